import random

from plumbline.operators import graph


def _model(edges, roots, depth=None):
    out = {}
    for root in roots:
        seen, layer, k = {root: 0}, {root}, 0
        while layer and (depth is None or k < depth):
            k += 1
            layer = {b for a, b in edges if a in layer and b not in seen}
            seen |= {b: k for b in layer}
        out |= {(root, n): d for n, d in seen.items() if d}
    return out


def test_reach_and_paths_against_a_model(spark):
    for seed in range(3):
        r = random.Random(seed)
        nodes = [f"n{i}" for i in range(9)]
        edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(14)]
        e = spark.createDataFrame(edges, "src string, dst string")
        roots = ["n0", "n1", "n9"]
        seeds = spark.createDataFrame([(x,) for x in roots], "root string")
        for depth in (None, 2):
            assert {(x.root, x.node): x.depth for x in graph.reach(e, seeds, depth).collect()} == _model(edges, roots, depth)
        full = _model(edges, roots, 9)
        for x in graph.shortest_paths(e, seeds, 9).collect():
            assert len(x.path) - 1 == full[x.root, x.node] and all((a, b) in edges for a, b in zip(x.path, x.path[1:]))
        want = {n for (root, n) in full if root == "n0"} | {"n0"}
        assert {x.node for x in graph.closure(e, spark.createDataFrame([("n0",)], "node string")).collect()} == want


def test_least_path_wins(spark):
    e = spark.createDataFrame([("a", "c"), ("a", "b"), ("c", "z"), ("b", "z"), ("a", "a")], "src string, dst string")
    got = graph.shortest_paths(e, spark.createDataFrame([("a",)], "root string"), 5).where("node = 'z'").first()
    assert got.path == ["a", "b", "z"]


def test_neighbours(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "a")], "src string, dst string")
    assert {tuple(r) for r in graph.neighbours(e).collect()} == {("a", "b"), ("b", "a")}
    assert graph.ego_net(e, spark.createDataFrame([("b",)], "node string")).count() == 2


def test_large_graphs_take_another_way_to_the_same_paths(spark, monkeypatch):
    r = random.Random(8)
    edges = [(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(30)]
    e, seeds = spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("n0",), ("n1",)], "root string")
    want = {(x.root, x.node): x.path for x in graph.shortest_paths(e, seeds).collect()}
    monkeypatch.setattr(graph, "LAYER_ROWS", 0)
    monkeypatch.setattr(graph, "FOLD", 2)
    assert {(x.root, x.node): x.path for x in graph.shortest_paths(e, seeds).collect()} == want
    chain = spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(9)], "src string, dst string")
    got = {x.node: x.depth for x in graph.reach(chain, spark.createDataFrame([("c00",)], "root string")).collect()}
    assert got == {f"c{i:02}": i for i in range(1, 10)}
