import random

from plumbline.llm import packing


def test_packs_hold_everything_and_waste_little():
    r = random.Random(2)
    lengths = [min(100, max(1, int(r.expovariate(1 / 25)))) for _ in range(4000)]
    packs = packing.best_two_fit(lengths, 100)
    assert sorted(x for p in packs for x in p) == sorted(lengths) and all(sum(p) <= 100 for p in packs)
    assert sum(lengths) / (100 * len(packs)) > 0.99


def test_two_replace_the_shortest():
    # greedy takes 60 and 30; 30 makes way for 22 and 18
    assert sorted(map(sorted, packing.best_two_fit([60, 30, 22, 18], 100))) == [[18, 22, 60], [30]]
    assert packing.best_two_fit([], 10) == [] and packing.best_two_fit([10, 0, 10], 10) == [[10], [10]]


def test_documents(spark):
    rows = [(1, 0), (2, 25), (3, 10), (4, 3), (4, 3), (None, 5), (5, 7), (6, 20)]
    counts = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    caps = spark.createDataFrame([("p", 10), ("p", 10), ("q", 100), ("bad", 0), ("none", None)], "pack_name string, capacity long")
    got = packing.pack_documents(counts, caps).collect()
    p = [x for x in got if x.pack_name == "p"]
    assert sorted((x.doc_id, x.piece, x.start_token, x.n_tokens) for x in p) == [(1, 0, 0, 0), (2, 0, 0, 10), (2, 1, 10, 10), (2, 2, 20, 5), (3, 0, 0, 10), (4, 0, 0, 3), (4, 0, 0, 3), (5, 0, 0, 7), (6, 0, 0, 10), (6, 1, 10, 10)]
    used = {}
    for x in got:
        if x.pack_id is not None:
            used[x.pack_id] = used.get(x.pack_id, 0) + x.n_tokens
            assert used[x.pack_id] <= x.capacity
    assert {x.doc_id for x in got if x.n_pieces > 1 and x.pack_name == "p"} == {2, 6} and {x.pack_name for x in got} == {"p", "q"}
    assert [x.pack_id for x in got if x.doc_id == 1] == [None, None]
    assert packing.pack_documents(counts.where("false"), caps).count() == 0
