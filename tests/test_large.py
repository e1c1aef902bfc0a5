"""What keeps large catalogs within limits, and gives what the plain way gives."""

import random
import time
from dataclasses import replace

from plumbline import api
from plumbline.operators import audit, change, graph
from plumbline.operators import self_check as sc
from plumbline.operators.references import asset_key, field_key, has_key
from plumbline.operators.snapshot import Snapshot, from_tables, load
from plumbline.queries import catalog, checks
from tests.oracle import connect, same

ENT = "urn string, kind string, owner string, deprecated boolean, live boolean, schema_ok boolean"
FLD = "urn string, path string, native_type string, nullable boolean, tags array<string>, description string"
EDG = "src string, src_field string, dst string, dst_field string"


def _snapshot(spark, seed, n=14, m=18):
    r = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(n)]
    ent = [(x, r.choice(("dataset", "dataset", "chart", "dashboard")), r.choice(("t", "u", None)), r.random() < 0.5, r.random() < 0.6, r.random() < 0.8) for x in nodes]
    fld = [(x, "id", "int", True, r.choice(([], ["pii"], ["Critical"])), None) for x in nodes]
    edg = {(r.choice(nodes), r.choice(("id", "x")), r.choice([*nodes, "ghost"]), r.choice(("id", "x"))) for _ in range(m)}
    return Snapshot(spark.createDataFrame(ent, ENT), spark.createDataFrame(fld, FLD), spark.createDataFrame(sorted(edg), EDG))


def test_sources_of_live_are_the_subjects_of_the_pairs(spark):
    for seed in range(2):
        s = _snapshot(spark, seed)
        want = {r.subject for r in sc.deprecated_upstream_of_live(s).collect()}
        assert {r.subject for r in sc.deprecated_sources_of_live(s).collect()} == want
    loop = [(x, "chart", "t", True, True, True) for x in "ab"] + [("c", "dataset", "t", False, False, True)]
    edges = [("a", None, "c", None), ("c", None, "a", None), ("b", None, "a", None), ("b", None, "b", None)]
    s = Snapshot(spark.createDataFrame(loop, ENT), spark.createDataFrame([], FLD), spark.createDataFrame(edges, EDG))
    assert {r.subject for r in sc.deprecated_sources_of_live(s).collect()} == {"b"}  # a only leads to itself


def _plain(order, near, bad, prior, budget):
    queue, seen, out = list(order), set(), []
    while queue:
        u = queue.pop(0)
        if u in seen:
            continue
        seen.add(u)
        if u in prior or budget == 0:
            out.append((u, ("refused" if prior[u] == "BLOCK" else "vouched") if u in prior else "deferred"))
            continue
        budget -= 1
        kinds = bad.get(u, set())
        out.append((u, "unestablished" if kinds and all(k.endswith("_unverifiable") for k in kinds) else "finding" if kinds else "clean"))
        if kinds & set(audit.CONTAGIOUS):
            queue = [x for x in sorted(near.get(u, ()), reverse=True) if x in order and x not in seen] + queue
    return out


def test_audit_makes_no_pair_and_reads_neighbours_as_it_goes(spark, monkeypatch):
    s = _snapshot(spark, 5)
    bad, near = {}, {}
    for r in sc.attributed(s, sc.run_all(s)).collect():
        bad.setdefault(r.urn, set()).add(r.kind)
    for r in graph.neighbours(s.asset_edges).collect():
        near.setdefault(r.node, set()).add(r.neighbour)
    order = [r.urn for r in audit.plan(s).orderBy("position").collect()]
    monkeypatch.setattr(sc, "shortest_paths", None)
    asked, look = [], audit.Near.__call__
    monkeypatch.setattr(audit.Near, "__call__", lambda self, u: asked.append(u) or look(self, u))
    assert [(r.urn, r.outcome) for r in api.audit(s, 8).orderBy("step").collect()] == _plain(order, near, bad, {}, 8)
    assert 0 < len(asked) <= 8


def _both_ways(s, make, monkeypatch):
    """The rows by joins, and by numbers without the joins."""
    roots = s.entity.where("deprecated").selectExpr("urn as root")
    with monkeypatch.context() as m:
        m.setattr(graph, "PACKED_EDGES", 0)
        want = sorted(map(tuple, make(s, roots).collect()))
    with monkeypatch.context() as m:
        m.setattr(change, "reach", None)
        got = sorted(map(tuple, make(s, roots).collect()))
    assert want and got == want


def test_bi_hops_by_numbers(spark, monkeypatch):
    for seed in range(2):
        _both_ways(_snapshot(spark, seed, 90, 130), lambda s, r: change.with_bi_hops(s, r).select("root", "node", "depth"), monkeypatch)


def test_blast_evidence_counts_without_pairs(spark, monkeypatch):
    _both_ways(_snapshot(spark, 3, 90, 130), change.blast_evidence, monkeypatch)


def test_pairs_above_live_need_no_paths(spark, data, monkeypatch):
    for walk in ("shortest_paths", "reach"):
        monkeypatch.setattr(sc, walk, None)
    same(catalog.deprecated_upstream_catalog(spark, data).toPandas(), connect(data).execute(catalog.ORACLE["deprecated_upstream_catalog"]).df())


def test_audit_summary_needs_no_pairs(spark, data, monkeypatch):
    monkeypatch.setattr(sc, "shortest_paths", None)
    per = {r.outcome: r.n for r in checks.audit_summary(spark, data).collect()}
    assert sum(per.values()) == checks.audit_plan(spark, data).count()


def test_summaries_need_no_pairs(spark, data, monkeypatch):
    """Without the walk that makes pairs; the SQL says how many subjects there are."""
    monkeypatch.setattr(sc, "shortest_paths", None)
    same(catalog.self_check_summary(spark, data).toPandas(), connect(data).execute(catalog.ORACLE["self_check_summary"]).df())


def test_check_change_makes_no_pairs(spark, data, monkeypatch):
    monkeypatch.setattr(change, "reach", None)
    same(checks.check_change(spark, data).toPandas(), connect(data).execute(checks.ORACLE["check_change"]).df())


def test_swarm_reads_findings_once(spark, monkeypatch):
    s = _snapshot(spark, 5)
    bad, near = {}, {}
    found = sc.attributed(s, sc.run_all(s, paths=False))
    for r in found.collect():
        bad.setdefault(r.urn, set()).add(r.kind)
    for r in graph.neighbours(s.asset_edges).collect():
        near.setdefault(r.node, set()).add(r.neighbour)
    read, kinds = [], audit._kinds
    monkeypatch.setattr(audit, "_kinds", lambda f: read.append(1) or kinds(f))
    plan = audit.plan(s)
    got = audit.swarm(plan, graph.neighbours(s.asset_edges), found, ["a", "b"], 3).orderBy("worker", "step").collect()
    want, done = [], {}
    for w in ("a", "b"):
        rows = _plain([r.urn for r in audit.rotation(plan, w).orderBy("turn").collect()], near, bad, done, 3)
        want += [(w, *x) for x in rows]
        done |= {u: "WARN" if o == "finding" else "PASS" for u, o in rows if o in ("finding", "clean")}
    assert [(r.worker, r.urn, r.outcome) for r in got] == want and read == [1]


def test_unions_of_evidence_do_not_zip_partitions(spark):
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    s = _snapshot(spark, 1)
    sc.lineage_field_missing(s)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"


def test_audit_leaves_no_shuffles_behind(spark, data, monkeypatch):
    """When the run over the plan begins, the shuffles of the checks and of the tables are gone from the disk."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}
    before, left, replay = files(), [], audit._replay

    def spied(*args):
        for _ in range(50):  # files are deleted in the background
            if not (rest := files() - before):
                break
            time.sleep(0.2)
        left.append(len(rest))
        return replay(*args)

    monkeypatch.setattr(audit, "_replay", spied)
    assert checks.audit_summary(spark, data).count() and left == [0]


def test_audit_run_is_the_plain_run(spark, data):
    s, near, bad = load(spark, data), {}, {}
    for r in graph.neighbours(s.asset_edges).collect():
        near.setdefault(r.node, set()).add(r.neighbour)
    for r in sc.attributed(s, sc.run_all(s)).collect():
        bad.setdefault(r.urn, set()).add(r.kind)
    prior = {r.urn: "PASS" if len(r.urn) % 2 == 0 else "BLOCK" for r in s.entity.collect() if len(r.urn) % 5 == 0}
    got = checks.audit_run(spark, data).orderBy("step").collect()
    assert [(r.urn, r.outcome) for r in got] == _plain([r.urn for r in audit.plan(s).orderBy("position").collect()], near, bad, prior, 50)
    examined = ("finding", "clean", "unestablished")
    assert [r.n_kinds for r in got] == [len(bad.get(r.urn, ())) if r.outcome in examined else 0 for r in got]


def test_kinds_are_those_of_the_evidence(spark):
    for seed in range(2):
        s = _snapshot(spark, seed)
        for s in (s, replace(s, entities_complete=False, resolved=s.entity.where("live").select("urn"))):
            assert sorted(map(tuple, sc.kinds(s).collect())) == sorted(map(tuple, sc.attributed(s, sc.run_all(s)).collect()))


def test_names_without_a_key(spark):
    names = ["a", " A ", '"', "'`\"", " ﻿​", ' "\t', "“x”", "", None, ".", "[x]", "\U0001f600", "\xa0.\xad"]
    df = spark.createDataFrame([(x,) for x in names], "x string")
    assert df.where(has_key(df["x"]) != asset_key(df["x"]).isNotNull()).count() == 0 and df.where(has_key(df["x"])).count() == 7
    edges = spark.createDataFrame([("A", x, "b", x) for x in names] + [(x, None, "b", None) for x in names], "source_urn string, source_field string, target_urn string, target_field string")
    none = spark.createDataFrame([], "urn string, kind string, owner string, deprecated boolean, live boolean, schema_available boolean, removed_at timestamp")
    fields = spark.createDataFrame([], "urn string, field_path string, native_type string, nullable boolean, tags array<string>, description string, dropped_at timestamp")
    key = lambda c: asset_key(edges[c])
    want = edges.select(key("source_urn"), field_key(edges["source_field"]), key("target_urn"), field_key(edges["target_field"])).where(key("source_urn").isNotNull() & key("target_urn").isNotNull())
    assert sorted(map(str, from_tables(none, fields, edges).edge.collect())) == sorted(map(str, want.toDF("src", "src_field", "dst", "dst_field").distinct().collect()))
