import pytest

from plumbline import api
from plumbline.operators import audit, change, claims, corpus, policy, receipts, repair
from plumbline.operators import self_check as sc
from plumbline.operators.snapshot import Snapshot, bounded

ENT = "urn string, kind string, owner string, deprecated boolean, live boolean, schema_ok boolean"
FLD = "urn string, path string, native_type string, nullable boolean, tags array<string>, description string"
EDG = "src string, src_field string, dst string, dst_field string"


@pytest.fixture(scope="module")
def snap(spark):
    ent = [("a", "dataset", None, False, False, True), ("b", "dataset", "t", True, False, True), ("d", "dashboard", "t", False, True, False), ("blind", "dataset", "t", False, False, False), ("e", "dataset", None, False, False, True)]
    fld = [("a", "id", "int", False, ["pii"], "see column b_key here"), ("b", "ID", "int4", True, [], None), ("b", "safe", "text", True, ["gdpr"], None), ("b", "no", "text", True, ["nonPII"], None)]
    edg = [("a", "id", "b", "id"), ("a", "id", "b", "ID"), ("a", "id", "b", "safe"), ("a", "id", "b", "no"), ("b", None, "d", None), ("a", None, "ghost", None), ("a", None, "blind", "x"), ("b", "no", "b", "lost"), ("b", None, "e", None), ("e", None, "d", None)]
    return Snapshot(spark.createDataFrame(ent, ENT), spark.createDataFrame(fld, FLD), spark.createDataFrame(edg, EDG))


def _pairs(df):
    return sorted({(r.kind, r.subject) for r in df.select("kind", "subject").collect()})


def test_self_checks(snap):
    assert _pairs(sc.run_all(snap)) == [
        ("deprecated_upstream_of_live", "b"), ("doc_references_missing_column", "a#id"), ("lineage_field_missing", "b#lost"), ("lineage_field_missing_unverifiable", "blind"), ("orphan_lineage", "ghost"),
        ("pii_leak_untagged", "b#ID"), ("pii_leak_untagged", "b#no"), ("unowned_consumed", "a"), ("unowned_consumed", "e"),
    ]


def test_bounded_snapshot_cannot_say(snap):
    small = bounded(snap, 1)
    assert ("orphan_lineage_unverifiable", "catalog") in _pairs(sc.run_all(small)) and not small.entities_complete
    assert small.edge.where("src_field is not null").count() == 1  # of b, the most connected


def test_changes(spark, snap):
    refs = spark.createDataFrame([("a", "id"), ("a", "nope"), ("ghost", "x"), ("blind", "x"), ("b", "ID")], "urn string, path string")
    assert _pairs(change.schema_gate(snap, refs)) == [("schema_unverifiable", "blind"), ("unknown_dataset", "ghost"), ("unknown_field", "a#nope")]
    live = spark.createDataFrame([("a", "id", "INTEGER", False), ("b", "ID", "integer", True)], "urn string, path string, native_type string, nullable boolean")
    urns = spark.createDataFrame([("a",), ("b",), ("e",)], "urn string")
    assert _pairs(change.reality_diff(snap, live, urns)) == [("catalog_reality_mismatch", "b"), ("graph_unavailable", "e")]
    found, verdict = api.check(snap, refs)
    assert verdict.first().decision == "BLOCK" and verdict.first().reason_code == "UNVERIFIABLE_CHANGE"
    assert {r.truthful for r in api.verify_context(snap, live, spark.createDataFrame([("a",), ("b",)], "urn string")).collect()} == {False}


def test_policy(spark):
    text = """
version: 1
unhandled_evidence: info
settings: {n: 5}
rules:
  - {id: big, kind: k, severity: block, where: [{field: detail.count, op: gt, value: $settings.n}], message: "{subject}: {detail.count}"}
  - {id: any, kind: k, severity: warn, where_any: [{field: detail.a, op: eq, value: 1}, {field: subject, op: in, value: [s2]}]}
"""
    p = policy.load(text)
    rows = [(1, "k", "s1", '{"count": 6, "a": 1}'), (2, "k", "s2", '{"count": 5}'), (3, "k", "s3", '{"count": "many"}'), (4, "k", "s4", "{}"), (5, "q", "s5", "{}")]
    got = policy.findings(spark.createDataFrame(rows, "ord long, kind string, subject string, detail string"), p).orderBy("ord", "rule_ord").collect()
    assert [(r.ord, r.rule_id, r.severity) for r in got] == [(1, "big", "block"), (1, "any", "warn"), (2, "any", "warn"), (3, "policy_evaluation_failed", "block"), (4, "informational", "info"), (5, "unhandled_evidence", "info")]
    assert got[0].message == "s1: 6"
    for bad in ("version: 2", "version: 1\nunhandled_evidence: maybe", text.replace("$settings.n", "$settings.x"), text.replace("op: gt", "op: above"), text.replace("severity: warn", "severity: bad"), text.replace("id: any", "id: big"), text.replace("detail.count, op", "wrong, op")):
        with pytest.raises(policy.PolicyError):
            policy.load(bad)
    assert len(policy.load().rules) == 38


def test_claims(spark):
    df = spark.createDataFrame([(1, "x", 5), (1, None, 7), (2, "y", None), (None, "z", 1)], "k int, s string, v int")
    other = spark.createDataFrame([(1,), (None,)], "k int")
    C = claims.Claim
    cs = [C("unique", ("k",)), C("not_null", ("s",)), C("accepted_values", ("s",), ("x", "y")), C("expression", ("v",), expr="v > 4"), C("relationships", ("k",), target=("o", "k")), C("not_null", ("gone",)), C("expression", ("v",), expr="(select 1) = 1", name="bad")]
    got = {r.claim: (r.status, r.violations) for r in claims.verify(df, cs, {"o": other}).collect()}
    assert got == {"unique(k)": ("violated", 2), "not_null(s)": ("violated", 1), "accepted_values(s)": ("violated", 1), "expression(v)": ("violated", 2), "relationships(k)": ("violated", 1), "not_null(gone)": ("unverifiable", None), "bad": ("unverifiable", None)}
    casts = [C("expression", ("s",), expr="cast(s as int) > 0", name="cast"), C("not_null", ("k",))]
    assert {r.claim: r.status for r in claims.verify_each(spark, df, casts).collect()} == {"cast": "unverifiable", "not_null(k)": "violated"}
    empty = df.where("false")
    assert {r.status for r in claims.verify(empty, cs[:4]).collect()} == {"holds"}
    with pytest.raises(ValueError):
        C("guess", ("k",))


def test_receipts(spark, tmp_path):
    log = spark.createDataFrame([("urn:li:dataset:x", "PASS", "2024-01-01"), ("urn:li:dataset:x", "BLOCK", "2024-02-01"), ("urn:li:chart:y", "PASS", "2024-01-01")], "urn string, verdict string, checked_at string")
    assert receipts.append(log, str(tmp_path / "log")) == 2
    assert [(r.urn, r.verdict) for r in receipts.latest(log).orderBy("urn").collect()] == [("urn:li:chart:y", "PASS"), ("urn:li:dataset:x", "BLOCK")]
    assert "| verdict |" in receipts.render(log.select("urn", "verdict"))


def test_audit_budget_and_repairs(spark, snap):
    plan = audit.plan(snap)
    assert [r.position for r in plan.orderBy("position").collect()] == [1, 2, 3, 4]
    got = api.audit(snap, 2)
    assert got.where("outcome in ('finding', 'clean', 'unestablished')").count() == 2 and got.count() == 4
    tags = repair.propose_tags(snap)
    before, after = sc.pii_leak_untagged(snap), sc.pii_leak_untagged(repair.with_tags(snap, tags))
    proof = repair.prove(before, after, before)
    assert {r.outcome for r in proof.collect()} == {"resolved"} and repair.unfixed(before, proof).count() == 0
    assert [(r.urn, r.owner) for r in repair.propose_owners(snap).collect()] == [("e", "t")]


def test_first_n_matches_a_plain_rank(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    got = {(r.g, r.h) for r in corpus.first_n(df, ["g"], [F.col("h")], 7).collect()}
    rows = [(r.g, r.h) for r in df.collect()]
    assert got == {x for g in range(3) for x in sorted(r for r in rows if r[0] == g)[:7]}
    assert corpus.class_quota({"a": 10, "b": 100}, {"a": 0.5, "b": 0.5}) == {"a": 10, "b": 10}


def test_documentation_after_the_change(spark):
    rows = [("t", "names `never_there`, 'quoted col', kept_col and gone_col, but not Upper_Case or xkept_colX", ["kept_col", "gone_col"], ["new_col"], ["gone_col"]), ("u", "new_col is there", [], ["new_col"], []), ("v", None, [], [], [])]
    docs = spark.createDataFrame(rows, "urn string, description string, fields array<string>, added array<string>, removed array<string>")
    assert {(r.subject, r.detail) for r in change.doc_rot(docs).collect()} == {("t", f'{{"mentioned_field":"{m}"}}') for m in ("never_there", "quoted col", "gone_col")}


def test_all_gates_of_a_change(spark, snap):
    refs = spark.createDataFrame([("b", "ID"), ("ghost", "x")], "urn string, path string")
    computed = spark.createDataFrame([("a", "id", "b", "ID"), ("a", "id", "b", "other")], EDG)
    docs = spark.createDataFrame([("b", "see lost_col", ["ID"], [], [])], "urn string, description string, fields array<string>, added array<string>, removed array<string>")
    live = spark.createDataFrame([("b", "ID", "integer", True)], "urn string, path string, native_type string, nullable boolean")
    e = api.change_evidence(snap, refs, live, docs, computed)
    assert {r.kind for r in e.select("kind").distinct().collect()} == {"unknown_dataset", "deprecated_upstream", "blast_radius", "catalog_reality_mismatch", "doc_rot", "lineage_rot_missing", "lineage_rot_extra"}
    found, _ = api.check(snap, refs, live=live, docs=docs, computed=computed)
    assert {"partial_blast_radius", "doc_rot", "lineage_rot", "lineage_rot_extra"} - {r.rule_id for r in found.collect()} == {"partial_blast_radius"}
    critical = Snapshot(snap.entity, spark.createDataFrame([("d", "x", "int", True, ["Business-Critical"], None)], FLD), snap.edge)
    found, _ = api.check(critical, refs.where("urn = 'b'"))
    assert "critical_downstream" in {r.rule_id for r in found.collect()}
    from plumbline.operators.snapshot import bounded as bound

    part = change.lineage_rot(bound(snap, 1), computed, spark.createDataFrame([("b",), ("a",)], "urn string"))
    assert ("lineage_rot_unverifiable", "a") in _pairs(part)


def test_dangling_edges_are_laid_to_who_states_them(spark):
    ent = [(x, "dataset", "t", False, False, True) for x in ("a", "b", "c")] + [("w", "dataset", "t", False, False, False)]
    s = Snapshot(spark.createDataFrame(ent, ENT), spark.createDataFrame([("b", "x", "int", True, [], None)], FLD), spark.createDataFrame([("a", None, "ghost", None), ("b", "x", "w", "y")], EDG))
    assert {tuple(r) for r in sc.attributed(s, sc.run_all(s)).collect()} == {("a", "orphan_lineage"), ("w", "lineage_field_missing_unverifiable")}
    got = {r.urn: r.outcome for r in api.audit(s, 10).collect()}
    assert got == {"a": "finding", "b": "clean", "c": "clean", "w": "unestablished"}
    assert {(r.urn, r.verdict) for r in audit.run_receipts(api.audit(s, 10)).collect()} == {("a", "WARN"), ("b", "PASS"), ("c", "PASS")}
    live = spark.createDataFrame([(x, "x", "int", True) for x in "abc"], "urn string, path string, native_type string, nullable boolean")
    urns = spark.createDataFrame([("a",), ("b",)], "urn string")
    assert {r.urn: r.truthful for r in api.verify_context(s, live, urns).collect()} == {"a": False, "b": True}
    bad = spark.createDataFrame([("b", "contradicts")], "relation string, state string")
    assert not any(r.truthful for r in api.verify_context(s, live, urns, reconciled=bad).collect())


def test_proposals_are_proven_one_by_one(spark):
    ent = [(x, "dataset", "t", False, False, True) for x in "abcd"]
    fld = [("a", "x", "int", True, ["pii"], None), ("b", "x", "int", True, [], None), ("c", "x", "int", True, [], None), ("d", "x", "int", True, [], None)]
    edg = [("a", "x", "b", "x"), ("a", "x", "d", "x"), ("b", "x", "c", "x")]
    s = Snapshot(spark.createDataFrame(ent, ENT), spark.createDataFrame(fld, FLD), spark.createDataFrame(edg, EDG))
    got = {r.urn: (r.outcome, r.collateral) for r in repair.prove_each(s, repair.propose_tags(s)).collect()}
    assert got == {"b": ("collateral", 1), "d": ("proven", 0)}
    blind = Snapshot(s.entity.withColumn("schema_ok", s.entity.urn != "c"), s.field, s.edge)
    assert {r.outcome for r in repair.prove_each(blind, repair.propose_tags(blind)).collect()} == {"refused"}


def test_forged_receipts_and_excluded_constraints(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import constraints
    from plumbline.sources import live

    log = spark.createDataFrame([("a", "PASS", "2024-01-01 00:00:00", False), ("b", "PASS", "2024-01-01 00:00:00", True)], "urn string, verdict string, checked_at string, intact boolean").withColumn("checked_at", F.col("checked_at").cast("timestamp"))
    got = receipts.classification(spark.createDataFrame([("a",), ("b",)], "urn string"), log, F.lit("2024-01-01 00:00:10").cast("timestamp"), 60)
    assert {(r.urn, r["class"], r.reason) for r in got.collect()} == {("a", "unverified", "tampered"), ("b", "verified", None)}
    ddl = spark.createDataFrame([("r", "CREATE TABLE r (a int, CONSTRAINT no_overlap EXCLUDE USING gist (a WITH =))")], "relation string, text string")
    (row,) = live.from_ddl(spark, ddl).collect()
    assert (row.name, row.kind) == ("no_overlap", "opaque")
    assert constraints.normalize(spark, [(row.relation, row.name, row.kind, [], row.definition, False)]).first().opaque
