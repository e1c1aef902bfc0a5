"""Registered queries do the whole job: no prefix, no subset of ids, no short walk."""

import datetime as dt

import pandas as pd

from plumbline.operators.lineage import resolve_sources
from plumbline.queries import catalog, checks, corpus


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


CLAIM = "record_id long, record_class string, sentence string, column_name string, table_name string, claim_type string, source_kind string, source_document string, split string"


def test_sentence_cap_takes_the_whole_sentence(spark, tmp_path):
    rows = [(i, "positive", f"the order has {i % 6}", None, None, "unique", None, None, None) for i in range(30)]
    _write(spark, tmp_path, "mine_claims_release", rows, CLAIM)
    got = corpus.sentence_cap(spark, str(tmp_path)).toPandas()
    per = pd.Series(got["record_id"] % 6).value_counts()
    assert per.to_dict() == {k: 3 for k in range(6)}


def test_receipts_of_every_customer_and_urn(spark, tmp_path):
    _write(spark, tmp_path, "customer", [(1,), (299,), (300,), (1200,), (None,)], "c_custkey long")
    at = dt.datetime(2024, 1, 29, 12)
    _write(spark, tmp_path, "events", [(1, 1, at, "purchase"), (2, 1200, at, "error"), (3, 5000, at, "view")], "event_id long, user_id long, ts timestamp_ntz, event_type string")
    got = {r.urn: r.verdict for r in checks.receipt_status(spark, str(tmp_path)).collect()}
    assert got == {"1": "PASS", "299": None, "300": None, "1200": "BLOCK", "5000": "WARN"}
    got = {r.urn: (r["class"], r.reason) for r in checks.search_classification(spark, str(tmp_path)).collect()}
    assert got == {"1": ("verified", None), "299": ("unverified", "never"), "300": ("unverified", "never"), "1200": ("rejected", None), "5000": ("verified", None)}


ENTITY = "urn string, kind string, owner string, deprecated boolean, live boolean, schema_available boolean, removed_at timestamp"
FIELD = "urn string, field_path string, native_type string, nullable boolean, tags array<string>, description string, dropped_at timestamp"
EDGE = "source_urn string, source_field string, target_urn string, target_field string"


def _urn(name):
    return f"urn:li:dataset:(urn:li:dataplatform:lake,{name},prod)"


def _chain(spark, folder, kinds):
    """A deprecated asset and a chain of assets of the given kinds below it."""
    urns = [_urn(f"n{i}") for i in range(len(kinds) + 1)]
    _write(spark, folder, "cat_entity", [(u, k, "t", k == "root", True, True, None) for u, k in zip(urns, ["root", *kinds])], ENTITY)
    _write(spark, folder, "cat_field", [], FIELD)
    _write(spark, folder, "cat_edge", [(a, None, b, None) for a, b in zip(urns, urns[1:])], EDGE)
    return urns


def test_blast_radius_goes_three_hops(spark, tmp_path):
    _chain(spark, tmp_path, ["dataset", "dataset", "dashboard", "dataset"])
    r = checks.blast_radius(spark, str(tmp_path)).collect()
    assert [(x.n_assets, x.n_dashboards, x.depth) for x in r] == [(3, 1, 3)]


def test_bi_hops_go_two_hops_on(spark, tmp_path):
    for at, last in ((3, 5), (2, 4), (1, 3)):  # the chart's place, and the depth of the last asset that belongs
        kinds = ["chart" if i == at else "dataset" for i in range(1, 8)]
        urns = _chain(spark, tmp_path / str(at), kinds)
        got = {x.node: x.depth for x in checks.bi_hops(spark, str(tmp_path / str(at))).collect()}
        assert got == {urns[i]: i for i in range(1, last + 1)}


def test_deprecated_upstream_has_no_last_hop(spark, tmp_path):
    urns = _chain(spark, tmp_path, ["dashboard" if i in (1, 4, 10) else "dataset" for i in range(1, 11)])
    got = {(r.source, r.consumer, r.hops) for r in catalog.deprecated_upstream_catalog(spark, str(tmp_path)).collect()}
    assert got == {(urns[0], urns[i], i + 1) for i in (1, 4, 10)}
    n = {r.kind: r.n_subjects for r in catalog.self_check_summary(spark, str(tmp_path)).collect()}
    assert n["deprecated_upstream_of_live"] == 1


def test_names_of_four_parts_resolve(spark):
    rel = spark.createDataFrame([("u", "srv.db.sch.tab"), ("v", "tab2")], "urn string, relation string")
    names = spark.createDataFrame([("Srv.db.sch.tab",), ("db.sch.tab",), ("x.srv.db.sch.tab",)], "name string")
    got = {r.name: (r.urn, r.status) for r in resolve_sources(names, rel).collect()}
    assert got == {"Srv.db.sch.tab": ("u", "resolved"), "db.sch.tab": ("u", "resolved"), "x.srv.db.sch.tab": (None, "unknown")}
