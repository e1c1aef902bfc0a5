from datetime import datetime

import pytest

from plumbline.operators.references import cascade, catalog_orphans, orphan_report

ENT = "urn string, schema_available boolean, registered_at timestamp, removed_at timestamp, owner string"
FLD = "urn string, field_path string, added_at timestamp, dropped_at timestamp"
EDG = "edge_id long, source_urn string, source_field string, target_urn string, target_field string, asserted_at timestamp, ingested_at timestamp, state string, at string"
T = lambda m: datetime(2024, m, 1)


def tables(spark, ent=(), fld=(), edg=()):
    return spark.createDataFrame(list(ent), ENT), spark.createDataFrame(list(fld), FLD), spark.createDataFrame(list(edg), EDG)


def edge(i, src, dst, field=None, at=6, ingested=7):
    return (i, src, None, dst, field, T(at) if at else None, T(ingested), "clash", "clash")


@pytest.fixture(scope="module")
def found(spark):
    ent = [
        ("urn:a", True, T(1), None, None), ("urn:a", True, T(1), None, None), ("urn:old", True, T(1), T(3), None), ("urn:again", True, T(1), T(3), None), ("urn:again", True, T(8), None, None),
        ("urn:late", True, T(8), None, None), ("urn:blind", False, T(1), None, None), (None, True, T(1), None, None),
    ]
    fld = [("urn:a", "x", T(1), None), ("urn:a", "[version=2.0].[type=struct].Payload.y", T(1), None), ("urn:a", "gone", T(1), T(2)), ("urn:a", "soon", T(9), None), ("urn:old", "z", T(4), None), (None, "x", T(1), None), ("urn:a", None, T(1), None)]
    edg = [
        edge(1, ' URN:"A"\n', "urn:a", "X "), edge(2, "urn:nobody", "urn:old", "z"), edge(3, "urn:again", "urn:late"), edge(4, None, "  "), edge(5, "urn:a", "urn:a", "payload.Y"), edge(6, "urn:a", "urn:a", "gone"),
        edge(7, "urn:a", "urn:a", "soon"), edge(8, "urn:a", "urn:a", "never"), edge(9, "urn:a", "urn:blind", "never"), edge(10, "urn:a", "urn:a", "[version=2.0]"), edge(11, "urn:nobody", "urn:a", at=None),
        edge(12, "urn:nobody", "urn:a", ingested=7), edge(12, "urn:a", "urn:a", ingested=9), edge(13, "urn:old", "urn:a", at=3), edge(None, "urn:nobody", "urn:a"),
    ]
    return catalog_orphans(*tables(spark, ent, fld, edg)).collect()


def test_states(found):
    got = {(int(r.record_id), r.ref_name, r.state) for r in found if r.table_name == "cat_edge" and r.kind == "direct"}
    assert got == {
        (2, "source_urn", "missing"), (2, "target_urn", "deleted"), (3, "source_urn", "deleted"), (3, "target_urn", "late"), (6, "target_field", "deleted"), (7, "target_field", "late"), (8, "target_field", "missing"), (13, "source_urn", "deleted"),
    }


def test_children_inherit(spark):
    ent = [("urn:a", True, T(1), None, None), ("urn:b", True, T(1), T(2), None), ("urn:b", True, T(5), None, None)]
    fld = [("urn:b", "x", T(3), None)]  # added while its asset was away
    rows = catalog_orphans(*tables(spark, ent, fld, [edge(1, "urn:a", "urn:b", "x")])).collect()
    assert {(r.table_name, r.ref_name, r.kind, r.depth) for r in rows} == {("cat_field", "urn", "direct", 0), ("cat_edge", "target_field", "inherited", 1)}


def test_orphans_of_orphans(spark):
    """A source that never was: the asset made from it, its field, the asset made from that one, and the references to them."""
    ent = [(f"urn:{x}", True, T(1), None, None) for x in "bcz"]
    fld = [("urn:b", "x", T(2), None), ("urn:z", "y", T(2), None)]
    edg = [edge(1, "urn:nobody", "urn:b"), edge(2, "urn:b", "urn:c", at=7), edge(3, "urn:z", "urn:b", "x"), edge(4, "urn:nobody", "urn:gone", "f"), edge(5, "urn:z", "urn:z", "y")]
    rows = catalog_orphans(*tables(spark, ent, fld, edg)).collect()
    got = {(r.table_name, r.record_id.split("@")[0], r.ref_name, r.state, r.depth) for r in rows}
    assert got == {
        ("cat_edge", "1", "source_urn", "missing", 0), ("cat_edge", "4", "source_urn", "missing", 0), ("cat_edge", "4", "target_urn", "missing", 0), ("cat_edge", "4", "target_field", "unjudged", 1),
        ("cat_entity", "urn:b", "derived_by", "held", 1), ("cat_edge", "1", "target_urn", "held", 2), ("cat_edge", "3", "target_urn", "held", 2), ("cat_edge", "2", "source_urn", "held", 2),
        ("cat_field", "urn:b#x", "urn", "held", 2), ("cat_entity", "urn:c", "derived_by", "held", 3), ("cat_edge", "3", "target_field", "held", 3), ("cat_edge", "2", "target_urn", "held", 4),
    }


def test_another_lifetime_is_another_record(spark):
    ent = [("urn:a", True, T(1), None, None), ("urn:b", True, T(2), None, None)]
    fld = [("urn:b", "x", T(1), T(3)), ("urn:b", "x", T(4), None)]  # the first lifetime began before its asset was there
    rows = catalog_orphans(*tables(spark, ent, fld, [edge(1, "urn:a", "urn:b", "x", at=2), edge(2, "urn:a", "urn:b", "x", at=6)])).collect()
    assert {(r.record_id.split("@")[0], r.kind) for r in rows} == {("urn:b#x", "direct"), ("1", "inherited")}


def test_cascade_ends_on_cycles(spark):
    links = spark.createDataFrame([("t", "a", "t", "b"), ("t", "b", "t", "c"), ("t", "c", "t", "a"), ("t", "d", "t", "c"), ("t", "e", "t", "x")], "node_type string, node_id string, parent_type string, parent_id string")
    direct = spark.createDataFrame([("t", "a"), ("t", "a")], "node_type string, node_id string")
    assert {(r.node_id, r.depth) for r in cascade(direct, links).collect()} == {("a", 0), ("c", 1), ("b", 2), ("d", 2)}


def test_empty(spark):
    assert catalog_orphans(*tables(spark)).count() == 0
    only_edges = catalog_orphans(*tables(spark, edg=[edge(1, "urn:a", "urn:b", "x")]))
    assert {(r.ref_name, r.state) for r in only_edges.collect()} == {("source_urn", "missing"), ("target_urn", "missing"), ("target_field", "unjudged")}
    assert orphan_report(only_edges).count() == 3
