"""Contradictions inside a catalog: six checks, each a set operation over the whole snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import is_pii_tag, is_protection_tag, leaf
from plumbline.functions.text import strict_references
from plumbline.operators.graph import closure, packed, packed_pairs, reach, shortest_paths, witnesses
from plumbline.operators.snapshot import Snapshot
from plumbline.schemas import EVIDENCE, evidence, union, unverifiable
from plumbline.session import cut, tidy

#: A graph of more edges is pruned before it is walked from many roots; in a smaller one that costs more than it saves.
PRUNE_EDGES = 1_000_000
BI_KINDS = ("chart", "dashboard")


def _one(df: DataFrame) -> DataFrame:
    """A row for a statement about the catalog as a whole."""
    return df.sparkSession.range(1)


def orphan_lineage(s: Snapshot) -> DataFrame:
    """Edges whose source or target is not in the catalog, a row per missing end. A catalog that was not read whole cannot say."""
    if not s.entities_complete:
        return unverifiable(_one(s.entity), "orphan_lineage", F.lit("catalog"), "the entities were not read completely")
    side = lambda name, urn, other: F.struct(F.lit(name).alias("side"), F.col(urn).alias("urn"), F.col(other).alias("other"))
    ends = s.edge.select(F.explode(F.array(side("source", "src", "dst"), side("target", "dst", "src"))).alias("e")).select("e.*")
    lost = ends.join(s.entity.select("urn"), "urn", "left_anti").distinct()  # of the lost ends only, which are few
    src, dst = (F.when(F.col("side") == x, F.col("urn")).otherwise(F.col("other")) for x in ("source", "target"))
    return evidence(lost, "orphan_lineage", F.col("urn"), side=F.col("side"), src=src, dst=dst)


def lineage_field_missing(s: Snapshot) -> DataFrame:
    """Target fields that the target's schema lacks under every spelling: as it is, case folded, or by its last segment."""
    claimed = s.edge.where(F.col("dst_field").isNotNull()).select("dst", "dst_field").distinct()
    known = claimed.join(s.entity.where("kind = 'dataset'").select(F.col("urn").alias("dst"), "schema_ok"), "dst")
    blind = unverifiable(known.where("not schema_ok"), "lineage_field_missing", F.col("dst"), "the schema of the target is not available")
    fields = s.field.select(F.col("urn").alias("dst"), "path")
    exact = fields.select("dst", F.lower("path").alias("_k")).distinct()
    leaves = fields.select("dst", leaf(F.col("path")).alias("_l")).where("_l <> ''").distinct()
    open_ = known.where("schema_ok").withColumn("_k", F.lower("dst_field")).withColumn("_l", leaf(F.col("dst_field")))
    lost = open_.join(exact, ["dst", "_k"], "left_anti").join(leaves, ["dst", "_l"], "left_anti")
    return union(evidence(lost, "lineage_field_missing", F.concat_ws("#", "dst", "dst_field"), field=F.col("dst_field")), blind)


def pii_leak_untagged(s: Snapshot) -> DataFrame:
    """Column edges from a field with a PII tag to a field that carries neither that tag nor any mark of protection."""
    tags = s.field.join(s.entity.where("kind = 'dataset' and schema_ok").select("urn"), "urn", "left_semi").select("urn", "path", "tags")
    src = tags.select(F.col("urn").alias("src"), F.col("path").alias("src_field"), F.filter("tags", is_pii_tag).alias("pii")).where(F.size("pii") > 0)
    dst = tags.select(F.col("urn").alias("dst"), F.col("path").alias("dst_field"), F.col("tags").alias("dst_tags"))
    leaks = s.edge.where("src_field is not null and dst_field is not null").join(src, ["src", "src_field"]).join(dst, ["dst", "dst_field"])
    leaks = leaks.where(~F.arrays_overlap("pii", "dst_tags") & ~F.exists("dst_tags", is_protection_tag))
    return evidence(leaks, "pii_leak_untagged", F.concat_ws("#", "dst", "dst_field"), source=F.concat_ws("#", "src", "src_field"), tags=F.col("pii"))


def unowned_consumed(s: Snapshot) -> DataFrame:
    """Assets without an owner that another known asset reads from."""
    e = s.edge.select("src", "dst").where(F.col("src") != F.col("dst")).join(s.entity.where(F.col("owner").isNull()).select(F.col("urn").alias("src")), "src", "left_semi")
    used = e.join(s.entity.select(F.col("urn").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.count_distinct("dst").alias("n"))
    return evidence(used, "unowned_consumed", F.col("src"), consumers=F.col("n"))


def _live_lineage(s: Snapshot) -> tuple[DataFrame, DataFrame]:
    """Edges between known assets, and the live charts and dashboards."""
    known = s.entity.select("urn")
    e = s.asset_edges.join(known.withColumnRenamed("urn", "src"), "src", "left_semi").join(known.withColumnRenamed("urn", "dst"), "dst", "left_semi")
    return e, s.entity.where(F.col("live") & F.col("kind").isin(*BI_KINDS)).select(F.col("urn").alias("node"))


def deprecated_upstream_of_live(s: Snapshot) -> DataFrame:
    """Deprecated assets that live charts and dashboards rest on, a row per pair, with the least shortest path; however far apart they are.
    In a large graph only edges that lead to a live chart or dashboard are walked, found by one walk backwards from all of them."""
    e, live = _live_lineage(s)
    e, roots = cut(e), s.entity.where("deprecated").select(F.col("urn").alias("root"))
    if e.count() > PRUNE_EDGES:
        above = closure(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), live)
        e, roots = e.join(above.withColumnRenamed("node", "dst"), "dst", "left_semi"), roots.join(above.withColumnRenamed("node", "root"), "root", "left_semi")
    paths = shortest_paths(e, roots, None, live)
    return evidence(paths, "deprecated_upstream_of_live", F.col("root"), live_consumer=F.col("node"), path=F.col("path"))


def live_below_deprecated(s: Snapshot) -> DataFrame:
    """(root, node, depth): the pairs of ``deprecated_upstream_of_live`` with the steps between them, and no paths."""
    e, live = _live_lineage(s)
    roots = s.entity.where("deprecated").select(F.col("urn").alias("root"))
    if (g := packed(e, roots)) is not None:
        return packed_pairs(g, wanted=g.mask(live))
    return reach(e, roots).join(live, "node", "left_semi").select("root", "node", "depth")


def deprecated_sources_of_live(s: Snapshot) -> DataFrame:
    """The subjects of ``deprecated_upstream_of_live``, each once and without its consumers: one walk backwards from all live charts and dashboards,
    where the pairs are as many as deprecated assets times consumers. Assets are numbers on the way, so that no round moves names."""
    bi = F.coalesce(F.col("live") & F.col("kind").isin(*BI_KINDS), F.lit(False))
    ids = cut(s.entity.groupBy("urn").agg(F.max("deprecated").alias("deprecated"), F.max(bi).alias("bi")).withColumn("id", F.monotonically_increasing_id()))
    at = lambda c: ids.select(F.col("urn").alias(c), F.col("id").alias(f"_{c}"))
    e = s.edge.select("src", "dst").where("src <> dst").join(at("src"), "src").join(at("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))
    leads = witnesses(e, ids.where("bi").select(F.col("id").alias("node"))).where(F.col("seed") != F.col("node")).select(F.col("node").alias("id"))
    return evidence(ids.where("deprecated").join(leads, "id", "left_semi"), "deprecated_upstream_of_live", F.col("urn"))


def doc_references_missing_column(s: Snapshot) -> DataFrame:
    """Columns that a field's description names, and the schema of the asset lacks; without a schema nothing can be said."""
    said = s.field.where(F.col("description").isNotNull()).select("urn", "path", F.explode(strict_references(F.col("description"))).alias("mentioned"))
    read = s.entity.select("urn", "schema_ok")
    said = said.join(read, "urn", "left").withColumn("schema_ok", F.coalesce("schema_ok", F.lit(True)))
    lost = said.where("schema_ok").join(s.field.select("urn", F.col("path").alias("mentioned")), ["urn", "mentioned"], "left_anti")
    blind = unverifiable(said.where("not schema_ok"), "doc_references_missing_column", F.col("urn"), "the schema of the asset is not available")
    return union(evidence(lost, "doc_references_missing_column", F.concat_ws("#", "urn", "path"), mentioned=F.col("mentioned")), blind)


CHECKS = {f.__name__: f for f in (orphan_lineage, lineage_field_missing, pii_leak_untagged, unowned_consumed, deprecated_upstream_of_live, doc_references_missing_column)}
#: The same without a row per pair: enough where only kinds and subjects are asked.
SUBJECTS = CHECKS | {"deprecated_upstream_of_live": deprecated_sources_of_live}


def unresolved_lineage(s: Snapshot) -> DataFrame:
    """Assets whose column edges were not read."""
    if s.resolved is None:
        return s.entity.sparkSession.createDataFrame([], EVIDENCE)
    rest = s.entity.where("kind = 'dataset'").join(s.resolved, "urn", "left_anti")
    return unverifiable(rest, "lineage_field_missing", F.col("urn"), "the column lineage was not read")


def attributed(s: Snapshot, found: DataFrame) -> DataFrame:
    """Evidence -> (urn, kind): the assets that it concerns. An edge to nowhere is laid to its other end, which states it; what could not
    be checked of the catalog as a whole concerns every asset."""
    urn = F.regexp_extract("subject", r"^([^#]*)", 1)
    ends = F.filter(F.array(F.get_json_object("detail", "$.src"), F.get_json_object("detail", "$.dst")), lambda x: x.isNotNull() & (x != F.col("subject")))
    own = F.when(F.col("kind") == "orphan_lineage", ends).otherwise(F.array(urn))
    per = found.select(F.explode(own).alias("urn"), "kind").distinct()
    if s.entities_complete:
        return per
    return per.unionByName(s.entity.select("urn", F.lit("orphan_lineage_unverifiable").alias("kind"))).distinct()


def run_all(s: Snapshot, paths: bool = True) -> DataFrame:
    """The evidence of all six checks. Without ``paths`` a deprecated asset above live ones is one row and not one per consumer: enough where
    only kinds and subjects are asked."""
    s = s.settled()
    return union(*(f(s) for f in (CHECKS if paths else SUBJECTS).values()), unresolved_lineage(s))


def kinds(s: Snapshot) -> DataFrame:
    """(urn, kind): what ``attributed`` makes of the evidence of all checks, for a snapshot that is settled. Each check is brought down to its
    assets and written out before the next one begins: no evidence is moved, and the disk holds the shuffles of one check at a time."""
    with tidy(s.entity.sparkSession):
        parts = [cut(attributed(s, f(s))) for f in (*SUBJECTS.values(), unresolved_lineage)]
    return reduce(DataFrame.unionByName, parts).distinct()
