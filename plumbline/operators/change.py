"""Checks of a proposed change against the catalog, and of the catalog against a live schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import is_pii_tag, type_token
from plumbline.functions.text import loose_references
from plumbline.operators.graph import packed, packed_counts, packed_pairs, reach, shortest_paths
from plumbline.operators.lineage import lineage_diff
from plumbline.operators.ranking import global_position
from plumbline.operators.snapshot import Snapshot
from plumbline.schemas import evidence, union, unverifiable
from plumbline.session import cut


def field_delta(projected: Column, previous: Column) -> tuple[Column, Column]:
    """Added and removed fields; without a previous version all are added."""
    before = F.coalesce(previous, F.array().cast("array<string>"))
    return F.array_sort(F.array_except(projected, before)), F.array_sort(F.array_except(before, projected))


def schema_after(fields: Column, added: Column, removed: Column) -> Column:
    return F.array_sort(F.array_except(F.array_union(fields, added), removed))


def schema_gate(s: Snapshot, refs: DataFrame) -> DataFrame:
    """refs(urn, path): unknown datasets (once each), fields that a known schema lacks, schemas that cannot be read."""
    r = refs.select("urn", "path").distinct().join(s.entity.select("urn", "schema_ok", F.lit(True).alias("_known")), "urn", "left")
    unknown = evidence(r.where("_known is null"), "unknown_dataset", F.col("urn"))
    blind = unverifiable(r.where("_known and not schema_ok"), "schema", F.col("urn"), "the schema is not available")
    lost = r.where("_known and schema_ok and path is not null").join(s.field.select("urn", "path"), ["urn", "path"], "left_anti")
    return union(unknown, blind, evidence(lost, "unknown_field", F.concat_ws("#", "urn", "path")))


def type_mismatch(s: Snapshot, declared: DataFrame) -> DataFrame:
    """declared(urn, path, native_type): types that differ from the catalog's beyond spelling."""
    j = declared.join(s.field.select("urn", "path", F.col("native_type").alias("_is")), ["urn", "path"])
    return evidence(j.where(type_token(F.col("native_type")) != type_token(F.col("_is"))), "type_mismatch", F.concat_ws("#", "urn", "path"), declared=F.col("native_type"), catalog=F.col("_is"))


def reality_diff(s: Snapshot, live: DataFrame, urns: DataFrame) -> DataFrame:
    """live(urn, path, native_type, nullable) against the catalog for the given urns: one row per asset that differs, with both lists."""
    want = urns.select("urn").distinct()
    text = lambda c: F.concat_ws(" ", "path", type_token(F.col("native_type")), F.coalesce(F.col("nullable").cast("string"), F.lit("?"))).alias(c)
    graph = s.field.join(want, "urn", "left_semi").select("urn", text("f"), F.lit(1).alias("side"))
    source = live.join(want, "urn", "left_semi").select("urn", text("f"), F.lit(2).alias("side"))
    each = graph.union(source).distinct().groupBy("urn", "f").agg(F.sum("side").alias("side"))  # 3: on both sides
    per = want.join(each, "urn", "left").groupBy("urn").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("f")))).alias("only_catalog"), F.array_sort(F.collect_list(F.when(F.col("side") == 2, F.col("f")))).alias("only_live"),
        F.count_if(F.col("side").isin(1, 3)).alias("n_catalog"), F.count_if(F.col("side").isin(2, 3)).alias("n_live"),
    )
    blind = per.where("n_catalog = 0 or n_live = 0")
    differ = per.where("n_catalog > 0 and n_live > 0 and (size(only_catalog) > 0 or size(only_live) > 0)")
    return union(evidence(differ, "catalog_reality_mismatch", F.col("urn"), only_catalog=F.col("only_catalog"), only_live=F.col("only_live")), evidence(blind, "graph_unavailable", F.col("urn")))


def blast_radius(s: Snapshot, roots: DataFrame, depth: int = 3) -> DataFrame:
    """roots(root) -> per root: downstream assets, dashboards, unreadable ones, teams other than its own, assets with PII."""
    hit = reach(s.asset_edges, roots, depth).join(s.entity.select(F.col("urn").alias("node"), "kind", "owner"), "node", "left")
    pii = s.field.where(F.exists("tags", is_pii_tag)).select(F.col("urn").alias("node"), F.lit(True).alias("_pii")).distinct()
    own = s.entity.select(F.col("urn").alias("root"), F.col("owner").alias("_own"))
    j = hit.join(pii, "node", "left").join(own, "root", "left")
    foreign = F.when(F.col("_own").isNotNull() & (F.col("owner") != F.col("_own")), F.col("owner"))
    return j.groupBy("root").agg(
        F.count("*").alias("n_assets"), F.count_if(F.col("kind").isin("chart", "dashboard")).alias("n_dashboards"), F.count_if(F.col("kind").isNull()).alias("n_unreadable"),
        F.count_distinct(foreign).alias("n_other_teams"), F.count_if(F.coalesce("_pii", F.lit(False))).alias("n_pii"), F.max("depth").alias("depth"),
    )


def blast_paths(s: Snapshot, roots: DataFrame, depth: int = 3) -> DataFrame:
    """The way from each root to each dashboard it reaches."""
    boards = s.entity.where("kind in ('chart', 'dashboard')").select(F.col("urn").alias("node"))
    return shortest_paths(s.asset_edges, roots, depth, boards).select("root", "node", "path")


def _bi(s: Snapshot) -> DataFrame:
    return s.entity.where("kind in ('chart', 'dashboard') or contains(urn, '.explore.')").select(F.col("urn").alias("node"))


def with_bi_hops(s: Snapshot, roots: DataFrame, depth: int = 3, hops: int = 2) -> DataFrame:
    """(root, node, depth) downstream, and ``hops`` more from the charts, dashboards and explores reached less than ``hops`` before the end, whose own consumers a bounded walk would miss."""
    if (g := packed(s.asset_edges, roots)) is not None:
        return packed_pairs(g, depth, rim=g.mask(_bi(s)), hops=hops)
    near = cut(reach(s.asset_edges, roots, depth))
    rim = near.where(F.col("depth") > depth - hops).join(_bi(s), "node", "left_semi")
    more = reach(s.asset_edges, rim.select(F.col("node").alias("root")).distinct(), hops).select(F.col("root").alias("_via"), F.col("node").alias("_far"), F.col("depth").alias("_d"))
    far = rim.join(more, rim["node"] == more["_via"]).select("root", F.col("_far").alias("node"), (F.col("depth") + F.col("_d")).alias("depth"))
    return near.unionByName(far).where("root <> node").groupBy("root", "node").agg(F.min("depth").alias("depth"))


def deprecated_upstream(s: Snapshot, refs: DataFrame) -> DataFrame:
    """Referenced assets that are deprecated, with the fields referred to."""
    j = refs.join(s.entity.where("deprecated").select("urn"), "urn", "left_semi").groupBy("urn").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return evidence(j, "deprecated_upstream", F.col("urn"), fields=F.col("paths"))


def unowned_asset(s: Snapshot, urns: DataFrame) -> DataFrame:
    return evidence(s.entity.where(F.col("owner").isNull()).join(urns.select("urn").distinct(), "urn", "left_semi"), "unowned_asset", F.col("urn"))


def doc_rot(docs: DataFrame) -> DataFrame:
    """docs(urn, description, fields, added, removed): every name in a description that the schema lacks after the change."""
    after = schema_after(F.col("fields"), F.col("added"), F.col("removed"))
    lost = docs.select("urn", F.explode(F.array_except(loose_references(F.col("description")), after)).alias("mentioned")).distinct()
    return evidence(lost, "doc_rot", F.col("urn"), mentioned_field=F.col("mentioned"))


def blast_evidence(s: Snapshot, roots: DataFrame, depth: int = 3) -> DataFrame:
    """The blast radius as evidence for the rules: how many assets are downstream (charts' consumers too), how many of them are critical,
    could not be read or carry personal data, and how many other teams own some."""
    tags = s.field.groupBy(F.col("urn").alias("node")).agg(F.bool_or(F.exists("tags", is_pii_tag)).alias("_pii"), F.bool_or(F.exists("tags", lambda t: F.lower(t).contains("critical"))).alias("_critical"))
    owners = cut(global_position(s.entity.select("owner").where("owner is not null").distinct(), F.col("owner"), name="team"))
    known = s.entity.select(F.col("urn").alias("node"), "kind", "owner").join(owners, "owner", "left")
    flags = (F.col("kind").isin("chart", "dashboard"), F.col("_critical"), F.col("_pii"), F.col("kind").isNull())
    # what counts of an asset as one number: its team, and a bit per flag
    number = lambda nodes: nodes.join(known, "node", "left").join(tags, "node", "left").withColumn("class", sum((F.coalesce(x, F.lit(False)).cast("long") * (1 << i) for i, x in enumerate(flags)), F.coalesce("team", F.lit(0)) * 16))
    if (g := packed(s.asset_edges, roots)) is not None:
        hit = packed_counts(g, number(g.names.select(F.col("name").alias("node"))).select("node", "class"), depth, g.mask(_bi(s)), 2)
    else:
        hit = number(with_bi_hops(s, roots, depth)).groupBy("root", "class").agg(F.count("*").alias("n"))
    j = hit.join(known.select(F.col("node").alias("root"), F.col("team").alias("_own")), "root", "left").withColumn("team", F.floor(F.col("class") / 16))
    foreign = F.when(F.col("_own").isNotNull() & (F.col("team") > 0) & (F.col("team") != F.col("_own")), F.col("team"))
    total = lambda i: F.sum(F.when(F.col("class").bitwiseAND(1 << i) > 0, F.col("n")).otherwise(0))
    per = j.groupBy("root").agg(
        F.sum("n").alias("n"), *(total(i).alias(c) for i, c in enumerate(("boards", "critical", "pii", "blind"))), F.count_distinct(foreign).alias("teams"),
    )
    per = roots.select("root").distinct().join(per, "root", "left").fillna(0)
    return evidence(per, "blast_radius", F.col("root"), count=F.col("n"), dashboards=F.col("boards"), critical_assets=F.col("critical"), pii_assets=F.col("pii"), unreadable_assets=F.col("blind"), cross_team_owners=F.col("teams"), depth=F.lit(depth))


def lineage_rot(s: Snapshot, computed: DataFrame, urns: DataFrame) -> DataFrame:
    """Stored against computed column edges into the given assets; stored edges that were not read make an asset unverifiable."""
    want = urns.select(F.col("urn").alias("dst")).distinct()
    known = want if s.resolved is None else want.join(s.resolved.withColumnRenamed("urn", "dst"), "dst", "left_semi")
    mine = lambda e: e.where("src_field is not null and dst_field is not null").join(known, "dst", "left_semi")
    diff = lineage_diff(mine(s.edge), mine(computed))
    found = evidence(diff, F.col("kind"), F.concat_ws("#", "dst", "dst_field"), src=F.concat_ws("#", "src", "src_field"))
    if s.resolved is None:
        return found
    return union(found, unverifiable(want.join(known, "dst", "left_anti"), "lineage_rot", F.col("dst"), "the column lineage was not read"))
