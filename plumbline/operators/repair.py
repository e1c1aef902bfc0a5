"""Repairs of metadata: proposed, simulated on a copy of the snapshot, and proven by running the check again."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.names import is_pii_tag
from plumbline.operators import self_check as sc
from plumbline.operators.snapshot import Snapshot

#: Kinds that no change of metadata can put right.
UNREPAIRABLE = ("orphan_lineage", "lineage_field_missing", "doc_references_missing_column", "deprecated_upstream_of_live")


def propose_owners(s: Snapshot) -> DataFrame:
    """(urn, owner): the owner of an unowned, used asset if all its owned direct upstreams have one and the same."""
    bad = sc.unowned_consumed(s).select(F.col("subject").alias("urn"))
    up = s.asset_edges.where(F.col("src") != F.col("dst")).join(bad.withColumnRenamed("urn", "dst"), "dst", "left_semi")
    owned = up.join(s.entity.where(F.col("owner").isNotNull()).select(F.col("urn").alias("src"), "owner"), "src")
    per = owned.groupBy(F.col("dst").alias("urn")).agg(F.min("owner").alias("owner"), F.max("owner").alias("_last"))
    return per.where("owner = _last").select("urn", "owner")


def propose_tags(s: Snapshot) -> DataFrame:
    """(urn, path, tag): the marker of the source on the receiving field, where all leaking sources carry one and the same marker."""
    leaks = sc.pii_leak_untagged(s)
    tag = leaks.select(F.split("subject", "#", 2).alias("_p"), F.explode(F.from_json(F.get_json_object("detail", "$.tags"), "array<string>")).alias("tag"))
    per = tag.groupBy(F.col("_p")[0].alias("urn"), F.col("_p")[1].alias("path")).agg(F.min("tag").alias("tag"), F.max("tag").alias("_last"))
    return per.where("tag = _last").select("urn", "path", "tag")


def with_owners(s: Snapshot, owners: DataFrame) -> Snapshot:
    new = s.entity.join(owners.select("urn", F.col("owner").alias("_o")), "urn", "left").withColumn("owner", F.coalesce("owner", "_o")).drop("_o")
    return replace(s, entity=new)


def with_tags(s: Snapshot, tags: DataFrame) -> Snapshot:
    per = tags.groupBy("urn", "path").agg(F.collect_set("tag").alias("_t"))
    new = s.field.join(per, ["urn", "path"], "left").withColumn("tags", F.array_sort(F.array_union("tags", F.coalesce("_t", F.array().cast("array<string>"))))).drop("_t")
    return replace(s, field=new)


def prove(before: DataFrame, after: DataFrame, targets: DataFrame) -> DataFrame:
    """before/after(kind, subject), targets(kind, subject) -> (kind, subject, outcome): resolved, unresolved, or collateral for a finding
    that the repair brought about."""
    b, a = before.select("kind", "subject").distinct(), after.select("kind", "subject").distinct()
    t = targets.select("kind", "subject").distinct()
    state = t.join(a.withColumn("_a", F.lit(True)), ["kind", "subject"], "left").select("kind", "subject", F.when(F.col("_a"), "unresolved").otherwise("resolved").alias("outcome"))
    return state.unionByName(a.exceptAll(b).withColumn("outcome", F.lit("collateral")))


def prove_each(s: Snapshot, tags: DataFrame) -> DataFrame:
    """tags(urn, path, tag) -> the same with outcome and collateral: each proposal judged for itself, all in one simulation.

    A tag changes what its own field receives and what it passes on, so a finding that the simulation adds is laid to the proposal on
    the field that it comes from. Outcomes: proven; collateral (it brings findings about); unresolved; refused for all where a check of
    the catalog as it is could not be made.
    """
    before, after = sc.pii_leak_untagged(s).select("kind", "subject", "detail"), sc.pii_leak_untagged(with_tags(s, tags)).select("kind", "subject", "detail")
    field = F.concat_ws("#", "urn", "path")
    added = after.join(before.select("kind", "subject").distinct(), ["kind", "subject"], "left_anti").groupBy(F.get_json_object("detail", "$.source").alias("_f")).agg(F.count_distinct("subject").alias("collateral"))
    left = after.select(F.col("subject").alias("_f"), F.lit(True).alias("_left")).distinct()
    p = tags.withColumn("_f", field).join(added, "_f", "left").join(left, "_f", "left").fillna(0, ["collateral"])
    if not sc.run_all(s).where(F.col("kind").endswith("_unverifiable")).isEmpty():
        return p.select("urn", "path", "tag", F.lit("refused").alias("outcome"), F.lit(0).cast("long").alias("collateral"))
    outcome = F.when(F.col("_left"), "unresolved").when(F.col("collateral") > 0, "collateral").otherwise("proven")
    return p.select("urn", "path", "tag", outcome.alias("outcome"), "collateral")


def unfixed(findings: DataFrame, proof: DataFrame) -> DataFrame:
    return findings.select("kind", "subject").distinct().join(proof.where("outcome = 'resolved'"), ["kind", "subject"], "left_anti")


def pii_fields_downstream(s: Snapshot) -> DataFrame:
    """Fields with a PII tag, as nodes for a closure."""
    return s.field.where(F.exists("tags", is_pii_tag)).select(F.concat_ws("#", "urn", "path").alias("node"))


def apply(s: Snapshot, folder: str, owners: DataFrame | None = None, tags: DataFrame | None = None, dry_run: bool = True) -> tuple[Snapshot, DataFrame]:
    """A new version of the snapshot with the proposals in it, written to ``folder`` unless it is a dry run, and the proof read back from
    what was written: (kind, subject, outcome) of the two repairable checks."""
    spark = s.entity.sparkSession
    new = with_tags(s, tags) if tags is not None else s
    new = with_owners(new, owners) if owners is not None else new
    if not dry_run:
        for name in ("entity", "field", "edge"):
            getattr(new, name).write.mode("errorifexists").parquet(f"{folder}/{name}")
        new = replace(new, **{name: spark.read.parquet(f"{folder}/{name}") for name in ("entity", "field", "edge")})
    find = lambda x: sc.pii_leak_untagged(x).unionByName(sc.unowned_consumed(x))
    before = find(s)
    return new, prove(before, find(new), before)
