"""The catalog at one moment: entities, fields and lineage edges, with what is known of their completeness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.names import urn_relation
from plumbline.operators.references import _asset, _field, asset_key, field_key, has_key
from plumbline.session import cut, table


@dataclass
class Snapshot:
    """entity(urn, kind, owner, deprecated, live, schema_ok), field(urn, path, native_type, nullable, tags, description),
    edge(src, src_field, dst, dst_field). ``resolved`` holds the urns whose column edges were read; None means all."""

    entity: DataFrame
    field: DataFrame
    edge: DataFrame
    entities_complete: bool = True
    resolved: DataFrame | None = None

    def settled(self) -> Snapshot:
        """The same with its tables written out, for work that reads them many times."""
        return Snapshot(cut(self.entity), cut(self.field), cut(self.edge), self.entities_complete, self.resolved)

    @property
    def asset_edges(self) -> DataFrame:
        """Distinct (src, dst)."""
        return self.edge.select("src", "dst").distinct()


def from_tables(entity: DataFrame, field: DataFrame, edge: DataFrame) -> Snapshot:
    """What stands in the catalog now, in one spelling; rows that repeat an asset or a field are merged."""
    ent = (
        entity.where(F.col("removed_at").isNull() & F.col("urn").isNotNull())
        .groupBy(asset_key(F.col("urn")).alias("urn"))
        .agg(
            F.min("kind").alias("kind"), F.min("owner").alias("owner"), F.coalesce(F.bool_or("deprecated"), F.lit(False)).alias("deprecated"),
            F.coalesce(F.bool_or("live"), F.lit(False)).alias("live"), F.coalesce(F.bool_or("schema_available"), F.lit(False)).alias("schema_ok"),
        )
        .where(F.col("urn").isNotNull())
    )
    fld = (
        field.where(F.col("dropped_at").isNull() & has_key(F.col("urn")))
        .groupBy(_asset(F.col("urn")).alias("urn"), field_key(F.col("field_path")).alias("path"))
        .agg(
            F.min("native_type").alias("native_type"), F.bool_and("nullable").alias("nullable"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"), F.min("description").alias("description"),
        )
        .where(F.col("path").isNotNull())
    )
    named = edge.where(has_key(F.col("source_urn")) & has_key(F.col("target_urn")))  # before they are spelled, so that each is spelled once
    path = lambda c: F.coalesce(_field(F.col(c)), F.lit(""))
    edg = named.select(_asset(F.col("source_urn")).alias("src"), path("source_field").alias("src_field"), _asset(F.col("target_urn")).alias("dst"), path("target_field").alias("dst_field")).distinct()
    return Snapshot(ent, fld, edg.select("src", F.nullif("src_field", F.lit("")).alias("src_field"), "dst", F.nullif("dst_field", F.lit("")).alias("dst_field")))


def load(spark: SparkSession, d: str) -> Snapshot:
    return from_tables(table(spark, d, "cat_entity"), table(spark, d, "cat_field"), table(spark, d, "cat_edge"))


def counts(s: Snapshot) -> DataFrame:
    """Rows per kind of thing."""
    per_kind = s.entity.groupBy(F.concat(F.lit("entity:"), F.col("kind")).alias("what")).agg(F.count("*").alias("n"))
    rest = [df.agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), "n") for w, df in (("field", s.field), ("edge", s.edge), ("asset_edge", s.asset_edges))]
    for r in rest:
        per_kind = per_kind.unionByName(r)
    return per_kind


def bounded(s: Snapshot, budget: int) -> Snapshot:
    """Column edges only of the ``budget`` most connected assets (ties by urn), asset edges of all; the other assets count as not resolved."""
    ends = s.edge.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("urn")).groupBy("urn").agg(F.count("*").alias("n"))
    chosen = ends.join(s.entity.select("urn"), "urn", "left_semi").orderBy(F.desc("n"), "urn").limit(budget).select("urn")
    column_edges = s.edge.where(F.col("src_field").isNotNull() | F.col("dst_field").isNotNull())
    kept = column_edges.join(chosen.withColumnRenamed("urn", "src"), "src", "left_semi")
    asset = s.asset_edges.select("src", F.lit(None).cast("string").alias("src_field"), "dst", F.lit(None).cast("string").alias("dst_field"))
    return Snapshot(s.entity, s.field, kept.unionByName(asset, allowMissingColumns=True).select("src", "src_field", "dst", "dst_field").distinct(), False, chosen)


def expand_lineage(aspects: DataFrame) -> DataFrame:
    """aspects(urn, upstreams array<string>, fine array<struct<sources array<struct<urn, path>>, targets array<string>>>) -> edges.

    Every fine-grained record gives the product of its own sources and targets, which are a few fields of one statement.
    """
    tables = aspects.select(F.explode("upstreams").alias("src"), F.lit(None).cast("string").alias("src_field"), F.col("urn").alias("dst"), F.lit(None).cast("string").alias("dst_field"))
    fine = aspects.select("urn", F.explode("fine").alias("f")).select("urn", F.explode("f.sources").alias("s"), F.col("f.targets").alias("t"))
    fine = fine.select(F.col("s.urn").alias("src"), F.col("s.path").alias("src_field"), F.col("urn").alias("dst"), F.explode("t").alias("dst_field"))
    return tables.unionByName(fine).distinct()


def lookup(s: Snapshot, names: DataFrame) -> DataFrame:
    """names(name), an urn in any spelling or the end of a relation -> (name, urn, kind, owner, n_fields): all assets that fit."""
    rel = s.entity.select("urn", "kind", "owner", F.lower(urn_relation(F.col("urn"))).alias("_rel"))
    parts = F.split("_rel", r"\.")
    keys = F.array_union(F.array("urn"), F.when(F.col("_rel").isNotNull(), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))).otherwise(F.array()))
    fits = names.select("name", asset_key(F.col("name")).alias("_k")).distinct().join(rel.withColumn("_k", F.explode(keys)), "_k")
    n = s.field.groupBy("urn").agg(F.count("*").alias("n_fields"))
    return fits.join(n, "urn", "left").select("name", "urn", "kind", "owner", F.coalesce("n_fields", F.lit(0).cast("long")).alias("n_fields"))
