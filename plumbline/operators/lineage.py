"""Stored against computed column lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["src", "src_field", "dst", "dst_field"]


def lineage_diff(claimed: DataFrame, computed: DataFrame) -> DataFrame:
    """Edges of one side only, as lineage_rot_missing (claimed, not computed) and lineage_rot_extra; one aggregation finds both."""
    both = claimed.select(*KEY, F.lit(1).alias("side")).unionByName(computed.select(*KEY, F.lit(2).alias("side"))).distinct()
    one = both.groupBy(*KEY).agg(F.sum("side").alias("side")).where("side < 3")
    return one.select(F.when(F.col("side") == 1, "lineage_rot_missing").otherwise("lineage_rot_extra").alias("kind"), *KEY)


def resolve_sources(names: DataFrame, entity: DataFrame) -> DataFrame:
    """names(name) of tables in SQL text -> (name, urn, status): the entity whose relation ends with the name's dotted parts.

    Suffixes of all lengths are keys of an equi-join, so no name is compared with every entity. Exactly one match resolves it.
    """
    parts = F.split(F.lower(F.col("relation")), r"\.")
    ends = entity.where(F.col("relation").isNotNull()).select("urn", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))).alias("_k"))
    j = names.select("name").distinct().withColumn("_k", F.lower("name")).join(ends, "_k", "left")
    per = j.groupBy("name").agg(F.count_distinct("urn").alias("n"), F.min("urn").alias("urn"))
    return per.select("name", F.when(F.col("n") == 1, F.col("urn")).alias("urn"), F.when(F.col("n") == 1, "resolved").when(F.col("n") == 0, "unknown").otherwise("ambiguous").alias("status"))
