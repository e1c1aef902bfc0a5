"""The catalog that the order tables stand for: order -> customer -> nation -> region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.snapshot import Snapshot
from plumbline.session import table


def _urn(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(c).cast("string"))


def derived_snapshot(spark: SparkSession, d: str) -> Snapshot:
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    no = F.lit(False)
    ent = (
        o.select(_urn("ord", "o_orderkey").alias("urn"), F.lit("dataset").alias("kind"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("owner"), (F.col("o_totalprice") < 20000).alias("deprecated"), no.alias("live"))
        .unionByName(c.select(_urn("cust", "c_custkey").alias("urn"), F.lit("dataset").alias("kind"), F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).alias("owner"), (F.col("c_acctbal") < 0).alias("deprecated"), no.alias("live")))
        .unionByName(n.select(_urn("nat", "n_nationkey").alias("urn"), F.lit("chart").alias("kind"), F.lit("viz").alias("owner"), no.alias("deprecated"), (F.col("n_nationkey") % 5 != 0).alias("live")))
        .unionByName(r.select(_urn("reg", "r_regionkey").alias("urn"), F.lit("dashboard").alias("kind"), F.lit("viz").alias("owner"), no.alias("deprecated"), F.lit(True).alias("live")))
        .withColumn("schema_ok", F.lit(True))
    )
    edges = (
        o.select(_urn("ord", "o_orderkey").alias("src"), _urn("cust", "o_custkey").alias("dst"))
        .union(c.select(_urn("cust", "c_custkey"), _urn("nat", "c_nationkey")))
        .union(n.select(_urn("nat", "n_nationkey"), _urn("reg", "n_regionkey")))
        .distinct()
    )
    none = F.lit(None).cast("string")
    fields = spark.createDataFrame([], "urn string, path string, native_type string, nullable boolean, tags array<string>, description string")
    return Snapshot(ent, fields, edges.select("src", none.alias("src_field"), "dst", none.alias("dst_field")))
