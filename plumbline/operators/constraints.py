"""Live constraints against documented claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.plans import predicates

NORMAL = "relation string, name string, kind string, columns string, text string, is_partial boolean, fingerprint string, shape string, opaque boolean"


def normalize(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows of (relation, name, kind, columns, text, is_partial) -> one record each, none dropped; what cannot be read stays as it is and
    is opaque. Definitions come from DDL and are as many as a schema has constraints."""
    out = []
    for relation, name, kind, columns, text, partial in rows:
        cols = ",".join(sorted(c.strip().lower() for c in columns))
        s = predicates.shape(kind, text or "")
        opaque = kind.lower() == "opaque" or (kind.lower() == "check" and predicates.parse(text or "") is None)
        out.append((relation, name, kind, cols, text, bool(partial), predicates.fingerprint(kind, text or cols), s, opaque))
    return spark.createDataFrame(out, NORMAL)


def family(kind: str, shape: str) -> str:
    """Constraints and claims are compared within one family."""
    return {"primary_key": "unique"}.get(kind, shape if shape in ("not_null", "unique", "foreign_key", "accepted_values") else kind)


def reconcile(live: DataFrame, claims: DataFrame) -> DataFrame:
    """Every live constraint with its best counterpart, and every claim without one.

    Candidates share the relation and, by falling preference, subject and family (1), an equal predicate (2), or a column while either is
    opaque (3); the first step that has any decides. Result: side, name, state, tier. States: confirmed (T0 to T2), contradicts (T3),
    missing_in_catalog, unverifiable (T4).
    """
    spark = live.sparkSession
    fam = F.when(F.col("kind") == "primary_key", "unique").when(F.col("shape").isin("not_null", "unique", "foreign_key", "accepted_values"), F.col("shape")).otherwise(F.col("kind"))
    a = live.select(*(F.col(c).alias(f"l_{c}") for c in live.columns), fam.alias("l_family"))
    b = claims.select(*(F.col(c).alias(f"c_{c}") for c in claims.columns), fam.alias("c_family"))
    pair = a.join(b, F.col("l_relation") == F.col("c_relation"))
    overlap = F.arrays_overlap(F.split("l_columns", ","), F.split("c_columns", ","))
    texts = pair.where("l_text is not null and c_text is not null").select("l_text", "c_text").distinct()
    tiers = spark.createDataFrame([(x["l_text"], x["c_text"], predicates.tier(x["l_text"], x["c_text"])) for x in texts.collect()], "l_text string, c_text string, tier string")
    pair = pair.join(F.broadcast(tiers), ["l_text", "c_text"], "left").withColumn("tier", F.coalesce("tier", F.lit("")))
    same = (F.col("l_columns") == F.col("c_columns")) & (F.col("l_family") == F.col("c_family"))
    named = F.col("l_family").isin("not_null", "unique", "foreign_key")
    step = F.when(same, 1).when(F.col("tier") != "", 2).when(overlap & (F.col("l_opaque") | F.col("c_opaque")), 3)
    best = pair.withColumn("step", step).where("step is not null")
    best = best.withColumn("_rn", F.row_number().over(Window.partitionBy("l_relation", "l_name").orderBy("step", F.when(F.col("tier") != "", 0).otherwise(1), "c_name"))).where("_rn = 1")
    equal = F.when(F.col("tier") != "", F.col("tier")).when((F.col("step") == 1) & named, "T1")
    decided = a.join(best.select("l_relation", "l_name", "step", "tier", "c_name", equal.alias("equal"), "c_opaque"), ["l_relation", "l_name"], "left")
    state = (
        F.when(F.col("l_is_partial"), "unverifiable").when(F.col("step").isNull(), "missing_in_catalog").when(F.col("equal").isNotNull(), "confirmed")
        .when(F.col("l_opaque") | F.col("c_opaque") | (F.col("step") == 3), "unverifiable").otherwise("contradicts")
    )
    tier = F.when(F.col("l_is_partial"), "T4").when(F.col("step").isNull(), F.lit(None).cast("string")).when(F.col("equal").isNotNull(), F.col("equal")).when(F.col("l_opaque") | F.col("c_opaque") | (F.col("step") == 3), "T4").otherwise("T3")
    lives = decided.select(F.lit("live").alias("side"), F.col("l_name").alias("name"), state.alias("state"), tier.alias("tier"))
    # claims that nothing enforces: contradicted, unless a constraint that cannot be read lies over the same columns
    used = best.select("c_name").distinct()
    lone = b.join(used, "c_name", "left_anti")
    block = lone.join(a.where("l_opaque or l_is_partial"), (F.col("l_relation") == F.col("c_relation")) & overlap, "left_semi").select("c_name").withColumn("_b", F.lit(True))
    lone = lone.join(block.distinct(), "c_name", "left")
    blind = F.coalesce("_b", F.lit(False)) | F.col("c_opaque")
    rest = lone.select(F.lit("claim").alias("side"), F.col("c_name").alias("name"), F.when(blind, "unverifiable").otherwise("contradicts").alias("state"), F.when(blind, "T4").otherwise("T3").alias("tier"))
    return lives.unionByName(rest)


def coverage(live: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Per kind of constraint: how many, how many can be read, and how many were decided."""
    j = live.join(reconciled.where("side = 'live'").select("name", "state", "tier"), "name")
    return j.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(~F.col("opaque")).alias("n_canonical"), F.count_if(F.col("state") != "unverifiable").alias("n_decided"))


def not_null_claims(fields: DataFrame) -> DataFrame:
    """Fields that the catalog calls not nullable, as claims."""
    n = F.concat_ws(".", F.lit("nn"), "urn", "path")
    return fields.where(~F.col("nullable")).select(
        F.col("urn").alias("relation"), n.alias("name"), F.lit("not_null").alias("kind"), F.lower("path").alias("columns"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("is_partial"),
        F.concat(F.lit("not_null:"), F.substring(F.sha2(n, 256), 1, 16)).alias("fingerprint"), F.lit("not_null").alias("shape"), F.lit(False).alias("opaque"),
    )
