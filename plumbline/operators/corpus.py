"""Making and describing a corpus of claims: duplicates, caps, splits, samples, data sheet.

Ranks within groups that may be huge (one sentence, one lane) are not worked out over the whole group: a row's hash bucket comes first,
and only buckets that can reach the quota are ranked (``first_n``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.hashing import hash_bucket

SALT = 64


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each group with their rank. Every group is cut into SALT parts by hash, each gives its own first n, and those
    (at most SALT * n a group) are ranked together; a group with a third of all rows is work for SALT tasks."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALT)))
    part = salted.withColumn("_p", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).where(F.col("_p") <= n)
    return part.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n).drop("_salt", "_p")


def first_seen(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the one with the least ``order``: a partially aggregated minimum."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    one = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return one.select(*keys, f"_r.{order}", *(f"_r.{c}" for c in rest))


def sentence_cap(df: DataFrame, cap: int = 3) -> DataFrame:
    """At most ``cap`` records of a sentence: positive ones first, then rare claim types, then by hash."""
    types = df.groupBy("claim_type").agg(F.count("*").alias("_n"))
    j = df.join(F.broadcast(types), df["claim_type"].eqNullSafe(types["claim_type"])).drop(types["claim_type"])
    order = [F.when(F.col("record_class") == "positive", 0).otherwise(1), F.col("_n"), F.sha2(F.col("record_id").cast("string"), 256)]
    return first_n(j, ["sentence"], order, cap).drop("_n")


def hash_split(df: DataFrame, key: Column, n: int = 5, name: str = "bucket") -> DataFrame:
    """Bucket of a document by hash; 0 is held out."""
    return df.withColumn(name, hash_bucket(key, n))


def split_overlap(df: DataFrame, key: str, split: str, a: str, b: str) -> DataFrame:
    """Keys that stand in both splits."""
    return df.where(F.col(split) == a).select(key).intersect(df.where(F.col(split) == b).select(key))


def round_robin(df: DataFrame, lane: str, order: list[Column], n: int) -> DataFrame:
    """n rows taken in turns from the lanes."""
    ranked = first_n(df, [lane], order, n)
    return ranked.orderBy("rn", F.sha2(F.col(lane), 256)).limit(n)


def class_quota(counts: dict[str, int], shares: dict[str, float]) -> dict[str, int]:
    """Greatest numbers per class that keep the shares."""
    whole = min((counts.get(c, 0) / s for c, s in shares.items() if s > 0), default=0)
    return {c: int(whole * s) for c, s in shares.items()}


def class_balance(df: DataFrame, label: str, order: list[Column], shares: dict[str, float]) -> DataFrame:
    counts = {r[label]: r["n"] for r in df.where(F.col(label).isin(*shares)).groupBy(label).agg(F.count("*").alias("n")).collect()}  # a row per class
    quota = class_quota(counts, shares)
    most = max(quota.values(), default=0)
    want = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))
    salted = df.where(F.col(label).isin(*shares)).withColumn("_b", F.pmod(F.shiftrightunsigned(F.xxhash64(*order), 52), F.lit(4096)))
    per = salted.groupBy(label, "_b").agg(F.count("*").alias("_n"))  # 4096 rows a class
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = per.withColumn("_before", before).select(label, "_b", "_before")
    ranked = salted.join(F.broadcast(start), [label, "_b"]).where(F.col("_before") < most)
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_b").orderBy(*order))
    return ranked.withColumn("rn", rank).where(F.col("rn") <= F.element_at(want, F.col(label))).drop("_b", "_before")


def per_type_head(df: DataFrame, label: str, order: list[Column], n: int, negatives: int) -> DataFrame:
    """n of each type and some without one."""
    some = first_n(df.where(F.col(label).isNotNull()), [label], order, n)
    none = first_n(df.where(F.col(label).isNull()).withColumn("_g", F.lit(1)), ["_g"], order, negatives).drop("_g")
    return some.unionByName(none)


def datasheet(df: DataFrame) -> DataFrame:
    """Rows, documents and sentences per lane, with the classes side by side."""
    return df.groupBy("source_kind").agg(
        F.count("*").alias("n_rows"), F.count_distinct("source_document").alias("n_documents"), F.count_distinct("sentence").alias("n_sentences"),
        *(F.count_if(F.col("record_class") == c).alias(f"n_{c}") for c in ("positive", "negative", "hard_negative")),
    )


def survival(candidates: DataFrame, kept: Column) -> DataFrame:
    return candidates.groupBy("source_kind").agg(F.count("*").alias("n_candidates"), F.count_if(F.coalesce(kept, F.lit(False))).alias("n_survived"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("n_rejected"))


def distinct_ratio(df: DataFrame, by: str, text: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(F.sha2(F.col(text), 256)).alias("n_distinct"))
