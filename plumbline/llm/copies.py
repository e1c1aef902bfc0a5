"""Records that are equal but for their formatting.

Every field of a record becomes a multiset of normalised (field name, value) pairs. Each pair is hashed, the hashes are added up, which
is commutative, so neither the order of the fields nor that of the members of a set matters and nothing is sorted. Records are grouped by
the fingerprint (two sums of differently seeded hashes); each is then compared, value by value, with its group's first record, and
those that differ (a collision of 90 bits) are grouped once more by their values, so the result is exact.

Defined cases: null and blank sentences are no records here; a sentence without any word has the empty word list, and all such are equal;
null and blank column names are the empty set; repeated rows of one record id are one record; an empty table gives no groups; other
columns play no part; a record may have any number of names. A group of any size costs one partially aggregated minimum, never a list of
its members; groups of more than ``HOT_ROWS`` records, of which there are at most as many as millions of records, are joined by broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.words import is_blank, names, words
from plumbline.session import cut, table


#: A group of more records is joined by broadcast of its one row; there are at most (records / HOT_ROWS) of them.
HOT_ROWS = 1_000_000


def _pair_hash(field: str, value: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(field), value)


def _set_hash(field: str, values: Column, seed: int) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: F.pmod(acc + F.pmod(_pair_hash(field, x, seed), F.lit(1 << 45)), F.lit(1 << 45)))


def fingerprint(fields: dict[str, Column], sets: dict[str, Column], seed: int) -> Column:
    """Commutative multiset hash: ``fields`` are single values, ``sets`` arrays whose members are hashed one by one. 45 bits of each
    hash are added up modulo 2**45, so any number of members fits a long; two seeds give 90 bits."""
    one = [F.pmod(_pair_hash(k, v, seed), F.lit(1 << 45)) for k, v in fields.items()]
    many = [_set_hash(k, v, seed) for k, v in sets.items()]
    return F.pmod(reduce(add, one + many), F.lit(1 << 45))


def _join_groups(rows: DataFrame, groups: DataFrame, key: list[str], n_hot: int) -> DataFrame:
    """rows joined with one row per group (with its size ``_n_group``); hot groups stay where they are instead of meeting in one task."""
    if not n_hot:
        return rows.join(groups.drop("_n_group"), key)
    hot, rest = F.broadcast(groups.where(F.col("_n_group") > HOT_ROWS).drop("_n_group")), groups.where(F.col("_n_group") <= HOT_ROWS).drop("_n_group")
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(rest, key))


def copy_groups(records: DataFrame, rid: str, sentence: str, columns: str) -> DataFrame:
    """records -> (keep_id, record_id): every record that has a copy, with the smallest record id of its group.

    ``keep_id`` itself is a row of its group as well. One shuffle of the fingerprints, one of the records that share one.
    """
    base = records.where(F.col(rid).isNotNull() & ~is_blank(F.col(sentence))).select(
        F.col(rid).alias("record_id"), F.array_join(words(F.col(sentence)), " ").alias("sentence"), names(F.col(columns)).alias("names")
    )
    norm = cut(base.select("*", *(fingerprint({"sentence": F.col("sentence")}, {"column_name": F.col("names")}, s).alias(f"f{s}") for s in (1, 2))))
    # the fingerprints that at least two records share
    shared = norm.groupBy("f1", "f2").agg(F.min("record_id").alias("keep_id"), F.max("record_id").alias("_last"), F.count("*").alias("_n_group"))
    shared = cut(shared.where(F.col("keep_id") < F.col("_last")).drop("_last"))
    n_hot = shared.where(F.col("_n_group") > HOT_ROWS).count()
    members = cut(_join_groups(norm, shared, ["f1", "f2"], n_hot))
    first = members.where(F.col("record_id") == F.col("keep_id")).select("keep_id", F.col("sentence").alias("_s"), F.col("names").alias("_n")).dropDuplicates(["keep_id"])
    first = first.join(shared.select("keep_id", "_n_group"), "keep_id")
    same = (F.col("sentence") == F.col("_s")) & (F.size("names") == F.size("_n")) & (F.size(F.array_except("names", "_n")) == 0)
    checked = _join_groups(members, first, ["keep_id"], n_hot).withColumn("_same", same)
    good = checked.where("_same").select("keep_id", "record_id")
    rest = checked.where("not _same").select("record_id", "sentence", F.array_sort("names").alias("names"))
    again = rest.join(rest.groupBy("sentence", "names").agg(F.min("record_id").alias("keep_id")), ["sentence", "names"]).select("keep_id", "record_id")
    return good.unionByName(again).distinct()


def copy_pairs(groups: DataFrame) -> DataFrame:
    """(keep_id, copy_id): each other member with the one that is kept."""
    return groups.where(F.col("keep_id") != F.col("record_id")).select("keep_id", F.col("record_id").alias("copy_id"))


def collapse(records: DataFrame, groups: DataFrame, rid: str) -> DataFrame:
    """Every record once, with the number of records that it stands for."""
    counts = groups.groupBy("keep_id").agg(F.count("*").alias("n_copies"))
    kept = records.join(copy_pairs(groups).select(F.col("copy_id").alias(rid)), rid, "left_anti").dropDuplicates([rid])
    return kept.join(counts.withColumnRenamed("keep_id", rid), rid, "left").withColumn("n_copies", F.coalesce("n_copies", F.lit(1).cast("long")))


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "mine_claims_release").select("record_id", "sentence", "column_name")
    return t, copy_groups(t, "record_id", "sentence", "column_name")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies with the record that is kept."""
    return copy_pairs(_groups(spark, d)[1])


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Each claim once, with its copy count."""
    t, g = _groups(spark, d)
    return collapse(t, g, "record_id").select("record_id", "n_copies")


QUERIES = {"p3_found": p3_found, "p3_collapsed": p3_collapsed}

_P3 = r"""
WITH n AS (
  SELECT DISTINCT record_id, CASE WHEN sentence IS NULL OR regexp_replace(sentence, '[\s\p{Z}\p{C}]+', '', 'g') = '' THEN 0 ELSE 1 END AS ok,
    regexp_replace(lower(upper(translate(replace(replace(replace(sentence, '≤', '<='), '≥', '>='), '≠', '!='), '−﹣－＜＞＝', '---<>='))), '[\x{00AD}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{180E}]', '', 'g') AS s,
    list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(upper(coalesce(column_name, ''))), '[\x{00AD}\x{200B}-\x{200F}\x{FEFF}]', '', 'g'), '[\p{L}\p{M}\p{N}_]+(?:[.$-][\p{L}\p{M}\p{N}_]+)*'))) AS c
  FROM mine_claims_release WHERE record_id IS NOT NULL),
w AS (
  SELECT record_id, c, regexp_extract_all(regexp_replace(regexp_replace(s, '(^|[^\p{L}\p{M}\p{N}_])-(\p{N})', '\1 ¬\2', 'g'), '(\p{N})\.(\p{N})', '\1·\2', 'g'), '¬?[\p{L}\p{M}\p{N}_]+(?:·[\p{L}\p{M}\p{N}_]+)*|[<>=]') AS s FROM n WHERE ok = 1),
g AS (SELECT record_id, min(record_id) OVER (PARTITION BY s, c) AS keep_id, count(*) OVER (PARTITION BY s, c) AS k FROM w)
"""

ORACLE = {
    "p3_found": _P3 + "SELECT keep_id, record_id AS copy_id FROM g WHERE keep_id <> record_id",
    "p3_collapsed": _P3
    + "SELECT record_id, max(n_copies)::BIGINT AS n_copies FROM (SELECT record_id, k AS n_copies FROM g WHERE keep_id = record_id UNION ALL SELECT record_id, 1 FROM n WHERE ok = 0) GROUP BY record_id",
}
