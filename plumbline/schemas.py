"""Evidence: what every check returns.

A row says what was found (``kind``), of what (``subject``: an asset or asset#field), with details as JSON. A check that could not be
made is a row too, of a kind that ends in ``_unverifiable``; so a clean result and a check that was not made never look alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "subject", "detail")])
CLAIM = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "column_name", "expr", "source_sentence", "origin")] + [T.StructField("values", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())])


def detail(**columns: Column) -> Column:
    """JSON with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def evidence(df: DataFrame, kind: str | Column, subject: Column, **details: Column) -> DataFrame:
    return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), subject.alias("subject"), (detail(**details) if details else F.lit("{}")).alias("detail"))


def unverifiable(df: DataFrame, check: str, subject: Column, reason: str) -> DataFrame:
    return evidence(df, f"{check}_unverifiable", subject, reason=F.lit(reason)).distinct()


def union(*parts: DataFrame) -> DataFrame:
    """All evidence, each row once. Spark 4.1 zips the partitions of a union's parts where it takes them for partitioned alike, and fails on large
    tables where the adaptive planner has given one of them more ("Can't zip RDDs with unequal numbers of partitions"); so it must not."""
    parts[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, parts).distinct()
