"""Claims about columns, compiled to violation counts. All claims on one table that a row decides are counted in one pass."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.plans.predicates import allowed_expression

TYPES = ("unique", "not_null", "accepted_values", "relationships", "expression")


@dataclass(frozen=True)
class Claim:
    """``column`` may list several columns for unique; ``target`` is (table, column) for relationships."""

    type: str
    column: tuple[str, ...]
    values: tuple[str, ...] = ()
    expr: str | None = None
    target: tuple[str, str] | None = None
    origin: str = "rule"
    name: str = field(default="")

    def __post_init__(self) -> None:
        if self.type not in TYPES or not self.column:
            raise ValueError(f"not a claim: {self}")

    @property
    def label(self) -> str:
        return self.name or f"{self.type}({','.join(self.column)})"


def violation(c: Claim) -> Column:
    """True for a violating row; for the three types that a row decides. A null result of an expression is a violation."""
    col = F.col(c.column[0])
    if c.type == "not_null":
        return col.isNull()
    if c.type == "accepted_values":
        return col.isNotNull() & ~col.isin(*c.values)
    if c.type == "expression":
        if not allowed_expression(c.expr or ""):
            raise ValueError(f"expression not allowed: {c.expr}")
        return ~F.coalesce(F.expr(c.expr), F.lit(False))
    raise ValueError(c.type)


def row_claims(df: DataFrame, claims: list[Claim]) -> DataFrame:
    """One aggregation for all claims a row decides -> (claim, violations)."""
    one = df.agg(*(F.count_if(violation(c)).alias(f"v{i}") for i, c in enumerate(claims)))
    pairs = F.array(*(F.struct(F.lit(c.label).alias("claim"), F.col(f"v{i}").alias("violations")) for i, c in enumerate(claims)))
    return one.select(F.explode(pairs).alias("p")).select("p.claim", "p.violations")


def duplicates(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Groups of rows that share a value; nulls are no values."""
    present = df.where(" and ".join(f"`{c}` is not null" for c in columns))
    return present.groupBy(*columns).agg(F.count("*").alias("row_count")).where("row_count > 1")


def unique_violations(df: DataFrame, c: Claim) -> DataFrame:
    """Rows in groups of more than one."""
    return duplicates(df, c.column).agg(F.coalesce(F.sum("row_count"), F.lit(0).cast("long")).alias("violations")).select(F.lit(c.label).alias("claim"), "violations")


def unique_sample(df: DataFrame, c: Claim, n: int = 10) -> DataFrame:
    """The first groups by value: a report of n rows."""
    return duplicates(df, c.column).orderBy(*c.column).limit(n)


def orphans(df: DataFrame, c: Claim, target: DataFrame) -> DataFrame:
    """Rows with a value that the target column lacks."""
    keys = target.select(F.col(c.target[1]).alias(c.column[0])).where(F.col(c.column[0]).isNotNull()).distinct()
    return df.where(F.col(c.column[0]).isNotNull()).join(keys, c.column[0], "left_anti")


def relationship_violations(df: DataFrame, c: Claim, target: DataFrame) -> DataFrame:
    return orphans(df, c, target).agg(F.count("*").alias("violations")).select(F.lit(c.label).alias("claim"), "violations")


def verify(df: DataFrame, claims: list[Claim], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(claim, type, status, violations, reason): a claim that cannot be analysed is unverifiable and does not take the others along."""
    spark, parts, good, bad = df.sparkSession, [], [], []
    for c in claims:
        try:
            if c.type in ("not_null", "accepted_values", "expression"):
                row_claims(df, [c]).schema  # noqa: B018  analysed here, run below
                good.append(c)
            elif c.type == "unique":
                parts.append(unique_violations(df, c))
            else:
                parts.append(relationship_violations(df, c, (tables or {})[c.target[0]]))
        except (AnalysisException, ValueError, KeyError) as e:
            bad.append((c.label, c.type, type(e).__name__))
    if good:
        parts.append(row_claims(df, good))
    kinds = spark.createDataFrame([(c.label, c.type) for c in claims], "claim string, type string")
    blind = spark.createDataFrame(bad, "claim string, type string, reason string").select("claim", "type", F.lit("unverifiable").alias("status"), F.lit(None).cast("long").alias("violations"), "reason")
    if not parts:
        return blind
    counted = parts[0]
    for p in parts[1:]:
        counted = counted.unionByName(p)
    status = F.when(F.col("violations") == 0, "holds").otherwise("violated")
    done = counted.join(F.broadcast(kinds), "claim").select("claim", "type", status.alias("status"), "violations", F.lit(None).cast("string").alias("reason"))
    return done.unionByName(blind)


def verify_each(spark: SparkSession, df: DataFrame, claims: list[Claim], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """As ``verify``, but run: if the fused pass fails on the data (a cast, say), the claims are run one by one and those that fail are unverifiable."""
    schema = "claim string, type string, status string, violations long, reason string"
    try:
        return spark.createDataFrame([tuple(r) for r in verify(df, claims, tables).collect()], schema)  # a row per claim
    except Exception:  # noqa: BLE001
        rows = []
        for c in claims:
            try:
                rows += [tuple(r) for r in verify(df, [c], tables).collect()]
            except Exception as e:  # noqa: BLE001
                rows.append((c.label, c.type, "unverifiable", None, type(e).__name__))
        return spark.createDataFrame(rows, schema)


def attest(proposals: DataFrame, budget: int) -> DataFrame:
    """proposals(urn, column_name, rule_type, model_type): rules first, the other reader only where they abstain; the first ``budget``
    documented columns (by urn and column) are taken, the rest is declined."""
    from pyspark.sql.window import Window

    p = proposals.withColumn("type", F.coalesce("rule_type", "model_type")).where(F.col("type").isNotNull())
    p = p.withColumn("origin", F.when(F.col("rule_type").isNotNull(), "rule").otherwise("model"))
    position = F.row_number().over(Window.partitionBy("urn").orderBy("column_name"))
    return p.withColumn("taken", position <= budget)


def attestation_summary(attested: DataFrame) -> DataFrame:
    return attested.groupBy("origin", "type").agg(F.count_if("taken").alias("n_taken"), F.count_if(~F.col("taken")).alias("n_declined"))
