"""Verdicts that were written down: the log, its latest rows, and what they are worth now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import signature

VERDICTS = ("PASS", "WARN", "BLOCK")
FIELDS = ("urn", "verdict", "reason_code", "commit_sha", "checked_at", "policy_hash", "context_hash", "swarm_run", "worker_id")


def append(receipts: DataFrame, path: str) -> int:
    """Add receipts of datasets to the log and read them back; returns how many are there now, and fails if any is not."""
    rows = receipts.where(~F.col("urn").startswith("urn:li:") | F.col("urn").startswith("urn:li:dataset:"))
    rows.write.mode("append").parquet(path)
    stored = receipts.sparkSession.read.parquet(path)
    if not rows.exceptAll(stored.select(*rows.columns)).isEmpty():
        raise OSError(f"receipts were not stored: {path}")
    return stored.count()


def latest(log: DataFrame, key: str = "urn") -> DataFrame:
    """The last receipt of each asset: one partial aggregation; ties go to the greatest row, so the result never depends on order."""
    rest = [c for c in log.columns if c not in (key, "checked_at")]
    row = F.max(F.struct("checked_at", *rest)).alias("_r")
    return log.groupBy(key).agg(row).select(key, *(F.col(f"_r.{c}").alias(c) for c in log.columns if c != key))


def status(urns: DataFrame, log: DataFrame) -> DataFrame:
    """One row per asked asset, with a null verdict where there is no receipt; receipts of others are not looked at."""
    return urns.select("urn").distinct().join(latest(log.join(urns.select("urn").distinct(), "urn", "left_semi")), "urn", "left")


def staleness(checked_at: Column, now: Column, policy: tuple[Column, Column], schema_changed_at: Column, context: tuple[Column, Column], max_age_s: int) -> Column:
    """First reason why a receipt no longer counts, or null. A receipt from the future is not too old."""
    had, has = policy
    old, new = context
    return (
        F.when(checked_at.isNull(), "invalid_timestamp")
        .when(~had.eqNullSafe(has), "policy_changed")
        .when(schema_changed_at > checked_at, "schema_changed")
        .when((F.unix_timestamp(now) - F.unix_timestamp(checked_at)) > max_age_s, "too_old")
        .when(old.isNull(), "no_context")
        .when(new.isNull(), "context_unknown")
        .when(old != new, "context_changed")
    )


def judgment(verdict: Column, stale: Column, present: Column) -> tuple[Column, Column]:
    """(state, action) of a receipt; ``stale`` null means that staleness is unknown."""
    known = verdict.isin(*VERDICTS)
    state = (
        F.when(~present, "INVALID").when(verdict.isNull(), "ABSENT").when(~known, "INVALID").when(stale.isNull(), "INVALID").when(stale, "STALE").otherwise("CURRENT")
    )
    action = F.when(state != "CURRENT", "RECHECK").when(verdict == "BLOCK", "STOP").when(verdict == "WARN", "REVIEW_OR_ESCALATE").otherwise("CONTINUE")
    return state, action


def context_hash(entity: DataFrame, neighbours: DataFrame) -> DataFrame:
    """entity(urn, ...), neighbours(node, neighbour) -> (urn, context_hash): what the asset is and what it touches, in sorted form."""
    near = neighbours.groupBy("node").agg(F.array_sort(F.collect_set("neighbour")).alias("near"))
    cols = sorted(c for c in entity.columns if c != "urn")
    j = entity.join(near.withColumnRenamed("node", "urn"), "urn", "left")
    text = F.to_json(F.struct("urn", *cols, F.coalesce("near", F.array().cast("array<string>")).alias("near")), {"ignoreNullFields": "false"})
    return j.select("urn", F.sha2(text, 256).alias("context_hash"))


def swarm_ledger(log: DataFrame, run: str) -> DataFrame:
    """Receipts and assets per worker of a run; receipts without a worker are one group."""
    of = log.where(F.col("swarm_run") == run)
    return of.groupBy(F.coalesce("worker_id", F.lit("unattributed")).alias("worker_id")).agg(F.count("*").alias("n_receipts"), F.count_distinct("urn").alias("n_assets"))


def classification(constraints: DataFrame, log: DataFrame, now: Column, max_age_s: int) -> DataFrame:
    """constraints(urn) -> verified, rejected or unverified with the reason. A receipt is tampered with if its verdict is none, or if the log
    was checked (``check_signatures``) and the row is not intact; only the last receipt of an asset counts."""
    j = status(constraints, log).withColumn("_age", F.unix_timestamp(now) - F.unix_timestamp("checked_at"))
    forged = ~F.coalesce("intact", F.lit(True)) if "intact" in j.columns else F.lit(False)
    why = F.when(F.col("verdict").isNull(), "never").when(~F.col("verdict").isin(*VERDICTS) | forged, "tampered").when(F.col("_age") > max_age_s, "expired")
    cls = F.when(why.isNotNull(), "unverified").when(F.col("verdict") == "BLOCK", "rejected").otherwise("verified")
    return j.select("urn", cls.alias("class"), why.alias("reason"))


def badge(verdict: Column) -> Column:
    """Tag of an asset by its verdict (fixed values): PASS and WARN are verified, BLOCK is blocked, anything else has none."""
    return F.when(verdict.isin("PASS", "WARN"), "verified").when(verdict == "BLOCK", "blocked")


def sign(log: DataFrame, key: bytes) -> DataFrame:
    """The log with a signature over all columns of each row, in name order."""
    text = F.to_json(F.struct(*sorted(log.columns)), {"ignoreNullFields": "false"})
    return log.withColumn("signature", signature(key)(text))


def check_signatures(signed: DataFrame, key: bytes) -> DataFrame:
    """Adds ``intact``: false for a row that was changed, or whose signature is missing."""
    names = [c for c in signed.columns if c != "signature"]
    text = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})
    return signed.withColumn("intact", F.coalesce(F.col("signature") == signature(key)(text), F.lit(False)))


def render(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = df.collect()  # a report
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
