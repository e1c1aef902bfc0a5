"""Metrics of classifiers and benchmarks, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str, values: list[str]) -> DataFrame:
    """Counts of predictions (columns) per truth (rows)."""
    return df.groupBy(truth).agg(*(F.count_if(F.col(predicted) == v).alias(f"n_{v.lower()}") for v in values))


def family_rates(df: DataFrame, family: str, harmful: Column, flagged: Column) -> DataFrame:
    """Missed harmful and falsely flagged harmless rows per family."""
    return df.groupBy(family).agg(
        F.count_if(harmful).alias("n_harmful"), F.count_if(harmful & ~flagged).alias("n_missed"), F.count_if(~harmful).alias("n_harmless"), F.count_if(~harmful & flagged).alias("n_false_alarms")
    )


def ladder_score(df: DataFrame, truth: Column, answer: Column) -> DataFrame:
    """answer: true, false, or null for an abstention."""
    return df.agg(
        F.count("*").alias("n"), F.count_if(truth & ~answer).alias("false_negatives"), F.count_if(~truth & answer).alias("false_positives"), F.count_if(answer.isNull()).alias("abstained"),
        F.round(F.count_if(truth == answer) / F.nullif(F.count_if(answer.isNotNull()), F.lit(0)), 6).alias("accuracy"),
    )


def operating_point(df: DataFrame, score: str, correct: str, target: float) -> DataFrame:
    """The least threshold of 0.30 to 0.99 whose precision reaches the target, else the one of the best precision. Scores are counted per
    step of a hundredth in one pass; the thresholds only see those 100 counts."""
    step = F.least(F.lit(99), F.floor(F.round(F.col(score) * 100, 6)).cast("int"))
    per = df.where(F.col(score).isNotNull()).groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("k"))
    at = per.where("s >= 30").select(F.explode(F.sequence(F.lit(30), F.col("s"))).alias("t"), "n", "k").groupBy("t").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    at = at.where("n > 0").withColumn("precision", F.col("k") / F.col("n"))
    good = F.min(F.when(F.col("precision") >= target, F.struct("t", "n", "k", "precision")))
    best = F.max(F.struct("precision", (-F.col("t")).alias("_t"), "n", "k"))
    one = at.agg(good.alias("g"), best.alias("b"))
    return one.select(F.coalesce("g.t", -F.col("b._t")).alias("threshold"), F.coalesce("g.n", "b.n").alias("n"), F.round(F.coalesce("g.precision", "b.precision"), 6).alias("precision"), F.col("g").isNotNull().alias("reached"))


def extractor_metrics(df: DataFrame, by: str, truth: str, predicted: str, exact: Column, latency: str) -> DataFrame:
    """Exact and type-only hits, abstentions on negatives, hallucinations, median latency."""
    t, p = F.col(truth), F.col(predicted)
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(exact & (t == p)).alias("n_exact"), F.count_if(t == p).alias("n_type"), F.count_if(t.isNull() & p.isNull()).alias("n_abstained"),
        F.count_if(t.isNull() & p.isNotNull()).alias("n_hallucinated"), F.round(F.median(latency), 6).alias("median_latency"),
    )


def label_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of the given columns, in long form."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.field", "p.value").groupBy("field", "value").agg(F.count("*").alias("n"))


def features(df: DataFrame, text: str) -> DataFrame:
    """Numbers of a change text for a classifier."""
    t = F.col(text)
    count = lambda rx: F.size(F.regexp_extract_all(t, F.lit(rx), F.lit(0))).cast("double")
    return df.withColumn("features", F.array(F.length(t).cast("double"), count(r"\w+"), count(r"_"), count(r"\d+"), count(r"[<>=]"), count(r"(?i)\bnot\b"), count(r"(?i)\bnull\b"), count(r","), count(r"\.")))


def every_third(df: DataFrame, group: str) -> DataFrame:
    """Held out: every third group in order of its name. Groups are ranked, not rows."""
    from plumbline.operators.ranking import global_position

    names = global_position(df.select(group).distinct(), F.col(group), name="_r")
    return df.join(names, group).withColumn("held_out", F.col("_r") % 3 == 0).drop("_r")


def classifier(train: DataFrame, features_col: str, label: str, seed: int = 3):
    """Logistic regression over an array of features; returns the fitted model and the function that prepares its input."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    prepare = lambda df: df.withColumn("_v", array_to_vector(features_col))
    return LogisticRegression(featuresCol="_v", labelCol=label, maxIter=30, regParam=0.01).fit(prepare(train)), prepare
