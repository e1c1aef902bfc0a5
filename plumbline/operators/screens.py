"""Embedding screens: pairs that drifted apart, and a linear head."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.vectors import cosine, dot, softmax, thresholded_label


def drift(pairs: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """Similarity of two vectors a row, and whether it is below the threshold; null where there is none."""
    c = cosine(F.col(a), F.col(b))
    return pairs.withColumn("similarity", c).withColumn("drifted", c < threshold)


def linear_head(df: DataFrame, vector: str, weights: list[list[float]], bias: list[float], threshold: float) -> DataFrame:
    """Label and probability by a linear layer given as literals; its size is that of the model."""
    scores = F.array(*(dot(F.col(vector), F.array(*(F.lit(float(x)) for x in w))) + F.lit(float(b)) for w, b in zip(weights, bias)))
    return df.withColumn("_s", scores).withColumn("_p", softmax(F.col("_s"))).withColumn("probability", F.array_max("_p")).withColumn("predicted", thresholded_label(F.col("_p"), threshold)).drop("_s", "_p")
