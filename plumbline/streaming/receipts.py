"""Receipts as a stream (an extension): counts per day and verdict, and the latest receipt of each asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.receipts import latest


def source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def verdicts_per_day(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Tumbling daily counts; rows later than the watermark are dropped, so state is bounded by it."""
    return stream.withWatermark("checked_at", late).groupBy(F.window("checked_at", "1 day"), "verdict").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "verdict", "n")


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The latest receipt of each asset as a table that every batch replaces: two folders in turn, named by the batch, so that a batch that
    is run again reads what the one before it left and writes the same."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/{number - 1}"
        fs = spark._jvm.org.apache.hadoop.fs.Path(old)
        there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        rows = batch.unionByName(spark.read.schema(batch.schema).parquet(old)) if there else batch
        latest(rows).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
