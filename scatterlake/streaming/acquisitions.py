"""Acquisitions as a stream: amplitude sums grow by micro-batch, late files included.

An extension of the batch engine, not a feature of its own semantics: sums per
pixel are kept as a Parquet table of partial sums, one folder a batch, so a
batch that is run again replaces its own folder and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.operators.prep import NEAR_ZERO, candidates

SCHEMA = "acq string, pixel long, amp double"


def partial_sums(batch: DataFrame) -> DataFrame:
    """Each acquisition's calibrated sums per pixel; a file holds whole acquisitions."""
    factor = batch.groupBy("acq").agg(F.avg(F.when(F.col("amp") > 0.001, F.col("amp"))).alias("factor"))
    a = batch.join(factor, "acq").withColumn("a", F.col("amp") / F.col("factor"))
    return a.groupBy("pixel").agg(F.count("*").alias("n"), F.sum("a").alias("total"), F.sum(F.col("a") * F.col("a")).alias("squares"), F.bool_or(F.col("a") <= NEAR_ZERO).alias("low"))


def follow(spark: SparkSession, source: str, sums: str, checkpoint: str, **options):
    """Starts the query; each micro-batch writes its partial sums."""

    def write(batch: DataFrame, number: int) -> None:
        partial_sums(batch).write.mode("overwrite").parquet(f"{sums}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).options(**options).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, sums: str, limit: float = 0.4) -> DataFrame:
    """Candidates over all batches so far: partial sums add up."""
    s = spark.read.parquet(sums).groupBy("pixel").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.bool_or("low").alias("low"))
    spread = F.try_divide(F.col("n") * F.col("squares"), F.col("total") * F.col("total")) - 1
    return candidates(s.select("pixel", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("d_a"), "total", "low"), limit)


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Windowed counts and means of an event stream, late events dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")
