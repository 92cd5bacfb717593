"""Diagnostics of velocity fields: masks, outliers, statistics, matching, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.operators import grid


def common(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Both coherences over the limit: (ps_id, mask_a, mask_b, mask_common)."""
    both = a.select("ps_id", F.col("coh").alias("p")).join(b.select("ps_id", F.col("coh").alias("q")), "ps_id")
    return both.select("ps_id", (F.col("p") >= least).alias("mask_a"), (F.col("q") >= least).alias("mask_b"), ((F.col("p") >= least) & (F.col("q") >= least)).alias("mask_common"))


def without_outliers(values: DataFrame, column: str, method: str = "iqr") -> DataFrame:
    """iqr: within 1.5 quartile ranges of the quartiles; zscore: within 3 population deviations of the mean.

    The quartiles are exact and looked up first; the other bounds are one aggregate
    row, joined by broadcast.
    """
    v = F.col(column)
    if method == "iqr":
        q1, q3 = grid.quantiles(values, column, (0.25, 0.75))
        return values.where(v.between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) if q1 is not None else F.lit(False))
    if method == "zscore":
        bounds = values.agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).select((F.col("m") - 3 * F.col("s")).alias("lo"), (F.col("m") + 3 * F.col("s")).alias("hi"))
    else:
        raise ValueError(f"unknown method {method}")
    return values.crossJoin(F.broadcast(bounds)).where(v.between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def statistics(values: DataFrame, column: str) -> DataFrame:
    v = F.col(column)
    p = F.percentile(column, F.array(F.lit(0.05), F.lit(0.95)))
    one = values.where(v.isNotNull() & ~F.isnan(v)).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_pop(v).alias("std"), p.alias("p"))
    return one.select("n", "mean", "low", "high", "std", F.col("p")[0].alias("p5"), F.col("p")[1].alias("p95"))


def compared(a: DataFrame, b: DataFrame, column: str, key: str = "ps_id") -> DataFrame:
    both = a.select(key, F.col(column).alias("p")).join(b.select(key, F.col(column).alias("q")), key)
    d = F.col("p") - F.col("q")
    return both.where(d.isNotNull() & ~F.isnan(d)).agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def matched(a: DataFrame, b: DataFrame, decimals: int = 5) -> DataFrame:
    """Points of a with the point of b at the same rounded place; of several in b the last counts."""
    place = lambda d: d.withColumns({"_x": F.round("lon", decimals), "_y": F.round("lat", decimals)})
    last = place(b).groupBy("_x", "_y").agg(F.max("ps_id").alias("other_id"))
    return place(a).join(last, ["_x", "_y"]).drop("_x", "_y")


def chosen(values: DataFrame, column: str, how: str, k: int) -> DataFrame:
    """k ids: of the largest size of a column, or evenly spaced in the order of ids. k is the feature's own limit."""
    if how in ("high_velocity", "high_variance"):
        return values.orderBy(F.desc(F.abs(F.col(column))), "ps_id").limit(k).select("ps_id")
    if how != "evenly_spaced":
        raise ValueError(f"unknown choice {how}")
    return every(values, max(1, values.count() // k)).orderBy("ps_id").limit(k).select("ps_id")


def every(values: DataFrame, step: int) -> DataFrame:
    """Every step-th row in the order of ids, numbered by ranges, not in one task."""
    ordered = values.repartitionByRange("ps_id").sortWithinPartitions("ps_id").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    counts = ordered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("_first"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return ordered.join(F.broadcast(before), "_p").where((F.col("_before") + F.col("_m") - F.col("_first")) % step == 0).drop("_p", "_m", "_first", "_before")


def fitted_series(velocity: DataFrame, ifgs: DataFrame) -> DataFrame:
    return velocity.crossJoin(F.broadcast(ifgs.select("ifg_ix", "day"))).select("ps_id", "ifg_ix", (F.col("intercept") + F.col("slope") * F.col("day")).alias("fitted"))
