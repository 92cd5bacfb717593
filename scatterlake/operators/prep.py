"""Raster stack to candidate points: calibration, amplitude dispersion, patches, chronology."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.functions import geometry

AMPLITUDE_FLOOR, NEAR_ZERO, DISPERSION = 0.001, 5e-5, 0.4


def calibration(amplitudes: DataFrame) -> DataFrame:
    """Mean amplitude over the floor of each acquisition: (acq, factor)."""
    return amplitudes.groupBy("acq").agg(F.avg(F.when(F.col("amp") > AMPLITUDE_FLOOR, F.col("amp"))).alias("factor"))


def dispersion(amplitudes: DataFrame, factors: DataFrame) -> DataFrame:
    """Amplitude dispersion of each pixel over calibrated amplitudes: (pixel, d_a, total, low).

    A near-zero acquisition marks the pixel; one shuffle by pixel, aggregated before it.
    The factors have a row an acquisition and are joined by broadcast where Spark finds them small.
    """
    scaled = amplitudes.join(factors, "acq").withColumn("a", F.col("amp") / F.col("factor"))
    sums = scaled.groupBy("pixel").agg(F.count("*").alias("n"), F.sum("a").alias("total"), F.sum(F.col("a") * F.col("a")).alias("squares"), F.bool_or(F.col("a") <= NEAR_ZERO).alias("low"))
    spread = F.try_divide(F.col("n") * F.col("squares"), F.col("total") * F.col("total")) - 1
    return sums.select("pixel", F.sqrt(F.greatest(spread, F.lit(0.0))).alias("d_a"), "total", "low")


def candidates(pixels: DataFrame, limit: float = DISPERSION) -> DataFrame:
    return pixels.where(~F.col("low") & (F.col("total") > 0) & F.col("d_a").isNotNull() & ~F.isnan("d_a") & (F.col("d_a") < limit))


def finite(*columns: str) -> Column:
    """No column is null, NaN or infinite."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < math.inf)
    return out


def valid_points(points: DataFrame, phase: DataFrame) -> DataFrame:
    """Points with finite coordinates none of whose phases is non-finite."""
    bad = phase.where(~finite("re", "im")).select("ps_id")
    return points.where(finite("lon", "lat")).join(bad, "ps_id", "left_anti")


def crop(raster: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """One-based inclusive window, renumbered from 1."""
    return raster.where(F.col("row").between(*rows) & F.col("col").between(*columns)).withColumns({"row": F.col("row") - rows[0] + 1, "col": F.col("col") - columns[0] + 1})


def patches(spark, width: int, length: int, across: int, along: int, overlap: int) -> DataFrame:
    """The patch table, columns outermost: a row a patch, so joins broadcast it."""
    rows, k = [], 0
    for c0, c1, oc0, oc1 in geometry.patch_ranges(width, across, overlap):
        for r0, r1, or0, or1 in geometry.patch_ranges(length, along, overlap):
            k += 1
            rows.append((k, c0, c1, r0, r1, oc0, oc1, or0, or1))
    return spark.createDataFrame(rows, "patch_id int, c0 int, c1 int, r0 int, r1 int, oc0 int, oc1 int, or0 int, or1 int")


def in_patches(points: DataFrame, table: DataFrame) -> DataFrame:
    """Every point in every patch it lies in, with ownership (the rectangle without overlap)."""
    inside = F.col("col").between(F.col("c0"), F.col("c1")) & F.col("row").between(F.col("r0"), F.col("r1"))
    own = F.col("col").between(F.col("oc0"), F.col("oc1")) & F.col("row").between(F.col("or0"), F.col("or1"))
    return points.join(F.broadcast(table), inside).withColumn("owned", own).drop("c0", "c1", "r0", "r1", "oc0", "oc1", "or0", "or1")


def chronology(phase: DataFrame, dates: DataFrame, master: float) -> tuple[DataFrame, DataFrame]:
    """Sorts acquisitions by day and puts the master in: (ifgs, phase) with 1-based ifg_ix, master 1 + 0i and baseline 0.

    dates: (acq, day, bperp) of the others; an acquisition on the master day is an error.
    """
    if not dates.where(F.col("day") == master).isEmpty():
        raise ValueError("the master is among the acquisitions")
    table = dates.select("acq", "day", "bperp", F.lit(False).alias("is_master")).unionByName(dates.sparkSession.sql(f"SELECT CAST(NULL AS {dict(dates.dtypes)['acq']}) AS acq, CAST({master} AS DOUBLE) AS day, 0.0D AS bperp, true AS is_master"))
    ifgs = table.withColumn("ifg_ix", F.row_number().over(W.orderBy("day")))
    placed = phase.join(F.broadcast(ifgs.where("not is_master").select("acq", "ifg_ix")), "acq").select("ps_id", "ifg_ix", "re", "im")
    ones = phase.select("ps_id").distinct().crossJoin(F.broadcast(ifgs.where("is_master").select("ifg_ix"))).select("ps_id", "ifg_ix", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return ifgs, placed.unionByName(ones)


def renumber(points: DataFrame) -> DataFrame:
    """Per patch, ids in the order of (y, x) in single precision, ties by the old id."""
    order = W.partitionBy("patch_id").orderBy(F.col("y").cast("float"), F.col("x").cast("float"), "ps_id")
    return points.withColumn("sort_ix", F.row_number().over(order).cast("long"))


def without(table: DataFrame, dropped: DataFrame, key: str = "ifg_ix") -> DataFrame:
    """Rows not on the drop list, with the positions they then have."""
    left = table.join(dropped.select(key), key, "left_anti")
    return left.withColumn("position", F.row_number().over(W.orderBy(key)).cast("long"))
