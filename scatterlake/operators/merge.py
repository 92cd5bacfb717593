"""Overlapping patches to one scene, corrections of the merged phase."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.functions.phase import Complex, arg, cpx, detrend, mul, polar, unit, wrap
from scatterlake.operators.weed import best_of


def owned(points: DataFrame) -> DataFrame:
    """Of rows of one pixel: the last owning one in patch order, else the first to arrive."""
    rank = F.when(F.col("owned"), -F.col("patch_id")).otherwise(F.col("patch_id"))
    order = W.partitionBy("row", "col").orderBy(F.desc("owned"), rank, "ps_id")
    return points.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def distinct_places(points: DataFrame) -> DataFrame:
    """Of rows with the very same longitude and latitude, the most coherent, ties to the first."""
    return best_of(points, ["lon", "lat"])


def scene_ids(points: DataFrame) -> DataFrame:
    """New ids in the order of (y, x). Ranges of y are numbered apart and offset by a running count, not in one task."""
    ordered = points.repartitionByRange(F.col("y").cast("float"), F.col("x").cast("float"), "ps_id").sortWithinPartitions(F.col("y").cast("float"), F.col("x").cast("float"), "ps_id").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    counts = ordered.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("_first"))  # a row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(before.drop("n")), "_p").withColumn("scene_id", F.col("_before") + F.col("_m") - F.col("_first") + 1).drop("_p", "_m", "_first", "_before")


def date_deviation(phase: DataFrame, patch_phase: DataFrame, fit: DataFrame, ifgs: DataFrame) -> DataFrame:
    """Per date, root mean square in degrees of what patch phase, baseline term and offset leave of the phase."""
    p = patch_phase.select("ps_id", "ifg_ix", F.col("re").alias("pr"), F.col("im").alias("pi"))
    joined = phase.join(p, ["ps_id", "ifg_ix"]).join(fit.select("ps_id", "k", "c"), "ps_id").join(F.broadcast(ifgs.select("ifg_ix", "bperp")), "ifg_ix")
    left = wrap(arg(cpx("re", "im")) - arg(cpx("pr", "pi")) - F.col("k") * F.col("bperp") - F.col("c"))
    return joined.groupBy("ifg_ix").agg((F.sqrt(F.avg(left * left)) * (180 / math.pi)).alias("std_deg"))


def corrected_phase(phase: DataFrame, fit: DataFrame, ifgs: DataFrame) -> DataFrame:
    """phase * exp(-i (k baseline + c)), normalised."""
    joined = phase.join(fit.select("ps_id", "k", "c"), "ps_id").join(F.broadcast(ifgs.select("ifg_ix", "bperp")), "ifg_ix")
    z = unit(mul(detrend(cpx("re", "im"), F.col("k"), F.col("bperp")), polar(F.lit(1.0), -F.col("c"))))
    return joined.select("ps_id", "ifg_ix", z.re.alias("re"), z.im.alias("im"))


def rereferenced(patch_phase: DataFrame, fit: DataFrame, ifgs: DataFrame) -> DataFrame:
    """Patch phase normalised; the master is 1 turned back by the offset of every point."""
    joined = patch_phase.join(fit.select("ps_id", "c"), "ps_id").join(F.broadcast(ifgs.select("ifg_ix", "is_master")), "ifg_ix")
    u, m = unit(cpx("re", "im")), Complex(F.lit(1.0), F.lit(0.0))
    z = mul(Complex(F.when(F.col("is_master"), m.re).otherwise(u.re), F.when(F.col("is_master"), m.im).otherwise(u.im)), polar(F.lit(1.0), F.col("c")))
    return joined.select("ps_id", "ifg_ix", z.re.alias("re"), z.im.alias("im"))


def to_unwrap(corrected: DataFrame, fit: DataFrame, ifgs: DataFrame, scla: DataFrame | None = None) -> DataFrame:
    """Input phase of unwrapping: the baseline term back on, smoothed scene terms off; ``offset`` is what to add again."""
    joined = corrected.join(fit.select("ps_id", "k"), "ps_id").join(F.broadcast(ifgs.select("ifg_ix", "bperp", "is_master")), "ifg_ix")
    turn = F.col("k") * F.col("bperp")
    if scla is None:
        joined = joined.withColumn("offset", F.lit(0.0))
    else:
        joined = joined.join(scla.select("ps_id", F.col("k").alias("k_uw"), F.col("c").alias("c_uw")), "ps_id").withColumn("offset", F.when(F.col("is_master"), 0.0).otherwise(F.col("k_uw") * F.col("bperp") + F.col("c_uw")))
    z = unit(mul(cpx("re", "im"), polar(F.lit(1.0), turn - F.col("offset"))))
    return joined.select("ps_id", "ifg_ix", z.re.alias("re"), z.im.alias("im"), "offset")
