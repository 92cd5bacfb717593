"""Linear algebra and filters along the time axis, as aggregates over (ps_id, ifg_ix) rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RADIANS = math.pi / 180


def differences(series: DataFrame, value: str, key: str = "ps_id", order: str = "ifg_ix") -> DataFrame:
    """value minus the one before, along each series."""
    return series.withColumn("d", F.col(value) - F.lag(value).over(W.partitionBy(key).orderBy(order))).where(F.col("d").isNotNull())


def cumulative(series: DataFrame, value: str, key: str = "ps_id", order: str = "ifg_ix") -> DataFrame:
    return series.withColumn("total", F.sum(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def fir(series: DataFrame, value: str, taps: list[float], order: str, before: float = 1.0) -> DataFrame:
    """Causal filter of a short ordered table (as many rows as bins); what precedes it counts as ``before``."""
    w = W.orderBy(order)
    return series.withColumn("filtered", sum((t * F.lag(value, k, before).over(w) for k, t in enumerate(taps)), F.lit(0.0)))


def gaussian_weights(ifgs: DataFrame, window: float) -> DataFrame:
    """(ifg_ix, src_ix, w): Gaussian in days, the master left out, each target's weights summing to 1.

    The weights are taken relative to the largest, so far-off dates don't underflow.
    """
    target, source = ifgs.select("ifg_ix", "day"), ifgs.where("not is_master").select(F.col("ifg_ix").alias("src_ix"), F.col("day").alias("src_day"))
    pairs = target.crossJoin(F.broadcast(source)).withColumn("e", -0.5 * F.pow((F.col("day") - F.col("src_day")) / window, 2))  # a table of dates
    per = W.partitionBy("ifg_ix")
    return pairs.withColumn("g", F.exp(F.col("e") - F.max("e").over(per))).select("ifg_ix", "src_ix", (F.col("g") / F.sum("g").over(per)).alias("w"))


def high_pass(series: DataFrame, value: str, weights: DataFrame) -> DataFrame:
    """value minus its weighted mean over the other dates."""
    low = series.select("ps_id", F.col("ifg_ix").alias("src_ix"), F.col(value).alias("v")).join(F.broadcast(weights), "src_ix").groupBy("ps_id", "ifg_ix").agg(F.sum(F.col("v") * F.col("w")).alias("low"))
    return series.join(low, ["ps_id", "ifg_ix"]).withColumn("high", F.col(value) - F.col("low"))


def line(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """Aggregates: intercept and slope of the weighted line."""
    s, sx, sy, sxx, sxy = (F.sum(c) for c in (w, w * x, w * y, w * x * x, w * x * y))
    slope = F.try_divide(s * sxy - sx * sy, s * sxx - sx * sx)
    return {"intercept": F.try_divide(sy - slope * sx, s), "slope": slope}


def through_origin(x: Column, y: Column, w: Column) -> Column:
    return F.try_divide(F.sum(w * x * y), F.sum(w * x * x))


def exact_weights(w: Column, any_exact: Column) -> Column:
    """Infinite weights take over: where a series has any, they count 1 and the rest 0."""
    sure = w == math.inf
    return F.when(any_exact, sure.cast("double")).otherwise(w)


def shared_design(x: np.ndarray, weights: np.ndarray | None = None, covariance: np.ndarray | None = None) -> np.ndarray:
    """Rows of the least-squares inverse of a design that all series share: coefficient i = sum_j out[i, j] * y_j."""
    x = np.asarray(x, float)
    if covariance is not None:
        root = np.linalg.inv(np.linalg.cholesky(np.asarray(covariance, float)))
    else:
        root = np.diag(np.sqrt(np.ones(len(x)) if weights is None else np.asarray(weights, float)))
    if np.linalg.matrix_rank(root @ x) < x.shape[1]:
        raise ValueError("the design has dependent columns")
    q, r = np.linalg.qr(root @ x)
    return np.linalg.solve(r, q.T) @ root


def apply_design(series: DataFrame, value: str, inverse: np.ndarray, positions: list[int], names: list[str]) -> DataFrame:
    """Coefficients of every series at once: a broadcast table of one row per date, then one aggregate."""
    rows = [(int(p), *map(float, inverse[:, k])) for k, p in enumerate(positions)]
    table = series.sparkSession.createDataFrame(rows, "ifg_ix long, " + ", ".join(f"_w{i} double" for i in range(len(names))))
    joined = series.join(F.broadcast(table), "ifg_ix")
    return joined.groupBy("ps_id").agg(*[F.sum(F.col(value) * F.col(f"_w{i}")).alias(n) for i, n in enumerate(names)])


def constant_steps(days: np.ndarray) -> bool:
    """Whether steps are equal up to rounding, so that a rate can't be told from a constant."""
    days = np.asarray(days, float)
    scale = max(1.0, np.abs(days).max(initial=1.0))
    return bool(np.all(np.abs(days - days[0]) <= scale * np.finfo(float).eps * 32 * len(days)))


def mean_velocity(series: DataFrame, ifgs: DataFrame, value: str) -> DataFrame:
    """Weighted line over time for every point; weights 1 / std**2 of each interferogram in degrees."""
    joined = series.join(F.broadcast(ifgs.select("ifg_ix", "day", "std_deg")), "ifg_ix")
    w = 1 / F.pow(F.col("std_deg") * RADIANS, 2)
    return joined.groupBy("ps_id").agg(*[c.alias(n) for n, c in line(F.col("day"), F.col(value), w).items()])


def deramp_dates(params, n_ifg: int) -> list[int]:
    """One-based dates to deramp: 'all', none, or a list that must lie inside the stack."""
    value = params.values.get("scn_deramp_ifg", "")
    if isinstance(value, str):
        if value.strip().lower() == "all":
            return list(range(1, n_ifg + 1))
        if value.strip():
            raise ValueError(f"scn_deramp_ifg is all, empty or a list, not {value}")
        return []
    dates = [i + 1 for i in params.indices("scn_deramp_ifg")]
    if any(i > n_ifg for i in dates):
        raise ValueError("scn_deramp_ifg names a date outside the stack")
    return dates
