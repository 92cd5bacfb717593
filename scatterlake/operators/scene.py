"""Unwrapped phase to scene terms: reference, ramps, look-angle error, correlated noise."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.functions import geometry
from scatterlake.operators import series
from scatterlake.operators.grid import within


def reference(points: DataFrame, lon: tuple[float, float] | None = None, lat: tuple[float, float] | None = None, centre: tuple[float, float] = (0.0, 0.0), radius: float = math.inf) -> DataFrame:
    """ps_id of the reference area: strictly inside the box, within the radius of the centre; radius -inf: none."""
    if radius == -math.inf:
        return points.select("ps_id").where(F.lit(False))
    out = points
    for column, bounds in (("lon", lon), ("lat", lat)):
        out = out.where((F.col(column) > bounds[0]) & (F.col(column) < bounds[1])) if bounds else out
    if math.isfinite(radius):
        x, y = geometry.polyconic(F.col("lon"), F.col("lat"), F.lit(centre[0]), F.lit(centre[1]))
        out = out.where(x * x + y * y <= radius * radius)
    return out.select("ps_id")


def centred(phase: DataFrame, ref: DataFrame, value: str = "ph") -> DataFrame:
    """Minus each date's mean over the reference points, NaN and null left out; without any, unchanged."""
    mean = phase.join(ref, "ps_id", "left_semi").where(~F.isnan(value)).groupBy("ifg_ix").agg(F.avg(value).alias("_m"))
    return phase.join(F.broadcast(mean), "ifg_ix", "left").withColumn(value, F.col(value) - F.coalesce("_m", F.lit(0.0))).drop("_m")


def deramped(phase: DataFrame, points: DataFrame, value: str = "ph", least: int = 6) -> DataFrame:
    """Adds ``ramp``, each date's plane over (x, y) in kilometres, and takes it off: normal equations as sums, solved in place.

    A date with fewer than ``least`` values keeps its phase and has a null ramp.
    """
    x, y, v = F.col("x") / 1000, F.col("y") / 1000, F.col(value)
    joined = phase.join(points.select("ps_id", "x", "y"), "ps_id")
    usable = joined.where(v.isNotNull() & ~F.isnan(v))
    sums = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y, "sv": v, "sxv": x * v, "syv": y * v}
    s = usable.groupBy("ifg_ix").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # about the means, the plane needs only a two by two system
    cxx, cxy, cyy = F.expr("sxx - sx * sx / n"), F.expr("sxy - sx * sy / n"), F.expr("syy - sy * sy / n")
    cxv, cyv = F.expr("sxv - sx * sv / n"), F.expr("syv - sy * sv / n")
    det = cxx * cyy - cxy * cxy
    plane = s.where(F.col("n") >= least).select("ifg_ix", "n", "sx", "sy", "sv", F.try_divide(cxv * cyy - cyv * cxy, det).alias("px"), F.try_divide(cyv * cxx - cxv * cxy, det).alias("py"))
    plane = plane.select("ifg_ix", "px", "py", ((F.col("sv") - F.col("px") * F.col("sx") - F.col("py") * F.col("sy")) / F.col("n")).alias("p0"))
    out = joined.join(F.broadcast(plane), "ifg_ix", "left").withColumn("ramp", F.col("px") * x + F.col("py") * y + F.col("p0"))
    return out.withColumn(value, v - F.coalesce("ramp", F.lit(0.0))).drop("px", "py", "p0", "x", "y")


def look_angle_error(phase: DataFrame, ifgs: DataFrame, value: str = "ph") -> DataFrame:
    """(ps_id, k, c): baseline slope from date-to-date differences, offset from what it leaves.

    ifgs: (ifg_ix, day, bperp, std_deg, is_master), a table of dates that the driver reads:
    the design is shared by all points, so only its inverse meets them, as a broadcast table.
    """
    dates = ifgs.orderBy("ifg_ix").toPandas()
    day, base = dates["day"].to_numpy(float), dates["bperp"].to_numpy(float)
    steps, rises = np.diff(day), np.diff(base)
    timed = len(dates) >= 4
    columns = [np.ones(len(steps)), rises, *([steps] if timed and not series.constant_steps(steps) else [])]
    # sum_j w_j (v_{j+1} - v_j) as weights of the values themselves
    w = series.shared_design(np.column_stack(columns))[1]
    direct = np.concatenate([[-w[0]], w[:-1] - w[1:], [w[-1]]])
    ids = dates["ifg_ix"].astype(int).tolist()
    k = series.apply_design(phase, value, direct[None, :], ids, ["k"])
    solve = ~dates["is_master"].to_numpy(bool)
    away = day - day[~solve][0] if (~solve).any() else day - day[0]
    if timed:
        std = dates["std_deg"].to_numpy(float)
        scale = np.where(std > 0, std * series.RADIANS, 1.0)[solve]
        inverse = series.shared_design(np.column_stack([np.ones(solve.sum()), away[solve]]), 1 / scale**2)[0]
    else:
        inverse = np.full(solve.sum(), 1 / solve.sum())
    kept = [i for i, s in zip(ids, solve, strict=True) if s]
    table = phase.sparkSession.createDataFrame([(i, float(inverse[n]), float(base[solve][n])) for n, i in enumerate(kept)], "ifg_ix long, _w double, _b double")
    joined = phase.join(F.broadcast(table), "ifg_ix").join(k, "ps_id")
    return joined.groupBy("ps_id").agg(F.first("k").alias("k"), F.sum((F.col(value) - F.col("k") * F.col("_b")) * F.col("_w")).alias("c"))


def neighbour_envelope(fit: DataFrame, edges: DataFrame) -> DataFrame:
    """k and c clamped into the range of the neighbours; a NaN neighbour or none leaves a point alone."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(fit.select(F.col("ps_id").alias("b"), F.col("k").alias("nk"), F.col("c").alias("nc")), "b").groupBy(F.col("a").alias("ps_id"))
    span = near.agg(*[f(c).alias(n) for f, c, n in ((F.min, "nk", "k0"), (F.max, "nk", "k1"), (F.min, "nc", "c0"), (F.max, "nc", "c1"))])
    joined = fit.join(span, "ps_id", "left")
    clamp = lambda v, lo, hi: F.when(F.col(lo).isNull() | F.isnan(hi), F.col(v)).otherwise(F.least(F.greatest(F.col(v), F.col(lo)), F.col(hi)))
    return joined.withColumns({"k": clamp("k", "k0", "k1"), "c": clamp("c", "c0", "c1")}).drop("k0", "k1", "c0", "c1")


def smoothed_phase(fit: DataFrame, ifgs: DataFrame) -> DataFrame:
    return fit.crossJoin(F.broadcast(ifgs.select("ifg_ix", "bperp"))).select("ps_id", "ifg_ix", (F.col("k") * F.col("bperp")).cast("float").alias("ph_scla"))


def without_terms(phase: DataFrame, scla: DataFrame, fit: DataFrame) -> DataFrame:
    """Unwrapped phase minus look-angle error and offset; NaN and null count 0."""
    joined = phase.join(scla, ["ps_id", "ifg_ix"]).join(fit.select("ps_id", "c"), "ps_id")
    v = F.col("ph") - F.col("ph_scla") - F.col("c")
    return joined.select("ps_id", "ifg_ix", F.when(v.isNull() | F.isnan(v), 0.0).otherwise(v).alias("ph"))


def low_pass(values: DataFrame, points: DataFrame, wavelength: float, value: str = "high") -> DataFrame:
    """Gaussian mean of each date over points nearer than four wavelengths: one radius join for all dates."""
    pairs = within(points, 4 * wavelength).withColumn("w", F.exp(-F.col("d2") / (2 * wavelength * wavelength)))
    joined = pairs.join(values.select(F.col("ps_id").alias("b"), "ifg_ix", F.col(value).alias("v")), "b")
    return joined.groupBy(F.col("a").alias("ps_id"), "ifg_ix").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("low"))


def correlated_noise(phase: DataFrame, points: DataFrame, ifgs: DataFrame, window: float, wavelength: float, first: int) -> DataFrame:
    """Space-time correlated noise: high in time, relative to the first point, low in space; 0 for the master."""
    high = series.high_pass(phase, "ph", series.gaussian_weights(ifgs, window)).select("ps_id", "ifg_ix", "high")
    ref = high.where(F.col("ps_id") == first).select("ifg_ix", F.col("high").alias("h0"))  # a row a date
    relative = high.join(F.broadcast(ref), "ifg_ix").select("ps_id", "ifg_ix", (F.col("high") - F.col("h0")).alias("high"))
    low = low_pass(relative, points, wavelength)
    start = low.where(F.col("ps_id") == first).select("ifg_ix", F.col("low").alias("l0"))
    out = low.join(F.broadcast(start), "ifg_ix").join(F.broadcast(ifgs.select("ifg_ix", "is_master")), "ifg_ix")
    return out.select("ps_id", "ifg_ix", F.when(F.col("is_master"), 0.0).otherwise(F.col("low") - F.col("l0")).alias("ph_scn"))
