"""Dates, map projection, grids and viewing geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterlake.functions.phase import half_away

# WGS84 semi-major axis and eccentricity.
WGS84_A, WGS84_E = 6_378_137.0, 0.082_094_437_949_70
LIGHT = 299_792_458.0


def datenum(day: Column) -> Column:
    """Days since year 0, as a proleptic serial number: 1 January of year 1 is 367."""
    return (F.datediff(day, F.lit("0001-01-01").cast("date")) + 367).cast("double")


def from_datenum(number: Column) -> Column:
    return F.date_add(F.lit("0001-01-01").cast("date"), (F.floor(number) - 367).cast("int"))


def from_yyyymmdd(number: Column) -> Column:
    return F.make_date((number / 10000).cast("int"), ((number % 10000) / 100).cast("int"), (number % 100).cast("int"))


def meridian_arc(latitude: Column) -> Column:
    """Length of the meridian from the equator (series to the sixth power of the eccentricity)."""
    e2 = WGS84_E**2
    terms = (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, -(3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024), 15 * e2**2 / 256 + 45 * e2**3 / 1024, -35 * e2**3 / 3072)
    return WGS84_A * (terms[0] * latitude + terms[1] * F.sin(2 * latitude) + terms[2] * F.sin(4 * latitude) + terms[3] * F.sin(6 * latitude))


def polyconic(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Local metres east and north of (lon0, lat0), degrees in."""
    phi, away = F.radians(lat), F.radians(lon) - F.radians(lon0)
    start = meridian_arc(F.radians(lat0))
    radius = WGS84_A / F.sqrt(1 - WGS84_E**2 * F.pow(F.sin(phi), 2))
    turn, cot = away * F.sin(phi), F.try_divide(F.lit(1.0), F.tan(phi))
    x = F.when(phi == 0, WGS84_A * away).otherwise(radius * cot * F.sin(turn))
    y = F.when(phi == 0, -start).otherwise(meridian_arc(phi) - start + radius * cot * (1 - F.cos(turn)))
    return x, y


def local_xy(points: DataFrame, heading: float | None = None) -> DataFrame:
    """Adds x and y around the middle of the scene; turned by the heading only if that shrinks both extents.

    One aggregate row (the bounds) is joined by broadcast: its size is fixed.
    """
    bounds = points.agg(((F.min("lon") + F.max("lon")) / 2).alias("lon0"), ((F.min("lat") + F.max("lat")) / 2).alias("lat0"))
    placed = points.crossJoin(F.broadcast(bounds))
    x, y = polyconic(F.col("lon"), F.col("lat"), F.col("lon0"), F.col("lat0"))
    placed = placed.withColumn("x", x).withColumn("y", y)
    if heading is None:
        return placed
    theta = math.radians(180.0 - heading)
    theta = theta - 2 * math.pi if theta > math.pi else theta
    turned_x = math.cos(theta) * F.col("x") + math.sin(theta) * F.col("y")
    turned_y = -math.sin(theta) * F.col("x") + math.cos(theta) * F.col("y")
    extent = lambda c: F.max(c) - F.min(c)
    better = placed.agg(((extent(turned_x) < extent("x")) & (extent(turned_y) < extent("y"))).alias("turn"))
    both = placed.crossJoin(F.broadcast(better))
    return both.withColumns({"x": F.when(F.col("turn"), turned_x).otherwise(F.col("x")), "y": F.when(F.col("turn"), turned_y).otherwise(F.col("y"))}).drop("turn")


def millimetres(x: Column) -> Column:
    """Single precision, rounded to millimetres, halves away from zero."""
    single = x.cast("float") * F.lit(1000.0).cast("float")
    return (half_away(single).cast("float") / F.lit(1000.0).cast("float")).cast("float")


def grid_cell(value: Column, least: Column, size: float, nudge: float) -> Column:
    """One-based cell before the last one is folded back: ceil((value - least + nudge) / size) in single precision."""
    f = lambda v: F.lit(v).cast("float")
    span = ((value.cast("float") - least.cast("float")).cast("float") + f(nudge)).cast("float")
    return F.ceil((span.cast("float") / f(size)).cast("float")).cast("int")


def patch_ranges(size: int, count: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(first, last, own first, own last) of every patch along one axis, one-based and inclusive."""
    if size < 1 or not 1 <= count <= size or overlap < 0:
        raise ValueError("an axis needs a size, and between one patch and one per cell")
    own = [(size * k // count + 1, size * (k + 1) // count) for k in range(count)]
    return [(max(1, low - overlap), min(size, high + overlap), low, high) for low, high in own]


def look_angle(rng: Column, earth: Column, orbit: Column) -> Column:
    """Angle at the target between the vertical and the line of sight, from slant range and the two radii."""
    cosine = (orbit * orbit - earth * earth - rng * rng) / (2 * earth * rng)
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


def perpendicular_baseline(cross: Column, normal: Column, cross_rate: Column, normal_rate: Column, seconds: Column, look: Column) -> Column:
    return (cross + cross_rate * seconds) * F.cos(look) - (normal + normal_rate * seconds) * F.sin(look)


def trial_wraps(baseline_range: float, wavelength: float, slant_range: float = 830_000.0, incidence: float = math.radians(21), error: float = 20.0) -> float:
    """Phase cycles over the baseline range that a height error of so many metres makes."""
    return baseline_range * error / (wavelength * slant_range * math.sin(incidence) / (4 * math.pi)) / (2 * math.pi)
