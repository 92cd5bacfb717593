"""Points to grid cells and back, histograms, order statistics, joins by distance."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.functions import geometry
from scatterlake.functions.phase import arg, conj, cpx, mul, unit, wrap


def cells(points: DataFrame, size: float, nudge: float = 1e-6) -> DataFrame:
    """Adds zero-based gi, gj per patch: the last row and column fold into the one before."""
    area = W.partitionBy("patch_id")
    placed = points.withColumns({"i": geometry.grid_cell(F.col("y"), F.min("y").over(area), size, nudge), "j": geometry.grid_cell(F.col("x"), F.min("x").over(area), size, nudge)})
    fold = lambda c: (F.greatest(F.when(F.col(c) == F.max(c).over(area), F.col(c) - 1).otherwise(F.col(c)), F.lit(1)) - 1).cast("int")
    return placed.withColumns({"gi": fold("i"), "gj": fold("j")}).drop("i", "j")


def accumulate(phase: DataFrame, placed: DataFrame, weight: str | None = None) -> DataFrame:
    """Complex sums per patch, cell and interferogram; aggregated before the shuffle."""
    joined = phase.join(placed.select("patch_id", "ps_id", "gi", "gj", *[weight] * bool(weight)), "ps_id")
    w = F.col(weight) if weight else F.lit(1.0)
    return joined.groupBy("patch_id", "gi", "gj", "ifg_ix").agg(F.sum(F.col("re") * w).alias("re"), F.sum(F.col("im") * w).alias("im"))


def at_points(grid: DataFrame, placed: DataFrame) -> DataFrame:
    """Unit phasor of each point's cell."""
    found = placed.select("patch_id", "ps_id", "gi", "gj").join(grid, ["patch_id", "gi", "gj"])
    u = unit(cpx("re", "im"))
    return found.select("ps_id", "ifg_ix", u.re.alias("re"), u.im.alias("im"))


def restore(phase: DataFrame, placed: DataFrame, unwrapped: DataFrame) -> DataFrame:
    """Unwrapped phase of each point: its cell's, plus its wrapped difference from it; null without a cell."""
    joined = phase.join(placed.select("patch_id", "ps_id", "gi", "gj"), "ps_id").join(unwrapped.select("patch_id", "gi", "gj", "ifg_ix", "uw"), ["patch_id", "gi", "gj", "ifg_ix"], "left")
    away = arg(mul(cpx("re", "im"), conj(cpx(F.cos("uw"), F.sin("uw")))))
    return joined.select("ps_id", "ifg_ix", (F.col("uw") + away).alias("ph_uw"))


def histogram(values: DataFrame, column: str, bins: int = 100, width: float = 0.01) -> DataFrame:
    """Counts around centres width * (bin + 1/2): ties to the lower bin, outliers to the end bins, non-finite ones left out."""
    v = F.col(column)
    slot = F.greatest(F.least(F.ceil(F.round(v / width, 9)) - 1, F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = values.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", ((F.col("bin") + 0.5) * width).alias("center"), F.coalesce("n", F.lit(0)).alias("n"))


def at_ranks(values: DataFrame, column: str, n: int, ranks: Iterable[int], few: int = 5_000, accuracy: int = 10_000) -> dict[int, float]:
    """The column's values at ranks (from 0, NaN last) among its n that aren't null, exactly.

    A sketch puts cuts around the ranks, all rows are counted between cuts, and only
    the stretches that hold a rank are put in order, equal values as one row. A cut in
    a bad place makes a stretch longer, never a value wrong.
    """
    v = values.select((F.col(column).cast("double") + 0.0).alias("v")).where("v is not null")
    ranks, cuts = sorted(set(ranks)), []
    if n > few:
        near = sorted({min(max(r / n + d / accuracy, 0.0), 1.0) for r in ranks for d in (-2, 2)})
        found = v.where(~F.isnan("v")).agg(F.percentile_approx("v", near[:: len(near) // 2000 + 1], accuracy)).first()[0] or []
        cuts = sorted({x for f in found for x in (f, math.nextafter(f, math.inf)) if math.isfinite(x)})
    placed = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="v", outputCol="slot", handleInvalid="keep").transform(v) if cuts else v.withColumn("slot", F.lit(0.0))
    wanted, start, left = [], 0, ranks[::-1]
    for slot, size in sorted(tuple(r) for r in placed.groupBy("slot").count().collect()):  # at most 4,002 slots
        while left and left[-1] < start + size:
            wanted.append((slot, left[-1], left.pop() - start))
        start += size
    if left:
        raise ValueError(f"no rank {left[0]} among {start} values of {column}")
    groups = placed.where(F.col("slot").isin(sorted({w[0] for w in wanted}))).groupBy("slot", "v").count()
    running = groups.withColumn("upto", F.sum("count").over(W.partitionBy("slot").orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    sought = values.sparkSession.createDataFrame(wanted, "slot double, rank long, inside long")
    hit = running.join(F.broadcast(sought), "slot").where("inside < upto and inside >= upto - count")
    return {r["rank"]: r["v"] for r in hit.select("rank", "v").collect()}


def quantiles(values: DataFrame, column: str, shares: Iterable[float]) -> list[float | None]:
    """Exact quantiles, in between neighbours by a line; nulls left out, None if nothing else is there."""
    n = values.where(F.col(column).isNotNull()).count()
    if not n:
        return [None for _ in shares]
    places = [(n - 1) * s for s in shares]
    found = at_ranks(values, column, n, [k for p in places for k in (math.floor(p), math.ceil(p))])
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        out.append(found[low] if found[low] == found[high] else (high - p) * found[low] + (p - low) * found[high] if high > low else found[low])
    return out


def area(points: DataFrame) -> DataFrame:
    """Square kilometres of each patch's bounding box; 1 if it has none."""
    side = lambda c: F.max(c) - F.min(c)
    found = points.groupBy("patch_id").agg((side("x") * side("y") / 1e6).alias("km2"))
    return found.select("patch_id", F.when(F.col("km2") > 0, F.col("km2")).otherwise(1.0).alias("km2"))


def within(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (a, b, d2) nearer than the radius, each both ways and each point with itself.

    Points fall into square bins as wide as the radius; one side is repeated for
    the 3 x 3 bins around it, so the join is by equality of bins.
    """
    bin_of = lambda c: F.floor(F.col(c) / radius).cast("long")
    left = points.select(F.col("ps_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), bin_of("x").alias("bx"), bin_of("y").alias("by"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = points.select(F.col("ps_id").alias("b"), F.col("x").alias("px"), F.col("y").alias("py"), F.explode(around).alias("o")).select("b", "px", "py", (F.floor(F.col("px") / radius).cast("long") + F.col("o.i")).alias("bx"), (F.floor(F.col("py") / radius).cast("long") + F.col("o.j")).alias("by"))
    d2 = F.pow(F.col("ax") - F.col("px"), 2) + F.pow(F.col("ay") - F.col("py"), 2)
    return left.join(right, ["bx", "by"]).select("a", "b", d2.alias("d2")).where(F.col("d2") < radius * radius)


def nearest(queries: DataFrame, known: DataFrame, size: float) -> DataFrame:
    """(query_id, known_id, d2): the nearest known place of each query, ties to the lower id.

    Queries look into 3 x 3 bins; who finds nothing surely nearest there looks at
    the bins' next ring, doubling the width, so each round is a join by equality.
    """
    out, left, width = None, queries.select("query_id", "qx", "qy"), size
    for _ in range(24):
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        asked = left.withColumn("o", F.explode(around)).select("query_id", "qx", "qy", (F.floor(F.col("qx") / width).cast("long") + F.col("o.i")).alias("bx"), (F.floor(F.col("qy") / width).cast("long") + F.col("o.j")).alias("by"))
        there = known.select("known_id", "kx", "ky", F.floor(F.col("kx") / width).cast("long").alias("bx"), F.floor(F.col("ky") / width).cast("long").alias("by"))
        d2 = F.pow(F.col("qx") - F.col("kx"), 2) + F.pow(F.col("qy") - F.col("ky"), 2)
        best = asked.join(there, ["bx", "by"]).groupBy("query_id").agg(F.min(F.struct(d2.alias("d2"), "known_id")).alias("m")).select("query_id", F.col("m.known_id").alias("known_id"), F.col("m.d2").alias("d2")).where(F.col("d2") <= width * width)
        out = best if out is None else out.unionByName(best)
        # kept for the next rounds, or every one would run all before it again
        left = left.join(best.select("query_id"), "query_id", "left_anti").persist(StorageLevel.MEMORY_AND_DISK)
        if left.isEmpty():
            return out
        width *= 2
    raise ValueError(f"queries without a known place within {width / 2}")


def raster_edges(cells_: DataFrame) -> DataFrame:
    """Different ids that meet across a side of the raster (row, col, id): (a, b), a < b."""
    here = cells_.select("row", "col", F.col("id").alias("p"))
    right = cells_.select("row", (F.col("col") - 1).alias("col"), F.col("id").alias("q"))
    below = cells_.select((F.col("row") - 1).alias("row"), "col", F.col("id").alias("q"))
    pairs = here.join(right, ["row", "col"]).unionByName(here.join(below, ["row", "col"]))
    return pairs.where("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def signed_edges(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """The edge of each step (p, q): its id, negative against its direction, 0 inside one node."""
    named = steps.withColumns({"a": F.least("p", "q"), "b": F.greatest("p", "q")}).join(edges, ["a", "b"], "left")
    return named.select("p", "q", F.when(F.col("p") == F.col("q"), 0).when(F.col("p") < F.col("q"), F.col("edge_id")).otherwise(-F.col("edge_id")).alias("signed"))


def wrapped(column: str):
    return wrap(F.col(column))
