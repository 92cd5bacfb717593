"""Phase against baseline: the trial fit, weights, random coherence, selection thresholds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.operators.grid import at_ranks, histogram

QUARTER, NEAR = math.pi / 4, 2e-4
FIT = "ps_id long, k double, c double, coh double"


def fit_rows(ph: np.ndarray, bperp: np.ndarray, wraps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slope, offset, coherence and residual of each row of phasors; zeros are missing.

    The best of the trial slopes (the last among equals) is refined once by the
    amplitude-weighted regression of the residual phase on the baseline.
    """
    ph, bperp = np.atleast_2d(ph), np.broadcast_to(np.atleast_2d(bperp), np.atleast_2d(ph).shape)
    there = ph != 0
    amp = np.abs(ph)
    low, high = np.where(there, bperp, np.inf).min(axis=1), np.where(there, bperp, -np.inf).max(axis=1)
    span = np.where(np.isfinite(high - low) & (high > low), high - low, 1.0)
    trials = np.arange(-math.ceil(8 * wraps), math.ceil(8 * wraps) + 1)
    total = np.where(amp.sum(axis=1) > 0, amp.sum(axis=1), 1.0)
    best, found = np.full(len(ph), -np.inf), np.zeros(len(ph))
    turn = np.exp(-1j * bperp / span[:, None] * QUARTER)
    now = ph * turn ** float(trials[0])
    for t in trials:
        coh = np.abs(now.sum(axis=1)) / total
        better = coh >= best
        best, found = np.where(better, coh, best), np.where(better, t, found)
        now = now * turn
    coarse = QUARTER / span * found
    rest = ph * np.exp(-1j * coarse[:, None] * bperp)
    mean = rest.sum(axis=1)
    wb = amp * bperp
    norm = (wb * wb).sum(axis=1)
    k = coarse + (wb * amp * np.angle(rest * mean.conj()[:, None]) * there).sum(axis=1) / np.where(norm > 0, norm, 1.0)
    rest = ph * np.exp(-1j * k[:, None] * bperp)
    mean = rest.sum(axis=1)
    empty = ~there.any(axis=1)
    coh = np.abs(mean) / total
    k, c, coh = (np.where(empty, np.nan, x) for x in (k, np.angle(mean), coh))
    return k, c, coh, rest


def wide(phase: DataFrame, ifgs: DataFrame) -> DataFrame:
    """(ps_id, re, im, bperp) arrays in the order of ifg_ix."""
    joined = phase.join(F.broadcast(ifgs.select("ifg_ix", "bperp")), "ifg_ix")
    one = joined.groupBy("ps_id").agg(F.array_sort(F.collect_list(F.struct("ifg_ix", "re", "im", "bperp"))).alias("s"))
    return one.select("ps_id", *[F.col(f"s.{c}").alias(c) for c in ("re", "im", "bperp")])


def topofit(phase: DataFrame, ifgs: DataFrame, wraps: float) -> DataFrame:
    """(ps_id, k, c, coh) by Arrow batches of whole series: the trial grid stays in numpy."""

    def run(parts):
        for p in parts:
            if len(p):
                ph = np.stack(p["re"]) + 1j * np.stack(p["im"])
                k, c, coh, _ = fit_rows(ph, np.stack(p["bperp"]), wraps)
                yield pd.DataFrame({"ps_id": p["ps_id"], "k": k, "c": c, "coh": coh})

    return wide(phase, ifgs).mapInPandas(run, FIT)


def signal_noise_weight(phase: DataFrame) -> DataFrame:
    """Weight of each series of (amp, angle): signal over noise of the in-phase part."""
    g = phase.groupBy("ps_id").agg(F.avg(F.col("amp") * F.cos("angle")).alias("g"), F.avg(F.col("amp") * F.col("amp")).alias("a2"))
    noise = F.sqrt(F.greatest(0.5 * (F.col("a2") - F.col("g") * F.col("g")), F.lit(0.0)))
    return g.select("ps_id", F.when(noise > 0, F.col("g") / noise).otherwise(0.0).alias("weight"))


def coherence_change(now: DataFrame, before: DataFrame) -> DataFrame:
    both = now.select("ps_id", F.col("coh").alias("p")).join(before.select("ps_id", F.col("coh").alias("q")), "ps_id")
    return both.agg(F.sqrt(F.avg(F.pow(F.col("p") - F.col("q"), 2))).alias("rms"))


def random_histogram(bperp: np.ndarray, wraps: float, rows: int, seed: int = 2005, bins: int = 100) -> np.ndarray:
    """Histogram of the coherence that the fit finds in random phases."""
    rng, out = np.random.default_rng(seed), np.zeros(bins)
    for lo in range(0, rows, 20_000):
        ph = np.exp(2j * np.pi * rng.random((min(20_000, rows - lo), len(bperp))))
        coh = fit_rows(ph, bperp, wraps)[2]
        out += np.bincount(np.clip(np.ceil(np.round(coh * bins, 9)).astype(int) - 1, 0, bins - 1), minlength=bins)
    return out


def interpolate(values: np.ndarray, factor: int = 10, half: int = 4, cutoff: float = 0.5) -> np.ndarray:
    """Band-limited upsampling: the symmetric filter that is exact for the original samples in the mean-square sense."""
    taps = np.arange(-half * factor, half * factor + 1)
    kernel = np.sinc(taps / factor) * (0.5 + cutoff * np.cos(np.pi * taps / (half * factor)))
    padded = np.concatenate([2 * values[0] - values[half:0:-1], values, 2 * values[-1] - values[-2 : -half - 2 : -1]])
    spread = np.zeros(len(padded) * factor)
    spread[::factor] = padded
    return np.convolve(spread, kernel, "same")[half * factor : half * factor + len(values) * factor]


def psquare_weights(observed: np.ndarray, random: np.ndarray, low: int = 31) -> np.ndarray:
    """Weight by 1/1000 of coherence: (1 - probability of being random) squared, smoothed by a 7-tap Gaussian."""
    scale = observed[:low].sum() / random[:low].sum() if random[:low].sum() else 1.0
    chance = random * scale / np.where(observed == 0, 1, observed)
    chance[:low] = 1
    last = np.flatnonzero(random)[-1] if random.any() else -1
    chance[last + 1 :] = 0
    chance = np.minimum(chance, 1)
    taps = np.exp(-0.5 * (2.5 * np.arange(-3, 4) / 3) ** 2)
    smooth = np.convolve(np.concatenate([np.ones(7), chance]), taps / taps.sum())[7 : 7 + len(chance)]
    fine = np.clip(interpolate(smooth), 0, 1)
    return (1 - np.append(fine, fine[-1])) ** 2


def dispersion_bins(points: DataFrame, few: int = 10_000, many: int = 50_000, steps: tuple[int, int] = (2_000, 10_000)) -> DataFrame:
    """Edges of amplitude-dispersion bins: 0, order statistics at a fixed step and the largest; 0 and 1 for few points.

    The last step's points and the rest are one bin, so the step before the largest
    has no edge. Equal values are edges as often as they come.
    """
    n = points.where("d_a is not null").count()
    edges = [0.0, 1.0]
    if n >= few:
        step = steps[n >= many]
        ranks = [*range(step - 1, n - step, step), n - 1]
        found = at_ranks(points, "d_a", n, ranks)
        edges = [0.0, *[found[r] for r in ranks]]
    return points.sparkSession.createDataFrame(list(enumerate(edges)), "edge int, d_a double")


def tail(observed: DataFrame, random: DataFrame, low: int = 31, percent: bool = True) -> DataFrame:
    """Per bin from the top down: the share (or number) of random points among those at least as coherent."""
    both = observed.select("bin", F.col("n").alias("o")).join(random.select("bin", F.col("n").alias("r")), "bin")
    scale = both.agg(F.try_divide(F.sum(F.when(F.col("bin") < low, F.col("o"))), F.sum(F.when(F.col("bin") < low, F.col("r")))).alias("scale"))
    down = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)  # as many rows as bins
    scaled = both.crossJoin(F.broadcast(scale)).withColumn("s", F.col("r") * F.coalesce("scale", F.lit(1.0)))
    expected, seen = F.sum("s").over(down), F.sum(F.when(F.col("o") == 0, 1).otherwise(F.col("o"))).over(down)
    return scaled.select("bin", (expected / seen * 100 if percent else expected).alias("metric"))


def threshold_of(metric: np.ndarray, most: float) -> float:
    """Coherence where the tail metric falls to the allowed one: a cubic through the six bins around; NaN if it never gets there in time."""
    under = np.flatnonzero(metric < most)
    if not len(under):
        return 1.0
    first = under[0] + 1
    if first <= 3:
        return math.nan
    start, end = first - 4, min(first + 2, 100, len(metric))
    if end - start < 4:
        return math.nan
    x, y = metric[start:end], (np.arange(start, end) + 1) * 0.01
    spread = x.std(ddof=1) or 1.0
    return float(np.polyval(np.polyfit((x - x.mean()) / spread, y, 3), (most - x.mean()) / spread))


def coherence_thresholds(points: DataFrame, edges: DataFrame, random: np.ndarray, most: float = 20.0, percent: bool = True, low: int = 31) -> tuple[float, float]:
    """(slope, intercept) of the selection threshold over amplitude dispersion."""
    cut = [r["d_a"] for r in edges.orderBy("edge").collect()]
    of_bin = sum((F.when(F.col("d_a") > e, 1).otherwise(0) for e in cut[:-1]), F.lit(0))
    inside = points.where((F.col("d_a") > cut[0]) & (F.col("d_a") <= cut[-1])).withColumn("slot", of_bin)
    means = {r["slot"]: r["m"] for r in inside.groupBy("slot").agg(F.avg("d_a").alias("m")).collect()}
    usable = inside.where(F.col("coh").isNotNull() & ~F.isnan("coh") & (F.col("coh") != 0))
    counts = usable.groupBy("slot", F.greatest(F.least(F.ceil(F.round(F.col("coh") * 100, 9)) - 1, F.lit(99)), F.lit(0)).alias("bin")).count().collect()
    found = []
    for slot, mean in sorted(means.items()):
        observed = np.zeros(100)
        for r in counts:
            if r["slot"] == slot:
                observed[r["bin"]] = r["count"]
        if not observed.any():
            continue
        scaled = random * (observed[:low].sum() / random[:low].sum() if random[:low].sum() else 1.0)
        above = np.cumsum(scaled[::-1])[::-1]
        value = threshold_of(above / np.cumsum(np.where(observed == 0, 1, observed)[::-1])[::-1] * 100 if percent else above, most)
        if math.isfinite(value):
            found.append((mean, value))
    if not found:
        return 0.0, 0.3
    if len(found) == 1:
        return 0.0, max(0.0, found[0][1])
    slope, intercept = np.polyfit(*np.array(found).T, 1)
    return (float(slope), float(intercept)) if slope > 0 else (0.0, max(0.0, float(slope * 0.35 + intercept)))


def selected(points: DataFrame, slope: float, intercept: float) -> DataFrame:
    """Strictly over the threshold of their dispersion."""
    return points.withColumn("thresh", F.greatest(slope * F.col("d_a") + intercept, F.lit(0.0))).where(F.col("coh") > F.col("thresh"))


def reestimated(fit: DataFrame, again: DataFrame, baseline_range: float) -> DataFrame:
    """Keeps points whose second coherence passes and whose slope moved by less than a cycle over the baselines."""
    both = fit.select("ps_id", "k", "thresh").join(again.select("ps_id", F.col("k").alias("k2"), F.col("coh").alias("coh2")), "ps_id")
    return both.withColumn("keep", (F.col("coh2") > F.greatest("thresh", F.lit(0.0))) & (F.abs(F.col("k") - F.col("k2")) < 2 * math.pi / baseline_range))


def coherence_histogram(fit: DataFrame) -> DataFrame:
    return histogram(fit, "coh")
