"""Weeding: duplicates, neighbours, edges and their noise."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.functions.phase import arg, conj, cpx, detrend, mul, polar, unit


def best_of(points: DataFrame, keys: list[str], ties: str = "ps_id") -> DataFrame:
    """Of rows with equal keys, the most coherent one, ties to the least id. The rank is limited before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.desc("coh"), ties)
    return points.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def corrected(phase: DataFrame, fit: DataFrame, ifgs: DataFrame) -> DataFrame:
    """Unit phasors without the baseline term; the master carries the offset."""
    joined = phase.join(fit.select("ps_id", "k", "c"), "ps_id").join(F.broadcast(ifgs.select("ifg_ix", "bperp", "is_master")), "ifg_ix")
    u, m = unit(detrend(cpx("re", "im"), F.col("k"), F.col("bperp"))), polar(F.lit(1.0), F.col("c"))
    return joined.select("ps_id", "ifg_ix", F.when(F.col("is_master"), m.re).otherwise(u.re).alias("re"), F.when(F.col("is_master"), m.im).otherwise(u.im).alias("im"))


def edge_phase(edges: DataFrame, phase: DataFrame, normal: bool = False) -> DataFrame:
    """b times conj(a) along every edge (edge_id, a, b); optionally as phasors."""
    a = phase.select(F.col("ps_id").alias("a"), "ifg_ix", F.col("re").alias("ar"), F.col("im").alias("ai"))
    b = phase.select(F.col("ps_id").alias("b"), "ifg_ix", F.col("re").alias("br"), F.col("im").alias("bi"))
    joined = edges.join(a, "a").join(b, ["b", "ifg_ix"])
    z = mul(cpx("br", "bi"), conj(cpx("ar", "ai")))
    z = unit(z) if normal else z
    return joined.select("edge_id", "a", "b", "ifg_ix", z.re.alias("re"), z.im.alias("im"))


def centred_angles(edge: DataFrame) -> DataFrame:
    """Edge angles minus each edge's mean angle."""
    angle = arg(cpx("re", "im"))
    return edge.select("edge_id", "a", "b", "ifg_ix", angle.alias("angle")).withColumn("noise", F.col("angle") - F.avg("angle").over(W.partitionBy("edge_id")))


def date_variance(edge: DataFrame) -> DataFrame:
    """Per date, the variance over edges of the real and of the complex values."""
    return edge.groupBy("ifg_ix").agg(F.coalesce(F.var_samp("re"), F.lit(0.0)).alias("var_re"), F.coalesce(F.var_samp("re") + F.var_samp("im"), F.lit(0.0)).alias("var"))


def spread(noise: DataFrame) -> DataFrame:
    """Standard deviation and largest size of each edge's noise."""
    return noise.groupBy("edge_id", "a", "b").agg(F.stddev_samp("noise").alias("std"), F.max(F.abs("noise")).alias("top"))


def point_noise(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The least std and top of a point's edges; infinite without any."""
    ends = edges.select(F.col("a").alias("ps_id"), "std", "top").unionByName(edges.select(F.col("b").alias("ps_id"), "std", "top"))
    least = ends.groupBy("ps_id").agg(F.min("std").alias("ps_std"), F.min("top").alias("ps_max"))
    return points.join(least, "ps_id", "left").na.fill({"ps_std": float("inf"), "ps_max": float("inf")})


def weeded(points: DataFrame, most_std: float, most_top: float, height: float | None = None) -> DataFrame:
    """The keep mask: strictly under both limits, above zero height if asked, and what columns near and unique already hold."""
    keep = (F.col("ps_std") < most_std) & (F.col("ps_max") < most_top)
    keep = keep & (F.col("height") >= 1e-6) if height is not None else keep
    return points.withColumn("keep", keep)


def delaunay(x: np.ndarray, y: np.ndarray) -> set[tuple[int, int]]:
    """Delaunay edges by insertion (Bowyer-Watson); two points make an edge, points on a line a chain."""
    p = np.column_stack([x, y]).astype(float)
    _, first = np.unique(p, axis=0, return_index=True)
    ids = np.sort(first)
    q = p[ids]
    n = len(q)
    if n < 2:
        return set()
    flat = q - q.mean(axis=0)
    if n == 2 or np.linalg.matrix_rank(flat, tol=1e-9 * max(1.0, np.abs(flat).max())) < 2:
        way = np.argsort(flat @ np.linalg.svd(flat)[2][0], kind="stable")
        return {tuple(sorted((int(ids[a]), int(ids[b])))) for a, b in zip(way[:-1], way[1:], strict=True)}
    size = np.abs(flat).max() * 1e3
    q = np.vstack([flat, [[-3 * size, -3 * size], [3 * size, -3 * size], [0, 3 * size]]])
    tri = np.array([[n, n + 1, n + 2]])
    centre, radius = _circles(q, tri)
    for k in np.lexsort((flat[:, 1], flat[:, 0])):
        bad = ((centre - q[k]) ** 2).sum(axis=1) < radius * (1 - 1e-12)
        sides = np.sort(np.concatenate([tri[bad][:, [0, 1]], tri[bad][:, [1, 2]], tri[bad][:, [2, 0]]]), axis=1)
        rim, count = np.unique(sides, axis=0, return_counts=True)
        rim = rim[count == 1]
        new = np.column_stack([rim, np.full(len(rim), k)])
        c, r = _circles(q, new)
        good = np.isfinite(r)
        tri, centre, radius = np.vstack([tri[~bad], new[good]]), np.vstack([centre[~bad], c[good]]), np.concatenate([radius[~bad], r[good]])
    tri = tri[(tri < n).all(axis=1)]
    sides = np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1)
    return {(int(ids[a]), int(ids[b])) for a, b in np.unique(sides, axis=0)}


def _circles(q: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = q[tri[:, 0]], q[tri[:, 1]] - q[tri[:, 0]], q[tri[:, 2]] - q[tri[:, 0]]
    d = 2 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    bb, cc = (b * b).sum(axis=1), (c * c).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.column_stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb]) / d[:, None]
    return a + u, (u * u).sum(axis=1)


def delaunay_edges(points: DataFrame) -> DataFrame:
    """(patch_id, a, b) per patch. Patches bound the group; the preparation step chooses their size."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ps_id").reset_index(drop=True)
        found = sorted(delaunay(p["x"].to_numpy(), p["y"].to_numpy()))
        a, b = ([int(p["ps_id"][e[k]]) for e in found] for k in (0, 1))
        return pd.DataFrame({"patch_id": np.full(len(found), p["patch_id"].iloc[0]), "a": np.minimum(a, b), "b": np.maximum(a, b)} if found else {"patch_id": [], "a": [], "b": []})

    return points.select("patch_id", "ps_id", "x", "y").groupBy("patch_id").applyInPandas(run, "patch_id int, a long, b long")


def adjacent_groups(i: np.ndarray, j: np.ndarray, coh: np.ndarray) -> np.ndarray:
    """Which points stay when, of points on touching pixels, the most coherent of a group does.

    A point follows the first one to arrive on its eight neighbouring pixels (not on its
    own). In order of arrival, a point gathers those that follow it, those that follow
    them and so on, as far as no earlier point has gathered them; of each group all but
    the first of the most coherent go.
    """
    first: dict[tuple[int, int], int] = {}
    cells = list(zip(i.tolist(), j.tolist(), strict=True))
    for k, cell in enumerate(cells):
        first.setdefault(cell, k)
    followers: dict[int, list[int]] = {}
    for k, (r, c) in enumerate(cells):
        near = [first[r + a, c + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (r + a, c + b) in first]
        if near:
            followers.setdefault(min(near), []).append(k)
    keep = np.ones(len(i), bool)
    for k in range(len(i)):
        todo, group = [k] if k in followers else [], set()
        while todo:
            m = todo.pop()
            group.add(m)
            todo += followers.pop(m, [])
        if group:
            stays = min(group, key=lambda m: (-coh[m], m))
            keep[[m for m in group if m != stays]] = False
    return keep


def adjacency_keep(points: DataFrame) -> DataFrame:
    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ps_id")
        return pd.DataFrame({"ps_id": p["ps_id"], "keep": adjacent_groups(p["row"].to_numpy(), p["col"].to_numpy(), p["coh"].to_numpy())})

    return points.select("patch_id", "ps_id", "row", "col", "coh").groupBy("patch_id").applyInPandas(run, "ps_id long, keep boolean")


def temporal_noise(z: np.ndarray, day: np.ndarray, bperp: np.ndarray, window: float) -> np.ndarray:
    """Noise of edge phasors (edges x dates): what a weighted local line in time, then a baseline slope, leave."""
    w = np.exp(-0.5 * ((day[:, None] - day[None, :]) / window) ** 2)
    total = w.sum(axis=1, keepdims=True)
    w = np.where(total > 0, w / np.where(total > 0, total, 1), 1 / len(day))
    smooth, alone = np.empty_like(z), np.empty(z.shape)
    for t in range(len(day)):
        for skip in (False, True):
            v = w[t].copy()
            if skip:
                v[t] = 0
                v = v / v.sum() if v.sum() > 0 else np.full(len(v), 1 / len(v))
            mean = z @ v
            fit = np.zeros(len(z))
            for _ in range(2):  # the second pass wraps around the first line
                rest = np.angle(z * np.conj(mean * np.exp(1j * fit))[:, None])
                x = day[t] - day
                s0, s1, s2 = v.sum(), v @ x, v @ (x * x)
                y0, y1 = rest @ v, rest @ (v * x)
                bottom = s0 * s2 - s1 * s1
                fit = fit + ((s2 * y0 - s1 * y1) / bottom if bottom > 1e-12 else y0)
            if skip:
                alone[:, t] = np.angle(z[:, t] * np.conj(mean * np.exp(1j * fit)))
            else:
                smooth[:, t] = mean * np.exp(1j * fit)
    noise = np.angle(z * np.conj(smooth))
    variance = alone.var(axis=0, ddof=1) if len(z) > 1 else np.ones(len(day))
    weight = 1 / np.where(variance > 0, variance, np.inf) if (variance > 0).any() else np.ones(len(day))
    slope = noise @ (weight * bperp) / max(1e-12, float((weight * bperp * bperp).sum()))
    return noise - slope[:, None] * bperp


def edge_noise(edge: DataFrame, ifgs: DataFrame, window: float = 730.0) -> DataFrame:
    """(edge_id, a, b, std, top) of single-master noise, by patches of edges; dates are a broadcast table."""
    dates = ifgs.orderBy("ifg_ix").select("ifg_ix", "day", "bperp").toPandas()
    day, bperp = dates["day"].to_numpy(float), dates["bperp"].to_numpy(float)
    series = edge.groupBy("patch_id", "edge_id", "a", "b").agg(F.array_sort(F.collect_list(F.struct("ifg_ix", "re", "im"))).alias("s"))
    flat = series.select("patch_id", "edge_id", "a", "b", F.transform("s", lambda x: x["re"]).alias("re"), F.transform("s", lambda x: x["im"]).alias("im"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("edge_id")
        noise = temporal_noise(np.stack(p["re"]) + 1j * np.stack(p["im"]), day, bperp, window)
        return pd.DataFrame({"edge_id": p["edge_id"], "a": p["a"], "b": p["b"], "std": noise.std(axis=1, ddof=1), "top": np.abs(noise).max(axis=1)})

    return flat.groupBy("patch_id").applyInPandas(run, "edge_id long, a long, b long, std double, top double")


def baseline_free_noise(edge: DataFrame, ifgs: DataFrame) -> DataFrame:
    """(edge_id, std, top) of the angle that the edge's complex slope on the baseline leaves.

    The slope weights dates by the inverse variance over edges; dates are a table the
    size of the stack and their variances join by broadcast. Two shuffles: by date with
    partial sums, and by edge.
    """
    dates = date_variance(edge).join(ifgs.select("ifg_ix", "bperp"), "ifg_ix").select("ifg_ix", "bperp", F.when(F.col("var") > 0, 1 / F.col("var")).otherwise(0.0).alias("w"))
    joined = edge.join(F.broadcast(dates), "ifg_ix")
    per = W.partitionBy("edge_id")
    below = F.sum(F.col("w") * F.col("bperp") * F.col("bperp")).over(per)
    slope = {c: F.try_divide(F.sum(F.col("w") * F.col("bperp") * F.col(c)).over(per), below) for c in ("re", "im")}
    rest = joined.withColumns({"sr": slope["re"], "si": slope["im"]})
    angle = F.atan2(F.col("im") - F.col("si") * F.col("bperp"), F.col("re") - F.col("sr") * F.col("bperp"))
    return rest.withColumn("angle", angle).groupBy("edge_id").agg(F.stddev_samp("angle").alias("std"), F.max(F.abs("angle")).alias("top"))
