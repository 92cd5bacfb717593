"""The network of a scene's grid: nearest occupied cells, edges between them, costs of their steps, dates solved on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterlake.functions.phase import TAU, arg, cpx, half_even, wrap
from scatterlake.operators import grid, unwrap


def nodes(cells: DataFrame, rows: int) -> DataFrame:
    """Adds the node of each occupied cell (gi, gj): ids from 1 in column order."""
    return cells.withColumn("node", F.col("gj").cast("long") * rows + F.col("gi") + 1)


def raster(occupied: DataFrame, rows: int, cols: int) -> DataFrame:
    """(gi, gj, node, own) of every cell of the grid: the nearest occupied cell (gi, gj, node), ties to the lower id."""
    every = occupied.sparkSession.range(rows * cols).select(F.col("id").alias("query_id"), (F.col("id") / cols).cast("int").alias("gi"), (F.col("id") % cols).cast("int").alias("gj"))
    asked = every.select("query_id", F.col("gj").cast("double").alias("qx"), F.col("gi").cast("double").alias("qy"))
    known = occupied.select(F.col("node").alias("known_id"), F.col("gj").cast("double").alias("kx"), F.col("gi").cast("double").alias("ky"))
    near = grid.nearest(asked, known, 2.0)
    return every.join(near, "query_id").select("gi", "gj", F.col("known_id").alias("node"), (F.col("d2") == 0).alias("own"))


def edges(cells: DataFrame) -> DataFrame:
    """(edge_id, a, b) of the different nodes that meet in the raster; store it before use, as the ids go by partition."""
    pairs = grid.raster_edges(cells.select(F.col("gi").alias("row"), F.col("gj").alias("col"), F.col("node").alias("id")))
    return pairs.withColumn("edge_id", F.monotonically_increasing_id() + 1)


def steps(cells: DataFrame, edges_: DataFrame) -> DataFrame:
    """The raster with the signed edge to the cell on the right and below: 0 inside a node, null at the border."""
    out = cells
    for name, beside in (("right", ("gi", F.col("gj") - 1)), ("down", (F.col("gi") - 1, "gj"))):
        i, j = (F.col(c) if isinstance(c, str) else c for c in beside)
        pairs = cells.select("gi", "gj", F.col("node").alias("p")).join(cells.select(i.cast("int").alias("gi"), j.cast("int").alias("gj"), F.col("node").alias("q")), ["gi", "gj"])
        named = grid.signed_edges(pairs.select("p", "q").distinct(), edges_)
        out = out.join(pairs.join(named, ["p", "q"]).select("gi", "gj", F.col("signed").alias(name)), ["gi", "gj"], "left")
    return out


def with_variances(stepped: DataFrame, smoothed: DataFrame) -> DataFrame:
    """Adds right_sig and down_sig: variance costs of the steps, 1 inside a node, null on edges without finite noise."""
    used = stepped.select(F.explode(F.array("right", "down")).alias("signed"))
    sig = unwrap.variances(smoothed, used).select("edge_id", "sigsq")
    out = stepped
    for name in ("right", "down"):
        out = out.join(sig.select(F.col("edge_id").alias("_e"), F.col("sigsq").alias(f"{name}_sig")), F.abs(name) == F.col("_e"), "left").drop("_e")
        out = out.withColumn(f"{name}_sig", F.when(F.col(name) == 0, F.lit(1)).otherwise(F.col(f"{name}_sig")))
    return out


def edge_offsets(edge: DataFrame, smoothed: DataFrame) -> DataFrame:
    """(edge_id, ifg_ix, off): the wrapped step of an edge minus its smooth one in cost units, along the edge; edges without finite noise have none."""
    good = smoothed.where("noise is not null and not isnan(noise)").select("edge_id", "ifg_ix", (F.col("smooth") - F.col("noise")).alias("smooth"))
    away = (wrap(arg(cpx("re", "im"))) - F.col("smooth")) * unwrap.CYCLE / TAU
    return edge.join(good, ["edge_id", "ifg_ix"]).select("edge_id", "ifg_ix", F.greatest(F.least(half_even(away), F.lit(32767.0)), F.lit(-32767.0)).cast("int").alias("off"))


def solve(costed: DataFrame, phase: DataFrame, offsets: DataFrame) -> DataFrame:
    """(patch_id, ifg_ix, gi, gj, uw) of the occupied cells, from the raster with its variances, the nodes' phase (node, ifg_ix, ph) and offsets.

    A date is one task. Edges without finite noise have the shelf of 1 that lets any flow pass.
    """
    rows = costed.join(phase.select("node", "ifg_ix", "ph"), "node")
    for name, way in (("right", 1), ("down", -1)):
        o = offsets.select(F.col("edge_id").alias("_e"), F.col("ifg_ix").alias("_d"), F.col("off").alias("_o"))
        sign: Column = F.signum(F.col(name).cast("double")).cast("int") * way
        rows = rows.join(o, (F.abs(name) == F.col("_e")) & (F.col("ifg_ix") == F.col("_d")), "left").withColumn(f"{name}_off", F.coalesce(sign * F.col("_o"), F.lit(0))).drop("_e", "_d", "_o")
    wide = rows.select("ifg_ix", "gi", "gj", "own", "ph", *[f"{n}_{k}" for n in ("right", "down") for k in ("off", "sig")])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["gi"].to_numpy(), p["gj"].to_numpy()
        plane = np.zeros((i.max() + 1, j.max() + 1))
        plane[i, j] = p["ph"]
        sides = []
        for name in ("right", "down"):
            sig = p[f"{name}_sig"].to_numpy(float, na_value=np.nan)
            cost = np.zeros((*plane.shape, 4), np.int64)
            cost[i, j] = np.stack([p[f"{name}_off"].to_numpy(np.int64), np.nan_to_num(sig, nan=1).astype(np.int64), np.full(len(p), unwrap.UNBOUNDED), np.where(np.isnan(sig), 1, unwrap.NO_SHELF)], axis=1)
            sides.append(cost)
        out = unwrap.unwrap_grid(plane, sides[0][:, :-1], sides[1][:-1])
        own = p["own"].to_numpy(bool)
        return p.loc[own, ["ifg_ix", "gi", "gj"]].assign(patch_id=0, uw=out[i[own], j[own]])

    return wide.groupBy("ifg_ix").applyInPandas(run, "ifg_ix long, gi int, gj int, patch_id int, uw double").select("patch_id", "ifg_ix", "gi", "gj", "uw")
