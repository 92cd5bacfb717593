"""Phase unwrapping of gridded interferograms: edge costs as columns, the flow solver a task an interferogram."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scatterlake.functions.phase import TAU, half_away, half_even, wrap

# Fixed values of the cost format: a cycle in cost units, the marks for masked, unbounded and unshelved edges.
CYCLE, MASKED, UNBOUNDED, NO_SHELF = 200, 32000, 32000, -32000


def edge_cost(sigsq: Column, offset: Column, dzmax: Column, laycost: Column, flow: Column, cycle: int = CYCLE) -> Column:
    """Integer cost of a flow: quadratic up to the shelf at laycost, a flatter quadratic beyond dzmax."""
    s = F.greatest(sigsq.cast("long"), F.lit(1))
    far = F.when(laycost == NO_SHELF, UNBOUNDED).otherwise(F.greatest(dzmax, F.lit(0))).cast("long")
    dz = F.abs(flow.cast("long") * cycle + offset.cast("long"))
    whole = lambda a, b: F.floor(a / b).cast("long")  # noqa: E731  both sides are non-negative
    near = whole(dz * dz, s)
    shelf = F.when((laycost != NO_SHELF) & (near > laycost), laycost.cast("long")).otherwise(near)
    beyond = whole((dz - far) * (dz - far), 2 * s) + laycost.cast("long")
    return F.when(sigsq == MASKED, F.lit(0).cast("long")).when(dz > far, beyond).otherwise(shelf)


def increments(sigsq: Column, offset: Column, dzmax: Column, laycost: Column, flow: Column, nflow: int) -> tuple[Column, Column]:
    """Cost of nflow more and of nflow less, over nflow squared, rounded up and cut to +-32000."""
    base = edge_cost(sigsq, offset, dzmax, laycost, flow)
    out = []
    for step in (nflow, -nflow):
        raw = edge_cost(sigsq, offset, dzmax, laycost, flow + step) - base
        scaled = F.when(raw >= 0, F.ceil(raw / (nflow * nflow))).otherwise(F.floor(raw / (nflow * nflow)))
        out.append(F.greatest(F.least(scaled.cast("long"), F.lit(32000)), F.lit(-32000)).cast("int"))
    return out[0], out[1]


def tree_weight(plus: Column, minus: Column) -> Column:
    return F.greatest(F.least(F.least(plus, minus), F.lit(1000)), F.lit(1)).cast("int")


def wanted_cycles(before: Column, after: Column) -> Column:
    """Cycles to add along an edge so that its phase step is the wrapped one."""
    return (before + wrap(after - before) - after) / TAU


def variances(noise: DataFrame, steps: DataFrame) -> DataFrame:
    """(edge_id, sigsq): squared std of noise in cycles, by how often the raster uses the edge, as an integer from 1 to 32767; null where it isn't finite."""
    var = noise.groupBy("edge_id").agg(F.pow(F.coalesce(F.stddev_samp("noise"), F.lit(0.0)) / TAU, 2).alias("var"))
    used = steps.where("signed is not null and signed != 0").groupBy(F.abs("signed").alias("edge_id")).agg(F.count("*").alias("uses"))
    raw = half_even(F.col("var") * CYCLE * CYCLE / 100 * F.coalesce("uses", F.lit(0)))
    good = F.col("var").isNotNull() & ~F.isnan("var")
    return var.join(used, "edge_id", "left").select("edge_id", F.coalesce("uses", F.lit(0).cast("long")).alias("uses"), F.when(good, F.greatest(F.least(raw, F.lit(32767.0)), F.lit(1.0))).cast("int").alias("sigsq"))


def offsets(steps: DataFrame) -> DataFrame:
    """Cost offset of each step (before, after, smooth, sign): wrapped step minus the smooth one, in cost units."""
    away = wrap(F.col("after") - F.col("before")) - F.col("smooth")
    return steps.withColumn("offset", half_even(away * F.col("sign") * CYCLE / TAU).cast("int"))


def residues(deltas: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Loop sums top + right - bottom - left of rounded cycle steps (keys, row, col, right, down) per 2 x 2 cells."""
    k = keys or []
    d = deltas.select(*k, "row", "col", half_away(F.col("right")).alias("r"), half_away(F.col("down")).alias("d"))
    below = d.select(*k, (F.col("row") - 1).alias("row"), "col", F.col("r").alias("bottom"))
    beside = d.select(*k, "row", (F.col("col") - 1).alias("col"), F.col("d").alias("beside"))
    joined = d.join(below, [*k, "row", "col"]).join(beside, [*k, "row", "col"])
    return joined.select(*k, "row", "col", F.coalesce(F.col("r") + F.col("beside") - F.col("bottom") - F.col("d"), F.lit(0.0)).cast("int").alias("residue"))


def neighbour_msd(cells: DataFrame, value: str = "uw", keys: list[str] | None = None) -> DataFrame:
    """Mean squared non-zero difference between neighbouring cells (keys, row, col)."""
    k = keys or []
    v = cells.where(F.col(value) != 0).select(*k, "row", "col", F.col(value).alias("v"))
    right, below = v.select(*k, "row", (F.col("col") - 1).alias("col"), F.col("v").alias("w")), v.select(*k, (F.col("row") - 1).alias("row"), "col", F.col("v").alias("w"))
    pairs = v.join(right, [*k, "row", "col"]).unionByName(v.join(below, [*k, "row", "col"]))
    return pairs.groupBy(*k).agg(F.avg(F.when(F.col("v") != F.col("w"), F.pow(F.col("v") - F.col("w"), 2))).alias("msd"))


class Field:
    """One wrapped grid with edge costs: right edges (rows x cols-1) and down edges (rows-1 x cols)."""

    def __init__(self, phase: np.ndarray, right: np.ndarray, down: np.ndarray):
        self.phase, self.costs = phase, (right.astype(np.int64), down.astype(np.int64))
        there = phase != 0
        self.there = (there[:, 1:] & there[:, :-1] & (right[..., 3] != 0), there[1:] & there[:-1] & (down[..., 3] != 0))
        step = lambda a, b: np.floor(np.abs((a + (np.mod(b - a + np.pi, TAU) - np.pi) - b) / TAU) + 0.5) * np.sign(a + (np.mod(b - a + np.pi, TAU) - np.pi) - b)
        self.delta = [np.where(self.there[0], step(phase[:, :-1], phase[:, 1:]), 0).astype(int), np.where(self.there[1], step(phase[:-1], phase[1:]), 0).astype(int)]
        self.extra = [np.zeros_like(self.delta[0]), np.zeros_like(self.delta[1])]

    def cost(self, side: int, at, extra: int) -> int:
        """Cost of ``extra`` cycles over the rounded step on one edge; the flow of down edges counts the other way."""
        if not self.there[side][at]:
            return 0
        offset, sigsq, dzmax, lay = (int(x) for x in self.costs[side][at])
        if sigsq == MASKED:
            return 0
        sigsq = max(1, sigsq)
        dz = abs((extra if side == 0 else -extra) * CYCLE + offset)
        far = UNBOUNDED if lay == NO_SHELF else max(0, dzmax)
        if dz > far:
            return (dz - far) ** 2 // (2 * sigsq) + lay
        near = dz * dz // sigsq
        return near if lay == NO_SHELF else min(near, lay)

    def total(self) -> int:
        return sum(self.cost(s, at, int(self.extra[s][at])) for s in (0, 1) for at in np.ndindex(self.extra[s].shape))

    def loops(self) -> np.ndarray:
        r, d = (self.delta[s] + self.extra[s] for s in (0, 1))
        return r[:-1] + d[:, 1:] - r[1:] - d[:, :-1]


def _edge_costs(field: Field, side: int, extra: np.ndarray) -> np.ndarray:
    """Cost of ``extra`` cycles on every edge of one side, as field.cost() has it."""
    offset, sigsq, dzmax, lay = (field.costs[side][..., k] for k in range(4))
    dz = np.abs((extra if side == 0 else -extra) * CYCLE + offset)
    s = np.maximum(1, sigsq)
    far = np.where(lay == NO_SHELF, UNBOUNDED, np.maximum(0, dzmax))
    near = dz * dz // s
    near = np.where(lay == NO_SHELF, near, np.minimum(near, lay))
    out = np.where(dz > far, (dz - far) ** 2 // (2 * s) + lay, near)
    return np.where((sigsq == MASKED) | ~field.there[side], 0, out)


def solve_flow(field: Field, reach: int = 3) -> None:
    """Integer flow without residues: each edge starts at its own cheapest flow, then residues are discharged one unit
    at a time along shortest paths of reduced costs.

    With convex edge costs every step keeps the flow optimal for what is discharged so far, so the
    result is a minimum-cost flow; costs with a shelf are not convex, and there it is a heuristic.
    A search ends at the nearest opposite residue or the outside, so it stays local.
    """
    rows, cols = field.phase.shape
    if rows < 2 or cols < 2:
        return
    for side in (0, 1):
        trials = np.stack([_edge_costs(field, side, np.full_like(field.extra[side], k)) for k in (0, *(s * k for k in range(1, reach + 1) for s in (1, -1)))])
        best = trials.argmin(axis=0)
        field.extra[side] = np.where(best == 0, 0, np.where(best % 2 == 1, (best + 1) // 2, -(best // 2)))
    width, height = cols - 1, rows - 1
    ground, base = width * height, rows * width
    plus, minus = ([int(v) for s in (0, 1) for v in (_edge_costs(field, s, field.extra[s] + u) - _edge_costs(field, s, field.extra[s])).ravel()] for u in (1, -1))
    charge = [int(v) for v in field.loops().ravel()] + [0]
    level = [0] * (ground + 1)

    def beside(n: int):
        """(other loop, edge, unit that a flow from n to it puts on the edge)."""
        i, j = divmod(n, width)
        yield (n - width if i else ground), i * width + j, -1
        yield (n + width if i + 1 < height else ground), (i + 1) * width + j, 1
        yield (n - 1 if j else ground), base + i * cols + j, 1
        yield (n + 1 if j + 1 < width else ground), base + i * cols + j + 1, -1

    def discharge(start: int, way: int) -> None:
        """One unit from a positive loop (way 1), or to a negative one (way -1)."""
        far, came, settled = {start: 0}, {start: None}, {}
        heap = [(0, start)]
        goal = None
        while heap:
            d, n = heapq.heappop(heap)
            if n in settled:
                continue
            settled[n] = d
            if n == ground or charge[n] * way < 0:
                goal = n
                break
            for m, e, unit in beside(n):
                if m in settled:
                    continue
                step = unit if way > 0 else -unit
                cost = (plus[e] if step > 0 else minus[e]) + (level[n] - level[m]) * way
                new = d + (cost if cost > 0 else 0)
                if new < far.get(m, math.inf):
                    far[m], came[m] = new, (n, e, step)
                    heapq.heappush(heap, (new, m))
        if goal is None:
            raise RuntimeError("a residue can't be discharged")
        top = settled[goal]
        for n, d in settled.items():
            level[n] += (d - top) * way
        charge[start] -= way
        if goal != ground:
            charge[goal] += way
        while came[goal] is not None:
            goal, e, step = came[goal]
            side, at = (0, divmod(e, width)) if e < base else (1, divmod(e - base, cols))
            field.extra[side][at] += step
            k = int(field.extra[side][at])
            now = field.cost(side, at, k)
            plus[e], minus[e] = field.cost(side, at, k + 1) - now, field.cost(side, at, k - 1) - now

    for n in range(ground):
        while charge[n] > 0:
            discharge(n, 1)
    for n in range(ground):
        while charge[n] < 0:
            discharge(n, -1)


def labels_of(field: Field) -> np.ndarray:
    """Cycles of every cell by growing along the cheapest edges; each component starts at 0."""
    rows, cols = field.phase.shape
    label, seen = np.zeros((rows, cols), int), field.phase == 0
    weight = [1.0 / np.maximum(1, np.abs(c[..., 1])) if c.size else np.zeros(c.shape[:2]) for c in field.costs]
    for start in zip(*np.nonzero(~seen), strict=True):
        if seen[start]:
            continue
        heap = [(0.0, int(start[0]), int(start[1]), 0)]
        while heap:
            _, i, j, value = heapq.heappop(heap)
            if seen[i, j]:
                continue
            seen[i, j], label[i, j] = True, value
            for a, b, side, at, way in ((i, j + 1, 0, (i, j), 1), (i, j - 1, 0, (i, j - 1), -1), (i + 1, j, 1, (i, j), 1), (i - 1, j, 1, (i - 1, j), -1)):
                if 0 <= a < rows and 0 <= b < cols and not seen[a, b] and field.there[side][at]:
                    heapq.heappush(heap, (float(-weight[side][at]), a, b, value + way * int(field.delta[side][at] + field.extra[side][at])))
    return label


def refine_labels(field: Field, label: np.ndarray, sweeps: int = 32) -> np.ndarray:
    """Local descent: a cell moves by one or two cycles while its edges get cheaper."""
    rows, cols = label.shape
    for _ in range(sweeps):
        moved = False
        for i, j in zip(*np.nonzero(field.phase), strict=True):
            near = [(s, at, w, label[a, b]) for a, b, s, at, w in ((i, j + 1, 0, (i, j), 1), (i, j - 1, 0, (i, j - 1), -1), (i + 1, j, 1, (i, j), 1), (i - 1, j, 1, (i - 1, j), -1)) if 0 <= a < rows and 0 <= b < cols and field.there[s][at]]
            energy = lambda v: sum(field.cost(s, at, w * int(o - v) - int(field.delta[s][at])) for s, at, w, o in near)  # noqa: B023, E731
            best = min((int(label[i, j]) + d for d in (0, 1, -1, 2, -2)), key=energy)
            if energy(best) < energy(int(label[i, j])):
                label[i, j], moved = best, True
        if not moved:
            break
    return label


def unwrap_grid(phase: np.ndarray, right: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Unwrapped grid: congruent to the input modulo 2 pi, zero where it is zero."""
    field = Field(phase, right, down)
    solve_flow(field)
    label = labels_of(field)
    if any((c[..., 3] != NO_SHELF)[t].any() for c, t in zip(field.costs, field.there, strict=True)):
        label = refine_labels(field, label)  # without shelves the flow is already at its least cost
    return np.where(phase != 0, phase + TAU * label, 0.0)


def default_costs(rows: int, cols: int, sigsq: int = 100) -> tuple[np.ndarray, np.ndarray]:
    make = lambda r, c: np.tile(np.array([0, sigsq, UNBOUNDED, NO_SHELF], np.int16), (r, c, 1))
    return make(rows, max(0, cols - 1)), make(max(0, rows - 1), cols)


def unwrap(cells: DataFrame, sigsq: int = 100) -> DataFrame:
    """(patch_id, ifg_ix, gi, gj, uw) of (patch_id, ifg_ix, gi, gj, ph): each patch and date is one independent task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["gi"].to_numpy() - p["gi"].min(), p["gj"].to_numpy() - p["gj"].min()
        grid = np.zeros((i.max() + 1, j.max() + 1))
        grid[i, j] = p["ph"]
        out = unwrap_grid(grid, *default_costs(*grid.shape, sigsq))
        return p[["patch_id", "ifg_ix", "gi", "gj"]].assign(uw=out[i, j])

    return cells.groupBy("patch_id", "ifg_ix").applyInPandas(run, "patch_id int, ifg_ix long, gi int, gj int, uw double")
