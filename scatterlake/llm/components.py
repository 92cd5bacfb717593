"""Connected components by alternating large-star and small-star steps.

Each step aggregates with map-side combine. The aggregate is dealt out once more, so
that both sides of the join on the vertex are plain exchanges, of which the adaptive
plan splits a hub's edges over several tasks; every round ends in a checkpoint in the
shared folder. A graph of at most ``SOLO`` edges, counted, is solved by one task instead,
with the same result. Defined results: loops and rows with a null end are dropped, repeated
edges count once, an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.llm.tables import BROADCAST_ROWS, checkpoint, partitions

ROUNDS = 40
#: Edges that one task may hold, a few MB.
SOLO = BROADCAST_ROWS


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _solve(batches):
    """Components of all edges of one task: labels go down to the least neighbour's and jump to their own label's."""
    ends = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for b in batches if b.num_rows]
    if not ends:
        return
    node, place = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    u, v = place.reshape(2, -1)
    label = np.arange(len(node))
    while True:
        least = label.copy()
        np.minimum.at(least, label[u], label[v])
        np.minimum.at(least, label[v], label[u])
        least = least[label]
        while not np.array_equal(least, least[least]):
            least = least[least]
        if np.array_equal(least, label):
            break
        label = least
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], names=["node", "component"])


def _least(edges: DataFrame, least) -> DataFrame:
    """The edges with the least neighbour m of their u."""
    return edges.join(edges.groupBy("u").agg(least.alias("m")).repartition(partitions(edges), "u", "m"), "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the least node it is connected with."""
    a, b = edges.columns[:2]
    now = checkpoint(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct())
    before = None
    for _ in range(ROUNDS):
        mark = _mark(now)
        if mark[0] <= SOLO:
            return now.coalesce(1).mapInArrow(_solve, "node long, component long")
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both, F.least(F.min("v"), F.first("u"))).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("v"))
        small = _least(large, F.min("v")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.unionByName(least).distinct())
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
