"""A stack of series projected from the driver's tables, once as DataFrames and once as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.functions.phase import wrap

IFGS, MASTER = 64, 6


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ifgs(spark: SparkSession) -> DataFrame:
    """64 dates about 12 days apart, baselines, the 6th the master."""
    rows = [(i, 12.0 * i + i % 3, float(i * 37 % 101 - 50), i == MASTER, 20.0 + i) for i in range(1, IFGS + 1)]
    return spark.createDataFrame(rows, "ifg_ix long, day double, bperp double, is_master boolean, std_deg double")


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("ps_id"),
        (F.col("label") + 1).cast("int").alias("patch_id"),
        F.col("vec_id").alias("v"),
        *[e(k).alias(f"e{k}") for k in range(6)],
    )
    row, col = F.floor(F.col("v") / 25), F.col("v") % 25
    placed = rows.withColumns({"row": row.cast("int"), "col": col.cast("int"), "x": F.round(col * 37.0 + 5 * F.col("e0"), 3), "y": F.round(row * 41.0 + 5 * F.col("e1"), 3)})
    return placed.select(
        "ps_id", "patch_id", "row", "col", "x", "y",
        F.round(12.0 + F.col("x") / 90000, 9).alias("lon"), F.round(45.0 + F.col("y") / 111000, 9).alias("lat"),
        (100 * F.col("e2")).alias("height"), (0.2 + F.abs("e3")).alias("d_a"), F.least(F.lit(0.99), 3.0 * F.abs("e4")).alias("coh"),
    )


def angles(spark: SparkSession, sf: str) -> DataFrame:
    """(ps_id, ifg_ix, angle) long: wrapped ten times the components."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ps_id"), F.posexplode(F.slice("embedding", 1, IFGS)).alias("p", "e"))
    return rows.select("ps_id", (F.col("p") + 1).cast("long").alias("ifg_ix"), wrap(10.0 * F.col("e").cast("double")).alias("angle"))


def phase(spark: SparkSession, sf: str) -> DataFrame:
    return angles(spark, sf).select("ps_id", "ifg_ix", F.cos("angle").alias("re"), F.sin("angle").alias("im"))


def fits(spark: SparkSession, sf: str) -> DataFrame:
    """(ps_id, k, c, coh): stands in for stage 2's result."""
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ps_id"), (0.1 * e(20)).alias("k"), (5.0 * e(21)).alias("c"), F.least(F.lit(0.99), 3.0 * F.abs(e(4))).alias("coh"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each point with the next one and the one 25 on: (edge_id, a, b)."""
    a = table(spark, sf, "embeddings").select(F.col("vec_id").alias("a"))
    b = a.withColumnRenamed("a", "b")
    steps = F.explode(F.array(F.lit(1), F.lit(25)))
    return a.withColumn("s", steps).select((F.col("a") * 100 + F.col("s")).alias("edge_id"), "a", (F.col("a") + F.col("s")).alias("b")).join(b, "b").select("edge_id", "a", "b")


PI = repr(math.pi)
TAU = repr(2 * math.pi)

#: The same projection for DuckDB, as common table expressions that every query here starts with.
SQL = f"""
WITH ifgs AS (SELECT i AS ifg_ix, 12.0::DOUBLE * i + i % 3 AS day, (i * 37 % 101 - 50)::DOUBLE AS bperp, i = {MASTER} AS is_master, 20.0::DOUBLE + i AS std_deg FROM range(1, {IFGS + 1}) t(i)),
points0 AS (SELECT vec_id AS ps_id, (label + 1)::INT AS patch_id, (vec_id // 25)::INT AS "row", (vec_id % 25)::INT AS col,
  round((vec_id % 25) * 37.0::DOUBLE + 5 * embedding[1]::DOUBLE, 3) AS x, round((vec_id // 25) * 41.0::DOUBLE + 5 * embedding[2]::DOUBLE, 3) AS y,
  100 * embedding[3]::DOUBLE AS height, 0.2::DOUBLE + abs(embedding[4]::DOUBLE) AS d_a, least(0.99::DOUBLE, 3.0::DOUBLE * abs(embedding[5]::DOUBLE)) AS coh FROM embeddings),
points AS (SELECT ps_id, patch_id, "row", col, x, y, round(12.0::DOUBLE + x / 90000, 9) AS lon, round(45.0::DOUBLE + y / 111000, 9) AS lat, height, d_a, coh FROM points0),
angles0 AS (SELECT vec_id AS ps_id, ifg_ix, 10.0::DOUBLE * embedding[ifg_ix]::DOUBLE + {PI} AS v FROM embeddings, ifgs),
angles AS MATERIALIZED (SELECT ps_id, ifg_ix, v - {TAU} * floor(v / {TAU}) - {PI} AS angle FROM angles0),
phase AS (SELECT ps_id, ifg_ix, cos(angle) AS re, sin(angle) AS im FROM angles),
fits AS (SELECT vec_id AS ps_id, 0.1::DOUBLE * embedding[21]::DOUBLE AS k, 5.0::DOUBLE * embedding[22]::DOUBLE AS c, least(0.99::DOUBLE, 3.0::DOUBLE * abs(embedding[5]::DOUBLE)) AS coh FROM embeddings),
edges AS (SELECT e.vec_id * 100 + s AS edge_id, e.vec_id AS a, e.vec_id + s AS b FROM embeddings e, (VALUES (1), (25)) t(s) WHERE e.vec_id + s IN (SELECT vec_id FROM embeddings))
"""


def wrap_sql(v: str) -> str:
    return f"(({v}) + {PI} - {TAU} * floor((({v}) + {PI}) / {TAU}) - {PI})"
