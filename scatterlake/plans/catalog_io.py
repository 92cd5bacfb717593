"""Formats and run-time helpers as queries: bytes are made and read back in the tasks, over driver tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from scatterlake.operators import series, spectral, weed
from scatterlake.plans import fixtures as X
from scatterlake.plans.catalog import EDGE, edge, long, q, query, r, table_of
from scatterlake.plans.config import Params
from scatterlake.plans.fixtures import IFGS
from scatterlake.plans.store import fingerprint
from scatterlake.sources import mat


@query("s3_mat_values", f"SELECT n_nationkey::BIGINT AS n_nationkey, c_custkey, {q('c_acctbal', 're')}, {q('-c_acctbal', 'im')} FROM customer JOIN nation ON n_nationkey = c_nationkey", False)
def s3(spark, sf):
    """Each nation's balances as a complex column of a compressed file, decoded into long rows."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("c_custkey")
        data = mat.dumps({"key": p[["c_custkey"]].to_numpy(), "z": (p[["c_acctbal"]].to_numpy() * (1 - 1j))})
        back = mat.loads(data)
        return pd.DataFrame({"n": p["c_nationkey"].iloc[0], "c": back["key"].ravel(), "re": back["z"].real.ravel(), "im": back["z"].imag.ravel()})

    out = table_of(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(run, "n int, c long, re double, im double")
    return out.select(long("n", "n_nationkey"), F.col("c").alias("c_custkey"), r("re"), r("im"))


@query("s5_memory_order", "SELECT i AS pos, (i % 20) * 5 + i // 20 AS source FROM range(100) t(i)", False)
def s5(spark, sf):
    flat = mat.row_to_column(np.arange(100), 20, 5)
    assert mat.column_to_row(flat, 20, 5).tolist() == list(range(100))
    return spark.createDataFrame([(k, int(v)) for k, v in enumerate(flat)], "pos long, source long")


@query("s6_raw_rasters", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS re, round(embedding[2]::DOUBLE, 6) + 0.0 AS im FROM embeddings", False)
def s6(spark, sf):
    """Big-endian complex samples, written and read back a batch at a time."""

    def run(parts):
        for p in parts:
            raw = (p["re"].to_numpy() + 1j * p["im"].to_numpy()).astype(">c8").tobytes()
            z = np.frombuffer(raw, ">c8")
            yield pd.DataFrame({"vec_id": p["vec_id"], "re": z.real.astype(float), "im": z.imag.astype(float)})

    e = table_of(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("re"), F.col("embedding")[1].cast("double").alias("im"))
    return e.mapInPandas(run, "vec_id long, re double, im double").select("vec_id", r("re"), r("im"))


@query("f17_deramp_dates", f"SELECT * FROM (SELECT 'all' AS spec, i AS ifg_ix FROM range(1, {IFGS + 1}) t(i) UNION ALL SELECT 'list', i FROM (VALUES (2::BIGINT), (5)) t(i))", False)
def f17(spark, sf):
    rows = [(n, i) for n, v in (("all", "ALL"), ("none", ""), ("list", [5, 2, 0])) for i in series.deramp_dates(Params({"scn_deramp_ifg": v}), IFGS)]
    return spark.createDataFrame(rows, "spec string, ifg_ix long")


SB = EDGE + """, dv AS (SELECT ifg_ix, bperp, 1 / (var_samp(re) + var_samp(im)) AS w FROM ep JOIN ifgs USING (ifg_ix) GROUP BY ifg_ix, bperp),
sl AS (SELECT edge_id, sum(w * bperp * re) / sum(w * bperp * bperp) AS sr, sum(w * bperp * im) / sum(w * bperp * bperp) AS si FROM ep JOIN dv USING (ifg_ix) GROUP BY edge_id),
an AS (SELECT edge_id, atan2(im - si * bperp, re - sr * bperp) AS a FROM ep JOIN dv USING (ifg_ix) JOIN sl USING (edge_id))"""


@query("w6_baseline_free_noise", f"WITH {SB} SELECT edge_id, {q('stddev_samp(a)', 'std')}, {q('max(abs(a))', 'top')} FROM an GROUP BY edge_id")
def w6(spark, sf):
    return weed.baseline_free_noise(edge(spark, sf), X.ifgs(spark)).select("edge_id", r("std"), r("top"))


@query("h6_wrap_filter_with_low_pass")
def h6(spark, sf):
    """Filtered and low-passed phase of one plane of gridded series."""
    e = table_of(spark, sf, "embeddings").select(F.lit(0).alias("plane"), "vec_id", (10.0 * F.col("embedding")[0].cast("double")).alias("a"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["vec_id"].to_numpy() // 20, p["vec_id"].to_numpy() % 20
        grid = np.zeros((int(i.max()) + 1, 20), complex)
        grid[i, j] = np.exp(1j * p["a"])
        out, low = spectral.goldstein(grid, 8, 0.8, low_pass=True)
        return pd.DataFrame({"vec_id": p["vec_id"], "filtered": np.angle(out[i, j]), "low": np.angle(low[i, j])})

    return e.groupBy("plane").applyInPandas(run, "vec_id long, filtered double, low double")


@query("x29_fingerprints", "SELECT true AS order_free, true AS content_bound", False)
def x29(spark, sf):
    s = table_of(spark, sf, "supplier")
    same = fingerprint(s) == fingerprint(s.orderBy(F.desc("s_acctbal")).repartition(3))
    return spark.createDataFrame([(same, fingerprint(s) != fingerprint(s.where("s_suppkey > 1")))], "order_free boolean, content_bound boolean")
