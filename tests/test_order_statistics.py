"""Exact order statistics, whose work is cut into stretches, against sorted lists."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterlake.operators import diagnostics, grid
from scatterlake.plans import catalog

ODD = [math.nan, math.nan, math.inf, -math.inf, -0.0, 0.0, 5e-324, -1e308, 1e308]


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "ps_id long, v double")


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("accuracy", [3, 10_000])
def test_ranks_are_exact_whatever_the_cuts(spark, few, accuracy):
    rng = np.random.default_rng(9)
    plain = [*rng.normal(0, 5, 700).tolist(), *[0.0] * 400, *[2.5] * 300, *ODD]
    want = sorted(plain, key=lambda x: (math.isnan(x), x))
    ranks = [0, 1, 9, 350, 351, 700, 900, 1000, 1300, len(plain) - 3, len(plain) - 2, len(plain) - 1]
    got = grid.at_ranks(frame(spark, [*plain, None, None]), "v", len(plain), ranks, few, accuracy)
    assert sorted(got) == ranks
    assert all(got[r] == want[r] or (math.isnan(got[r]) and math.isnan(want[r])) for r in ranks)


def test_a_rank_out_of_reach_is_an_error(spark):
    with pytest.raises(ValueError):
        grid.at_ranks(frame(spark, [1.0, 2.0, None]), "v", 3, [2])


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0], [1.0, 1.0, 4.0, None], [1.0, 2.0, 3.0, 4.0, 5.0, 1e9], [1.0, 2.0, 3.0, math.nan], [0.0] * 9 + [7.0]])
def test_outliers_equal_sql_on_small_and_odd_columns(spark, values):
    con = duckdb.connect()
    con.execute("create table t (ps_id bigint, v double)")
    if values:
        con.executemany("insert into t values (?, ?)", list(enumerate(values)))
    q = "select quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 from t"
    want = con.execute(f"select ps_id from t, ({q}) where v between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) order by ps_id").fetchall()
    kept = diagnostics.without_outliers(frame(spark, values), "v")
    assert kept.columns == ["ps_id", "v"]
    assert [tuple(r) for r in kept.select("ps_id").orderBy("ps_id").collect()] == want


def test_no_buffer_holds_every_value(spark, monkeypatch, tmp_path):
    """percentile keeps a map of all distinct values in one task's heap, however large the table."""
    n = 300_000
    table = spark.range(n).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (F.col("id") * 7919 % n + 0.5).alias("l_extendedprice"), F.when(F.col("id") % 1000 == 0, 9.0).otherwise(1.0).alias("l_discount"))
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(F, "percentile", lambda *_: pytest.fail("exact percentile in one buffer"))
    out = catalog.QUERIES["f19_iqr"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert tuple(out.agg(F.count("*"), F.sum("l_orderkey")).first()) == con.execute(f"select count(*), sum(l_orderkey) from ({catalog.ORACLE['f19_iqr']})").fetchone()
