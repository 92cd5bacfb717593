"""Edges of dispersion bins once there are enough points for more than one bin."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterlake.operators import fit
from scatterlake.plans import catalog
from scatterlake.plans.fixtures import SQL


def reference(values, few, many, steps):
    """The slice of the published code: every step-th of the sorted values that leaves a whole step behind it, and the last."""
    step = steps[len(values) >= many]
    s = np.sort(values)
    return [0.0, *s[step - 1 : len(s) - step : step].tolist(), float(s[-1])] if len(s) >= few else [0.0, 1.0]


@pytest.mark.parametrize("n", [99, 100, 101, 119, 120, 139, 499, 500, 501, 777])
def test_edges_leave_a_whole_step_behind_them(spark, n):
    values = np.random.default_rng(n).uniform(0.2, 0.9, n)
    rows = spark.createDataFrame([(float(v),) for v in values], "d_a double").union(spark.sql("select cast(null as double)"))
    got = fit.dispersion_bins(rows, 100, 500, (20, 100)).orderBy("edge").collect()
    assert [r["edge"] for r in got] == list(range(len(got)))
    assert [r["d_a"] for r in got] == reference(values, 100, 500, (20, 100))


def test_equal_values_keep_their_edges(spark):
    values = [0.3] * 150 + [0.5] * 50
    got = fit.dispersion_bins(spark.createDataFrame([(v,) for v in values], "d_a double"), 100, 500, (20, 100)).orderBy("edge").collect()
    assert [r["d_a"] for r in got] == reference(np.array(values), 100, 500, (20, 100))


#: What the query's own SQL says for under 10,000 points, and the reference for more.
EDGES = """, c AS (SELECT count(d_a) AS n, CASE WHEN count(d_a) >= 50000 THEN 10000 ELSE 2000 END AS step FROM points),
o AS (SELECT d_a, row_number() OVER (ORDER BY d_a) AS k FROM points WHERE d_a IS NOT NULL)
SELECT 0::BIGINT AS edge, 0.0::DOUBLE AS d_a UNION ALL SELECT 1, 1.0 FROM c WHERE n < 10000
UNION ALL SELECT k // step, d_a FROM o, c WHERE n >= 10000 AND k % step = 0 AND k <= n - step
UNION ALL SELECT n // step, d_a FROM o, c WHERE n >= 10000 AND k = n ORDER BY edge"""


@pytest.mark.parametrize("n", [9_999, 10_256, 51_282])
def test_query_follows_the_points(spark, tmp_path, n):
    ids = spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: ((F.col("id") * 7919 + k * 31) % 104729 / 104729 - 0.5).cast("float")).alias("embedding"), (F.col("id") % 10).cast("int").alias("label"))
    ids.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(SQL + EDGES).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["a9_dispersion_bins"](spark, str(tmp_path)).orderBy("edge").collect()]
    assert got == want
    if n < 10_000:
        assert got == con.execute(catalog.ORACLE["a9_dispersion_bins"]).fetchall()
