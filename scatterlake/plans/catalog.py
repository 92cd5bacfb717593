"""Every operator as a query over the driver's tables, with the SQL that must give the same rows.

Results are scalars, floats rounded to ``DIGITS`` places (the two engines add in
different orders); ids and counts are 64-bit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.functions import geometry
from scatterlake.functions import phase as P
from scatterlake.operators import fit, grid, merge, prep, scene, spectral, weed
from scatterlake.plans import fixtures as X
from scatterlake.plans.fixtures import MASTER, PI, SQL, TAU, wrap_sql
from scatterlake.sources import raster

DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, fixture: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            ORACLE[name] = (SQL + (", " + body[5:] if body[:5].upper() == "WITH " else body)) if fixture else body
        return f

    return add


def r(c: str | Column, name: str | None = None) -> Column:
    """Rounded, without negative zeros."""
    c, name = (F.col(c), name or c) if isinstance(c, str) else (c, name)
    return (F.round(c.cast("double"), DIGITS) + 0.0).alias(name)


def q(c: str, name: str | None = None) -> str:
    return f"round(({c})::DOUBLE, {DIGITS}) + 0.0 AS {name or c}"


def long(c: str | Column, name: str | None = None) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").alias(name or c)


# ---------------------------------------------------------------- preparation

AMP = "amp AS (SELECT l_partkey AS pixel, strftime(l_shipdate, '%Y%m') AS acq, l_extendedprice AS amp FROM lineitem), factors AS (SELECT acq, avg(amp) FILTER (amp > 0.001) AS factor FROM amp GROUP BY acq)"
DA = AMP + ", pix AS (SELECT pixel, count(*) AS n, sum(amp / factor) AS total, sum(amp / factor * (amp / factor)) AS squares, bool_or(amp / factor <= 5e-5) AS low FROM amp JOIN factors USING (acq) GROUP BY pixel), da AS (SELECT pixel, sqrt(greatest(n * squares / (total * total) - 1, 0)) AS d_a, total, low FROM pix)"


def amplitudes(spark, sf):
    return X.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("pixel"), F.date_format("l_shipdate", "yyyyMM").alias("acq"), F.col("l_extendedprice").alias("amp"))


@query("a1_calibration", f"WITH {AMP} SELECT acq, {q('factor')} FROM factors", False)
def a1(spark, sf):
    return prep.calibration(amplitudes(spark, sf)).select("acq", r("factor"))


@query("a2_amplitude_dispersion", f"WITH {DA} SELECT pixel, {q('d_a')}, {q('total')}, low FROM da", False)
def a2(spark, sf):
    a = amplitudes(spark, sf)
    return prep.dispersion(a, prep.calibration(a)).select("pixel", r("d_a"), r("total"), "low")


@query("f1_candidates", f"WITH {DA} SELECT pixel, {q('d_a')}, {q('total')} FROM da WHERE NOT low AND total > 0 AND d_a < 0.4", False)
def f1(spark, sf):
    a = amplitudes(spark, sf)
    return prep.candidates(prep.dispersion(a, prep.calibration(a))).select("pixel", r("d_a"), r("total"))


@query("f2_valid_points", "SELECT ps_id FROM points WHERE ps_id % 7 <> 3")
def f2(spark, sf):
    bad = F.when((F.col("ps_id") % 7 == 3) & (F.col("ifg_ix") == 4), F.lit(float("nan"))).otherwise(F.col("re"))
    return prep.valid_points(X.points(spark, sf), X.phase(spark, sf).withColumn("re", bad)).select("ps_id")


@query("f3_select_rows", f"SELECT ps_id, {q('x')}, {q('y')} FROM points WHERE ps_id IN (SELECT ps_id FROM fits WHERE coh > 0.3)")
def f3(spark, sf):
    return X.points(spark, sf).join(X.fits(spark, sf).where("coh > 0.3").select("ps_id"), "ps_id", "left_semi").select("ps_id", r("x"), r("y"))


@query("f4_select_columns", f"SELECT ps_id, ifg_ix, {q('re')} FROM phase WHERE ifg_ix IN (2, 5, 7)")
def f4(spark, sf):
    picked = F.explode(F.transform(F.array(*[F.lit(i) for i in (2, 5, 7)]), lambda i: F.struct(i.cast("bigint").alias("ifg_ix"), F.element_at("s", i).alias("v"))))
    wide = fit.wide(X.phase(spark, sf), X.ifgs(spark)).select("ps_id", F.col("re").alias("s"))
    return wide.select("ps_id", picked.alias("p")).select("ps_id", "p.ifg_ix", r(F.col("p.v"), "re"))


@query("f5_crop", 'SELECT ps_id, ("row" - 2)::BIGINT AS "row", (col - 4)::BIGINT AS col FROM points WHERE "row" BETWEEN 3 AND 9 AND col BETWEEN 5 AND 14')
def f5(spark, sf):
    return prep.crop(X.points(spark, sf), (3, 9), (5, 14)).select("ps_id", long("row"), long("col"))


PATCHES = 'ranges AS (SELECT 25 AS size, 3 AS n, \'c\' AS axis UNION ALL SELECT (SELECT max("row") + 1 FROM points), 4, \'r\'), own AS (SELECT axis, size, k, size * k // n + 1 AS o0, size * (k + 1) // n AS o1 FROM ranges, range(4) t(k) WHERE k < n), ax AS (SELECT axis, k, greatest(1, o0 - 2) AS l, least(size, o1 + 2) AS h, o0, o1 FROM own), patches AS (SELECT (c.k * 4 + r.k + 1)::INT AS patch, c.l AS c0, c.h AS c1, r.l AS r0, r.h AS r1, c.o0 AS oc0, c.o1 AS oc1, r.o0 AS or0, r.o1 AS or1 FROM ax c, ax r WHERE c.axis = \'c\' AND r.axis = \'r\')'


def last_row(spark, sf) -> int:
    """Rows of the grid that the points fill, so that every point lies in a patch."""
    return (X.points(spark, sf).agg(F.max("row")).first()[0] or 0) + 1


@query("x9_patch_grid", f"WITH {PATCHES} SELECT patch::BIGINT AS patch_id, c0::BIGINT AS c0, c1::BIGINT AS c1, r0::BIGINT AS r0, r1::BIGINT AS r1 FROM patches")
def x9(spark, sf):
    return prep.patches(spark, 25, last_row(spark, sf), 3, 4, 2).select(*[long(c) for c in ("patch_id", "c0", "c1", "r0", "r1")])


INSIDE = 'points.col + 1 BETWEEN c0 AND c1 AND "row" + 1 BETWEEN r0 AND r1'
OWN = '(points.col + 1 BETWEEN oc0 AND oc1 AND "row" + 1 BETWEEN or0 AND or1)'


def in_patches(spark, sf):
    p = X.points(spark, sf).withColumns({"row": F.col("row") + 1, "col": F.col("col") + 1}).drop("patch_id")
    return prep.in_patches(p, prep.patches(spark, 25, last_row(spark, sf), 3, 4, 2))


@query("f6_patch_membership", f"WITH {PATCHES} SELECT ps_id, patch::BIGINT AS patch_id FROM points JOIN patches ON {INSIDE}")
def f6(spark, sf):
    return in_patches(spark, sf).select("ps_id", long("patch_id"))


@query("f20_patch_ownership", f"WITH {PATCHES} SELECT ps_id, patch::BIGINT AS patch_id, {OWN} AS owned FROM points JOIN patches ON {INSIDE}")
def f20(spark, sf):
    return in_patches(spark, sf).select("ps_id", long("patch_id"), "owned")


@query("u1_patch_union", f"WITH {PATCHES}, m AS (SELECT ps_id, patch, {OWN} AS owned FROM points JOIN patches ON {INSIDE}) SELECT ps_id, (CASE WHEN max(patch) FILTER (owned) IS NOT NULL THEN max(patch) FILTER (owned) ELSE min(patch) END)::BIGINT AS patch_id FROM m GROUP BY ps_id")
def u1(spark, sf):
    return merge.owned(in_patches(spark, sf)).select("ps_id", long("patch_id"))


@query("w13_chronology", f"SELECT ifg_ix, {q('day')}, {q('bperp')}, is_master FROM (SELECT row_number() OVER (ORDER BY day) AS ifg_ix, day, CASE WHEN is_master THEN 0 ELSE bperp END AS bperp, is_master FROM ifgs)")
def w13(spark, sf):
    d = X.ifgs(spark)
    dates = d.where("not is_master").select(F.col("ifg_ix").alias("acq"), "day", "bperp")
    master = d.where("is_master").first()["day"]
    table, _ = prep.chronology(X.phase(spark, sf).withColumnRenamed("ifg_ix", "acq"), dates, master)
    return table.select(long("ifg_ix"), r("day"), r("bperp"), "is_master")


@query("j17_insert_master", f"SELECT ps_id, ifg_ix, {q('CASE WHEN is_master THEN 1 ELSE re END', 're')}, {q('CASE WHEN is_master THEN 0 ELSE im END', 'im')} FROM phase JOIN ifgs USING (ifg_ix)")
def j17(spark, sf):
    d = X.ifgs(spark)
    dates = d.where("not is_master").select(F.col("ifg_ix").alias("acq"), "day", "bperp")
    _, full = prep.chronology(X.phase(spark, sf).withColumnRenamed("ifg_ix", "acq"), dates, d.where("is_master").first()["day"])
    return full.select("ps_id", long("ifg_ix"), r("re"), r("im"))


@query("w14_renumber", "SELECT ps_id, row_number() OVER (PARTITION BY patch_id ORDER BY y::FLOAT, x::FLOAT, ps_id) AS sort_ix FROM points")
def w14(spark, sf):
    return prep.renumber(X.points(spark, sf)).select("ps_id", "sort_ix")


@query("t1_spatial_order", "SELECT ps_id, row_number() OVER (ORDER BY y::FLOAT, x::FLOAT, ps_id) AS scene_id FROM points")
def t1(spark, sf):
    return merge.scene_ids(X.points(spark, sf)).select("ps_id", long("scene_id"))


@query("f7_without_master", f"SELECT ps_id, ifg_ix, {q('re')} FROM phase WHERE ifg_ix <> {MASTER}")
def f7(spark, sf):
    return X.phase(spark, sf).join(F.broadcast(X.ifgs(spark).where("not is_master").select("ifg_ix")), "ifg_ix", "left_semi").select("ps_id", "ifg_ix", r("re"))


@query("f8_dropped_dates", "SELECT ifg_ix, row_number() OVER (ORDER BY ifg_ix) AS position FROM ifgs WHERE ifg_ix NOT IN (3, 9)")
def f8(spark, sf):
    return prep.without(X.ifgs(spark), spark.createDataFrame([(3,), (9,)], "ifg_ix long")).select("ifg_ix", "position")


@query("f9_date_sets", f"SELECT ifg_ix, ifg_ix <> {MASTER} AS solve FROM ifgs WHERE ifg_ix NOT IN (3, 9)")
def f9(spark, sf):
    return prep.without(X.ifgs(spark), spark.createDataFrame([(3,), (9,)], "ifg_ix long")).select("ifg_ix", (~F.col("is_master")).alias("solve"))


@query("f10_date_pairs", f"SELECT m.ifg_ix AS master_ix, s.ifg_ix AS slave_ix, {q('s.day - m.day', 'days')} FROM ifgs s, ifgs m WHERE m.is_master AND NOT s.is_master")
def f10(spark, sf):
    m = X.ifgs(spark).where("is_master").select(F.col("ifg_ix").alias("master_ix"), F.col("day").alias("d0"))
    return X.ifgs(spark).where("not is_master").crossJoin(F.broadcast(m)).select("master_ix", F.col("ifg_ix").alias("slave_ix"), r(F.col("day") - F.col("d0"), "days"))


@query("f11_complete_series", "SELECT ps_id FROM points WHERE ps_id % 5 <> 1")
def f11(spark, sf):
    zero = (F.col("ps_id") % 5 == 1) & (F.col("ifg_ix") == 2)
    p = X.phase(spark, sf).withColumns({c: F.when(zero, 0.0).otherwise(F.col(c)) for c in ("re", "im")})
    return p.groupBy("ps_id").agg(F.bool_or(P.is_zero(P.cpx("re", "im"))).alias("z")).where("not z").select("ps_id")


@query("f16_drop_lists", "SELECT ifg_ix FROM (VALUES (2::BIGINT), (5), (9)) t(ifg_ix)")
def f16(spark, sf):
    a, b = (spark.createDataFrame([(i,) for i in s], "ifg_ix long") for s in ((2, 5), (5, 9)))
    return a.union(b).distinct()


@query("u2_index_difference", "SELECT ps_id FROM fits EXCEPT SELECT ps_id FROM fits WHERE coh > 0.3")
def u2(spark, sf):
    f = X.fits(spark, sf).select("ps_id", "coh")
    return f.join(f.where("coh > 0.3").select("ps_id"), "ps_id", "left_anti").select("ps_id")


@query("u3_index_intersection", "SELECT ps_id FROM fits WHERE coh > 0.3 INTERSECT SELECT ps_id FROM points WHERE d_a < 0.3")
def u3(spark, sf):
    return X.fits(spark, sf).where("coh > 0.3").select("ps_id").join(X.points(spark, sf).where("d_a < 0.3").select("ps_id"), "ps_id", "left_semi")


@query("u4_unique_indices", "SELECT DISTINCT b AS ps_id FROM edges")
def u4(spark, sf):
    return X.edges(spark, sf).select(F.col("b").alias("ps_id")).distinct()


@query("u5_unique_edges", "SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM edges")
def u5(spark, sf):
    e = X.edges(spark, sf)
    both = e.select("a", "b").union(e.select("b", "a"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---------------------------------------------------------------- scalar functions


@query("x1_wrap", f"SELECT ps_id, ifg_ix, {q(wrap_sql('3.7 * angle + 1'), 'w')} FROM angles")
def x1(spark, sf):
    return X.angles(spark, sf).select("ps_id", "ifg_ix", r(P.wrap(3.7 * F.col("angle") + 1), "w"))


@query("x2_complex_arithmetic", f"SELECT edge_id, p.ifg_ix, {q('q.re * p.re + q.im * p.im', 're')}, {q('q.im * p.re - q.re * p.im', 'im')}, {q('sqrt(p.re * p.re + p.im * p.im)', 'size')} FROM edges JOIN phase p ON p.ps_id = a JOIN phase q ON q.ps_id = b AND q.ifg_ix = p.ifg_ix")
def x2(spark, sf):
    p = X.phase(spark, sf)
    e = weed.edge_phase(X.edges(spark, sf), p).withColumnRenamed("re", "zr").withColumnRenamed("im", "zi")
    size = p.select(F.col("ps_id").alias("a"), "ifg_ix", P.norm(P.cpx("re", "im")).alias("size"))
    return e.join(size, ["a", "ifg_ix"]).select("edge_id", "ifg_ix", r("zr", "re"), r("zi", "im"), r("size"))


@query("x3_normalise", f"SELECT ps_id, ifg_ix, {q('re', 're')}, {q('im', 'im')}, {q('(ps_id % 3)::DOUBLE + CASE WHEN ps_id % 3 = 0 THEN 1 ELSE 0 END', 'amp')} FROM (SELECT ps_id, ifg_ix, CASE WHEN ps_id % 3 = 0 THEN 0 ELSE re END AS re, CASE WHEN ps_id % 3 = 0 THEN 0 ELSE im END AS im FROM phase)")
def x3(spark, sf):
    z = X.phase(spark, sf).withColumns({c: F.col(c) * (F.col("ps_id") % 3) for c in ("re", "im")})
    u = P.unit(P.cpx("re", "im"))
    return z.select("ps_id", "ifg_ix", r(u.re, "re"), r(u.im, "im"), r(P.amplitude(P.cpx("re", "im")), "amp"))


@query("x4_weighted_phase", f"SELECT ps_id, ifg_ix, {q('coh * cos(angle - k * bperp)', 're')}, {q('coh * sin(angle - k * bperp)', 'im')} FROM angles JOIN fits USING (ps_id) JOIN ifgs USING (ifg_ix)")
def x4(spark, sf):
    j = X.phase(spark, sf).join(X.fits(spark, sf), "ps_id").join(F.broadcast(X.ifgs(spark)), "ifg_ix")
    z = P.detrend(P.cpx("re", "im"), F.col("k"), F.col("bperp"), F.col("coh"))
    return j.select("ps_id", "ifg_ix", r(z.re, "re"), r(z.im, "im"))


@query("x5_datenum", "SELECT o_orderkey, (date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 367)::DOUBLE AS day FROM orders", False)
def x5(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", geometry.datenum(F.col("o_orderdate").cast("date")).alias("day"))


@query("x31_from_datenum", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders", False)
def x31(spark, sf):
    day = F.col("o_orderdate").cast("date")
    whole = F.date_format(day, "yyyyMMdd").cast("int")
    back = geometry.from_datenum(geometry.datenum(geometry.from_yyyymmdd(whole)))
    return X.table(spark, sf, "orders").select("o_orderkey", F.date_format(back, "yyyyMMdd").alias("day"))


_E2 = geometry.WGS84_E**2
_ARC = lambda p: f"6378137.0::DOUBLE * ({1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256!r} * {p} - {3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024!r} * sin(2 * {p}) + {15 * _E2**2 / 256 + 45 * _E2**3 / 1024!r} * sin(4 * {p}) - {35 * _E2**3 / 3072!r} * sin(6 * {p}))"
XY = f"b AS (SELECT radians((min(lon) + max(lon)) / 2) AS l0, radians((min(lat) + max(lat)) / 2) AS p0 FROM points), g AS (SELECT ps_id, radians(lat) AS p, radians(lon) - l0 AS d, p0, 6378137.0::DOUBLE / sqrt(1 - {_E2!r} * sin(radians(lat)) * sin(radians(lat))) AS n FROM points, b), xy AS (SELECT ps_id, n / tan(p) * sin(d * sin(p)) AS lx, {_ARC('p')} - {_ARC('p0')} + n / tan(p) * (1 - cos(d * sin(p))) AS ly FROM g)"


@query("x6_local_xy", f"WITH {XY} SELECT ps_id, round(lx, 4) + 0.0 AS x, round(ly, 4) + 0.0 AS y FROM xy")
def x6(spark, sf):
    return geometry.local_xy(X.points(spark, sf).select("ps_id", "lon", "lat")).select("ps_id", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query("x7_millimetres", f"SELECT ps_id, {q('round((x + 0.0003)::FLOAT * 1000::FLOAT) / 1000', 'x')} FROM points")
def x7(spark, sf):
    return X.points(spark, sf).select("ps_id", r(geometry.millimetres(F.col("x") + 0.0003), "x"))


@query("x10_baseline", f"SELECT ifg_ix, {q('(bperp + 0.1 * day) * cos(0.4) - (2 * bperp - 0.2 * day) * sin(0.4)', 'b')} FROM ifgs")
def x10(spark, sf):
    d = F.col("bperp")
    return X.ifgs(spark).select("ifg_ix", r(geometry.perpendicular_baseline(d, 2 * d, F.lit(0.1), F.lit(-0.2), F.col("day"), F.lit(0.4)), "b"))


@query("x11_look_angle", f"SELECT ps_id, {q('acos(greatest(least((7070000.0::DOUBLE * 7070000.0 - 6371000.0::DOUBLE * 6371000.0 - (830000 + 5 * x) * (830000 + 5 * x)) / (2 * 6371000.0::DOUBLE * (830000 + 5 * x)), 1), -1))', 'look')} FROM points")
def x11(spark, sf):
    return X.points(spark, sf).select("ps_id", r(geometry.look_angle(830000 + 5 * F.col("x"), F.lit(6371000.0), F.lit(7070000.0)), "look"))


@query("x12_trial_wraps", f"SELECT {q(f'(max(bperp) - min(bperp)) * 20 / (0.0555 * 830000 * sin(radians(21)) / (4 * {PI})) / {TAU}', 'wraps')} FROM ifgs")
def x12(spark, sf):
    span = F.max("bperp") - F.min("bperp")
    return X.ifgs(spark).agg(r(span * geometry.trial_wraps(1.0, 0.0555), "wraps"))


@query("x14_gaussian_kernel", f"SELECT i::BIGINT AS i, j::BIGINT AS j, {q('exp(-0.5 * power(2.5 * (i - 3) / 3.0, 2)) * exp(-0.5 * power(2.5 * (j - 3) / 3.0, 2))', 'w')} FROM range(7) a(i), range(7) b(j)", False)
def x14(spark, sf):
    k = spectral.gaussian_kernel()
    return spark.createDataFrame([(i, j, round(float(k[i, j]), DIGITS)) for i in range(7) for j in range(7)], "i long, j long, w double")


@query("x34_wrapped_difference", f"SELECT edge_id, p.ifg_ix, {q(f'abs(p.angle - q.angle + {PI} - {TAU} * floor((p.angle - q.angle + {PI}) / {TAU}) - {PI})', 'd')} FROM edges JOIN angles p ON p.ps_id = a JOIN angles q ON q.ps_id = b AND q.ifg_ix = p.ifg_ix")
def x34(spark, sf):
    a = X.angles(spark, sf)
    j = X.edges(spark, sf).join(a.select(F.col("ps_id").alias("a"), "ifg_ix", F.col("angle").alias("p")), "a").join(a.select(F.col("ps_id").alias("b"), "ifg_ix", F.col("angle").alias("w")), ["b", "ifg_ix"])
    return j.select("edge_id", "ifg_ix", r(P.wrapped_difference(F.col("p"), F.col("w")), "d"))


@query("x33_text_flags", "SELECT event_id, lower(trim(event_type)) AS flag, CASE WHEN lower(trim(event_type)) IN ('click', 'view') THEN 'y' ELSE 'n' END AS yes FROM events", False)
def x33(spark, sf):
    t = F.lower(F.trim("event_type"))
    return X.table(spark, sf, "events").select("event_id", t.alias("flag"), F.when(t.isin("click", "view"), "y").otherwise("n").alias("yes"))


@query("s11_date_pair", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS first, strftime(o_orderdate + INTERVAL 12 DAY, '%Y%m%d') AS second FROM orders", False)
def s11(spark, sf):
    o = X.table(spark, sf, "orders")
    name = F.concat(F.lit("diff0/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 12), "yyyyMMdd"), F.lit(".diff"))
    a, b = raster.date_pair(name)
    return o.select("o_orderkey", a.alias("first"), b.alias("second"))


@query("s12_named_values", "SELECT s_suppkey, round(s_acctbal, 2) AS v0, s_nationkey::DOUBLE AS v1 FROM supplier", False)
def s12(spark, sf):
    s = X.table(spark, sf, "supplier")
    text = F.concat(F.lit("title: x\ninitial_baseline(TCN): "), F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(" m\nother: 7"))
    v = raster.named_values(text, "initial_baseline(TCN)")
    return s.select("s_suppkey", v[0].alias("v0"), v[1].alias("v1"))


@query("s18_parameter_layers", "SELECT n_nationkey::BIGINT AS n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 1.5 END, CASE WHEN n_nationkey % 2 = 0 THEN 2.5 END, 9.0)::DOUBLE AS value FROM nation", False)
def s18(spark, sf):
    n = F.col("n_nationkey")
    return X.table(spark, sf, "nation").select(long("n_nationkey"), F.coalesce(F.when(n % 3 == 0, 1.5), F.when(n % 2 == 0, 2.5), F.lit(9.0)).alias("value"))


@query("s15_upsert_params", "SELECT name, value FROM (VALUES ('heading', -168.5::DOUBLE), ('lambda', 0.0555), ('other', 3.0)) t(name, value)", False)
def s15(spark, sf):
    old, new = spark.createDataFrame([("heading", 1.0), ("other", 3.0)], "name string, value double"), spark.createDataFrame([("heading", -168.5), ("lambda", 0.0555)], "name string, value double")
    return old.join(new, "name", "left_anti").unionByName(new)


# ---------------------------------------------------------------- grids, joins

GRID = lambda size, nudge: f"cell0 AS (SELECT *, ceil(((y::FLOAT - (min(y) OVER w)::FLOAT)::FLOAT + {nudge}::FLOAT)::FLOAT / {size}::FLOAT)::INT AS i, ceil(((x::FLOAT - (min(x) OVER w)::FLOAT)::FLOAT + {nudge}::FLOAT)::FLOAT / {size}::FLOAT)::INT AS j FROM points WINDOW w AS (PARTITION BY patch_id)), cells AS (SELECT ps_id, patch_id, x, y, coh, greatest(CASE WHEN i = max(i) OVER w THEN i - 1 ELSE i END, 1) - 1 AS gi, greatest(CASE WHEN j = max(j) OVER w THEN j - 1 ELSE j END, 1) - 1 AS gj FROM cell0 WINDOW w AS (PARTITION BY patch_id))"
G50, G200 = GRID(50, 1e-6), GRID(200, 1e-3)
ACC = G200 + ", acc AS (SELECT patch_id, gi, gj, ifg_ix, sum(re) AS re, sum(im) AS im FROM phase JOIN cells USING (ps_id) GROUP BY ALL)"


@query("x8_grid_cells", f"WITH {G50} SELECT ps_id, gi::BIGINT AS gi, gj::BIGINT AS gj FROM cells")
def x8(spark, sf):
    return grid.cells(X.points(spark, sf), 50.0).select("ps_id", long("gi"), long("gj"))


@query("a3_weighted_grid", f"WITH {G50} SELECT patch_id::BIGINT AS patch_id, gi::BIGINT AS gi, gj::BIGINT AS gj, ifg_ix, {q('sum(re * coh)', 're')}, {q('sum(im * coh)', 'im')} FROM phase JOIN cells USING (ps_id) GROUP BY ALL")
def a3(spark, sf):
    return grid.accumulate(X.phase(spark, sf), grid.cells(X.points(spark, sf), 50.0), "coh").select(long("patch_id"), long("gi"), long("gj"), "ifg_ix", r("re"), r("im"))


@query("a4_grid_sums", f"WITH {ACC} SELECT patch_id::BIGINT AS patch_id, gi::BIGINT AS gi, gj::BIGINT AS gj, ifg_ix, {q('re')}, {q('im')} FROM acc")
def a4(spark, sf):
    return grid.accumulate(X.phase(spark, sf), grid.cells(X.points(spark, sf), 200.0, 1e-3)).select(long("patch_id"), long("gi"), long("gj"), "ifg_ix", r("re"), r("im"))


@query("j3_cell_phase", f"WITH {ACC} SELECT ps_id, ifg_ix, {q('re / sqrt(re * re + im * im)', 're')}, {q('im / sqrt(re * re + im * im)', 'im')} FROM cells JOIN acc USING (patch_id, gi, gj)")
def j3(spark, sf):
    placed = grid.cells(X.points(spark, sf), 200.0, 1e-3)
    return grid.at_points(grid.accumulate(X.phase(spark, sf), placed), placed).select("ps_id", "ifg_ix", r("re"), r("im"))


@query("j4_restore_points", f"WITH {ACC}, uw AS (SELECT patch_id, gi, gj, ifg_ix, atan2(im, re) + {TAU} * (gi % 3) AS uw FROM acc WHERE gj % 4 <> 1) SELECT ps_id, ifg_ix, {q('uw + atan2(im * cos(uw) - re * sin(uw), re * cos(uw) + im * sin(uw))', 'ph_uw')} FROM phase JOIN cells USING (ps_id) LEFT JOIN uw USING (patch_id, gi, gj, ifg_ix)")
def j4(spark, sf):
    placed, p = grid.cells(X.points(spark, sf), 200.0, 1e-3), X.phase(spark, sf)
    uw = grid.accumulate(p, placed).where("gj % 4 != 1").select("patch_id", "gi", "gj", "ifg_ix", (F.atan2("im", "re") + P.TAU * (F.col("gi") % 3)).alias("uw"))
    return grid.restore(p, placed, uw).select("ps_id", "ifg_ix", r("ph_uw"))


@query("a5_histogram", f"SELECT b::BIGINT AS bin, {q('(b + 0.5) * 0.01', 'center')}, count(coh) AS n FROM range(100) t(b) LEFT JOIN fits ON greatest(least(ceil(round(coh / 0.01, 9)) - 1, 99), 0) = b GROUP BY b")
def a5(spark, sf):
    return fit.coherence_histogram(X.fits(spark, sf)).select(long("bin"), r("center"), long("n"))


@query("a11_patch_area", f"SELECT patch_id::BIGINT AS patch_id, {q('CASE WHEN (max(x) - min(x)) * (max(y) - min(y)) > 0 THEN (max(x) - min(x)) * (max(y) - min(y)) / 1e6 ELSE 1 END', 'km2')} FROM points GROUP BY patch_id")
def a11(spark, sf):
    return grid.area(X.points(spark, sf)).select(long("patch_id"), r("km2"))


@query("j1_align_rows", f"SELECT ps_id, ifg_ix, {q('x')}, {q('k')}, {q('re')} FROM points JOIN fits USING (ps_id) JOIN phase USING (ps_id)")
def j1(spark, sf):
    return X.phase(spark, sf).join(X.points(spark, sf).select("ps_id", "x"), "ps_id").join(X.fits(spark, sf).select("ps_id", "k"), "ps_id").select("ps_id", "ifg_ix", r("x"), r("k"), r("re"))


@query("j2_gather_selected", f"SELECT ps_id, {q('k')}, {q('x')} FROM points JOIN fits USING (ps_id) WHERE fits.coh > 0.4")
def j2(spark, sf):
    return X.points(spark, sf).drop("coh").join(X.fits(spark, sf).where("coh > 0.4"), "ps_id").select("ps_id", r("k"), r("x"))


NEAR = "known AS (SELECT ps_id AS known_id, x AS kx, y AS ky FROM points WHERE d_a < 0.24), ask AS (SELECT ps_id AS query_id, x AS qx, y AS qy FROM points), best AS (SELECT query_id, known_id, power(qx - kx, 2) + power(qy - ky, 2) AS d2 FROM ask, known QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, known_id) = 1)"


def nearest(spark, sf):
    p = X.points(spark, sf)
    known = p.where("d_a < 0.24").select(F.col("ps_id").alias("known_id"), F.col("x").alias("kx"), F.col("y").alias("ky"))
    return grid.nearest(p.select(F.col("ps_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy")), known, 80.0)


@query("j6_nearest", f"WITH {NEAR} SELECT query_id, known_id, {q('d2')} FROM best")
def j6(spark, sf):
    return nearest(spark, sf).select("query_id", "known_id", r("d2"))


@query("j5_nearest_gather", f"WITH {NEAR} SELECT query_id, ifg_ix, {q('re')} FROM best JOIN phase ON ps_id = known_id")
def j5(spark, sf):
    return nearest(spark, sf).join(X.phase(spark, sf).withColumnRenamed("ps_id", "known_id"), "known_id").select("query_id", "ifg_ix", r("re"))


@query("j7_radius_pairs", f"SELECT p.ps_id AS a, s.ps_id AS b, {q('power(p.x - s.x, 2) + power(p.y - s.y, 2)', 'd2')} FROM points p JOIN points s ON abs(p.x - s.x) < 120 AND abs(p.y - s.y) < 120 AND power(p.x - s.x, 2) + power(p.y - s.y, 2) < 14400")
def j7(spark, sf):
    return grid.within(X.points(spark, sf), 120.0).select("a", "b", r("d2"))


LOW = "pair AS (SELECT p.ps_id AS a, s.ps_id AS b, exp(-(power(p.x - s.x, 2) + power(p.y - s.y, 2)) / (2 * 30.0::DOUBLE * 30.0)) AS w FROM points p JOIN points s ON abs(p.x - s.x) < 120 AND abs(p.y - s.y) < 120 AND power(p.x - s.x, 2) + power(p.y - s.y, 2) < 14400)"


@query("h23_gaussian_low_pass", f"WITH {LOW} SELECT a AS ps_id, ifg_ix, {q('sum(w * angle) / sum(w)', 'low')} FROM pair JOIN angles ON ps_id = b GROUP BY a, ifg_ix")
def h23(spark, sf):
    return scene.low_pass(X.angles(spark, sf).withColumnRenamed("angle", "high"), X.points(spark, sf), 30.0).select("ps_id", "ifg_ix", r("low"))


RASTER = 'ras AS (SELECT "row", col, (ps_id // 3) % 40 AS id FROM points), ed AS (SELECT DISTINCT least(p.id, n.id) AS a, greatest(p.id, n.id) AS b FROM ras p JOIN ras n ON (n."row" = p."row" AND n.col = p.col + 1) OR (n."row" = p."row" + 1 AND n.col = p.col) WHERE p.id <> n.id)'


def ras(spark, sf):
    return X.points(spark, sf).select("row", "col", (F.floor(F.col("ps_id") / 3) % 40).cast("bigint").alias("id"))


@query("j12_raster_edges", f"WITH {RASTER} SELECT a, b FROM ed")
def j12(spark, sf):
    return grid.raster_edges(ras(spark, sf))


@query("j13_signed_edges", f'WITH {RASTER} SELECT p.id AS p, n.id AS q, CASE WHEN p.id = n.id THEN 0 WHEN p.id < n.id THEN a * 1000 + b ELSE -(a * 1000 + b) END AS signed FROM ras p JOIN ras n ON n."row" = p."row" AND n.col = p.col + 1 LEFT JOIN ed ON a = least(p.id, n.id) AND b = greatest(p.id, n.id)')
def j13(spark, sf):
    s = ras(spark, sf)
    steps = s.select("row", "col", F.col("id").alias("p")).join(s.select("row", (F.col("col") - 1).alias("col"), F.col("id").alias("q")), ["row", "col"])
    return grid.signed_edges(steps, grid.raster_edges(s).withColumn("edge_id", F.col("a") * 1000 + F.col("b"))).select("p", "q", F.col("signed").cast("bigint").alias("signed"))


EDGE = "ep AS (SELECT edge_id, a, b, p.ifg_ix, q.re * p.re + q.im * p.im AS re, q.im * p.re - q.re * p.im AS im FROM edges JOIN phase p ON p.ps_id = a JOIN phase q ON q.ps_id = b AND q.ifg_ix = p.ifg_ix), ang AS (SELECT edge_id, a, b, ifg_ix, atan2(im, re) AS angle FROM ep), noise AS (SELECT *, angle - avg(angle) OVER (PARTITION BY edge_id) AS noise FROM ang), sp AS (SELECT edge_id, a, b, stddev_samp(noise) AS std, max(abs(noise)) AS top FROM noise GROUP BY ALL)"


def edge(spark, sf):
    return weed.edge_phase(X.edges(spark, sf), X.phase(spark, sf))


@query("j8_edge_phase", f"WITH {EDGE} SELECT edge_id, ifg_ix, {q('re')}, {q('im')} FROM ep")
def j8(spark, sf):
    return edge(spark, sf).select("edge_id", "ifg_ix", r("re"), r("im"))


@query("j9_edge_phasors", f"WITH {EDGE} SELECT edge_id, ifg_ix, {q('re / sqrt(re * re + im * im)', 're')} FROM ep")
def j9(spark, sf):
    return weed.edge_phase(X.edges(spark, sf), X.phase(spark, sf), True).select("edge_id", "ifg_ix", r("re"))


@query("a33_edge_noise", f"WITH {EDGE} SELECT edge_id, ifg_ix, {q('noise')} FROM noise")
def a33(spark, sf):
    return weed.centred_angles(edge(spark, sf)).select("edge_id", "ifg_ix", r("noise"))


@query("a13_date_variance", f"WITH {EDGE} SELECT ifg_ix, {q('var_samp(re)', 'var_re')}, {q('var_samp(re) + var_samp(im)', 'var')} FROM ep GROUP BY ifg_ix")
def a13(spark, sf):
    return weed.date_variance(edge(spark, sf)).select("ifg_ix", r("var_re"), r("var"))


@query("a14_edge_spread", f"WITH {EDGE} SELECT edge_id, {q('std')}, {q('top')} FROM sp")
def a14(spark, sf):
    return weed.spread(weed.centred_angles(edge(spark, sf))).select("edge_id", r("std"), r("top"))


POINT = EDGE + ", ends AS (SELECT a AS ps_id, std, top FROM sp UNION ALL SELECT b, std, top FROM sp), pn AS (SELECT p.ps_id, height, min(std) AS ps_std, min(top) AS ps_max FROM points p LEFT JOIN ends USING (ps_id) GROUP BY ALL)"


def point_noise(spark, sf):
    return weed.point_noise(X.points(spark, sf), weed.spread(weed.centred_angles(edge(spark, sf))))


@query("a15_point_minimum", f"WITH {POINT} SELECT ps_id, {q('ps_std')}, {q('ps_max')} FROM pn")
def a15(spark, sf):
    return point_noise(spark, sf).select("ps_id", r("ps_std"), r("ps_max"))


@query("f14_weed_mask", f"WITH {POINT} SELECT ps_id, ps_std < 1.5 AND ps_max < 3.0 AND height >= 1e-6 AS keep FROM pn")
def f14(spark, sf):
    return weed.weeded(point_noise(spark, sf), 1.5, 3.0, 0.0).select("ps_id", "keep")


@query("a24_duplicates", "SELECT min(ps_id) AS ps_id FROM (SELECT *, max(coh) OVER (PARTITION BY ps_id % 90) AS best FROM points) WHERE coh = best GROUP BY ps_id % 90")
def a24(spark, sf):
    return weed.best_of(X.points(spark, sf).withColumn("place", F.col("ps_id") % 90), ["place"]).select("ps_id")


@query("a25_distinct_places", f"SELECT ps_id, {q('lon')}, {q('lat')} FROM points QUALIFY row_number() OVER (PARTITION BY lon, lat ORDER BY coh DESC, ps_id) = 1")
def a25(spark, sf):
    return merge.distinct_places(X.points(spark, sf)).select("ps_id", r("lon"), r("lat"))


@query("x17_phase_correction", f"SELECT ps_id, ifg_ix, {q('cos(CASE WHEN is_master THEN c ELSE angle - k * bperp END)', 're')}, {q('sin(CASE WHEN is_master THEN c ELSE angle - k * bperp END)', 'im')} FROM angles JOIN fits USING (ps_id) JOIN ifgs USING (ifg_ix)")
def x17(spark, sf):
    return weed.corrected(X.phase(spark, sf), X.fits(spark, sf), X.ifgs(spark)).select("ps_id", "ifg_ix", r("re"), r("im"))


@query("x15_corrected_phase", f"SELECT ps_id, ifg_ix, {q('cos(angle - k * bperp - c)', 're')}, {q('sin(angle - k * bperp - c)', 'im')} FROM angles JOIN fits USING (ps_id) JOIN ifgs USING (ifg_ix)")
def x15(spark, sf):
    return merge.corrected_phase(X.phase(spark, sf), X.fits(spark, sf), X.ifgs(spark)).select("ps_id", "ifg_ix", r("re"), r("im"))


@query("x16_rereferenced_phase", f"SELECT ps_id, ifg_ix, {q('cos(CASE WHEN is_master THEN 0 ELSE angle END + c)', 're')}, {q('sin(CASE WHEN is_master THEN 0 ELSE angle END + c)', 'im')} FROM angles JOIN fits USING (ps_id) JOIN ifgs USING (ifg_ix)")
def x16(spark, sf):
    return merge.rereferenced(X.phase(spark, sf), X.fits(spark, sf), X.ifgs(spark)).select("ps_id", "ifg_ix", r("re"), r("im"))


@query("x18_phase_to_unwrap", f"SELECT ps_id, ifg_ix, {q('cos(angle + k * bperp - o)', 're')}, {q('o', '\"offset\"')} FROM (SELECT ps_id, ifg_ix, angle, k, bperp, CASE WHEN is_master THEN 0 ELSE 2 * k * bperp + c / 2 END AS o FROM angles JOIN fits USING (ps_id) JOIN ifgs USING (ifg_ix))")
def x18(spark, sf):
    f = X.fits(spark, sf)
    return merge.to_unwrap(X.phase(spark, sf), f, X.ifgs(spark), f.select("ps_id", (2 * F.col("k")).alias("k"), (F.col("c") / 2).alias("c"))).select("ps_id", "ifg_ix", r("re"), r("offset"))


@query("a12_date_deviation", f"SELECT ifg_ix, {q(f'sqrt(avg(w * w)) * 180 / {PI}', 'std_deg')} FROM (SELECT ifg_ix, {wrap_sql('angle - 0.3 - k * bperp - c')} AS w FROM angles JOIN fits USING (ps_id) JOIN ifgs USING (ifg_ix)) GROUP BY ifg_ix")
def a12(spark, sf):
    p = X.phase(spark, sf)
    patch = p.select("ps_id", "ifg_ix", F.lit(math.cos(0.3)).alias("re"), F.lit(math.sin(0.3)).alias("im"))
    return merge.date_deviation(p, patch, X.fits(spark, sf), X.ifgs(spark)).select("ifg_ix", r("std_deg"))


table_of = X.table

from scatterlake.plans import catalog_io, catalog_scene  # noqa: E402, F401  their queries register themselves here
