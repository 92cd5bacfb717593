"""The rest of the catalog: fits and selection, time series, scene terms, unwrapping, verification, diagnostics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.functions import phase as P
from scatterlake.operators import diagnostics, fit, grid, scene, series, spacetime, spectral, unwrap, verify, weed
from scatterlake.plans import fixtures as X
from scatterlake.plans.catalog import _ARC, _E2, EDGE, LOW, edge, long, q, query, r, table_of
from scatterlake.plans.fixtures import IFGS, MASTER, PI, TAU, wrap_sql

# ---------------------------------------------------------------- fits and selection

WRAPS = 1.0
_TRIALS = math.ceil(8 * WRAPS)
H1 = f"""span AS (SELECT max(bperp) - min(bperp) AS s FROM ifgs),
tr AS (SELECT ps_id, t, sum(cos(angle - bperp / s * {PI} / 4 * t)) AS re, sum(sin(angle - bperp / s * {PI} / 4 * t)) AS im FROM angles JOIN ifgs USING (ifg_ix), span, range({-_TRIALS}, {_TRIALS + 1}) x(t) GROUP BY ps_id, t),
best AS (SELECT ps_id, {PI} / 4 / s * arg_max(t, struct_pack(a := round(sqrt(re * re + im * im), 9), b := t)) AS k0 FROM tr, span GROUP BY ps_id, s),
off AS (SELECT ps_id, k0, atan2(sum(sin(angle - k0 * bperp)), sum(cos(angle - k0 * bperp))) AS o FROM angles JOIN ifgs USING (ifg_ix) JOIN best USING (ps_id) GROUP BY ps_id, k0),
fine AS (SELECT ps_id, k0 + sum(bperp * {wrap_sql('angle - k0 * bperp - o')}) / sum(bperp * bperp) AS k FROM angles JOIN ifgs USING (ifg_ix) JOIN off USING (ps_id) GROUP BY ps_id, k0),
fitted AS (SELECT ps_id, k, sum(cos(angle - k * bperp)) AS re, sum(sin(angle - k * bperp)) AS im FROM angles JOIN ifgs USING (ifg_ix) JOIN fine USING (ps_id) GROUP BY ps_id, k)"""


@query("h1_topofit", f"WITH {H1} SELECT ps_id, {q('k')}, round(atan2(im, re), 5) + 0.0 AS c, {q(f'sqrt(re * re + im * im) / {IFGS}', 'coh')} FROM fitted")
def h1(spark, sf):
    return fit.topofit(X.phase(spark, sf), X.ifgs(spark), WRAPS).select("ps_id", r("k"), (F.round("c", 5) + 0.0).alias("c"), r("coh"))


@query("t4_trial_peak", f"WITH {H1} SELECT ps_id, {q('max(sqrt(re * re + im * im))', 'peak')} FROM tr GROUP BY ps_id")
def t4(spark, sf):
    """The coherence curve in long form: points x trials x dates, aggregated twice."""
    j = X.angles(spark, sf).join(F.broadcast(X.ifgs(spark).select("ifg_ix", "bperp")), "ifg_ix").withColumn("t", F.explode(F.sequence(F.lit(-_TRIALS), F.lit(_TRIALS))))
    span = X.ifgs(spark).agg((F.max("bperp") - F.min("bperp")).alias("s"))
    turned = F.col("angle") - F.col("bperp") / F.col("s") * (math.pi / 4) * F.col("t")
    sums = j.crossJoin(F.broadcast(span)).groupBy("ps_id", "t").agg(F.sum(F.cos(turned)).alias("re"), F.sum(F.sin(turned)).alias("im"))
    return sums.groupBy("ps_id").agg(r(F.max(F.hypot("re", "im")), "peak"))


@query("a7_signal_noise_weight", f"SELECT ps_id, {q('CASE WHEN s > 0 THEN g / s ELSE 0 END', 'weight')} FROM (SELECT ps_id, avg((1 + ifg_ix % 3) * cos(angle)) AS g, sqrt(greatest(0.5 * (avg((1 + ifg_ix % 3) * (1 + ifg_ix % 3)) - avg((1 + ifg_ix % 3) * cos(angle)) * avg((1 + ifg_ix % 3) * cos(angle))), 0)) AS s FROM angles GROUP BY ps_id)")
def a7(spark, sf):
    return fit.signal_noise_weight(X.angles(spark, sf).withColumn("amp", (1 + F.col("ifg_ix") % 3).cast("double"))).select("ps_id", r("weight"))


@query("a8_coherence_change", f"SELECT {q('sqrt(avg(power(coh - coh * coh, 2)))', 'rms')} FROM fits")
def a8(spark, sf):
    f = X.fits(spark, sf)
    return fit.coherence_change(f, f.withColumn("coh", F.col("coh") * F.col("coh"))).select(r("rms"))


@query("a9_dispersion_bins", "SELECT 0::BIGINT AS edge, 0.0::DOUBLE AS d_a UNION ALL SELECT 1, 1.0")
def a9(spark, sf):
    return fit.dispersion_bins(X.points(spark, sf)).select(long("edge"), "d_a")


TAIL = "obs AS (SELECT b AS bin, count(coh) AS o, 100 - b AS r FROM range(100) t(b) LEFT JOIN fits ON greatest(least(ceil(round(coh / 0.01, 9)) - 1, 99), 0) = b GROUP BY b), sc AS (SELECT *, r * (sum(o) FILTER (bin < 31) OVER () / sum(r) FILTER (bin < 31) OVER ()) AS s FROM obs)"


@query("w10_reverse_tail", f"WITH {TAIL} SELECT bin::BIGINT AS bin, {q('100 * sum(s) OVER w / sum(CASE WHEN o = 0 THEN 1 ELSE o END) OVER w', 'metric')} FROM sc WINDOW w AS (ORDER BY bin DESC)")
def w10(spark, sf):
    random = spark.range(100).select(F.col("id").cast("int").alias("bin"), (100 - F.col("id")).alias("n"))
    return fit.tail(fit.coherence_histogram(X.fits(spark, sf)), random).select(long("bin"), r("metric"))


@query("a10_threshold_line", f"SELECT {q('regr_slope(t, d)', 'slope')}, {q('regr_intercept(t, d)', 'intercept')} FROM (SELECT avg(d_a) AS d, quantile_cont(coh, 0.5) AS t FROM points GROUP BY patch_id)")
def a10_line(spark, sf):
    bins = X.points(spark, sf).groupBy("patch_id").agg(F.avg("d_a").alias("d"), F.median("coh").alias("t"))
    return bins.agg(r(F.regr_slope("t", "d"), "slope"), r(F.regr_intercept("t", "d"), "intercept"))


@query("a10_coherence_threshold")
def a10(spark, sf):
    p = X.points(spark, sf)
    random = fit.random_histogram(np.array([float(i * 37 % 101 - 50) for i in range(1, IFGS + 1)]), WRAPS, 2000)
    slope, intercept = fit.coherence_thresholds(p, fit.dispersion_bins(p), random)
    return spark.createDataFrame([(slope, intercept)], "slope double, intercept double")


@query("f12_initial_selection", f"SELECT ps_id, {q('greatest(0.5::DOUBLE * d_a + 0.05, 0)', 'thresh')} FROM points WHERE coh > greatest(0.5::DOUBLE * d_a + 0.05, 0)")
def f12(spark, sf):
    return fit.selected(X.points(spark, sf), 0.5, 0.05).select("ps_id", r("thresh"))


@query("f13_reestimate", f"SELECT ps_id, coh * 0.9 > greatest(0.2, 0) AND abs(k - (k + 0.03 * c)) < {TAU} / 100 AS keep FROM fits")
def f13(spark, sf):
    f = X.fits(spark, sf)
    again = f.select("ps_id", (F.col("k") + 0.03 * F.col("c")).alias("k"), (F.col("coh") * 0.9).alias("coh"))
    return fit.reestimated(f.withColumn("thresh", F.lit(0.2)), again, 100.0).select("ps_id", "keep")


@query("h8_random_coherence")
def h8(spark, sf):
    n = fit.random_histogram(np.array([float(i * 37 % 101 - 50) for i in range(1, IFGS + 1)]), WRAPS, 5000)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(n)], "bin int, n double")


@query("a6_psquare_weight")
def a6(spark, sf):
    seen = np.array([x["n"] for x in fit.coherence_histogram(X.fits(spark, sf)).orderBy("bin").collect()], float)  # 100 bins
    table = fit.psquare_weights(seen, fit.random_histogram(np.linspace(-50, 50, IFGS), WRAPS, 2000))
    return spark.createDataFrame([(k, float(w)) for k, w in enumerate(table)], "slot int, weight double")


@query("w12_interpolation")
def w12(spark, sf):
    fine = fit.interpolate(np.sin(np.linspace(0, 3, 40)))
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(fine)], "pos int, value double")


# ---------------------------------------------------------------- time series


@query("w1_differences", f"SELECT ps_id, ifg_ix, {q('d')} FROM (SELECT ps_id, ifg_ix, angle - lag(angle) OVER (PARTITION BY ps_id ORDER BY ifg_ix) AS d FROM angles) WHERE d IS NOT NULL")
def w1(spark, sf):
    return series.differences(X.angles(spark, sf), "angle").select("ps_id", "ifg_ix", r("d"))


@query("w1_event_differences", f"SELECT event_id, {q('d')} FROM (SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) WHERE d IS NOT NULL", False)
def w1_events(spark, sf):
    e = table_of(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return series.differences(e, "value", "user_id", "at").select("event_id", r("d"))


WEIGHTS = "pr AS (SELECT t.ifg_ix, s.ifg_ix AS src_ix, -0.5 * power((t.day - s.day) / 40.0, 2) AS e FROM ifgs t, ifgs s WHERE NOT s.is_master), g AS (SELECT ifg_ix, src_ix, exp(e - max(e) OVER (PARTITION BY ifg_ix)) AS g FROM pr), wt AS (SELECT ifg_ix, src_ix, g / sum(g) OVER (PARTITION BY ifg_ix) AS w FROM g)"


@query("w2_temporal_weights", f"WITH {WEIGHTS} SELECT ifg_ix, src_ix, {q('w')} FROM wt")
def w2(spark, sf):
    return series.gaussian_weights(X.ifgs(spark), 40.0).select("ifg_ix", "src_ix", r("w"))


@query("w3_high_pass", f"WITH {WEIGHTS}, low AS (SELECT ps_id, wt.ifg_ix, sum(angle * w) AS low FROM angles JOIN wt ON src_ix = angles.ifg_ix GROUP BY ALL) SELECT ps_id, ifg_ix, {q('angle - low', 'high')} FROM angles JOIN low USING (ps_id, ifg_ix)")
def w3(spark, sf):
    return series.high_pass(X.angles(spark, sf), "angle", series.gaussian_weights(X.ifgs(spark), 40.0)).select("ps_id", "ifg_ix", r("high"))


@query("w4_weights_with_self", f"SELECT t.ifg_ix, s.ifg_ix AS src_ix, {q('exp(-0.5 * power((t.day - s.day) / 730.0, 2)) / sum(exp(-0.5 * power((t.day - s.day) / 730.0, 2))) OVER (PARTITION BY t.ifg_ix)', 'w')} FROM ifgs t, ifgs s")
def w4(spark, sf):
    return series.gaussian_weights(X.ifgs(spark).withColumn("is_master", F.lit(False)), 730.0).select("ifg_ix", "src_ix", r("w"))


@query("w8_close_to_master", f"SELECT ifg_ix, {q('day - m', 'away')} FROM ifgs, (SELECT day AS m FROM ifgs WHERE is_master) WHERE day > m ORDER BY day LIMIT 1")
def w8(spark, sf):
    m = X.ifgs(spark).where("is_master").select(F.col("day").alias("m"))
    later = X.ifgs(spark).crossJoin(F.broadcast(m)).where("day > m")
    return later.agg(F.min_by("ifg_ix", "day").alias("ifg_ix"), r(F.min(F.col("day") - F.col("m")), "away"))


@query("w9_cumulative_phase", f"SELECT ps_id, ifg_ix, {q('sum(angle) OVER (PARTITION BY ps_id ORDER BY ifg_ix)', 'total')} FROM angles")
def w9(spark, sf):
    return series.cumulative(X.angles(spark, sf), "angle").select("ps_id", "ifg_ix", r("total"))


@query("w11_fir", f"SELECT ifg_ix, {q('0.5 * bperp + 0.3 * lag(bperp, 1, 1.0) OVER w + 0.2 * lag(bperp, 2, 1.0) OVER w', 'filtered')} FROM ifgs WINDOW w AS (ORDER BY ifg_ix)")
def w11(spark, sf):
    return series.fir(X.ifgs(spark), "bperp", [0.5, 0.3, 0.2], "ifg_ix").select("ifg_ix", r("filtered"))


@query("t2_chronological_order", "SELECT ifg_ix, row_number() OVER (ORDER BY -bperp, ifg_ix) AS position FROM ifgs")
def t2(spark, sf):
    return X.ifgs(spark).withColumn("position", F.row_number().over(W.orderBy(-F.col("bperp"), "ifg_ix")).cast("bigint")).select("ifg_ix", "position")


@query("t3_median", f"SELECT patch_id::BIGINT AS patch_id, {q('median(x)', 'm')} FROM points GROUP BY patch_id")
def t3(spark, sf):
    return X.points(spark, sf).groupBy("patch_id").agg(r(F.median("x"), "m")).select(long("patch_id"), "m")


_LINE = "sum(1/v) AS s, sum(day/v) AS sx, sum(angle/v) AS sy, sum(day*day/v) AS sxx, sum(day*angle/v) AS sxy"


@query("a28_mean_velocity", f"WITH m AS (SELECT ps_id, {_LINE} FROM (SELECT *, power(std_deg * {PI} / 180, 2) AS v FROM angles JOIN ifgs USING (ifg_ix)) GROUP BY ps_id) SELECT ps_id, {q('(sy - (s * sxy - sx * sy) / (s * sxx - sx * sx) * sx) / s', 'intercept')}, {q('(s * sxy - sx * sy) / (s * sxx - sx * sx)', 'slope')} FROM m")
def a28(spark, sf):
    return series.mean_velocity(X.angles(spark, sf), X.ifgs(spark), "angle").select("ps_id", r("intercept"), r("slope"))


@query("a26_slope_through_origin", f"SELECT ps_id, {q('sum(std_deg * bperp * angle) / sum(std_deg * bperp * bperp)', 'slope')} FROM angles JOIN ifgs USING (ifg_ix) GROUP BY ps_id")
def a26(spark, sf):
    j = X.angles(spark, sf).join(F.broadcast(X.ifgs(spark)), "ifg_ix")
    return j.groupBy("ps_id").agg(r(series.through_origin(F.col("bperp"), F.col("angle"), F.col("std_deg")), "slope"))


@query("a27_exact_weights", f"SELECT ps_id, {q('sum(w * bperp * angle) / sum(w * bperp * bperp)', 'slope')} FROM (SELECT *, CASE WHEN ps_id % 4 = 0 THEN (ifg_ix = 3)::INT ELSE std_deg END AS w FROM angles JOIN ifgs USING (ifg_ix)) GROUP BY ps_id")
def a27(spark, sf):
    j = X.angles(spark, sf).join(F.broadcast(X.ifgs(spark)), "ifg_ix")
    raw = F.when((F.col("ps_id") % 4 == 0) & (F.col("ifg_ix") == 3), float("inf")).otherwise(F.col("std_deg"))
    j = j.withColumn("raw", raw).withColumn("any", F.max(F.col("raw") == float("inf")).over(W.partitionBy("ps_id")))
    return j.groupBy("ps_id").agg(r(series.through_origin(F.col("bperp"), F.col("angle"), series.exact_weights(F.col("raw"), F.col("any"))), "slope"))


@query("a26_user_trends", f"SELECT user_id, {q('regr_intercept(value, n)', 'intercept')}, {q('regr_slope(value, n)', 'slope')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id HAVING count(*) > 1", False)
def a26_users(spark, sf):
    e = table_of(spark, sf, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("double"))
    fitted = series.line(F.col("n"), F.col("value"), F.lit(1.0))
    return e.groupBy("user_id").agg(F.count("*").alias("c"), *[r(v, k) for k, v in fitted.items()]).where("c > 1").drop("c")


@query("a19_shared_design", f"SELECT ps_id, {q('regr_intercept(angle, day)', 'c0')}, {q('regr_slope(angle, day)', 'c1')} FROM angles JOIN ifgs USING (ifg_ix) GROUP BY ps_id")
def a19(spark, sf):
    day = np.array([12.0 * i + i % 3 for i in range(1, IFGS + 1)])
    inverse = series.shared_design(np.column_stack([np.ones(IFGS), day]))
    return series.apply_design(X.angles(spark, sf), "angle", inverse, list(range(1, IFGS + 1)), ["c0", "c1"]).select("ps_id", r("c0"), r("c1"))


# ---------------------------------------------------------------- scene terms

_DAY = np.array([12.0 * i + i % 3 for i in range(1, IFGS + 1)])
_BASE = np.array([float(i * 37 % 101 - 50) for i in range(1, IFGS + 1)])
_W = np.linalg.pinv(np.column_stack([np.ones(IFGS - 1), np.diff(_BASE), np.diff(_DAY)]))[1]
_SEQ = "(VALUES " + ", ".join(f"({i + 2}, {float(w)!r}::DOUBLE)" for i, w in enumerate(_W)) + ") t(ifg_ix, w)"
SCLA = f"""ds AS (SELECT ps_id, ifg_ix, angle - lag(angle) OVER (PARTITION BY ps_id ORDER BY ifg_ix) AS d FROM angles),
kk AS (SELECT ps_id, sum(d * w) AS k FROM ds JOIN {_SEQ} USING (ifg_ix) GROUP BY ps_id),
md AS (SELECT day AS d0 FROM ifgs WHERE is_master),
rs AS (SELECT ps_id, k, angle - k * bperp AS y, day - d0 AS x, power(std_deg * {PI} / 180, -2) AS w FROM angles JOIN kk USING (ps_id) JOIN ifgs USING (ifg_ix), md WHERE NOT is_master),
scla AS (SELECT ps_id, k, (sum(w * x * x) * sum(w * y) - sum(w * x) * sum(w * x * y)) / (sum(w) * sum(w * x * x) - sum(w * x) * sum(w * x)) AS c FROM rs GROUP BY ps_id, k)"""


def angle_phase(spark, sf):
    return X.angles(spark, sf).withColumnRenamed("angle", "ph")


@query("a20_look_angle_error", f"WITH {SCLA} SELECT ps_id, {q('k')}, {q('c')} FROM scla")
def a20(spark, sf):
    return scene.look_angle_error(angle_phase(spark, sf), X.ifgs(spark)).select("ps_id", r("k"), r("c"))


@query("a21_constant_cadence", "SELECT false AS irregular, true AS regular", False)
def a21(spark, sf):
    return spark.createDataFrame([(series.constant_steps(np.diff(_DAY)), series.constant_steps(np.full(9, 12.0)))], "irregular boolean, regular boolean")


ENV = "two AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), sp AS (SELECT two.a AS ps_id, min(k) AS k0, max(k) AS k1, min(c) AS c0, max(c) AS c1 FROM two JOIN fits ON ps_id = b GROUP BY two.a)"


@query("a16_neighbour_envelope", f"WITH {ENV} SELECT ps_id, {q('CASE WHEN k0 IS NULL THEN k ELSE least(greatest(k, k0), k1) END', 'k')}, {q('CASE WHEN c0 IS NULL THEN c ELSE least(greatest(c, c0), c1) END', 'c')} FROM fits LEFT JOIN sp USING (ps_id)")
def a16(spark, sf):
    return scene.neighbour_envelope(X.fits(spark, sf), X.edges(spark, sf)).select("ps_id", r("k"), r("c"))


@query("x19_smoothed_phase", f"SELECT ps_id, ifg_ix, round((k * bperp)::FLOAT::DOUBLE, 5) + 0.0 AS ph_scla FROM fits, ifgs")
def x19(spark, sf):
    return scene.smoothed_phase(X.fits(spark, sf), X.ifgs(spark)).select("ps_id", "ifg_ix", (F.round(F.col("ph_scla").cast("double"), 5) + 0.0).alias("ph_scla"))


REF = "ref AS (SELECT ps_id FROM points WHERE lon > 12.001 AND lon < 12.006 AND lat > 45.0 AND lat < 45.005)"


@query("f15_reference_box", f"WITH {REF} SELECT ps_id FROM ref")
def f15(spark, sf):
    return scene.reference(X.points(spark, sf), (12.001, 12.006), (45.0, 45.005))


CIRCLE = f"gc AS (SELECT ps_id, radians(lat) AS p, radians(lon) - radians(12.004::DOUBLE) AS d, radians(45.003::DOUBLE) AS p0, 6378137.0::DOUBLE / sqrt(1 - {_E2!r} * sin(radians(lat)) * sin(radians(lat))) AS n FROM points), cxy AS (SELECT ps_id, n / tan(p) * sin(d * sin(p)) AS cx, {_ARC('p')} - {_ARC('p0')} + n / tan(p) * (1 - cos(d * sin(p))) AS cy FROM gc)"


@query("f15_reference_radius", f"WITH {CIRCLE} SELECT ps_id FROM cxy WHERE cx * cx + cy * cy <= 40000")
def f15_radius(spark, sf):
    return scene.reference(X.points(spark, sf), centre=(12.004, 45.003), radius=200.0)


@query("a17_centre_to_reference", f"WITH {REF}, m AS (SELECT ifg_ix, avg(angle) AS m FROM angles JOIN ref USING (ps_id) GROUP BY ifg_ix) SELECT ps_id, ifg_ix, {q('angle - m', 'ph')} FROM angles JOIN m USING (ifg_ix)")
def a17(spark, sf):
    return scene.centred(angle_phase(spark, sf), scene.reference(X.points(spark, sf), (12.001, 12.006), (45.0, 45.005))).select("ps_id", "ifg_ix", r("ph"))


PLANE = "pl AS (SELECT ifg_ix, count(*) AS n, avg(x / 1000) AS mx, avg(y / 1000) AS my, avg(angle) AS mv, covar_pop(x / 1000, x / 1000) AS xx, covar_pop(x / 1000, y / 1000) AS xy, covar_pop(y / 1000, y / 1000) AS yy, covar_pop(x / 1000, angle) AS xv, covar_pop(y / 1000, angle) AS yv FROM angles JOIN points USING (ps_id) GROUP BY ifg_ix), pp AS (SELECT ifg_ix, mx, my, mv, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS px, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS py FROM pl)"


@query("a18_deramp", f"WITH {PLANE} SELECT ps_id, ifg_ix, {q('angle - (mv + px * (x / 1000 - mx) + py * (y / 1000 - my))', 'ph')}, {q('mv + px * (x / 1000 - mx) + py * (y / 1000 - my)', 'ramp')} FROM angles JOIN points USING (ps_id) JOIN pp USING (ifg_ix)")
def a18(spark, sf):
    return scene.deramped(angle_phase(spark, sf), X.points(spark, sf)).select("ps_id", "ifg_ix", r("ph"), r("ramp"))


@query("x28_without_terms", f"SELECT ps_id, ifg_ix, round(angle - (k * bperp)::FLOAT::DOUBLE - c, 5) + 0.0 AS ph FROM angles JOIN fits USING (ps_id) JOIN ifgs USING (ifg_ix)")
def x28(spark, sf):
    f = X.fits(spark, sf)
    return scene.without_terms(angle_phase(spark, sf), scene.smoothed_phase(f, X.ifgs(spark)), f).select("ps_id", "ifg_ix", (F.round("ph", 5) + 0.0).alias("ph"))


@query("h24_correlated_noise", f"""WITH {WEIGHTS}, low AS (SELECT ps_id, wt.ifg_ix, sum(angle * w) AS low FROM angles JOIN wt ON src_ix = angles.ifg_ix GROUP BY ALL),
hi AS (SELECT ps_id, ifg_ix, angle - low AS high FROM angles JOIN low USING (ps_id, ifg_ix)), h0 AS (SELECT ifg_ix, high AS h0 FROM hi WHERE ps_id = 0), rel AS (SELECT ps_id, ifg_ix, high - h0 AS v FROM hi JOIN h0 USING (ifg_ix)),
{LOW}, lp AS (SELECT a AS ps_id, ifg_ix, sum(w * v) / sum(w) AS l FROM pair JOIN rel ON ps_id = b GROUP BY a, ifg_ix), l0 AS (SELECT ifg_ix, l AS l0 FROM lp WHERE ps_id = 0)
SELECT ps_id, ifg_ix, {q('CASE WHEN is_master THEN 0 ELSE l - l0 END', 'ph_scn')} FROM lp JOIN l0 USING (ifg_ix) JOIN ifgs USING (ifg_ix)""")
def h24(spark, sf):
    return scene.correlated_noise(angle_phase(spark, sf), X.points(spark, sf), X.ifgs(spark), 40.0, 30.0, 0).select("ps_id", "ifg_ix", r("ph_scn"))


# ---------------------------------------------------------------- unwrapping

COST = lambda f: f"(CASE WHEN sig = 32000 THEN 0 WHEN abs({f} * 200 + off) > far THEN ((abs({f} * 200 + off) - far) * (abs({f} * 200 + off) - far)) // (2 * greatest(sig, 1)) + lay WHEN lay <> -32000 AND (abs({f} * 200 + off) * abs({f} * 200 + off)) // greatest(sig, 1) > lay THEN lay ELSE (abs({f} * 200 + off) * abs({f} * 200 + off)) // greatest(sig, 1) END)"
LI = "li AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 17 = 0 THEN 32000 ELSE l_partkey % 200 + 1 END AS sig, l_suppkey % 150 - 75 AS off, CASE WHEN l_linenumber % 3 = 0 THEN -32000 ELSE 50 + l_linenumber END AS lay, CASE WHEN l_linenumber % 3 = 0 THEN 32000 ELSE 300 END AS far, l_quantity::BIGINT % 5 - 2 AS flow FROM lineitem)"


def cost_edges(spark, sf):
    c = F.col
    return table_of(spark, sf, "lineitem").select(
        "l_orderkey", long("l_linenumber"), F.when(c("l_partkey") % 17 == 0, 32000).otherwise(c("l_partkey") % 200 + 1).alias("sig"), (c("l_suppkey") % 150 - 75).alias("off"),
        F.when(c("l_linenumber") % 3 == 0, -32000).otherwise(50 + c("l_linenumber")).alias("lay"), F.lit(300).alias("dzmax"), (c("l_quantity").cast("bigint") % 5 - 2).alias("flow"),
    )


def cost_of(flow):
    return unwrap.edge_cost(F.col("sig"), F.col("off"), F.col("dzmax"), F.col("lay"), flow)


@query("x20_edge_cost", f"WITH {LI} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {COST('flow')}::BIGINT AS cost FROM li", False)
def x20(spark, sf):
    return cost_edges(spark, sf).select("l_orderkey", "l_linenumber", long(cost_of(F.col("flow")), "cost"))


INC = lambda s, n: f"greatest(least(CASE WHEN {COST(f'(flow + {s})')} - {COST('flow')} >= 0 THEN ceil(({COST(f'(flow + {s})')} - {COST('flow')})::DOUBLE / {n * n}) ELSE floor(({COST(f'(flow + {s})')} - {COST('flow')})::DOUBLE / {n * n}) END, 32000), -32000)::BIGINT"


@query("x21_incremental_cost", f"WITH {LI} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {INC(2, 2)} AS plus, {INC(-2, 2)} AS minus FROM li", False)
def x21(spark, sf):
    plus, minus = unwrap.increments(F.col("sig"), F.col("off"), F.col("dzmax"), F.col("lay"), F.col("flow"), 2)
    return cost_edges(spark, sf).select("l_orderkey", "l_linenumber", long(plus, "plus"), long(minus, "minus"))


@query("x22_label_energy", f"WITH {LI} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, ({COST('(flow + 1)')} - {COST('flow')})::BIGINT AS delta FROM li", False)
def x22(spark, sf):
    return cost_edges(spark, sf).select("l_orderkey", "l_linenumber", long(cost_of(F.col("flow") + 1) - cost_of(F.col("flow")), "delta"))


@query("x23_tree_weight", f"WITH {LI} SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, greatest(least(least({INC(1, 1)}, {INC(-1, 1)}), 1000), 1)::BIGINT AS weight FROM li", False)
def x23(spark, sf):
    plus, minus = unwrap.increments(F.col("sig"), F.col("off"), F.col("dzmax"), F.col("lay"), F.col("flow"), 1)
    return cost_edges(spark, sf).select("l_orderkey", "l_linenumber", long(unwrap.tree_weight(plus, minus), "weight"))


@query("a23_flow_objective", f"WITH {LI} SELECT sum({COST('flow')})::BIGINT AS total FROM li", False)
def a23(spark, sf):
    return cost_edges(spark, sf).agg(long(F.sum(cost_of(F.col("flow"))), "total"))


@query("x25_wanted_cycles", f"SELECT edge_id, p.ifg_ix, {q(f'(3 * p.angle + {wrap_sql('3 * q.angle - 3 * p.angle')} - 3 * q.angle) / {TAU}', 'cycles')} FROM edges JOIN angles p ON p.ps_id = a JOIN angles q ON q.ps_id = b AND q.ifg_ix = p.ifg_ix")
def x25(spark, sf):
    a = X.angles(spark, sf)
    j = X.edges(spark, sf).join(a.select(F.col("ps_id").alias("a"), "ifg_ix", F.col("angle").alias("p")), "a").join(a.select(F.col("ps_id").alias("b"), "ifg_ix", F.col("angle").alias("w")), ["b", "ifg_ix"])
    return j.select("edge_id", "ifg_ix", r(unwrap.wanted_cycles(3 * F.col("p"), 3 * F.col("w")), "cycles"))


LOOP = f'st AS (SELECT p.ifg_ix, p."row", p.col, round((3 * p.v + {wrap_sql("3 * e.v - 3 * p.v")} - 3 * e.v) / {TAU}) AS rt, round((3 * p.v + {wrap_sql("3 * s.v - 3 * p.v")} - 3 * s.v) / {TAU}) AS dn FROM gv p LEFT JOIN gv e ON e.ifg_ix = p.ifg_ix AND e."row" = p."row" AND e.col = p.col + 1 LEFT JOIN gv s ON s.ifg_ix = p.ifg_ix AND s."row" = p."row" + 1 AND s.col = p.col)'
GV = 'gv AS (SELECT ifg_ix, "row", col, angle AS v FROM points JOIN angles USING (ps_id))'


def steps(spark, sf):
    g = X.points(spark, sf).join(X.angles(spark, sf), "ps_id").select("ifg_ix", "row", "col", (3 * F.col("angle")).alias("v"))
    e = g.select("ifg_ix", "row", (F.col("col") - 1).alias("col"), F.col("v").alias("e"))
    s = g.select("ifg_ix", (F.col("row") - 1).alias("row"), "col", F.col("v").alias("s"))
    j = g.join(e, ["ifg_ix", "row", "col"], "left").join(s, ["ifg_ix", "row", "col"], "left")
    return j.select("ifg_ix", "row", "col", unwrap.wanted_cycles(F.col("v"), F.col("e")).alias("right"), unwrap.wanted_cycles(F.col("v"), F.col("s")).alias("down"))


@query("x24_residues", f'WITH {GV}, {LOOP} SELECT a.ifg_ix, a."row"::BIGINT AS "row", a.col::BIGINT AS col, coalesce(a.rt + b.dn - c.rt - a.dn, 0)::BIGINT AS residue FROM st a JOIN st b ON b.ifg_ix = a.ifg_ix AND b."row" = a."row" AND b.col = a.col + 1 JOIN st c ON c.ifg_ix = a.ifg_ix AND c."row" = a."row" + 1 AND c.col = a.col')
def x24(spark, sf):
    return unwrap.residues(steps(spark, sf), ["ifg_ix"]).select("ifg_ix", long("row"), long("col"), long("residue"))


@query("x26_edge_variance", f"WITH {EDGE}, us AS (SELECT edge_id, edge_id % 4 AS uses FROM edges) SELECT edge_id, uses::BIGINT AS uses, greatest(least(round_even(power(stddev_samp(noise) / {TAU}, 2) * 200 * 200 / 100 * uses, 0), 32767), 1)::BIGINT AS sigsq FROM noise JOIN us USING (edge_id) GROUP BY edge_id, uses")
def x26(spark, sf):
    used = X.edges(spark, sf).select(F.explode(F.array_repeat("edge_id", (F.col("edge_id") % 4).cast("int"))).alias("signed"))
    return unwrap.variances(weed.centred_angles(edge(spark, sf)).select("edge_id", "noise"), used).select("edge_id", "uses", long("sigsq"))


@query("f22_mask_bad_edges", f"WITH {EDGE} SELECT edge_id, max(abs(noise)) < 3 AS usable FROM noise GROUP BY edge_id")
def f22(spark, sf):
    bad = F.when(F.max(F.abs("noise")) < 3, F.lit(1.0)).otherwise(F.lit(float("nan")))
    return weed.centred_angles(edge(spark, sf)).groupBy("edge_id").agg(bad.alias("v")).select("edge_id", (~F.isnan("v")).alias("usable"))


@query("x27_cost_offsets", f"WITH {EDGE} SELECT edge_id, p.ifg_ix, round_even(({wrap_sql('q.angle - p.angle')} - 0.1 * p.angle) * CASE WHEN edge_id % 2 = 0 THEN -1 ELSE 1 END * 200 / {TAU}, 0)::BIGINT AS \"offset\" FROM edges JOIN angles p ON p.ps_id = a JOIN angles q ON q.ps_id = b AND q.ifg_ix = p.ifg_ix")
def x27(spark, sf):
    a = X.angles(spark, sf)
    j = X.edges(spark, sf).join(a.select(F.col("ps_id").alias("a"), "ifg_ix", F.col("angle").alias("before")), "a").join(a.select(F.col("ps_id").alias("b"), "ifg_ix", F.col("angle").alias("after")), ["b", "ifg_ix"])
    j = j.withColumns({"smooth": 0.1 * F.col("before"), "sign": F.when(F.col("edge_id") % 2 == 0, -1).otherwise(1)})
    return unwrap.offsets(j).select("edge_id", "ifg_ix", long("offset"))


@query("a34_edge_uses", "SELECT abs(s) AS edge_id, count(*) AS n FROM (SELECT (vec_id % 21) - 10 AS s FROM embeddings) WHERE s <> 0 GROUP BY abs(s)", False)
def a34(spark, sf):
    s = table_of(spark, sf, "embeddings").select((F.col("vec_id") % 21 - 10).alias("s")).where("s != 0")
    return s.groupBy(F.abs("s").alias("edge_id")).agg(F.count("*").alias("n"))


@query("a22_neighbour_msd", f'WITH {GV} SELECT p.ifg_ix, {q("avg(power(p.v - n.v, 2)) FILTER (p.v <> n.v)", "msd")} FROM gv p JOIN gv n ON n.ifg_ix = p.ifg_ix AND ((n."row" = p."row" AND n.col = p.col + 1) OR (n."row" = p."row" + 1 AND n.col = p.col)) WHERE p.v <> 0 AND n.v <> 0 GROUP BY p.ifg_ix')
def a22(spark, sf):
    g = X.points(spark, sf).join(X.angles(spark, sf), "ps_id").select("ifg_ix", "row", "col", F.col("angle").alias("uw"))
    return unwrap.neighbour_msd(g, "uw", ["ifg_ix"]).select("ifg_ix", r("msd"))


def cells_of(spark, sf, size=200.0):
    placed = grid.cells(X.points(spark, sf).withColumn("patch_id", F.lit(1)), size, 1e-3)
    return placed, grid.accumulate(X.phase(spark, sf), placed)


@query("h12_unwrap")
def h12(spark, sf):
    _, cells = cells_of(spark, sf)
    return unwrap.unwrap(cells.select("patch_id", "ifg_ix", "gi", "gj", F.atan2("im", "re").alias("ph")))


@query("h4_clap_filter")
def h4(spark, sf):
    return spectral.filter_stack(cells_of(spark, sf, 50.0)[1], "clap", 8)


@query("h5_goldstein_filter")
def h5(spark, sf):
    return spectral.filter_stack(cells_of(spark, sf, 50.0)[1], "goldstein", 8)


@query("h2_edge_slopes_and_w7_smoothing")
def w7(spark, sf):
    return spacetime.smoothed_edges(weed.edge_phase(X.edges(spark, sf), X.phase(spark, sf), True), X.ifgs(spark), 730.0, WRAPS, 12.0 * MASTER)


@query("j11_delaunay_edges")
def j11(spark, sf):
    return weed.delaunay_edges(X.points(spark, sf))


@query("h10_adjacent_points")
def h10(spark, sf):
    return weed.adjacency_keep(X.points(spark, sf))


@query("w5_edge_noise")
def w5(spark, sf):
    e = weed.edge_phase(X.edges(spark, sf), X.phase(spark, sf), True).withColumn("patch_id", (F.col("edge_id") % 10).cast("int"))
    return weed.edge_noise(e, X.ifgs(spark))


@query("x13_low_pass_response")
def x13(spark, sf):
    h = spectral.low_pass_response(16, 50.0, 800.0)
    return spark.createDataFrame([(i, j, float(h[i, j])) for i in range(16) for j in range(16)], "i int, j int, h double")


@query("h9_without_own_cell")
def h9(spark, sf):
    """Each point's cell refiltered in its window without itself."""
    placed, cells = cells_of(spark, sf, 50.0)
    filtered = spectral.without_own_cells(cells, placed, 8)
    return placed.select("ps_id", "patch_id", "gi", "gj").join(filtered, ["patch_id", "gi", "gj"]).select("ps_id", "ifg_ix", "re", "im")


# ---------------------------------------------------------------- verification and diagnostics

VER = "g AS (SELECT l_orderkey % 3 AS a, CASE WHEN l_linenumber % 2 = 0 THEN 'C_ps' ELSE 'K_ps' END AS key, l_orderkey * 10 + l_linenumber AS pos, l_extendedprice / 1e4 AS v, l_orderkey FROM lineitem), rn AS (SELECT *, CASE WHEN l_orderkey % 50 = 7 THEN v + 0.01 WHEN key = 'C_ps' THEN v + 2 * pi() ELSE v + 1e-9 END AS w FROM g WHERE l_orderkey % 97 <> 5)"


def versions(spark, sf):
    c = F.col
    g = table_of(spark, sf, "lineitem").select(F.concat(F.lit("part"), c("l_orderkey") % 3).alias("artifact"), F.when(c("l_linenumber") % 2 == 0, "C_ps").otherwise("K_ps").alias("key"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("pos"), (c("l_extendedprice") / 1e4).alias("re"), F.lit(0.0).alias("im"), "l_orderkey")
    moved = F.when(c("l_orderkey") % 50 == 7, c("re") + 0.01).when(c("key") == "C_ps", c("re") + P.TAU).otherwise(c("re") + 1e-9)
    return g.where("l_orderkey % 97 != 5").withColumn("re", moved), g


@query("r6_verify", f"WITH {VER}, d AS (SELECT 'part' || g.a AS artifact, g.key, rn.w IS NULL AS gone, CASE WHEN g.key = 'C_ps' THEN abs(rn.w - g.v + {PI} - {TAU} * floor((rn.w - g.v + {PI}) / {TAU}) - {PI}) ELSE abs(rn.w - g.v) END AS d, CASE WHEN g.key = 'C_ps' THEN 1e-7 ELSE 1e-7 + 1e-5 * abs(g.v) END AS lim FROM g LEFT JOIN rn ON rn.pos = g.pos AND rn.a = g.a AND rn.key = g.key) SELECT artifact, key, count(*) AS n, sum(gone::BIGINT)::BIGINT AS missing, sum((NOT gone AND d > lim)::BIGINT)::BIGINT AS n_out, {q('max(d)', 'max_abs')}, bool_and(NOT gone) AND sum((NOT gone AND d > lim)::BIGINT) = 0 AS passed FROM d GROUP BY artifact, key", False)
def r6(spark, sf):
    run, golden = versions(spark, sf)
    policies = verify.Policies(wrap_keys=verify.SCIENTIFIC_WRAP).table(spark)
    return verify.compared(run, golden, policies).select("artifact", "key", "n", "missing", "n_out", r("max_abs"), "passed")


@query("r8_policies", "SELECT k AS key, CASE WHEN k LIKE '%ph_res' OR k LIKE '%C_ps' THEN true ELSE false END AS wrap FROM (VALUES ('pm1.ph_res'), ('pm1.K_ps'), ('C_ps'), ('uw.msd')) t(k)", False)
def r8(spark, sf):
    keys = spark.createDataFrame([("x", k) for k in ("pm1.ph_res", "pm1.K_ps", "C_ps", "uw.msd")], "artifact string, key string")
    return verify.resolved(keys, verify.Policies(wrap_keys=verify.SCIENTIFIC_WRAP).table(spark)).select("key", "wrap")


@query("r7_exact", "SELECT 'part' || (l_orderkey % 3) AS artifact, bool_and(l_orderkey % 97 <> 5) AS passed FROM lineitem GROUP BY l_orderkey % 3", False)
def r7(spark, sf):
    _, golden = versions(spark, sf)
    return verify.exact(golden.where("l_orderkey % 97 != 5"), golden).groupBy("artifact").agg(F.bool_and("passed").alias("passed"))


@query("r9_failure_kinds", "SELECT 'shape' AS kind, 6::BIGINT AS n", False)
def r9(spark, sf):
    run, golden = versions(spark, sf)
    return verify.classified(verify.compared(run, golden, verify.Policies(wrap_keys=verify.SCIENTIFIC_WRAP).table(spark)))


@query("f18_masks", "SELECT p.ps_id, p.coh >= 0.3 AS mask_a, f.coh * 0.8 >= 0.3 AS mask_b, p.coh >= 0.3 AND f.coh * 0.8 >= 0.3 AS mask_common FROM points p JOIN fits f USING (ps_id)")
def f18(spark, sf):
    return diagnostics.common(X.points(spark, sf), X.fits(spark, sf).withColumn("coh", F.col("coh") * 0.8), 0.3)


IQR = "SELECT quantile_cont(l_extendedprice * l_discount, 0.25) AS q1, quantile_cont(l_extendedprice * l_discount, 0.75) AS q3 FROM lineitem"


@query("f19_iqr", f"SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem, ({IQR}) WHERE l_extendedprice * l_discount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)", False)
def f19(spark, sf):
    v = table_of(spark, sf, "lineitem").withColumn("v", F.col("l_extendedprice") * F.col("l_discount"))
    return diagnostics.without_outliers(v, "v").select("l_orderkey", long("l_linenumber"))


@query("f19_zscore", "SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE value BETWEEN m - 3 * s AND m + 3 * s", False)
def f19z(spark, sf):
    return diagnostics.without_outliers(table_of(spark, sf, "events"), "value", "zscore").select("event_id")


@query("a29_field_statistics", f"SELECT count(*) AS n, {q('avg(o_totalprice)', 'mean')}, {q('min(o_totalprice)', 'low')}, {q('max(o_totalprice)', 'high')}, {q('stddev_pop(o_totalprice)', 'std')}, {q('quantile_cont(o_totalprice, 0.05)', 'p5')}, {q('quantile_cont(o_totalprice, 0.95)', 'p95')} FROM orders", False)
def a29(spark, sf):
    return diagnostics.statistics(table_of(spark, sf, "orders"), "o_totalprice").select("n", *[r(c) for c in ("mean", "low", "high", "std", "p5", "p95")])


@query("a30_compare_fields", f"SELECT count(*) AS n, {q('avg(p.coh - f.coh * f.coh)', 'bias')}, {q('sqrt(avg(power(p.coh - f.coh * f.coh, 2)))', 'rmse')}, {q('avg(abs(p.coh - f.coh * f.coh))', 'mae')} FROM points p JOIN fits f USING (ps_id)")
def a30(spark, sf):
    f = X.fits(spark, sf).withColumn("coh", F.col("coh") * F.col("coh"))
    return diagnostics.compared(X.points(spark, sf), f, "coh").select("n", r("bias"), r("rmse"), r("mae"))


@query("a31_numeric_result", f"SELECT {q('max(abs(l_tax - l_discount))', 'max_abs')}, count(*) FILTER (abs(l_tax - l_discount) > 0.0501) AS n_out FROM lineitem", False)
def a31(spark, sf):
    d = F.abs(F.col("l_tax") - F.col("l_discount"))
    return table_of(spark, sf, "lineitem").agg(r(F.max(d), "max_abs"), F.count(F.when(d > 0.0501, 1)).alias("n_out"))


@query("a32_incidence_mean", f"SELECT {q('avg(s_acctbal) FILTER (s_acctbal > 0)', 'mean')} FROM supplier", False)
def a32(spark, sf):
    return table_of(spark, sf, "supplier").agg(r(F.avg(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))), "mean"))


@query("j14_match_points", "WITH b AS (SELECT round(lon, 3) AS rx, round(lat, 3) AS ry, max(ps_id) AS other_id FROM points GROUP BY round(lon, 3), round(lat, 3)) SELECT ps_id, other_id FROM points JOIN b ON round(lon, 3) = rx AND round(lat, 3) = ry")
def j14(spark, sf):
    p = X.points(spark, sf)
    return diagnostics.matched(p, p, 3).select("ps_id", "other_id")


@query("j15_row_intersection", "SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0", False)
def j15(spark, sf):
    a = table_of(spark, sf, "orders").select("o_custkey")
    return a.join(table_of(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").distinct()


@query("j16_missing_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", False)
def j16(spark, sf):
    o = table_of(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table_of(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("t6_highest", "SELECT ps_id FROM fits ORDER BY abs(k) DESC, ps_id LIMIT 20")
def t6(spark, sf):
    return diagnostics.chosen(X.fits(spark, sf), "k", "high_velocity", 20)


@query("t6_evenly_spaced", "SELECT ps_id FROM (SELECT ps_id, row_number() OVER (ORDER BY ps_id) - 1 AS n, count(*) OVER () // 20 AS s FROM fits) WHERE n % s = 0 ORDER BY ps_id LIMIT 20")
def t6_even(spark, sf):
    return diagnostics.chosen(X.fits(spark, sf), "k", "evenly_spaced", 20)


@query("t7_stride", "SELECT ps_id FROM (SELECT ps_id, row_number() OVER (ORDER BY ps_id) - 1 AS n FROM fits) WHERE n % 7 = 0")
def t7(spark, sf):
    return diagnostics.every(X.fits(spark, sf), 7).select("ps_id")


@query("x30_fitted_series", f"SELECT ps_id, ifg_ix, {q('c + k * day', 'fitted')} FROM fits, ifgs")
def x30(spark, sf):
    v = X.fits(spark, sf).select("ps_id", F.col("c").alias("intercept"), F.col("k").alias("slope"))
    return diagnostics.fitted_series(v, X.ifgs(spark)).select("ps_id", "ifg_ix", r("fitted"))


@query("s20_optional_tables", f"SELECT c_custkey, {q('coalesce(o, c_acctbal)', 'value')} FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey", False)
def s20(spark, sf):
    o = table_of(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("o"))
    return table_of(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", r(F.coalesce("o", "c_acctbal"), "value"))


@query("s21_profile", f"SELECT count(*) AS n, count(DISTINCT label) AS labels, {q('min(embedding[1])', 'low')}, {q('max(embedding[1])', 'high')} FROM embeddings", False)
def s21(spark, sf):
    e = F.col("embedding")[0].cast("double")
    return table_of(spark, sf, "embeddings").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), r(F.min(e), "low"), r(F.max(e), "high"))

