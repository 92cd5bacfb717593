"""Operators that SQL can't express, against analytic cases and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterlake.functions import geometry
from scatterlake.operators import fit, grid, network, prep, scene, series, spacetime, spectral, unwrap, weed

RNG = np.random.default_rng(4)


def test_fit_recovers_planted_slopes():
    bperp = RNG.uniform(-150, 150, 24)
    k = RNG.uniform(-0.02, 0.02, 40)
    ph = np.exp(1j * (k[:, None] * bperp + RNG.uniform(-3, 3, (40, 1)) + RNG.normal(0, 0.05, (40, 24))))
    got, _, coh, rest = fit.fit_rows(ph, bperp, 1.0)
    assert np.abs(got - k).max() < 5e-4 and coh.min() > 0.98
    assert np.allclose(np.abs(rest), 1)
    ph[0, 3:] = 0
    ph[1] = 0
    got, _, coh, _ = fit.fit_rows(ph, bperp, 1.0)
    assert np.isfinite(got[0]) and np.isnan(got[1]) and np.isnan(coh[1])


def test_patch_ranges():
    assert geometry.patch_ranges(10, 3, 2) == [(1, 5, 1, 3), (2, 8, 4, 6), (5, 10, 7, 10)]
    with pytest.raises(ValueError):
        geometry.patch_ranges(3, 4, 0)


def test_candidates_drop_pixels_with_a_zero(spark):
    rows = [(p, a, 0.0 if (p, a) == (1, 4) else 1.0) for p in (1, 2) for a in range(10)]
    pixels = prep.dispersion(spark.createDataFrame(rows, "pixel int, acq int, amp double"), spark.createDataFrame([(a, 1.0) for a in range(10)], "acq int, factor double"))
    got = {r.pixel: (round(r.d_a, 9), r.low) for r in pixels.collect()}
    assert got == {1: (round(1 / 3, 9), True), 2: (0.0, False)}
    assert [r.pixel for r in prep.candidates(pixels).collect()] == [2]


def test_chronology_refuses_the_master_twice(spark):
    dates = spark.createDataFrame([(1, 5.0, 1.0)], "acq long, day double, bperp double")
    phase = spark.createDataFrame([(1, 1, 1.0, 0.0)], "ps_id long, acq long, re double, im double")
    with pytest.raises(ValueError):
        prep.chronology(phase, dates, 5.0)


def test_nearest_looks_beyond_its_bins(spark):
    p = RNG.uniform(0, 1000, (60, 2))
    q = RNG.uniform(-500, 1500, (80, 2))
    known = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "known_id long, kx double, ky double")
    ask = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(q)], "query_id long, qx double, qy double")
    d = ((q[:, None] - p[None]) ** 2).sum(-1)
    assert {r.query_id: r.known_id for r in grid.nearest(ask, known, 20.0).collect()} == dict(enumerate(d.argmin(1).tolist()))


def delaunay_brute(p):
    out = set()
    n = len(p)
    for i in range(n):
        for j in range(i + 1, n):
            for k in range(j + 1, n):
                c, r = weed._circles(p, np.array([[i, j, k]]))
                if (((p - c[0]) ** 2).sum(1) >= r[0] * (1 - 1e-9)).all():
                    out |= {(i, j), (j, k), (i, k)}
    return out


def test_delaunay():
    p = RNG.uniform(0, 100, (25, 2))
    assert weed.delaunay(*p.T) == delaunay_brute(p)
    assert weed.delaunay(np.array([0.0, 5.0]), np.array([0.0, 1.0])) == {(0, 1)}
    assert weed.delaunay(np.array([0.0, 3.0, 1.0, 2.0]), np.zeros(4)) == {(0, 2), (2, 3), (1, 3)}
    assert weed.delaunay(np.array([1.0]), np.array([1.0])) == set()


def test_adjacent_points_keep_the_best():
    keep = weed.adjacent_groups(np.array([0, 1, 5, 5]), np.array([0, 1, 5, 7]), np.array([0.5, 0.9, 0.1, 0.2]))
    assert keep.tolist() == [False, True, True, True]
    # columns 0, 3, 1, 2 by arrival: the third follows the first, the fourth the second
    row = weed.adjacent_groups(np.zeros(4, int), np.array([0, 3, 1, 2]), np.array([0.1, 0.2, 0.3, 0.4]))
    assert row.tolist() == [False, False, True, True]
    for _ in range(40):
        n = 30
        i, j, coh = RNG.integers(0, 8, n), RNG.integers(0, 8, n), RNG.integers(0, 5, n) / 5
        assert weed.adjacent_groups(i, j, coh).tolist() == grouped_brute(i, j, coh)


def grouped_brute(i, j, coh):
    """Marks every neighbouring pixel with its first point, then follows the marks."""
    mark = np.full((12, 12), -1)
    for k, (r, c) in enumerate(zip(i, j, strict=True)):
        around = mark[r : r + 3, c : c + 3]
        around[(around < 0) & (np.arange(9).reshape(3, 3) != 4)] = k
    leader = [int(mark[r + 1, c + 1]) for r, c in zip(i, j, strict=True)]
    taken, keep = set(), [True] * len(i)
    for k in range(len(i)):
        group, grown = {k}, True
        while grown:
            new = {m for m in range(len(i)) if m not in taken and leader[m] in group}
            taken |= new
            grown = bool(new)
            group |= new
        best = max(sorted(group), key=lambda m: coh[m])
        for m in group - {best}:
            keep[m] = False
    return keep


def test_unwrapping_is_congruent_and_integrates_smooth_fields():
    y, x = np.mgrid[:14, :17]
    true = 0.35 * x + 0.2 * y + 0.02 * x * y
    wrapped = np.angle(np.exp(1j * true))
    out = unwrap.unwrap_grid(wrapped, *unwrap.default_costs(14, 17))
    assert np.allclose(np.angle(np.exp(1j * (out - wrapped))), 0, atol=1e-9)
    assert np.allclose(out - out[0, 0], true - true[0, 0])


def test_flow_removes_residues_and_lowers_the_objective():
    noisy = np.angle(np.exp(1j * (0.4 * np.mgrid[:9, :9][1] + RNG.normal(0, 1.2, (9, 9)))))
    field = unwrap.Field(noisy, *unwrap.default_costs(9, 9))
    assert field.loops().any()
    unwrap.solve_flow(field)
    assert not field.loops().any()
    label = unwrap.labels_of(field)
    step = np.diff(label, axis=1)
    assert (step == field.delta[0] + field.extra[0]).all() and (np.diff(label, axis=0) == field.delta[1] + field.extra[1]).all()
    holes = noisy.copy()
    holes[3:5, 2:6] = 0
    out = unwrap.unwrap_grid(holes, *unwrap.default_costs(9, 9))
    assert (out[holes == 0] == 0).all() and np.allclose(np.angle(np.exp(1j * (out - holes)))[holes != 0], 0, atol=1e-9)


def test_flow_is_optimal_on_small_grids():
    """Against all flows: per cell one of a few cycle labels, the first cell fixed."""
    import itertools

    for _ in range(6):
        phase = RNG.uniform(-np.pi, np.pi, (2, 4))
        right, down = unwrap.default_costs(2, 4)
        right[..., 0], down[..., 0] = RNG.integers(-120, 120, right.shape[:2]), RNG.integers(-120, 120, down.shape[:2])
        right[..., 1], down[..., 1] = RNG.integers(5, 300, right.shape[:2]), RNG.integers(5, 300, down.shape[:2])
        field = unwrap.Field(phase, right, down)
        unwrap.solve_flow(field)
        least = min(
            sum(field.cost(0, at, int(n[at[0], at[1] + 1] - n[at] - field.delta[0][at])) for at in np.ndindex(2, 3)) + sum(field.cost(1, at, int(n[at[0] + 1, at[1]] - n[at] - field.delta[1][at])) for at in np.ndindex(1, 4))
            for rest in itertools.product(range(-2, 3), repeat=7)
            for n in [np.array([0, *rest]).reshape(2, 4)]
        )
        assert field.total() == least


def test_filters_keep_smooth_fields_and_lower_noise():
    y, x = np.mgrid[:48, :40]
    clean = np.exp(1j * (0.1 * x + 0.05 * y))
    noisy = clean * np.exp(1j * RNG.normal(0, 0.8, clean.shape))
    for out in (spectral.clap(noisy, 16), spectral.goldstein(noisy, 16)):
        assert np.abs(np.angle(out * clean.conj())).mean() < 0.8 * np.abs(np.angle(noisy * clean.conj())).mean()
    assert np.allclose(np.abs(spectral.goldstein(noisy, 16)), 1)
    assert not spectral.clap(noisy[:8], 16).any()
    with pytest.raises(ValueError):
        spectral.goldstein(noisy[:8], 16)


def test_smoothing_over_time_keeps_lines_and_edge_slopes_find_baselines():
    day, bperp = np.arange(0.0, 20) * 12, RNG.uniform(-100, 100, 20)
    line = np.exp(1j * (0.004 * day + 0.3))[None]
    smooth, noise = spacetime.smooth_series(line, day, 100.0, 50.0)
    assert np.abs(noise).max() < 1e-6 and np.allclose(np.diff(smooth[0]), 0.048, atol=1e-6)
    k = spacetime.edge_slopes(np.exp(1j * 0.01 * bperp)[None], bperp, 1.0)
    assert abs(k[0] - 0.01) < 1e-4
    noise_only = spacetime.edge_slopes(np.exp(1j * RNG.uniform(-np.pi, np.pi, (200, 20))), bperp, 1.0)
    assert (noise_only == 0).mean() > 0.5
    flat = weed.temporal_noise(np.repeat(line, 3, axis=0), day, bperp, 100.0)
    assert np.abs(flat).max() < 1e-6


@pytest.mark.parametrize("days", [[0.0, 10.0, 25.0, 45.0, 70.0], [0.0, 12.0, 24.0, 36.0, 48.0]])
def test_look_angle_error_recovers_planted_terms(spark, days):
    base = [0.0, 30.0, -20.0, 55.0, -5.0]
    rows = [(i + 1, d, b, i == 0, 30.0) for i, (d, b) in enumerate(zip(days, base))]
    ifgs = spark.createDataFrame(rows, "ifg_ix long, day double, bperp double, is_master boolean, std_deg double")
    true = {p: (RNG.uniform(-0.05, 0.05), RNG.uniform(-1, 1), RNG.uniform(-0.01, 0.01)) for p in range(6)}
    phase = [(p, i + 1, k * base[i] + (0 if i == 0 else c) + v * (d - days[0])) for p, (k, c, v) in true.items() for i, d in enumerate(days)]
    same = [(p, i, x + (true[p][1] if i == 1 else 0)) for p, i, x in phase]  # differences see no jump at the master
    got = {r.ps_id: (r.k, r.c) for r in scene.look_angle_error(spark.createDataFrame(same, "ps_id long, ifg_ix long, ph double"), ifgs).collect()}
    for p, (k, c, _) in true.items():
        assert abs(got[p][0] - k) < 1e-10 and abs(got[p][1] - c) < 2e-6


def test_shared_design_rejects_dependent_columns_and_takes_covariances():
    with pytest.raises(ValueError):
        series.shared_design(np.ones((4, 2)))
    x = np.column_stack([np.ones(6), np.arange(6.0)])
    y, c = RNG.normal(size=6), np.diag(RNG.uniform(1, 3, 6))
    assert np.allclose(series.shared_design(x, covariance=c) @ y, series.shared_design(x, 1 / np.diag(c)) @ y)
    assert series.constant_steps(np.full(5, 12.0)) and not series.constant_steps(np.array([12.0, 13.0]))


def test_ramp_and_reference(spark):
    pts = [(p, float(RNG.uniform(0, 5000)), float(RNG.uniform(0, 5000))) for p in range(12)]
    points = spark.createDataFrame([(p, x, y, 10 + x / 1e5, 45 + y / 1e5) for p, x, y in pts], "ps_id long, x double, y double, lon double, lat double")
    phase = spark.createDataFrame([(p, 1, 0.3 * x / 1000 - 0.2 * y / 1000 + 1.5 if p else float("nan")) for p, x, y in pts], "ps_id long, ifg_ix long, ph double")
    flat = scene.deramped(phase, points).collect()
    assert all(math.isnan(r.ph) if r.ps_id == 0 else abs(r.ph) < 1e-9 for r in flat)
    assert scene.reference(points, radius=-math.inf).count() == 0
    assert {r.ph for r in scene.centred(phase.where("ps_id > 0"), scene.reference(points, radius=-math.inf)).collect()} == {r.ph for r in phase.where("ps_id > 0").collect()}


def test_histogram_ties_go_down(spark):
    got = {r.bin: r.n for r in grid.histogram(spark.createDataFrame([(v,) for v in (0.01, 0.02, 0.0150001, -5.0, 7.0, float("nan"))], "v double"), "v").collect()}
    assert got[0] == 2 and got[1] == 2 and got[99] == 1 and sum(got.values()) == 5


def test_interpolation_passes_through_smooth_samples():
    x = np.sin(np.linspace(0, 4, 50))
    fine = fit.interpolate(x)
    assert len(fine) == 500 and np.abs(fine[100:400:10] - x[10:40]).max() < 0.02


def test_cells_refiltered_without_themselves(spark):
    rng = np.random.default_rng(8)
    g = rng.normal(size=(2, 9, 7)) + 1j * rng.normal(size=(2, 9, 7))
    rows = [(1, d, i, j, float(g[d, i, j].real), float(g[d, i, j].imag)) for d in (0, 1) for i in range(9) for j in range(7)]
    cells = spark.createDataFrame(rows, "patch_id int, ifg_ix long, gi int, gj int, re double, im double")
    wanted = spark.createDataFrame([(1, i, j) for i in range(9) for j in (0, 3, 6)] * 2, "patch_id int, gi int, gj int")
    # without the adaptive part and with a low-pass that only the mean passes, a value is its window's mean without the cell
    how = {"beta": 0.0, "wavelength": 1e9}
    got = {(r.ifg_ix, r.gi, r.gj): complex(r.re, r.im) for r in spectral.without_own_cells(cells, wanted, 4, **how).collect()}
    want = {}
    for d in (0, 1):
        for i in range(9):
            for j in (0, 3, 6):
                a, b = min(max(0, i - 2), 5), min(max(0, j - 2), 3)
                want[d, i, j] = (g[d, a : a + 4, b : b + 4].sum() - g[d, i, j]) / 16
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert not any(complex(r.re, r.im) for r in spectral.without_own_cells(cells, wanted, 8, **how).collect())


def network_of(spark, rows, cols, at, truth, days, bperp=None):
    """Raster, edges, smoothed edges, costs, offsets and phase of nodes at these cells whose true phase is truth(cell, date)."""
    occupied = network.nodes(spark.createDataFrame(at, "gi int, gj int"), rows)
    found = network.raster(occupied, rows, cols).persist()
    links = network.edges(found).persist()
    series = [(n.node, d + 1, truth((n.gi, n.gj), d)) for n in occupied.collect() for d in range(len(days))]
    phase = spark.createDataFrame(series, "ps_id long, ifg_ix long, v double")
    phasors = phase.select("ps_id", "ifg_ix", F.cos("v").alias("re"), F.sin("v").alias("im"))
    edge = weed.edge_phase(links, phasors, True)
    ifgs = spark.createDataFrame([(d + 1, float(t), float((bperp or [0.0] * len(days))[d])) for d, t in enumerate(days)], "ifg_ix long, day double, bperp double")
    smoothed = spacetime.smoothed_edges(edge, ifgs, 30.0, 0.5, 0.0).persist()
    costed = network.with_variances(network.steps(found, links), smoothed)
    return found, links, smoothed, costed, network.edge_offsets(edge, smoothed), phasors.select(F.col("ps_id").alias("node"), "ifg_ix", F.atan2("im", "re").alias("ph"))


def test_network_nearest_edges_and_uses(spark):
    import itertools

    rows, cols, at = 5, 6, [(0, 0), (4, 1), (2, 4), (0, 5)]
    found, links, _, costed, _, _ = network_of(spark, rows, cols, at, lambda c, d: 0.1 * c[1] + 0.01 * d, range(-40, 41, 10))
    near = {(i, j): min(((i - a) ** 2 + (j - b) ** 2, b * rows + a + 1) for a, b in at)[1] for i, j in itertools.product(range(rows), range(cols))}
    assert {(r.gi, r.gj): r.node for r in found.collect()} == near
    assert {(r.gi, r.gj) for r in found.where("own").collect()} == set(at)
    meet = {k: (near[k], near.get((k[0] + di, k[1] + dj))) for k in near for di, dj in ((0, 1),)}
    ids = {(r.a, r.b): r.edge_id for r in links.collect()}
    sign = lambda p, q: None if q is None else 0 if p == q else ids[p, q] if p < q else -ids[q, p]
    got = {(r.gi, r.gj): r for r in costed.collect()}
    assert {k: r.right for k, r in got.items()} == {k: sign(*v) for k, v in meet.items()}
    assert {k: r.down for k, r in got.items()} == {k: sign(near[k], near.get((k[0] + 1, k[1]))) for k in near}
    assert all(r.right_sig == 1 for r in got.values() if r.right == 0) and all((r.right_sig is None) == (r.right is None) for r in got.values())


def test_smoothing_in_time_decides_the_cycles(spark):
    """A step of over pi between two halves: uniform costs take it as wrapped, the series' smooth course has it whole."""
    at = [(i, j) for i in range(4) for j in range(8)]
    days = list(range(-60, 61, 10))
    truth = lambda c, d: 0.3 + 0.02 * c[0] + 0.01 * c[1] + (0.09 * days[d] if c[1] >= 4 else 0.0)
    _, _, _, costed, offsets, phase = network_of(spark, 4, 8, at, truth, days)
    solved = {(r.ifg_ix, r.gi, r.gj): r.uw for r in network.solve(costed, phase, offsets).collect()}
    plain = {(r.ifg_ix, r.gi, r.gj): r.uw for r in unwrap.unwrap(phase.join(network.nodes(spark.createDataFrame(at, "gi int, gj int"), 4), "node").select(F.lit(0).alias("patch_id"), "ifg_ix", "gi", "gj", "ph")).collect()}
    assert len(solved) == len(plain) == len(at) * len(days)
    wrong = 0
    for d in range(len(days)):
        base, flat = solved[d + 1, 0, 0] - truth((0, 0), d), plain[d + 1, 0, 0] - truth((0, 0), d)
        for c in at:
            assert abs(solved[d + 1, *c] - truth(c, d) - base) < 1e-6
            wrong += abs(plain[d + 1, *c] - truth(c, d) - flat) > 1
    assert wrong > 0


def test_edges_without_finite_noise_let_flow_pass(spark):
    rnd = np.random.default_rng(3)
    at = [(i, j) for i in range(3) for j in range(6)]
    days = list(range(-60, 61, 10))
    jumps = rnd.uniform(-np.pi, np.pi, (18, len(days)))
    truth = lambda c, d: 0.2 + 0.01 * c[1] + (float(jumps[c[0] * 6 + c[1], d]) if c[1] == 3 else 0.0)
    _, _, smoothed, costed, offsets, phase = network_of(spark, 3, 6, at, truth, days)
    bad = {r.edge_id for r in smoothed.where("noise is null or isnan(noise)").collect()}
    assert bad and all((r.right_sig is None) == (abs(r.right) in bad) for r in costed.where("right is not null").collect())
    assert not bad & {r.edge_id for r in offsets.select("edge_id").distinct().collect()}
    out = network.solve(costed, phase, offsets).join(network.nodes(spark.createDataFrame(at, "gi int, gj int"), 3), ["gi", "gj"]).join(phase, ["node", "ifg_ix"])
    assert out.count() == len(at) * len(days) and out.where(F.abs(F.sin((F.col("uw") - F.col("ph")) / 2)) > 1e-6).count() == 0
