"""The eight stages over a store, each a DataFrame plan whose results are published together."""

from __future__ import annotations

import hashlib
import math
import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.functions.phase import cpx
from scatterlake.functions.phase import unit as phasor
from scatterlake.operators import fit, grid, merge, network, prep, scene, spacetime, spectral, weed
from scatterlake.plans.config import Params, RunConfig, refuse
from scatterlake.plans.store import MARKERS, Store, fingerprint


def load_points(store: Store, params: Params, source: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage 1: chronology, valid points, local coordinates, ids by position."""
    ifgs, phase = prep.chronology(source["phase"], source["dates"], params.scalar("master_day"))
    points = prep.valid_points(source["points"], phase)
    from scatterlake.functions.geometry import local_xy, millimetres

    placed = local_xy(points, params.values.get("heading")).withColumns({"x": millimetres(F.col("x")).cast("double"), "y": millimetres(F.col("y")).cast("double")})
    ids = prep.renumber(placed)
    return {"points": ids, "phase": phase.join(ids.select("ps_id"), "ps_id", "left_semi"), "ifgs": ifgs}


def unit_series(phase: DataFrame, ifgs: DataFrame) -> DataFrame:
    """Unit phasors of the phase on these dates."""
    u = phasor(cpx("re", "im"))
    return phase.join(F.broadcast(ifgs.select("ifg_ix")), "ifg_ix", "left_semi").withColumns({"re": u.re, "im": u.im})


def without_patch(phase: DataFrame, patch: DataFrame) -> DataFrame:
    """The phase times the conjugate of the filtered phase of each point's surroundings."""
    p = patch.select("ps_id", "ifg_ix", F.col("re").alias("pr"), F.col("im").alias("pi"))
    return phase.join(p, ["ps_id", "ifg_ix"]).select("ps_id", "ifg_ix", F.expr("re * pr + im * pi").alias("re"), F.expr("im * pr - re * pi").alias("im"))


def estimate(store: Store, params: Params) -> dict[str, DataFrame]:
    """Stage 2: fixed point of gridding, filtering and fitting; a table is written per round, so plans stay short."""
    points, phase, ifgs = (store.read(n) for n in ("points", "phase", "ifgs"))
    wraps, rounds = params.scalar("n_trial_wraps", 1.0), int(params.scalar("gamma_max_iterations", 3))
    base = np.array([r["bperp"] for r in ifgs.where("not is_master").orderBy("ifg_ix").select("bperp").collect()], float)
    others = ifgs.where("not is_master")
    own = unit_series(phase, others)
    rows = int(params.scalar("random_samples", 20_000))
    random = store.cached("random", f"{rows}-{hashlib.sha256(str((wraps, base.tolist())).encode()).hexdigest()[:16]}", lambda: store.spark.createDataFrame([(b, float(n)) for b, n in enumerate(fit.random_histogram(base, wraps, rows))], "bin int, n double"))
    chance = np.array([r["n"] for r in random.orderBy("bin").collect()])
    placed = grid.cells(points, params.scalar("filter_grid_size", 50.0)).withColumn("weight", F.lit(1.0))
    before, change = None, math.inf
    for k in range(rounds):
        sums = grid.accumulate(own, placed, "weight")
        cells = spectral.filter_stack(sums, "clap", int(params.scalar("clap_win", 8)))
        name = f"fit_round_{k}"
        store.write({name: fit.topofit(without_patch(own, grid.at_points(cells, placed)), others, wraps)})
        now = store.read(name)
        if before is not None:
            rms = fit.coherence_change(now, before).first()["rms"] or 0.0
            if abs(rms - change) < params.scalar("gamma_change_convergence", 0.005):
                break
            change = rms
        seen = np.array([r["n"] for r in fit.coherence_histogram(now).orderBy("bin").collect()], float)
        table = fit.psquare_weights(seen, chance)
        weights = store.spark.createDataFrame([(s, float(w)) for s, w in enumerate(table)], "slot int, w double")
        slot = F.least(F.round(F.coalesce(F.nanvl("coh", F.lit(0.0)), F.lit(0.0)) * 1000).cast("int"), F.lit(len(table) - 1))
        coh = now.select("ps_id", slot.alias("slot")).join(F.broadcast(weights), "slot").select("ps_id", F.col("w").alias("weight"))
        placed = placed.drop("weight").join(coh, "ps_id")
        before = now
    return {"fit": now, "random_hist": random, "cells": placed.select("ps_id", "patch_id", "gi", "gj"), "cell_sums": sums}


def select(store: Store, params: Params) -> dict[str, DataFrame]:
    """Stage 3: coherence thresholds by dispersion; points strictly over them are fitted again without their own cell.

    After that (unless a flag turns it off) a point stays if its new coherence is
    strictly over the thresholds of all points' newest coherences and its slope
    moved by less than a cycle over the baselines. A point that is zero on a date,
    or whose grid is smaller than a window, has no second fit and goes.
    """
    points = store.read("points").join(store.read("fit"), ["ps_id"])
    random = np.array([r["n"] for r in store.read("random_hist").orderBy("bin").collect()])
    bins = fit.dispersion_bins(points)
    line = lambda of: fit.coherence_thresholds(of, bins, random, params.scalar("percent_rand", 20.0), params.text("select_method", "percent") == "percent")
    columns = ["patch_id", "ps_id", "k", "c", "coh", "thresh"]
    first = fit.selected(points, *line(points))
    if not (params.flag("quick_est_gamma_flag", True) and params.flag("select_reest_gamma_flag", True)):
        return {"selection": first.select(columns)}
    others = store.read("ifgs").where("not is_master")
    placed = store.read("cells").join(first.select("ps_id"), "ps_id", "left_semi")
    cells = spectral.without_own_cells(store.read("cell_sums"), placed, int(params.scalar("clap_win", 8)))
    rest = without_patch(unit_series(store.read("phase"), others), grid.at_points(cells, placed))
    full = rest.withColumn("least", F.min(F.hypot("re", "im")).over(W.partitionBy("ps_id"))).where("least > 0").drop("least")
    store.write({"fit_again": fit.topofit(full, others, params.scalar("n_trial_wraps", 1.0))})
    again = store.read("fit_again")
    newest = points.join(first.select("ps_id", F.lit(True).alias("first")), "ps_id", "left").join(again.select("ps_id", F.col("coh").alias("coh2")), "ps_id", "left")
    slope, intercept = line(newest.withColumn("coh", F.when(F.col("first"), F.col("coh2")).otherwise(F.col("coh"))))
    span = others.agg((F.max("bperp") - F.min("bperp")).alias("s")).first()["s"] or 1.0
    judged = first.withColumn("thresh", F.greatest(slope * F.col("d_a") + intercept, F.lit(0.0)))
    kept = fit.reestimated(judged, again, span).where("keep").select("ps_id", "thresh")
    return {"selection": first.select("patch_id", "ps_id").join(kept, "ps_id").join(again, "ps_id").select(columns)}


def weeding(store: Store, params: Params) -> dict[str, DataFrame]:
    """Stage 4: less coherent neighbours (if asked for) and duplicates go, then points at sea level (if asked for) and with noisy edges."""
    chosen = store.read("points").join(store.read("selection").drop("patch_id"), "ps_id")
    if params.flag("weed_neighbours"):
        chosen = chosen.join(weed.adjacency_keep(chosen).where("keep").select("ps_id"), "ps_id", "left_semi")
    unique = weed.best_of(chosen, ["patch_id", "x", "y"])
    if params.flag("weed_zero_elevation"):
        unique = unique.where(F.col("height") >= 1e-6)
    limit = params.scalar("weed_standard_dev", 1.0), params.scalar("weed_max_noise", math.inf)
    edges = weed.delaunay_edges(unique).withColumn("edge_id", F.xxhash64("patch_id", "a", "b"))
    if min(limit) >= math.pi:
        kept = unique.withColumns({"ps_std": F.lit(0.0), "ps_max": F.lit(0.0), "keep": F.lit(True)})
    else:
        ifgs = store.read("ifgs")
        clean = weed.corrected(store.read("phase"), unique, ifgs).join(F.broadcast(ifgs.where("not is_master").select("ifg_ix")), "ifg_ix", "left_semi")
        edge = weed.edge_phase(edges.select("edge_id", "a", "b"), clean, True).join(edges.select("edge_id", "patch_id"), "edge_id")
        noise = weed.edge_noise(edge, ifgs.where("not is_master"), params.scalar("weed_time_win", 730.0))
        kept = weed.weeded(weed.point_noise(unique, noise), *limit)
    return {"edges": edges, "weed": kept}


def merging(store: Store, params: Params) -> dict[str, DataFrame]:
    """Stage 5: one row a place over all patches, corrected phase, deviation per date."""
    kept = merge.distinct_places(store.read("weed").where("keep"))
    points = merge.scene_ids(kept)
    phase, ifgs = store.read("phase").join(points.select("ps_id"), "ps_id", "left_semi"), store.read("ifgs")
    corrected = merge.corrected_phase(phase, points, ifgs)
    ones = phase.select("ps_id", "ifg_ix", F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    return {"scene_phase": corrected, "ifg_std": merge.date_deviation(phase, ones, points, ifgs), "scene": points}


def unwrapping(store: Store, params: Params) -> dict[str, DataFrame]:
    """Stage 6: grid, filter, edges between nearest occupied cells smoothed in time, costs, every date solved on its own, back to points.

    Solved dates are kept under a fingerprint of what they come from, so a run that
    broke off goes on with the dates that are missing.
    """
    points, ifgs = store.read("scene").withColumn("patch_id", F.lit(0)), store.read("ifgs")
    scla = store.read("scla_smooth") if store.exists("scla_smooth") else None
    phase = merge.to_unwrap(store.read("scene_phase"), points, ifgs, scla)
    others = ifgs.where("not is_master")
    solve = phase.join(F.broadcast(others.select("ifg_ix")), "ifg_ix", "left_semi")
    size = params.scalar("unwrap_grid_size", 200.0) * params.scalar("stage6_grid_scale", 1.0)
    placed = grid.cells(points, size, 1e-3)
    sums = grid.accumulate(solve, placed)
    if params.flag("unwrap_prefilter_flag", True):
        sums = spectral.filter_stack(sums, "goldstein", int(params.scalar("unwrap_gold_n_win", 32)), alpha=params.scalar("unwrap_gold_alpha", 0.8))
    box = placed.agg((F.max("gi") + 1).alias("rows"), (F.max("gj") + 1).alias("cols")).first()
    store.write({"uw_grid": network.nodes(sums, box["rows"]).withColumn("ifg_ix", F.col("ifg_ix").cast("long"))})
    cells = store.read("uw_grid")
    store.write({"uw_raster": network.raster(cells.select("gi", "gj", "node").distinct(), box["rows"], box["cols"])})
    store.write({"uw_edges": network.edges(store.read("uw_raster"))})
    edge = weed.edge_phase(store.read("uw_edges"), cells.select(F.col("node").alias("ps_id"), "ifg_ix", "re", "im"), True)
    window, wraps, master = params.scalar("unwrap_time_win", 730.0), params.scalar("n_trial_wraps", 1.0), ifgs.where("is_master").first()["day"]
    store.write({"uw_smooth": spacetime.smoothed_edges(edge, others, window, wraps, master)})
    smoothed = store.read("uw_smooth")
    store.write({"uw_costs": network.with_variances(network.steps(store.read("uw_raster"), store.read("uw_edges")), smoothed), "uw_offsets": network.edge_offsets(edge, smoothed)})
    angles = cells.select("node", "ifg_ix", F.atan2("im", "re").alias("ph"))
    sources = [points, store.read("scene_phase"), ifgs, *([scla] if scla else [])]
    settings = [size, window, wraps, *(str(params.values.get(n)) for n in ("unwrap_prefilter_flag", "unwrap_gold_n_win", "unwrap_gold_alpha"))]
    done = store.resumable("uw_dates", hashlib.sha256(str([*map(fingerprint, sources), *settings]).encode()).hexdigest()[:16])
    left = sorted(r["ifg_ix"] for r in store.missing(done, others.select(F.col("ifg_ix").cast("long").alias("ifg_ix")), "ifg_ix").collect())
    batch = max(1, store.spark.sparkContext.defaultParallelism)
    for k in range(0, len(left), batch):
        store.append(done, network.solve(store.read("uw_costs"), angles.where(F.col("ifg_ix").isin(left[k : k + batch])), store.read("uw_offsets")))
    solved = store.read(done)
    back = grid.restore(solve, placed, solved).select("ps_id", "ifg_ix", F.col("ph_uw").alias("ph"))
    full = phase.select("ps_id", "ifg_ix", "offset").join(back, ["ps_id", "ifg_ix"], "left").select("ps_id", "ifg_ix", F.coalesce(F.col("ph") + F.col("offset"), F.lit(0.0)).alias("ph"))
    return {"uw_cells": solved, "unwrapped": full}


def look_angle(store: Store, params: Params) -> dict[str, DataFrame]:
    """Stage 7: optional ramps, reference, slope and offset, smoothed over neighbours."""
    points, phase = store.read("scene"), store.read("unwrapped")
    ifgs = store.read("ifgs").join(store.read("ifg_std"), "ifg_ix", "left").na.fill({"std_deg": 0.0})
    if params.flag("scla_deramp"):
        phase = scene.deramped(phase, points).drop("ramp")
    centred = scene.centred(phase, scene.reference(points))
    terms = scene.look_angle_error(centred, ifgs)
    edges = weed.delaunay_edges(points.withColumn("patch_id", F.lit(0)))
    return {"scla_smooth": scene.neighbour_envelope(terms, edges), "scla": terms}


def noise(store: Store, params: Params) -> dict[str, DataFrame]:
    """Stage 8: space-time correlated noise."""
    points, ifgs = store.read("scene"), store.read("ifgs")
    terms = store.read("scla")
    scla = scene.smoothed_phase(terms, ifgs)
    clean = scene.without_terms(store.read("unwrapped"), scla, terms)
    first = points.agg(F.min_by("ps_id", "scene_id")).first()[0]
    return {"scn": scene.correlated_noise(clean, points, ifgs, params.scalar("scn_time_win", 365.0), params.scalar("scn_wavelength", 100.0), first)}


STAGES = {1: load_points, 2: estimate, 3: select, 4: weeding, 5: merging, 6: unwrapping, 7: look_angle, 8: noise}


def run(store: Store, config: RunConfig, source: dict[str, DataFrame]) -> DataFrame:
    """Runs stages in order; returns the run log (stage, status, seconds, detail); the first failure ends it."""
    params = Params({**config.params, "stage6_grid_scale": config.grid_scale})
    refuse(params)
    log, known = [], store.status()
    for stage in range(max(1, config.start_step), config.end_step + 1):
        began, status, detail = time.time(), "completed", ""
        if config.dry_run:
            status = "planned"
        elif config.resume and config.start_step == 0 and stage <= known:
            status = "skipped_existing"
        else:
            try:
                store.invalidate(stage)
                tables = STAGES[stage](store, params, source) if stage == 1 else STAGES[stage](store, params)
                store.write(tables, MARKERS[stage - 1])
            except Exception as error:
                status, detail = "failed", f"{type(error).__name__}: {error}"[:500]
        log.append((stage, status, time.time() - began, detail))
        if status == "failed":
            break
    return store.spark.createDataFrame(log, "stage int, status string, seconds double, detail string")
