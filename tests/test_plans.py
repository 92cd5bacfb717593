import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterlake.__main__ import main
from scatterlake.operators import network, verify
from scatterlake.plans import registry
from scatterlake.plans.config import Params, RunConfig, refuse
from scatterlake.plans.pipeline import run
from scatterlake.plans.store import MARKERS, Store, fingerprint
from scatterlake.streaming import acquisitions


def test_params_and_config():
    p = Params({"A": 1, "flag": "y", "ix": [0, 3, float("nan"), 1]}, {"a": 2})
    assert p.scalar("a") == 2 and p.flag("flag") and p.indices("ix") == [0, 2] and p.scalar("none", 5) == 5
    with pytest.raises(KeyError):
        p.scalar("none")
    with pytest.raises(ValueError):
        RunConfig.parse('{"root": "x", "wrong": 1}')
    with pytest.raises(ValueError):
        RunConfig.parse('{"root": "x", "start_step": 9}')
    assert RunConfig.parse('{"root": "x", "end_step": 2}').end_step == 2
    for bad in ({"small_baseline_flag": "y"}, {"scla_method": "L1"}, {"merge_resample_size": 5}, {"scn_kriging_flag": "y"}):
        with pytest.raises(ValueError):
            refuse(Params(bad))


def test_store_publishes_all_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    one = spark.range(3)
    store.write({"points": one, "phase": one}, "points")
    assert store.status() == 1 and store.read("phase").count() == 3
    bad = spark.range(2).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        store.write({"points": spark.range(9), "phase": bad}, "points")
    assert store.read("points").count() == 3 and store.status() == 1
    built = []
    for key in ("k1", "k1", "k2"):
        assert store.cached("t", key, lambda: built.append(1) or one).count() == 3
    assert len(built) == 2 and not store.exists("cache/t-k1")
    store.write({"fit": one, "scla_smooth": one, "selection": one})
    assert store.status() == 3 and sorted(store.invalidate(1)) == ["fit", "selection"] and store.exists("scla_smooth")
    assert [r.id for r in store.missing("points", spark.range(5), "id").orderBy("id").collect()] == [3, 4]
    assert fingerprint(spark.range(5)) == fingerprint(spark.range(5).orderBy(F.desc("id"))) != fingerprint(spark.range(6))


def source(spark, n=90, dates=10):
    rng = np.random.default_rng(2)
    base = rng.uniform(-120, 120, dates)
    rows, phase = [], []
    for p in range(n):
        x, y = rng.uniform(0, 3000, 2).tolist()
        rows.append((p, 1, 12 + x / 8e4, 45 + y / 1.1e5, 5.0, float(rng.uniform(0.1, 0.4))))
        k, v = rng.normal(0, 0.004), 2e-4 * x / 1000
        for d in range(dates):
            a = float(k * base[d] + v * 12 * d + rng.normal(0, 0.15 if p % 6 else 2.0))
            phase.append((p, d, math.cos(a), math.sin(a)))
    return {
        "points": spark.createDataFrame(rows, "ps_id long, patch_id int, lon double, lat double, height double, d_a double"),
        "phase": spark.createDataFrame(phase, "ps_id long, acq long, re double, im double"),
        "dates": spark.createDataFrame([(d, 12.0 * d + (d % 2), float(b)) for d, b in enumerate(base)], "acq long, day double, bperp double"),
    }


def test_stages_end_to_end(spark, tmp_path, capsys, monkeypatch):
    store = Store(spark, str(tmp_path / "run"))
    params = {"master_day": 50.5, "n_trial_wraps": 0.5, "random_samples": 2000, "clap_win": 4, "filter_grid_size": 200.0, "unwrap_grid_size": 400.0, "weed_standard_dev": 2.5, "scn_wavelength": 400.0}
    config = RunConfig(store.root, params=params)
    log = run(store, config, source(spark)).collect()
    assert [(r.stage, r.status) for r in log] == [(k, "completed") for k in range(1, 9)], log
    assert store.status() == 8 and all(store.exists(m) for m in MARKERS)
    chosen, again, first = (store.read(n) for n in ("selection", "fit_again", "fit"))
    assert chosen.count() == chosen.join(again, ["ps_id", "k", "c", "coh"]).where("coh > thresh").count() > 0
    assert again.count() < first.count() and chosen.join(first, ["ps_id", "coh"]).count() == 0  # refitted without their own cell
    scene, scn = store.read("scene"), store.read("scn")
    assert scene.count() > 40 and scn.count() == scene.count() * 11
    assert scn.where(F.isnan("ph_scn") | F.col("ph_scn").isNull()).count() == 0
    dry = run(store, RunConfig(store.root, dry_run=True, params=params), {}).collect()
    assert {r.status for r in dry} == {"planned"}
    again = run(store, RunConfig(store.root, start_step=0, params=params), {}).collect()
    assert {r.status for r in again} == {"skipped_existing"}
    calls, solve = [], network.solve

    def breaking(*of):
        calls.append(of[1].select("ifg_ix").distinct().count())
        if len(calls) == 2:
            raise OSError("lost")
        return solve(*of)

    monkeypatch.setattr(network, "solve", breaking)  # the smoothed terms feed back, so every date is solved anew; the second batch breaks
    step = RunConfig(store.root, 6, 6, params=params)
    assert run(store, step, {}).first()["status"] == "failed"
    assert run(store, step, {}).first()["status"] == "completed" and len(calls) > 2 and sum(calls) - calls[1] == 10
    known = len(calls)
    assert run(store, step, {}).first()["status"] == "completed" and len(calls) == known
    assert store.read("unwrapped").count() == scene.count() * 11
    assert run(store, RunConfig(store.root, 3, 3, params=params), {}).first()["status"] == "completed" and store.status() == 3
    failed = run(store, RunConfig(store.root, 6, 8, params=params), {}).collect()
    assert [r.status for r in failed] == ["failed"]
    assert main(["status", store.root], spark) == 0 and capsys.readouterr().out.strip() == "3"
    assert main(["describe"], spark) == 0 and "topofit" in capsys.readouterr().out


def test_command_line_run_and_verify(spark, tmp_path, capsys):
    for name, frame in source(spark, 20, 6).items():
        frame.write.parquet(f"{tmp_path}/src/{name}")
    config = {"root": f"{tmp_path}/out", "end_step": 1, "params": {"master_day": 30.5}}
    assert main(["run", json.dumps(config), "--source", f"{tmp_path}/src"], spark) == 0
    assert json.loads(capsys.readouterr().out)["status"] == "completed"
    rows = [("a", "K_ps", k, float(k), 0.0) for k in range(5)]
    spark.createDataFrame(rows, "artifact string, key string, pos long, re double, im double").write.parquet(f"{tmp_path}/g")
    spark.createDataFrame([(*r[:3], r[3] + (r[2] == 4), 0.0) for r in rows], "artifact string, key string, pos long, re double, im double").write.parquet(f"{tmp_path}/r")
    assert main(["verify", f"{tmp_path}/g", f"{tmp_path}/g"], spark) == 0
    assert main(["verify", f"{tmp_path}/r", f"{tmp_path}/g"], spark) == 1


def test_verifier_rules(spark):
    schema = "artifact string, key string, pos long, re double, im double"
    golden = spark.createDataFrame([("a", "C_ps", 0, 1.0, 0.0), ("a", "z", 0, 1.0, 2.0), ("a", "n", 0, math.nan, 0.0), ("a", "gone", 0, 1.0, 0.0), ("a", "i", 0, math.inf, 0.0)], schema)
    mine = spark.createDataFrame([("a", "C_ps", 0, 1.0 + 4 * math.pi, 0.0), ("a", "z", 0, 1.0, 2.1), ("a", "n", 0, math.nan, 0.0), ("a", "i", 0, math.inf, 0.0)], schema)
    out = {r.key: r.passed for r in verify.compared(mine, golden, verify.Policies(wrap_keys=verify.SCIENTIFIC_WRAP).table(spark)).collect()}
    assert out == {"C_ps": True, "z": False, "n": True, "gone": False, "i": True}


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    for k in range(3):
        rows = [(f"a{k}{j}", int(p), float(1 + 0.1 * rng.random())) for j in range(2) for p in range(20)]
        spark.createDataFrame(rows, acquisitions.SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = acquisitions.follow(spark, f"{tmp_path}/in", f"{tmp_path}/sums", f"{tmp_path}/ck", maxFilesPerTrigger=1).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.pixel: round(r.d_a, 9) for r in acquisitions.current(spark, f"{tmp_path}/sums").collect()}
    from scatterlake.operators import prep

    all_rows = spark.read.parquet(f"{tmp_path}/in")
    want = {r.pixel: round(r.d_a, 9) for r in prep.candidates(prep.dispersion(all_rows, prep.calibration(all_rows))).collect()}
    assert got == want and len(got) == 20


def test_kernels_and_sql_functions(spark):
    k = registry.default_kernels()
    k.add("topofit", lambda: 1, "other", "fit")
    assert k.get("fit", "other")() == 1 and k.get("topofit", "missing") is k.get("topofit")
    with pytest.raises(KeyError):
        k.get("nothing")
    registry.register_sql(spark)
    row = spark.sql("SELECT wrap_phase(7.0D) AS w, phase_fit(array(1.0D, 1.0D, 1.0D), array(0.0D, 0.0D, 0.0D), array(0.0D, 5.0D, 9.0D), 1.0D) AS f").first()
    assert abs(row.w - (7 - 2 * math.pi)) < 1e-12 and abs(row.f.k) < 1e-9 and abs(row.f.coh - 1) < 1e-12
