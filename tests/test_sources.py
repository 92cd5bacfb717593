import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterlake.sources import mat, raster, stack


def test_mat_round_trip():
    values = {
        "a": np.arange(6.0).reshape(2, 3), "f": np.float32([[1.5]]), "z": np.array([[1 + 2j, 3 - 1j]]), "zf": np.array([[1 + 2j]], np.complex64), "i": np.array([[1, -2]], np.int16), "u": np.array([[7]], np.uint64),
        "b": np.array([[True, False]]), "s": "größe", "e": np.zeros((0, 0)), "st": {"x": np.array([[1.0]]), "y": "n"}, "c": np.array([np.ones((1, 2)), np.zeros((2, 1))], object).reshape(1, 2),
    }
    for compress in (True, False):
        back = mat.loads(mat.dumps(values, compress))
        assert back.keys() == values.keys()
        for k, v in values.items():
            if isinstance(v, str):
                assert back[k] == v
            elif isinstance(v, dict):
                assert back[k]["y"] == "n" and back[k]["x"] == 1
            elif v.dtype == object:
                assert all(np.array_equal(a, b) for a, b in zip(back[k].ravel(), v.ravel()))
            else:
                assert back[k].dtype == v.dtype and np.array_equal(back[k], v)
    with pytest.raises(NotImplementedError):
        mat.loads(b"\x89HDF\r\n\x1a\n" + b"\0" * 600)
    with pytest.raises(ValueError):
        mat.loads(b"nothing" * 40)
    assert mat.row_to_column(mat.column_to_row(np.arange(6), 2, 3), 2, 3).tolist() == list(range(6))


def test_mat_source(spark, tmp_path):
    (tmp_path / "pm1.mat").write_bytes(mat.dumps({"K_ps": np.array([[1.0], [2.0]]), "name": "y"}))
    (tmp_path / "parms.mat").write_bytes(mat.dumps({"lambda": np.array([[0.0555]])}))
    spark.dataSource.register(mat.MatSource)
    want = {("pm1.mat", "K_ps", 0, 1.0), ("pm1.mat", "K_ps", 1, 2.0), ("pm1.mat", "name", 0, None), ("parms.mat", "lambda", 0, 0.0555)}
    for frame in (spark.read.format("mat").load(str(tmp_path)), mat.read_mat(spark, str(tmp_path))):
        assert {(r.file, r.key, r.pos, r.re) for r in frame.collect()} == want


def test_rasters_text_and_parameters(spark, tmp_path):
    z = (np.arange(12) + 1j * np.arange(12)[::-1]).astype(">c8")
    (tmp_path / "a.rslc").write_bytes(z.tobytes())
    got = raster.read_raster(spark, f"{tmp_path}/a.rslc", 4, "c64")
    assert {(r.row, r.col, r.re, r.im) for r in got.collect()} == {(i // 4, i % 4, float(i), float(11 - i)) for i in range(12)}
    (tmp_path / "out").mkdir()
    raster.write_raster(got, f"{tmp_path}/out", 4, "c64")
    assert (tmp_path / "out/a.rslc").read_bytes() == z.tobytes()
    (tmp_path / "t.ij").write_text("1 2 3\n\n 4  5 6 \n")
    assert [(r.line, r.a, r.c) for r in raster.text_matrix(spark, f"{tmp_path}/t.ij", ["a", "b", "c"]).orderBy("line").collect()] == [(0, 1.0, 3.0), (1, 4.0, 6.0)]
    with pytest.raises(Exception, match="other than 2"):
        raster.text_matrix(spark, f"{tmp_path}/t.ij", ["a", "b"]).collect()
    (tmp_path / "m.par").write_text("title: x\nheading:  -168.5 degrees\nradar_frequency: 5.405e+09 Hz\nrange_samples: 4\nazimuth_lines: 3\n")
    s = stack.sensor(spark, f"{tmp_path}/m.par")
    assert s["heading"] == -168.5 and abs(s["lambda"] - 0.0554658) < 1e-6 and (s["width"], s["length"]) == (4, 3)
    assert raster.phase_matrix(z.tobytes(), 3).shape == (3, 4)
    assert raster.master_of("/x/INSAR_20200113", []) == 20200113
    assert raster.master_of("/x/y", ["20200101_20200113.diff", "20200113_20200125.diff"]) == 20200113
    with pytest.raises(ValueError):
        raster.master_of("/x/y", ["20200101_20200113.diff"])


def test_prepare_a_stack(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "rslc").mkdir()
    (tmp_path / "geo").mkdir()
    base = rng.uniform(1, 2, 30)
    for k in range(6):
        amp = base * np.where(np.arange(30) % 5 == 0, rng.uniform(0.01, 3, 30), 1)
        (tmp_path / f"rslc/2020010{k}.rslc").write_bytes((amp * np.exp(1j * rng.uniform(-3, 3, 30))).astype(">c8").tobytes())
    for name, v in (("m.lon", 12 + np.arange(30) / 1e4), ("m.lat", 45 + np.arange(30) / 1e4), ("elevation_dem.rdc", np.where(np.arange(30) == 7, np.nan, 5.0))):
        (tmp_path / "geo" / name).write_bytes(v.astype(">f4").tobytes())
    got = stack.prepare(spark, str(tmp_path), 6, 2, 1, 1)
    pixels = {r.row * 6 + r.col for r in got.collect()}
    assert 7 not in pixels and {p for p in range(30) if p % 5 and p != 7} <= pixels
    shared = got.groupBy("row", "col").agg(F.count("*").alias("n"), F.sum(F.col("owned").cast("int")).alias("own")).collect()
    assert all(r.own == 1 and r.n == (2 if r.col in (2, 3) else 1) for r in shared)


def test_patch_folders(spark, tmp_path):
    for n in (10, 2, 1):
        (tmp_path / f"PATCH_{n}").mkdir()
    assert stack.patches(spark, str(tmp_path)) == ["PATCH_1", "PATCH_2", "PATCH_10"]
    (tmp_path / "patch.list").write_text("PATCH_10\nPATCH_1\n")
    assert stack.patches(spark, str(tmp_path)) == ["PATCH_10", "PATCH_1"]
    (tmp_path / "patch.list").write_text("../x\n")
    with pytest.raises(ValueError):
        stack.patches(spark, str(tmp_path))


def test_candidate_files(spark, tmp_path):
    d = tmp_path / "PATCH_3"
    d.mkdir()
    (d / "pscands.1.ij").write_text("1 0 4\n2 7 9\n")
    (d / "pscands.1.ll").write_bytes(np.array([12.0, 45.0, 12.5, 45.5], ">f4").tobytes())
    (d / "pscands.1.hgt").write_bytes(np.array([3.0, 4.0], ">f4").tobytes())
    (d / "pscands.1.da").write_text("0.25\n0.30\n")
    (d / "pscands.1.ph").write_bytes(np.array([1, 2, 3, 4, 5, 6], ">c8").tobytes())
    points, phase = stack.candidates(spark, str(tmp_path), "PATCH_3", 2)
    assert {(r.ps_id, r.row, r.col, r.lon, r.height, r.d_a, r.patch_id) for r in points.collect()} == {(1, 0, 4, 12.0, 3.0, 0.25, 3), (2, 7, 9, 12.5, 4.0, 0.3, 3)}
    assert {(r.ps_id, r.acq, r.re) for r in phase.collect()} == {(1, 1, 1.0), (2, 1, 2.0), (1, 2, 3.0), (2, 2, 4.0), (1, 3, 5.0), (2, 3, 6.0)}
