import numpy as np
import pytest
from pyspark.sql import functions as F

from scatterlake.llm import ann


def brute(rows, k=5, step=50):
    good = {}
    dim = max({len(v) for _, v in rows if v}, key=lambda d: sum(len(v or []) == d for _, v in rows), default=0)
    for i, v in rows:
        if i is None or v is None or len(v) != dim or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = min(good.get(i, v), v)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids], float)
    out = {}
    for i in ids[ids % step == 0]:
        a = x[ids == i][0]
        s = (x * a).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((a * a).sum()))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def result(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, list long, unit int").repartition(3)
    out = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies"])
def test_recall_and_scores(spark, kind, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 300)
    monkeypatch.setattr(ann, "BLOCK", 4)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    if kind == "clustered":
        x = (x * 0.3 + rng.standard_normal((20, 32))[rng.integers(0, 20, 3000)]).astype(np.float32)
    if kind == "copies":
        x[::3] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    want, got = brute(rows), result(spark, rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.93 * 5 * len(want)
    known = {q: dict(brute_scores) for q, brute_scores in want.items()}
    assert all(abs(s - known[q][i]) < 1e-12 for q in got for i, s in got[q] if i in known[q])
    if kind == "copies":
        assert [i for i, _ in got[1500]] == [0, 3, 6, 9, 12] and [i for i, _ in got[0]] == [3, 6, 9, 12, 15]


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.standard_normal(8).astype(np.float32)]) for i in range(120)]
    rows += [(150, None), (200, [0.0] * 8), (250, [1.0, None] * 4), (300, [float("nan")] * 8), (350, [float("inf")] * 8), (400, [1.0, 2.0]), (None, [1.0] * 8), (50, rows[50][1]), (450, [])]
    want, got = brute(rows), result(spark, rows)
    assert got.keys() == want.keys() == {0, 50, 100}
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_few_and_none(spark):
    assert result(spark, [(0, [1.0, 0.0]), (7, [2.0, 2.0])]) == {0: [(7, pytest.approx(2**-0.5))]}
    assert result(spark, []) == {}


def test_small_cells_still_give_k(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ann, "centres", lambda x, lists: x[::2])
    monkeypatch.setattr(ann, "probes", lambda x, c, k: seen.append(x) or 1)
    x = np.random.default_rng(3).standard_normal((301, 16)).astype(np.float32)
    x[200:240] = x[7]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    want, got = brute(rows), result(spark, rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert len(np.unique(seen[0], axis=0)) == len(seen[0]) == 261
    assert len(result(spark, rows[:4])[0]) == 3


def test_scan_keeps_the_first_ones_in_large_blocks():
    import numpy as np

    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((9000, 8)), rng.standard_normal((1000, 8))
    at, ids, score = ann.scan(x, np.arange(9000), q, 6, ann.rotation(8))
    assert np.array_equal(np.bincount(at, minlength=1000), np.full(1000, 6))
    true = np.sort((ann.unit(q) @ ann.unit(x).T), axis=1)[:, -6:]
    assert (np.abs(np.sort(score.reshape(1000, 6), axis=1) - true) < 1e-9).mean() > 0.97
