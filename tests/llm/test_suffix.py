import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from scatterlake.llm import suffix, textops


def brute(texts):
    """Marks of every byte by the definition, over (doc_id, text) in order."""
    seen, out = {}, {}
    for doc, text in sorted(texts):
        raw = (text or "").encode()
        marks = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                marks[s : s + 100] = b"\1" * 100
            else:
                seen[w] = (doc, s)
        out[doc] = marks
    return out


def expected(texts):
    rows = {}
    for doc, marks in brute(texts).items():
        raw = (dict(texts)[doc] or "").encode()
        runs = sum(1 for i, m in enumerate(marks) if m and (i == 0 or not marks[i - 1]))
        rows[doc] = (len(raw), sum(marks), runs, hashlib.sha256(bytes(b for b, m in zip(raw, marks) if not m)).hexdigest())
    return rows


def fixture(seed, n=60):
    rnd = random.Random(seed)
    words = ["the", "été", "lion", "über", "re", "of", "tion", "and", "ñandú", "wh"]
    text = lambda k: " ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(k))
    shared, line = text(60), text(12)[:90]
    out = []
    for i in range(n):
        t = text(rnd.randrange(5, 90))
        if rnd.random() < 0.4:
            t += shared[rnd.randrange(60) :]
        if rnd.random() < 0.5:
            t = line + t
        if rnd.random() < 0.2 and out:
            t = out[rnd.randrange(len(out))][1] or ""
        if rnd.random() < 0.2 and out:
            b = list(out[rnd.randrange(len(out))][1] or "x")
            b[rnd.randrange(len(b))] = "#"
            t = "".join(b)
        out.append((i * 3 + 1, t))
    return [*out, (1000, None), (1001, ""), (1002, "a" * 700), (1003, "ab" * 300), (1004, "a" * 99), (1005, "é" * 200), (1006, shared * 3)]


@pytest.mark.parametrize("held", [2000, 3])
def test_matches_definition(spark, tmp_path, monkeypatch, held):
    texts = fixture(held)
    monkeypatch.setattr(suffix.removed_spans, "__defaults__", (held,))
    spark.createDataFrame([Row(doc_id=d, text=t, source="s", spans=1, h=2) for d, t in texts]).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.op4_suffix(spark, str(tmp_path)).collect()}
    assert got == expected(texts)


def test_long_texts_go_in_parts(spark, tmp_path, monkeypatch):
    texts = fixture(11)
    monkeypatch.setattr(textops.slices, "__defaults__", (1, False))
    parts, whole = [], []
    for out, size in ((parts, 50), (whole, 1 << 20)):
        monkeypatch.setattr(suffix, "PART", size)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in texts]), pa.array([t for _, t in texts])], names=["doc_id", "text"])
        for found in suffix._scan([batch]):
            for r in found.to_pylist():
                if r["p"] % 256:
                    out.extend((r["doc_id"], (r["p"] >> 8) + k) for k in range(r["p"] % 256))
                else:
                    out.extend((r["doc_id"], k) for k in range(r["p"] >> 8, r["c"] - 99))
    every = {(d, s) for d, t in texts for s in range(len((t or "").encode()) - 99)}
    assert set(parts) == every == set(whole)


def test_repeated_rows_and_nulls(spark):
    long = "x1 y2 " * 3 + " ".join(map(str, range(200)))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, None)]
    out = suffix.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 5
    assert {r.doc_id for r in out if r.removed_spans} == {2}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert suffix.op4_suffix(spark, str(tmp_path)).count() == 0


def test_stage_keeps_valid_text(spark):
    texts = [(d, t) for d, t in fixture(5) if t is not None]
    docs = spark.createDataFrame([(d, t, "s", len(t)) for d, t in texts], "doc_id long, text string, source string, n_chars long")
    out = suffix.cut_repeats(spark, docs, "")
    assert out.columns == docs.columns
    marks = brute(texts)
    for r in out.collect():
        raw = dict(texts)[r.doc_id].encode()
        whole = "".join(c for c, m in chars(raw, marks[r.doc_id]) if not m)
        assert r.text == whole and r.n_chars == len(whole)


def chars(raw, marks):
    at = 0
    for c in raw.decode():
        n = len(c.encode())
        yield c, all(marks[at : at + n])
        at += n


def test_maximal_repeats_list_all_occurrences():
    a = bytes(range(65, 91)) * 5
    data = a + b"!" + a + b"?" + a[:110]
    first, count = np.array([0, 131, 262]), np.array([31, 31, 11])
    found = [(n, d, s) for n, d, s in suffix.maximal_repeats(np.frombuffer(data, np.uint8), first, count, np.array([1, 2, 3]), np.zeros(3, np.int64), np.zeros(3, np.int64))]
    assert any(n == 130 and d == [1, 2] for n, d, s in found)
    assert any(n == 110 and {1, 2, 3} <= {*d} for n, d, s in found)
    assert all(data.count(b"!") for _ in found)
    assert textops.SHINGLE_WORDS == 5


def test_windows_under_one_hash_are_told_apart(monkeypatch):
    """Every window gets the same 64-bit hash; the repeats are those that the bytes show."""
    import numpy as np

    rnd = random.Random(9)
    texts = ["".join(rnd.choice("abcd") for _ in range(130)) for _ in range(4)]
    texts += [texts[0][:125] + "xyzxy", texts[1]]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    n = len(texts)
    columns = np.arange(n) * 130, np.full(n, 31), np.arange(n), np.zeros(n, np.int64), np.array([7, 7, 7, 7, 7, 8])
    want = sorted(suffix.maximal_repeats(data, *columns))
    real = suffix.textops.span_hash
    monkeypatch.setattr(suffix.textops, "span_hash", lambda *a: np.zeros_like(real(*a)))
    assert sorted(suffix.maximal_repeats(data, *columns)) == want
    assert (125, [0, 4], [0, 0]) in want and not any(5 in docs for _, docs, _ in want)
