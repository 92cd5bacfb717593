import random

import numpy as np
import pyarrow as pa
import pytest

from scatterlake.llm import pieces, textops

TEXTS = [None, "", " ", "  a  b ", "\n\nx\ty", "日本語 🎉 test", "a" * 300 + " " + "hello" * 200, "x y  \r\n z", "ÉTÉ!! | ### 4785380592391139", " lead and trail "]


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def texts(n=120):
    rnd = random.Random(9)
    parts = ["the", "tion", "über", "ñandú", " ", "  ", "\n", "42", "!!", "ing", "é", "\t", "un", "believ", "able"]
    return TEXTS[1:] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(200))) for _ in range(n)]


def run(model, rows, **how):
    out = []
    for lo, hi, buf, offs in textops.slices(pa.array(rows, pa.string())):
        ids, at = pieces.encode(model, buf, offs, np.arange(lo, hi), **how)
        data, ends = pieces.decode(model, ids, at)
        assert np.array_equal(data, buf) and np.array_equal(ends, offs)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


def test_without_dropout_equals_the_library(model):
    import sentencepiece

    assert run(model, texts(), rate=0.0) == sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).encode(texts())


def test_dropout_round_trip_and_heap_agree(model, monkeypatch):
    rows = [*texts(), "▁a▁ b"]
    wide = run(model, rows, rate=0.3)
    monkeypatch.setattr(pieces, "LONG", 0)
    assert run(model, rows, rate=0.3) == wide


def test_seeds_vary_and_repeat(model):
    rows = texts()
    assert run(model, rows, seed=1) == run(model, rows, seed=1) != run(model, rows, seed=2)
    assert sum(map(len, run(model, rows, rate=0.5))) > sum(map(len, run(model, rows, rate=0.0)))
    assert max(map(len, run(model, ["information"], rate=1.0))) == 12


def test_frames(spark, model):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")]
    frame = spark.createDataFrame([(d, t, [1]) for d, t in rows], "doc_id long, text string, ids array<int>").repartition(3)
    out = pieces.encoded(frame, model)
    got = out.collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert [r.ids for r in got if r.doc_id == 0] == [None] and [r.ids for r in got if r.doc_id == 1] == [[]]
    back = sorted((tuple(r) for r in pieces.decoded(out, model).collect()), key=str)
    assert back == sorted(rows, key=str)
    assert pieces.encoded(frame.limit(0), model).count() == 0


def test_every_occurrence_draws_on_its_own(model, monkeypatch):
    rows = ["information " * 3000, "information " * 3000]
    got = run(model, rows)
    cut = lambda ids: pieces.decode(model, np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes()
    found = set()
    for ids in got:
        word: list = []
        for i in ids:
            if word and model["data"][model["start"][i]] == 32:
                found.add(tuple(word))
                word = []
            word.append(i)
    assert len(found) > 20 and got[0] != got[1] and cut(got[0]) == rows[0].encode()
    few = run(model, [x[:2400] for x in rows])
    monkeypatch.setattr(pieces, "LONG", 0)
    assert run(model, [x[:2400] for x in rows]) == few
