import random

import corpus_pipeline
from scatterlake.llm import pieces, quality
from tests.llm import test_decontaminate, test_forest, test_suffix


def tables(spark, path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(["the", "ing", "er", "é", "on", "tion"]) for _ in range(rnd.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(30)) for k in range(10)]
    passage = text(60)
    docs = []
    for d in range(260):
        t, kind = text(rnd.randrange(20, 120)), rnd.random()
        if kind < 0.2:
            t = " | ".join(t.upper().split()) + " !!"
        elif kind < 0.3 and docs:
            t = docs[rnd.randrange(len(docs))][1]
        elif kind < 0.4 and docs:
            words = docs[rnd.randrange(len(docs))][1].split()
            words[rnd.randrange(len(words))] = "zz"
            t = " ".join(words)
        elif kind < 0.55:
            t += " " + passage + " " + text(5)
        elif kind < 0.65:
            t += "\n" + items[rnd.randrange(10)][1] + "\n" + text(9)
        docs.append((d, t, "en", "src", len(t), int(kind >= 0.2)))
    docs += [(900, None, None, None, None, 1), (901, "", "en", "s", 0, 1)]
    spark.createDataFrame([r[:5] for r in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], r[5], 0) for r in docs if r[0] < 900], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return items


def test_every_stage_against_brute_force(spark, tmp_path):
    items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = columns = None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        rows = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            columns = docs.columns
            kept = {r.doc_id for r in quality.op10_quality(spark, str(tmp_path)).collect() if r.predicted}
            want = {d: t for d, t in rows.items() if d in kept}
            assert 0 < len(want) < len(rows)
        elif k == 1:
            want = {d: rows[d] for d, c, *_ in test_forest.expected(list(rows.items())) if d == c}
            assert len(want) < len(rows)
        elif k == 2:
            marks = test_suffix.brute(list(rows.items()))
            want = {d: t if t is None else "".join(c for c, m in test_suffix.chars(t.encode(), marks[d]) if not m) for d, t in rows.items()}
            assert want != rows
        elif k == 3:
            leaked = {d for d, _, _ in test_decontaminate.expected(list(rows.items()), items)}
            want = {d: t for d, t in rows.items() if d not in leaked}
            assert leaked
        else:
            got = {r.doc_id: r for r in out.collect()}
            assert got.keys() == rows.keys() and all(r.lossless for r in got.values())
            back = {r.doc_id: r.text for r in pieces.decoded(out).collect()}
            assert back == rows
            before = {d: r.ids for d, r in got.items()}
            break
        assert out.columns == columns
        got = {r.doc_id: r.text for r in out.collect()}
        assert got == want, name
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
    whole = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == before


def test_empty(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
