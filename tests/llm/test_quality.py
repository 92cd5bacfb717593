import random
import zlib

import numpy as np

from scatterlake.llm import quality


def corpus(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["the", "ing", "er", "é", "on"]) for _ in range(rnd.randrange(1, 4)))
    rows = []
    for d in range(n):
        words = [word() for _ in range(rnd.randrange(2, 80))]
        good = rnd.random() < 0.7
        if not good:
            words = rnd.choice([lambda: [w.upper() + "!!" for w in words], lambda: [x for w in words for x in (w, "|")], lambda: [w + rnd.choice(["$$$", "###"]) for w in words]])()
        rows.append((d, " ".join(words), int(good)))
    return rows


def write(spark, path, rows, odd=()):
    spark.createDataFrame([(d, t, "en", 0.5, 7) for d, t, _ in rows] + [(d, t, "en", 0.5, 7) for d, t in odd], "doc_id long, text string, lang string, score double, y int").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_held_out_accuracy_and_defined_rows(spark, tmp_path):
    rows = corpus(700, 1)
    odd = [(9000, None), (9001, ""), (None, "the thing"), (3, rows[3][1])]
    write(spark, tmp_path, rows, odd)
    got = quality.op10_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score
    held = [(by[d].predicted, q) for d, _, q in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(by[d].held_out for d, _, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2)
    assert np.mean([a == b for a, b in held]) > 0.95
    documents = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = quality.keep_good(spark, documents, str(tmp_path))
    assert kept.columns == documents.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_scores_are_sparse_dot_products():
    texts = ["Is the THE thing?? 42 é", "", "one"]
    weights = np.random.default_rng(0).standard_normal(1 << quality.BITS)
    import pyarrow as pa

    from scatterlake.llm import textops

    for _, _, buf, offs in textops.slices(pa.array(texts)):
        grams, at = quality.features(buf, offs)
        want = [100 * np.mean([weights[g] for g in grams[a:b]]) if b > a else 0.0 for a, b in zip(at[:-1], at[1:])]
        assert np.allclose(quality.text_sums(weights, grams, at), want)
        assert at[2] - at[1] == 0 and at[3] - at[2] == 2


def test_without_labels_and_empty(spark, tmp_path):
    write(spark, f"{tmp_path}/a", corpus(5, 2))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/a/labels.parquet")
    assert {r.score for r in quality.op10_quality(spark, f"{tmp_path}/a").collect()} == {0.5}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert quality.op10_quality(spark, f"{tmp_path}/b").count() == 0
