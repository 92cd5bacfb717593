import itertools
import random
import zlib

import numpy as np

from scatterlake.llm import language

PARTS = {"en": ["the", "ing", "th", "er", "and", "on"], "fr": ["é", "eau", "le", "que", "oi", "tion"], "de": ["ung", "sch", "ein", "ß", "ch", "keit"]}


def word(rnd, lang):
    return "".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randrange(1, 4)))


def corpus(n, seed):
    rnd = random.Random(seed)
    out = []
    for d in range(n):
        lang = rnd.choice(list(PARTS))
        other = rnd.choice(list(PARTS))
        text = [word(rnd, lang) for _ in range(rnd.randrange(3, 150))] + [word(rnd, other) for _ in range(rnd.choice([0, 0, 2]))]
        out.append((d, " ".join(text).capitalize() + ".", lang))
    return out


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    score, length, tr = rng.standard_normal((3, 5, 3)), np.array([5, 3, 1]), rng.standard_normal((3, 3))
    post = language.forward_backward(score, length, tr)[0]
    for c, n in enumerate(length):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(score[c, t, y] for t, y in enumerate(path)) + sum(tr[a, b] for a, b in zip(path, path[1:])))
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose(post[c, :n], want / want.sum(axis=1, keepdims=True))


def test_held_out_accuracy_and_defined_rows(spark, tmp_path):
    rows = corpus(500, 1)
    odd = [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !? 42", "de"), (1003, "é", None), (None, "the thing and", "en"), (1004, "Γειά", "en"), (5, rows[5][1], rows[5][2])]
    frame = spark.createDataFrame([(d, t, lang, "x", 3) for d, t, lang in rows + odd], "doc_id long, text string, lang string, score string, place int")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = language.op7_language(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002))
    held = [(by[d].lang_pred, lang) for d, _, lang in rows if by[d].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(r.lang_pred in {*PARTS, "und"} and 0 <= r.score <= 1 for r in got)


def test_code_switched_words():
    rows = corpus(300, 2)
    model = language.fit([t for _, t, _ in rows], [lang for *_, lang in rows])
    rnd = random.Random(3)
    text = [(word(rnd, lang), lang) for lang in ["en"] * 12 + ["de"] * 12 + ["fr"] * 12]
    found = language.label_words(model, " ".join(w for w, _ in text))
    assert np.mean([a[1] == b[1] for a, b in zip(found, text, strict=True)]) > 0.85


def test_nothing_to_learn(spark, tmp_path):
    spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.lang_pred for r in language.op7_language(spark, str(tmp_path)).collect()] == ["und"]
    spark.createDataFrame([], "doc_id long, text string, lang string").write.mode("overwrite").parquet(f"{tmp_path}/empty/documents.parquet")
    assert language.op7_language(spark, f"{tmp_path}/empty").count() == 0


def test_long_texts_are_labelled_like_one_chain():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "and", "house"] if k % 2 else ["der", "und", "haus"]) for _ in range(40)) for k in range(60)]
    model = language.fit(texts, ["en" if k % 2 else "de" for k in range(60)])
    long = " ".join(rnd.choice(["the", "and", "house", "und", "zzz", "42x"]) for _ in range(50_000))
    _, _, buf, offs = next(language.textops.slices(pa.array([long])))
    sums, n = language.posterior_sums(model, buf, offs)
    starts, ends, at = language.words(buf, offs)
    score = language.emissions(model["weights"], *language.features(buf, starts, ends))
    whole = language.forward_backward(score[None], np.array([len(starts)]), model["transition"])[0][0]
    assert n[0] == len(starts) and np.allclose(sums[0] / n, whole.sum(axis=0) / n, atol=2e-3)
    parts = [language.chains(at, 64, 12)]
    covered = np.concatenate([np.arange(f + b, f + e) for f, _, _, b, e in zip(*parts[0], strict=True)])
    assert sorted(covered.tolist()) == list(range(len(starts)))
