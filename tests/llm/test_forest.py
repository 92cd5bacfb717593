import random
import re

import pytest

from scatterlake.llm import components, forest, similar


def sets(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def expected(rows, threshold=0.8):
    texts = {}
    for d, t in rows:
        texts.setdefault(t or "", []).append(d)
    keys = list(texts)
    grams = [sets(t) for t in keys]
    near = [[j for j in range(len(keys)) if j != i and jaccard(grams[i], grams[j]) >= threshold] for i in range(len(keys))]
    label = list(range(len(keys)))
    for _ in keys:
        for i in range(len(keys)):
            label[i] = min([label[i], *(label[j] for j in near[i])])
    out = []
    for i, t in enumerate(keys):
        members = [d for j in range(len(keys)) if label[j] == label[i] for d in texts[keys[j]] if d is not None]
        out += [(d, min(members, default=None), len(near[i]), len(texts[t])) for d in texts[t]]
    return sorted(out, key=str)


def fixture(seed=1):
    rnd = random.Random(seed)
    base = [" ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(3, 80))) for _ in range(40)]
    rows = list(enumerate(base))
    for k in range(120):
        words = base[rnd.randrange(12)].split()
        for _ in range(rnd.randrange(0, 3)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(900)}"
        rows.append((100 + k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "!!! ???"), (303, "Été"), (304, "été!"), (305, base[0]), (305, base[0]), (None, base[1])]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = fixture()
    frame = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, node int").repartition(3)
    want = expected(rows)
    for nodes, shingles, sampled, free in ((512, 1_000_000, 64, 16), (4, 200, 1, 2)):
        monkeypatch.setattr(similar, "BLOCK_NODES", nodes)
        monkeypatch.setattr(similar, "VERIFY_NODES", nodes)
        monkeypatch.setattr(similar, "BLOCK_SHINGLES", shingles)
        monkeypatch.setattr(similar, "STRIP", 2 * nodes - 1)
        monkeypatch.setattr(similar, "SAMPLED", sampled)
        monkeypatch.setattr(similar, "CROWDED", 10)
        monkeypatch.setattr(forest, "FREE", free)
        got = sorted((tuple(r) for r in forest.join_classes(frame).collect()), key=str)
        assert got == want


def test_blocks_of_near_copies_hold_bounded_matrices():
    """6,000 near copies of one short text, two blocks of a component, in one unit."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n = 2 * similar.VERIFY_NODES
    sets = [np.append(np.arange(36), 1000 + k).astype(np.int64).tobytes() for k in range(n)]
    column = lambda x: pa.array(np.asarray(x, np.int64))
    unit = pa.RecordBatch.from_arrays([column([1] * n), column(np.arange(n)), column([9] * n), column(np.arange(n) % 2), column([0] * n), column([1] * n), pa.array(sets, pa.binary())], names=["unit", "node", "blocks", "mine", "i", "j", "set"])
    tracemalloc.start()
    (got,) = list(similar._verify(0.8)(iter([unit])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = got.to_pylist()
    assert all(r["n"] == n // 2 for r in rows if r["kind"] == 1) and sum(r["kind"] == 1 for r in rows) == n
    assert sum(r["kind"] == 2 for r in rows) == n - 1 and peak < 600 * 2**20


def test_very_long_text_and_short_ones(spark):
    rnd = random.Random(6)
    long = [f"v{rnd.randrange(10**6)}" for _ in range(200_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:100_000], "x", *long[100_000:]])), (3, " ".join(long[:100_000])), (4, "a b"), (5, "A, b!")]
    got = {r.doc_id: r.class_id for r in forest.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_stage_keeps_one_of_each_class(spark):
    rows = fixture(2)
    frame = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    kept = forest.keep_one(spark, frame, "")
    assert kept.columns == frame.columns
    want = sorted({d for d, c, *_ in expected(rows) if d is not None and d == c})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_empty(spark):
    assert forest.join_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prefixes_are_shortened_to_the_recall():
    import numpy as np

    recall = lambda steps: 1 - np.prod(1 - 0.8 ** (forest.ROOT + np.append(steps, [0] * (forest.TREES - len(steps)))))
    rnd = np.random.default_rng(2)
    for trees in (0, 1, 7, 20):
        for top in (5, 300, 10_000):
            counts = np.sort(rnd.integers(1, top, (trees, 3)), axis=1)[:, ::-1]
            steps = forest.shortened(counts)
            assert recall(steps) >= forest.RECALL
            if top == 5:
                assert not steps.any()  # rare prefixes go up to the root
    crowded = np.tile([5000, 2000, 1000], (20, 1))
    assert forest.shortened(crowded).sum() > 0 and recall(forest.shortened(crowded)) < 0.9999
    assert recall(np.full(20, 2)) < forest.RECALL  # whole labels alone would not do


def test_pairs_at_the_threshold_are_found(spark):
    """Recall of pairs of similarity 0.8 to 0.85 among unrelated texts that share a stock beginning."""
    rnd = random.Random(12)
    stock, rows, pairs = [f"s{k}" for k in range(40)], [], []
    for k in range(150):
        w = [f"u{rnd.randrange(10**6)}" for _ in range(60)]
        v = w[: len(w) - rnd.choice([9, 10])] + [f"u{rnd.randrange(10**6)}" for _ in range(2)]
        a, b = " ".join(stock + w), " ".join(stock + v)
        rows += [(2 * k, a), (2 * k + 1, b)]
        if jaccard(sets(a), sets(b)) >= 0.8:
            pairs.append((2 * k, 2 * k + 1))
    got = {r.doc_id: r.class_id for r in forest.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


@pytest.mark.parametrize("solo", [components.SOLO, 0])
def test_components(spark, monkeypatch, solo):
    monkeypatch.setattr(components, "SOLO", solo)
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(500, 500), (None, 1)]
    label = {x: x for e in edges[:150] for x in e}
    for _ in range(200):
        for a, b in edges[:150]:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges[:150] if a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
