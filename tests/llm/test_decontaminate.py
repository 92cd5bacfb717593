import random
import re

import pytest

from scatterlake.llm import decontaminate
from scatterlake.llm import tables as tables_module


def runs(text, width):
    words = re.findall("[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    width = min(width, len(words)) if width == 5 else width
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if width else frozenset()


def expected(docs, items, threshold=0.8):
    known = {}
    for i, t in items:
        grams = runs(t, 5)
        if i is not None and grams:
            known.setdefault(grams, set()).add(i)
    out = {}
    for d, t in docs:
        own = {k: runs(t, k) for k in range(1, 6)}
        for g, ids in known.items():
            share = len(g & own[len(next(iter(g)))]) / len(g)
            if d is not None and share >= threshold:
                key = d, min(ids), len(ids)
                out[key] = max(out.get(key, 0), round(share, 9))
    return out


@pytest.fixture(scope="module")
def tables():
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rnd.choice([5, 6, 9, 20, 60, 300])))) for k in range(60)]
    items += [(100, None), (101, ""), (102, "one two three"), (105, "Three, ONE"), (106, "w7"), (107, "one; two -- three"), (108, "four five six seven"), (109, "!?"), (103, items[0][1].upper() + "!"), (None, "a b c d e f"), (104, "Ä ö ü ß é è")]
    docs = []
    for d in range(150):
        words = [word() for _ in range(rnd.choice([0, 3, 50, 2000]))]
        for _ in range(rnd.randrange(0, 4)):
            part = items[rnd.randrange(60)][1].split()
            for _ in range(rnd.randrange(0, 3)):
                part[rnd.randrange(len(part))] = "changed"
            at = rnd.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, " ".join(words)))
    docs += [(500, None), (501, ""), (None, items[1][1]), (3, items[2][1]), (502, "ä Ö, ü ß; é -- è"), (502, "ä Ö, ü ß; é -- è")]
    docs += [(510, "x one two three four"), (511, "one two"), (512, "w7"), (513, "w7x three one"), (514, "four five six eight seven"), (515, "four five six seven")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, item_id string").repartition(3), spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, room int")


def test_matches_brute_force(spark, tables):
    got = {(r.doc_id, r.item_id, r.n_items): round(r.containment, 9) for r in decontaminate.contained(*frames(spark, *tables)).collect()}
    assert got == expected(*tables) and len(got) > 60


def test_shuffled_way_agrees(spark, tables, monkeypatch):
    monkeypatch.setattr(decontaminate, "small", lambda frame, rows=0: frame)
    got = {(r.doc_id, r.item_id, r.n_items): round(r.containment, 9) for r in decontaminate.contained(*frames(spark, *tables)).collect()}
    assert got == expected(*tables)


def test_empty_sides(spark, tables):
    docs, items = frames(spark, *tables)
    assert decontaminate.contained(docs.limit(0), items).count() == 0
    assert decontaminate.contained(docs, items.limit(0)).count() == 0


def test_stage_drops_leaked_documents(spark, tables, tmp_path):
    docs, items = tables
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = decontaminate.drop_leaked(spark, frame, str(tmp_path))
    leaked = {d for d, _, _ in expected(docs, items)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in docs if d not in leaked)


def test_very_long_text(spark):
    rnd = random.Random(9)
    words = [f"v{rnd.randrange(10**6)}" for _ in range(400_000)]
    items = [(1, " ".join(words[300_000:300_007])), (2, " ".join(words[200_000:200_500])), (3, " ".join(words[-2:])), (4, " ".join(words[5:40:2]))]
    docs = [(1, " ".join(words)), (2, " ".join(words[:1000]))]
    got = {(r.doc_id, r.item_id, r.n_items): round(r.containment, 9) for r in decontaminate.contained(*frames(spark, docs, items)).collect()}
    assert got == {(1, 1, 1): 1, (1, 2, 1): 1, (1, 3, 1): 1}


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "a" * 5000, [1, 2])], "a long, b string, c array<long>")
    hinted = lambda: "ResolvedHint" in tables_module.small(frame)._jdf.queryExecution().analyzed().toString()
    assert hinted()
    monkeypatch.setattr(tables_module, "BROADCAST_BYTES", 5000)
    assert not hinted()
