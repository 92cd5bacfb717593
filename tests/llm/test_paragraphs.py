import random
import re

from scatterlake.llm import paragraphs, similar
from tests.llm.test_forest import jaccard, sets


def words(line):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (line or "").lower().encode())


def segments(w):
    """Cuts before each word whose value is least among its neighbours on both sides."""
    value = [(sum(b * (31 * i + 7) for i, b in enumerate(x)) * 2654435761 + 97 * len(x)) % 2**32 for x in w]
    n = paragraphs.REACH
    cut = [i for i in range(len(w)) if all(value[i] < v for v in value[max(0, i - n) : i]) and all(value[i] <= v for v in value[i + 1 : i + n + 1])]
    cut = sorted({0, *cut, len(w)})
    return [(a, tuple(w[a:b])) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def units(text):
    """(kind, first word, words) of every line and segment of five words."""
    at, out = 0, []
    for line in (text or "").split("\n"):
        w = words(line)
        out.append((0, at, tuple(w)))
        at += len(w)
    return [x for x in out + [(1, a, w) for a, w in segments(words(text))] if len(x[2]) >= 5]


def expected(docs, least):
    places, every = {}, {}
    for d, t in docs:
        for kind, start, w in units(t) if d is not None else []:
            places.setdefault((kind, w), []).append((d, start))
    keys = list(places)
    grams = [sets(b" ".join(w).decode()) for _, w in keys]
    near = [[j for j in range(len(keys)) if j != i and keys[i][0] == keys[j][0] == 0 and jaccard(grams[i], grams[j]) >= 0.8] for i in range(len(keys))]
    label = list(range(len(keys)))
    for _ in keys:
        for i in range(len(keys)):
            label[i] = min([label[i], *(label[j] for j in near[i])])
    for i, (kind, w) in enumerate(keys):
        first = min(p for j in range(len(keys)) if label[j] == label[i] for p in places[keys[j]])
        if near[i] or len(set(places[kind, w])) > 1:
            for d, start in set(places[kind, w]):
                every.setdefault(d, []).append((d, kind, start, len(w), *first, len(near[i]), len(places[kind, w]), (d, start) != first))
    out = []
    for found in every.values():
        runs = []
        for x in sorted(found, key=lambda x: (x[2], x[2] + x[3])):
            if runs and x[2] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], x[2] + x[3])
                runs[-1][2].append(x)
            else:
                runs.append([x[2], x[2] + x[3], [x]])
        out += [(*x, a, b - a) for a, b, members in runs if b - a >= least for x in members]
    return sorted(out)


def fixture():
    rnd = random.Random(4)
    line = lambda: " ".join(f"w{rnd.randrange(800)}" for _ in range(rnd.choice([3, 6, 20, 39, 60])))
    pool = [line() for _ in range(15)]
    docs = []
    for d in range(30):
        lines = [line() for _ in range(rnd.randrange(0, 4))]
        for _ in range(rnd.randrange(0, 4)):
            new = rnd.choice(pool).split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                new[rnd.randrange(len(new))] = f"z{rnd.randrange(99)}"
            lines.insert(rnd.randrange(len(lines) + 1), " ".join(new) + rnd.choice(["", ".", "  "]))
        docs.append((d, "\n".join(lines)))
    return [*docs, (100, None), (101, ""), (102, "\n\n"), (None, pool[3]), (103, "\n" + pool[4].upper() + "\n"), (5, docs[5][1]), (104, "ha " * 300), (105, "Ha, " * 300)]


def frame_of(spark, docs):
    return spark.createDataFrame([(d, t, 1, "s", 2, "c") for d, t in docs], "doc_id long, text string, start int, node string, kind int, class string").repartition(4)


def test_matches_brute_force(spark, monkeypatch):
    docs = fixture()
    frame = frame_of(spark, docs)
    for least, nodes in ((5, 512), (30, 2)):
        monkeypatch.setattr(similar, "BLOCK_NODES", nodes)
        monkeypatch.setattr(similar, "VERIFY_NODES", nodes)
        monkeypatch.setattr(similar, "SAMPLED", 1)
        monkeypatch.setattr(similar, "CROWDED", 5 if nodes == 2 else 64)
        got = sorted(tuple(r) for r in paragraphs.repeated(frame, least).collect())
        assert got == expected(docs, least) and any(r[8] for r in got)
    gone = {(r[0], r[2]) for r in got if r[8] and r[1] == 0}

    def cut(d, t):
        at, out = 0, []
        for x in t.split("\n"):
            n = len(words(x))
            out += [] if n and (d, at) in gone else [x]
            at += n
        return "\n".join(out)

    kept = {(r.doc_id, r.text) for r in paragraphs.without_repeats(frame, 30).collect()}
    assert gone and kept == {(d, t if t is None else cut(d, t)) for d, t in docs}


def test_passages_inside_lines_and_across_line_breaks(spark):
    rnd = random.Random(8)
    some = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randrange(4000)}" for _ in range(n)]
    shared, docs, holders = [some(n) for n in (51, 55, 60, 80, 120)], [], {}
    for d in range(200):
        w = some(rnd.randrange(60, 200))
        if d % 2:
            k = rnd.randrange(len(shared))
            holders.setdefault(k, []).append(d)
            at = rnd.randrange(len(w))
            w[at:at] = shared[k]
        every = rnd.choice([7, 13, 1000])
        docs.append((d, "".join(x + ("\n" if i % every == every - 1 else rnd.choice([" ", " ", ", ", ". "])) for i, x in enumerate(w))))
    got = paragraphs.repeated(frame_of(spark, docs)).collect()
    assert {r.doc_id for r in got} == {d for of in holders.values() for d in of}
    removed = {r.doc_id for r in got if r.removed}
    assert removed == {d for of in holders.values() for d in sorted(of)[1:]}


def test_short_lines_count_where_asked_for(spark):
    docs = [(200, "all rights are reserved here"), (201, "x\nAll rights are reserved here.\ny"), (202, "one two three four"), (203, "one two three four")]
    frame = frame_of(spark, docs)
    assert {r.doc_id for r in paragraphs.repeated(frame, 5).collect()} == {200, 201}
    assert paragraphs.repeated(frame).count() == 0


def test_very_long_text(spark):
    rnd = random.Random(5)
    long = [f"v{rnd.randrange(10**6)}" for _ in range(300_000)]
    docs = [(1, " ".join(long)), (2, "start\n" + " ".join(long[150_000:150_060]) + "\nend"), (3, "w" * 2_000_000)]
    got = paragraphs.repeated(frame_of(spark, docs)).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.doc_id for r in got if r.removed} == {2}


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert paragraphs.repeated(empty).count() == 0 and paragraphs.without_repeats(empty).count() == 0


def test_bands_reach_the_recall():
    n = paragraphs.bands()
    assert 1 - (1 - 0.8**paragraphs.ROWS) ** n >= paragraphs.RECALL > 1 - (1 - 0.8**paragraphs.ROWS) ** (n - 1)
    assert n * paragraphs.ROWS % 4 == 0  # signatures are stored as longs
