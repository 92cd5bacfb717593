"""Suffix-array dedup: bytes covered by a 100-byte string that starts earlier go.

Every 100-byte window of a text belongs to one *anchor*, the leftmost least
24-byte hash inside it, so equal windows always meet under equal anchors,
wherever they stand. The windows of one anchor form a *context* of at most 176
bytes. Steps, all of them one lazy plan:

1. a scan emits (anchor hash, context hash, doc_id, start, windows); contexts
   that repeat within one batch leave it once, with their copies' spans;
2. by anchor: all but the earliest of equal contexts are removed whole; anchors
   with one context need nothing more; contexts of the others fetch their bytes;
3. by anchor again: an enhanced suffix array of the contexts' windows (buckets
   of equal first 100 bytes, sorted by what follows, LCP between neighbours) is
   scanned with a stack. Intervals of the common-prefix tree whose members
   differ in the byte before them are the maximal repeats; each gives all its
   occurrences, and all but the earliest are removed;
4. an anchor with over ``CONTEXTS`` different contexts (a frequent line inside
   different texts) is dealt out by the hash of each single window instead, an
   exact way for groups of any size that no task has to hold;
5. spans are joined to their documents and merged.

Defined results: null text is an empty text; texts under 100 bytes lose
nothing; rows with the same doc_id are one document repeated, neither earlier
than the other, and each returns the union of their spans, clipped to its
length; rows with null doc_id take no part and lose nothing; extra columns are
ignored; an empty table gives an empty result. Equality rests on 64-bit hashes
of 24 and of 100 to 176 bytes that must agree together, in step 4 of 24 and of 100;
step 3 compares bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.llm import textops
from scatterlake.llm.tables import fresh, partitions, table

WINDOW, GRAM = 100, 24
SPAN = WINDOW - GRAM + 1
#: Contexts of one anchor that one task holds; larger groups take step 4.
CONTEXTS = 2000
#: Context bytes for which one suffix array is built at a time.
ARRAY_BYTES = 1 << 20
#: Windows of a text that are judged together; the next ones start where these end, so the size changes no result.
PART = 1 << 20
_POSITION = np.uint64((1 << 31) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, x
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    rest = width - size
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def contexts(buf: np.ndarray, offs: np.ndarray):
    """Anchor hash, context hash, text number, start in the text and number of windows of every context."""
    none = np.zeros(0, np.int64)
    if len(buf) < WINDOW:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    sums = textops.prefix_hash(buf)
    inverse = textops.powers(len(sums))[1]
    gram = textops.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(sums) - GRAM])
    packed = gram & ~_POSITION
    packed |= np.arange(len(gram), dtype=np.uint64)
    anchor = (sliding_min(packed, SPAN) & _POSITION).astype(np.int64)
    text = np.full(len(anchor), -1, np.int32)
    for k in np.flatnonzero(np.diff(offs) >= WINDOW):
        text[offs[k] : offs[k + 1] - WINDOW + 1] = k
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(anchor))
    real = text[first] >= 0
    first, last = first[real], last[real]
    at = anchor[first]
    whole = textops.span_hash(sums, first, last + WINDOW - 1)
    whole = textops.mix(whole + ((at - first) * 1024 + (last - first)).astype(np.uint64))
    return gram[at], whole, text[first].astype(np.int64), first - offs[text[first]], last - first


def merge(owner: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Merges overlapping and touching spans of each owner."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = owner[1:] != owner[:-1]
    block = np.cumsum(fresh) - 1
    base = block * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    fresh[1:] |= (start + base)[1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(owner)) - 1
    return owner[heads], start[heads], (reach - base)[tails]


def maximal_repeats(data: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, begin: np.ndarray, group: np.ndarray, least: int = WINDOW):
    """Maximal repeats of at least ``least`` bytes among contexts of one group.

    Context i starts at data[first[i]], holds count[i] windows (count[i] + least - 1
    bytes) and stands at byte begin[i] of document doc[i]. Yields (length, documents,
    starts), the earliest occurrence first. Left extension is judged inside contexts.
    """
    which = np.repeat(np.arange(len(first)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    place = first[which] + inside
    sums = textops.prefix_hash(data)
    bucket = textops.mix(textops.span_hash(sums, place, place + least) + group[which].view(np.uint64))
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    same = ordered[1:] == ordered[:-1]
    before, after = place[order[:-1][same]], place[order[1:][same]]
    if any(not np.array_equal(data[before + k], data[after + k]) for k in range(least)):
        # different windows under one hash: number the windows of each group by their bytes
        rows = np.column_stack([group[which].view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), data[place[:, None] + np.arange(least)]])
        bucket = np.unique(rows, axis=0, return_inverse=True)[1].ravel().astype(np.uint64)
        order = np.argsort(bucket, kind="stable")
        ordered = bucket[order]
        same = ordered[1:] == ordered[:-1]
    many = np.zeros(len(order), bool)
    many[1:] |= same
    many[:-1] |= same
    live = order[many]
    if not len(live):
        return
    which, inside, place, bucket = which[live], inside[live], place[live], bucket[live]
    rest = count[which] - 1 - inside
    padded = np.concatenate([data.astype(np.int16) + 1, np.zeros(SPAN + 8 + least, np.int16)])
    keys = []
    for k in range(0, int(rest.max(initial=0)), 4):
        key = np.zeros(len(place), np.int64)
        for j in range(4):
            byte = padded[place + least + k + j]
            byte[k + j >= rest] = 0
            key = key * 512 + byte
        keys.append(key)
    order = np.lexsort((*keys[::-1], bucket))
    which, inside, place, bucket, rest = which[order], inside[order], place[order], bucket[order], rest[order]
    together = bucket[1:] == bucket[:-1]
    lcp = np.zeros(len(place), np.int64)
    pair = np.flatnonzero(together)
    lcp[pair + 1] = least
    most = np.minimum(rest[pair], rest[pair + 1])
    k = 0
    while len(pair):
        keep = (most > k) & (padded[place[pair] + least + k] == padded[place[pair + 1] + least + k])
        pair, most = pair[keep], most[keep]
        lcp[pair + 1] += 1
        k += 1
    left = np.where(inside > 0, padded[np.maximum(place - 1, 0)], np.int16(-1))
    differs = np.concatenate([[False], (left[1:] != left[:-1]) | (left[1:] < 0)])
    changes, open_left = np.cumsum(differs).tolist(), (left < 0).tolist()
    owner, start, depth = doc[which].tolist(), (begin[which] + inside).tolist(), [*lcp.tolist()[1:], 0]
    stack: list[tuple[int, int]] = []  # length and first row of the open intervals
    for row, ahead in enumerate(depth):
        low = row
        while stack and stack[-1][0] > ahead:
            length, low = stack.pop()
            if open_left[low] or changes[row] > changes[low]:
                found = sorted({*zip(owner[low : row + 1], start[low : row + 1], strict=True)})
                if len(found) > 1:
                    yield length, [x for x, _ in found], [x for _, x in found]
        if ahead and (not stack or stack[-1][0] < ahead):
            stack.append((ahead, low))


def _emit(columns, names):
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _scan(batches):
    """Step 1. p = start * 256 + windows; p = start * 256: a removed span that ends at c."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        parts = []
        for lo, hi, buf, offs in textops.slices(batch.column("text")):
            step = PART if hi - lo == 1 else max(1, len(buf))
            for a in range(0, len(buf) - WINDOW + 1, step):  # a long text goes in parts that share WINDOW - 1 bytes
                sub = buf[a : a + step + WINDOW - 1]
                h, c, text, start, count = contexts(sub, np.minimum(offs, len(sub)) if hi - lo == 1 else offs)
                parts.append((h, c, ids[lo + text], start + a, count))
        if not parts:
            continue
        h, c, doc, start, count = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((start, doc, c))
        h, c, doc, start, count = h[order], c[order], doc[order], start[order], count[order]
        fresh = np.ones(len(c), bool)
        fresh[1:] = (c[1:] != c[:-1]) | (h[1:] != h[:-1])
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        copy = ~fresh & ((doc != doc[head]) | (start != start[head]))
        d, s, e = merge(doc[copy], start[copy], start[copy] + count[copy] + WINDOW - 1)
        yield _emit((np.concatenate([h[fresh].view(np.int64), textops.mix(d.view(np.uint64)).view(np.int64)]), np.concatenate([c[fresh].view(np.int64), e]), np.concatenate([doc[fresh], d]), np.concatenate([start[fresh] * 256 + count[fresh], s * 256])), ["h", "c", "doc_id", "p"])


def _lists(column):
    """Offsets and field arrays of a list<struct> column; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in flat.flatten()]


_CUT = "k long, kind int, doc_id long, s long, e long, ctx binary"


def _cut(batches):
    """Steps 2 to 4, at the documents: spans pass (kind 0), contexts get their bytes (1), windows of crowded anchors their hashes (2)."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        at, (key, other, p, kind) = _lists(batch.column("pieces"))
        owner = textops.segments(at)
        start, count = p >> 8, p & 255
        gone = kind == 0
        spans = [(ids[owner[gone]], start[gone], other[gone])]
        rows = [], [], [], [], []
        windows = [], [], [], []
        for lo, hi, buf, offs in textops.slices(batch.column("text")):
            mine = np.flatnonzero((owner >= lo) & (owner < hi) & ~gone)
            mine = mine[start[mine] + count[mine] + WINDOW - 1 <= np.diff(offs)[owner[mine] - lo]]
            if not len(mine):
                continue
            place = offs[owner[mine] - lo] + start[mine]
            own = kind[mine] == 1
            raw = buf.tobytes()
            for i, x in zip(mine[own], place[own], strict=True):
                rows[0].append(key[i])
                rows[1].append(ids[owner[i]])
                rows[2].append(start[i])
                rows[3].append(count[i])
                rows[4].append(raw[x : x + count[i] + WINDOW - 1])
            if not own.all():
                i, x = mine[~own], place[~own]
                each = np.repeat(np.arange(len(i)), count[i])
                inside = np.arange(len(each)) - np.repeat(np.cumsum(count[i]) - count[i], count[i])
                windows[0].append(textops.span_hash(textops.prefix_hash(buf), x[each] + inside, x[each] + inside + WINDOW))
                windows[1].append(ids[owner[i]][each])
                windows[2].append(start[i][each] + inside)
                windows[3].append(key[i][each])
        if windows[0]:
            h, doc, s, anchor = map(np.concatenate, windows)
            order = np.lexsort((s, doc, anchor, h))
            h, doc, s, anchor = h[order], doc[order], s[order], anchor[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (anchor[1:] != anchor[:-1])
            head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            copy = ~fresh & ((doc != doc[head]) | (s != s[head]))
            spans.append((doc[copy], s[copy], s[copy] + WINDOW))
            h, doc, s, anchor = h[fresh].view(np.int64), doc[fresh], s[fresh], anchor[fresh]
        else:
            h = doc = s = anchor = np.zeros(0, np.int64)
        d, b, e = merge(*map(np.concatenate, zip(*spans, strict=True)))
        n = len(d), len(rows[0]), len(h)
        yield _emit(
            (
                np.concatenate([textops.mix(d.view(np.uint64)).view(np.int64), np.array(rows[0], np.int64), h]),
                np.repeat(np.arange(3, dtype=np.int32), n),
                np.concatenate([d, np.array(rows[1], np.int64), doc]),
                np.concatenate([b, np.array(rows[2], np.int64), s]),
                np.concatenate([e, np.array(rows[3], np.int64), anchor]),
                pa.array([None] * n[0] + rows[4] + [None] * n[2], pa.binary()),
            ),
            ["k", "kind", "doc_id", "s", "e", "ctx"],
        )


def _repeats(batches):
    """Steps 3 and 4 over rows sorted by kind, key, document and start; a group may go on in the next batch."""
    held: list = []
    size = 0
    head = None  # of the windows with one pair of hashes: key, anchor, document, start
    names = ["doc_id", "s", "e"]

    def solve():
        key, doc, start, count, ctx = (np.concatenate([x[k] for x in held]) if k < 4 else [y for x in held for y in x[4]] for k in range(5))
        data = np.frombuffer(b"".join(ctx), np.uint8)
        first = np.concatenate([[0], np.cumsum(count + WINDOW - 1)])[:-1]
        out = [], [], []
        for length, docs, starts in maximal_repeats(data, first, count, doc, start, key):
            out[0].extend(docs[1:])
            out[1].extend(starts[1:])
            out[2].extend(x + length for x in starts[1:])
        return _emit(merge(*(np.array(x, np.int64) for x in out)), names)

    for batch in batches:
        key, kind, doc, s, e = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
        if (gone := kind == 0).any():
            yield _emit((doc[gone], s[gone], e[gone]), names)
        own = np.flatnonzero(kind == 1)
        for lo in range(0, len(own), 2000):
            part = own[lo : lo + 2000]
            cut = np.flatnonzero(key[part][1:] != key[part][:-1]) + 1
            cut = 0 if held and key[part][0] != held[-1][0][-1] else cut[0] if len(cut) else None
            if cut is not None and size >= ARRAY_BYTES:
                take(held, key, doc, s, e, batch, part[:cut])
                yield solve()
                held, size, part = [], 0, part[cut:]
            size += take(held, key, doc, s, e, batch, part)
        two = kind == 2
        if two.any():
            k2, a2, d2, s2 = key[two], e[two], doc[two], s[two]
            fresh = np.ones(len(k2), bool)
            fresh[1:] = (k2[1:] != k2[:-1]) | (a2[1:] != a2[:-1])
            if head is not None and head[:2] == (k2[0], a2[0]):
                fresh[0] = False
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(k2)), -1))
            d1, s1 = np.where(at < 0, head[2] if head else 0, d2[at]), np.where(at < 0, head[3] if head else 0, s2[at])
            head = int(k2[-1]), int(a2[-1]), int(d1[-1]), int(s1[-1])
            copy = (d1 != d2) | (s1 != s2)
            yield _emit(merge(d2[copy], s2[copy], s2[copy] + WINDOW), names)
    if held:
        yield solve()


def take(held, key, doc, s, e, batch, part) -> int:
    if not len(part):
        return 0
    ctx = batch.column(5).take(pa.array(part)).to_pylist()
    held.append((key[part], doc[part], s[part], e[part], ctx))
    return sum(map(len, ctx))


def _known(documents: DataFrame) -> DataFrame:
    """Rows with a doc_id. The same plan stands on the left of both joins, so their exchange is made once."""
    rows = documents.where(F.col("doc_id").isNotNull())
    rows = rows if dict(rows.dtypes)["doc_id"] == "bigint" else rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def removed_spans(documents: DataFrame, contexts_held: int = CONTEXTS) -> DataFrame:
    """doc_id and spans, a list of [s, e) byte ranges to remove, of every document that loses any."""
    texts = _known(documents)
    found = texts.mapInArrow(_scan, "h long, c long, doc_id long, p long")
    own = F.struct("doc_id", "p")
    is_span = F.col("p") % 256 == 0
    equal = W.partitionBy("h", "c").orderBy("doc_id", "p")
    anchor = W.partitionBy("h")
    judged = found.repartition(partitions(documents), "h").withColumn("earliest", is_span | (F.first(own).over(equal) == own)).withColumn("n", F.sum((F.col("earliest") & ~is_span).cast("long")).over(anchor))
    pieces = judged.where(is_span | ~F.col("earliest") | (F.col("n") > 1)).select(
        "doc_id",
        F.struct(
            F.col("h").alias("h"),
            F.when(is_span, F.col("c")).otherwise(F.shiftright("p", 8) + F.col("p") % 256 + (WINDOW - 1)).alias("c"),
            F.col("p").alias("p"),
            F.when(is_span | ~F.col("earliest"), 0).when(F.col("n") <= contexts_held, 1).otherwise(2).cast("long").alias("kind"),
        ).alias("piece"),
    )
    lists = pieces.groupBy("doc_id").agg(F.collect_list("piece").alias("pieces"))
    cut = texts.join(lists, "doc_id").select("doc_id", "text", "pieces").mapInArrow(_cut, _CUT)
    dealt = cut.repartition(partitions(documents), "k").sortWithinPartitions("kind", "k", F.when(F.col("kind") == 2, F.col("e")), "doc_id", "s")
    spans = dealt.mapInArrow(_repeats, "doc_id long, s long, e long")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def with_spans(documents: DataFrame) -> DataFrame:
    """Every row of documents with its spans in one more column, the last (null: none)."""
    key, name = fresh(documents, "span_doc_id", "removed_spans")
    spans = removed_spans(documents).select(F.col("doc_id").alias(key), F.col("spans").alias(name))
    return documents.join(spans, F.col("doc_id") == F.col(key), "left").drop(key)


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last:s])
        last = e
    return b"".join([*out, raw[last:]])


def _by_row(batch):
    """Row number, bytes and merged, clipped spans of every row; the spans stand in the last column."""
    at, (s, e) = _lists(batch.column(batch.num_columns - 1))
    o, s, e = merge(textops.segments(at), s, e)
    bounds = np.searchsorted(o, np.arange(batch.num_rows + 1))
    s, e = s.tolist(), e.tolist()
    for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        raw = text or b""
        yield k, raw, [(x, min(y, len(raw))) for x, y in zip(s[bounds[k] : bounds[k + 1]], e[bounds[k] : bounds[k + 1]], strict=True) if x < len(raw)]


def _digest(batches):
    for batch in batches:
        out = [(len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()) for _, raw, spans in _by_row(batch)]
        n, r, c, h = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(c, pa.int64()), pa.array(h, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    unknown = documents.where("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("array<struct<s:long,e:long>>").alias("removed_spans"))
    return with_spans(_known(documents)).unionByName(unknown).select("doc_id", "text", "removed_spans").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they hold in part."""
    out = []
    for s, e in spans:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def cut_repeats(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose their repeated bytes, whole characters only; n_chars follows. All rows and columns stay."""
    sized, columns = "n_chars" in documents.columns, documents.columns

    def run(batches):
        for batch in batches:
            text = [None if not batch.column("text")[k].is_valid else _kept(raw, _whole_characters(raw, spans)).decode() if spans else raw.decode() for k, raw, spans in _by_row(batch)]
            for name in ["text", *["n_chars"] * sized]:
                k = batch.schema.get_field_index(name)
                new = pa.array(text, pa.string()) if name == "text" else pa.array([None if x is None else len(x) for x in text], pa.int64()).cast(batch.schema.field(k).type)
                batch = batch.set_column(k, name, new)
            yield batch.select(columns)

    return with_spans(documents).mapInArrow(run, documents.schema)


#: The definition itself: every 100-byte window with its first place, islands of covered bytes, what is left between them.
ORACLE = f"""
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, s, substr(h, 2 * s + 1, {2 * WINDOW}) AS w FROM (SELECT doc_id, h, unnest(range(0, n - {WINDOW - 1})) AS s FROM raw)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
isl AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM dup)),
span AS (SELECT doc_id, min(s) AS a, max(s) + {WINDOW} AS b FROM isl GROUP BY doc_id, k),
cut AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM span UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN t IS NULL THEN substr(h, 2 * f + 1) ELSE substr(h, 2 * f + 1, 2 * (t - f)) END, '' ORDER BY f) AS h FROM cut JOIN raw USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, raw.h))) AS kept_sha256
FROM raw LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
