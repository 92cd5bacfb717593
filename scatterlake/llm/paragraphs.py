"""Substring dedup by paragraphs: MinHash banding, exact Jaccard, components; passages inside paragraphs by segments.

Units of two kinds are judged, all of five words and more, against those of
their kind in all documents.

* A *paragraph* (kind 0) is a line. The number of bands is the least that lets a
  pair at the threshold collide with probability ``RECALL``; paragraphs that
  collide are verified by the exact Jaccard similarity of their five-word
  shingles, at 0.8 or more, and components of the links are classes. A paragraph
  of up to three shingles is near another only if their shingles are equal, so
  its first band suffices.
* A *segment* (kind 1) is cut from a document's words, across line breaks, before
  every word whose hash is least among the ``REACH`` words on both sides. Where
  to cut depends on the words nearby alone, so a passage inside longer lines, or
  wrapped elsewhere, is cut alike wherever it stands; but for runs of one word,
  segments are of about 2 * ``REACH`` + 1 words. They are too short for edits
  and are compared as copies.

A unit with a copy or a near copy elsewhere is repeated; of every class the
earliest unit (least doc_id, then place) stays and the others go. Repeated units
of a document that touch or overlap make a *passage*. ``repeated`` returns every
repeated unit with its class and its passage, of ``least_words`` words at least;
the query asks for passages of ``PASSAGE`` words, as shorter ones are stock
lines and phrases that clean texts share too.

Defined results: null and empty texts have no unit; units with the same words in
the same order are copies, whatever their case, punctuation and line breaks;
rows with null doc_id take no part; rows of one doc_id are one document, and what
stands at the same place in several of them is no copy, but counts in n_copies;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.llm import similar, textops
from scatterlake.llm.forest import distinct_sets
from scatterlake.llm.tables import checkpoint, fresh, join_counted, partitions, small, stored, table

ROWS, RECALL = 3, 0.995
REACH, PASSAGE = 5, 30
_SIGN = 4  # signature values in one long


def bands(rows: int = ROWS, threshold: float = similar.THRESHOLD, target: float = RECALL) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - threshold**rows))


class Words:
    """The words of lower-cased texts: hashes, offsets per text and where each word starts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        self.starts, self.ends, self.at = textops.runs(textops.WORD_BYTE[buf], offs)
        self.hashes = textops.span_hash(textops.prefix_hash(buf), self.starts, self.ends)
        powers, self._inverse = textops.powers(len(self.hashes) + 1)
        self._sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * powers[: len(self.hashes)], out=self._sums[1:])

    def identity(self, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
        """A hash of the words from start to end, in order."""
        whole = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return textops.keyed(whole + (end - start).astype(np.uint64), kind).view(np.int64)

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end word of every line."""
        cut = np.unique(np.concatenate([self.at, np.searchsorted(self.starts, np.flatnonzero(self.buf == 10))]))
        return cut[:-1], cut[1:]

    def segments(self, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
        """First and end word of every segment."""
        n = len(self.starts)
        place = np.arange(len(self.buf), dtype=np.int64)
        plain = np.concatenate([[0], np.cumsum(self.buf, dtype=np.int64)])
        placed = np.concatenate([[0], np.cumsum(self.buf * place)])
        size = self.ends - self.starts
        level = 31 * (placed[self.ends] - placed[self.starts]) + (7 - 31 * self.starts) * (plain[self.ends] - plain[self.starts])
        value = (level * 2654435761 + size * 97) % 4294967296
        text = textops.segments(self.at)
        least = np.ones(n, bool)
        for k in range(1, reach + 1):
            same = text[k:] == text[:-k]
            least[k:] &= (value[k:] < value[:-k]) | ~same
            least[:-k] &= (value[:-k] <= value[k:]) | ~same
        cut = np.unique(np.concatenate([self.at, np.flatnonzero(least)]))
        return cut[:-1], cut[1:]

    def units(self, kind: int):
        """First word, end word and text of the units of a kind that have five words."""
        start, end = self.paragraphs() if kind == 0 else self.segments()
        keep = end - start >= textops.SHINGLE_WORDS
        start, end = start[keep], end[keep]
        return start, end, np.searchsorted(self.at, start, "right") - 1

    def byte_bounds(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Byte offsets at which units begin and end, in turn."""
        return np.column_stack([self.starts[start], self.ends[end - 1]]).ravel()


def _read(batches):
    """Batches of units: yields the batch, first row, and the words of a slice of its texts."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, hi, buf, offs in textops.slices(batch.column("text"), lower=True):
            if len(buf):
                yield batch, ids, lo, hi, Words(buf, offs)


def _rows(columns, names):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(np.int64)) for x in columns], names=names)


def _places(kinds: tuple[int, ...]):
    """(node, doc_id, start, n_words, kind) of the units of these kinds; kind only if there are several."""

    def run(batches):
        for _, ids, lo, _, words in _read(batches):
            for kind in kinds:
                start, end, text = words.units(kind)
                found = _rows((words.identity(start, end, kind), ids[lo + text], start - words.at[text], end - start), ["node", "doc_id", "start", "n_words"])
                yield found.append_column("kind", pa.array(np.full(len(start), kind, np.int32))) if len(kinds) > 1 else found

    return run


def _signed(count: int):
    """(node, doc_id, start, n_words, size, s0, s1, ...) of the paragraphs: signatures as longs."""
    names = ["node", "doc_id", "start", "n_words", "size", *(f"s{k}" for k in range(count * ROWS // _SIGN))]

    def run(batches):
        for _, ids, lo, _, words in _read(batches):
            start, end, text = words.units(0)
            if not len(start):
                continue
            node = words.identity(start, end, 0)
            _, which, back = np.unique(node, return_index=True, return_inverse=True)
            which, order = np.sort(which), np.argsort(np.argsort(which))
            back = order[back]
            values, at = textops.shingles(words.buf, words.byte_bounds(start[which], end[which]))
            size = np.diff(at)[::2]  # the odd ones are what stands between the units
            values, cut = values[np.repeat(np.arange(len(at) - 1) % 2 == 0, np.diff(at))], np.concatenate([[0], np.cumsum(size)])
            sig = np.ascontiguousarray(similar.signatures(values, cut, count * ROWS)).view(np.int64)
            yield _rows((node, ids[lo + text], start - words.at[text], end - start, size[back], *sig[back].T), names)

    return run


def _keys(count: int):
    """(key, node, side) of the bands of paragraphs (node, size, s0, s1, ...)."""

    def run(batches):
        for batch in batches:
            node, size, *sig = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns))
            keys = similar.band_keys(np.ascontiguousarray(np.stack(sig, axis=1)).view(np.uint16), ROWS, ROWS).view(np.int64)
            wanted = np.ones(keys.shape, bool)
            wanted[size < textops.SHINGLE_WORDS - 1, 1:] = False
            row, band = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, band]), pa.array(node[row]), pa.array(np.zeros(len(row), np.int32))], names=["key", "node", "side"])

    return run


def _sets(batches):
    """Shingle sets of the wanted paragraphs, given as nodes, of each text."""
    for batch in batches:
        nodes, sets = [], []
        wanted = batch.column("wanted")
        for lo, hi, buf, offs in textops.slices(batch.column("text"), lower=True):
            words = Words(buf, offs)
            start, end, _ = words.units(0)
            own, first = np.unique(words.identity(start, end, 0), return_index=True)
            asked = np.unique(wanted.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False))
            k = np.sort(first[np.isin(own, asked)])
            if len(k):
                values, at = distinct_sets(buf, words.byte_bounds(start[k], end[k]))
                nodes.extend(words.identity(start[k], end[k], 0).tolist())
                sets.extend(values[a:b].tobytes() for a, b in zip(at[::2], at[1::2], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])


#: A document's places in the order of documents and starts; no text has so many words.
_WORDS = 1 << 40


def _summed(rows: DataFrame, *others) -> DataFrame:
    """One row a node: how many rows have it, its first place and whether it has another.

    A place is document * 2**40 + start, a decimal, which hash aggregation takes.
    """
    placed = rows.withColumn("place", F.expr(f"cast(cast(doc_id AS decimal(19,0)) * cast({_WORDS} AS decimal(13,0)) + start AS decimal(38,0))"))
    one = placed.groupBy("node").agg(F.count("*").alias("n_copies"), F.min("place").alias("place"), F.max("place").alias("last"), *others)
    return one.withColumn("copied", F.col("place") != F.col("last")).drop("last")


def _start(place: Column) -> Column:
    return F.pmod(place, F.lit(_WORDS).cast("decimal(38,0)")).cast("long")


def _doc_id(place: Column) -> Column:
    return ((place - _start(place)) / F.lit(_WORDS).cast("decimal(13,0)")).cast("long")


def repeated(documents: DataFrame, least_words: int = PASSAGE) -> DataFrame:
    """Every repeated unit in a passage of so many words: doc_id, kind, start, n_words, class_doc_id, class_start, n_links, n_copies, removed, passage_start, passage_words."""
    texts = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    count = bands()
    signs = [f"s{k}" for k in range(count * ROWS // _SIGN)]
    columns = "node long, doc_id long, start long, n_words long"
    lines = texts.mapInArrow(_signed(count), f"{columns}, size long, {', '.join(f'{s} long' for s in signs)}")
    nodes = stored(_summed(lines, *(F.min(c).alias(c) for c in ("size", *signs))))
    twins = _summed(texts.mapInArrow(_places((1,)), columns)).where("copied").select("node", "n_copies", F.lit(0).cast("long").alias("n_links"), "place")

    def fetch(wanted: DataFrame) -> DataFrame:
        by_doc = checkpoint(wanted.groupBy(_doc_id(F.col("place")).alias("doc_id")).agg(F.collect_list("node").alias("wanted")))
        return texts.join(small(by_doc), "doc_id").select("text", "wanted").mapInArrow(_sets, "node long, set binary")

    buckets = nodes.select("node", "size", *signs).mapInArrow(_keys(count), "key long, node long, side int")
    linked = checkpoint(similar.similar_classes(nodes, signs, buckets, fetch, count * ROWS))
    firsts = linked.groupBy("class_node").agg(F.min("place").alias("first"))
    near = linked.join(firsts, "class_node").select("node", "n_copies", "n_links", F.col("first").alias("place"))
    copied = nodes.where("copied").select("node", "n_copies", "place").join(small(checkpoint(linked.where("copied").select("node"))), "node", "left_anti").withColumn("n_links", F.lit(0).cast("long"))
    judged = stored(near.unionByName(copied).unionByName(twins))
    units = join_counted(texts.mapInArrow(_places((0, 1)), f"{columns}, kind int"), judged, "node", "n_copies")
    placed = units.repartition(partitions(documents), "doc_id").dropDuplicates(["doc_id", "kind", "start", "n_words", "node"]).withColumn("end", F.col("start") + F.col("n_words"))
    order = W.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = placed.withColumn("opens", (before.isNull() | (F.col("start") > before)).cast("int")).withColumn("run", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy("doc_id", "run")
    passages = runs.withColumns({"passage_start": F.min("start").over(whole), "passage_words": F.max("end").over(whole) - F.min("start").over(whole)}).where(F.col("passage_words") >= least_words)
    first = passages.withColumns({"class_doc_id": _doc_id(F.col("place")), "class_start": _start(F.col("place"))})
    return first.select("doc_id", "kind", "start", "n_words", "class_doc_id", "class_start", "n_links", "n_copies", ((F.col("doc_id") != F.col("class_doc_id")) | (F.col("start") != F.col("class_start"))).alias("removed"), "passage_start", "passage_words")


def without_repeats(documents: DataFrame, least_words: int = PASSAGE) -> DataFrame:
    """The documents without the lines that are removed in passages of so many words; all rows and columns stay."""
    key, name = fresh(documents, "cut_doc_id", "cut_lines")
    gone = repeated(documents, least_words).where("removed and kind = 0").groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("start").alias(name))
    joined = documents.join(small(checkpoint(gone)), F.col("doc_id") == F.col(key), "left").drop(key)
    k, columns = documents.columns.index("text"), documents.columns

    def run(batches):
        for batch in batches:
            texts, cuts = batch.column(k).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for row, cut in enumerate(cuts):
                if cut and texts[row] is not None:
                    lines = texts[row].split("\n")
                    _, _, buf, offs = next(textops.slices(pa.array(["\n".join(lines)]), lower=True))
                    words = Words(buf, offs)
                    n_words = np.searchsorted(words.starts, np.append(np.flatnonzero(buf == 10), len(buf)))
                    first = np.concatenate([[0], n_words[:-1]])
                    wanted = set(cut)
                    texts[row] = "\n".join(x for x, a, b in zip(lines, first.tolist(), n_words.tolist(), strict=True) if a == b or a not in wanted)
            yield batch.set_column(k, "text", pa.array(texts, batch.schema.field(k).type)).select(columns)

    return joined.mapInArrow(run, documents.schema)


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))


_BYTE = "(instr('0123456789ABCDEF', substr(x, 2 * b + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * b + 2, 1)) - 1"
_NEAR = "OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {} AND {})"
ORACLE = similar.oracle(
    f"lines AS (SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS t FROM (SELECT DISTINCT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents WHERE doc_id IS NOT NULL)), "
    f"split AS (SELECT doc_id, line, {similar.WORDS.format('t')} AS w FROM lines), "
    "placed AS (SELECT doc_id, w, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line) - len(w) AS start FROM split), "
    f"nodes AS (SELECT DISTINCT array_to_string(w, ' ') AS node, w FROM placed WHERE len(w) >= {textops.SHINGLE_WORDS})",
    f""", word AS (SELECT doc_id, start + j AS i, w[j + 1] AS w FROM (SELECT doc_id, start, w, unnest(range(len(w))) AS j FROM placed)),
valued AS (SELECT w, ((list_sum(list_transform(range(len(x) // 2), lambda b: ({_BYTE}) * (31 * b + 7)))::HUGEINT * 2654435761 + len(x) // 2 * 97) % 4294967296)::BIGINT AS v FROM (SELECT DISTINCT w, hex(encode(w)) AS x FROM word)),
cut AS (SELECT doc_id, i, w, CASE WHEN v >= min(v) {_NEAR.format(f'{REACH} PRECEDING', '1 PRECEDING')} OR v > min(v) {_NEAR.format('1 FOLLOWING', f'{REACH} FOLLOWING')} THEN 0 ELSE 1 END AS opens FROM word JOIN valued USING (w)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM cut),
units AS (
  SELECT 0 AS kind, doc_id, start, len(w) AS n_words, array_to_string(w, ' ') AS node FROM placed WHERE len(w) >= {textops.SHINGLE_WORDS}
  UNION ALL
  SELECT 1, doc_id, min(i), count(*), string_agg(w, ' ' ORDER BY i) FROM numbered GROUP BY doc_id, s HAVING count(*) >= {textops.SHINGLE_WORDS}
),
copies AS (SELECT kind, node, count(*) AS n_copies FROM units GROUP BY kind, node),
least AS (SELECT a AS node, min(b) AS class FROM reach GROUP BY a),
found AS (
  SELECT u.*, c.n_copies, coalesce(l.n_links, 0) AS n_links, CASE WHEN u.kind = 0 THEN least.class ELSE u.node END AS class
  FROM units u JOIN copies c USING (kind, node) LEFT JOIN links l ON u.kind = 0 AND l.node = u.node LEFT JOIN least ON u.kind = 0 AND least.node = u.node
  WHERE c.n_copies > 1 OR l.n_links > 0
),
firsts AS (SELECT kind, class, min(struct_pack(d := doc_id, s := start)) AS first FROM found GROUP BY kind, class),
opened AS (SELECT *, CASE WHEN start <= max(start + n_words) OVER (PARTITION BY doc_id ORDER BY start, n_words ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM found),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY start, n_words) AS run FROM opened),
whole AS (SELECT *, min(start) OVER (PARTITION BY doc_id, run) AS passage_start, max(start + n_words) OVER (PARTITION BY doc_id, run) - min(start) OVER (PARTITION BY doc_id, run) AS passage_words FROM runs)
SELECT doc_id, kind, start::BIGINT AS start, n_words::BIGINT AS n_words, first.d AS class_doc_id, first.s::BIGINT AS class_start, n_links, n_copies, (doc_id, start) <> (first.d, first.s) AS removed, passage_start::BIGINT AS passage_start, passage_words::BIGINT AS passage_words
FROM whole JOIN firsts USING (kind, class) WHERE passage_words >= {PASSAGE}""",
)
