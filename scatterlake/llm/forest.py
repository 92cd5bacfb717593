"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

Each different text has a label in each of ``TREES`` trees: ``LABEL`` MinHash
values of its five-word shingles. A tree's labels, sorted, are its prefix trie;
scanning them in order gives how many texts share a text's prefix at each depth
from ``ROOT`` to ``LABEL``. Every text starts with its whole labels and shortens
its prefixes: always where this brings at most ``FREE`` more texts, and then,
cheapest first, until a text of similarity 0.8 shares one of its prefixes with
the probability ``RECALL``. Crowded prefixes thus stay long where the other
trees make up for it, and rare ones go up to the root. A text is compared with
all that share its prefix, whatever depth those have for themselves.
Candidates pass an agreement filter on the signatures and are verified by the
exact Jaccard similarity of their five-word shingle sets, at 0.8 or more.

Defined results: null text counts as empty; texts without words link with
nothing, but equal texts are copies of one another; texts of one to four words
have one shingle; every input row returns one row, repeated rows too; class_id
is the least doc_id of the class (null if none has one); extra columns are
ignored; an empty table gives an empty result. n_links counts the other
different texts that a text is linked with, n_copies the rows that hold it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.llm import similar, textops
from scatterlake.llm.tables import checkpoint, fresh, join_counted, small, stored, table

TREES, ROOT, LABEL, RECALL = 20, 4, 6, 0.999
#: More texts that a shorter prefix may bring without need.
FREE = 16


def gains(threshold: float = similar.THRESHOLD) -> np.ndarray:
    """What a tree adds to -log(1 - recall) with a prefix of each depth from the root on."""
    return -np.log1p(-(threshold ** np.arange(ROOT, LABEL + 1.0)))


def shortened(counts: np.ndarray, target: float = RECALL, free: int = FREE) -> np.ndarray:
    """Steps from the root at which each tree's prefix ends; counts[tree, step] texts share it, trees that are left out have the root's."""
    gain, least = gains(), -np.log1p(-target)
    step = np.full(len(counts), LABEL - ROOT)
    total = (TREES - len(counts)) * gain[0] + len(counts) * gain[-1]
    while step.any():
        open_ = np.flatnonzero(step)
        more = counts[open_, step[open_] - 1] - counts[open_, step[open_]]
        k = int(more.argmin())
        if more[k] > free and total >= least - 1e-9:
            break
        t = open_[k]
        total += gain[step[t] - 1] - gain[step[t]]
        step[t] -= 1
    return step


def _texts(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("node"), text.alias("text"))


def distinct_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets without repeats, each sorted."""
    values, at = textops.shingles(buf, offs)
    text = textops.segments(at)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[fresh], np.searchsorted(text[fresh], np.arange(len(offs)))


def _scan(batches):
    for batch in batches:
        size, sigs = [], []
        for _, _, buf, offs in textops.slices(batch.column("text"), lower=True):
            values, at = textops.shingles(buf, offs)
            sigs.extend(x.tobytes() for x in similar.signatures(values, at, TREES * LABEL))
            size.append(np.diff(at))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(np.concatenate(size) if size else np.zeros(0, np.int64)), pa.array(sigs, pa.binary())], names=["doc_id", "node", "size", "sig"])


_PREFIXES = [f"k{d}" for d in range(ROOT, LABEL + 1)]


def _labels(batches):
    """(k4, k5, k6, node): a key for each prefix of each of a text's labels."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, TREES * LABEL)
        keys = [pa.array(similar.band_keys(sig, LABEL, d).view(np.int64).reshape(-1)) for d in range(ROOT, LABEL + 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), TREES))], names=[*_PREFIXES, "node"])


def _choose(batches):
    """(key, node, side) of all prefixes that a text shares, of side 0 where its own ends."""
    for batch in batches:
        node = batch.column("node").to_numpy(zero_copy_only=False)
        found = batch.column("found")
        at = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))])
        fields = np.stack([x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten()], axis=1)
        keys, counts = fields[:, : len(_PREFIXES)], fields[:, len(_PREFIXES) :]
        side = np.ones(keys.shape, np.int32)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            side[np.arange(a, b), shortened(counts[a:b])] = 0
        row, depth = np.nonzero(counts > 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys[row, depth]), pa.array(np.repeat(node, np.diff(at))[row]), pa.array(side[row, depth])], names=["key", "node", "side"])


def prefixes(nodes: DataFrame) -> DataFrame:
    """(key, node, side) of the prefixes that texts share, from (node, size, sig)."""
    rows = nodes.where("size > 0").select("node", "sig").mapInArrow(_labels, ", ".join(f"{k} long" for k in [*_PREFIXES, "node"]))
    root, counts = _PREFIXES[0], [k.replace("k", "n") for k in _PREFIXES]
    hot = similar.crowded_keys(rows.select(F.col(root).alias("key"), "node"))
    rest = rows.join(F.broadcast(hot.select(F.col("key").alias(root))), root, "left_anti")
    shared = rest.withColumn(counts[0], F.count("*").over(W.partitionBy(root))).where(f"{counts[0]} > 1")
    for k, n in zip(_PREFIXES[1:], counts[1:], strict=True):
        shared = shared.withColumn(n, F.count("*").over(W.partitionBy(*_PREFIXES[: _PREFIXES.index(k) + 1])))
    if not hot.isEmpty():
        crowd = checkpoint(rows.join(F.broadcast(hot.select(F.col("key").alias(root))), root, "left_semi"))
        for k, n in zip(_PREFIXES, counts, strict=True):
            crowd = join_counted(crowd, checkpoint(crowd.groupBy(k).agg(F.count("*").alias(n))), k, n)
        shared = shared.unionByName(crowd)
    one = shared.groupBy("node").agg(F.collect_list(F.struct(*_PREFIXES, *counts)).alias("found"))  # at most one a tree
    return one.mapInArrow(_choose, "key long, node long, side int")


def _sets(batches):
    for batch in batches:
        sets = []
        for _, hi, buf, offs in textops.slices(batch.column("text"), lower=True):
            values, at = distinct_sets(buf, offs)
            sets.extend(values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])


def join_classes(documents: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every row."""
    texts = _texts(documents)
    scanned = stored(texts.mapInArrow(_scan, "doc_id long, node long, size long, sig binary"))
    nodes = stored(scanned.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.min(F.struct("size", "sig")).alias("x")).select("node", "rep", "n_copies", "x.*"))

    def fetch(wanted: DataFrame) -> DataFrame:
        one = checkpoint(wanted.select("node", "rep"))
        return texts.join(small(one), "node").where(F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text").mapInArrow(_sets, "node long, set binary")

    linked = checkpoint(similar.similar_classes(nodes.drop("n_copies"), ["sig"], stored(prefixes(nodes)), fetch, TREES * LABEL))
    of_class = linked.groupBy("class_node").agg(F.min("rep").alias("least"))
    classes = linked.join(of_class, "class_node").select("node", "least", "n_links")
    judged = nodes.select("node", "rep", "n_copies").join(small(checkpoint(classes)), "node", "left").select("node", F.coalesce("least", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies")
    return join_counted(scanned.select("doc_id", "node"), checkpoint(judged), "node", "n_copies").select("doc_id", "class_id", "n_links", "n_copies")


def op6_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every class the document with the least doc_id stays, once; rows without doc_id stay."""
    judged = checkpoint(join_classes(documents.select("doc_id", "text")))
    (key,) = fresh(documents, "judged_doc_id")
    gone = checkpoint(judged.where("doc_id != class_id").select(F.col("doc_id").alias(key)).distinct())
    stay = documents.join(small(gone), F.col("doc_id") == F.col(key), "left_anti")
    again = checkpoint(judged.where("doc_id = class_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key)))
    if again.isEmpty():
        return stay
    once = stay.join(small(again), F.col("doc_id") == F.col(key), "left_semi").dropDuplicates(["doc_id"])
    return stay.join(small(again), F.col("doc_id") == F.col(key), "left_anti").unionByName(once)


ORACLE = similar.oracle(
    f"nodes AS (SELECT coalesce(text, '') AS node, {similar.WORDS.format('text')} AS w, min(doc_id) AS rep, count(*) AS n_copies FROM documents GROUP BY coalesce(text, ''), text)",
    "SELECT d.doc_id, c.class_id, coalesce(l.n_links, 0) AS n_links, n.n_copies FROM documents d JOIN nodes n ON n.node = coalesce(d.text, '') JOIN (SELECT reach.a AS node, min(m.rep) AS class_id FROM reach JOIN nodes m ON m.node = reach.b GROUP BY reach.a) c ON c.node = n.node LEFT JOIN links l ON l.node = n.node",
)
