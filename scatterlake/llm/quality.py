"""Quality classifier: hashed word n-gram logistic regression, fitted with
follow-the-regularised-leader updates and scored as sparse dot products.

Tokens are maximal runs of word bytes (letters, digits, bytes >= 0x80) or of
other non-space bytes, case kept. Each token also has a shape: for a word,
which of lower case, upper case, digits and other letters it holds and whether
it is one byte long; for punctuation, its bytes. Features are hashed token
1-grams and 2-grams and shape 1-, 2- and 3-grams. A text's vector holds
100 * count / number of features, so the score is one gather and one sum.

Defined results: null and empty texts score the bias alone; rows of the same
doc_id are scored one by one; extra columns are ignored; without any labelled
row every score is the prior 0.5; with labels of one value only, the fit goes
to that value. Ties don't arise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.llm import textops
from scatterlake.llm.tables import held_out, table

#: Documented bound of the sample that the classifier is fitted on, in documents.
TRAIN_ROWS = 6000
BITS, EPOCHS, THRESHOLD = 18, 3, 0.7
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
SCALE = 100.0

_KIND = np.full(256, 2, np.uint8)
_KIND[textops.WORD_BYTE] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_LOWER, _UPPER, _DIGIT = (np.isin(np.arange(256), r) for r in (range(97, 123), range(65, 91), range(48, 58)))


def features(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of every text, with offsets per text."""
    kind = _KIND[buf]
    starts, ends, at = textops.runs(kind, offs)
    words = textops.span_hash(textops.prefix_hash(buf), starts, ends)
    has = np.zeros(len(starts), np.uint64)
    for k, member in enumerate((_LOWER, _UPPER, _DIGIT)):
        sums = np.concatenate([[0], np.cumsum(member[buf], dtype=np.int64)])
        count = sums[ends] - sums[starts]
        has |= (count > 0).astype(np.uint64) << np.uint64(2 * k)
        if k == 1:
            has |= (count > 1).astype(np.uint64) << np.uint64(7)
    has |= (ends - starts == 1).astype(np.uint64) << np.uint64(6)
    shapes = np.where(kind[starts] == 1, textops.mix(has + np.uint64(977)), words) if len(starts) else words
    text = textops.segments(at)
    grams, owner = [], []
    for seed, base, size in ((1, words, 1), (2, words, 2), (3, shapes, 1), (4, shapes, 2), (5, shapes, 3)):
        n = max(0, len(base) - size + 1)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + base[k : k + n]
        inside = text[:n] == text[size - 1 : size - 1 + n]
        grams.append((textops.keyed(h[inside], seed) >> np.uint64(64 - bits)).astype(np.int64))
        owner.append(text[:n][inside])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return np.concatenate(grams)[order], np.searchsorted(owner_all[order], np.arange(len(offs)))


def text_sums(weights: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sparse dot product of each text's vector with the weights."""
    sums = np.concatenate([[0.0], np.cumsum(weights[grams])])
    n = np.diff(at)
    return SCALE * (sums[at[1:]] - sums[at[:-1]]) / np.maximum(n, 1)


def fit(texts: list[str | None], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over whole texts in the given order; returns weights and bias."""
    dim = 1 << bits
    z, n = np.zeros(dim + 1), np.zeros(dim + 1)
    rows = []
    for lo, hi, buf, offs in textops.slices(pa.array(texts, pa.string())):
        grams, at = features(buf, offs, bits)
        for k in range(hi - lo):
            index, count = np.unique(grams[at[k] : at[k + 1]], return_counts=True)
            rows.append((np.append(index, dim), np.append(SCALE * count / max(1, count.sum()), 1.0)))
    for _ in range(epochs if len(rows) else 0):
        for (index, value), y in zip(rows, labels, strict=True):
            zi, ni = z[index], n[index]
            l1 = np.full(len(index), L1)
            l1[-1] = 0.0
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[index] = zi + g - sigma * w
            n[index] = ni + g * g
    l1 = np.full(dim + 1, L1)
    l1[-1] = 0.0
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w[:-1].astype(np.float32), float(w[-1])


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fits on at most ``rows`` labelled documents, those with the least hash of doc_id, held-out ones left out; of rows with one doc_id, on the least text."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).toPandas()
    sample = sample.sort_values("doc_id", kind="stable")
    order = np.argsort(textops.keyed(sample["doc_id"].to_numpy(np.int64).view(np.uint64), 7), kind="stable")
    sample = sample.iloc[order]
    return fit(sample["text"].tolist(), sample["y"].to_numpy(np.float64))


def score(documents: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score and predicted of every row."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, buf, offs in textops.slices(batch.column("text")):
                grams, at = features(buf, offs)
                out[lo:hi] = text_sums(weights, grams, at)
            p = 1.0 / (1.0 + np.exp(-np.clip(out + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; the columns stay.

    The filter runs inside the scan's own tasks, so no join brings the scores back.
    """
    model = train(documents, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, buf, offs in textops.slices(batch.column("text")):
                grams, at = features(buf, offs)
                out[lo:hi] = text_sums(weights, grams, at)
            yield batch.filter(pa.array(1.0 / (1.0 + np.exp(-np.clip(out + bias, -35, 35))) >= THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
