"""Approximate nearest neighbours: inverted lists and an adaptive dimension scan.

Vectors are scaled to length one, so the nearest by cosine are the nearest by
distance. Lists are the cells of k-means centres, fitted on a sample of at most
``SAMPLE`` different vectors; every vector is put in a list. A query probes the
fewest lists that reached the ``TARGET`` recall on the sample; one that found
fewer than ``K`` others goes on to its next lists, twice as many in every round,
until it has them or all lists are done. Inside a probed list the
vectors, turned by a random rotation, are scanned a block of columns at a time:
the distance over the first d of D rotated columns estimates the whole, and a
candidate is abandoned once estimate > (1 + EPSILON / sqrt(d)) times the k-th
distance known (the test of ADSampling). Survivors are scored by the cosine of
the original vectors in double precision.

Lists are dealt out in chunks and their queries in blocks, so a task holds at
most ``CHUNK`` candidates and ``BLOCK`` queries on average, whatever one list
holds. Of equal vectors only the K + 1 least ids are searched: no answer can
name another one. Equal queries are searched once.

Defined results: rows with a null vec_id, a null, zero or non-finite vector, or
a length other than the most frequent one take no part; a repeated vec_id counts
once, with its least vector; ties go to the smaller vec_id; a query with fewer
candidates returns what there is; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.llm.similar import _bounds, _units
from scatterlake.llm.tables import checkpoint, join_counted, partitions, table

K, QUERY_STEP = 5, 50
#: Documented bounds: of the sample, of the lists and of the queries that set the number of probes.
SAMPLE, LISTS, TUNING, TARGET = 20_000, 4096, 256, 0.97
CHUNK, BLOCK, COLUMNS, EPSILON = 4096, 1024, 16, 2.1
SLACK = 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(axis=1))
        c[length > 1e-9] = sums[length > 1e-9] / length[length > 1e-9, None]
    return c


def probes(x: np.ndarray, c: np.ndarray, k: int = K, target: float = TARGET) -> int:
    """The fewest lists that hold the target share of the sample queries' true neighbours."""
    step = max(1, len(x) // TUNING)
    queries = np.arange(0, len(x), step)
    own = (x @ c.T).argmax(axis=1)
    order = np.argsort(-(x[queries] @ c.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    needed = []
    for i, q in enumerate(queries):
        s = x @ x[q]
        s[q] = -9
        near = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        needed.append(place[i, own[near]])
    needed = np.sort(np.concatenate(needed)) if needed else np.zeros(0, int)
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1 if len(needed) else len(c)


def scan(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, turn: np.ndarray, columns: int = COLUMNS):
    """The k nearest of each query among the vectors: query numbers, ids and scores."""
    dim = vectors.shape[1]
    x, q = (unit(vectors) @ turn).astype(np.float32), (unit(queries) @ turn).astype(np.float32)
    cuts = [*range(0, dim, columns), dim]
    xs = [np.ascontiguousarray(x[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    qs = [np.ascontiguousarray(q[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    part = (qs[0] ** 2).sum(axis=1)[:, None] + (xs[0] ** 2).sum(axis=1)[None, :] - 2 * qs[0] @ xs[0].T
    np.maximum(part, 0, out=part)
    top = min(k, len(x))
    first = np.argpartition(part, top - 1, axis=1)[:, :top] if top < len(x) else np.broadcast_to(np.arange(len(x)), part.shape)
    limit = ((x[first] - q[:, None, :]) ** 2).sum(axis=2).max(axis=1) + SLACK
    d = cuts[1]
    at_q, at_x = np.nonzero(part * (dim / d) <= (limit * (1 + EPSILON / d**0.5) ** 2)[:, None])
    found = part[at_q, at_x]
    for block in range(1, len(xs)):
        found = found + ((xs[block][at_x] - qs[block][at_q]) ** 2).sum(axis=1)
        d = cuts[block + 1]
        stretch = (1 + EPSILON / d**0.5) ** 2 if d < dim else 1.0
        keep = found * (dim / d) <= limit[at_q] * stretch
        at_q, at_x, found = at_q[keep], at_x[keep], found[keep]
    sure = np.repeat(np.arange(len(q)), first.shape[1]) * len(x) + first.ravel()  # the first ones count whatever the tests said
    at_q, at_x = np.divmod(np.union1d(at_q * len(x) + at_x, sure), len(x))
    a, b = np.asarray(vectors, np.float64), np.asarray(queries, np.float64)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    score = (a[at_x] * b[at_q]).sum(axis=1) / (na[at_x] * nb[at_q])
    odd = ~np.isfinite(score) | (na[at_x] < 1e-150) | (nb[at_q] < 1e-150)
    if odd.any():
        score[odd] = (unit(a[at_x[odd]]) * unit(b[at_q[odd]])).sum(axis=1)
    order = np.lexsort((ids[at_x], -score, at_q))
    at_q, at_x, score = at_q[order], at_x[order], score[order]
    place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q)
    keep = place < k
    return at_q[keep], ids[at_x[keep]], score[keep]


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    usable = usable.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    one = usable.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = one.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return one.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def nearest(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest of every vector that is_query holds for."""
    session = vectors.sparkSession
    usable = checkpoint(clean(vectors))
    different = checkpoint(usable.groupBy("v").agg(F.min("vec_id").alias("vec_id")))
    n = different.count()
    if not n:
        return session.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = unit(np.array([r["v"] for r in different.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()]))
    c = centres(sample, max(1, min(LISTS, len(sample) // 8, 2 ** round(np.log2(max(1, n**0.5))))))
    count = probes(sample, c, k)
    model = session.sparkContext.broadcast((c, count, rotation(sample.shape[1])))

    def assign(batches):
        c, _, _ = model.value
        for batch in batches:
            own = (unit(_matrix(batch.column("v"))) @ c.T).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own.astype(np.int64))], names=["vec_id", "v", "list"])

    def probe(start: int, end: int):
        """The lists that are start-th to before end-th nearest to each query."""

        def run(batches):
            c = model.value[0]
            for batch in batches:
                own = np.argsort(-(unit(_matrix(batch.column("v"))) @ c.T), axis=1, kind="stable")[:, start:end] if batch.num_rows else np.zeros((0, end - start), np.int64)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), own.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(rows), batch.column("v").take(rows), pa.array(own.ravel().astype(np.int64))], names=["vec_id", "v", "list"])

        return run

    def search(batches):
        turn = model.value[2]
        for rows in _units(batches, 4):
            key, asks, ids = (rows.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(3))
            v = _matrix(rows.column(3).combine_chunks())
            out = [], [], []
            for a, b in _bounds(key):
                cut = a + int(np.searchsorted(asks[a:b], 1))
                if a < cut < b:
                    q, found, score = scan(v[a:cut], ids[a:cut], v[cut:b], k + 1, turn)
                    for column, part in zip(out, (ids[cut:b][q], found, score), strict=True):
                        column.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, t), kind) for x, t, kind in zip(out, (np.int64, np.int64, np.float64), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["rep", "vec_id", "score"])

    first = usable.withColumn("copy", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("copy") <= k + 1).drop("copy")
    listed = checkpoint(first.mapInArrow(assign, "vec_id long, v array<double>, list long"))
    chunks = listed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))  # at most LISTS rows
    queries = usable.where(is_query)
    equal = checkpoint(queries.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    reps = equal.select(F.col("rep").alias("vec_id"), "v")
    hashed = F.xxhash64("vec_id")

    def look(asking: DataFrame, start: int, end: int) -> DataFrame:
        asked = checkpoint(asking.mapInArrow(probe(start, end), "vec_id long, v array<double>, list long"))
        blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        sizes = F.broadcast(chunks.join(blocks, "list"))
        candidates = listed.join(sizes, "list").withColumn("chunk", F.pmod(hashed, "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        wanted = asked.join(sizes, "list").withColumn("block", F.pmod(hashed, "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        dealt = [x.select(F.xxhash64("list", "chunk", "block").alias("unit"), F.lit(asks).alias("asks"), "vec_id", "v") for asks, x in enumerate((candidates, wanted))]
        return dealt[0].unionByName(dealt[1]).repartition(partitions(vectors), "unit").sortWithinPartitions("unit", "asks", "vec_id").mapInArrow(search, "rep long, vec_id long, score double")

    def top(found: DataFrame) -> DataFrame:
        return checkpoint(found.withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1).drop("place"))

    done = count
    best = top(look(reps, 0, done))
    while done < len(c):
        enough = best.groupBy(F.col("rep").alias("vec_id")).count().where(F.col("count") > k)  # each vector finds itself too
        short = checkpoint(reps.join(enough, "vec_id", "left_anti"))
        if short.isEmpty():
            break
        best = top(best.unionByName(look(short, done, 2 * done)))
        done *= 2
    named = join_counted(queries.select(F.col("vec_id").alias("query_id"), "v"), equal, "v", "n").select("query_id", "rep")
    others = named.join(best, "rep").where("query_id != vec_id")
    ranked = others.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
