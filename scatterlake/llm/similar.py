"""What the two MinHash joins share: signatures, collision blocks, exact verification, classes.

A *node* is one different text, known by a 64-bit hash; copies stand behind it.
Colliding nodes are compared by signature in blocks of at most about
``BLOCK_NODES`` and each block passes on stars of its connected nodes, never all
pairs. Blocks of a crowded bucket are first compared within themselves; as the
dealing differs from bucket to bucket, a group of near copies is connected by
then. Across blocks only nodes that are not yet connected with the bucket's
largest group are compared with the others. Components of these edges are then
verified exactly, all pairs inside a component, in blocks bounded by nodes and
by shingles: each pair is judged in one block, which returns the number of links
of each node and stars of what is linked, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scatterlake.llm import textops
from scatterlake.llm.components import components
from scatterlake.llm.tables import checkpoint, join_counted, partitions, small, stored

THRESHOLD = 0.8
#: Nodes of a collision block, nodes and shingles of a verification block.
BLOCK_NODES, VERIFY_NODES, BLOCK_SHINGLES = 512, 2000, 1_000_000
#: One in so many nodes tells which keys are crowded enough to be dealt out apart; it changes no result.
SAMPLED, CROWDED = 64, 64
#: Rows of a block's matrix that are worked on at a time.
STRIP = 256


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    x = textops.mix(np.arange(1, 2 * count + 1, dtype=np.uint64))
    return (x[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[count:] >> np.uint64(32)).astype(np.uint32)


def signatures(values: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
    """MinHash values, 16 bits of each, of the sets values[at[i]:at[i+1]]; empty sets get zeros."""
    out = np.zeros((len(at) - 1, count), np.uint16)
    full = np.diff(at) > 0
    if not full.any():
        return out
    low = (values >> np.uint64(32)).astype(np.uint32)
    first = at[:-1][full]
    for k, (a, b) in enumerate(zip(*multipliers(count), strict=True)):
        # the low bits of the least values are taken: its high bits are all near zero
        out[full, k] = textops.mix(np.minimum.reduceat(low * a + b, first).astype(np.uint64)).astype(np.uint16)
    return out


def band_keys(sigs: np.ndarray, width: int, depth: int) -> np.ndarray:
    """One 64-bit key for the first ``depth`` of each ``width`` signature values."""
    n, count = sigs.shape
    bands = sigs.reshape(n, count // width, width)[:, :, :depth].astype(np.uint64)
    h = np.broadcast_to(np.arange(1, count // width + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for k in range(depth):
        h = textops.mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k] + np.uint64(1))
    return h


def recall(similarity: float, depth: int, bands: int) -> float:
    return 1 - (1 - similarity**depth) ** bands


def _units(batches, columns: int):
    """Rows of whole units: yields (offsets, columns) for complete units; rows come sorted by column 0."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
        if last or (held and held[-1].column(0)[-1].as_py() != key[0]):
            held.append(batch.slice(0, last)) if last else None
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(key: np.ndarray) -> list[tuple[int, int]]:
    cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def roots(near: np.ndarray) -> np.ndarray:
    """The least member of each row's component under a symmetric matrix of links."""
    n = len(near)
    label = np.arange(n)
    while True:
        least = label.copy()
        for lo in range(0, n, STRIP):
            least[lo : lo + STRIP] = np.minimum(label[lo : lo + STRIP], np.where(near[lo : lo + STRIP], label[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _signatures(rows: pa.Table) -> np.ndarray:
    """One signature a row, from one binary column or from columns of eight bytes each."""
    columns = [rows.column(k).combine_chunks() for k in range(3, rows.num_columns)]
    if pa.types.is_binary(columns[0].type):
        return np.frombuffer(b"".join(columns[0].to_pylist()), np.uint16).reshape(rows.num_rows, -1)
    return np.ascontiguousarray(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)).view(np.uint16)


def _forest(least: int):
    """Stars over the nodes of each unit that are connected by signatures that agree in so many places.

    Rows are (unit, node, side, signature); a pair counts if one of it is of side 0.
    """

    def run(batches):
        for rows in _units(batches, 3):
            key, node, side = (rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(3))
            sig = _signatures(rows)
            out = []
            bounds = np.array(_bounds(key)).reshape(-1, 2)
            two = bounds[(np.diff(bounds, axis=1)[:, 0] == 2), 0]
            near = ((sig[two] == sig[two + 1]).sum(axis=1) >= least) & (side[two] * side[two + 1] == 0)
            out.append((node[two[near]], node[two[near] + 1]))
            for a, b in bounds[np.diff(bounds, axis=1)[:, 0] > 2].tolist():
                own, part, asks = node[a:b], sig[a:b], side[a:b] == 0
                agree = np.zeros((b - a, b - a), bool)
                for i in np.flatnonzero(asks).tolist():
                    agree[i] = (part == part[i]).sum(axis=1) >= least
                agree |= agree.T
                label = roots(agree)
                tied = label != np.arange(b - a)
                out.append((own[tied], own[label[tied]]))
            x, y = map(np.concatenate, zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def intersections(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all pairwise intersections of n sets given as (value, owner) rows without repeats."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    rank = np.cumsum(fresh) - 1
    shared = np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, bool)
    rank, owner = rank[shared], owner[shared]
    out = np.zeros((n, n), np.float32)  # exact: counts are far below 2**24
    step = max(256, 2_000_000 // max(n, 1))
    lo = 0
    while lo < len(rank):
        hi = int(np.searchsorted(rank, rank[lo] + step))
        m = np.zeros((int(rank[hi - 1] - rank[lo]) + 1, n), np.float32)
        m[rank[lo:hi] - rank[lo], owner[lo:hi]] = 1
        out += m.T @ m
        lo = hi
    return out


def _verify(threshold: float):
    """Unit rows (unit, node, blocks, own block, first block, second block, set), judged pair by pair.

    Gives (kind, a, b, n): of a component in one block, a node, its class and its links (kind 0);
    else a node and its links in this unit (kind 1), and a star over what is linked (kind 2).
    """
    names = ["kind", "a", "b", "n"]

    def run(batches):
        for rows in _units(batches, 6):
            key, node, blocks, mine, i, j = (rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(6))
            raw = rows.column(6)
            out = [], [], [], []

            def add(kind, a, b, n):
                for column, values in zip(out, (np.full(len(a), kind), a, b, n), strict=True):
                    column.append(values.astype(np.int64))

            for a, b in _bounds(key):
                own, at = np.unique(node[a:b], return_index=True)
                sets = [np.frombuffer(raw[int(a + k)].as_py(), np.int64) for k in at]
                size = np.array([len(x) for x in sets], np.float64)
                block = mine[a:b][at]
                both = intersections(np.concatenate(sets), np.repeat(np.arange(len(own)), size.astype(np.int64)), len(own))
                near = np.zeros(both.shape, bool)
                for lo in range(0, len(own), STRIP):
                    inter, part = both[lo : lo + STRIP].astype(np.float64), slice(lo, lo + STRIP)
                    near[part] = (inter >= threshold * (size[part, None] + size[None, :] - inter) - 1e-9) & (size[part, None] > 0)
                    if i[a] != j[a]:
                        near[part] &= block[part, None] != block[None, :]
                del both
                np.fill_diagonal(near, False)
                links, label = near.sum(axis=1), roots(near)
                linked, tied = links > 0, label != np.arange(len(own))
                if blocks[a] == 1:
                    add(0, own[linked], own[label[linked]], links[linked])
                else:
                    add(1, own[linked], own[linked], links[linked])
                    add(2, own[tied], own[label[tied]], links[tied])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in out], names=names)

    return run


def _numbers(blocks: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))


def crowded_keys(buckets: DataFrame) -> DataFrame:
    """At most 1000 keys that a sample finds crowded; they have thousands of nodes each."""
    sample = buckets.where(F.pmod("node", F.lit(SAMPLED)) == 0).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= CROWDED)
    return checkpoint(sample.orderBy(F.desc("n"), "key").limit(1000).select("key"))


def similar_classes(nodes: DataFrame, signed: list[str], buckets: DataFrame, fetch: Callable[[DataFrame], DataFrame], signature: int, threshold: float = THRESHOLD) -> DataFrame:
    """Links and classes among nodes (node, size, signature columns and others), stored and without repeats.

    buckets holds (key, node, side), each node once a key: nodes with one key are compared if one of
    them is of side 0. fetch gets a table with node and the other columns and returns (node, set), the
    nodes' shingles. Returns (node, class_node, n_links) and the other columns of the nodes that have links.
    """
    spread = (threshold * (1 - threshold) / signature) ** 0.5
    least = int(np.floor(signature * (threshold - 4.5 * spread)))
    parts = partitions(nodes)
    others = [c for c in nodes.columns if c not in {"node", "size", *signed}]
    blocks = F.ceil(F.col("n") / BLOCK_NODES).cast("long")
    hot = crowded_keys(buckets)
    of_key = W.partitionBy("key")
    plain = buckets.join(F.broadcast(hot), "key", "left_anti").withColumns({"n": F.count("*").over(of_key), "asked": F.min("side").over(of_key), "lo": F.min("node").over(of_key), "hi": F.max("node").over(of_key)})
    plain = stored(plain.where("n > 1 and asked = 0").withColumn("blocks", blocks))
    pairs = plain.where("n = 2").select("lo", "hi").distinct().select(F.xxhash64("lo", "hi").alias("unit"), F.explode(F.array("lo", "hi")).alias("node"), F.lit(0).alias("side"))
    dealt = checkpoint(buckets.join(F.broadcast(hot), "key"))
    counts = dealt.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("asked")).where("asked = 0").withColumn("blocks", blocks)
    crowded = plain.where("n > 2").select("key", "node", "side", "blocks").unionByName(dealt.join(F.broadcast(counts), "key").select("key", "node", "side", "blocks"))
    units = pairs.unionByName(crowded.select(F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), "blocks")).alias("unit"), "node", "side"))
    met = plain.select("node").unionByName(dealt.select("node")).distinct()
    known = stored(nodes.join(small(checkpoint(met)), "node"))

    def edges(units: DataFrame) -> DataFrame:
        rows = units.join(known.select("node", *signed), "node").select("unit", "node", "side", *signed)
        return rows.repartition(parts, "unit").sortWithinPartitions("unit", "side", "node").mapInArrow(_forest(least), "a long, b long")

    first = checkpoint(edges(units))
    found = checkpoint(components(first))
    large = crowded.where("blocks > 1")
    if not large.isEmpty():
        across = checkpoint(edges(_across(large, found)))
        found = found if across.isEmpty() else checkpoint(components(first.unionByName(across)))
    sized = stored(found.join(known.select("node", "size", *others), "node"))
    whole = checkpoint(sized.groupBy("component").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.sum("size") / BLOCK_SHINGLES), F.ceil(F.count("*") / VERIFY_NODES)).cast("long").alias("blocks")))
    placed = join_counted(sized.select("node", "component"), whole, "component", "n").withColumn("mine", F.pmod(F.xxhash64("node", F.lit(11)), "blocks")).withColumn("other", _numbers(F.col("blocks")))
    placed = placed.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).withColumn("unit", F.xxhash64("component", "i", "j"))
    checked = placed.select("unit", "node", "blocks", "mine", "i", "j").join(fetch(sized.select("node", *others)), "node").select("unit", "node", "blocks", "mine", "i", "j", "set").repartition(parts, "unit").sortWithinPartitions("unit", "node")
    judged = checkpoint(checked.mapInArrow(_verify(threshold), "kind long, a long, b long, n long"))
    linked = judged.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("class_node"), F.col("n").alias("n_links"))
    if not judged.where("kind = 2").isEmpty():
        counted = judged.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
        linked = linked.unionByName(counted.join(components(judged.where("kind = 2").select("a", "b")), "node").select("node", F.col("component").alias("class_node"), "n_links"))
    return linked.join(sized.select("node", *others), "node")


def _across(large: DataFrame, found: DataFrame) -> DataFrame:
    """Units that compare each node outside its bucket's largest component with all nodes of the bucket."""
    placed = checkpoint(large.join(found, "node", "left").withColumn("group", F.coalesce("component", "node")))
    groups = checkpoint(placed.groupBy("key", "group").agg(F.count("*").alias("m")))
    main = groups.groupBy("key").agg(F.max_by("group", F.struct("m", "group")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("largest"))
    open_ = checkpoint(main.where("largest < all").withColumn("rows", F.ceil((F.col("all") - F.col("largest")) / BLOCK_NODES).cast("long")))
    dealt = join_counted(placed.drop("component"), open_.drop("largest"), "key", "all").withColumn("asks", F.col("group") != F.col("main"))
    asking = dealt.where("asks").select("key", "node", "side", F.pmod(F.xxhash64("node", F.lit(3)), "rows").alias("row"), _numbers(F.col("blocks")).alias("block"))
    all_ = dealt.select("key", "node", F.lit(1).alias("side"), _numbers(F.col("rows")).alias("row"), F.pmod(F.xxhash64("node", "key"), "blocks").alias("block"))
    return asking.withColumn("side", F.lit(0)).unionByName(all_).select(F.xxhash64("key", "row", "block").alias("unit"), "node", "side")


def oracle(nodes: str, select: str) -> str:
    """SQL of exact Jaccard classes over nodes(node, w): shingles, pairs that share any, components by reachability."""
    return f"""
WITH RECURSIVE {nodes},
shingle AS (SELECT DISTINCT node, CASE WHEN len(w) < {textops.SHINGLE_WORDS} THEN list_concat([len(w)::VARCHAR], w) ELSE w[i:i + {textops.SHINGLE_WORDS - 1}] END AS s FROM (SELECT node, w, unnest(range(1, greatest(len(w) - {textops.SHINGLE_WORDS - 2}, 2))) AS i FROM nodes WHERE len(w) > 0)),
size AS (SELECT node, count(*) AS n FROM shingle GROUP BY node),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.node <> b.node GROUP BY a.node, b.node),
link AS (SELECT a, b FROM common JOIN size p ON p.node = a JOIN size q ON q.node = b WHERE common.n >= {THRESHOLD} * (p.n + q.n - common.n) - 1e-9),
reach AS (SELECT node AS a, node AS b FROM nodes UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
links AS (SELECT a AS node, count(*) AS n_links FROM link GROUP BY a)
{select}
"""


WORDS = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '')"
