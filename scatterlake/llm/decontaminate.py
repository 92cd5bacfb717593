"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Test items are partitioned by size: the number of words in their shingles (five;
an item of one to four words is one shingle of all its words) and the power of
two of their number of shingles. An item's MinHash sketch is its least shingle
hashes, two more than a document at the threshold can lack, so that no such
document is missed; with over ``SKETCH`` of these (an item of more than 110
shingles) the sketch has ``SKETCH`` and misses with a probability of about 1e-4.
A partition's reach is the largest hash in its sketches, its floor the fewest
words of a document that can hold an item of it. A document's shingles over the
reach of all partitions whose floor it meets are dropped as they are hashed, the
others meet the sketches. Documents, however long, are never sketched, so a short
item inside a long text costs no recall. Candidates are then verified by exact
containment of the item's shingles, as text; for an item of under five words that
means its words in a row.

Words are runs of [0-9a-z] and characters from U+0080 on after lower-casing.
Defined results: an item without a word matches nothing; items with equal shingle
sets are one item, known by the least item_id, with their number in n_items; null
texts are empty; rows with a null id take no part; a repeated doc_id returns one
row per item, with its largest containment; extra columns are ignored; an empty
table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.llm.tables import BROADCAST_ROWS, checkpoint, fresh, small, table

THRESHOLD, SKETCH, SHINGLE = 0.8, 24, 5
_SEPARATOR = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATOR), "")


def _starts(words: Column, width: Column) -> Column:
    return F.when(F.size(words) >= width, F.sequence(F.lit(0), F.greatest(F.size(words) - width, F.lit(0))))


def _shingles(words: Column, width: Column) -> Column:
    """All runs of so many words, as text."""
    return F.coalesce(F.transform(_starts(words, width), lambda i: F.array_join(F.slice(words, i + 1, width), " ")), F.array().cast("array<string>"))


def items_of(benchmark: DataFrame, sketch: int = SKETCH, threshold: float = THRESHOLD) -> DataFrame:
    """One row per different item: item_id, n_items, shingles, n, words a shingle, partition, sketch hashes, how many of
    them a candidate holds, and the fewest words of a document that holds the item."""
    texts = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words"))
    wide = texts.where(F.size("words") > 0).withColumn("width", F.least(F.size("words"), F.lit(SHINGLE)))
    sets = wide.select("item_id", "width", F.array_sort(F.array_distinct(_shingles(F.col("words"), F.col("width")))).alias("shingles"))
    one = sets.groupBy("shingles", "width").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("n_items")).withColumn("n", F.size("shingles"))
    hashes = F.array_sort(F.transform("shingles", lambda s: F.xxhash64("width", F.split(s, " "))))
    needed = F.ceil(F.col("n") * threshold - 1e-9)
    lacking = F.col("n") - needed
    k = F.least(F.col("n"), lacking + 2, F.lit(sketch)).cast("int")
    lost = 4 * F.sqrt(k * threshold * (1 - threshold) * (F.col("n") - k) / F.greatest(F.col("n") - 1, F.lit(1)))
    least = F.when(k > lacking, k - lacking).otherwise(F.greatest(F.ceil(k * threshold - lost - 1e-9), F.lit(1)))
    return one.withColumns({"part": F.floor(F.log2("n")), "sketch": F.slice(hashes, F.lit(1), k), "least": least, "words": needed + F.col("width") - 1})


def _partitions(items: DataFrame) -> dict[int, list[tuple[int, int]]]:
    """By the width of shingles, (fewest words, largest sketch hash) of each partition in order of the words: at most 32 for each of five widths."""
    rows = items.groupBy("width", "part").agg(F.min("words").alias("words"), F.max(F.array_max("sketch")).alias("reach")).collect()
    return {w: sorted((r.words, r.reach) for r in rows if r.width == w) for w in sorted({r.width for r in rows})}


def _hashes(docs: DataFrame, parts: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """doc_id, n_words, hash of every shingle within the reach of a partition that a text of so many words can meet.

    Positions are exploded, not arrays of shingles: the hash of the words from a position
    on is then generated code. explode_outer(), as explode() would bring a filter that is
    pushed below the words and splits each text twice.
    """

    def held(width: int, sizes: list[tuple[int, int]]) -> Column:
        run = F.xxhash64(F.lit(width), *[F.get("words", F.col("at") + k) for k in range(width)])
        reach, chosen = None, F.lit(None).cast("long")
        for words, largest in sizes:
            reach = largest if reach is None else max(reach, largest)
            chosen = F.when(F.col("n_words") >= words, F.lit(reach)).otherwise(chosen)
        return F.when((F.col("at") + width <= F.col("n_words")) & (run <= chosen), run)

    words = docs.select("doc_id", _words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    placed = words.select("doc_id", "words", "n_words", F.explode_outer(_starts(F.col("words"), F.lit(min(parts)))).alias("at"))
    if len(parts) == 1:
        ((width, sizes),) = parts.items()
        found = placed.select("doc_id", "n_words", held(width, sizes).alias("hash"))
    else:
        found = placed.select("doc_id", "n_words", F.explode_outer(F.array(*[held(w, sizes) for w, sizes in parts.items()])).alias("hash"))
    return found.where("hash is not null")


def contained(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_items and containment of every document that holds an item."""
    items = small(checkpoint(items_of(benchmark, threshold=threshold)))
    parts = _partitions(items) or {SHINGLE: []}
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = items.select("item_id", F.col("words").alias("fewest"), "least", F.explode("sketch").alias("hash"))
    found = _hashes(docs, parts).join(small(sketches, SKETCH * BROADCAST_ROWS // 10), "hash").where("n_words >= fewest")
    candidates = found.groupBy("doc_id", "item_id").agg(F.countDistinct("hash").alias("held"), F.first("least").alias("least")).where("held >= least")
    by_doc = checkpoint(candidates.groupBy("doc_id").agg(F.collect_list("item_id").alias("items")))
    own = F.concat(*[_shingles(F.col("words"), F.lit(w)) for w in parts])
    fetched = docs.join(small(by_doc), "doc_id").select("doc_id", "items", _words(F.col("text")).alias("words")).select("doc_id", "items", own.alias("own"))
    pairs = fetched.select("doc_id", "own", F.explode_outer("items").alias("item_id")).join(items.select("item_id", "n_items", "n", "shingles"), "item_id")
    judged = pairs.select("doc_id", "item_id", "n_items", (F.size(F.array_intersect("shingles", "own")) / F.col("n")).alias("containment"))
    return judged.where(F.col("containment") >= threshold).groupBy("doc_id", "item_id").agg(F.max("n_items").alias("n_items"), F.max("containment").alias("containment"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaked(spark: SparkSession, documents: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a test item go; rows without doc_id stay."""
    found = contained(documents.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    (key,) = fresh(documents, "leaked_id")
    leaked = checkpoint(found.select(F.col("doc_id").alias(key)).distinct())
    return documents.join(small(leaked), F.col("doc_id") == F.col(key), "left_anti")


ORACLE = r"""
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT 1, item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda w: w <> '') FROM benchmark WHERE item_id IS NOT NULL
), widths AS (
  SELECT kind, id, w, least(len(w), 5) AS k FROM words WHERE kind = 1 AND len(w) > 0
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (
    FROM widths UNION ALL SELECT d.kind, d.id, d.w, k FROM words d, (SELECT DISTINCT k FROM widths) WHERE d.kind = 0))
), sets AS (
  SELECT id, list_sort(list(s)) AS shingles FROM shingles WHERE kind = 1 GROUP BY id
), items AS (
  SELECT min(id) AS item_id, count(*) AS n_items, len(shingles) AS n FROM sets GROUP BY shingles
)
SELECT d.id AS doc_id, item_id, any_value(n_items) AS n_items, count(*) / any_value(n) AS containment
FROM items JOIN shingles b ON b.kind = 1 AND b.id = item_id JOIN shingles d ON d.kind = 0 AND d.s = b.s
GROUP BY d.id, item_id HAVING count(*) / any_value(n) >= 0.8
"""
