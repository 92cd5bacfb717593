"""A training corpus from the table of documents: quality, one of each near-duplicate
class, no repeated passages, no benchmark items, piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scatterlake.llm.decontaminate import drop_leaked
from scatterlake.llm.forest import keep_one
from scatterlake.llm.pieces import tokenise
from scatterlake.llm.quality import keep_good
from scatterlake.llm.suffix import cut_repeats
from scatterlake.llm.tables import checkpoint

STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_leaked),
    ("SentencePiece encoding and decoding", tokenise),
]

#: The classifier, the forest and the encoder have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        documents = checkpoint(stage(spark, documents, sf_dir))
    return STAGES[-1][1](spark, documents, sf_dir)
