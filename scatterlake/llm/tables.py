"""Reading the tables, checkpoints and other session-wide conventions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows, and of bytes written as JSON, that an operator here broadcasts; both are counted before each use.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 128 << 20


def held_out() -> Column:
    return (F.crc32(F.col("doc_id").cast("string")) % 4) == 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(frame: DataFrame) -> str:
    """The shared folder for cut lineage that the session names; a temporary one only where it names none and all runs on one machine."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def checkpoint(frame: DataFrame) -> DataFrame:
    """Cuts lineage in the shared checkpoint folder."""
    _shared(frame)
    return frame.checkpoint()


def stored(frame: DataFrame) -> DataFrame:
    """Cuts lineage by a Parquet table in the shared folder: smaller than a checkpoint, and later scans read only their columns."""
    path = f"{_shared(frame)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a checkpointed frame for broadcast if it has at most so many rows and bytes; otherwise joins shuffle."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")
    held = frame.limit(rows + 1).agg(F.count("*").alias("rows"), size).first()
    return F.broadcast(frame) if held["rows"] <= rows and (held["bytes"] or 0) <= BROADCAST_BYTES else frame


def partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with a checkpointed table of one row a key that counts the key's rows.

    Keys with over 1/share of all rows are fewer than ``share``. They are broadcast, their
    rows are dealt out by a hash of the whole row, and their row of the table goes to each part.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    part, parts = fresh(rows.join(table.limit(0), key), "part", "parts")
    crowded = table.where(F.col(count) * share > total).select(key, F.ceil(F.col(count) * share / max(total, 1)).cast("long").alias(parts))
    dealt = rows.join(F.broadcast(crowded), key, "left").withColumn(part, F.pmod(F.xxhash64(*rows.columns, F.lit(5)), F.coalesce(F.col(parts), F.lit(1)))).drop(parts)
    last = F.when(F.col(count) * share > total, F.ceil(F.col(count) * share / max(total, 1)).cast("long") - 1).otherwise(0)
    return dealt.join(table.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), last))), [key, part]).drop(part)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that a column of the frame already has."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
