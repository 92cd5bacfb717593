"""Stage results as Parquet under one root: staged writes, markers, caches by fingerprint, status."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stage markers in order; a stage is done if its marker and all before it exist.
MARKERS = ("points", "fit", "selection", "weed", "scene", "unwrapped", "scla", "scn")
#: What a stage's rerun makes stale; smoothed scene terms feed unwrapping back and outlive its rerun.
RESULTS = {
    1: ("points", "phase", "ifgs"), 2: ("fit", "random_hist", "cells", "cell_sums"), 3: ("selection", "fit_again"), 4: ("weed", "edges"),
    5: ("scene", "scene_phase", "ifg_std"), 6: ("uw_cells", "unwrapped", "uw_grid", "uw_raster", "uw_edges", "uw_smooth", "uw_costs", "uw_offsets"), 7: ("scla", "scla_smooth"), 8: ("scn",),
}
FEEDBACK = ("scla_smooth",)


def fingerprint(frame: DataFrame) -> str:
    """Order-free hash of rows and schema, one aggregate."""
    h = F.xxhash64(*frame.columns) if frame.columns else F.lit(0)
    row = frame.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first()
    return hashlib.sha256(json.dumps([frame.schema.simpleString(), *map(str, row)]).encode()).hexdigest()[:32]


class Store:
    """Tables under a root that Spark's file system reaches; nothing here opens local files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self._fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{name}/_SUCCESS"))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def write(self, tables: dict[str, DataFrame], marker: str | None = None, partition: str | None = None) -> None:
        """All tables or none: written aside, then renamed, the marker's table last; what failed is rolled back."""
        names = sorted(tables, key=lambda n: n == marker)
        done = []
        try:
            for n in names:
                writer = tables[n].write.mode("overwrite")
                (writer.partitionBy(partition) if partition and partition in tables[n].columns else writer).parquet(f"{self.root}/.staging/{n}")
            for n in names:
                if self._fs.exists(self._path(n)):
                    self._fs.delete(self._path(f".backup/{n}"), True)
                    self._fs.mkdirs(self._path(".backup"))
                    self._fs.rename(self._path(n), self._path(f".backup/{n}"))
                done.append(n)
                if not self._fs.rename(self._path(f".staging/{n}"), self._path(n)):
                    raise OSError(f"{n} can't be published")
        except Exception:
            for n in done:
                self._fs.delete(self._path(n), True)
                if self._fs.exists(self._path(f".backup/{n}")):
                    self._fs.rename(self._path(f".backup/{n}"), self._path(n))
            raise
        finally:
            self._fs.delete(self._path(".staging"), True)
            self._fs.delete(self._path(".backup"), True)

    def drop(self, *names: str) -> None:
        for n in names:
            self._fs.delete(self._path(n), True)

    def resumable(self, name: str, key: str) -> str:
        """The name of the cache under this key; those under another key go."""
        at, cache = f"{name}-{key}", self._path("cache")
        for s in self._fs.listStatus(cache) if self._fs.exists(cache) else []:
            if s.getPath().getName().startswith(f"{name}-") and s.getPath().getName() != at:
                self._fs.delete(s.getPath(), True)
        return f"cache/{at}"

    def cached(self, name: str, key: str, build) -> DataFrame:
        """The table built before under this key, else built now; another key's table goes."""
        at = self.resumable(name, key)
        if not self.exists(at):
            build().write.mode("overwrite").parquet(f"{self.root}/{at}")
        return self.read(at)

    def append(self, name: str, frame: DataFrame) -> None:
        """Adds rows; a unit that is made by one task is there whole or not at all."""
        frame.write.mode("append").parquet(f"{self.root}/{name}")

    def missing(self, name: str, wanted: DataFrame, key: str) -> DataFrame:
        """The units of a resumable table that aren't there yet."""
        return wanted.join(self.read(name).select(key).distinct(), key, "left_anti") if self.exists(name) else wanted

    def status(self) -> int:
        """The last stage whose marker and all markers before it exist."""
        n = 0
        for m in MARKERS:
            if not self.exists(m):
                break
            n += 1
        return n

    def invalidate(self, stage: int) -> list[str]:
        """Drops what stages after this one wrote, but for feedback tables."""
        gone = [n for s, names in RESULTS.items() if s > stage for n in names if n not in FEEDBACK and self.exists(n)]
        self.drop(*gone)
        return gone
