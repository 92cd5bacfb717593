"""Folders of a prepared stack: patches, candidate files, raster stacks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scatterlake.functions.geometry import LIGHT
from scatterlake.operators import prep
from scatterlake.sources import raster

_PATCH = re.compile(r"PATCH_(\d+)$")


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def patches(spark: SparkSession, root: str) -> list[str]:
    """Patch folders: as patch.list orders them, else by number; names with separators are refused."""
    names = listed(spark, root)
    if "patch.list" in names:
        out = [r["value"].strip() for r in spark.read.text(f"{root}/patch.list").collect() if r["value"].strip()]
        bad = [n for n in out if "/" in n or "\\" in n or n in (".", "..")]
        if bad:
            raise ValueError(f"not plain folder names: {bad}")
        return out
    return sorted((n for n in names if _PATCH.match(n)), key=lambda n: int(_PATCH.match(n)[1]))


def candidates(spark: SparkSession, root: str, patch: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Candidate points and long phase of one patch from pscands files; the phase file holds one interferogram after the other."""
    base = f"{root}/{patch}/pscands.1"
    ij = raster.text_matrix(spark, f"{base}.ij", ["id", "row", "col"])
    ll = raster.read_raster(spark, f"{base}.ll", 2).groupBy(F.col("row").cast("int").alias("line")).agg(F.max(F.when(F.col("col") == 0, F.col("re"))).alias("lon"), F.max(F.when(F.col("col") == 1, F.col("re"))).alias("lat"))
    points = ij.join(ll, "line").select((F.col("line") + 1).cast("long").alias("ps_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "lon", "lat")
    names = listed(spark, f"{root}/{patch}")
    for ext, column in (("hgt", "height"), ("da", "d_a")):
        if f"pscands.1.{ext}" in names:
            more = raster.read_raster(spark, f"{base}.hgt", 1).select((F.col("row") + 1).cast("long").alias("ps_id"), F.col("re").alias(column)) if ext == "hgt" else raster.text_matrix(spark, f"{base}.da", [column]).select((F.col("line") + 1).cast("long").alias("ps_id"), column)
            points = points.join(more, "ps_id", "left")
    phase = raster.read_raster(spark, f"{base}.ph", size, "c64").select((F.col("col") + 1).cast("long").alias("ps_id"), (F.col("row") + 1).cast("long").alias("acq"), "re", "im")
    return points.withColumn("patch_id", F.lit(int(_PATCH.search(patch)[1]) if _PATCH.search(patch) else 1)), phase


def sensor(spark: SparkSession, par: str) -> dict[str, float]:
    """Heading, wavelength and dimensions from a parameter file."""
    text = spark.read.text(par, wholetext=True)
    names = ("heading", "radar_frequency", "range_samples", "width", "azimuth_lines", "nlines")
    row = text.select(*[F.try_element_at(raster.named_values(F.col("value"), n), F.lit(1)).alias(n) for n in names]).first()
    if row["heading"] is None or row["radar_frequency"] is None:
        raise ValueError(f"{par} names no heading or radar frequency")
    return {"heading": row["heading"], "lambda": LIGHT / row["radar_frequency"], "width": int(row["range_samples"] or row["width"]), "length": int(row["azimuth_lines"] or row["nlines"])}


def prepare(spark: SparkSession, root: str, width: int, across: int = 1, along: int = 1, overlap: int = 50, limit: float = prep.DISPERSION) -> DataFrame:
    """Raster stack under root/rslc and root/geo to candidates in every patch they lie in: one shuffle by pixel."""
    slc = raster.read_raster(spark, f"{root}/rslc/*.rslc", width, "c64")
    amp = slc.select(F.col("file").alias("acq"), F.struct("row", "col").alias("pixel"), F.hypot("re", "im").alias("amp"))
    chosen = prep.candidates(prep.dispersion(amp, prep.calibration(amp)), limit).select("pixel.row", "pixel.col", "d_a")
    for name, column in (("*.lon", "lon"), ("*.lat", "lat"), ("elevation_dem.rdc", "height")):
        plane = raster.read_raster(spark, f"{root}/geo/{name}", width).select("row", "col", F.col("re").alias(column))
        chosen = chosen.join(plane, ["row", "col"])
    chosen = chosen.where(prep.finite("lon", "lat", "height"))
    length = slc.agg(F.max("row")).first()[0] + 1
    table = prep.patches(spark, width, length, across, along, overlap)
    one = chosen.withColumns({"row": F.col("row") + 1, "col": F.col("col") + 1})
    return prep.in_patches(one, table).withColumns({"row": F.col("row") - 1, "col": F.col("col") - 1})


def profile(points: DataFrame) -> pd.DataFrame:
    """Counts and ranges of a table's numbers, for a look at a dataset."""
    return points.select(*[n for n, t in points.dtypes if t in ("double", "float", "int", "bigint")]).summary("count", "min", "25%", "50%", "75%", "max").toPandas()
