"""Big-endian rasters, candidate files and parameter files."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DTYPES = {"f32": ">f4", "c64": ">c8"}


def read_raster(spark: SparkSession, path: str, width: int, kind: str = "f32") -> DataFrame:
    """(file, row, col, re, im) of raw rasters, rows and columns from 0. A file is a row of the scan and leaves it in blocks of lines."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts):
        for p in parts:
            for name, data in zip(p["path"], p["content"], strict=True):
                values = np.frombuffer(data, DTYPES[kind])
                if len(values) % width:
                    raise ValueError(f"{name} holds {len(values)} values, not whole lines of {width}")
                step = max(1, 100_000 // width)
                for lo in range(0, len(values) // width, step):
                    z = values[lo * width : (lo + step) * width]
                    at = np.arange(len(z))
                    yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "row": (lo + at // width).astype(np.int32), "col": (at % width).astype(np.int32), "re": z.real.astype(float), "im": z.imag.astype(float)})

    return files.mapInPandas(run, "file string, row int, col int, re double, im double")


def write_raster(pixels: DataFrame, folder: str, width: int, kind: str = "f32") -> None:
    """One file a name from (file, row, col, re, im); the files are written where the tasks run, into a shared folder."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["row", "col"])
        out = np.zeros((int(p["row"].max()) + 1) * width, DTYPES[kind])
        out[p["row"] * width + p["col"]] = p["re"] + (1j * p["im"] if kind == "c64" else 0)
        with open(f"{folder}/{p['file'].iloc[0]}", "wb") as file:
            file.write(out.tobytes())
        return pd.DataFrame({"file": [p["file"].iloc[0]], "bytes": [out.nbytes]})

    pixels.groupBy("file").applyInPandas(run, "file string, bytes long").collect()  # a row a file


def text_matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """White-space separated numbers of text files, with the line number from 0; other numbers of columns are an error."""
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("line", "text"))
    parts = F.split(F.trim("text"), r"\s+")
    checked = F.when(F.size(parts) == len(names), parts).otherwise(F.raise_error(F.concat(F.lit("a line of other than "), F.lit(len(names)), F.lit(" numbers: "), F.col("text"))).cast("array<string>"))
    return lines.select("line", *[checked[k].cast("double").alias(n) for k, n in enumerate(names)])


def phase_matrix(data: bytes, candidates: int) -> np.ndarray:
    """Candidates by interferograms, from a file that holds one interferogram after the other."""
    values = np.frombuffer(data, ">c8")
    if candidates < 1 or len(values) % candidates:
        raise ValueError("the phase file doesn't hold whole interferograms")
    return values.reshape(-1, candidates).T


def date_pair(name: Column) -> tuple[Column, Column]:
    """The two dates of names like 20200101_20200113."""
    return tuple(F.regexp_extract(name, r"(\d{8})_(\d{8})", k) for k in (1, 2))


def named_values(text: Column, name: str) -> Column:
    """The numbers after ``name:`` in a parameter file."""
    line = F.regexp_extract(text, rf"(?m)^\s*{re.escape(name)}\s*:[ \t]*(.*)$", 1)
    return F.transform(F.regexp_extract_all(line, F.lit(r"([-+]?\d+\.?\d*(?:[eE][-+]?\d+)?)"), F.lit(1)), lambda x: x.cast("double"))


def master_of(root: str, pairs: list[str], explicit: int | None = None) -> int:
    """The master date: as given, else as the folder is named, else the one that all pairs share."""
    if explicit:
        return explicit
    found = re.search(r"INSAR_(\d{8})", root.rstrip("/").rsplit("/", 1)[-1])
    if found:
        return int(found[1])
    sets = [set(m.groups()) for p in pairs if (m := re.search(r"(\d{8})_(\d{8})", p))]
    shared = set.intersection(*sets) if sets else set()
    if len(shared) != 1:
        raise ValueError("the pairs don't name one master")
    return int(shared.pop())
