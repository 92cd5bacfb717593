"""Level-5 MAT files: reader, writer and a Spark data source of long rows (key, pos, re, im, text)."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: element types and array classes.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CLASSES = {1: "cell", 2: "struct", 4: "char", 5: "sparse", 6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
_CODE = {v: k for k, v in TYPES.items() if k < 16}
_CLASS = {v: k for k, v in CLASSES.items()}


def _element(data: bytes, at: int, order: str) -> tuple[int, bytes, int]:
    """Type, content and where the next element starts; short elements hold up to four bytes in place."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
    if at + 8 + size > len(data):
        raise ValueError("the file ends inside an element")
    return kind, data[at + 8 : at + 8 + size], at + 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def _numbers(kind: int, raw: bytes, order: str) -> np.ndarray:
    if kind not in TYPES:
        raise ValueError(f"unknown element type {kind}")
    return np.frombuffer(raw, np.dtype(TYPES[kind]).newbyteorder(order))


def _array(data: bytes, order: str):
    if not data:
        return "", np.zeros((0, 0))
    _, raw, at = _element(data, 0, order)
    flags = struct.unpack_from(order + "I", raw)[0]
    kind = CLASSES.get(flags & 0xFF)
    _, raw, at = _element(data, at, order)
    shape = tuple(int(n) for n in np.frombuffer(raw, np.dtype("i4").newbyteorder(order)))
    _, raw, at = _element(data, at, order)
    name = raw.decode("latin1")

    def part() -> np.ndarray:
        nonlocal at
        k, raw, at = _element(data, at, order)
        return _numbers(k, raw, order)

    if kind == "cell":
        out = np.empty(int(np.prod(shape)), object)
        for n in range(len(out)):
            _, raw, at = _element(data, at, order)
            out[n] = _array(raw, order)[1]
        return name, out.reshape(shape, order="F")
    if kind == "struct":
        width = int(part()[0])
        _, raw, at = _element(data, at, order)
        fields = [raw[n : n + width].split(b"\0")[0].decode("latin1") for n in range(0, len(raw), width)]
        rows = []
        for _ in range(int(np.prod(shape))):
            row = {}
            for f in fields:
                _, raw, at = _element(data, at, order)
                row[f] = _array(raw, order)[1]
            rows.append(row)
        return name, rows[0] if len(rows) == 1 else rows
    if kind == "sparse":
        row, start = part().astype(int), part().astype(int)
        value = part()
        value = value + 1j * part() if flags & 0x800 else value
        out = np.zeros(shape, complex if flags & 0x800 else float)
        for col in range(shape[1]):
            span = slice(start[col], start[col + 1])
            out[row[span], col] = value[span]
        return name, out
    if kind is None:
        raise ValueError(f"unknown array class {flags & 0xFF}")
    k, raw, at = _element(data, at, order)
    if kind == "char":
        text = raw.decode("utf-16-le" if k in (4, 17) and order == "<" else "utf-16-be" if k in (4, 17) else "utf-8")
        return name, text if shape[:1] in ((1,), (0,)) else np.array(list(text)).reshape(shape, order="F")
    value = _numbers(k, raw, order).astype(kind)
    if flags & 0x800:
        value = value + 1j * part()
    value = value.reshape(shape, order="F")
    return name, value.astype(bool) if flags & 0x200 else value


def loads(data: bytes) -> dict:
    """Values by name; arrays come with their own shape, column order undone."""
    if data[:8] == b"\x89HDF\r\n\x1a\n" or data[512:520] == b"\x89HDF\r\n\x1a\n":
        raise NotImplementedError("version 7.3 files need an HDF5 reader")
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level-5 file")
    order = "<" if data[126:128] == b"IM" else ">"
    out, at = {}, 128
    while at + 8 <= len(data):
        kind, raw, at = _element(data, at, order)
        if kind == COMPRESSED:
            kind, raw, _ = _element(zlib.decompress(raw), 0, order)
        if kind == MATRIX:
            name, value = _array(raw, order)
            out[name] = value
    return out


def _pack(kind: int, raw: bytes) -> bytes:
    return struct.pack("<II", kind, len(raw)) + raw + b"\0" * (-len(raw) % 8)


def _packed(name: str, value) -> bytes:
    flags, parts = 0, []
    if isinstance(value, str):
        kind, shape = "char", (1, len(value))
        parts = [_pack(17, value.encode("utf-16-le"))]
    elif isinstance(value, dict):
        kind, shape = "struct", (1, 1)
        parts = [_pack(5, struct.pack("<i", 32)), _pack(1, b"".join(k.encode().ljust(32, b"\0") for k in value)), *(_packed("", v) for v in value.values())]
    else:
        a = np.asarray(value)
        a = a.reshape((1, -1)) if a.ndim < 2 else a
        shape = a.shape
        if a.dtype == object:
            kind, parts = "cell", [_packed("", v) for v in a.ravel(order="F")]
        else:
            flags = 0x200 * (a.dtype == bool) | 0x800 * np.iscomplexobj(a)
            kind = "u1" if a.dtype == bool else ("f4" if a.dtype == np.complex64 else "f8") if np.iscomplexobj(a) else a.dtype.str[1:]
            halves = (a.real, a.imag) if np.iscomplexobj(a) else (a,)
            parts = [_pack(_CODE[kind], h.astype("<" + kind).tobytes(order="F")) for h in halves]
    body = _pack(6, struct.pack("<II", _CLASS[kind] | flags, 0)) + _pack(5, np.array(shape, "<i4").tobytes()) + _pack(1, name.encode("latin1")) + b"".join(parts)
    return struct.pack("<II", MATRIX, len(body)) + body


def dumps(values: dict, compress: bool = True) -> bytes:
    head = b"MATLAB 5.0 MAT-file, written by scatterlake".ljust(116) + b"\0" * 8 + struct.pack("<H", 0x0100) + b"IM"
    out = [head]
    for name, value in values.items():
        raw = _packed(name, value)
        if compress:
            packed = zlib.compress(raw)
            raw = struct.pack("<II", COMPRESSED, len(packed)) + packed
        out.append(raw)
    return b"".join(out)


def column_to_row(values: np.ndarray, rows: int, cols: int) -> np.ndarray:
    return np.asarray(values).reshape((rows, cols), order="F").ravel()


def row_to_column(values: np.ndarray, rows: int, cols: int) -> np.ndarray:
    return np.asarray(values).reshape((rows, cols)).ravel(order="F")


def long_rows(values: dict):
    """(key, pos, re, im, text) of every value; positions count along rows; struct fields are named key.field."""
    for key, value in values.items():
        if isinstance(value, dict):
            yield from long_rows({f"{key}.{f}": v for f, v in value.items()})
        elif isinstance(value, str):
            yield key, 0, None, None, value
        elif isinstance(value, np.ndarray) and value.dtype == object:
            yield from long_rows({f"{key}[{n}]": v for n, v in enumerate(value.ravel())})
        else:
            flat = np.asarray(value).ravel()
            for n, v in enumerate(flat.tolist()):
                yield key, n, float(getattr(v, "real", v)), float(getattr(v, "imag", 0.0)), None


class MatSource(DataSource):
    """spark.read.format("mat").load(folder or file): one input partition a file."""

    @classmethod
    def name(cls):
        return "mat"

    def schema(self):
        return "file string, key string, pos long, re double, im double, text string"

    def reader(self, schema):
        return MatReader(self.options["path"])


class MatReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        if os.path.isfile(self.path):
            return [InputPartition(self.path)]
        return [InputPartition(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith(".mat")]

    def read(self, partition):
        with open(partition.value, "rb") as file:
            for row in long_rows(loads(file.read())):
                yield (os.path.basename(partition.value), *row)


def read_mat(spark, path: str):
    """Long rows of all .mat files under any path that Spark reads, a file a row of the scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(path).select("path", "content")

    def run(parts):
        import pandas as pd

        for p in parts:
            for name, data in zip(p["path"], p["content"], strict=True):
                yield pd.DataFrame([(name.rsplit("/", 1)[-1], *r) for r in long_rows(loads(data))], columns=["file", "key", "pos", "re", "im", "text"])

    return files.mapInPandas(run, "file string, key string, pos long, re double, im double, text string")
