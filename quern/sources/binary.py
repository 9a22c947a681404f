"""Python data sources: .npy matrices and TFRecord files, read in partitions."""

from __future__ import annotations

import ast
import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _open(uri: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return fs.open_input_file(path)


def npy_header(uri: str) -> tuple[int, int, str, int]:
    """(rows, width, dtype, offset) of a two-dimensional array in C order."""
    with _open(uri) as f:
        magic = f.read(8)
        if magic[:6] != b"\x93NUMPY":
            raise ValueError("not a .npy file")
        wide = magic[6] > 1
        (n,) = struct.unpack("<I" if wide else "<H", f.read(4 if wide else 2))
        head = ast.literal_eval(f.read(n).decode("latin-1"))
    if head["fortran_order"] or len(head["shape"]) != 2:
        raise ValueError("a two-dimensional array in C order is needed")
    return head["shape"][0], head["shape"][1], head["descr"], 8 + (4 if wide else 2) + n


class _Rows(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.rows = options["path"], int(options.get("rows", 65536))
        self.n, self.width, self.kind, self.offset = npy_header(self.path)

    def partitions(self):
        return [_Rows(a, min(a + self.rows, self.n)) for a in range(0, self.n, self.rows)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(self.kind)
        with _open(self.path) as f:
            f.seek(self.offset + partition.start * self.width * kind.itemsize)
            for a in range(partition.start, partition.end, 4096):
                n = min(4096, partition.end - a)
                values = np.frombuffer(f.read(n * self.width * kind.itemsize), kind).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.width, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), lists], names=["id", "vector"])


class NpySource(DataSource):
    """(id, vector): rows of a .npy matrix by their place, as 32-bit floats; each task seeks to its rows."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "id bigint, vector array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer: varints, and byte strings of known length."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def example_features(data: bytes) -> dict[str, list]:
    """Features of an Example message: lists of bytes, floats or integers by name."""
    out: dict[str, list] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            pair = dict(_fields(entry))
            for kind, values in _fields(pair.get(2, b"")):
                if kind == 1:
                    found: list = [v for _, v in _fields(values)]
                elif kind == 2:
                    found = [x for _, v in _fields(values) for x in struct.unpack(f"<{len(v) // 4}f", v)]
                else:
                    found = []
                    for _, v in _fields(values):
                        if isinstance(v, int):
                            found.append(v - (1 << 64) if v >> 63 else v)
                            continue
                        at = 0
                        while at < len(v):
                            x, at = _varint(v, at)
                            found.append(x - (1 << 64) if x >> 63 else x)
                out[pair[1].decode()] = found
    return out


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TfRecordReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        from pyarrow.fs import FileSelector, FileSystem

        uri = self.options["path"]
        fs, path = FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        info = fs.get_file_info(path)
        if info.is_file:
            return [_File(uri)]
        return [_File(f"{uri.rstrip('/')}/{f.base_name}") for f in sorted(fs.get_file_info(FileSelector(path)), key=lambda f: f.path) if f.is_file]

    def read(self, partition: _File) -> Iterator[tuple]:
        import json

        with _open(partition.path) as raw:
            f = gzip.open(raw) if raw.read(2) == b"\x1f\x8b" else raw
            raw.seek(0)
            at = 0
            while len(head := f.read(12)) == 12:
                (n,) = struct.unpack("<Q", head[:8])
                found = example_features(f.read(n))
                f.read(4)
                text = {k: [v.decode("utf-8", "replace") if isinstance(v, bytes) else v for v in vs] for k, vs in found.items()}
                yield partition.path, at, json.dumps(text, ensure_ascii=False)
                at += 1


class TfRecordSource(DataSource):
    """(source_file, record_index, features): Example records of a file or folder, plain or gzip;
    features is a JSON object of lists. Files are the unit of work, since gzip can't be split."""

    @classmethod
    def name(cls) -> str:
        return "tfrecord"

    def schema(self) -> str:
        return "source_file string, record_index bigint, features string"

    def reader(self, schema) -> TfRecordReader:
        return TfRecordReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
    spark.dataSource.register(TfRecordSource)
