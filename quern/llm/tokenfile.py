"""Binary token files with Elias-Fano document boundaries.

A shard file holds the ids of consecutive documents (ascending doc_id) as one array of 16- or
32-bit integers, and two Elias-Fano sequences: where each document ends, and the document ids.
An Elias-Fano sequence of n values below u takes about n * (2 + log2(u / n)) bits; select samples
in it give any offset without a table of 64-bit numbers. Files are written and read through the
file system of the folder's URI, first under a name of their own and then moved, so a task that
runs twice leaves one whole file.

Layout, little-endian: magic, version, id bytes, documents, ids, null documents, first id (signed),
bytes of the two sequences; ids; boundaries; document ids; CRC-32 of all before.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import GROUP_CHARS, arrow_schema, chunks_of, encoder, id_text, read_whole, staged, trim_memory, write_whole

MAGIC, VERSION = b"QTOK", 1
HEAD = struct.Struct("<4sHHQQQqQQ")
SHARD_IDS = 2 << 20
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of integers from 0 to 2**63 - 1."""

    HEAD = struct.Struct("<QBQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(at[-1]) + 1, np.uint8)
        marks[at] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(marks, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        at, n = i * self.low_bits, self.low_bits
        return int.from_bytes(self.low[at // 8 : (at + n + 7) // 8].tobytes(), "little") >> at % 8 & (1 << n) - 1

    def select(self, i: int) -> int:
        """Value i: from the sample before it, the bits up to its mark are counted."""
        start = int(self.samples[i // SAMPLE])
        end = int(self.samples[i // SAMPLE + 1]) if i // SAMPLE + 1 < len(self.samples) else 8 * len(self.high)
        byte = start // 8
        marks = np.unpackbits(self.high[byte : end // 8 + 1], bitorder="little")
        marks[: start - 8 * byte] = 0
        at = 8 * byte + int(np.flatnonzero(marks)[i % SAMPLE])
        return (at - i) << self.low_bits | (self._low(i) if self.low_bits else 0)

    def span(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1: select for many, which reads only the marks between the samples around them."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first, last = i // SAMPLE, (j - 1) // SAMPLE + 1
        start = int(self.samples[first])
        end = int(self.samples[last]) if last < len(self.samples) else 8 * len(self.high)
        marks = np.unpackbits(self.high[start // 8 : -(-end // 8)], bitorder="little")
        marks[: start % 8] = 0
        at = np.flatnonzero(marks)[i - first * SAMPLE : j - first * SAMPLE] + 8 * (start // 8)
        out = (at - np.arange(i, j)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            since = i * self.low_bits
            bits = np.unpackbits(self.low[since // 8 : -(-j * self.low_bits // 8)], bitorder="little")[since % 8 :][: (j - i) * self.low_bits].reshape(j - i, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def all(self) -> np.ndarray:
        return self.span(0, self.n)

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, highs = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        lows = (n * low_bits + 7) // 8
        raw = np.frombuffer(data, np.uint8)
        return cls(n, low_bits, raw[at : at + lows], raw[at + lows : at + lows + highs], np.frombuffer(data[at + lows + highs :], "<u4"))


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """A whole shard file; doc_ids ascend, nulls first; ids: little-endian 32-bit ids of each.

    ValueError if an id doesn't fit into width bytes.
    """
    flat = np.frombuffer(b"".join(ids), "<u4")
    if len(flat) and int(flat.max()) >> 8 * width:
        raise ValueError(f"id {int(flat.max())} doesn't fit into {width} bytes")
    ends = EliasFano.of(np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)).to_bytes()
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    names = EliasFano.of(np.array(known, np.int64).view(np.uint64) - np.array(first, np.int64).view(np.uint64)).to_bytes()
    head = HEAD.pack(MAGIC, VERSION, width, len(doc_ids), len(flat), len(doc_ids) - len(known), first, len(ends), len(names))
    body = head + flat.astype(f"<u{width}").tobytes() + ends + names
    return body + struct.pack("<I", zlib.crc32(body))


class Shard:
    """A shard file's bytes, opened: document ids, boundaries, ids."""

    def __init__(self, data: bytes):
        magic, version, width, self.n_docs, self.n_ids, nulls, first, n_ends, n_names = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("not a whole token file")
        at = HEAD.size
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)
        at += width * self.n_ids
        self.ends = EliasFano.from_bytes(data[at : at + n_ends])
        self.names, self.nulls, self.first = EliasFano.from_bytes(data[at + n_ends : at + n_ends + n_names]), nulls, np.array(first, np.int64).view(np.uint64)

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Document ids i to j - 1."""
        known = (self.names.span(max(0, i - self.nulls), max(0, j - self.nulls)) + self.first).view(np.int64)
        return [None] * (min(j, self.nulls) - min(i, self.nulls)) + known.tolist()

    def starts(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j - 1 start, and where the last of them ends."""
        ends = self.ends.span(max(0, i - 1), j).astype(np.int64)
        return ends if i else np.append(0, ends)

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def id_width(tokenizer: str, end_id: int) -> int:
    """Bytes of an id: 2 if every id of the tokenizer's vocabulary and the end id fit, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, width: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards of docs below folder (a URI that all executors reach); returns their list.

    (part, shard, path, n_docs, n_ids), in order of part and shard. Documents ascend by doc_id, null
    ids first, equal ids by their text; null and empty texts are the end id alone. Ranges of doc_id
    are dealt out by sampled bounds, so each task has a like share; a shard ends at shard_ids ids,
    or after one longer document. width: bytes of an id, else by the vocabulary; an id that doesn't
    fit raises. No document, no file.
    """
    width = width or id_width(tokenizer, end_id)
    schema = "part int, shard int, path string, n_docs bigint, n_ids bigint"
    arrow = arrow_schema(docs.sparkSession, schema)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        names: list = []
        found: list[bytes] = []
        size, rows = 0, []

        def close() -> None:
            nonlocal size
            path = f"{folder}/part-{part:07d}-{len(rows):05d}.qtok"
            write_whole(path, shard_bytes(names, found, width))
            rows.append((part, len(rows), path, len(names), size))
            names.clear()
            found.clear()
            size = 0

        for doc_ids, texts in chunks_of(batches, GROUP_CHARS):
            for doc_id, ids in zip(doc_ids, encode(texts)):
                names.append(doc_id)
                found.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    close()
        if names:
            close()
        encoder(tokenizer).rest()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    ranged = id_text(docs).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return staged(ranged.mapInArrow(run, schema), "token-shards")


def read_token_files(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids): each document from its shard file; ids as little-endian 32-bit integers.

    start counts the ids of all documents before it: the ids of the parts before, one row for each
    task that wrote, and of the part's own shards before. A task reads the shards of a part in turn,
    and takes its documents' places from the select samples.
    """
    schema = "doc_id bigint, start bigint, ids binary"
    arrow = arrow_schema(spark, schema)
    earlier = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", earlier(Window.orderBy("part")).alias("since"))
    own = shards.select("part", "path", earlier(Window.partitionBy("part").orderBy("shard")).alias("before")).join(parts, "part")
    placed = own.select("path", (F.col("since") + F.col("before")).alias("before"), "part").repartition(max(1, shards.select("part").distinct().count()), "part").select("path", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, since in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(read_whole(path))
                for at in range(0, shard.n_docs, 1024):
                    until = min(at + 1024, shard.n_docs)
                    starts = shard.starts(at, until)
                    ids = [shard.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(at, until), pa.int64()), pa.array(since + starts[:-1]), pa.array(ids, pa.binary())], schema=arrow)
        trim_memory()

    return placed.mapInArrow(run, schema)
