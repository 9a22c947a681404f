"""Bounded-space online packing of token ids into fixed windows.

Each partition holds a fixed number of open windows. A document's full windows are cut off first;
its rest goes to the open window that it fills best; if none has room and no more may be opened,
the fullest is emitted. What is still open at the end of the partitions is merged in groups of a
fixed number of partitions, best fit in descending order. Memory and group size are bounded by
parameters, whatever the size of the corpus.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import GROUP_CHARS, arrow_schema, chunks_of, encoder, id_text, staged

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, open boolean"
#: Sequences of one partition have ids from partition << SHIFT on, those of one merging group below 0.
SHIFT = 36
FLUSH_BYTES = 8 << 20


class Windows:
    """Open windows, by free room; at most limit of them."""

    def __init__(self, size: int, limit: int | None):
        self.size, self.limit, self.serial = size, limit, 0
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def place(self, piece: list, length: int) -> list | None:
        """Puts a piece into the window with the least room that suffices; a window emitted for it."""
        out, k = None, bisect_left(self.free, (length, -1))
        if k < len(self.free):
            room, name = self.free.pop(k)
        else:
            if self.limit is not None and len(self.free) >= self.limit:
                out = self.held.pop(self.free.pop(0)[1])
            room, name = self.size, self.serial
            self.serial += 1
            self.held[name] = []
        self.held[name].append(piece)
        if room == length:  # full
            done = self.held.pop(name)
            return [*(out or []), *[None], *done] if out else done
        insort(self.free, (room - length, name))
        return out

    def rest(self) -> Iterator[list]:
        for _, name in self.free:
            yield self.held[name]


def _emitted(found: list | None) -> list[list]:
    """place() may emit two windows at once, parted by None."""
    if not found:
        return []
    if None in found:
        k = found.index(None)
        return [found[:k], found[k + 1 :]]
    return [found]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, open_windows: int = 64, merge_partitions: int = 8) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row a piece of a document.

    ids: the piece's ids as little-endian unsigned 32-bit integers; start: ids of the document
    before it; offset: its place in the sequence. A null or empty text is the end id alone; repeated
    rows are packed each; a document longer than a window is cut into whole windows and a rest;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow = arrow_schema(spark, PIECES)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, encode = Windows(size, open_windows), encoder(tokenizer).encode
        base, serial = TaskContext.get().partitionId() << SHIFT, 0
        out: list[list] = []
        held = 0

        def close(pieces: list, left_open: bool) -> None:
            nonlocal serial, held
            at = 0
            for doc_id, start, doc_tokens, ids in pieces:
                out.append([doc_id, start, len(ids) // 4, doc_tokens, base + serial, at, ids, left_open])
                at += len(ids) // 4
                held += len(ids)
            serial += 1

        def flush() -> pa.RecordBatch:
            nonlocal held
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
            out.clear()
            held = 0
            return batch

        for doc_ids, texts in chunks_of(batches, GROUP_CHARS):
            for doc_id, ids in zip(doc_ids, encode(texts)):
                ids += end
                n = len(ids) // 4
                cut = n - n % size
                for start in range(0, cut, size):
                    close([(doc_id, start, n, ids[4 * start : 4 * (start + size)])], False)
                if n > cut:
                    for done in _emitted(windows.place((doc_id, cut, n, ids[4 * cut :]), n - cut)):
                        close(done, False)
                if held >= FLUSH_BYTES:
                    yield flush()
        for done in windows.rest():
            close(done, True)
        if out:
            yield flush()
        encoder(tokenizer).rest()

    pieces = staged(id_text(docs).mapInArrow(run, PIECES), "packed", "open")
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pieces.filter("not open").select(columns).unionByName(_merge(pieces.filter("open"), size, merge_partitions))


def _merge(left: DataFrame, size: int, merge_partitions: int) -> DataFrame:
    """Leftover windows of merge_partitions partitions at a time, packed anew piece by piece."""
    schema = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "sequence_id", "offset"], ascending=[False, True, True, True, True], kind="stable")
        windows, out, serial = Windows(size, None), [], 0
        done = [w for piece in rows.itertuples(index=False) for w in _emitted(windows.place(piece, piece.length))]
        for window in [*done, *windows.rest()]:
            at, name = 0, -1 - ((int(key[0]) << SHIFT) + serial)
            for p in window:
                out.append((p.doc_id, p.start, p.length, p.doc_tokens, name, at, p.ids))
                at += p.length
            serial += 1
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    group = F.expr(f"shiftright(sequence_id, {SHIFT}) div {int(merge_partitions)}")
    return left.withColumn("group", group).groupBy("group").applyInPandas(merge, schema)
