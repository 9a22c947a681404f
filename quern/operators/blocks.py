"""Blocks of queries against blocks of keys: inner products by numpy where no pair needs a row of its own.

Vectors are packed, some hundred queries or two thousand keys a row, and each block of queries meets
each block of keys. A function reduces a block's products at once, so what is shuffled is what it
keeps. Products are summed in order of the dimensions, as the SQL does, so equal keys have equal
scores wherever they stand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.compat import written

QUERY_ROWS, KEY_ROWS = 256, 2048
#: Queries of a tile, which with its keys stays in a core's cache, and most blocks of queries that a task remembers.
TILE, REMEMBERED = 32, 4096


@dataclass
class Block:
    """Some vectors of one length: ids, a matrix (None if they have nulls), and further columns."""

    ids: pa.Array
    vectors: np.ndarray | None
    extra: dict[str, np.ndarray | pa.Array]

    def __len__(self) -> int:
        return len(self.ids)


def _lengths(column: pa.Array) -> np.ndarray:
    """Length of each list, -1 of one that is null or holds a null: its products are null."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if column.flatten().null_count:
        lengths[np.array([any(v is None for v in x or ()) for x in column.to_pylist()], bool)] = -1
    return lengths


def packed(rows: DataFrame, id: str, vector: str, size: int) -> DataFrame:
    """(length, n, ids, data, and an array of each further column) of up to size rows, by order of id."""
    types = dict(rows.dtypes)
    others = [c for c in rows.columns if c not in (id, vector)]
    schema = ", ".join(["length int", "data binary", f"`{id}` array<{types[id]}>", *(f"`{c}` array<{types[c]}>" for c in others)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(id), null_placement="at_start"))
            lengths = _lengths(batch.column(vector))
            for length in np.unique(lengths):
                own = batch.take(pa.array(np.flatnonzero(lengths == length)))
                for at in range(0, len(own), size):
                    part = own.slice(at, size)
                    data = b"" if length < 0 else np.asarray(part.column(vector).flatten(), np.float64).tobytes()
                    out = {"length": pa.array([length], pa.int32()), "data": pa.array([data], pa.binary())}
                    for c in [id, *others]:
                        values = part.column(c)
                        out[c] = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values)
                    yield pa.RecordBatch.from_pydict(out)

    return rows.select(id, vector, *others).mapInArrow(run, schema)


def products(q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Inner products of each query and key, summed dimension by dimension."""
    out, across = np.zeros((len(q), len(k))), np.ascontiguousarray(k.T)
    room = np.empty((min(TILE, len(q)), len(k)))
    for at in range(0, len(q), TILE):
        part, sums = q[at : at + TILE], out[at : at + TILE]
        tmp = room[: len(part)]
        for d in range(q.shape[1]):
            np.multiply(part[:, d, None], across[d], out=tmp)
            sums += tmp
    return out


def _block(row: dict, id: str, kept: list[str]) -> Block:
    length, n = row["length"].as_py(), len(row[id].values)
    matrix = None if length < 0 else np.frombuffer(row["data"].as_buffer(), np.float64).reshape(n, length)
    return Block(row[id].values, matrix, {c: row[c].values for c in kept})


def met(queries: DataFrame, keys: DataFrame, reduce: Callable[[], Callable[[Block, Block], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """What reduce makes of each block of queries and block of keys.

    queries: (query_id, query, ...), keys: (id, key, ...). reduce is called once a task and may remember.
    A block's vectors are None if they hold nulls; so are those of both if their lengths differ.
    """
    kept = {s: [c for c in df.columns if c not in own] for s, df, own in (("q", queries, ("query_id", "query")), ("k", keys, ("id", "key")))}
    left = written(packed(queries, "query_id", "query", QUERY_ROWS), "queries")
    cores = keys.sparkSession.sparkContext.defaultParallelism
    right = packed(keys, "id", "key", KEY_ROWS).repartition(max(2 * cores, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    left, right = (df.toDF(*[f"{s}_{c}" for c in df.columns]) for s, df in (("q", left), ("k", right)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = reduce()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
                q = _block({c[2:]: v for c, v in row.items() if c[0] == "q"}, "query_id", kept["q"])
                k = _block({c[2:]: v for c, v in row.items() if c[0] == "k"}, "id", kept["k"])
                if q.vectors is None or k.vectors is None or q.vectors.shape[1] != k.vectors.shape[1]:
                    q, k = Block(q.ids, None, q.extra), Block(k.ids, None, k.extra)
                out = made(q, k)
                if out is not None:
                    yield out

    return right.crossJoin(left).mapInArrow(run, schema)


def pairs(q: Block, k: Block, score: np.ndarray | None) -> pa.RecordBatch:
    """(query_id, id, score) of all pairs of a block; without a score it is null."""
    nq, nk = len(q), len(k)
    values = pa.nulls(nq * nk, pa.float64()) if score is None else pa.array(score.ravel())
    return pa.RecordBatch.from_pydict({"query_id": q.ids.take(pa.array(np.repeat(np.arange(nq), nk))), "id": k.ids.take(pa.array(np.tile(np.arange(nk), nq))), "score": values})


def greatest(score: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n greatest of each row, the first of equal ones; not a number is greatest."""
    if score.shape[1] <= n:
        return np.ones(score.shape, bool)
    least = np.partition(score, score.shape[1] - n, axis=1)[:, -n, None]
    mask = score >= least
    odd = np.isnan(score).any(axis=1)
    for r in np.flatnonzero((mask.sum(axis=1) > n) | odd):
        row = score[r]
        order = np.lexsort((np.arange(len(row)), -row, ~np.isnan(row)))[:n]
        mask[r] = False
        mask[r, order] = True
    return mask


class Best:
    """Keeps of a block the n greatest scores of each query, and drops what the task's earlier blocks outdo."""

    def __init__(self, n: int) -> None:
        self.n, self.least = n, {}

    def __call__(self, q: Block, k: Block, score: np.ndarray | None) -> pa.RecordBatch:
        if score is None:
            few = Block(k.ids[: self.n], None, {})
            return pairs(q, few, None)
        name = q.ids.to_numpy(zero_copy_only=False).tobytes() if not pa.types.is_string(q.ids.type) else tuple(q.ids.to_pylist())
        mask = greatest(score, self.n)
        floor = self.least.get(name)
        if len(k) >= self.n:
            lowest = np.where(mask, score, np.inf).min(axis=1)  # not a number stays one, and outdoes nothing
            if len(self.least) >= REMEMBERED:
                self.least.clear()
            self.least[name] = lowest if floor is None else np.fmax(floor, lowest)
        if floor is not None:
            mask &= ~(score < floor[:, None])
        r, c = np.nonzero(mask)
        return pa.RecordBatch.from_pydict({"query_id": q.ids.take(pa.array(r)), "id": k.ids.take(pa.array(c)), "score": pa.array(score[r, c])})
