"""Byte-level BPE by a global shuffle of distinct words.

Pre-tokens are exploded with their positions chunk by chunk: a chunk's positions go to a file in
the shared folder, and its distinct words are dealt out by hash. There each distinct word of the
corpus is encoded once, its ids are joined back to every chunk that has it, and each chunk puts its
documents together by position. A frequent word is one entry a chunk, so no bucket is hot.
Decoding joins the fixed token-byte table, which is as large as the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import arrow_schema, buckets_for, by_batch, chunk_name, chunks_of, id_text, planes, read_whole, shared_dir, trim_memory, unplanes, write_whole

CHUNK_CHARS = 6 << 20


@lru_cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache
def token_table(path: str) -> tuple[pa.Array, pa.Array]:
    """The token-byte table, as large as the vocabulary: bytes of each id; its decimal digits and a comma."""
    table = ranks(path)
    out: list[bytes | None] = [None] * (max(table.values()) + 1)
    for token, k in table.items():
        out[k] = token
    if None in out:
        raise ValueError("ids of the vocabulary have gaps")
    return pa.array(out, pa.large_binary()), pa.array([b"%d," % k for k in range(len(out))], pa.large_binary())


def words_blob(words: list[bytes]) -> bytes:
    return struct.pack("<I", len(words)) + planes(np.array([len(w) for w in words], np.uint64)) + b"".join(words)


def blob_words(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    width = data[4]
    lengths = unplanes(data[4 : 5 + n * width]) if width else np.zeros(n, np.uint64)
    ends = (5 + n * width + np.cumsum(lengths)).astype(np.int64).tolist()
    return [data[a:b] for a, b in zip([5 + n * width, *ends], ends)]


def positions_file(doc_ids: list, counts: list[int], words: np.ndarray) -> bytes:
    """Documents of a chunk, their numbers of pre-tokens, and each pre-token's word number."""
    known = np.array([d is not None for d in doc_ids])
    ids = np.array([d or 0 for d in doc_ids], np.int64)
    parts = [known.tobytes(), ids.tobytes(), np.array(counts, np.int64).tobytes(), planes(words)]
    return zlib.compress(struct.pack("<Q", len(doc_ids)) + b"".join(parts), 1)


def file_positions(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    data = zlib.decompress(data)
    (n,) = struct.unpack_from("<Q", data)
    known = np.frombuffer(data, bool, n, 8)
    ids, counts = np.frombuffer(data, np.int64, n, 8 + n), np.frombuffer(data, np.int64, n, 8 + 9 * n)
    words = unplanes(data[8 + 17 * n :])
    total = int(counts.sum())
    if len(words) != total:  # only word 0, which has no plane
        words = np.zeros(total, np.uint64)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], counts, words.astype(np.int64)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_tokens, ids): each whole text's ids as little-endian unsigned 32-bit integers.

    As tiktoken's encode_ordinary. Null and empty texts have no ids; repeated rows are encoded each;
    other columns aren't read; one text is never split, so a chunk is as large as its longest text
    at least. Positions are kept in the shared folder until the query ends.
    """
    spark = docs.sparkSession
    buckets, folder = buckets_for(docs), shared_dir(spark, "bpe-positions")
    words_schema, ids_schema, out_schema = "chunk string, bucket int, asked int, words binary", "chunk string, bucket int, asked int, ids binary", "doc_id bigint, n_tokens bigint, ids binary"
    arrow = arrow_schema(spark, words_schema)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        for chunk, (doc_ids, texts) in enumerate(chunks_of(batches, chunk_chars)):
            number: dict[str, int] = {}
            counts, at = [], [np.zeros(0, np.int32)]
            for t in texts:
                found = find(t)
                counts.append(len(found))
                at.append(np.array([number.setdefault(w, len(number)) for w in found], np.int32))
            seen, at = [w.encode("utf-8", "replace") for w in number], np.concatenate(at)
            # Numbered by falling frequency, so positions pack well; a bucket has its words in that order.
            order = np.argsort(-np.bincount(at, minlength=len(seen)), kind="stable")
            rank = np.empty(len(seen), np.int64)
            rank[order] = np.arange(len(seen))
            bucket = np.fromiter((zlib.crc32(seen[k]) % buckets for k in order), np.int64, len(seen))
            where = positions_file(doc_ids, counts, rank[at])
            data = len(where).to_bytes(8, "little") + where + zlib.compress(planes(bucket), 1)
            name = chunk_name(folder, chunk, data)
            write_whole(name, data)
            by_bucket = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
            runs = [b for b in range(buckets) if edges[b] < edges[b + 1]] or [0]
            rows = [(name, b, len(runs), words_blob([seen[k] for k in order[by_bucket[edges[b] : edges[b + 1]]]])) for b in runs]
            del seen, number, at
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            del rows
            trim_memory()

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        own, known = encoding(ranks_path, pattern), {}
        out = []
        for data in rows["words"]:
            words = blob_words(data)
            for w in words:
                if w not in known:
                    known[w] = own.encode_ordinary(w.decode("utf-8", "replace"))
            found = [known[w] for w in words]
            lengths = planes(np.array([len(x) for x in found], np.uint64))
            flat = np.array([i for x in found for i in x], "<u4")
            out.append(struct.pack("<II", len(found), len(lengths)) + lengths + flat.tobytes())
        known.clear()
        trim_memory()
        return rows[["chunk", "bucket", "asked"]].assign(ids=out)

    def put_together(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        if len(rows) != rows["asked"].iloc[0]:
            raise RuntimeError("a chunk lacks answers: its input changed while the query ran")
        lengths, flat = [], []
        for data in rows["ids"]:
            n, size = struct.unpack_from("<II", data)
            lengths.append(unplanes(data[8 : 8 + size]).astype(np.int64) if n else np.zeros(0, np.int64))
            flat.append(np.frombuffer(data, "<u4", offset=8 + size))
        lengths, flat = np.concatenate(lengths), np.concatenate(flat)
        starts = np.cumsum(lengths) - lengths
        data = read_whole(rows["chunk"].iloc[0])
        size = int.from_bytes(data[:8], "little")
        doc_ids, counts, ranks_ = file_positions(data[8 : 8 + size])
        bucket = unplanes(zlib.decompress(data[8 + size :]))
        answer = np.arange(len(lengths))  # of each word number, its place among the answers
        if len(bucket) == len(lengths):  # else all words are in bucket 0, in order
            answer[np.argsort(bucket, kind="stable")] = np.arange(len(lengths))
        words = answer[ranks_]
        n = lengths[words]
        until = np.cumsum(n)
        place = np.repeat((starts[words] - (until - n)).astype(np.int32), n)
        place += np.arange(len(place), dtype=np.int32)
        ids = flat[place].tobytes() if len(place) else b""
        ends = np.append(0, until)[np.cumsum(counts)].tolist() if len(counts) else []
        parts = [ids[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]
        del ids, place, words, until, flat, lengths, data
        trim_memory()
        return pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "n_tokens": [len(x) // 4 for x in parts], "ids": parts})

    asked = id_text(docs).mapInArrow(explode, words_schema)
    answered = asked.groupBy("bucket").applyInPandas(encode, ids_schema)
    return answered.groupBy("chunk").applyInPandas(put_together, out_schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded, the bytes of the ids by the token-byte table, and ids_sha256, the SHA-256 of the
    decimal ids joined by commas in lowercase hex; null ids give nulls, an unknown id raises.

    A batch's ids are joined with the table, which every worker holds, by id; it is in the order of
    the ids, so the join is a take, and its rows come in the order of the ids asked for.
    """

    def joined(table: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        found = table.take(pa.array(ids))
        offsets = np.frombuffer(found.buffers()[1], np.int64, len(ids) + 1, 8 * found.offset)
        data = memoryview(found.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(offsets[np.append(0, ends[:-1])].tolist(), offsets[ends].tolist())]

    def rows(c: dict) -> dict:
        data, decimal = token_table(ranks_path)
        ids = [np.frombuffer(x or b"", "<u4") for x in c["ids"]]
        flat, ends = np.concatenate([*ids, np.zeros(0, "<u4")]), np.cumsum([len(x) for x in ids])
        decoded, told = joined(data, flat, ends), joined(decimal, flat, ends)
        known = [x is not None for x in c["ids"]]
        return c | {
            "decoded": [x if k else None for k, x in zip(known, decoded)],
            "ids_sha256": [hashlib.sha256(x[:-1]).hexdigest() if k else None for k, x in zip(known, told)],
        }

    return by_batch(encoded.select("doc_id", "n_tokens", "ids"), rows, "doc_id bigint, n_tokens bigint, ids binary, decoded binary, ids_sha256 string", batch_rows=64)
