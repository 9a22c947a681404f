"""Bigram language model by deleted interpolation.

p(w | v) = l2 c(v w) / c(v) + l1 c(w) / N + l0 / (V + 1), with weights l that depend on how often the
context v was seen (buckets of powers of two). The weights are learned by expectation-maximisation
on a held-out fold of the training documents, against maximum-likelihood estimates from the other
folds; the final estimates use all training documents.

Documents are read once. A chunk's token numbers go to a file in the shared folder; its distinct
words and bigrams travel as packed sorted hashes, by bucket, with their counts in the chunk. A
bucket sums the counts of each key over all chunks and answers each chunk in the order in which it
asked. So a frequent word is one entry a chunk, and no text is shuffled. Keys are 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import file_positions, positions_file
from quern.llm.common import Hashes, arrow_schema, bucket_of, buckets_for, chained, chunk_name, chunks_of, id_text, planes, read_whole, shared_dir, sorted_planes, staged, trim_memory, unplanes, unsorted_planes, write_whole

CHUNK_CHARS = 8 << 20
END = b"\n"  # no word holds a line end
BASE_ADD = 0.1


@dataclass(frozen=True)
class Model:
    """folds: documents with fold 0 are never learned from, fold 1 is held out for the weights.

    context_buckets: context counts 0, 1, 2-3, 4-7, ... share weights; grid: steps a doubling in which
    the likelihood ratios are tabled for EM, so its table is bounded.
    """

    folds: int = 10
    context_buckets: int = 16
    grid: int = 16
    rounds: int = 60


def fold_of(doc_id: int | None, folds: int) -> int:
    """crc32 of the decimal id, modulo folds; a null id counts as the empty text, fold 0."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


_HASHES = Hashes(500_000)


class Chunk:
    """Token numbers of a chunk's documents, and hashes of its distinct words."""

    def __init__(self, doc_ids: list, counts: np.ndarray, tokens: np.ndarray, hashes: np.ndarray):
        tokens = tokens.astype(np.int32, copy=False)
        self.doc_ids, self.counts, self.tokens, self.hashes = doc_ids, counts, tokens, hashes
        self.first = np.cumsum(counts) - counts
        # The context of a first token is the end token.
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        end = tokens[-1] if len(tokens) else 0
        before[self.first] = end
        self.before = before
        pairs, at = np.unique(before.astype(np.int64) * len(hashes) + tokens, return_inverse=True)
        self.pair_at = at.astype(np.int32)
        self.pair_hashes = chained(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)]) if len(pairs) else np.zeros(0, np.uint64)

    def per_token(self, per_doc: np.ndarray) -> np.ndarray:
        return np.repeat(per_doc, self.counts)

    @classmethod
    def of(cls, doc_ids: list, texts: list[str]) -> Chunk:
        number: dict[bytes, int] = {END: 0}
        each = []
        for t in texts:
            words = t.encode("utf-8", "replace").lower().split()
            each.append(np.array([*[number.setdefault(w, len(number)) for w in words], 0], np.int32))
        counts, tokens = np.array([len(x) for x in each], np.int64), np.concatenate(each)
        each.clear()
        return cls(doc_ids, counts, tokens, _HASHES.of(list(number)))

    def to_bytes(self) -> bytes:
        where = positions_file(self.doc_ids, self.counts.tolist(), self.tokens.astype(np.uint64))
        return len(where).to_bytes(8, "little") + where + self.hashes.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Chunk:
        n = int.from_bytes(data[:8], "little")
        doc_ids, counts, tokens = file_positions(data[8 : 8 + n])
        return cls(doc_ids, counts.copy(), tokens, np.frombuffer(data, "<u8", offset=8 + n).astype(np.uint64))


ASKED = "chunk string, kind int, bucket int, asked int, keys binary, rest binary, held binary"
ANSWERED = "chunk string, kind int, bucket int, asked int, rest binary, held binary, types bigint, types_rest bigint, tokens bigint, tokens_rest bigint"


def count_ngrams(docs: DataFrame, model: Model) -> DataFrame:
    """Answers (ANSWERED) for every chunk: corpus counts of its words (kind 1) and bigrams (kind 2).

    rest: counts in the training folds but the held-out one; held: in that one. A bucket's first
    answer of kind 1 also has its numbers of types and tokens; all others have zeros.
    """
    spark = docs.sparkSession
    buckets, folder, arrow = buckets_for(docs), shared_dir(spark, "lm-tokens"), arrow_schema(spark, ASKED)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (doc_ids, texts) in enumerate(chunks_of(batches, CHUNK_CHARS)):
            chunk = Chunk.of(doc_ids, texts)
            data = chunk.to_bytes()
            name = chunk_name(folder, number, data)
            write_whole(name, data)
            fold = chunk.per_token(np.array([fold_of(d, model.folds) for d in doc_ids]))
            rows = []
            for kind, keys, at in ((1, chunk.hashes, chunk.tokens), (2, chunk.pair_hashes, chunk.pair_at)):
                rest, held = (np.bincount(at[where], minlength=len(keys)).astype(np.uint64) for where in (fold > 1, fold == 1))
                order = np.argsort(keys)
                edges = np.searchsorted(bucket_of(keys[order], buckets), np.arange(buckets + 1))
                full = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                for b in full:
                    part = order[edges[b] : edges[b + 1]]
                    rows.append((name, kind, b, len(full), sorted_planes(keys[part]), planes(rest[part]), planes(held[part])))
            del chunk, data, fold
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        trim_memory()

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind in (1, 2):
            own = rows[rows["kind"] == kind]
            if own.empty:
                continue
            keys = [unsorted_planes(k) for k in own["keys"]]
            _, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = int(at.max()) + 1
            sums = []
            for name in ("rest", "held"):
                each = [_filled(v, len(k)) for v, k in zip(own[name], keys)]
                sums.append(np.bincount(at, weights=np.concatenate(each).astype(np.float64), minlength=n).astype(np.uint64))
            ends = np.cumsum([len(k) for k in keys])
            rest, held = sums
            stats = (int((rest + held > 0).sum()), int((rest > 0).sum()), int(rest.sum() + held.sum()), int(rest.sum())) if kind == 1 else (0,) * 4
            for (_, row), a, b in zip(own.iterrows(), [0, *ends], ends):
                out.append((row["chunk"], kind, row["bucket"], row["asked"], planes(rest[at[a:b]]), planes(held[at[a:b]]), *stats))
                stats = (0,) * 4
        return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERED.split(", ")])

    return staged(id_text(docs).mapInArrow(ask, ASKED).groupBy("bucket").applyInPandas(total, ANSWERED), "lm-counts")


def _filled(data: bytes, n: int) -> np.ndarray:
    """unplanes; all zeros, which have no plane, get their number back."""
    values = unplanes(data)
    return values if len(values) == n else np.zeros(n, np.uint64)


def _counts(rows: pd.DataFrame) -> tuple[Chunk, dict[tuple[int, str], np.ndarray]]:
    """A chunk and the counts of its words and bigrams, in the chunk's own order."""
    chunk, out = Chunk.from_bytes(read_whole(rows["chunk"].iloc[0])), {}
    for kind, keys in ((1, chunk.hashes), (2, chunk.pair_hashes)):
        own = rows[rows["kind"] == kind].sort_values("bucket")
        if len(own) != own["asked"].iloc[0]:
            raise RuntimeError("a chunk lacks answers: its input changed while the query ran")
        order = np.argsort(keys)
        edges = np.searchsorted(bucket_of(keys[order], int(rows["buckets"].iloc[0])), np.arange(int(rows["buckets"].iloc[0]) + 1))
        sizes = np.diff(edges)[own["bucket"]]
        for name in ("rest", "held"):
            values = np.empty(len(keys), np.uint64)
            values[order] = np.concatenate([_filled(v, n) for v, n in zip(own[name], sizes)])
            out[kind, name] = values.astype(np.float64)
    return chunk, out


def context_bucket(counts: np.ndarray, buckets: int) -> np.ndarray:
    """0 for a context never seen, else 1 more than the whole part of its logarithm in base 2."""
    return np.minimum(np.frexp(counts)[1], buckets - 1)


def _estimates(chunk: Chunk, words: np.ndarray, pairs: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context count, bigram and unigram maximum-likelihood estimate of each token."""
    context = words[chunk.before]
    p2 = np.divide(pairs[chunk.pair_at], context, out=np.zeros(len(context)), where=context > 0)
    p1 = words[chunk.tokens] / tokens if tokens else np.zeros(len(context))
    return context, p2, p1


def learn_weights(answers: DataFrame, model: Model, types: int, tokens: int) -> np.ndarray:
    """Weights (l2, l1, l0) of each context bucket, by EM over the held-out fold's tokens.

    A token matters by its bucket and its two likelihood ratios to the uniform estimate; these are
    tabled on a logarithmic grid, so a bucket's table doesn't grow with the corpus. Each bucket's
    weights are learned from its table by a task of its own, and only the weights reach the driver.
    A bucket without a held-out token takes the weights of the one below it.
    """
    schema = "bucket int, r2 int, r1 int, n bigint"
    none = -(1 << 20)

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        chunk, counts = _counts(rows)
        held = chunk.per_token(np.array([fold_of(d, model.folds) for d in chunk.doc_ids])) == 1
        context, p2, p1 = _estimates(chunk, counts[1, "rest"], counts[2, "rest"], tokens)
        ratios = [np.where(p > 0, np.round(np.log2(np.where(p > 0, p, 1) * (types + 1)) * model.grid), none).astype(np.int64)[held] for p in (p2, p1)]
        found, n = np.unique(np.stack([context_bucket(context, model.context_buckets)[held], *ratios]), axis=1, return_counts=True)
        return pd.DataFrame({"bucket": found[0], "r2": found[1], "r1": found[2], "n": n})

    def maximise(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["r2", "r1"])
        ratio = np.stack([np.where(own[c] == none, 0, np.exp2(own[c].astype(float) / model.grid)) for c in ("r2", "r1")] + [np.ones(len(own))], axis=1)
        n, w = own["n"].to_numpy(float), np.full(3, 1 / 3)
        for _ in range(model.rounds):
            share = ratio * w
            w = (n[:, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
        # Some weight stays on the uniform estimate: no text has probability 0.
        w = (w + [0, 0, 1e-6]) / (1 + 1e-6)
        return pd.DataFrame({"bucket": own["bucket"].iloc[:1], "l2": w[0], "l1": w[1], "l0": w[2]})

    cells = answers.groupBy("chunk").applyInPandas(table, schema).groupBy("bucket", "r2", "r1").agg(F.sum("n").alias("n"))
    learned = {r["bucket"]: np.array([r["l2"], r["l1"], r["l0"]]) for r in cells.groupBy("bucket").applyInPandas(maximise, "bucket int, l2 double, l1 double, l0 double").collect()}
    out, last = np.zeros((model.context_buckets, 3)), np.array([0.0, 0.0, 1.0] if not tokens else [0.0, 0.9, 0.1])
    for b in range(model.context_buckets):
        if b in learned:
            last = learned[b]
        elif b == 1 and tokens:
            last = np.array([0.3, 0.6, 0.1])
        out[b] = last
    return out


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """One row a document: base (add-0.1 unigram) and model log10 probability of the whole text.

    Null and empty texts are the end token alone; without a training document all counts are 0 and
    each token has the uniform estimate; repeated rows are scored, and counted, each.
    """
    buckets = buckets_for(docs)
    answers = count_ngrams(docs, model).withColumn("buckets", F.lit(buckets))
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "types_rest", "tokens", "tokens_rest")]).first()
    types, tokens = int(sums["types"]), int(sums["tokens"])
    weights = learn_weights(answers, model, int(sums["types_rest"]), int(sums["tokens_rest"]))

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        chunk, counts = _counts(rows)
        words, pairs = (counts[k, "rest"] + counts[k, "held"] for k in (1, 2))
        context, p2, p1 = _estimates(chunk, words, pairs, tokens)
        w = weights[context_bucket(context, model.context_buckets)]
        c = words[chunk.tokens]
        each = np.stack([np.log10((c + BASE_ADD) / (tokens + BASE_ADD * (types + 1))), np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (types + 1))])
        base, own = np.add.reduceat(each, chunk.first, axis=1)
        return pd.DataFrame(
            {
                "doc_id": pd.array(chunk.doc_ids, "Int64"),
                "held_out": [fold_of(d, model.folds) == 0 for d in chunk.doc_ids],
                "n_tokens": chunk.counts,
                "n_known": np.add.reduceat((c > 0).astype(np.int64), chunk.first),
                "train_tokens": tokens,
                "base_score": base,
                "score": own,
            }
        )

    return answers.groupBy("chunk").applyInPandas(score, SCORES)
