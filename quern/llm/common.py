"""Shared pieces of the training-data operators: text batches, tokenizer caches, shared storage."""

from __future__ import annotations

import gc
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.compat import shared_dir

#: Entries that one worker's word cache holds before it keeps only those in use (about 180 MB).
CACHE_WORDS = 800_000
#: Characters of the documents whose unseen words are encoded in one call of the tokenizer.
GROUP_CHARS = 10 << 20
JOINED_WORDS = 128
SMALL_TASK_WORDS = 500_000

#: Words cut at a blank or line end that can't be encoded on their own: white space meets there.
_MEETS = re.compile(r"\s\s|\s\Z|\A[^\S\n]|\A\Z")
#: A stop between a letter and a blank is a word of its own, marked as one without a blank before it.
# The stop is tried first, so the engine skips from one to the next.
_STOP = re.compile(r"([.,])(?<=[A-Za-z].)(?![^ \n])")
_MARK = "\x02"


#: Rows of one Arrow batch between the JVM and Python; both hold a batch outside the heap.
BATCH_ROWS = 1024


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id bigint, text string), so extra columns of any name can't clash; nulls stay.

    Also bounds the session's Arrow batches: whole texts in batches of Spark's default rows are large.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def staged(df: DataFrame, kind: str, *partition_by: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.option("compression", "zstd").mode("overwrite").parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def by_batch(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str, batch_rows: int = 256) -> DataFrame:
    """mapInArrow over column lists: rows gets {column: values} of at most batch_rows rows; a task gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                out = rows({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
                del out
        trim_memory()

    small_batches(df.sparkSession)
    arrow = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


class Encoder:
    """Ids of whole texts by a tokenizers JSON file, as little-endian unsigned 32-bit bytes.

    The text is cut at blanks and line ends; each distinct cut word is encoded once and kept in a
    bounded cache. A byte-level file marks the blank before a word, and there a new word starts
    whatever stands around, unless white space meets: such a text goes to the tokenizer whole. The
    other files drop white space. Equal to Tokenizer.encode(text, add_special_tokens=False) for any
    text (tests/llm).
    """

    def __init__(self, path: str, keep: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.marks_blank = self.tokenizer.normalizer is None
        self.parting = "\n" if self.marks_blank else " ~ "
        self.keep = keep
        self.used, self.last = 0, []  # words cut since rest(), those of the last call
        #: Of each cut word, its ids; None if it can't be encoded on its own.
        self.known: dict[str, bytes | None] = {}

    def rest(self) -> None:
        """At a task's end: after a small task only its last words stay, and memory goes back. Many small
        tasks run in more workers than there are cores, and a full cache in each is too much."""
        if self.used < SMALL_TASK_WORDS:
            self.known = {w: self.known[w] for w in self.last if w in self.known}
        self.used, self.last = 0, []
        trim_memory()

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(i)}I", *i) for i in [e.ids for e in found]]

    def _parted(self, text: str) -> str:
        """The text with a blank between any two words; empty if it can't be cut."""
        if not self.marks_blank:
            text = text.lower() if text.isascii() else text
            return _STOP.sub(r" \1", text).replace("\n", " ")
        if _MARK in text:
            return ""
        # A word that starts a line keeps the line end, all others have a blank before them. The
        # first word is cut as if it started a line; _group takes that line end's id off again.
        return _STOP.sub(rf" {_MARK}\1", "\n" + text).replace("\n", " \n")[1:]

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone are encoded many at a time, parted by a token none of them has."""
        known = self.known
        parting = self.tokenizer.encode(self.parting.strip(" "), add_special_tokens=False).ids
        letters = [w for w in words if w.isalpha()] if len(parting) == 1 else []
        if self.marks_blank and len(parting) == 1:
            # A line end and letters: put end to end, each starts with the parting token itself.
            lines = [w for w in words if w[:1] == "\n" and w[1:].isalpha()]
            for k in range(0, len(lines), JOINED_WORDS):
                some = lines[k : k + JOINED_WORDS]
                ids = np.array(self.tokenizer.encode("".join(some), add_special_tokens=False).ids, "<u4")
                starts = (4 * np.flatnonzero(ids == parting[0])).tolist()
                ids = ids.tobytes()
                known.update(zip(some, [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]))
        at = range(0, len(letters), JOINED_WORDS)
        lead = " " if self.marks_blank else ""
        found = self.tokenizer.encode_batch([self.parting.join([lead + w for w in letters[k : k + JOINED_WORDS]]) for k in at], add_special_tokens=False)
        for k, e in zip(at, found):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == parting[0])).tolist()
            ids = ids.tobytes()
            known.update(zip(letters[k : k + JOINED_WORDS], [ids[a:b] for a, b in zip([0, *[x + 4 for x in ends]], [*ends, len(ids)])]))
        rest = [w for w in words if w not in known]
        if not self.marks_blank:
            known.update(zip(rest, self.whole(rest)))
            return
        known.update(dict.fromkeys(rest))
        alone = [w for w in rest if not _MEETS.search(w) and (w[0] != _MARK or len(w) == 2)]
        known.update(zip(alone, self.whole([w if w[0] == "\n" else w[1] if w[0] == _MARK else " " + w for w in alone])))

    def encode(self, texts: list[str]) -> list[bytes]:
        collects = gc.isenabled()
        gc.disable()  # a big cache of strings makes each collection slow, and nothing here is cyclic
        try:
            return self._group(texts)
        finally:
            if collects:
                gc.enable()

    def _group(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # Arrow cuts the texts, numbers their words and puts the ids together; only distinct words are looked up.
        cut, known = pc.split_pattern(pa.array([self._parted(t) for t in texts], pa.large_string()), " "), self.known
        numbered = cut.values.dictionary_encode()
        need = numbered.dictionary.to_pylist()
        values = list(map(known.get, need))
        gaps = [k for k, v in enumerate(values) if v is None]
        missing = [need[k] for k in gaps if need[k] not in known]
        if len(known) + len(missing) > self.keep:
            # Words of the present documents stay: most words to come are among them.
            known = self.known = {w: known[w] for w in need if w in known}
        if missing:
            self._learn(missing)
        known = self.known
        for k in gaps:
            values[k] = known[need[k]]
        self.used, self.last = self.used + len(numbered), need
        ends = cut.offsets.to_numpy()
        found = pa.array([v or b"" for v in values], pa.large_binary()).take(numbered.indices)
        data, at = found.buffers()[2], np.frombuffer(found.buffers()[1], np.int64, len(found) + 1, 8 * found.offset)[ends]
        data = memoryview(data) if data else memoryview(b"")
        # Texts with a word that has no ids of its own are encoded whole.
        hard = np.array([v is None for v in values])
        whole = np.diff(np.append(0, np.cumsum(hard[numbered.indices.to_numpy()]))[ends]) > 0 if hard.any() else np.zeros(len(texts), bool)
        skip = 4 if self.marks_blank else 0
        return [b"" if not t else self.whole([t])[0] if w else bytes(data[a + skip : b]) for t, w, a, b in zip(texts, whole.tolist(), at[:-1].tolist(), at[1:].tolist())]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file; the cache lives on between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- numbers of words, packed arrays and files that more than one operator uses


class Hashes(dict):
    """64-bit hash of each word (bytes), kept; cleared by fresh() once it holds keep words."""

    def __init__(self, keep: int = 1_000_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.keep:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(*hashes: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row of hashes, in order."""
    out = mixed(hashes[0])
    for h in hashes[1:]:
        out = mixed(out * np.uint64(3) + h)
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key; grows with the key, so sorted keys fall into runs."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, lowest first, without the empty high ones."""
    values = np.ascontiguousarray(values, "<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    width = data[0]
    n = (len(data) - 1) // width if width else 0
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, 1).reshape(width, n).T
    return out.view("<u8").ravel()


def sorted_planes(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unsorted_planes(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data), dtype=np.uint64)


def file_system(uri: str):
    """(file system, path) of a URI: local, HDFS or an object store."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """A file under a name of its own, then moved: readers see a whole file or none."""
    fs, path = file_system(uri)
    own = f"{path}.{uuid.uuid4().hex}.part"
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, path)


def read_whole(uri: str) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def trim_memory() -> None:
    """Gives free memory back to the system at a task's end: workers are kept, and share an executor's limit."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


#: Bytes of input, as the planner estimates them, for each bucket of packed keys.
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 16


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(docs: DataFrame) -> int:
    """Buckets that a chunk's keys are dealt into: more for a larger input, so a bucket's size stays bounded.

    The number has no effect on results. It is kept below MOST_BUCKETS, as an estimate after joins
    can be far too high.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_partitions(docs.sparkSession), min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))


def chunk_name(folder: str, number: int, data: bytes) -> str:
    """Name of a task's chunk: the same if the task runs again, another for equal chunks elsewhere."""
    from pyspark import TaskContext

    return f"{folder}/{TaskContext.get().partitionId()}-{number}-{hashlib.sha1(data).hexdigest()}"


def chunks_of(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of consecutive rows with about chars characters each; null text as empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                ids.append(i)
                texts.append(t or "")
                size += len(t or "")
                if size >= chars:
                    yield ids, texts
                    ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
