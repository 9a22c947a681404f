import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from tests.llm.helpers import ODD, docs, odd_docs

from quern.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def plain():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(spark):
    rng, own = random.Random(7), plain()
    alphabet = ["a", "B", "é", "'", "s", ".", ",", " ", " ", "\n", "\t", "1", "\xa0", " ", "ß", "!", "你", "🙂", "\x0b", "\x1c", "\x85", "'ve", "'re", "²", "ⅷ", "́"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(1500)]
    frame = docs(spark, texts).repartition(3)
    got = {r.doc_id: r for r in bpe.decode_documents(bpe.encode_documents(frame, PATH, public_tokenizers.PATTERN, chunk_chars=3000), PATH).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = own.encode_ordinary(t or "")
        assert np.frombuffer(got[k].ids, "<u4").tolist() == want and got[k].n_tokens == len(want), repr(t)
        assert bytes(got[k].decoded).decode() == (t or "")


def test_odd_rows(spark):
    rows = bpe.encode_documents(odd_docs(spark), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) + 2 and sum(r.doc_id is None for r in rows) == 1
    assert bpe.encode_documents(docs(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode_documents(docs(spark, ["", None]), PATH, public_tokenizers.PATTERN).select("n_tokens").distinct().collect()[0][0] == 0


def test_query(spark, tmp_path):
    docs(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    own = plain()
    for r in queries.op6_byte_bpe(spark, str(tmp_path)).collect():
        ids = own.encode_ordinary(ODD[r.doc_id] or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((ODD[r.doc_id] or "").encode()).hexdigest()


def test_queries_of_single_documents(spark, tmp_path):
    docs(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op8_pii(spark, str(tmp_path)).collect()}
    assert rows[13].n_email == 4 and rows[14].n_ip == 4 and rows[0].spans == "" and rows[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    for name in ("op1_packing", "op2_quality_rules", "op5_media_columns", "op9_token_files"):
        assert queries.queries()[name](spark, str(tmp_path)).select("doc_id").distinct().count() == len(ODD)


def test_equal_chunks_are_answered_each(spark):
    one = docs(spark, ["a b a"])
    rows = bpe.encode_documents(one.union(one), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
    # Null ids and other words of the same bucket: equal data but for the words.
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a, b = [f"w{chr(97 + k)}" for k in range(26) if zlib.crc32(f"w{chr(97 + k)}".encode()) % buckets == 0][:2]
    null = [docs(spark, [w]).selectExpr("cast(null as bigint) doc_id", "text") for w in (a, b)]
    got = bpe.decode_documents(bpe.encode_documents(null[0].union(null[1]), PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted(bytes(r.decoded).decode() for r in got) == [a, b]
