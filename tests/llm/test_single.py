"""Operators on single documents against brute force and round trips."""

import random
import re
import struct
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, docs, odd_docs

from quern.llm import media, packing, pii, quality, tokenfile
from quern.llm.common import Encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@cache
def tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def plain_ids(path, text, end):
    return [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_tokenizer(path):
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "é", "'", "s", ".", ",", " ", " ", "\n", "\t", "1", "9", " ", " ", "ß", "!", "$", "你", "🙂", "\x0b", "İ", "Σ", "ll", "'ve"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    own = Encoder(path, keep=500)
    for t, ids in zip(texts, own.encode(texts)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == plain_ids(path, t, 0)[:-1], repr(t)


def test_packing_holds_every_id_once(spark):
    frame = odd_docs(spark).repartition(3)
    rows = packing.pack(frame, WORDS, open_windows=2, size=64).collect()
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])
        assert sum(p.length for p in pieces) <= 64
    for doc_id, text in [*enumerate(ODD), (None, "no id at all")]:
        want = plain_ids(WORDS, text, 2)
        pieces = by_doc[doc_id]
        if doc_id == 6:  # a repeated row
            assert sum(p.length for p in pieces) == 2 * len(want)
            continue
        pieces.sort(key=lambda r: r.start)
        got = b"".join(p.ids for p in pieces)
        assert list(np.frombuffer(got, "<u4")) == want and {p.doc_tokens for p in pieces} == {len(want)}
        assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces])[:-1])


def test_packing_pads_little(spark):
    rng = random.Random(2)
    frame = docs(spark, [" ".join(rng.choices(["a", "the", "cat"], k=int(rng.expovariate(1 / 300)))) for _ in range(4000)]).repartition(4)
    rows = packing.pack(frame, WORDS, size=1024).select("sequence_id", "length").collect()
    n = len({r.sequence_id for r in rows})
    assert sum(r.length for r in rows) / (n * 1024) > 0.97


def test_empty_tables(spark):
    none = docs(spark, [])
    assert packing.pack(none, WORDS).count() == 0
    assert quality.quality_rules(none).count() == 0 and quality.keep_good(none).count() == 0
    assert media.decode_media(media.encode_media(none)).count() == 0
    assert pii.pii_spans(none).count() == 0 and pii.redact_documents(none).count() == 0


def brute_repeats(words):
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    return len(inside)


def test_base_counts():
    rng = random.Random(3)
    texts = [t or "" for t in ODD if len(t or "") < 2000] + [" ".join(rng.choices("abc", k=rng.randint(0, 30))) + rng.choice(["", "\n", " \n \n"]) * 2 for _ in range(200)]
    for t in texts:
        words, got, lines = re.findall(r"[^\x20\x09-\x0D]+", t), quality.base_counts(t), t.split("\n")
        dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:k] for k, x in enumerate(lines))
        assert got == {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": dup, "n_repeat_words": brute_repeats(words)}


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(4)
    vocabulary = {lang: [f"{lang}{''.join(rng.choices('aeiounrst', k=4))}" for _ in range(400)] for lang in ("x", "y")}
    weights = [1 / (k + 1) for k in range(400)]
    texts = [" ".join(rng.choices(vocabulary[lang], weights, k=200)) + "." for lang in "xy" for _ in range(60)]
    junk = ["!! ".join(w.upper() for w in rng.choices(vocabulary["x"], k=120)) for _ in range(5)] + ["short text", None]
    frame = docs(spark, texts + junk).withColumn("lang", F.when(F.col("doc_id").between(60, 119), "y").otherwise("x"))
    rows = {r.doc_id: r for r in quality.quality_rules(frame).collect()}
    assert all(rows[k].kept for k in range(120)) and not any(rows[120 + k].kept for k in range(7))
    assert {r.doc_id for r in quality.keep_good(frame).collect()} == {k for k, r in rows.items() if r.kept}


@pytest.mark.parametrize("op", ["pack", "quality", "lm", "lines", "media", "bpe", "pii", "files"])
def test_a_table_twice_is_answered_twice(spark, tmp_path, op):
    """Equal partitions, equal rows: twice the rows, and what belongs to a row doesn't change."""
    from quern.llm import bpe, line_dedup, lm_scoring

    texts = [t for t in ODD if t is None or len(t) < 3000] + ["long " + " ".join(f"w{k % 977}" for k in range(120_000))]
    frame = docs(spark, texts, source="s").coalesce(2)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    run = {
        "pack": lambda d: packing.pack(d, WORDS).select("doc_id", "start", "length", "doc_tokens", "ids"),
        "quality": lambda d: quality.quality_rules(d).select("doc_id", "n_words", "n_repeat_words", "base_failed"),
        "lm": lambda d: lm_scoring.score_documents(d).select("doc_id", "held_out", "n_tokens"),
        "lines": lambda d: line_dedup.drop_boilerplate(d, counts=True).select("doc_id", "text", "n_lines"),
        "media": lambda d: media.decode_media(media.encode_media(d)).select("doc_id", "payload", "media", "feature"),
        "bpe": lambda d: bpe.encode_documents(d, path, public_tokenizers.PATTERN),
        "pii": lambda d: pii.pii_spans(d),
        "files": lambda d: tokenfile.read_token_files(spark, tokenfile.write_token_files(d, BYTES, f"file://{tmp_path}/f{d.count()}")).select("doc_id", "ids"),
    }[op]
    plain = lambda rows: sorted(map(repr, rows))
    one, two = run(frame).collect(), run(frame.union(frame)).collect()
    assert len(one) >= len(texts) and plain(two) == sorted(plain(one) * 2)


def test_texts_of_megabytes():
    """Whole texts: what stands at their end counts, and nothing grows out of bounds."""
    text = " ".join(f"word{k % 50_000}" for k in range(400_000)) + " mail end@x.org DE89 3704 0044 0532 0130 00"
    words = text.split()
    counts = quality.base_counts(text)
    assert counts["n_words"] == len(words) and counts["n_repeat_words"] == 400_000  # the numbered words come eight times over
    kinds = [k for k, *_ in pii.find_spans(text)]
    assert kinds == ["email", "iban"] and pii.redact(text).endswith("mail [EMAIL] [IBAN]")
    payload = media.pad_payload(text.encode())
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload


def test_long_texts_count_alike():
    rng = random.Random(12)
    for n in (3, 4, 50, 700):
        words = rng.choices([f"w{k}" for k in range(9)], k=n)
        assert quality.long_repeat_words(words) == quality.repeat_words(words) == brute_repeats(words)


def slow_hash(image):
    """The cosine-transform hash by its definition: cell means, sums of cosines, the median of all but the first."""
    import math
    import statistics

    gray = image[..., :1].astype(float).mean(axis=2)
    for axis in (0, 1):
        n = gray.shape[axis]
        edges = [k * n // 32 for k in range(33)]
        cells = [np.take(gray, range(a, max(a + 1, b)), axis=axis).mean(axis=axis) for a, b in zip(edges, edges[1:])]
        gray = np.stack(cells, axis=axis)
    c = [[math.cos(math.pi * k * (2 * x + 1) / 64) for x in range(32)] for k in range(8)]
    low = [round(sum(c[u][y] * c[v][x] * gray[y, x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low[1:])
    return int("".join("1" if x > middle else "0" for x in low), 2).to_bytes(8, "big")


def test_feature_equals_its_definition():
    rng = np.random.default_rng(5)
    for text in ("", "some text " * 30, "".join(map(chr, rng.integers(32, 126, 40_000)))):
        image = media.decode_png(media.encode_png(media.pad_payload(text.encode())))
        assert media.low_frequency_hash(image) == slow_hash(image)


def test_filters_of_all_kinds_are_undone():
    """Rows of mixed filters, images of several widths and kinds in one batch, against a loop over samples."""
    rng = np.random.default_rng(9)
    images, want = [], []
    for _ in range(30):
        h, w, c = rng.integers(1, 9), rng.choice([1, 3, 7]), rng.choice([1, 2, 3, 4])
        kinds, rows = rng.integers(0, 5, h).astype(np.uint8), rng.integers(0, 256, (h, w, c)).astype(np.uint8)
        out = np.zeros((h, w, c), int)
        for y in range(h):
            for x in range(w):
                for k in range(c):
                    a, b = out[y, x - 1, k] if x else 0, out[y - 1, x, k] if y else 0
                    d = out[y - 1, x - 1, k] if x and y else 0
                    near = min((abs(a + b - d - v), i, v) for i, v in enumerate((a, b, d)))[2]
                    out[y, x, k] = (int(rows[y, x, k]) + (0, a, b, (a + b) // 2, near)[kinds[y]]) % 256
        images.append((kinds, rows))
        want.append(out)
    for got, expected in zip(media.unfiltered(images), want):
        assert (got == expected).all()
    mixed = media.encode_png(bytes(range(256)) * 9 + bytes(rng.integers(0, 256, 2304).astype(np.uint8)) + b"text of letters " * 36 * 3, 576)
    assert len(set(media._filtered_rows(mixed)[0].tolist())) > 1


def test_references_count_everything(spark):
    frame = docs(spark, ["a a b", "b c", None], lang="q")
    refs = quality.learn_references(frame)
    assert refs.languages == ["q"] and refs.words[0] == ["a", "b", "c"] and np.allclose(refs.shares[0], [0.4, 0.4, 0.2, 0])
    assert np.isclose(refs.classes.sum(), 1)


def test_every_language_has_a_reference(spark):
    """40 languages; the 33rd and later, with the fewest characters, are judged by their own words too."""
    rng, langs = random.Random(8), [f"l{k:02}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = []
    for k, lang in enumerate(langs):
        vocabulary = [f"{lang}{''.join(rng.choices('aeiounrst', k=4))}" for _ in range(300)]
        rows += [(" ".join(rng.choices(vocabulary, weights, k=200)) + ".", lang) for _ in range(45 - k)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    refs = quality.learn_references(frame)
    assert sorted(refs.languages) == langs and refs.classes.shape == (40, 8)
    assert all(r.kept for r in quality.quality_rules(frame).collect()) and quality.keep_good(frame).count() == len(rows)
    # Distances by entries equal those of whole histograms.
    for text, _ in rows[::40]:
        words, seen = text.lower().encode().split(), text.lower().split()
        own = [np.array([seen.count(w) for w in common], float) for common in refs.words]
        want = [quality.js_distance(np.append(x, len(words) - x.sum()) / len(words), s) for x, s in zip(own, refs.shares)]
        assert np.allclose(refs.word_distances(words), want, atol=1e-7)


def test_js_distance():
    assert np.isclose(quality.js_distance(np.array([1.0, 0]), np.array([0, 1.0])), 1) and quality.js_distance(np.array([0.5, 0.5]), np.array([0.5, 0.5])) == 0


@pytest.mark.parametrize("color", [0, 2, 4, 6])
@pytest.mark.parametrize("row_filter", range(5))
def test_png_round_trip(color, row_filter):
    step, rng = media.SAMPLES[color], np.random.default_rng(row_filter)
    samples = rng.integers(0, 256, 7 * 5 * step, np.uint8).tobytes()
    data = media.encode_png(samples, 5, color, row_filter)
    assert media.decode_png(data).tobytes() == samples
    for k in range(0, len(data), 7):  # any changed byte is noticed
        with pytest.raises(media.BadImage):
            media.decode_png(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
    for k in range(len(data)):
        with pytest.raises(media.BadImage):
            media.decode_png(data[:k])


def test_media_columns(spark):
    rows = media.decode_media(media.encode_media(odd_docs(spark))).collect()
    for r in rows:
        data = ((ODD[r.doc_id] if r.doc_id is not None else "no id at all") or "").encode()
        assert r.n_bytes == len(data) and r.payload[: len(data)] == data and set(r.payload[len(data) :]) <= {255}
        assert len(r.payload) % 576 == 0 and len(r.payload) and len(r.feature) == 8 and r.error is None
    broken = spark.createDataFrame([(1, 1, bytearray(b"no")), (2, 2, None)], "doc_id long, n_bytes long, media binary")
    assert [(r.payload, r.error) for r in media.decode_media(broken).orderBy("doc_id").collect()] == [(None, "signature"), (None, None)]


def test_hash_is_of_the_low_frequencies():
    y, x = np.mgrid[:96, :576]
    image = (127 + 100 * np.cos(np.pi * x / 576) * np.cos(np.pi * y / 96)).astype(np.uint8)[..., None]
    noisy = np.clip(image.astype(int) + np.random.default_rng(0).integers(-9, 9, image.shape), 0, 255).astype(np.uint8)
    bits = lambda b: np.unpackbits(np.frombuffer(media.low_frequency_hash(b), np.uint8))
    other = (255 - image)[:, ::-1] // 2 + (x % 64)[..., None].astype(np.uint8)
    assert media.low_frequency_hash(image) == media.low_frequency_hash(image.copy())
    assert (bits(image) != bits(other.astype(np.uint8))).sum() >= 1 and bits(noisy)[1] == bits(image)[1]


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub(r"\D", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub(r"\D", "", s)) <= 15),
}


def test_pii_base_equals_the_patterns():
    rng = random.Random(5)
    alphabet = ["a", "Z", "0", "1", "25", "255", "4539578763621486", ".", "@", "-", "+", " ", "(", ")", "%", "_", "é", "x.", "@b.c", "\n", "+49 "]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(20000)]
    for t in texts:
        want = [(k, *m.span()) for k, (p, ok) in BASE.items() for m in re.finditer(p, t) if ok(m[0])]
        assert [s for s in pii.find_spans(t) if s[0] in BASE] == want, repr(t)


def test_pii_added_kinds_and_redaction(spark):
    text = ODD[-1]
    got = {k: text[s:e] for k, s, e in pii.find_spans(text)}
    assert got["secret"] == "04dbebab91ab85687d33eeaaf9ac699e1188f962" and got["url"] == "https://x.org/a?b=c"
    assert got["iban"] == "DE89 3704 0044 0532 0130 00" and got["account"] == "12345678"
    assert "@" not in pii.redact("write to a.b@c.de now") and pii.redact(None) is None and pii.redact("clean") == "clean"
    rows = {r.doc_id: r for r in pii.redact_documents(odd_docs(spark)).collect()}
    assert len(rows) == len(ODD) + 1 and rows[0].text is None and rows[13].text.startswith("[EMAIL]")


def test_pii_accounts_and_ibans_at_one_cue():
    iban = "DE89 3704 0044 0532 0130 00"
    for text, want in (
        (f"Account: 12345678, IBAN {iban}", [("iban", iban), ("account", "12345678")]),
        ("account 12345678 for order AB12CDEFGHIJKLMNO", [("account", "12345678")]),
        (f"account 12345678 {iban}", [("iban", iban), ("account", "12345678")]),
        (f"account 12345678 for order AB12CDEFGHIJKLMNO, {iban}", [("iban", iban), ("account", "12345678")]),
        (f"IBAN {iban}", [("iban", iban)]),
        (f"account IBAN: {iban}.", [("iban", iban)]),
        (f"The account that we use for this is {'now ' * 4}{iban}, thanks", [("iban", iban)]),
        (f"account {'x' * 70} {iban}", [("iban", iban)]),
        (f"no cue at all, {iban} and xDE89370400440532013000", [("iban", iban)]),
        (f"{iban} {iban}", [("iban", iban)] * 2),
        ("DE88 3704 0044 0532 0130 00", []),
    ):
        found = [(k, text[s:e]) for k, s, e in pii.find_spans(text)]
        assert [f for f in found if f[0] in ("iban", "account")] == want, text
    assert pii.redact(f"Account: 12345678, IBAN {iban}") == "Account: [ACCOUNT], IBAN [IBAN]"


def test_elias_fano():
    rng = np.random.default_rng(6)
    for n, top in ((0, 1), (1, 0), (1, 2**62), (5, 3), (1000, 10), (3000, 10**12), (700, 2**62)):
        values = np.sort(rng.integers(0, top + 1, n))
        ef = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.of(values).to_bytes())
        assert ef.all().tolist() == values.tolist() and [ef.select(i) for i in range(n)] == values.tolist()
        for i, j in ((0, 0), (n // 3, n // 2), (n // 2, n), (max(0, n - 1), n), (min(n, 255), min(n, 257)), (min(n, 256), min(n, 512))):
            assert ef.span(i, j).tolist() == values[i:j].tolist()
        if n >= 700:
            assert len(ef.to_bytes()) * 8 < n * (2.5 + max(1, np.log2(top / n))) + 500


def test_token_files(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    shards = tokenfile.write_token_files(odd_docs(spark).repartition(3), BYTES, folder, shard_ids=500)
    rows = tokenfile.read_token_files(spark, shards).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *sorted([*range(len(ODD)), 6])]
    assert [r.start for r in rows] == list(np.cumsum([0] + [len(r.ids) // 4 for r in rows])[:-1])
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == plain_ids(BYTES, ODD[r.doc_id] if r.doc_id is not None else "no id at all", 0)
    one = shards.collect()[0]
    shard = tokenfile.Shard(open(one.path.removeprefix("file://"), "rb").read())
    assert shard.document(1).tolist() == np.frombuffer(rows[1].ids, "<u4").tolist()
    none = tokenfile.write_token_files(docs(spark, []), BYTES, folder + "0")
    assert none.count() == 0 and tokenfile.read_token_files(spark, none).count() == 0
    with pytest.raises(ValueError):
        tokenfile.shard_bytes([1], [struct.pack("<2I", 70000, 0)], 2)
    data = tokenfile.shard_bytes([None, None, -5, 7], [struct.pack("<2I", 5, 0)] * 4, 2)
    assert tokenfile.Shard(data).doc_ids(1, 4) == [None, -5, 7] and tokenfile.Shard(data).starts(2, 4).tolist() == [4, 6, 8]
    with pytest.raises(ValueError):
        tokenfile.Shard(data[:-1] + bytes([data[-1] ^ 1]))
    assert zlib.crc32(data[:-4]) == struct.unpack("<I", data[-4:])[0]
