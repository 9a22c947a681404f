import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
from tests.llm.helpers import DOCS
from tests.llm.test_join import brute as brute_join
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_single import BASE, brute_repeats, plain_ids

import corpus_pipeline
from quern.llm import line_dedup


def js(p, q):
    """Jensen-Shannon distance of two histograms, by the definition."""
    out = 0.0
    for x, y in zip(p, q):
        m = (x + y) / 2
        out += sum(v * math.log2(v / m) / 2 for v in (x, y) if v > 0)
    return math.sqrt(max(0.0, out))


def classes(text):
    """Shares of lower, upper, other letters, digits, white space, stops, brackets and quotes, symbols."""
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c in ".,;:!?" else 6 if c in "()[]{}\"'`-_/\\" else 7
    found = Counter(map(kind, text))
    return [found[k] / max(1, len(text)) for k in range(8)]


def kept_by_quality(rows, min_words, min_class_chars):
    """Ids that the quality rules keep, restated: base rules, then the nearest of the languages in both tests."""
    words = {lang: Counter(w for r in rows if r[2] == lang for w in (r[1] or "").lower().split()) for lang in {r[2] for r in rows}}
    refs = []
    for lang, counts in words.items():
        top = sorted(counts, key=lambda w: (-counts[w], w))[:64]
        shares = [counts[w] / sum(counts.values()) for w in top]
        refs.append((classes("".join(r[1] or "" for r in rows if r[2] == lang)), top, [*shares, max(0.0, 1 - sum(shares))]))
    out = []
    for i, text, *_ in rows:
        ws = (text or "").split()
        if len(ws) < min_words or 100 * brute_repeats(ws) > 50 * len(ws):
            continue
        low = text.lower().split()
        by_class, by_word = len(text) >= min_class_chars, len(ws) >= 50
        most = 0.43 + 0.5 / math.sqrt(len(ws))
        good = not by_class and not by_word
        for shares, top, word_shares in refs:
            own = [low.count(w) / len(low) for w in top]
            good |= (not by_class or js(classes(text), shares) <= 0.30) and (not by_word or js([*own, 1 - sum(own)], word_shares) <= most) and (by_class or by_word)
        if good:
            out.append(i)
    return out


def hidden(text):
    """Mails, addresses, cards and phones by their patterns, replaced; the corpus has no other kinds."""
    spans = sorted((m.start(), -m.end(), k) for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m[0]))
    out, at = "", 0
    for start, end, kind in spans:
        if start >= at:
            out += f"{text[at:start]}[{kind.upper()}]"
        at = max(at, -end)
    return out + text[at:]


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "and", "to", "in", *[f"w{k}" for k in range(300)]]
    weights = [1 / (k + 1) for k in range(len(words))]
    prose = lambda n: " ".join(rng.choices(words, weights, k=n))
    out = []
    for i in range(120):
        out.append(f"{prose(150)}\nshared boilerplate line of every site\n{prose(60)} mail me.{i}@x.org")
    out += [out[3], out[4] + " tail", out[5], "!! ".join(w.upper() for w in rng.choices(words, k=100)), "short text stays", "", None, "again and " * 40]
    out += [f"{prose(90)} call +49 170 123{i}567 from 10.0.{i}.1 with 4539 5787 6362 1486" for i in range(9)]
    return [(i, t, "en", f"s{i % 7}", len(t or "")) for i, t in enumerate(out)]


def test_pipeline_equals_stage_by_stage(spark, tmp_path):
    rows = corpus()
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    ids = set(kept_by_quality(rows, 1, 80))
    kept = [r for r in rows if r[0] in ids]
    assert 100 < len(kept) < len(rows) and 124 in ids and 123 not in ids and 127 not in ids
    lines = brute_lines([(r[0], r[1], r[3]) for r in kept], line_dedup.Spread())
    ids = [r[0] for r in kept]
    groups = brute_join([lines[i] for i in ids], 5, 80)
    left = [i for k, i in enumerate(ids) if groups[k][1] == k]
    want = {i: plain_ids(public_tokenizers.path("word_bpe_49k.json"), hidden(lines[i]), 2) for i in left}
    got: dict = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want and len(left) < len(kept)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns


def test_stages_take_empty_and_odd_tables(spark):
    from tests.llm.helpers import docs, odd_docs

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs(spark, []), "").count() == 0
        stage(spark, odd_docs(spark), "").collect()
