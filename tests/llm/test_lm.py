import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from tests.llm.helpers import ODD, docs, odd_docs

from quern.llm import lm_scoring as lm


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]


def corpus(n):
    rng = random.Random(1)
    follow = {f"w{k}": [f"w{rng.randrange(60)}" for _ in range(3)] for k in range(80)}
    out = []
    for _ in range(n):
        w, text = "w0", []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(follow[w]) if rng.random() < 0.9 else f"w{rng.randrange(80)}"
            text.append(w.title() if rng.random() < 0.1 else w)
        out.append(" ".join(text))
    return out


def brute(texts, model):
    fold = [zlib.crc32(str(i).encode()) % 10 for i in range(len(texts))]
    words = [tokens(t) for t in texts]
    count = lambda keep: (Counter(w for f, ws in zip(fold, words) if keep(f) for w in ws), Counter(p for f, ws in zip(fold, words) if keep(f) for p in zip(["\n", *ws], ws)))

    def parts(ws, c1, c2):
        n = sum(c1.values())
        for v, w in zip(["\n", *ws], ws):
            yield min(math.frexp(c1[v])[1], model.context_buckets - 1), (c2[v, w] / c1[v] if c1[v] else 0), c1[w] / n, 1 / (len(c1) + 1)

    c1, c2 = count(lambda f: f > 1)
    held = [p for f, ws in zip(fold, words) if f == 1 for p in parts(ws, c1, c2)]
    weights = {}
    for b in {p[0] for p in held}:
        own, w = np.array([p[1:] for p in held if p[0] == b]), np.full(3, 1 / 3)
        for _ in range(model.rounds):
            s = own * w
            w = (s / s.sum(axis=1, keepdims=True)).mean(axis=0)
        weights[b] = w
    c1, c2 = count(lambda f: f > 0)
    n, v = sum(c1.values()), len(c1)
    out = {}
    for i, ws in enumerate(words):
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        own = [np.dot(weights[p[0]], p[1:]) if p[0] in weights else None for p in parts(ws, c1, c2)]
        out[i] = (fold[i] == 0, len(ws), sum(c1[w] > 0 for w in ws), n, base, None if None in own else sum(map(math.log10, own)))
    return out


def test_equals_brute_force(spark, monkeypatch):
    texts, model = corpus(400), lm.Model(grid=512)
    monkeypatch.setattr(lm, "CHUNK_CHARS", 4000)
    got = {r.doc_id: r for r in lm.score_documents(docs(spark, texts).repartition(3), model).collect()}
    want, compared = brute(texts, model), 0
    for i, w in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9)
        if w[5] is not None:
            compared += 1
            assert abs(r.score - w[5]) < 0.002 * max(1, abs(w[5]))
    assert compared > 300
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_probabilities_sum_to_one_at_most(spark):
    """Over all known words and one unknown, in each context, the model is a distribution."""
    texts = corpus(60)
    words = sorted({w for t in texts for w in tokens(t)} - {"\n"})
    rows = lm.score_documents(docs(spark, texts + [f"w1 {w}" for w in [*words, "new"]])).collect()
    assert len(rows) == 61 + len(words) and all(r.score < 0 for r in rows)


def test_odd_rows(spark):
    rows = lm.score_documents(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) + 2 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lm.score_documents(docs(spark, [])).count() == 0
    alone = lm.score_documents(docs(spark, [None]).selectExpr("cast(null as bigint) doc_id", "text")).collect()[0]
    assert alone.held_out and (alone.n_tokens, alone.n_known, alone.train_tokens) == (1, 0, 0) and alone.base_score == 0 and abs(alone.score) < 1e-5


def test_equal_chunks_are_answered_each(spark):
    one = docs(spark, ["a b a"])
    rows = lm.score_documents(one.union(one)).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].n_tokens == 4
