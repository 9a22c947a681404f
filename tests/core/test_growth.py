"""Steps whose work must not outgrow the input, against plain loops and the old forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import mixtures


def em(x, means, covariances, weights, iterations):
    """Expectation maximisation, a component at a time."""
    for _ in range(iterations):
        p = []
        for m, s, w in zip(means, covariances, weights):
            d = x - m
            p.append(w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)) / math.sqrt((2 * math.pi) ** x.shape[1] * np.linalg.det(s)))
        p = np.array(p)
        likelihood = np.log(p.sum(axis=0)).sum()
        p /= p.sum(axis=0)
        weights = p.sum(axis=1) / len(x)
        means = [(q[:, None] * x).sum(axis=0) / q.sum() for q in p]
        covariances = [((x - m).T * q) @ (x - m) / q.sum() + mixtures.LEAST_VARIANCE * np.eye(x.shape[1]) for q, m in zip(p, means)]
    return np.array(means), likelihood


def test_mixtures_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)) + 3 * rng.integers(0, 3, (90, 1))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(3)
    center = x.mean(axis=0)
    start = mixtures._start(points, 4, center, 1)
    order = [r["id"] for r in points.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(20).collect()]
    first = (x[order] - center).reshape(4, 5, 3)
    assert np.allclose(start.means, first.mean(axis=1))
    want, likelihood = em(x - center, first.mean(axis=1), [np.diag(f.var(axis=0) + mixtures.LEAST_VARIANCE) for f in first], np.full(4, 0.25), 6)
    mixtures._step(points, models := {0: start}, 90)
    for _ in range(5):
        mixtures._step(points, models, 90)
    assert np.allclose(start.means, want, atol=1e-8) and math.isclose(start.log_likelihood, likelihood, rel_tol=1e-9)


def test_mixtures_of_equal_points(spark):
    points = spark.range(300).select("id", F.array(F.lit(0.5), (F.col("id") % 2).cast("double")).alias("x"))
    labels, means = mixtures.fit(points, 6, 10, 2, 7)
    found = {(r["id"] % 2, r["cluster"]) for r in labels.collect()}
    assert labels.count() == 300 and np.isfinite(means).all() and {a for a, _ in found} == {0, 1} and len({c for _, c in found}) == len(found)


def test_layer_norm_keeps_digits_and_signs(spark):
    from quern.functions import vectors as v

    keys = [[1e8 + 1, 1e8 + 2, 1e8 + 4], [1.0, 0.0, -1e-7], [0.0, 0.0, 0.0]]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, key array<double>").select("id", F.transform(v.layer_norm(F.col("key")), lambda x: v.rounded(x, 5)).alias("key"))
    for r in rows.collect():
        x = np.array(keys[r.id]) - np.mean(keys[r.id])
        assert np.allclose(r.key, x / np.sqrt((x**2).mean() + 1e-5), atol=1e-5)
    got = spark.createDataFrame([(x,) for x in (-1e-7, 1e-7, -0.6e-5)], "x double").select(v.rounded(F.col("x"), 5).alias("x")).collect()
    assert [math.copysign(1, r.x) for r in got] == [-1, 1, -1] and [abs(r.x) for r in got] == [0, 0, 1e-5]


def _dot(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def test_blocks_equal_plain_loops(spark, monkeypatch):
    from quern.operators import blocks, retrieval

    monkeypatch.setattr(blocks, "QUERY_ROWS", 3)
    monkeypatch.setattr(blocks, "KEY_ROWS", 16)
    rng = random.Random(8)
    vector = lambda: [rng.choice((-1.0, -0.25, 0.1, 0.3, 2.0)) for _ in range(4)]
    common = vector()
    keys = [(i, common if i % 3 == 0 else vector(), i % 4, float(i % 7)) for i in range(200)] + [(200, None, 1, 1.0), (201, [1.0, None, 2.0, 3.0], 1, 1.0), (202, [1.0], 1, 1.0)]
    asked = [(i, vector()) for i in range(10)] + [(10, None)]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    table = spark.createDataFrame(keys, "id long, key array<double>, part long, value double").repartition(5)

    want = {(a, i): _dot(q, k) for a, q in asked for i, k, _, _ in keys}
    assert {(r.query_id, r.id): r.score for r in retrieval.scores(queries, table.select("id", "key")).collect()} == want
    for n in (1, 5, 150):
        got = {(r.query_id, r["rank"]): r.id for r in retrieval.flat_topk(queries, table.select("id", "key"), n).collect()}
        for a, _ in asked:
            order = sorted((i for i, *_ in keys), key=lambda i: (want[a, i] is None, -(want[a, i] or 0), i))[:n]
            assert [got[a, r + 1] for r in range(n)] == order
    for r in retrieval.merged_attention(queries, table).collect():
        told = [(want[r.query_id, i], value) for i, _, _, value in keys if want[r.query_id, i] is not None]
        assert r.value is None if not told else math.isclose(r.value, sum(math.exp(s) * x for s, x in told) / sum(math.exp(s) for s, _ in told))
    heads = {}
    for a, q in asked:
        for h in (0, 1):
            part = {i: _dot(q[2 * h : 2 * h + 2], k[2 * h : 2 * h + 2]) / math.sqrt(2) for i, k, _, _ in keys if want[a, i] is not None}
            total = sum(map(math.exp, part.values()))
            for i, s in part.items():
                heads[a, i] = heads.get((a, i), 0) + math.exp(s) / total
    pooled = {(r.query_id, r.id): r.score for r in retrieval.pooled(queries, table.select("id", "key"), 2).collect()}
    assert pooled.keys() == want.keys() and all(s is None if k not in heads else math.isclose(s, heads[k]) for k, s in pooled.items())


def test_no_row_a_pair_is_shuffled(spark):
    """A block passes on its share: of 40 x 4,000 pairs, no more rows than its best of each query."""
    from quern.operators import retrieval

    keys = spark.range(4000).select("id", F.array(F.sin(F.col("id").cast("double")), F.cos(F.col("id").cast("double"))).alias("key"))
    queries = keys.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("key").alias("query"))
    found = retrieval.flat_topk(queries, keys, 5)
    assert found.count() == 200
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan


def test_listing_deals_its_rows_out_once(spark):
    from quern.plans import registry

    found = registry.queries()["compact_listing"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1


def test_listing_values_equal_literals(spark):
    import ast

    from quern.operators import screens

    values = ["'a'", '"it\'s"', r"'it\'s'", r"'a\\b\n'", "'tab\there'", "''", "None", "'null'", "'a, b(c)'"]
    lines = spark.createDataFrame([(i, f"UI element {i}: UIElement(text={v}, class_name='View', box=Box(x=1), is_clickable, disabled)") for i, v in enumerate(values)] + [(99, "UI element: no")], "i int, line string")
    got = {r.i: r.element for r in screens.parse_listing(lines).collect()}
    assert got.pop(99) is None
    assert [(got[i].idx, got[i].text, got[i].class_name, got[i].is_clickable, got[i].is_enabled, got[i].is_selected) for i in range(len(values))] == [(i, ast.literal_eval(v), "View", True, False, None) for i, v in enumerate(values)]


def test_own_words_of_a_resource(spark):
    from quern.functions import text as t

    def own(name):
        words = [w for w in __import__("re").split("[^a-z0-9]+", name.split("/")[-1].strip(" ").lower()) if w]
        return any(w not in t.GENERIC_TOKENS and not w.isdigit() for w in words)

    rng = random.Random(2)
    parts = ["btn", "btn2", "mybtn", "view", "views", "viewsx", "12", "12a", "send", "É", "é", "layout"]
    names = sorted({"a/" + "".join(rng.choice(parts) + rng.choice(("_", "-", "", ".")) for _ in range(rng.randint(1, 4))) for _ in range(300)})
    rows = spark.createDataFrame([(x,) for x in names], "s string").select("s", t.is_semantic_resource(F.col("s")).alias("own")).collect()
    assert {r.s: r.own for r in rows} == {x: own(x) and bool(__import__("re").search("[a-z]", x.split("/")[-1].lower())) for x in names}


def test_subsequences_of_long_texts(spark, monkeypatch):
    from quern.operators import evaluation

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(6)
    for bits in (1, 3, 64, 8192):
        monkeypatch.setattr(evaluation, "LCS_BITS", bits)
        for words in ("ab", "abcdefgh"):
            for _ in range(20):
                a, b = (rng.choices(words, k=rng.randint(0, 30)) for _ in "ab")
                assert evaluation.lcs_length(a, b) == table(a, b)
    a, b = (" ".join(rng.choices(["one", "Two", "three", "x4", "five"], k=9000)) for _ in "ab")  # too long for a table of cells in the JVM
    rows = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, a), (4, "", "!")], "id long, predicted string, truth string")
    got = {r.id: (r.lcs, r.f1) for r in evaluation.rouge_l(rows).collect()}
    monkeypatch.undo()
    assert got[1][0] == evaluation.lcs_length(a.lower().split(), b.lower().split()) and got[2] == (9000, 1.0) and got[3] == (0, 0.0) and got[4] == (0, 0.0)


def _plan(found):
    return found._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_episode_rows_make_no_texts(spark):
    """Rows are told apart by a mark, so what a count drops is never put together; before, all of it was."""
    from quern.plans import registry

    plan = _plan(registry.queries()["qkv_counts"](spark, "/root/testdata/sf0.001"))
    assert "current screen shows" not in plan and "Earlier steps" not in plan
    assert "Earlier steps" not in _plan(registry.queries()["qkv_summary"](spark, "/root/testdata/sf0.001"))


def test_episodes_are_read_once(spark):
    from quern.plans import registry

    for name, shuffles in (("qkv_counts", None), ("episode_qkv", 1), ("qkv_summary", None)):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1, name
        assert shuffles is None or plan.count("Exchange ") == shuffles, name


def test_names_of_original_steps_are_made_once(spark):
    from quern.operators import summary

    rows = spark.createDataFrame([("aw_e 1_4_click",), ("aw_e 1_4_keyboard",), ("none",)], "name string").selectExpr("name || '' name", "'x' description", "'y' A")
    found = summary.original_steps(summary.with_action(rows))
    assert [tuple(r) for r in found.collect()] == [("e 1", 4)] and "Filter" not in _plan(found)


def test_cleaned_texts(spark):
    import re
    import time

    from quern.functions import text as t

    rng = random.Random(3)
    texts = ["".join(rng.choice(" .aB_9é  \n\x1f\U0001f600-") for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "To be.", "to  "]
    c = F.col("s")
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", t.collapse(c).alias("c"), t.safe_name(c).alias("n"), t.token_count(c).alias("k"), t.sentence(c).alias("e"), t.truncate(c, 5).alias("u")).collect()
    for r in rows:
        s = texts[r.i] or ""
        clean = " ".join(s.split())
        bare = clean.strip(" .")
        assert (r.c, r.k, r.e) == (clean, len(s.split()), bare and bare + ".")
        assert r.n == (re.sub("[^0-9A-Za-z_]+", "_", clean or "row").strip("_") or "row")
        assert r.u == (bare if len(bare) <= 5 else bare[:4].rstrip(" .,;") + "...")
    long = spark.range(8).select(F.repeat(F.lit("some wörds, and more. "), 100_000).alias("s"))
    began = time.time()
    assert long.select(F.length(t.safe_name(F.col("s"))).alias("n")).distinct().count() == 1
    assert time.time() - began < 15  # 17.6 MB
