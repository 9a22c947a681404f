import random
import re

import numpy as np
import pytest
from tests.llm.helpers import ODD, docs, odd_docs

from quern.llm import ngram_join as nj
from quern.llm.components import connected_components


def brute(texts, n, percent):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(rng, groups, size):
    vocabulary = [f"w{k}" for k in range(300)]
    out = []
    for _ in range(groups):
        words = rng.choices(vocabulary, k=rng.choice([2, 3, 5, 12, 40, 150]))
        for _ in range(rng.randint(1, size)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                k = rng.randrange(len(own))
                own[k : k + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
            out.append(" ".join(own))
        out.append(" ".join(words[::-1]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("n", "percent", "tile"), [(3, 90, 512), (5, 80, 512), (2, 60, 3)])
def test_components_equal_all_pairs(spark, n, percent, tile):
    texts = corpus(random.Random(n), 60, 8) + [t for t in ODD if t is None or len(t) < 3000]
    frame = docs(spark, texts).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(frame, nj.Join(n, percent, tile)).collect()}
    want = brute(texts, n, percent)
    assert got == dict(enumerate(want))
    assert len({c for _, c in want}) < len(want)


def chains(rng):
    """Long texts: groups of near copies, and rows of texts each near the next but far from the rest."""
    vocabulary = [f"v{k}" for k in range(4000)]
    out = []
    for n in (700, 1500, 2600):
        words = rng.choices(vocabulary, k=n)
        for step in range(14):
            out.append(" ".join(words))
            if step % 5 == 4:
                words = rng.choices(vocabulary, k=n)
            for _ in range(n // 60 if step % 2 else 1):
                words[rng.randrange(n)] = rng.choice(vocabulary)
    out += out[:3] + [" ".join(rng.choices(vocabulary, k=900)) + out[0][:200] for _ in range(5)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("join", [nj.Join(3, 90, tile_shingles=4000), nj.Join(3, 90, tile=2, block=2), nj.Join(5, 80, tile=3), nj.Join(2, 100, tile=2)])
def test_large_sets_in_many_tiles(spark, join):
    texts = chains(random.Random(11))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(docs(spark, texts).repartition(3), join).collect()}
    want = brute(texts, join.n, join.percent)
    assert got == dict(enumerate(want)) and len({c for _, c in want}) < len(want)


def test_points_fold():
    rng = np.random.default_rng(3)
    for n in (1, 512, 513, 5000, 70000):
        s = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        own = nj.dimensions(len(s))
        data = nj.packed(nj.point(s, own))
        for d in {128, own // 2, own} - {64}:
            assert nj.unpacked(data, len(s), d).tolist() == nj.point(s, d).tolist()


def test_repeated_table_and_long_text(spark):
    texts = ["a b c d e f g", "a b c d e f h", None, "", "word " * 400_000, " ".join(f"w{k}" for k in range(150_000))]
    frame = docs(spark, texts)
    rows = nj.jaccard_components(frame.union(frame), nj.Join(3, 90)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted([(0, 5, 0), (1, 5, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 149_998, 5)] * 2)
    with pytest.raises(ValueError):
        nj.Join(percent=0)


def test_rows_without_an_id(spark):
    """They have the ids of rows with the same set, else none; a set that only they have links nothing."""
    text = " ".join(f"w{k}" for k in range(60))
    frame = spark.createDataFrame([(1, text), (None, text), (None, text + " x"), (3, text + " x y")], "doc_id long, text string")
    rows = nj.jaccard_components(frame, nj.Join(3, 98)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == [(1, 1), (3, 3), (None, 1), (None, None)]


def test_odd_rows(spark):
    rows = nj.jaccard_components(odd_docs(spark)).collect()
    assert len(rows) == len(ODD) + 2
    assert nj.jaccard_components(docs(spark, [])).count() == 0 and nj.one_of_each(docs(spark, [])).count() == 0
    kept = nj.one_of_each(docs(spark, ["a b c d e f", "A b c d e F", None, "", "other words"])).collect()
    assert sorted(r.doc_id for r in kept) == [0, 2, 3, 4] and len(kept[0]) == 5


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        base = rng.integers(0, 2**63, 400).astype(np.uint64)
        sets = []
        for _ in range(120):
            keep = base[rng.random(400) < rng.choice([0.85, 0.95, 0.99])]
            sets.append(np.unique(np.append(keep, rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64))))
        tree = nj.RTree(np.array([nj.point(s, 128) for s in sets]), percent)
        for i in range(len(sets)):
            near = set(tree.near(i).tolist())
            for j in range(len(sets)):
                if nj.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), percent):
                    assert j in near
                    join = nj.Join(3, percent)
                    assert set(nj.block_keys(sets[i], join).tolist()) & set(nj.block_keys(sets[j], join).tolist())


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    got = {r.node: r.root for r in rows}
    assert len(rows) == len(got) and all(got.get(x, x) == r for x, r in want.items())
