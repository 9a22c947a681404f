"""Jaccard self-join of documents' word-shingle sets, to connected components.

1. A document's set is its distinct n-word shingles as 64-bit hashes; equal sets are one node.
2. Blocks. Sets with similarity t or more differ in at most d shingles, and d follows from their
   sizes. Shingles are dealt by hash into more than d groups, so two such sets agree wholly in at
   least one group, and in one that isn't empty unless both fill d groups or fewer; nodes that share
   a group's whole content are a block.
3. Count-vector R-tree. The shingles of a set are hashed into groups (128, for large sets more), and
   their counts are a point. The overlap of two sets is at most the sum of the coordinates' minima,
   of a set and a node of the tree at most the sum of the minima with its upper corner. Each block's points are indexed, and only pairs that
   the bound lets through are linked, by as few links as connect them (a block of over 1,024
   sets is linked to its least node instead, without the bound). Components of these links hold
   every pair of the join.
4. Inside a component a tree over its points finds the pairs again, and they are verified on the
   shingles; pairs already connected are passed over. A component over the size of a tile is dealt
   into tiles, so a task's memory is bounded. Each tile is joined first; then one set of each cluster
   found so far is compared with those of the other tiles; then, only where several clusters of a
   component are left, the sets outside its largest cluster are compared with all the others. So a
   group of copies of any size costs each of its sets a few comparisons, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Hashes, arrow_schema, bucket_of, buckets_for, chained, chunks_of, id_text, mixed, planes, shuffle_partitions, sorted_planes, staged, trim_memory, unplanes, unsorted_planes
from quern.llm.components import connected_components, join_to_one

CHUNK_CHARS = 4 << 20
COORDINATES = 128
LEAF = 16
ASKED = 64


@dataclass(frozen=True)
class Join:
    """n: words of a shingle; links at 100 * overlap >= percent * union (percent from 1 to 100); tile and
    tile_shingles: sets, and shingles of them, in half a task's tree; block: largest block that is
    tested by the bound."""

    n: int = 5
    percent: int = 80
    tile: int = 512
    tile_shingles: int = 1 << 21
    block: int = 1024

    def __post_init__(self) -> None:
        if not 1 <= self.percent <= 100 or self.n < 1:
            raise ValueError("n is 1 or more, percent from 1 to 100")


_HASHES = Hashes(250_000)


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the whole sequence."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _HASHES.of(words)
    if len(h) < n:
        return chained(*h[:, None], np.array([len(h)], np.uint64))
    return np.unique(chained(*(h[k : len(h) - n + 1 + k] for k in range(n))))


def set_hash(s: np.ndarray) -> int:
    """Of a whole set, as a signed 64-bit number."""
    return int(mixed(mixed(s + np.uint64(1)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0].view(np.int64)) if len(s) else 0


def size_class(n: int, percent: int) -> int:
    """Sets that link are of the same or of neighbouring classes; at 100 per cent, each size is a class."""
    if percent == 100:
        return n
    k = max(0, int(math.log(n) / math.log(100 / percent)) - 1)
    while class_end(k, percent) < n:
        k += 1
    return k


def class_end(k: int, percent: int) -> int:
    """Largest size in class k: (100 / percent) ** (k + 1), rounded down, by exact arithmetic."""
    if percent == 100:
        return k
    return 100 ** (k + 1) // percent ** (k + 1)


def differences(k: int, percent: int) -> int:
    """Most shingles in which a set of class k and a linked one, as large or larger, differ."""
    small = class_end(k, percent)
    large = small * 100 // percent
    return (100 - percent) * (small + large) // (100 + percent)


def block_keys(s: np.ndarray, join: Join) -> np.ndarray:
    """A key of each group's content, for the set's own class and the class below.

    Of g groups two linked sets agree in g - d at least. A set that fills more than d groups has
    fewer empty ones, so one that agrees is full; then empty groups need no key. There are a sixth
    more groups than d, so nearly all sets do.
    """
    k, out = size_class(len(s), join.percent), []
    for c in (k, k - 1) if k else (k,):
        d = differences(c, join.percent)
        g = d + 1 + d // 6
        group = (mixed(s ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(g)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=g)
        run = np.append(np.uint64(0), np.cumsum(mixed(s[order]), dtype=np.uint64))
        ends = np.cumsum(sizes)
        content = run[ends] - run[ends - sizes]
        keys = chained(content, np.arange(g, dtype=np.uint64), np.full(g, c + 1, np.uint64))
        full = sizes > 0
        out.append(keys[full] if full.sum() > d else keys)
    return np.concatenate(out)


def linked(overlap: int, a: int, b: int, percent: int) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def dimensions(n: int) -> int:
    """Coordinates of a set of n: COORDINATES up to 512 hashes, twice as many for twice as many hashes, so
    counts stay small and the bound stays sharp."""
    return COORDINATES << min(10, max(0, (max(int(n), 1) - 1).bit_length() - 9))


def point(s: np.ndarray, d: int) -> np.ndarray:
    """Counts of the hashes by their highest bits, in d (a power of two) coordinates."""
    return np.bincount((s >> np.uint64(65 - d.bit_length())).astype(np.int64), minlength=d).astype(np.int32)


def packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))).newbyteorder("<")).tobytes()


def unpacked(data: bytes, n: int, d: int) -> np.ndarray:
    """The packed point of a set of n, folded to d coordinates: neighbours share all but their lowest bits."""
    own = dimensions(n)
    counts = np.frombuffer(data, f"<u{len(data) // own}").astype(np.int32)
    return counts if d == own else counts.reshape(d, -1).sum(axis=1, dtype=np.int32)


class RTree:
    """Points in leaves sorted by size and counts, with bounding corners."""

    def __init__(self, points: np.ndarray, percent: int):
        self.percent, self.points = percent, points
        self.sizes = points.sum(axis=1).astype(np.int64)
        self.order = np.lexsort((*points.T[:8][::-1], self.sizes))
        self.levels = []
        starts = np.arange(0, len(self.order), LEAF)
        if len(self.order):
            upper = np.maximum.reduceat(points[self.order], starts)
            least, most = np.minimum.reduceat(self.sizes[self.order], starts), np.maximum.reduceat(self.sizes[self.order], starts)
            while True:
                self.levels.append((upper, least, most))
                if len(upper) <= LEAF:
                    break
                at = np.arange(0, len(upper), LEAF)
                upper, least, most = np.maximum.reduceat(upper, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)

    def near(self, i: int) -> np.ndarray:
        """Points whose bound lets them link with point i."""
        q, n, p = self.points[i], int(self.sizes[i]), self.percent
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least, most = (x[nodes] for x in self.levels[depth])
            bound = np.minimum(upper, q).sum(axis=1, dtype=np.int64)
            # A linked set has at least p / 100 of n, at most 100 / p of it.
            ok = (100 * most >= p * n) & (p * least <= 100 * n) & ((100 + p) * bound >= p * (n + np.maximum(least, -(-p * n // 100))))
            below = nodes[ok][:, None] * LEAF + np.arange(LEAF)
            nodes = below[below < (len(self.levels[depth - 1][0]) if depth else len(self.order))]
        found = self.order[nodes]
        found = found[(100 * self.sizes[found] >= p * n) & (p * self.sizes[found] <= 100 * n)]
        bound = np.minimum(self.points[found], q).sum(axis=1, dtype=np.int64)
        return found[(100 + p) * bound >= p * (n + self.sizes[found])]


def roots(points: np.ndarray, percent: int, verified=None, known: np.ndarray | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """Least member reached from each point (indices), by pairs that pass the bound and are verified.

    verified: of a point and an array of others, which are linked; each pair is asked for once at
    most, a few at a time, and not once its ends are connected. known: the least member that each
    point is already connected with; asked: marks the points whose pairs are wanted, else all. Few
    points are compared with each other outright, the leaf of a tree without the tree.
    """
    root = np.arange(len(points)) if known is None else known.copy()
    asked = np.ones(len(points), bool) if asked is None else asked
    if len(points) <= LEAF:
        size = points.sum(axis=1).astype(np.int64)
        bound = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=np.int64)
        ok = (100 + percent) * bound >= percent * (size[:, None] + size[None])
        near = [np.flatnonzero(x) for x in ok].__getitem__
    else:
        near = RTree(points, percent).near
    for i in np.flatnonzero(asked):
        left = near(i)
        left = left[(left > i) | ~asked[left]]
        while len(left := left[root[left] != root[i]]):
            some, left = left[:ASKED], left[ASKED:]
            for j in some if verified is None else some[verified(i, some)]:
                if root[j] != root[i]:
                    a, b = sorted((root[i], root[j]))
                    root[root == b] = a
    return root


def local_roots(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """Least member reached from each set by links (indices); known and asked as in roots."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(sizes)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), bool)
    own = [flat[e - n : e] for e, n in zip(ends, sizes)]

    def verified(i: int, some: np.ndarray) -> np.ndarray:
        mark[own[i]] = True
        starts = np.cumsum(sizes[some]) - sizes[some]
        both = np.add.reduceat(mark[np.concatenate([own[j] for j in some])].astype(np.int64), starts)
        mark[own[i]] = False
        return 100 * both >= percent * (sizes[i] + sizes[some] - both)

    d = dimensions(int(sizes.mean()))
    return roots(np.array([point(s, d) for s in sets]).reshape(-1, d), percent, verified, known, asked)


def document_sets(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, n_shingles, node, counts): node is the set's hash, 0 for no words; counts its packed point."""
    schema = "doc_id bigint, n_shingles bigint, node bigint, counts binary"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in chunks_of(batches, CHUNK_CHARS):
            rows = [(len(s), set_hash(s), packed(point(s, dimensions(len(s)))) if len(s) else None) for s in (shingles(t, join.n) for t in texts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, *zip(*rows)), arrow)], schema=arrow)
        trim_memory()

    return id_text(docs).mapInArrow(run, schema)


def blocks(docs: DataFrame, join: Join) -> DataFrame:
    """(block, node): nodes of each block of two or more; blocks of equal nodes are one. Keys travel packed, by bucket."""
    spark = docs.sparkSession
    buckets, schema = buckets_for(docs), "bucket int, keys binary, at binary, nodes binary"
    arrow = arrow_schema(spark, schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks_of(batches, CHUNK_CHARS):
            seen: dict[int, np.ndarray] = {}
            for t in texts:
                s = shingles(t, join.n)
                if len(s) and (h := set_hash(s)) not in seen:
                    seen[h] = block_keys(s, join)
            if not seen:
                continue
            nodes = np.array(list(seen), np.int64)
            keys = np.concatenate(list(seen.values()))
            at = np.repeat(np.arange(len(nodes)), [len(x) for x in seen.values()])
            order = np.argsort(keys)
            keys, at = keys[order], at[order]
            edges = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                if edges[b] < edges[b + 1]:
                    part = slice(edges[b], edges[b + 1])
                    own, where = np.unique(at[part], return_inverse=True)
                    rows.append((b, sorted_planes(keys[part]), planes(where.astype(np.uint64)), nodes[own].tobytes()))
            del seen, keys, at, order
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
            del rows
        trim_memory()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        keys, nodes = [], []
        for k, at, own in zip(rows["keys"], rows["at"], rows["nodes"]):
            keys.append(unsorted_planes(k))
            where = unplanes(at).astype(np.int64)
            nodes.append(np.frombuffer(own, np.int64)[where if len(where) else np.zeros(len(keys[-1]), np.int64)])
        keys, nodes = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
        keys, nodes = keys[new], nodes[new]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        # A block is named by its nodes, so copies of a block within and between buckets are one.
        names = np.repeat(np.add.reduceat(mixed(nodes.view(np.uint64)), starts), sizes).view(np.int64)
        many = np.repeat(sizes > 1, sizes)
        rows = np.unique(np.stack([names[many], nodes[many]], 1), axis=0).reshape(-1, 2)
        return pd.DataFrame({"block": rows[:, 0], "node": rows[:, 1]})

    return id_text(docs).mapInArrow(emit, schema).groupBy("bucket").applyInPandas(meet, "block bigint, node bigint")


def block_links(found: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """(a, b): links that connect the nodes of each block which pass the bound; nodes: (node, shingles, counts)."""
    spark = found.sparkSession
    found = staged(found.distinct(), "blocks")
    sizes = found.groupBy("block").agg(F.count("*").alias("size"), F.min("node").alias("a"))
    sized = join_to_one(found, sizes, "block", "size", found.count(), F.col("node"))
    large = sized.filter((F.col("size") > join.block) & (F.col("node") != F.col("a"))).select("a", F.col("node").alias("b"))
    small = sized.filter(F.col("size") <= join.block).select("block", "node").join(nodes.select("node", "counts", "shingles"), "node")
    schema = "a bigint, b bigint"
    arrow = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # rows of the last block so far, which may go on
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if left is None else pa.concat_tables([left, now])
            block = now.column(0).to_numpy()
            cut = int(np.searchsorted(block == block[-1], True)) if len(block) else 0
            yield linked_blocks(now.slice(0, cut))
            left = now.slice(cut)
        if left is not None and left.num_rows:
            yield linked_blocks(left)

    def linked_blocks(rows: pa.Table) -> pa.RecordBatch:
        block, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        data, n = rows.column(2).to_pylist(), rows.column(3).to_numpy()
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(block)))
        least = np.minimum.reduceat(n, starts) if len(block) else n
        a, b = [], []
        points = lambda at, d: np.array([unpacked(data[k], n[k], d) for k in at]).reshape(-1, d)
        pairs = starts[sizes == 2]  # most blocks; all of some size at once
        folded = np.array([dimensions(int(x)) for x in least[sizes == 2]], np.int64)
        for d in np.unique(folded).tolist():
            for pair in np.array_split(pairs[folded == d], 1 + (folded == d).sum() * d // (1 << 22)):
                bound = np.minimum(points(pair, d), points(pair + 1, d)).sum(axis=1, dtype=np.int64)
                pair = pair[(100 + join.percent) * bound >= join.percent * (n[pair] + n[pair + 1])]
                a.append(node[pair])
                b.append(node[pair + 1])
        for start, size, d in zip(starts[sizes > 2], sizes[sizes > 2], least[sizes > 2]):
            root = roots(points(range(start, start + size), dimensions(int(d))), join.percent)
            own = np.flatnonzero(root != np.arange(size))
            a.append(node[start + root[own]])
            b.append(node[start + own])
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], schema=arrow)

    placed = small.select("block", "node", "counts", "shingles").repartition("block").sortWithinPartitions("block")
    return placed.mapInArrow(run, schema).unionByName(large)


def jaccard_components(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id): one row a document.

    class_id: least doc_id with the same set; component_id: least doc_id reachable by links.
    Null or empty text: no shingles, linked with nothing, both ids its own. Rows with a null
    doc_id belong to no one's minimum; they have the ids of rows with the very same set, else null
    ids, and a set that only such rows have links nothing. Repeated rows are answered each. No
    rows, no rows.
    """
    sets = staged(document_sets(docs, join), "sets")
    nodes = staged(sets.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.min("n_shingles").alias("shingles"), F.min("counts").alias("counts")), "nodes")
    candidates = connected_components(block_links(blocks(docs, join), nodes, join))
    within = _clusters(docs, nodes, candidates, join)
    rooted = nodes.select("node", "class_id").join(within, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = staged(rooted.groupBy("root").agg(F.min("class_id").alias("component_id"), F.count("*").alias("n")), "component-ids")
    labels = join_to_one(rooted, least, "root", "n", nodes.count(), F.col("node")).select("node", "class_id", "component_id")
    full = sets.filter("n_shingles > 0").join(labels, "node").select("doc_id", "n_shingles", "component_id", "class_id")
    return full.unionByName(sets.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id")))


GROUP = "root bigint, i int, j int, node bigint, cluster bigint, asked boolean, shingles binary"


def _joined(groups: DataFrame, join: Join) -> DataFrame:
    """(root, a, b): of each group (root, i, j), every set's cluster b and the least cluster a it is connected with."""
    spark = groups.sparkSession
    schema = "root bigint, a bigint, b bigint"
    arrow = arrow_schema(spark, schema)

    def answer(key: tuple, rows: dict[int, tuple]) -> pa.RecordBatch:
        names = np.array(list(rows), np.int64)
        clusters, asked = (np.array(c) for c in zip(*((r[0], r[1]) for r in rows.values())))
        _, first, known = np.unique(clusters, return_index=True, return_inverse=True)
        root = local_roots([unsorted_planes(r[2]) for r in rows.values()], join.percent, first[known], asked)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, root, clusters)
        found = np.unique(np.stack([least[root], clusters]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * found.shape[1], pa.int64()), *(pa.array(c, pa.int64()) for c in found)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            for root, i, j, node, cluster, asked, s in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, i, j) != key:
                    if held:
                        yield answer(key, held)
                    key, held = (root, i, j), {}
                held[node] = (cluster, asked or held.get(node, (0, False))[1], s)
        if held:
            yield answer(key, held)
        trim_memory()

    names = [x.split()[0] for x in GROUP.split(", ")]
    # Few rows, but much work: the number of partitions is given, so they aren't coalesced.
    placed = groups.select(names).repartition(shuffle_partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return placed.mapInArrow(run, schema)


def _tiles(members: Column, volume: Column, join: Join) -> Column:
    """Tiles of a group of so many sets with so many shingles."""
    return F.greatest(F.lit(1), F.ceil(members / F.lit(join.tile)), F.ceil(volume / F.lit(join.tile_shingles))).cast("int")


def _dealt(rows: DataFrame, join: Join) -> DataFrame:
    """rows (root, node, size, ...) with tiles, the number of tiles of their root, and their own tile."""
    sizes = staged(rows.groupBy("root").agg(F.count("*").alias("members"), F.sum("size").alias("volume")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    return join_to_one(rows, sizes, "root", "members", total, F.col("node")).withColumn("tiles", _tiles(F.col("members"), F.col("volume"), join)).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).drop("members", "volume")


def _merged(links: DataFrame) -> DataFrame:
    """(b, top): the least cluster that each cluster of links (a, b) reaches."""
    return connected_components(links.select("a", "b")).select(F.col("node").alias("b"), F.col("root").alias("top"))


def _clusters(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, join: Join) -> DataFrame:
    """(node, root): a node of a candidate component and the least node it reaches by verified links."""
    spark = docs.sparkSession
    wanted = _dealt(candidates.join(nodes.select("node", "class_id", F.col("shingles").alias("size")), "node").filter("class_id is not null"), join)
    texts = id_text(docs).join(wanted, F.col("doc_id") == F.col("class_id")).select("root", "tiles", "tile", "node", "size", "text")
    schema = "root bigint, tiles int, tile int, node bigint, size bigint, shingles binary"
    arrow = arrow_schema(spark, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for *own, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text or "", join.n)
                # Else not this set's own document, but an id that repeats with another text.
                if set_hash(s) == own[3]:
                    rows.append((*own, sorted_planes(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        trim_memory()

    held = staged(texts.mapInArrow(cut, schema), "candidate-sets")
    alone = held.select("root", F.col("tile").alias("i"), F.col("tile").alias("j"), "node", F.col("node").alias("cluster"), F.lit(True).alias("asked"), "shingles")
    found = staged(_joined(alone, join).select("root", F.col("b").alias("node"), F.col("a").alias("cluster")), "clusters")
    many = held.filter("tiles > 1")
    if many.isEmpty():
        return found.select("node", F.col("cluster").alias("root"))

    # One set of each cluster: tiles of these, each with each other.
    own = many.join(found.select("node", "cluster"), "node").drop("tiles", "tile")
    heads = staged(_dealt(own.filter("node = cluster"), join), "heads")
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != F.col("tile")))
    pairs = heads.withColumn("other", F.explode(others)).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other"), "asked": F.lit(True)})
    tops = staged(_merged(staged(_joined(pairs, join), "head-links")), "tops")

    # Where clusters of a component are left, the sets outside the largest meet all others.
    topped = own.join(tops, F.col("cluster") == F.col("b"), "left").withColumn("cluster", F.coalesce("top", "cluster")).drop("b", "top")
    counts = topped.groupBy("root", "cluster").agg(F.count("*").alias("n"), F.sum("size").alias("volume"))
    last = F.struct("n", "cluster")
    left = counts.groupBy("root").agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.sum("volume").alias("volume"), F.max_by(F.struct("cluster", "n", "volume"), last).alias("largest"))
    left = left.filter("clusters > 1 and clusters < members").withColumns(
        {"tiles": _tiles(F.col("members"), F.col("volume"), join), "small_tiles": _tiles(F.col("members") - F.col("largest.n"), F.col("volume") - F.col("largest.volume"), join), "largest": F.col("largest.cluster")}
    )
    left = staged(left.drop("volume", "clusters"), "open-components")
    if not left.isEmpty():
        open_ = join_to_one(topped, left, "root", "members", left.agg(F.sum("members")).first()[0], F.col("node"))
        tile = lambda tiles: F.pmod(F.xxhash64("node"), F.col(tiles)).cast("int")
        each = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
        columns = ["root", "i", "j", "node", "cluster", "asked", "shingles"]
        questions = open_.filter(F.col("cluster") != F.col("largest")).withColumns({"i": tile("small_tiles"), "asked": F.lit(True)}).withColumn("j", each("tiles"))
        answers = open_.withColumns({"j": tile("tiles"), "asked": F.lit(False)}).withColumn("i", each("small_tiles"))
        more = _joined(questions.select(columns).unionByName(answers.select(columns)), join).select("a", "b")
        tops = staged(_merged(staged(more.unionByName(tops.select(F.col("top").alias("a"), "b")), "last-links")), "tops")
    return found.join(tops, F.col("cluster") == F.col("b"), "left").select("node", F.coalesce("top", "cluster").alias("root"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """docs without the rows whose component has a document of lower doc_id; all columns stay.

    Rows with an equal id stay or go together, so exact repeats of the row that stays all stay; a row
    with a null doc_id stays. Empty texts link with nothing and stay.
    """
    found = jaccard_components(docs, join)
    lost = found.filter("doc_id is not null and component_id is not null and doc_id > component_id").select(F.col("doc_id").alias("lost_id")).distinct()
    left = docs.join(lost, docs["doc_id"].cast("bigint") == lost["lost_id"], "left_anti")
    return left


__all__ = ["Join", "jaccard_components", "one_of_each", "RTree", "local_roots", "shingles"]


#: jaccard_components with three words and 90 per cent over the documents table, by DuckDB: all pairs
#: that share a shingle, then reachability.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM words
), shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS MATERIALIZED (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS o FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2)
  WHERE 100 * o >= 90 * (nx + ny - o)
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE reach.x = sets.doc_id) AS component_id FROM sets
"""
