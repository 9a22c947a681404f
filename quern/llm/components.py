"""Connected components of an edge table, by rounds of joins with written tables between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged

#: A key with more than this share of all rows is split over several tasks; so at most its inverse are.
SPLIT_SHARE = 10_000
#: Rows of a key that one task takes in any case.
SPLIT_ROWS = 512


def join_to_one(rows: DataFrame, one: DataFrame, key: str, count: str, total: int, spread: Column) -> DataFrame:
    """rows joined with one, which has a row a key and in count the number of rows that have it.

    A hot key's rows are dealt over tasks by the hash of spread, and its row of one is repeated for
    each. The keys that are split are SPLIT_SHARE at most, whatever total (the number of rows), so
    their list is broadcast; everything else is an ordinary join.
    """
    limit = max(SPLIT_ROWS, total // SPLIT_SHARE)
    parts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = one.filter(F.col(count) > limit).select(key, parts.alias("__parts"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(spread), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    right = one.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return left.join(right, [key, "__part"]).drop("__part")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): of every node of edges (a bigint, b bigint), the least node it can reach.

    Alternates large-star and small-star steps; each keeps the components and shortens the paths,
    and rounds grow with the logarithm of the longest path. Minima are aggregated on the map side,
    and the edges of a star's centre are dealt over several tasks. Self-edges and repeated edges do
    no harm; no edges, no rows.
    """
    now = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a is not null and b is not null and a < b").distinct(), "edges")
    size = now.count()
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        # Large star: every larger neighbour of a node goes to the least of the node and its neighbours.
        large = join_to_one(both.filter("b > a"), least, "a", "n", 2 * size, F.col("b")).select(F.col("m").alias("a"), "b").distinct()
        large = staged(large, "edges")
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        small = join_to_one(large, low, "b", "n", size, F.col("a")).select(F.col("m").alias("m"), F.explode(F.array("a", "b")).alias("b")).filter("m < b").select(F.col("m").alias("a"), "b").distinct()
        new = staged(small, "edges")
        before, size = size, new.count()
        same = size == before and new.exceptAll(now).isEmpty()
        now = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
