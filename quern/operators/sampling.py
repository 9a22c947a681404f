"""Proportional quotas, stratified round-robin sampling, hash-ordered draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.compat import hash_order


def largest_remainder(capacities: DataFrame, target: Column | int) -> DataFrame:
    """Adds quota to (bucket, capacity): shares of target by largest remainder, in exact integers.

    Ties of the remainder go to the greater bucket. A target at or over all capacity takes all.
    The window is over one row a bucket.
    """
    whole = Window.partitionBy()
    total, t = F.sum("capacity").over(whole), F.lit(target) if isinstance(target, int) else target
    rows = capacities.withColumn("_t", t.cast("bigint")).withColumn("_total", total)
    rows = rows.withColumn("_floor", F.expr("_t * capacity div greatest(_total, 1)")).withColumn("_rest", F.expr("(_t * capacity) % greatest(_total, 1)"))
    extra = F.row_number().over(whole.orderBy(F.desc("_rest"), F.desc("bucket"))) <= F.col("_t") - F.sum("_floor").over(whole)
    quota = F.when(F.col("_t") <= 0, F.lit(0)).when(F.col("_t") >= F.col("_total"), F.col("capacity")).otherwise(F.col("_floor") + extra.cast("bigint"))
    return rows.withColumn("quota", quota.cast("bigint")).drop("_t", "_total", "_floor", "_rest")


def quotas(capacities: DataFrame, size: int, rare: int = 200) -> DataFrame:
    """Adds quota: buckets of at most rare rows whole, the rest of size by largest remainder.

    If the rare buckets alone are over size, all buckets share it.
    """
    kept = capacities.agg(F.sum(F.when(F.col("capacity") <= rare, F.col("capacity")).otherwise(0)).alias("_kept"))
    rows = capacities.join(F.broadcast(kept))
    rows = rows.withColumn("_whole", (F.col("capacity") <= rare) & (F.col("_kept") <= size))
    large = largest_remainder(rows.filter("not _whole"), F.when(F.col("_kept") > size, F.lit(size)).otherwise(F.lit(size) - F.col("_kept")))
    return rows.filter("_whole").withColumn("quota", F.col("capacity")).unionByName(large).select("bucket", "capacity", "quota")


def round_robin(rows: DataFrame, quota: DataFrame, seed: int = 1607) -> DataFrame:
    """rows (bucket, episode, id, ...) cut to each bucket's quota, one row of every episode a pass.

    The order inside an episode and of the episodes is a seeded hash. A pass takes one row of every
    episode, so the rows of each pass are counted first: passes that fit into the quota are taken
    whole, and only the one that it cuts is ranked, within which Spark cuts each task's rows first.
    So a bucket of any size is never ranked in one task.
    """
    inside = Window.partitionBy("bucket", "episode").orderBy(hash_order("id", seed=seed), "id")
    turns = rows.withColumn("_pass", F.row_number().over(inside))
    passes = turns.groupBy("bucket", "_pass").agg(F.count("*").alias("_n")).join(quota.select("bucket", "quota"), "bucket")
    since = F.coalesce(F.sum("_n").over(Window.partitionBy("bucket").orderBy("_pass").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = passes.withColumn("_room", F.col("quota") - since).filter("_room > 0").select("bucket", "_pass", "_n", "_room")
    chosen = turns.join(room, ["bucket", "_pass"])
    most = room.filter("_n > _room").agg(F.coalesce(F.max("_room"), F.lit(0))).first()[0]
    cut = Window.partitionBy("bucket", "_pass").orderBy(hash_order("episode", seed=seed), "episode")
    # A literal bound is what lets Spark cut each task's rows; the bucket's own room is never over it.
    last = chosen.filter("_n > _room").withColumn("_rank", F.row_number().over(cut)).filter(F.col("_rank") <= most).filter("_rank <= _room").drop("_rank")
    return chosen.filter("_n <= _room").unionByName(last).drop("_pass", "_n", "_room")


def stratified(rows: DataFrame, size: int, rare: int = 200, seed: int = 1607) -> DataFrame:
    return round_robin(rows, quotas(rows.groupBy("bucket").agg(F.count("*").alias("capacity")), size, rare), seed)


def sampled_counts(rows: DataFrame, sample: DataFrame) -> DataFrame:
    """(bucket, before, after): rows of each bucket before and after sampling, buckets that lost all with 0."""
    n = lambda df, name: df.groupBy("bucket").agg(F.count("*").alias(name))
    return n(rows, "before").join(n(sample, "after"), "bucket", "left").na.fill(0, ["after"])


def shuffled(rows: DataFrame, *key: str, seed: int = 0) -> DataFrame:
    """rows in a seeded hash order over all partitions; rows of equal keys follow each other."""
    return rows.orderBy(hash_order(*key, seed=seed), *key)


def without_replacement(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows by seeded hash order; a top-k, so no full sort."""
    return rows.orderBy(hash_order(id_col, seed=seed), id_col).limit(n)


def with_replacement(rows: DataFrame, position: str, n: int, draws: int, seed: int) -> DataFrame:
    """draws rows, (draw, ...): a hash of each draw's number picks a position below n."""
    picked = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("bigint") % n
    return rows.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("_at", picked).join(rows, F.col("_at") == F.col(position)).drop("_at")
