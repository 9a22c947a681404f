"""Triples to question/key/value rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.compat import written
from quern.functions.text import char_count, token_count


@dataclass(frozen=True)
class Bounds:
    """Lengths of names and descriptions; all exclusive. key_tokens is inclusive, with 2 to spare.

    min_description_tokens None: no least length; check False: no length test at all.
    """

    name_tokens: int = 10
    name_chars: int = 200
    description_tokens: int = 100
    description_chars: int = 2000
    min_description_tokens: int | None = None
    key_tokens: int | None = 25
    check: bool = True


#: The two kinds of build: short training rows, and everything of moderate length.
TRAINING = Bounds(4, 80, 20, 400, 10, 25)
FULL = Bounds(key_tokens=None)


def with_missing_side(triples: DataFrame, key: str = "rid") -> DataFrame:
    """Adds missing, "head" or "tail", by a fair hash of the row's key."""
    return triples.withColumn("missing", F.when(F.ascii(F.md5(F.col(key).cast("string"))) % 2 == 0, "head").otherwise("tail"))


def skip_participation(triples: DataFrame) -> DataFrame:
    return triples.filter(~F.col("relation").contains("participate"))


def named(triples: DataFrame) -> DataFrame:
    """Adds name (the known end) and description (the end asked for)."""
    known = F.col("missing") == "head"
    return triples.withColumn("name", F.when(known, F.col("tail")).otherwise(F.col("head"))).withColumn("description", F.when(known, F.col("head")).otherwise(F.col("tail")))


def within_bounds(rows: DataFrame, bounds: Bounds) -> DataFrame:
    if not bounds.check:
        return rows
    tokens = token_count(F.col("description"))
    keep = (token_count(F.col("name")) < bounds.name_tokens) & (char_count(F.col("name")) < bounds.name_chars) & (tokens < bounds.description_tokens) & (char_count(F.col("description")) < bounds.description_chars)
    if bounds.min_description_tokens is not None:
        keep &= tokens > bounds.min_description_tokens
    return rows.filter(keep)


def relation_nouns(rows: DataFrame, noun=lambda relation, missing: relation) -> DataFrame:
    """Adds noun: the hook runs once for each distinct (relation, missing), joined back.

    noun maps two columns to one; the naive default passes the relation through, and then Spark
    needs no join at all.
    """
    probe = noun(F.col("relation"), F.col("missing"))
    if str(probe) == str(F.col("relation")):
        return rows.withColumn("noun", F.col("relation"))
    pairs = rows.select("relation", "missing").distinct().withColumn("noun", probe)
    return rows.join(pairs, ["relation", "missing"])


def qkv(rows: DataFrame, bounds: Bounds = TRAINING, strip_quotes: bool = False) -> DataFrame:
    """The question/key/value row of (name, description, noun); rows with a long key go."""
    noun = F.replace(F.col("noun"), F.lit('"'), F.lit("")) if strip_quotes else F.col("noun")
    key = F.concat(F.lit("the "), noun, F.lit(" of "), F.col("name"))
    out = rows.select(
        "rid",
        "name",
        noun.alias("description_type"),
        "description",
        F.concat(F.lit("What is "), key, F.lit("?")).alias("Q"),
        F.concat(key, F.lit(" is "), F.col("description")).alias("A"),
        key.alias("key_string"),
        F.lit("").alias("extended_Q"),
        F.lit("").alias("extended_A"),
    )
    return out if bounds.key_tokens is None else out.filter(token_count(F.col("key_string")) <= bounds.key_tokens + 2)


def build(triples: DataFrame, bounds: Bounds = TRAINING, noun=lambda relation, missing: relation, strip_quotes: bool = False) -> DataFrame:
    """Skip, choose a side, test lengths, name the relation, project."""
    rows = within_bounds(named(with_missing_side(skip_participation(triples))), bounds)
    return qkv(relation_nouns(rows, noun), bounds, strip_quotes)


#: Rows of a range whose ranks one task counts.
RANGE_ROWS = 1 << 20


def batch_ids(rows: DataFrame, order: str, size: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds batch_id, size rows a batch in the given order, the last one partial.

    Ranks are dealt out in two steps: ranges of the order are counted, and rows ranked inside their
    range, so no task sorts the whole table; there are as many ranges as the rows need. The rows are
    written first, since the bounds of the ranges are sampled and must be the same in both steps.
    """
    rows = written(rows, "unranked")
    buckets = max(1, -(-rows.count() // range_rows))
    if buckets == 1:
        return rows.withColumn("batch_id", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / F.lit(size)))
    ranged = written(rows.repartitionByRange(buckets, order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return ranged.join(F.broadcast(before), "_range").withColumn("batch_id", F.floor((F.col("_before") + rank - 1) / F.lit(size))).drop("_range", "_before")


def split_at(rows: DataFrame, position: str | Column, index: int) -> DataFrame:
    """Adds split: "train" before the index, "test" from it on."""
    position = F.col(position) if isinstance(position, str) else position
    return rows.withColumn("split", F.when(position < index, "train").otherwise("test"))


def unpivot_entities(entities: DataFrame, kinds: list[str]) -> DataFrame:
    """One row an entity and described property, with its question, answer and key."""
    long = entities.unpivot(["name"], kinds, "description_type", "description")
    of = F.concat(F.col("description_type"), F.lit(" of "), F.col("name"))
    return long.select("name", "description_type", "description", F.concat(F.lit("What is the "), of, F.lit("?")).alias("Q"), F.concat(F.lit("The "), of, F.lit(" is "), F.col("description"), F.lit(".")).alias("A"), F.concat(F.lit("the "), of).alias("key_string"))
