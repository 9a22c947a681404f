"""Evaluation: transcripts, answers, n-gram overlap, judge scores."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(text: Column, n: int) -> Column:
    """Lower-case alphanumeric n-grams of a text, as an array; words are parted by a blank."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    last = F.size(words) - n
    return F.when(last < 0, F.filter(F.array(F.lit("")), lambda x: F.lit(False))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " ")))


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    """(id, overlap, precision, recall, f1) of predicted and true texts by multiset n-gram overlap.

    What the prediction lacks is counted in the row: of each distinct common n-gram the lesser number,
    told by removing it. So a pair stays in its row and nothing is shuffled.
    """
    rows = pairs.select("id", grams(F.col("predicted"), n).alias("_p"), grams(F.col("truth"), n).alias("_t"))
    common = F.array_intersect("_p", "_t")  # distinct
    times = lambda c, g: F.size(c) - F.size(F.array_remove(c, g))
    overlap = F.aggregate(common, F.lit(0), lambda sum_, g: sum_ + F.least(times(F.col("_p"), g), times(F.col("_t"), g)))
    rows = rows.select("id", F.size("_p").alias("_np"), F.size("_t").alias("_nt"), overlap.cast("bigint").alias("overlap"))
    part = lambda c: F.when(F.col(c) > 0, F.col("overlap") / F.col(c)).otherwise(0.0)
    rows = rows.withColumn("precision", part("_np")).withColumn("recall", part("_nt"))
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0)).drop("_np", "_nt")


#: Words of the truth that one number holds a bit each of.
LCS_BITS = 8192


def lcs_length(predicted: list[str], truth: list[str]) -> int:
    """Length of the longest common subsequence: a column of the usual table is a number's bits, a step is one addition.

    A zero bit is a rise of the column. Longer truths go block by block, with the carry of each step.
    """
    common = set(predicted).intersection(truth)
    steps, found = [w for w in predicted if w in common], 0
    carries = [0] * len(steps)
    for at in range(0, len(truth), LCS_BITS) if steps else ():
        block, masks = truth[at : at + LCS_BITS], {}
        for i, word in enumerate(block):
            if word in common:
                masks[word] = masks.get(word, 0) | 1 << i
        n = len(block)
        full = v = (1 << n) - 1
        for j, word in enumerate(steps):
            mask = masks.get(word, 0)
            s = v + (v & mask) + carries[j]
            carries[j] = s >> n
            v = (s | v & ~mask) & full
        found += n - v.bit_count()
    return found


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(id, lcs, f1): longest common subsequence of words, by additions of long numbers in Arrow batches."""

    @F.arrow_udf("lcs bigint, words bigint")
    def measured(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        words = re.compile("[a-z0-9]+").findall
        for predicted, truth in batches:
            both = [(words(p), words(t)) for p, t in zip(predicted.to_pylist(), truth.to_pylist())]
            columns = [lcs_length(p, t) for p, t in both], [len(p) + len(t) for p, t in both]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["lcs", "words"])

    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = pairs.select("id", measured(lower("predicted"), lower("truth")).alias("m")).select("id", "m.lcs", "m.words")
    return rows.select("id", "lcs", F.when(F.col("words") > 0, 2.0 * F.col("lcs") / F.col("words")).otherwise(0.0).alias("f1"))


def extracted_answers(text: Column) -> Column:
    """Every "... is X" answer of a generation, joined by a blank; null if it has none or is sorry."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|;\s*)[^;]*?\bis\s+([^;]+)"), F.lit(1))
    return F.when((F.size(found) > 0) & ~text.contains("sorry"), F.array_join(F.transform(found, lambda x: F.btrim(x)), " "))


def transcripts(text: DataFrame, column: str = "text") -> DataFrame:
    """(question, prediction, truth) of the blocks of a transcript, parted by dashed lines."""
    block = text.select(F.explode(F.split(column, r"-{20,}\n?")).alias("block"))
    field = lambda name: F.btrim(F.regexp_extract("block", rf"(?s){name}:\s*(.*?)(?:\n[A-Z][A-Za-z ]*:|$)", 1))
    return block.filter(F.btrim(F.col("block")) != "").select(field("Question").alias("question"), field("PREDICTION").alias("prediction"), field("TRUE").alias("truth"))


def qa_lines(text: Column) -> Column:
    """struct(question, answer) of the first "Q:" and "A:" lines."""
    return F.struct(F.nullif(F.btrim(F.regexp_extract(text, r"(?m)^Q:\s*(.*)$", 1)), F.lit("")).alias("question"), F.nullif(F.btrim(F.regexp_extract(text, r"(?m)^A:\s*(.*)$", 1)), F.lit("")).alias("answer"))


def visible_indices(text: Column) -> Column:
    """Distinct indices of "UI element N:" lines; null if there are none."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bUI\s+element\s+([0-9]+)\s*:"), F.lit(1)), lambda x: x.cast("bigint"))))
    return F.when(F.size(found) > 0, found)


__all__ = ["grams", "rouge_n", "rouge_l", "extracted_answers", "transcripts", "qa_lines", "visible_indices"]
