"""Quality rules by distribution divergence.

Counting rules come first (few words, repeated three-word windows). A text that passes them is
compared with language references learned from the whole corpus: its histogram of character
classes and its histogram of each language's most common words, each by Jensen-Shannon distance
(base 2, between 0 and 1). It is kept if some language is near enough in both. Histograms of
short texts say little, so minimum lengths guard both tests.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import BATCH_ROWS, by_batch, small_batches, staged, trim_memory

#: Character classes of the first histogram.
CLASSES = ("lower", "upper", "other letter", "digit", "white space", "stop", "bracket or quote", "symbol")
SYMBOLS = "#*$%&|<>"
#: Words from which on windows are counted by number; no effect on results.
LONG_TEXT = 4096
_STOPS, _QUOTES = ".,;:!?", "()[]{}\"'`-_/\\"


@dataclass(frozen=True)
class Rules:
    """Parameters; the words of a reference are bounded, its languages and what they count aren't.

    The word limit is max_word_distance + short_text_slack / sqrt(words): few words scatter widely.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_class_distance: float = 0.30
    max_word_distance: float = 0.43
    short_text_slack: float = 0.5
    min_class_chars: int = 200
    min_common_words: int = 50
    reference_words: int = 64


def _class_table() -> np.ndarray:
    table = np.full(0x3000, 7, np.uint8)
    for c in range(0x3000):
        s = chr(c)
        if s.islower():
            table[c] = 0
        elif s.isupper():
            table[c] = 1
        elif s.isalpha():
            table[c] = 2
        elif s.isdigit():
            table[c] = 3
        elif s.isspace():
            table[c] = 4
        elif s in _STOPS:
            table[c] = 5
        elif s in _QUOTES:
            table[c] = 6
    return table


_TABLE = _class_table()


def class_counts(text: str) -> np.ndarray:
    """Characters of each class; from U+3000 on all count as other letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 2), minlength=len(CLASSES))


def words_of(text: str) -> list[str]:
    """Maximal runs of anything but ASCII white space."""
    return [w.decode() for w in text.encode().split()]


def repeat_words(words: list[str]) -> int:
    """Words in three-word windows that stand twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:]))
    repeated = until = 0  # words up to there are counted
    if len(counts := Counter(windows)) < len(windows):
        for k, w in enumerate(windows):
            if counts[w] > 1:
                repeated += k + 3 - max(until, k)
                until = k + 3
    return repeated


def long_repeat_words(words: list[str]) -> int:
    """As repeat_words, on word numbers: a long text's windows as objects would take much memory."""
    number: dict[str, int] = {}
    at = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    _, pair = np.unique(at[:-1] * len(number) + at[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * len(number) + at[2:], return_inverse=True, return_counts=True)
    twice = np.zeros(len(words), bool)
    for k in range(3):
        twice[k : len(words) - 2 + k] |= n[window] > 1
    return int(twice.sum())


def base_counts(text: str | None) -> dict[str, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: none)."""
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.encode().split()]
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words) if n < LONG_TEXT else long_repeat_words(words),
    }


@dataclass
class References:
    """Of each language: shares of the character classes; its common words, and their shares."""

    languages: list[str] = field(default_factory=list)
    classes: np.ndarray = field(default_factory=lambda: np.zeros((0, len(CLASSES))))
    words: list[list[str]] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)

    @cached_property
    def entries(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """By word: numbers of the words, where the entries of each start, and their languages and shares."""
        number: dict[bytes, int] = {}
        at = np.array([number.setdefault(w.encode(), len(number)) for words in self.words for w in words], np.int64)
        order = np.argsort(at, kind="stable")
        langs = np.repeat(np.arange(len(self.words)), [len(w) for w in self.words])[order]
        shares = np.concatenate([s[:-1] for s in self.shares])[order]
        return number, np.searchsorted(at[order], np.arange(len(number) + 1)), langs, shares

    @cached_property
    def rest(self) -> np.ndarray:
        return np.array([s[-1] for s in self.shares])

    @cached_property
    def unseen(self) -> np.ndarray:
        """Of each language, what its common words add to the divergence if a text has none of them."""
        return np.array([s[:-1].sum() / 2 for s in self.shares])

    def word_distances(self, words: list[bytes]) -> np.ndarray:
        """Jensen-Shannon distance to each language; work grows with the entries of the text's words."""
        number, starts, langs, shares = self.entries
        seen = Counter(words)
        both = list(number.keys() & seen.keys())
        at = np.array([number[w] for w in both], np.int64)
        n = starts[at + 1] - starts[at]
        flat = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        counts = np.repeat(np.array([seen[w] for w in both], float), n)
        lang, q, p = langs[flat], shares[flat], counts / len(words)
        more = _js_terms(p, q) - q / 2
        left = (len(words) - np.bincount(lang, counts, len(self.languages))) / len(words)
        return np.sqrt(np.maximum(0, self.unseen + np.bincount(lang, more, len(self.languages)) + _js_terms(left, self.rest)))


def learn_references(docs: DataFrame, rules: Rules = Rules()) -> References:
    """Counts over all whole texts; every lang value has a reference, and only its shares reach the driver.

    A partial count of each batch leaves the Python workers, so a frequent word or a large language
    is one row a batch. A null language is a language of its own.
    """

    def count(c: dict) -> dict:
        by: dict[str, tuple[Counter, np.ndarray]] = {}
        for lang, text in zip(c["lang"], c["text"]):
            words, classes = by.setdefault(lang or "", (Counter(), np.zeros(len(CLASSES), np.int64)))
            words.update((text or "").lower().encode().split())
            classes += class_counts(text or "")
        rows = [(lang, w.decode(), None, n) for lang, (words, _) in by.items() for w, n in words.items()]
        rows += [(lang, None, k, int(n)) for lang, (_, classes) in by.items() for k, n in enumerate(classes)]
        return dict(zip(("lang", "word", "class", "n"), zip(*rows) if rows else [()] * 4))

    source = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = by_batch(source, count, "lang string, word string, class int, n bigint", batch_rows=BATCH_ROWS).groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    counts = staged(counts, "language-counts")
    # Spark keeps the first rows of each window before it shuffles, so a language's words needn't meet.
    top = (
        counts.filter("word is not null or class is not null")
        .withColumn("is_word", F.col("word").isNotNull())
        .withColumn("at", F.row_number().over(Window.partitionBy("lang", "is_word").orderBy(F.desc("n"), "word")))
        .filter(F.col("at") <= max(rules.reference_words, len(CLASSES)))
        .select("lang", "word", "class", "n")
    )
    totals = counts.groupBy("lang").agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("words"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("chars"))
    # One row a language: its words by falling count, and its classes.
    listed = lambda keep, key: F.sort_array(F.collect_list(F.when(keep, F.struct((-F.col("n")).alias("less"), F.col(key).alias("key")))))
    tables = top.groupBy("lang").agg(listed(F.col("word").isNotNull(), "word").alias("common"), listed(F.col("class").isNotNull(), "class").alias("classes"))
    tables = tables.select("lang", F.col("common.key").alias("common"), F.col("common.less").alias("common_less"), F.col("classes.key").alias("classes"), F.col("classes.less").alias("classes_less"))
    out, classes = References(), []
    for r in totals.filter("chars > 0 and words > 0").join(tables, "lang").orderBy(F.desc("chars"), F.desc("lang")).toLocalIterator():
        own = np.zeros(len(CLASSES))
        own[r["classes"]] = -np.array(r["classes_less"]) / r["chars"]
        classes.append(own)
        shares = -np.array(r["common_less"][: rules.reference_words]) / r["words"]
        out.languages.append(r["lang"])
        out.words.append(r["common"][: rules.reference_words])
        out.shares.append(np.append(shares, max(0.0, 1 - shares.sum())))
    out.classes = np.array(classes).reshape(-1, len(CLASSES))
    return out


def _js_terms(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return sum(np.where(x > 0, x * np.log2(x / m), 0) / 2 for x in (p, q))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in base 2 along the last axis."""
    return np.sqrt(np.maximum(0, _js_terms(p, q).sum(axis=-1)))


def divergence(text: str, refs: References, rules: Rules = Rules()) -> tuple[bool, float | None, float | None]:
    """(kept, class distance, word distance) of the nearest language; None where a guard holds."""
    counts = class_counts(text)
    n = int(counts.sum())
    by_class = js_distance(counts / n, refs.classes) if n >= rules.min_class_chars and refs.languages else None
    words = text.lower().encode().split()
    by_word = refs.word_distances(words) if len(words) >= rules.min_common_words and refs.languages else None
    if by_class is None and by_word is None:
        return True, None, None
    most = rules.max_word_distance + rules.short_text_slack / len(words) ** 0.5 if words else 1.0
    zero = np.zeros(len(refs.languages))
    a, b = zero if by_class is None else by_class, zero if by_word is None else by_word
    k = int(np.argmin(np.maximum(a / rules.max_class_distance, b / most)))
    kept = bool(a[k] <= rules.max_class_distance and b[k] <= most)
    return kept, None if by_class is None else float(a[k]), None if by_word is None else float(b[k])


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, kept boolean"


def quality_rules(docs: DataFrame, rules: Rules = Rules(), refs: References | None = None) -> DataFrame:
    """One row a document: counts, base verdict, distances to the nearest reference, verdict.

    Null text counts as empty and fails the base rule; a corpus without any word has no reference,
    and then only the base rule decides; repeated rows are judged alike; texts are taken whole.
    """
    refs = refs or learn_references(docs, rules)

    def judge(c: dict) -> dict:
        out = []
        for doc_id, text in zip(c["doc_id"], c["text"]):
            base = base_counts(text)
            failed = base["n_words"] < rules.min_words or 100 * base["n_repeat_words"] > rules.max_repeat_percent * base["n_words"]
            kept, by_class, by_word = (False, None, None) if failed else divergence(text, refs, rules)
            out.append({"doc_id": doc_id, **base, "base_failed": failed, "class_distance": by_class, "word_distance": by_word, "kept": kept})
        return {k: [r[k] for r in out] for k in names}

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return by_batch(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), judge, SCHEMA)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs without the rows that quality_rules rejects; all columns stay, and equal rows go together.

    The verdict is taken where the text is, so no shuffle: a pandas function over the text column.
    """
    refs = learn_references(docs, rules)
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        def one(text) -> bool:
            base = base_counts(text)
            return not (base["n_words"] < rules.min_words or 100 * base["n_repeat_words"] > rules.max_repeat_percent * base["n_words"]) and divergence(text, refs, rules)[0]

        found = texts.map(one)
        trim_memory()
        return found

    return docs.filter(good(F.col("text")))
