"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.compat import once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """With a guard of 1e-12 on the denominator."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-12)


def scaled_dot(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(F.size(a).cast("double"))


def layer_norm(a: Column) -> Column:
    """Zero mean, unit variance, 1e-5 under the root, no scale or shift.

    The mean is taken off before squares are summed, so a large mean costs no digits. What is summed is
    bound to a lambda's variable, so it is taken once and not for each element.
    """
    n = F.size(a).cast("double")
    centred = once(F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n, lambda mean: F.transform(a, lambda x: x - mean))
    return once(centred, lambda c: once(F.sqrt(dot(c, c) / n + 1e-5), lambda root: F.transform(c, lambda x: x / root)))


def rounded(c: Column, digits: int) -> Column:
    """Half up; what is negative and rounds to zero keeps its sign, as in SQL engines that round doubles."""
    r = F.round(c, digits)
    return F.when((r == 0) & (c < 0), F.lit(-0.0)).otherwise(r)


def rescaled(score: Column, size: Column | int, scale: float = 100.0) -> Column:
    """A score shifted by the knowledge base's size: - ln(size) + ln(scale)."""
    return score - F.log(F.lit(size).cast("double") if isinstance(size, int) else size.cast("double")) + F.log(F.lit(float(scale)))


def project(c: Column, weights, bias=None, layer_norm: bool = False) -> Column:
    """x W + b of each vector by numpy in Arrow batches; weights: in x out, a fixed size. layer_norm as for keys."""
    w = np.asarray(weights, np.float64)
    b = np.zeros(w.shape[1]) if bias is None else np.asarray(bias, np.float64)

    @F.pandas_udf("array<double>")
    def run(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return vectors
        out = np.stack(vectors.to_numpy()).astype(np.float64) @ w + b
        if layer_norm:
            out = (out - out.mean(axis=1, keepdims=True)) / np.sqrt(out.var(axis=1, keepdims=True) + 1e-5)
        return pd.Series(list(out))

    return run(c)


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A stand-in for a sentence encoder: counts of hashed words and word pairs, of unit length.

    Arrow batches, as any encoder behind this hook would need; null and empty texts are all zeros.
    """

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            words = re.findall(r"\w+", (t or "").lower())
            grams = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
            counts = np.bincount([zlib.crc32(g.encode()) % dims for g in grams], minlength=dims).astype(float) if grams else np.zeros(dims)
            return counts / max(np.sqrt((counts**2).sum()), 1e-12)

        return pd.Series([one(t) for t in texts], dtype="object")

    return run(text)
