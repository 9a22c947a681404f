"""Gaussian mixtures with full covariances, by expectation maximisation over Arrow batches.

A point's log density under a component is linear in the point's monomials of degree two, so a batch
meets all components in one matrix product, and its responsibilities meet the monomials in another.
An iteration costs points x components x dims ** 2 / 2 multiplications; tasks pass on one block of
sums for every BLOCK components, and a component's new parameters are solved where its block is
added up. The driver holds the parameters only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.compat import written

#: Components of a block, numbers of a batch's responsibilities, what is added to each variance, and the
#: change of the log likelihood at which a fit ends.
BLOCK = 512
BATCH_CELLS = 1 << 21
LEAST_VARIANCE = 1e-6
TOLERANCE = 0.01
#: Points that a first component is made of.
START_POINTS = 5


@dataclass
class Mixture:
    """center: what is taken off each point; means are of the points as they came."""

    center: np.ndarray
    means: np.ndarray
    coefficients: np.ndarray
    log_likelihood: float = -math.inf


def monomials(x: np.ndarray) -> np.ndarray:
    """1, each coordinate, each product of two: a row a point."""
    a, b = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, a] * x[:, b]], axis=1)


def coefficients(weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """Of each component's log weight and density over monomials: a column a component."""
    d = means.shape[1]
    a, b = np.triu_indices(d)
    roots = np.linalg.cholesky(covariances)
    precision = np.linalg.inv(covariances)
    precision = (precision + precision.transpose(0, 2, 1)) / 2
    linear = np.einsum("kij,kj->ki", precision, means)
    log_det = 2 * np.log(np.diagonal(roots, axis1=1, axis2=2)).sum(axis=1)
    constant = np.log(weights) - 0.5 * (d * math.log(2 * math.pi) + log_det + (linear * means).sum(axis=1))
    return np.concatenate([constant[:, None], linear, precision[:, a, b] * np.where(a == b, -0.5, -1.0)], axis=1).T


def solved(sums: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """(means, coefficients) of components from their sums of monomials; total: all points."""
    d = round((math.sqrt(8 * sums.shape[0] + 1) - 3) / 2)
    a, b = np.triu_indices(d)
    n = sums[0] + 10 * np.finfo(float).eps
    means = (sums[1 : d + 1] / n).T
    second = np.zeros((sums.shape[1], d, d))
    second[:, a, b] = second[:, b, a] = (sums[d + 1 :] / n).T
    covariances = second - means[:, :, None] * means[:, None, :] + LEAST_VARIANCE * np.eye(d)
    spread, axes = np.linalg.eigh(covariances)  # rounding may leave a variance below the least one
    covariances = np.einsum("kij,kj,klj->kil", axes, np.maximum(spread, LEAST_VARIANCE), axes)
    return means, coefficients(n / total, means, covariances)


def _batches(x: np.ndarray, components: int) -> Iterator[np.ndarray]:
    size = max(16, BATCH_CELLS // components)
    return (x[i : i + size] for i in range(0, len(x), size))


def _sums(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums of monomials by component, and the log likelihood."""
    out, likelihood = np.zeros(c.shape), 0.0
    for part in _batches(x, c.shape[1]):
        f = monomials(part)
        p = f @ c
        top = p.max(axis=1)
        p -= top[:, None]
        np.exp(p, out=p)
        s = p.sum(axis=1)
        likelihood += float((top + np.log(s)).sum())
        out += (f / s[:, None]).T @ p
    return out, likelihood


def _points(frame: pd.DataFrame, center: np.ndarray) -> np.ndarray:
    return np.stack(frame["x"].to_numpy()).astype(np.float64) - center


def _step(points: DataFrame, models: dict[int, Mixture], total: int) -> None:
    """One iteration of each model in place, by one job; its log likelihood is of what it was before."""
    now = {r: (m.center, m.coefficients) for r, m in models.items()}

    def collected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}
        for frame in frames:
            for r, (center, c) in now.items() if len(frame) else ():
                sums, likelihood = _sums(_points(frame, center), c)
                old = found.get(r, (0.0, 0.0))
                found[r] = old[0] + sums, old[1] + likelihood
        for r, (sums, likelihood) in found.items():
            for at in range(0, sums.shape[1], BLOCK):
                yield pd.DataFrame({"fit": [r], "at": [at], "sums": [np.ascontiguousarray(sums[:, at : at + BLOCK]).tobytes()], "likelihood": [likelihood]})

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("likelihood")  # sums are of one order, however the rows arrive
        rows = len(now[frame["fit"][0]][1])
        means, c = solved(sum(np.frombuffer(s).reshape(rows, -1) for s in frame["sums"]), total)
        return pd.DataFrame({"fit": frame["fit"][:1], "at": frame["at"][:1], "means": [means.tobytes()], "c": [c.tobytes()], "likelihood": [math.fsum(frame["likelihood"])]})

    parts = points.mapInPandas(collected, "fit int, at int, sums binary, likelihood double")
    rows = parts.groupBy("fit", "at").applyInPandas(merged, "fit int, at int, means binary, c binary, likelihood double").collect()
    for r, model in models.items():
        own = sorted((row for row in rows if row["fit"] == r), key=lambda row: row["at"])
        model.means = np.concatenate([np.frombuffer(row["means"]).reshape(-1, len(model.center)) for row in own])
        model.coefficients = np.concatenate([np.frombuffer(row["c"]).reshape(len(model.coefficients), -1) for row in own], axis=1)
        model.log_likelihood = own[0]["likelihood"]


def _start(points: DataFrame, k: int, center: np.ndarray, seed: int) -> Mixture:
    """Each component is the mean and the variances of some points, in the order of a hash of their ids."""
    picked = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(START_POINTS * k).toPandas()
    x = np.resize(_points(picked, center), (k, START_POINTS, len(center)))  # goes round if there are too few
    variances = x.var(axis=1) + LEAST_VARIANCE
    means = x.mean(axis=1)
    return Mixture(center, means, coefficients(np.full(k, 1 / k), means, variances[:, :, None] * np.eye(len(center))))


def fit(points: DataFrame, k: int, iterations: int, restarts: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster), means of the clusters) of points (id, x array<double>): the likeliest of some restarts.

    All restarts share an iteration's pass over the points, and each ends by itself.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    points = written(points.repartition(cores), "points")
    n = points.count()
    size = points.select(F.size("x")).first()[0]
    center = np.array(points.agg(*[F.avg(F.col("x")[i]) for i in range(size)]).first(), np.float64)
    models = {r: _start(points, k, center, seed + r) for r in range(restarts)}
    going = dict(models)
    for _ in range(iterations):
        last = {r: m.log_likelihood for r, m in going.items()}
        _step(points, going, n)
        going = {r: m for r, m in going.items() if abs(m.log_likelihood - last[r]) > TOLERANCE}
        if not going:
            break
    best = max(models.values(), key=lambda m: m.log_likelihood)

    def labelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = _points(frame, best.center)
                yield pd.DataFrame({"id": frame["id"], "cluster": np.concatenate([(monomials(part) @ best.coefficients).argmax(axis=1) for part in _batches(x, k)])})

    return points.mapInPandas(labelled, f"id {dict(points.dtypes)['id']}, cluster bigint"), best.means + center
