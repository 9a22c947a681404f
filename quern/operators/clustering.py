"""A two-level cluster hierarchy of key vectors: reduce, fit mixtures bottom-up, average in the original space."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import mixtures


def level_sizes(leaves: int, levels: int = 2) -> list[int]:
    """Clusters of level i, always from the number of leaves: ceil(N ** ((levels - i) / (levels + 1)))."""
    return [math.ceil(leaves ** ((levels - i) / (levels + 1))) for i in range(levels)]


def fit_hierarchy(leaves: DataFrame, dims: int = 8, restarts: int = 2, iterations: int = 50, seed: int = 7, levels: int = 2) -> list[DataFrame]:
    """Edges (member, cluster) of each level, leaves first.

    Level 0 clusters the reduced keys; each later level clusters the mixture means of the one below.
    The best of some restarts by log-likelihood is kept. Principal components stand in for the
    manifold reduction. The means of a level are as many as level_sizes says, far fewer than leaves.
    """
    spark = leaves.sparkSession
    data = leaves.select("id", array_to_vector("key").alias("raw"))
    out, now, n = [], PCA(k=dims, inputCol="raw", outputCol="x").fit(data).transform(data).select("id", vector_to_array("x").alias("x")), leaves.count()
    members = n
    for k in level_sizes(n, levels):
        k = max(2, min(k, members - 1))
        edges, means = mixtures.fit(now, k, iterations, restarts, seed)
        out.append(edges.select(F.col("id").alias("member"), "cluster"))
        # As many means as clusters, far fewer than leaves.
        now, members = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(means)], "id bigint, x array<double>"), k
    return out
