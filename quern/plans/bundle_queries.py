"""Queries over a knowledge base as stored: its bundle, batch files, split outputs, rows by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.compat import shared_dir
from quern.functions import vectors as v
from quern.operators import retrieval
from quern.plans.episode_queries import CONVERTED, _converted
from quern.plans.fixtures import HIERARCHY, VECTORS, hierarchy, table, vectors
from quern.plans.registry import query
from quern.sources import bundles, rows


def _stored(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A bundle written and read back; a leaf's value is its key times two."""
    leaves = vectors(spark, sf_dir)
    edges = hierarchy(leaves)
    clusters = None
    for level in ("inter", "root"):
        part = retrieval.centroids(leaves, edges, f"{level}_id").select(F.lit(level).alias("level"), "id", "key")
        clusters = part if clusters is None else clusters.unionByName(part)
    path = shared_dir(spark, "bundle")
    bundles.write_bundle(path, leaves.withColumn("value", F.transform("key", lambda x: x * 2)), clusters, edges)
    return bundles.read_bundle(spark, path)


@query(f"WITH {VECTORS}, {HIERARCHY} SELECT id, inter_id, root_id, round(key[1], 6) AS key_0, round(key[1] * 2, 6) AS value_0, CAST(len(key) AS INTEGER) AS dims FROM vectors JOIN edges USING (id)")
def bundle_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stored(spark, sf_dir)
    both = found["leaves"].join(found["edges"], "id")
    return both.select("id", "inter_id", "root_id", v.rounded(F.col("key")[0], 6).alias("key_0"), v.rounded(F.col("value")[0], 6).alias("value_0"), F.size("key").alias("dims"))


@query(f"WITH {VECTORS}, {HIERARCHY} SELECT 'leaves' AS part, count(*) AS n FROM vectors UNION ALL SELECT 'inter', count(DISTINCT inter_id) FROM edges UNION ALL SELECT 'root', count(DISTINCT root_id) FROM edges")
def bundle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.bundle_sizes(_stored(spark, sf_dir))


@query(f"WITH {VECTORS} SELECT doc_id, lang, round(key[1], 6) AS key_0, round(key[1] + key[2], 6) AS value_0 FROM documents JOIN vectors ON id = doc_id")
def rows_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the key and value vectors of their position."""
    own = vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    keyed = bundles.with_vectors(docs, own.withColumnRenamed("key", "vector"), "doc_id", "key")
    both = bundles.with_vectors(keyed, own.select("id", F.array(F.col("key")[0] + F.col("key")[1]).alias("vector")), "doc_id", "value")
    return both.select("doc_id", "lang", v.rounded(F.col("key")[0], 6).alias("key_0"), v.rounded(F.col("value")[0], 6).alias("value_0"))


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id >= 100 AND vec_id < 350")
def row_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 250 rows from position 100 on."""
    return bundles.first_rows(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id", 250, start=100)


@query("SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by their number as text, out of one map: the table has a fixed 25 rows."""
    names = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))).alias("names"))
    return table(spark, sf_dir, "customer").join(F.broadcast(names)).select("c_custkey", bundles.looked_up(F.col("names"), F.col("c_nationkey")).alias("nation"))


@query("SELECT p_name AS name, p_brand AS description_type, p_type AS description FROM part")
def batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written in batch files of 100 and merged."""
    path = shared_dir(spark, "batches")
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("description_type"), F.col("p_type").alias("description"))
    rows.write_batches(parts, path, 100)
    return rows.merged_batches(spark, path, seed=7, array=False).select("name", "description_type", "description")


_STEP = T.StructType([T.StructField("episode_id", T.StringType()), T.StructField("step_index", T.LongType()), T.StructField("conversion_error", T.StringType())])


@query(f"WITH {CONVERTED} SELECT episode_id, step_index, conversion_error, conversion_error IS NOT NULL AS failed FROM converted")
def failure_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Converted steps and failed ones, written apart in one pass and read back."""
    path = shared_dir(spark, "checked")
    rows.write_checked(_converted(spark, sf_dir).select(*_STEP.names), "conversion_error", path)
    good, bad = (rows.read_checked(spark, path, _STEP, failed).withColumn("failed", F.lit(failed)) for failed in (False, True))
    return good.unionByName(bad)
