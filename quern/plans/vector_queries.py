"""Queries over vectors: top-k, hierarchy, softmax, clusters, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import vectors as v
from quern.compat import hash_order
from quern.operators import clustering, kg2kv, retrieval, sampling
from quern.plans.fixtures import HIERARCHY, VECTORS, hierarchy, table, vectors
from quern.plans.registry import query

#: The query set: every row whose id is divisible by 100, against all rows.
STEP = 100
QUERIES = f"queries AS (SELECT id AS query_id, key AS query FROM vectors WHERE id % {STEP} = 0)"
SCORES = "scores AS (SELECT query_id, id, list_inner_product(query, key) AS score FROM queries, vectors)"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).filter(F.col("id") % STEP == 0).select(F.col("id").alias("query_id"), F.col("key").alias("query"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.scores(_queries(spark, sf_dir), vectors(spark, sf_dir))


def _rounded(df: DataFrame, c: str = "score") -> DataFrame:
    return df.withColumn(c, v.rounded(F.col(c), 6))


@query(f"WITH {VECTORS}, {QUERIES}, {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores) SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 16")
def flat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(retrieval.flat_topk(_queries(spark, sf_dir), vectors(spark, sf_dir), 16))


def _centroids_sql(c: str) -> str:
    return f"(SELECT c AS id, list(m ORDER BY pos) AS key FROM (SELECT {c} AS c, pos, avg(val) AS m FROM (SELECT {c}, unnest(key) AS val, generate_subscripts(key, 1) AS pos FROM vectors JOIN edges USING (id)) GROUP BY {c}, pos) GROUP BY c)"


@query(f"WITH {VECTORS}, {HIERARCHY}, c AS {_centroids_sql('inter_id')} SELECT id, list_transform(key, lambda x: round(x, 6)) AS key, (SELECT count(*) FROM edges e WHERE e.inter_id = c.id) AS members FROM c")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = vectors(spark, sf_dir)
    return retrieval.centroids(leaves, hierarchy(leaves), "inter_id").withColumn("key", F.transform("key", lambda x: v.rounded(x, 6)))


@query(
    f"""WITH {VECTORS}, {HIERARCHY}, {QUERIES}, rc AS {_centroids_sql("root_id")}, ic AS {_centroids_sql("inter_id")},
 r AS (SELECT query_id, rc.id AS root_id, row_number() OVER (PARTITION BY query_id ORDER BY list_inner_product(query, rc.key) DESC, rc.id) AS n FROM queries, rc),
 io AS (SELECT DISTINCT inter_id, root_id FROM edges),
 i AS (SELECT q.query_id, ic.id AS inter_id, row_number() OVER (PARTITION BY q.query_id ORDER BY list_inner_product(query, ic.key) DESC, ic.id) AS n FROM r JOIN io USING (root_id) JOIN ic ON ic.id = io.inter_id JOIN queries q USING (query_id) WHERE r.n <= 3),
 l AS (SELECT q.query_id, v.id, list_inner_product(query, v.key) AS score FROM i JOIN edges USING (inter_id) JOIN vectors v ON v.id = edges.id JOIN queries q USING (query_id) WHERE i.n <= 4),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM l)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 8"""
)
def hier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = vectors(spark, sf_dir)
    return _rounded(retrieval.hierarchical_topk(_queries(spark, sf_dir), leaves, hierarchy(leaves), 3, 4, 8)).select("query_id", "id", "score", "rank")


@query(f"WITH {VECTORS}, {HIERARCHY} SELECT CAST(k AS BIGINT) AS cluster, coalesce((SELECT list(id ORDER BY id) FROM edges WHERE inter_id = k), CAST([] AS BIGINT[])) AS ids FROM range(26) t(k)")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.all_clusters(hierarchy(vectors(spark, sf_dir)), "inter_id", 26)


@query(f"WITH {VECTORS}, {HIERARCHY}, s AS (SELECT e.* FROM edges e JOIN embeddings m ON m.vec_id = e.id WHERE label = 3) SELECT DISTINCT 'inter' AS level, inter_id AS cluster_id FROM s UNION ALL SELECT DISTINCT 'root', root_id FROM s")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    subset = table(spark, sf_dir, "embeddings").filter("label = 3").select(F.col("vec_id").alias("id"))
    return retrieval.ancestors(subset, hierarchy(vectors(spark, sf_dir)))


@query(f"WITH {VECTORS}, {HIERARCHY} SELECT id FROM edges WHERE inter_id % 2 = 0 INTERSECT SELECT vec_id FROM embeddings WHERE label < 5")
def candidate_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    subset = table(spark, sf_dir, "embeddings").filter("label < 5").select(F.col("vec_id").alias("id"))
    return hierarchy(vectors(spark, sf_dir)).filter("inter_id % 2 = 0").select("id").distinct().join(subset, "id", "left_semi")


@query(f"WITH {VECTORS}, {QUERIES}, {SCORES}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS mx FROM scores) SELECT query_id, round(sum(exp(score - mx) * (id % 10)) / sum(exp(score - mx)), 6) AS value FROM m GROUP BY query_id")
def softmax_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts, merged; the SQL takes one softmax over all."""
    keys = vectors(spark, sf_dir).withColumns({"part": F.col("id") % 3, "value": (F.col("id") % 10).cast("double")})
    return _rounded(retrieval.merged_attention(_queries(spark, sf_dir), keys), "value")


@query(
    f"""WITH {VECTORS}, {QUERIES}, heads AS (SELECT query_id, h, id, list_inner_product(query[16*h+1:16*h+16], key[16*h+1:16*h+16]) / 4 AS score FROM queries, vectors, range(4) t(h)),
 p AS (SELECT query_id, id, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS prob FROM heads WINDOW w AS (PARTITION BY query_id, h))
SELECT query_id, id, round(sum(prob), 6) AS score FROM p GROUP BY query_id, id"""
)
def score_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of each of four heads, summed for each key."""
    return _rounded(retrieval.pooled(_queries(spark, sf_dir), vectors(spark, sf_dir), 4))


@query(
    f"""WITH {VECTORS}, again AS (SELECT id, CASE WHEN id % 7 = 0 THEN list_transform(key, lambda x, i: x + (i % 3) * 0.2) ELSE key END AS key FROM vectors),
 s AS (SELECT a.id AS center, v.id, list_inner_product(a.key, v.key) / (sqrt(list_inner_product(a.key, a.key)) * sqrt(list_inner_product(v.key, v.key)) + 1e-12) AS sim FROM again a JOIN vectors v ON v.id BETWEEN a.id - 3 AND a.id + 3)
SELECT center, round(max(sim) FILTER (WHERE id = center), 6) AS own_sim, round(max(sim), 6) AS best_sim, arg_max(id, row(sim, -id)) AS best_id, max(sim) FILTER (WHERE id = center) >= max(sim) - 1e-3 AS consistent FROM s GROUP BY center"""
)
def consistency_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = vectors(spark, sf_dir)
    again = stored.withColumn("key", F.when(F.col("id") % 7 == 0, F.transform("key", lambda x, i: x + ((i + 1) % 3) * 0.2)).otherwise(F.col("key")))
    return _rounded(_rounded(retrieval.neighbour_check(stored, again), "own_sim"), "best_sim")


@query(
    f"""WITH {VECTORS}, {QUERIES}, {SCORES}, r AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores),
 t AS (SELECT query_id, (query_id + query_id // 100) % (SELECT count(*) FROM vectors) AS id FROM queries)
SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS acc1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS acc5 FROM t JOIN r USING (query_id, id)"""
)
def acc_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.flat_topk(_queries(spark, sf_dir), vectors(spark, sf_dir), 5)
    n = vectors(spark, sf_dir).agg(F.count("*").alias("n"))
    truth = _queries(spark, sf_dir).join(F.broadcast(n)).select("query_id", ((F.col("query_id") + F.floor(F.col("query_id") / 100)) % F.col("n")).alias("id"))
    return _rounded(_rounded(retrieval.accuracy(ranked, truth), "acc1"), "acc5")


@query(f"WITH {VECTORS}, n AS (SELECT id, list_transform(key, lambda x: x - list_avg(key)) AS c FROM vectors) SELECT id, list_transform(c, lambda x: round(x / sqrt(list_inner_product(c, c) / 64 + 1e-5), 5)) AS key FROM n")
def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.transform(v.layer_norm(F.col("key")), lambda x: v.rounded(x, 5)).alias("key"))


@query(f"WITH {VECTORS}, {QUERIES}, {SCORES} SELECT query_id, id, round(score / 8 - ln((SELECT count(*) FROM vectors)) + ln(100), 6) AS score FROM scores")
def rescaled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vectors(spark, sf_dir).agg(F.count("*").alias("n"))
    return _scores(spark, sf_dir).join(F.broadcast(n)).select("query_id", "id", v.rounded(v.rescaled(F.col("score") / 8, F.col("n")), 6).alias("score"))


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY md5('11|' || vec_id), vec_id LIMIT 300")
def kb_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.without_replacement(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id", 300, 11)


@query("SELECT draw, vec_id AS id FROM range(400) t(draw) JOIN embeddings ON vec_id = CAST('0x' || substr(md5('5|' || draw), 1, 8) AS BIGINT) % (SELECT count(*) FROM embeddings)")
def kb_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with replacement among all positions."""
    keys = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return sampling.with_replacement(keys, "id", keys.count(), 400, 5)


@query("SELECT vec_id AS id, row_number() OVER (ORDER BY md5('3|' || vec_id), vec_id) - 1 AS place FROM embeddings")
def kb_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in a seeded order; the place is counted by ranges, so no task sorts them all."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(hash_order("vec_id", seed=3), F.lpad(F.col("vec_id").cast("string"), 20, "0")).alias("_at"))
    return kg2kv.batch_ids(rows, "_at", 1).select("id", F.col("batch_id").alias("place"))


@query("SELECT i AS level, CAST(ceil(pow((SELECT count(*) FROM embeddings), (2.0 - i) / 3)) AS BIGINT) AS clusters FROM range(2) t(i)")
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    return spark.range(2).join(F.broadcast(n)).select(F.col("id").alias("level"), F.ceil(F.pow(F.col("n").cast("double"), (2.0 - F.col("id")) / 3)).alias("clusters"))


@query()
def gmm_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(level, member, cluster) of a fitted hierarchy: an iterative model, compared by invariants in tests."""
    levels = clustering.fit_hierarchy(vectors(spark, sf_dir))
    out = [df.select(F.lit(i).alias("level"), "member", "cluster") for i, df in enumerate(levels)]
    return out[0].unionByName(out[1])


@query(f"WITH {VECTORS} SELECT id, [round(list_sum(list_transform(key, lambda x, i: x * (i % 3))), 5), round(1 + list_sum(list_transform(key, lambda x, i: x * ((i + 1) % 5))), 5)] AS projected FROM vectors")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear projection of every key with fixed weights."""
    weights = [[(i + 1) % 3, (i + 2) % 5] for i in range(64)]
    return vectors(spark, sf_dir).select("id", F.transform(v.project(F.col("key"), weights, [0, 1]), lambda x: v.rounded(x, 5)).alias("projected"))


@query()
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed word vectors of the benchmark texts; tests check length and nearness of equal texts."""
    return table(spark, sf_dir, "benchmark").select("item_id", v.hashed_embedding(F.col("text")).alias("key"))
