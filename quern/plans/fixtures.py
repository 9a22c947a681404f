"""Reference-shaped inputs made from the driver's tables: triples, entities, episodes, boxes, edges.

Each comes as a DataFrame and as SQL common table expressions, so that a query and its DuckDB
equivalent start from the same rows. Whole tables and whole texts, always.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Row numbers of triples: kind * 10**15 + a key; a line's key is doc_id * 10**6 + its place.
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid, head, relation, tail): star-schema edges and every line of every document."""
    t = lambda name: table(spark, sf_dir, name)
    s = lambda kind, key, head, relation, tail: [(F.lit(kind * 10**15) + key).cast("bigint").alias("rid"), head.alias("head"), F.lit(relation).alias("relation"), tail.alias("tail")]
    nation, region = t("nation"), t("region")
    parts = [
        t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter("line <> ''").select(*s(1, F.col("doc_id") * 1_000_000 + F.col("pos"), F.concat(F.lit("document "), F.col("doc_id").cast("string")), "statement", F.col("line"))),
        t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(*s(2, F.col("c_custkey"), F.col("c_name"), "home \"country\"", F.col("n_name"))),
        t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(*s(3, F.col("s_suppkey"), F.col("s_name"), "home country", F.col("n_name"))),
        nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(*s(4, F.col("n_nationkey"), F.col("n_name"), "region", F.col("r_name"))),
        t("part").select(*s(5, F.col("p_partkey"), F.col("p_name"), "brand", F.col("p_brand"))),
        t("part").select(*s(6, F.col("p_partkey"), F.col("p_name"), "participates in", F.col("p_type"))),
        t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(*s(7, F.col("o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "buyer", F.col("c_name"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TRIPLES = """doc_lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), triples AS (
  SELECT 1000000000000000 + doc_id * 1000000 + pos AS rid, 'document ' || doc_id AS head, 'statement' AS relation, line AS tail FROM doc_lines WHERE line <> ''
  UNION ALL SELECT 2000000000000000 + c_custkey, c_name, 'home "country"', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 3000000000000000 + s_suppkey, s_name, 'home country', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 4000000000000000 + n_nationkey, n_name, 'region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 5000000000000000 + p_partkey, p_name, 'brand', p_brand FROM part
  UNION ALL SELECT 6000000000000000 + p_partkey, p_name, 'participates in', p_type FROM part
  UNION ALL SELECT 7000000000000000 + o_orderkey, 'order ' || o_orderkey, 'buyer', c_name FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded action steps: an episode a user, a raw action an event; k is the event's number.

    (episode_id string, step_index, k, goal, ui, instruction, action_type, idx, x, y, text, direction, app_name, goal_status).
    """
    # Numbered by the episode's own name, so that windows by episode after it find their rows together.
    w = Window.partitionBy("episode_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").select("*", F.col("user_id").cast("string").alias("episode_id"), k.alias("k"))
    e = e.withColumn("step_index", (F.row_number().over(w) - 1).cast("bigint"))
    kind = F.col("event_type")
    return e.select(
        "episode_id",
        "step_index",
        "k",
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("Finish the plan of user "), F.col("user_id").cast("string"), F.lit("."))).alias("goal"),
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("UI element "), F.col("k").cast("string"), F.lit(": UIElement(text='item "), F.col("k").cast("string"), F.lit("')"))).alias("ui"),
        F.when(F.col("k") % 7 != 0, F.concat(F.element_at(F.array(*[F.lit(v) for v in VERBS]), (F.col("k") % len(VERBS) + 1)), F.lit(" the item "), F.col("k").cast("string"), F.lit("."))).alias("instruction"),
        F.when(kind == "click", F.when(F.col("k") % 10 == 9, "long_press").otherwise("click")).when(kind == "view", "scroll").when(kind == "purchase", "input_text").when(kind == "signup", F.when(F.col("k") % 2 == 0, "open_app").otherwise("status")).otherwise("swipe").alias("action_type"),
        F.when((kind == "click") & (F.col("k") % 3 != 0) | (kind == "purchase"), F.col("k")).cast("bigint").alias("idx"),
        F.when((kind == "click") & (F.col("k") % 3 == 0), F.col("k") * 10).cast("bigint").alias("x"),
        F.when((kind == "click") & (F.col("k") % 3 == 0) & (F.col("k") % 2 == 0), F.col("k") * 20).cast("bigint").alias("y"),
        F.when(kind == "purchase", F.concat(F.lit("item "), F.col("k").cast("string"))).alias("text"),
        F.when(kind == "view", F.element_at(F.array(*[F.lit(v) for v in ("up", "down", "left", "right", "away")]), F.col("k") % 5 + 1)).alias("direction"),
        F.when((kind == "signup") & (F.col("k") % 4 == 0), F.concat(F.lit("App "), F.col("k").cast("string"))).alias("app_name"),
        F.when((kind == "signup") & (F.col("k") % 2 == 1), F.when(F.col("k") % 3 == 0, "complete").when(F.col("k") % 3 == 1, "infeasible").otherwise("unknown")).alias("goal_status"),
    )


VERBS = ("open", "tap", "Make", "die", "agree", "stop", "to search", "fix", "send", "long press", "Long-pressing", "saving", "set", "running", "42 times check", "visit")

_VERBS = ", ".join(f"'{v}'" for v in VERBS)
STEPS = f"""events_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_index FROM events
), steps AS (
  SELECT CAST(user_id AS VARCHAR) AS episode_id, step_index, k,
    CASE WHEN user_id % 11 <> 0 THEN 'Finish the plan of user ' || user_id || '.' END AS goal, CASE WHEN k % 5 <> 0 THEN 'UI element ' || k || ': UIElement(text=''item ' || k || ''')' END AS ui,
    CASE WHEN k % 7 <> 0 THEN ([{_VERBS}])[k % {len(VERBS)} + 1] || ' the item ' || k || '.' END AS instruction,
    CASE event_type WHEN 'click' THEN CASE WHEN k % 10 = 9 THEN 'long_press' ELSE 'click' END WHEN 'view' THEN 'scroll' WHEN 'purchase' THEN 'input_text'
      WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'open_app' ELSE 'status' END ELSE 'swipe' END AS action_type,
    CAST(CASE WHEN event_type = 'click' AND k % 3 <> 0 OR event_type = 'purchase' THEN k END AS BIGINT) AS idx,
    CAST(CASE WHEN event_type = 'click' AND k % 3 = 0 THEN k * 10 END AS BIGINT) AS x,
    CAST(CASE WHEN event_type = 'click' AND k % 3 = 0 AND k % 2 = 0 THEN k * 20 END AS BIGINT) AS y,
    CASE WHEN event_type = 'purchase' THEN 'item ' || k END AS text,
    CASE WHEN event_type = 'view' THEN (['up', 'down', 'left', 'right', 'away'])[k % 5 + 1] END AS direction,
    CASE WHEN event_type = 'signup' AND k % 4 = 0 THEN 'App ' || k END AS app_name,
    CASE WHEN event_type = 'signup' AND k % 2 = 1 THEN CASE k % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'infeasible' ELSE 'unknown' END END AS goal_status
  FROM events_k
)"""


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen elements: a screen an order, an element a line item, boxes by integer arithmetic.

    (screen, idx, x_min, x_max, y_min, y_max, visible, clickable, editable, focused, enabled, package).
    """
    x, y = (F.col("l_partkey") * 37) % 1000, (F.col("l_suppkey") * 91 + F.col("l_linenumber") * 13) % 2300
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    # Numbered by the screen's own name, so that windows by screen after it find their rows together.
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "screen")
    rows = rows.withColumn("idx", (F.row_number().over(Window.partitionBy("screen").orderBy(*order)) - 1).cast("bigint"))
    return rows.select(
        "screen",
        "idx",
        x.alias("x_min"),
        (x + F.col("l_quantity").cast("bigint") * 12).alias("x_max"),
        y.alias("y_min"),
        (y + (F.col("l_partkey") % 400)).alias("y_max"),
        (F.col("l_linenumber") % 5 != 0).alias("visible"),
        (F.col("l_returnflag") == "R").alias("clickable"),
        (F.col("l_returnflag") == "A").alias("editable"),
        (F.col("l_partkey") % 3 == 0).alias("focused"),
        (F.col("l_linestatus") == "F").alias("enabled"),
        F.when(F.col("l_suppkey") % 7 == 0, "com.android.systemui").when(F.col("l_suppkey") % 7 == 1, "x.inputmethod.y").when(F.col("l_suppkey") % 7 == 2, "").otherwise(F.concat(F.lit("app"), (F.col("l_partkey") % 4).cast("string"))).alias("package"),
    )


ELEMENTS = """elements AS (
  SELECT l_orderkey AS screen, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS idx,
    (l_partkey * 37) % 1000 AS x_min, (l_partkey * 37) % 1000 + CAST(l_quantity AS BIGINT) * 12 AS x_max,
    (l_suppkey * 91 + l_linenumber * 13) % 2300 AS y_min, (l_suppkey * 91 + l_linenumber * 13) % 2300 + l_partkey % 400 AS y_max,
    l_linenumber % 5 <> 0 AS visible, l_returnflag = 'R' AS clickable, l_returnflag = 'A' AS editable, l_partkey % 3 = 0 AS focused, l_linestatus = 'F' AS enabled,
    CASE WHEN l_suppkey % 7 = 0 THEN 'com.android.systemui' WHEN l_suppkey % 7 = 1 THEN 'x.inputmethod.y' WHEN l_suppkey % 7 = 2 THEN '' ELSE 'app' || (l_partkey % 4) END AS package
  FROM lineitem
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, key): leaf keys as doubles."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("key"))


def hierarchy(leaves: DataFrame, inter: int = 24, root: int = 6) -> DataFrame:
    """(id, inter_id, root_id): a fixed two-level assignment, for queries that both engines run."""
    return leaves.select("id", (F.col("id") % inter).alias("inter_id"), (F.col("id") % inter % root).alias("root_id"))


VECTORS = """vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS key FROM embeddings)"""
HIERARCHY = """edges AS (SELECT id, id % 24 AS inter_id, id % 24 % 6 AS root_id FROM vectors)"""
