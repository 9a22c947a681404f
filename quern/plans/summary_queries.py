"""Queries that sum rows up: question/key/value counters, action reports, value types, accuracy by layer, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import actions, episodes, retrieval, screens, stats, summary
from quern.plans.episode_queries import CONVERTED, QKV, _converted, _valid
from quern.plans.fixtures import STEPS, VECTORS, steps, table, vectors
from quern.plans.registry import query
from quern.plans.vector_queries import QUERIES, SCORES, _queries

#: Some descriptions hold no action, some are empty (then A stands in), some rows have no type.
MARKED = f"{QKV}, q AS (SELECT *, synthetic = 'no' AND step_index % 13 = 0 AS bad FROM u)"


def _acted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes.qkv_rows(_valid(spark, sf_dir))
    place, own = F.col("step_index") % 13, F.col("synthetic") == "no"
    said = F.when(own & (place == 0), "no action here").when(own & (place == 1), "").otherwise(F.col("description"))
    return summary.with_action(rows.withColumns({"description": said, "description_type": F.when(F.col("step_index") % 7 != 0, F.col("description_type"))}))


@query(
    f"""WITH {MARKED}, t AS (SELECT *, CASE WHEN bad THEN 'malformed' ELSE json_extract_string(action, '$.action_type') END AS kind FROM q)
SELECT 'rows' AS section, 'total' AS key, count(*) AS n FROM t UNION ALL SELECT 'episodes', 'total', count(DISTINCT episode_id) FROM t
UNION ALL SELECT 'description_type', CASE WHEN step_index % 7 <> 0 THEN 'next AndroidWorld action' ELSE 'missing' END, count(*) FROM t GROUP BY 2
UNION ALL SELECT 'action_type', kind, count(*) FROM t GROUP BY 2
UNION ALL SELECT 'status_goal', json_extract_string(action, '$.goal_status'), count(*) FROM t WHERE kind = 'status' GROUP BY 2
UNION ALL SELECT 'synthetic', CASE synthetic WHEN 'keyboard' THEN 'keyboard_enter_after_input_text' WHEN 'terminal' THEN 'terminal_complete' ELSE 'invalid_action_to_infeasible' END, count(*) FROM t WHERE synthetic <> 'no' OR invalid GROUP BY 2"""
)
def qkv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.qkv_summary(_acted(spark, sf_dir))


@query(f"WITH {MARKED} SELECT name, 'missing_action' AS error FROM q WHERE bad ORDER BY name LIMIT 20")
def malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.malformed_rows(_acted(spark, sf_dir))


@query(
    f"""WITH {STEPS}, l AS (SELECT episode_id AS ep, count(DISTINCT step_index) AS n FROM steps GROUP BY 1), e AS (SELECT round(avg(n), 3) AS avg, min(n) AS min, max(n) AS max FROM l)
SELECT *, (SELECT list(ep ORDER BY ep)[1:10] FROM l WHERE n = e.min) AS min_episodes, (SELECT list(ep ORDER BY ep)[1:10] FROM l WHERE n = e.max) AS max_episodes FROM e"""
)
def original_step_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_stats(summary.original_steps(_acted(spark, sf_dir)), "episode")


def _fields_sql(section: str, rows: str) -> str:
    names = "['action_type', 'index', 'x', 'y', 'text', 'direction', 'app_name', 'goal_status']"
    there = "[true, idx IS NOT NULL, x IS NOT NULL, y IS NOT NULL, text IS NOT NULL, direction IS NOT NULL, app_name IS NOT NULL, goal_status IS NOT NULL]"
    return f"SELECT '{section}', action_type, field, CASE WHEN field IN ('index', 'x', 'y') THEN 'int' ELSE 'str' END, count(*) FROM (SELECT action_type, unnest({names}) AS field, unnest({there}) AS there FROM {rows}) WHERE there GROUP BY ALL"


@query(
    f"""WITH {CONVERTED}, c AS (SELECT *, NULL AS x, NULL AS y FROM valid)
SELECT 'original_action_type' AS section, action_type AS key, NULL::VARCHAR AS field, NULL::VARCHAR AS type, count(*) AS n FROM steps GROUP BY 2
UNION ALL SELECT 'converted_action_type', action_type, NULL, NULL, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'validity', CASE WHEN invalid IS NULL THEN 'valid' ELSE 'invalid' END, NULL, NULL, count(*) FROM c GROUP BY 2
UNION ALL SELECT 'conversion_error', conversion_error, NULL, NULL, count(*) FROM c WHERE conversion_error IS NOT NULL GROUP BY 2
UNION ALL {_fields_sql("original_fields", "steps")} UNION ALL {_fields_sql("converted_fields", "c")}"""
)
def action_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw actions beside what they are converted to."""
    original = F.to_json(F.struct("action_type", F.col("idx").alias("index"), "x", "y", "text", "direction", "app_name", "goal_status"))
    raw = steps(spark, sf_dir).select("episode_id", "step_index", original.alias("original"))
    rows = _valid(spark, sf_dir).select("episode_id", "step_index", actions.action_json().alias("converted"), "conversion_error", F.col("invalid").alias("error"))
    return summary.action_report(raw.join(rows, ["episode_id", "step_index"]))


_MIXED = """SELECT event_type AS key, CASE event_id % 5 WHEN 0 THEN '{"a": 1, "b": 2.5, "c": [1]}' WHEN 1 THEN '{"a": "x", "b": true}' WHEN 2 THEN '{"a": null, "c": {"d": 1}}' WHEN 3 THEN 'broken {' ELSE props END AS j FROM events"""


@query(
    f"""WITH m AS ({_MIXED}), v AS (SELECT * FROM m WHERE json_valid(j)), f AS (SELECT key, j, unnest(json_keys(j)) AS field FROM v), t AS (SELECT key, field, json_type(j, '$.' || field) AS type FROM f)
SELECT key, field, CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN 'int' WHEN type = 'DOUBLE' THEN 'float' WHEN type = 'VARCHAR' THEN 'str' WHEN type = 'BOOLEAN' THEN 'bool' WHEN type = 'NULL' THEN 'null' WHEN type = 'ARRAY' THEN 'list' ELSE 'dict' END AS type, count(*) AS n FROM t GROUP BY ALL"""
)
def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of mixed value types beside the events' own."""
    place = F.col("event_id") % 5
    j = F.when(place == 0, '{"a": 1, "b": 2.5, "c": [1]}').when(place == 1, '{"a": "x", "b": true}').when(place == 2, '{"a": null, "c": {"d": 1}}').when(place == 3, "broken {").otherwise(F.col("props"))
    return stats.value_profile(table(spark, sf_dir, "events"), F.col("event_type"), j)


@query(f"WITH {STEPS} SELECT episode_id, step_index, coalesce(instruction, goal) AS goal FROM steps")
def goal_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("episode_id", "step_index", episodes.goal_of_step(by_instruction=True).alias("goal"))


@query(
    f"""WITH {CONVERTED} SELECT episode_id, step_index, CASE action_type WHEN 'open_app' THEN 'opening ' || app_name WHEN 'click' THEN 'tapping UI element ' || idx WHEN 'long_press' THEN 'long pressing UI element ' || idx
  WHEN 'input_text' THEN 'typing ' || text || ' into UI element ' || idx WHEN 'scroll' THEN CASE WHEN idx IS NOT NULL THEN 'scrolling ' || direction || ' on UI element ' || idx ELSE 'scrolling ' || direction END ELSE 'marking the task ' || goal_status END AS phrase FROM converted"""
)
def action_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir).select("episode_id", "step_index", actions.phrase().alias("phrase"))


#: Two layers of scores, in batches of 500 query ids.
LAYERED = f"{VECTORS}, {QUERIES}, {SCORES}, layered AS (SELECT query_id // 500 AS batch, query_id, id, unnest([score, score / 2 + id % 7 / 10.0]) AS score FROM scores)"


@query(
    f"""WITH {LAYERED}, s AS (SELECT batch, query_id, id, sum(score) AS total, avg(score) AS mean FROM layered GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) AS rank, max(mean) OVER (PARTITION BY query_id) AS top FROM s),
 p AS (SELECT batch, query_id, max(CASE WHEN id = query_id AND rank = 1 THEN 1.0 ELSE 0 END) AS a1, max(CASE WHEN id = query_id AND rank <= 5 THEN 1.0 ELSE 0 END) AS a5, max(exp(mean - top)) / sum(exp(mean - top)) AS c FROM r GROUP BY ALL),
 b AS (SELECT batch, avg(a1) AS a1, avg(a5) AS a5, max(c) AS c FROM p GROUP BY 1)
SELECT round(avg(a1), 6) AS acc1, round(avg(a5), 6) AS acc5, round(avg(c), 6) AS confidence FROM b"""
)
def layer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _queries(spark, sf_dir).withColumn("batch", F.floor(F.col("query_id") / 500))
    keys = vectors(spark, sf_dir).withColumn("biases", F.array(F.lit(0.0), F.col("id") % 7 / 10.0))
    found = retrieval.layered_accuracy(queries, keys, [1.0, 0.5], queries.select("query_id", F.col("query_id").alias("id")))
    return found.select(*[F.round(c, 6).alias(c) for c in ("acc1", "acc5", "confidence")])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SAID = ("'goal ' || conv_id", "CASE WHEN turn % 2 = 0 THEN text ELSE 'Not available' END", "'Not available'", "'{\"action_type\":\"wait\"}'", "text")
_CLOSING = 'Now output an action from the above list in the correct JSON format, following the reason why you do that. Your answer should look like:\nReason: ...\nAction: {"action_type":...}\n\nYour Answer:\n'


@query(
    f"""SELECT conv_id, turn, md5({" || ".join(f"{_quoted(part)} || {said}" for part, said in zip(screens.SUMMARY_PARTS, _SAID))} || {_quoted(screens.SUMMARY_RULES)}) AS summary_md5,
 md5({_quoted(chr(10) + "The current user goal/request is: ")} || 'goal ' || conv_id || {_quoted(chr(10) * 2 + "Here is a history of what you have done so far:" + chr(10))} || text || {_quoted(screens.LABELLED_LISTING)} || 'Not available'
  || CASE WHEN turn % 2 = 0 THEN {_quoted("For The Current Task:" + chr(10) + "- be quick" + chr(10))} ELSE '' END || {_quoted(chr(10) + _CLOSING)}) AS selection_md5 FROM conversations"""
)
def prompt_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts to sum a step up, and prompts that come with screenshots, some with guidelines of their own."""
    even, goal = F.col("turn") % 2 == 0, F.concat(F.lit("goal "), F.col("conv_id").cast("string"))
    told = screens.summary_prompt(goal, F.lit('{"action_type":"wait"}'), F.col("text"), F.when(even, F.col("text")).otherwise(""), F.lit(None).cast("string"))
    lines = F.when(even, F.array(F.lit("be quick"))).otherwise(F.array().cast("array<string>"))
    asked = screens.selection_prompt(goal, F.col("text"), F.lit(""), screenshots=True, guidelines=lines)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(told).alias("summary_md5"), F.md5(asked).alias("selection_md5"))
