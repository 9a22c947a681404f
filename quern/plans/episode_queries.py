"""Queries over recorded episodes: conversion, validation, histories, question/key/value rows, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.compat import written
from quern.operators import actions, episodes, sampling, screens, stats
from quern.plans.fixtures import STEPS, steps
from quern.plans.registry import query

def visible() -> Column:
    """Indices that every screen shows."""
    return F.sequence(F.lit(0), F.lit(59)).cast("array<bigint>")


CONVERTED = f"""{STEPS}, placed AS (
  SELECT *, action_type IN ('click', 'long_press') AS is_point, x IS NOT NULL AND y IS NOT NULL AS has_xy,
    coalesce(idx, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN CASE WHEN x % 20 = 0 THEN x // 10 END END) AS spot FROM steps
), judged AS (
  SELECT *, CASE
    WHEN is_point AND idx IS NULL AND NOT has_xy THEN action_type || ' requires index or both x and y.'
    WHEN is_point AND spot IS NULL THEN action_type || ' point (' || x || ', ' || y || ') did not map to a visible UI element.'
    WHEN action_type = 'input_text' AND text IS NULL THEN 'input_text requires text.'
    WHEN action_type = 'input_text' AND spot IS NULL THEN 'input_text could not find a visible editable UI element index.'
    WHEN action_type = 'scroll' AND NOT coalesce(direction IN ('up', 'down', 'left', 'right'), false) THEN 'scroll requires direction in up/down/left/right.'
    WHEN action_type = 'open_app' AND trim(coalesce(app_name, '')) = '' THEN 'open_app requires a non-empty app_name.'
    WHEN action_type = 'status' AND NOT coalesce(goal_status IN ('complete', 'infeasible'), false) THEN 'status requires goal_status complete or infeasible.'
    WHEN action_type = 'swipe' THEN 'Unsupported action_type: ''swipe''.' END AS conversion_error FROM placed
), converted AS (
  SELECT episode_id, step_index, k, goal, ui, instruction, conversion_error, CASE WHEN conversion_error IS NULL THEN action_type ELSE 'status' END AS action_type,
    CASE WHEN conversion_error IS NULL AND (is_point OR action_type = 'input_text') THEN spot WHEN conversion_error IS NULL AND action_type = 'scroll' THEN idx END AS idx,
    CASE WHEN conversion_error IS NULL AND action_type = 'input_text' THEN text END AS text,
    CASE WHEN conversion_error IS NULL AND action_type = 'scroll' THEN direction END AS direction,
    CASE WHEN conversion_error IS NULL AND action_type = 'open_app' THEN app_name END AS app_name,
    CASE WHEN conversion_error IS NOT NULL THEN 'infeasible' WHEN action_type = 'status' THEN goal_status END AS goal_status FROM judged
), valid AS (
  SELECT *, CASE WHEN action_type IN ('click', 'long_press', 'input_text', 'scroll') AND idx IS NOT NULL AND NOT (idx BETWEEN 0 AND 59) THEN 'index_out_of_range' END AS invalid FROM converted
), jsons AS (
  SELECT *, '{{"action_type":"' || action_type || '"' || coalesce(',"index":' || idx, '') || coalesce(',"text":"' || text || '"', '') || coalesce(',"direction":"' || direction || '"', '')
    || coalesce(',"app_name":"' || app_name || '"', '') || coalesce(',"goal_status":"' || goal_status || '"', '') || '}}' AS action,
    '{{"action_type": "' || action_type || '"' || coalesce(', "app_name": "' || app_name || '"', '') || coalesce(', "direction": "' || direction || '"', '') || coalesce(', "goal_status": "' || goal_status || '"', '')
    || coalesce(', "index": ' || idx, '') || coalesce(', "text": "' || text || '"', '') || '}}' AS told_action FROM valid
)"""


def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.when(F.col("x") % 20 == 0, F.floor(F.col("x") / 10))
    return actions.convert(steps(spark, sf_dir), point)


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _converted(spark, sf_dir).withColumns({"x": F.lit(None).cast("bigint"), "y": F.lit(None).cast("bigint")})
    return rows.withColumn("invalid", actions.error_code(visible(), index_only=True)).drop("x", "y")


@query(f"WITH {STEPS} SELECT episode_id, step_index, action_type, lag(instruction) OVER (PARTITION BY episode_id ORDER BY step_index) AS previous, lead(action_type) OVER (PARTITION BY episode_id ORDER BY step_index) AS following FROM steps")
def episode_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps(spark, sf_dir).select("episode_id", "step_index", "action_type", F.lag("instruction").over(episodes.by_step()).alias("previous"), F.lead("action_type").over(episodes.by_step()).alias("following"))


@query(f"WITH {CONVERTED} SELECT episode_id, step_index, action_type, idx, text, direction, app_name, goal_status, conversion_error FROM converted")
def action_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(spark, sf_dir).select("episode_id", "step_index", "action_type", "idx", "text", "direction", "app_name", "goal_status", "conversion_error")


RAW_CODE = """CASE WHEN action_type = 'swipe' THEN 'unsupported_action_type'
  WHEN action_type IN ('click', 'long_press') AND idx IS NOT NULL AND (x IS NOT NULL OR y IS NOT NULL) THEN 'conflicting_action_fields'
  WHEN action_type IN ('click', 'long_press') AND idx IS NULL AND (x IS NULL OR y IS NULL) OR action_type = 'open_app' AND app_name IS NULL THEN 'missing_action_field'
  WHEN action_type = 'scroll' AND direction = 'away' OR action_type = 'status' AND goal_status = 'unknown' THEN 'invalid_action_enum'
  WHEN idx > 59 THEN 'index_out_of_range' WHEN action_type IN ('click', 'long_press') AND idx IS NULL THEN 'missing_index_action' END"""


@query(f"WITH {STEPS} SELECT episode_id, step_index, {RAW_CODE} AS code FROM steps")
def action_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw actions as they are, against the same rules."""
    return steps(spark, sf_dir).select("episode_id", "step_index", actions.error_code(visible(), index_only=True).alias("code"))


LINES = """lines AS (SELECT *, 'Step ' || (step_index + 1) || ': Action selected: ' || told_action || '.' || coalesce(' Instruction: ' || instruction || '.', '') AS line FROM jsons),
histories AS (SELECT *, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'You just started, no action has been performed yet.') AS history FROM lines)"""


@query(f"WITH {CONVERTED}, {LINES} SELECT episode_id, step_index, md5(history) AS history_md5, length(history) AS chars FROM histories")
def episode_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes.with_history(_valid(spark, sf_dir))
    text = episodes.history_text(F.col("history"))
    return rows.select("episode_id", "step_index", F.md5(text).alias("history_md5"), F.length(text).cast("bigint").alias("chars"))


@query(f"WITH {CONVERTED}, {LINES}, t AS (SELECT *, CASE WHEN step_index % 4 = 1 THEN 'told by the teacher' END AS teacher FROM jsons) SELECT episode_id, step_index, 'Step ' || (step_index + 1) || ': ' || coalesce(teacher, 'Action selected: ' || told_action || '.' || coalesce(' Instruction: ' || instruction || '.', '')) AS step_line FROM t")
def history_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valid(spark, sf_dir)
    teacher = rows.filter("step_index % 4 = 1").select("episode_id", "step_index", F.lit("told by the teacher").alias("line"))
    return episodes.with_history(rows, teacher).select("episode_id", "step_index", "step_line")


PAST = """CASE action_type WHEN 'open_app' THEN 'opened ' || app_name WHEN 'click' THEN 'clicked UI element ' || idx WHEN 'long_press' THEN 'long pressed UI element ' || idx
  WHEN 'input_text' THEN 'typed text into UI element ' || idx WHEN 'scroll' THEN 'scrolled ' || direction ELSE 'marked the goal ' || goal_status END"""
_CUT = "CASE WHEN length({0}) <= {1} THEN {0} ELSE rtrim(left({0}, {1} - 1), ' .,;') || '...' END"


def _compact_sql(lines: str, shorts: str) -> str:
    """The compact history of a list of lines, by the lines' numbers and lists; the reference's rule, spelled out."""
    n = f"len({lines})"
    parts = f"array_to_string(CASE WHEN {n} > 10 THEN list_concat({shorts}[1:3], ['...'], {shorts}[{n} - 6:{n} - 5]) ELSE {shorts}[1:{n} - 5] END, '; ')"
    cut = _CUT.format(f"trim({parts}, ' .')", 360)
    return f"CASE WHEN {n} = 0 THEN 'You just started, no action has been performed yet.' WHEN {n} <= 5 THEN array_to_string({lines}, chr(10)) ELSE 'Earlier steps 1-' || ({n} - 5) || ': ' || {cut} || '.' || chr(10) || array_to_string({lines}[{n} - 4:{n}], chr(10)) END"


HISTORIES = f"""{CONVERTED}, {LINES}, told AS (SELECT *, trim(coalesce(instruction, {PAST}), ' .') AS t FROM lines), short AS (SELECT *, {_CUT.format("t", 80)} AS s FROM told),
 listed AS (SELECT *, coalesce(list(line) OVER w, []) AS ls, coalesce(list(s) OVER w, []) AS ss FROM short WINDOW w AS (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {HISTORIES} SELECT episode_id, step_index, {_compact_sql('ls', 'ss')} AS compact FROM listed")
def history_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.with_compact_history(episodes.with_lines(_valid(spark, sf_dir))).select("episode_id", "step_index", "compact")


def _reason(kind: str) -> str:
    return f"""CASE {kind} WHEN 'open_app' THEN 'The task requires ' || app_name || ', so I should open that app.'
  WHEN 'click' THEN 'The next step is to select the relevant visible UI element at index ' || idx || '.'
  WHEN 'long_press' THEN 'The next step requires a long press on the relevant visible UI element at index ' || idx || '.'
  WHEN 'input_text' THEN 'The target text field at index ' || idx || ' needs ' || text || ', so I should enter it there.'
  WHEN 'scroll' THEN 'The needed item is not visible yet, so I should scroll ' || direction || '.'
  ELSE CASE WHEN goal_status = 'complete' THEN 'The recorded episode has reached its final state, so the task is complete.'
    WHEN conversion_error IS NOT NULL THEN 'The recorded target action could not be converted into a valid AndroidWorld action because ' || conversion_error
    ELSE 'The required action cannot be safely performed from this state.' END END"""


#: The fixture's sixteen verbs while they are done and once they are, by the rules for verb forms.
DOING = "['opening', 'tapping', 'making', 'dying', 'agreeing', 'stopping', 'searching', 'fixing', 'sending', 'long pressing', 'long pressing', 'saving', 'setting', 'running', '42 times check', 'visitting']"
DONE = "['having opened', 'having tapped', 'having made', 'having died', 'having agreed', 'having stopped', 'having searched', 'having fixed', 'having sent', 'having long pressed', 'having long pressed', 'having saved', 'having set', 'having run', 'having completed 42 times check', 'having visited']"


def _key_sql(k: str, goal: str, done: str) -> str:
    """k: number of the instruction's item, null without one."""
    task = f"coalesce({DOING}[{k} % 16 + 1] || ' the item ' || {k}, 'finishing' || rtrim(substr({goal}, 7), '.'), 'thing current task')"
    return f"'For the AndroidWorld goal of ' || {task} || ', after ' || {done} || ', the current screen shows the visible UI elements, and the next action should be'"


def _question_sql(goal: str, history: str, ui: str) -> str:
    suffix = f"{screens.ALLOWED_ACTIONS}\n\n{screens.ANSWER_FORMAT}"
    return f"""'What is the next AndroidWorld action?\n\nThe current AndroidWorld user goal is: ' || coalesce({goal}, 'Unknown goal.') || '\nHistory: ' || {history} || '\nThe visible UI elements are:\n' || coalesce({ui}, 'No UI element details were found.') || '\n\n{suffix}'"""


_DONE = f"{DONE}[{{0}} % 16 + 1] || ' the item ' || {{0}}"

#: The rows of every step as u (episode_id, step_index, synthetic, invalid, name, reason, action, q, key_string).
QKV = f"""{HISTORIES}, c AS (SELECT *, {_compact_sql("ls", "ss")} AS compact, {_compact_sql("list_append(ls, own)", "list_append(ss, s)")} AS after, {_reason("action_type")} AS reason,
   CASE WHEN instruction IS NOT NULL THEN k END AS ik FROM (SELECT *, 'Step ' || (step_index + 1) || ': Action selected: ' || action || '.' || coalesce(' Instruction: ' || instruction || '.', '') AS own FROM listed)),
 r AS (SELECT *, lead(step_index) OVER w IS NULL AS last, lead(compact) OVER w AS next_compact, lead(goal) OVER w AS next_goal, lead(ui) OVER w AS next_ui,
   last_value(ik IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM c WINDOW w AS (PARTITION BY episode_id ORDER BY step_index)),
 base AS (SELECT episode_id, step_index, 'no' AS synthetic, invalid IS NOT NULL AS invalid,
   'aw_' || episode_id || '_' || step_index || '_' || action_type || CASE WHEN invalid IS NOT NULL THEN '_infeasible' ELSE '' END AS name,
   CASE WHEN invalid IS NULL THEN reason ELSE 'The recorded target action could not be converted into a valid index-based AndroidWorld action, so the task should be marked infeasible.' END AS reason,
   CASE WHEN invalid IS NULL THEN action ELSE '{{"action_type":"status","goal_status":"infeasible"}}' END AS action, {_question_sql("goal", "compact", "ui")} AS q,
   {_key_sql("ik", "goal", f"coalesce({_DONE.format('prior')}, CASE WHEN step_index = 0 THEN 'no previous actions' ELSE 'previous recorded actions' END)")} AS key_string FROM r),
 typed AS (SELECT episode_id, step_index, 'keyboard', false, 'aw_' || episode_id || '_' || step_index || '_keyboard_enter_keyboard_enter_after_input_text', 'The text has been entered, so I should press Enter to submit it.', '{{"action_type":"keyboard_enter"}}',
   {_question_sql("CASE WHEN last THEN goal ELSE next_goal END", "CASE WHEN last THEN after ELSE next_compact END", "CASE WHEN last THEN ui ELSE next_ui END")},
   {_key_sql("ik", "goal", f"coalesce({_DONE.format('coalesce(ik, prior)')}, 'previous recorded actions')")} FROM r WHERE action_type = 'input_text' AND invalid IS NULL),
 done AS (SELECT episode_id, step_index, 'terminal', false, 'aw_' || episode_id || '_' || step_index || '_terminal_complete_status_complete', 'The recorded episode has reached its final state, so the task is complete.', '{{"action_type":"status","goal_status":"complete"}}',
   {_question_sql("goal", "after", "ui")}, {_key_sql("ik", "goal", f"coalesce({_DONE.format('coalesce(ik, prior)')}, 'previous recorded actions')")} FROM r WHERE last),
 u AS (SELECT * FROM base UNION ALL SELECT * FROM typed UNION ALL SELECT * FROM done)"""


@query(
    f"""WITH {QKV}
SELECT name, synthetic, invalid, reason, 'Reason: ' || reason || chr(10) || 'Action: ' || action AS description, 'Reason: ' || reason || chr(10) || 'Action: ' || action AS a, md5(q) AS q_md5, key_string FROM u"""
)
def episode_qkv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = episodes.qkv_rows(_valid(spark, sf_dir))
    return rows.select("name", "synthetic", F.expr("invalid and synthetic = 'no'").alias("invalid"), "reason", "description", F.col("A").alias("a"), F.md5("Q").alias("q_md5"), "key_string")


@query(
    f"""WITH {CONVERTED}, l AS (SELECT *, lead(step_index) OVER (PARTITION BY episode_id ORDER BY step_index) IS NULL AS last FROM valid)
SELECT count(*) + count(*) FILTER (WHERE action_type = 'input_text' AND invalid IS NULL) + count(*) FILTER (WHERE last) AS qkv_rows, count(*) AS prompt_rows,
  count(*) FILTER (WHERE action_type = 'input_text' AND invalid IS NULL) AS keyboard_enter_rows, count(*) FILTER (WHERE last) AS terminal_rows, count(*) FILTER (WHERE invalid IS NOT NULL) AS invalid_actions,
  count(*) FILTER (WHERE conversion_error IS NOT NULL) AS conversion_error_rows, count(DISTINCT episode_id) AS episodes FROM l"""
)
def qkv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.qkv_counts(episodes.qkv_rows(_valid(spark, sf_dir)))


@query(f"WITH {CONVERTED} SELECT action_type AS key, count(*) AS n FROM converted GROUP BY 1")
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counted(_converted(spark, sf_dir), "action_type")


@query(
    f"""WITH {STEPS}, l AS (SELECT episode_id AS ep, count(*) AS n FROM steps GROUP BY 1), e AS (SELECT round(avg(n), 3) AS avg, min(n) AS min, max(n) AS max FROM l)
SELECT *, (SELECT list(ep ORDER BY ep)[1:10] FROM l WHERE n = e.min) AS min_episodes, (SELECT list(ep ORDER BY ep)[1:10] FROM l WHERE n = e.max) AS max_episodes FROM e"""
)
def episode_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_stats(steps(spark, sf_dir), "episode_id")


@query(
    f"""WITH {STEPS}, f AS (SELECT action_type, unnest(['idx', 'x', 'y', 'text', 'direction', 'app_name', 'goal_status']) AS field,
  unnest([idx IS NOT NULL, x IS NOT NULL, y IS NOT NULL, text IS NOT NULL, direction IS NOT NULL, app_name IS NOT NULL, goal_status IS NOT NULL]) AS there FROM steps)
SELECT action_type, field, CASE WHEN field IN ('idx', 'x', 'y') THEN 'int' ELSE 'str' END AS type, count(*) AS n FROM f WHERE there GROUP BY ALL"""
)
def action_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.field_profile(steps(spark, sf_dir), "action_type", list(actions.ARGUMENTS))


@query(f"WITH {STEPS}, r AS (SELECT action_type, episode_id, step_index, row_number() OVER (PARTITION BY action_type ORDER BY episode_id, step_index) AS example FROM steps) SELECT action_type, episode_id, step_index, CAST(example AS INTEGER) AS example FROM r WHERE example <= 3")
def action_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.examples(steps(spark, sf_dir).select("action_type", "episode_id", "step_index"), "action_type", ["episode_id", "step_index"])


BUCKETS = f"""{CONVERTED}, buckets AS (SELECT episode_id || '/' || step_index AS id, episode_id AS episode, CASE WHEN action_type = 'status' THEN 'status_' || goal_status ELSE action_type END AS bucket FROM converted),
caps AS (SELECT bucket, count(*) AS capacity FROM buckets GROUP BY 1)"""
_SIZE, _RARE = 200, 20
QUOTAS = f"""kept AS (SELECT coalesce(sum(capacity) FILTER (WHERE capacity <= {_RARE}), 0) AS k FROM caps), marked AS (SELECT caps.*, k, capacity <= {_RARE} AND k <= {_SIZE} AS whole, CASE WHEN k > {_SIZE} THEN {_SIZE} ELSE {_SIZE} - k END AS t FROM caps, kept),
shares AS (SELECT *, sum(capacity) OVER () AS total, t * capacity // sum(capacity) OVER () AS fl, t * capacity % sum(capacity) OVER () AS rest FROM marked WHERE NOT whole),
large AS (SELECT bucket, capacity, CASE WHEN t >= total THEN capacity ELSE fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, bucket DESC) <= t - sum(fl) OVER () THEN 1 ELSE 0 END END AS quota FROM shares),
quotas AS (SELECT bucket, capacity, capacity AS quota FROM marked WHERE whole UNION ALL SELECT bucket, capacity, CAST(quota AS BIGINT) FROM large)"""


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("action_type") == "status", F.concat(F.lit("status_"), F.col("goal_status"))).otherwise(F.col("action_type"))
    return _converted(spark, sf_dir).select(F.concat_ws("/", "episode_id", F.col("step_index").cast("string")).alias("id"), F.col("episode_id").alias("episode"), bucket.alias("bucket"))


@query(f"WITH {BUCKETS}, {QUOTAS} SELECT bucket, capacity, CAST(quota AS BIGINT) AS quota FROM quotas")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quotas(_buckets(spark, sf_dir).groupBy("bucket").agg(F.count("*").alias("capacity")), _SIZE, _RARE)


@query(
    f"""WITH {BUCKETS}, {QUOTAS}, turns AS (SELECT b.*, quota, row_number() OVER (PARTITION BY b.bucket, episode ORDER BY md5('1607|' || id), id) AS pass FROM buckets b JOIN quotas USING (bucket)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY pass, md5('1607|' || episode), episode) AS r FROM turns)
SELECT id, episode, bucket FROM ranked WHERE r <= quota"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(_buckets(spark, sf_dir), "buckets")
    return sampling.stratified(rows, _SIZE, _RARE).select("id", "episode", "bucket")


@query(f"WITH {BUCKETS}, {QUOTAS} SELECT bucket, capacity AS before, CAST(quota AS BIGINT) AS after FROM quotas")
def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(_buckets(spark, sf_dir), "buckets")
    return sampling.sampled_counts(rows, sampling.stratified(rows, _SIZE, _RARE))


@query(
    f"""WITH {CONVERTED}, n AS (SELECT 'aw_' || episode_id || '_' || step_index || '_' || action_type AS name FROM converted UNION ALL SELECT 'other ' || k FROM converted)
SELECT name, CASE WHEN regexp_matches(name, '^aw_(.*)_([0-9]+)(?:_(.*))?$') THEN coalesce(nullif(regexp_extract(name, '^aw_(.*)_([0-9]+)(?:_(.*))?$', 1), ''), 'unknown') ELSE 'unknown' END AS episode,
  TRY_CAST(nullif(regexp_extract(name, '^aw_(.*)_([0-9]+)(?:_(.*))?$', 2), '') AS BIGINT) AS step, regexp_extract(name, '^aw_(.*)_([0-9]+)(?:_(.*))?$', 3) AS suffix FROM n"""
)
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _converted(spark, sf_dir)
    names = rows.select(F.concat_ws("_", F.lit("aw"), "episode_id", F.col("step_index").cast("string"), "action_type").alias("name")).unionByName(rows.select(F.concat(F.lit("other "), F.col("k").cast("string")).alias("name")))
    return names.select("name", F.inline(F.array(episodes.parsed_name(F.col("name")))))
