"""Queries over texts and chats: cleaning, verb forms, sections, prompts, usage, overlap, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.compat import WS_SQL
from quern.functions import text as t
from quern.operators import chat, evaluation, outputs, screens, stats
from quern.plans.fixtures import VERBS, table
from quern.plans.registry import query


def _clean(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS_SQL}', ' ', 'g'))"


@query(
    f"""WITH d AS (SELECT doc_id, text, {_clean("text")} AS c FROM documents), i AS (SELECT *, trim(c, ' .') AS s FROM d)
SELECT doc_id, md5(c) AS clean_md5, md5(CASE WHEN lower(left(s, 3)) = 'to ' THEN trim(substr(s, 4)) ELSE s END) AS instruction_md5,
  md5(coalesce(nullif(trim(regexp_replace(c, '[^0-9A-Za-z_]+', '_', 'g'), '_'), ''), 'row')) AS name_md5,
  CASE WHEN length(s) <= 80 THEN s ELSE rtrim(left(s, 79), ' .,;') || '...' END AS short, md5(CASE WHEN s = '' THEN '' ELSE s || '.' END) AS sentence_md5,
  len(list_filter(regexp_split_to_array(text, '{WS_SQL}'), lambda p: p <> '')) AS tokens, length(text) AS chars FROM i"""
)
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")  # cleaning what is clean changes nothing, so the rest starts from the collapsed text
    return table(spark, sf_dir, "documents").withColumn("c", t.collapse(F.col("text"))).select(
        "doc_id", F.md5(c).alias("clean_md5"), F.md5(t.clean_instruction(c)).alias("instruction_md5"), F.md5(t.safe_name(c)).alias("name_md5"), t.truncate(c, 80).alias("short"),
        F.md5(t.sentence(c)).alias("sentence_md5"), t.token_count(c).alias("tokens"), t.char_count(F.col("text")).alias("chars"),
    )


def _lookup(table_: dict[str, str], v: str) -> str:
    return f"CASE {v} " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in table_.items()) + " END"


_DOUBLES = "(length({0}) >= 3 AND NOT contains('aeiouwxy', {0}[-1]) AND contains('aeiou', {0}[-2]) AND NOT contains('aeiou', {0}[-3]))"
_GERUND = f"""CASE WHEN v LIKE '%ing' THEN v ELSE coalesce({_lookup(t.GERUNDS, "v")}, CASE WHEN v LIKE '%ie' THEN regexp_replace(v, 'ie$', 'ying')
  WHEN v LIKE '%e' AND NOT regexp_matches(v, '[eoy]e$') THEN regexp_replace(v, 'e$', 'ing') WHEN {_DOUBLES.format("v")} THEN v || right(v, 1) || 'ing' ELSE v || 'ing' END) END"""
_BASE = """CASE WHEN NOT v LIKE '%ing' OR length(v) <= 4 THEN v WHEN v LIKE '%ying' THEN regexp_replace(v, 'ying$', 'ie')
  WHEN length(stem) >= 3 AND right(stem, 1) = substr(stem, length(stem) - 1, 1) AND NOT regexp_matches(stem, '[aeiou]$') AND regexp_matches(substr(stem, length(stem) - 2, 1), '[aeiou]') THEN left(stem, length(stem) - 1)
  WHEN regexp_matches(stem, '(ak|av|az|os|ov|yp|rit)$') THEN stem || 'e' ELSE stem END"""


def _participle(b: str) -> str:
    return f"coalesce({_lookup(t.PARTICIPLES, b)}, CASE WHEN {b} LIKE '%e' THEN {b} || 'd' WHEN {_DOUBLES.format(b)} THEN {b} || right({b}, 1) || 'ed' ELSE {b} || 'ed' END)"


WORDS = "words AS (SELECT DISTINCT lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) AS v FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) UNION SELECT unnest(" + repr(sorted({w.lower() for v in VERBS for w in v.split() if w.isalpha()})) + ")), verbs AS (SELECT v, regexp_replace(v, 'ing$', '') AS stem FROM words WHERE v <> '')"


@query(f"WITH {WORDS}, b AS (SELECT *, {_BASE} AS base FROM verbs) SELECT v, {_GERUND} AS gerund, base, CASE WHEN v LIKE '%ing' THEN coalesce({_lookup(t.GERUND_PARTICIPLES, 'v')}, {_participle('base')}) ELSE {_participle('v')} END AS participle FROM b")
def verb_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).select(F.lower(F.regexp_replace("w", "[^A-Za-z]", "")).alias("v"))
    more = spark.range(1).select(F.explode(F.array(*[F.lit(w.lower()) for v in VERBS for w in v.split() if w.isalpha()])).alias("v"))
    v = F.col("v")
    return words.union(more).distinct().filter("v <> ''").select("v", t.gerund(v).alias("gerund"), t.base_of_gerund(v).alias("base"), t.past_participle(v).alias("participle"))


@query()
def goal_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goal and completed-goal phrases of every conversation turn; tests compare with a loop."""
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.goal_phrase(c).alias("goal"), t.completed_goal_phrase(c).alias("done"))


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN md5(CAST(event_id AS VARCHAR)) WHEN 1 THEN 'item-' || event_id || '-abcdefghijklmnopq' WHEN 2 THEN props WHEN 3 THEN substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || '-' || substr(md5(props), 1, 4) ELSE event_type END AS s FROM events)
SELECT event_id, s, regexp_matches(lower(trim(s)), '^([0-9a-f]{12,}|[0-9a-f]{8,}([-_][0-9a-f]{4,})+)([-_][0-9]{6,})?$') OR (length(s) >= 20 AND regexp_matches(s, '[0-9]') AND contains(s, '-') AND NOT regexp_matches(s, '\\s')) AS machine FROM e"""
)
def machine_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, k = F.col("event_id").cast("string"), F.col("event_id") % 5
    s = F.when(k == 0, F.md5(i)).when(k == 1, F.concat(F.lit("item-"), i, F.lit("-abcdefghijklmnopq"))).when(k == 2, F.col("props")).when(k == 3, F.concat_ws("-", F.substring(F.md5(i), 1, 8), F.substring(F.md5("props"), 1, 4))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).withColumn("machine", t.is_machine_id(F.col("s")))


@query(
    f"""WITH c AS (SELECT doc_id, {_clean("text")} AS c FROM documents)
SELECT doc_id, CASE WHEN c = '' OR length(c) >= 20 AND regexp_matches(c, '[0-9]') AND contains(c, '-') AND NOT contains(c, ' ') THEN NULL WHEN length(c) > 96 THEN rtrim(left(c, 95), ' .,;') || '...' ELSE c END AS compact FROM c"""
)
def compact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.compact_text(F.col("text")).alias("compact"))


QUESTION = "CASE WHEN turn % 5 = 4 THEN text ELSE 'The current AndroidWorld user goal is: ' || role || ' goal' || chr(10) || 'History: ' || text || chr(10) || 'The visible UI elements are:' || chr(10) || 'UI element ' || turn || ': x' || CASE WHEN turn % 2 = 0 THEN chr(10) || chr(10) || 'Please answer in exactly this format:' || chr(10) || 'Reason' ELSE '' END END"


@query(
    f"""WITH q AS (SELECT conv_id, turn, role, text, {QUESTION} AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN role || ' goal' END AS goal, CASE WHEN turn % 5 <> 4 THEN md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END AS history_md5,
  CASE WHEN turn % 5 <> 4 THEN 'UI element ' || turn || ': x' END AS ui_elements, CASE WHEN turn % 5 <> 4 THEN CASE WHEN turn % 2 = 0 THEN 'Please answer in exactly this format:' || chr(10) || 'Reason' ELSE '' END END AS suffix FROM q"""
)
def section_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.expr(QUESTION.replace("||", "||").replace("chr(10)", "'\\n'"))
    rows = table(spark, sf_dir, "conversations").withColumn("q", q).withColumn("s", t.q_sections(F.col("q")))
    return rows.select("conv_id", "turn", "s.goal", F.md5("s.history").alias("history_md5"), "s.ui_elements", "s.suffix")


PROMPT = "CASE turn % 4 WHEN 0 THEN 'Summary of this step: This is the action you picked: x. Based on the reason: ' || text WHEN 1 THEN 'Now output an action from the above list, action_type; your answer should look like: ' || text WHEN 2 THEN 'AndroidWorld: action_type of the next AndroidWorld action ' || text ELSE text END"


@query(f"WITH p AS (SELECT conv_id, turn, {PROMPT} AS prompt FROM conversations) SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'summarization' WHEN 3 THEN 'other' ELSE 'action_selection' END AS kind FROM p")
def prompt_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("prompt", F.expr(PROMPT)).select("conv_id", "turn", chat.prompt_kind(F.col("prompt")).alias("kind"))


@query("SELECT conv_id, string_agg(upper(role) || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS prompt, string_agg(upper(left(role, 1)) || substr(role, 2) || ': ' || text, chr(10) ORDER BY turn) || chr(10) || 'Assistant:' AS labelled FROM conversations GROUP BY conv_id")
def chat_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.flattened(turns).join(chat.flattened(turns, True).withColumnRenamed("prompt", "labelled"), "conv_id")


@query(
    f"""WITH p AS (SELECT conv_id, turn, {PROMPT} AS prompt, CASE WHEN turn % 5 <> 0 THEN 100 + turn * 40 END AS m FROM conversations)
SELECT conv_id, turn, md5(CASE WHEN turn % 4 IN (1, 2) THEN 'What is the next AndroidWorld action?' ELSE prompt END) AS prompt_md5, CASE WHEN turn % 4 IN (1, 2) THEN least(coalesce(m, 128), 128) ELSE m END AS max_tokens,
  CASE WHEN turn % 3 = 0 THEN 'img' || turn END AS image FROM p"""
)
def payload_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one message, a third of them with an image."""
    none = F.lit(None).cast("string")
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("url"))
    image = part("image_url", none, F.concat(F.lit("img"), F.col("turn").cast("string")))
    parts = F.array_compact(F.array(part("text", F.expr(PROMPT), none), F.when(F.col("turn") % 3 == 0, image)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts"))).alias("messages"), F.when(F.col("turn") % 5 != 0, 100 + F.col("turn") * 40).alias("max_tokens"))
    out = chat.rewritten(rows, lambda text: F.lit("What is the next AndroidWorld action?"))
    first = F.col("messages")[0]["parts"]
    return out.select("conv_id", "turn", F.md5(first[0]["text"]).alias("prompt_md5"), "max_tokens", F.try_element_at(first, F.lit(2))["url"].alias("image"))


REQUEST = "CASE event_id % 3 WHEN 0 THEN 'Now output an action from the above list, action_type; your answer should look like: UI element 1: a UI element ' || event_id || ': b' WHEN 1 THEN 'Summary of this step: This is the action you picked: x. Based on the reason: y' ELSE event_type END"
ANSWER = """CASE event_id % 9 WHEN 0 THEN 'Reason: tap  it' || chr(10) || 'Action: {"action_type":"click","index":"' || event_id || '"}' WHEN 3 THEN 'Action: {"action_type":"click","index":' || (event_id + 1) || '}' WHEN 6 THEN 'Action: {"action_type":"fly"}'
  WHEN 1 THEN 'Summary: it  went ' || event_type WHEN 4 THEN 'Action: x' WHEN 7 THEN '' ELSE 'kept  as it is' END"""


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'action_selection' WHEN 1 THEN 'summarization' ELSE 'other' END AS kind,
  CASE event_id % 9 WHEN 0 THEN 'Reason: tap it' || chr(10) || 'Action: {"action_type":"click","index":' || event_id || '}' WHEN 1 THEN 'it went ' || event_type WHEN 2 THEN 'kept  as it is' WHEN 5 THEN 'kept  as it is' WHEN 8 THEN 'kept  as it is' END AS content,
  CASE event_id % 9 WHEN 3 THEN 'index_out_of_range' WHEN 6 THEN 'unsupported_action_type' WHEN 4 THEN 'invalid_summary_output' WHEN 7 THEN 'empty_summary_output' END AS error FROM events"""
)
def output_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs as their requests want them; an action must stand on the request's own screen."""
    line = lambda sql: F.expr(sql.replace("chr(10)", "'\\n'"))
    rows = table(spark, sf_dir, "events").select("event_id", line(REQUEST).alias("prompt"), line(ANSWER).alias("raw"))
    return outputs.with_processed(rows, "prompt", "raw").select("event_id", "processed.kind", "processed.content", "processed.error")


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Thought: see it' || chr(10) || 'Action: {"a": ' || event_id || '}' WHEN 1 THEN 'Thought:' || chr(10) || 'Action: {"a": [1, 2]}' ELSE 'no step in ' || event_type END AS step FROM events"""
)
def single_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = """CASE event_id % 3 WHEN 0 THEN 'Reason: see it' || '\\n' || 'Action: {"a":' || event_id || '} and Action: {"b":1}' WHEN 1 THEN ' Action: {"a":[1,2]}' ELSE 'no step in ' || event_type END"""
    return outputs.with_single_step(table(spark, sf_dir, "events").select("event_id", F.expr(raw).alias("raw")), "raw").select("event_id", "step")


def _count(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{WS_SQL}'), lambda p: p <> ''))"


@query(
    f"""WITH u AS (SELECT role AS model, CASE WHEN turn % 3 <> 2 THEN {_count("text")} END AS p, length(text) AS c FROM conversations),
 s AS (SELECT model, count(*) AS calls, coalesce(sum(p), 0)::BIGINT AS prompt_tokens, coalesce(sum(c), 0)::BIGINT AS completion_tokens FROM u GROUP BY model)
SELECT *, prompt_tokens + completion_tokens AS total_tokens, CASE model WHEN 'user' THEN round((prompt_tokens * 2.5::DOUBLE + completion_tokens * 10.0::DOUBLE) / 1e6, 6) WHEN 'assistant' THEN round((prompt_tokens * 0.5::DOUBLE + completion_tokens * 1.5::DOUBLE) / 1e6, 6) END AS cost_usd FROM s"""
)
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return stats.usage(rows, "role", F.when(F.col("turn") % 3 != 2, t.token_count(F.col("text"))), t.char_count(F.col("text")), {"user": (2.5, 10.0), "assistant": (0.5, 1.5)})


def _grams(c: str, n: int) -> str:
    words = f"list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
    return words if n == 1 else f"list_transform(list_zip({words}[:-2], {words}[2:]), lambda z: z[1] || ' ' || z[2])"


def _rouge_sql(n: int) -> str:
    return f"""WITH pairs AS (SELECT a.conv_id * 1000 + a.turn AS id, a.text AS predicted, b.text AS truth FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
 p AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest({_grams("predicted", n)}) AS g FROM pairs) GROUP BY ALL), t AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest({_grams("truth", n)}) AS g FROM pairs) GROUP BY ALL),
 s AS (SELECT id, sum(least(coalesce(p.n, 0), coalesce(t.n, 0))) AS o, sum(coalesce(p.n, 0)) AS pn, sum(coalesce(t.n, 0)) AS tn FROM p FULL JOIN t USING (id, g) GROUP BY id),
 r AS (SELECT pairs.id, coalesce(o, 0)::BIGINT AS overlap, CASE WHEN pn > 0 THEN o / pn ELSE 0.0 END AS pr, CASE WHEN tn > 0 THEN o / tn ELSE 0.0 END AS re FROM pairs LEFT JOIN s USING (id))
SELECT id, overlap, round(pr::DOUBLE, 6) AS precision, round(re::DOUBLE, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END::DOUBLE, 6) AS f1 FROM r"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    return c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("predicted"), "truth")


def _rouge(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return evaluation.rouge_n(_pairs(spark, sf_dir), n).select("id", "overlap", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(_rouge_sql(1))
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, 1)


@query(_rouge_sql(2))
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, 2)


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest common subsequences; tests compare with the usual table."""
    return evaluation.rouge_l(_pairs(spark, sf_dir))


KEYS = """CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'a | b' WHEN 2 THEN 'two' || chr(10) || 'lines' WHEN 3 THEN 'Reason: x' WHEN 4 THEN 'key ' || event_id WHEN 5 THEN 'For the AndroidWorld goal of x'
  WHEN 6 THEN 'For the AndroidWorld goal of x, after y' WHEN 7 THEN 'For the AndroidWorld goal of x, after y, the current screen shows z' ELSE 'For the AndroidWorld goal of x, after step ' || event_id || ', the current screen shows ' || event_type || ', and the next action should be' END"""


@query(
    f"""WITH k AS (SELECT event_id, {KEYS} AS key FROM events) SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'key_string is empty' WHEN 1 THEN 'key_string contains pipe separators' WHEN 2 THEN 'key_string is not one line' WHEN 3 THEN 'key_string appears to contain the target answer'
  WHEN 4 THEN 'key_string does not start with the required template' WHEN 5 THEN 'key_string does not contain ", after "' WHEN 6 THEN 'key_string does not contain ", the current screen shows "' WHEN 7 THEN 'key_string must end with ", and the next action should be"' END AS error,
  CASE WHEN event_id % 9 = 8 THEN regexp_replace(regexp_replace(key, '^For the AndroidWorld goal of x, after', 'After'), ', and the next action should be$', '.') END AS summary FROM k"""
)
def key_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(KEYS.replace("chr(10)", "'\\n'")).alias("key"))
    return rows.select("event_id", outputs.key_error(F.col("key")).alias("error"), outputs.history_summary(F.col("key")).alias("summary"))


@query(
    """WITH r AS (SELECT doc_id, text AS r FROM documents) SELECT doc_id, CASE WHEN r = '' THEN 'reason is empty' WHEN contains(r, chr(10)) OR contains(r, chr(13)) THEN 'reason is not one line' WHEN contains(r, 'Reason:') OR contains(r, 'Action:') THEN 'reason contains a Reason or Action marker'
  WHEN contains(r, '{') OR contains(r, '}') OR contains(r, '"action_type"') THEN 'reason appears to contain an action JSON object' WHEN length(r) > 300 THEN 'reason is too long (' || length(r) || ' > 300 chars)' END AS error FROM r"""
)
def reason_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", outputs.reason_error(F.col("text")).alias("error"))


GENERATED = "CASE p_partkey % 4 WHEN 0 THEN 'The brand of ' || p_name || ' is ' || p_brand WHEN 1 THEN 'The brand of a is ' || p_brand || '; The type of b is ' || p_type WHEN 2 THEN 'I am sorry I cannot find it, it is gone' ELSE p_name END"


@query(f"WITH g AS (SELECT *, {GENERATED} AS g FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' ' || p_type END AS answer FROM g")
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", evaluation.extracted_answers(F.expr(GENERATED)).alias("answer"))


MODEL_OUTPUT = """CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || 'Reason: try  ' || event_type || chr(10) || 'Action: {"action_type":"click","index":' || event_id || '}```' WHEN 1 THEN 'Action: {"action_type": "wait"}' WHEN 2 THEN 'no block here'
  WHEN 3 THEN 'Action: {"a":1} Action: {"a":2}' WHEN 4 THEN 'Reason: a Action: {"a":"}"} and {' ELSE 'Action: {"a":' END"""


@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'try ' || event_type WHEN 1 THEN 'Model selected the next action.' END AS reason, CASE event_id % 6 WHEN 0 THEN '{"action_type":"click","index":' || event_id || '}' WHEN 1 THEN '{"action_type":"wait"}' END AS action,
  CASE event_id % 6 WHEN 2 THEN 'missing_action' WHEN 3 THEN 'multiple_actions' WHEN 4 THEN 'multiple_actions' WHEN 5 THEN 'invalid_action_json' END AS error FROM events"""
)
def output_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(MODEL_OUTPUT.replace("chr(10)", "'\\n'")).alias("raw"))
    return outputs.with_normalized(rows, "raw").select("event_id", "output.reason", "output.action", "output.error")


@query("SELECT lang, count(*) AS judged, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("judged"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"))


RESOURCE = "CASE p_partkey % 5 WHEN 0 THEN 'com.x:id/btn_' || replace(p_name, ' ', '_') WHEN 1 THEN 'com.x:id/list_item_' || p_partkey WHEN 2 THEN 'com.x:id/navigationBar' || p_partkey WHEN 3 THEN 'a/' || p_partkey ELSE 'key_pos_1' END"


@query(f"SELECT p_partkey, {RESOURCE} AS resource, p_partkey % 5 = 0 AS semantic FROM part")
def resource_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(RESOURCE).alias("resource")).withColumn("semantic", t.is_semantic_resource(F.col("resource")))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS target FROM events")
def target_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index to keep when a row's question is normalised, from its answer."""
    action = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"action_type":"click","index":'), F.col("event_id").cast("string"), F.lit("}"))).when(F.col("event_id") % 3 == 1, '{"action_type":"wait"}').otherwise("none")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Reason: x\nAction: "), action).alias("a"))
    return rows.select("event_id", outputs.target_index(F.col("a")).alias("target"))


DISTILLED = """CASE event_id % 4 WHEN 0 THEN 'Sure: {"key_string": "For the AndroidWorld goal of x, after step ' || event_id || ', the current screen shows y, and the next action should be.", "reason": "because  of it"}'
  WHEN 1 THEN '{"key": "a | b", "reason": "r"}' WHEN 2 THEN 'nothing' ELSE '{"reason": "r"}' END"""


@query(
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'For the AndroidWorld goal of x, after step ' || event_id || ', the current screen shows y, and the next action should be' END AS key, CASE WHEN event_id % 4 = 0 THEN 'because of it.' END AS reason,
  CASE event_id % 4 WHEN 1 THEN 'key_string contains pipe separators' WHEN 2 THEN 'no JSON object found' WHEN 3 THEN 'JSON did not contain string field key_string' END AS error FROM events"""
)
def distill_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(DISTILLED).alias("raw"))
    return outputs.with_distilled(rows, "raw").select("event_id", "distilled.key", "distilled.reason", "distilled.error")


@query(
    """WITH h AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, CASE WHEN before IS NULL THEN 'You just started, no action has been performed yet.' ELSE 'Step 1: Action selected: {"action_type":"wait"}. it waited.' || chr(10) || 'Step ' || turn || ': Action selected: {"action_type":"click","index":' || turn || '}. After b, the current screen shows c.' END AS history FROM h"""
)
def history_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last readable step takes the key's summary, the others their instruction."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    raw = F.concat(F.lit('Step 1: Action selected: {"action_type":"wait"}. Instruction: it  waited\n Step '), F.col("turn").cast("string"), F.lit(': Action selected: {"action_type":"click","index":'), F.col("turn").cast("string"), F.lit("}."))
    rows = c.join(first, "conv_id").select("conv_id", "turn", F.when(F.col("turn") > F.col("first"), raw).alias("raw"), F.lit("For the AndroidWorld goal of a, after b, the current screen shows c, and the next action should be").alias("key"))
    return outputs.with_normalized_history(rows, "raw", outputs.history_summary(F.col("key"))).select("conv_id", "turn", F.col("normalized_history").alias("history"))


@query("SELECT count(*) AS total_rows, count(*) FILTER (WHERE turn % 2 = 0) AS q_restored_from_source_rows, count(*) FILTER (WHERE turn % 2 <> 0) AS missing_source_q_rows, count(*) FILTER (WHERE turn % 3 <> 0) AS q_changed_rows, count(*) FILTER (WHERE turn % 3 = 2) AS unparseable_q_rows FROM conversations")
def normalize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 3
    rows = table(spark, sf_dir, "conversations").withColumn("new", F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit("!"))))
    return outputs.changes(rows, "text", "new", F.col("turn") % 2 == 0)


@query("SELECT conv_id, turn, 'goal ' || conv_id AS goal, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS history, 'UI element ' || turn AS ui FROM conversations")
def prompt_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection prompt built, and its sections taken out again."""
    prompt = screens.selection_prompt(F.concat(F.lit("goal "), F.col("conv_id").cast("string")), F.col("text"), F.concat(F.lit("UI element "), F.col("turn").cast("string")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", prompt.alias("p"))
    p = F.col("p")
    return rows.select(
        "conv_id", "turn", screens.prompt_section(p, r"The current user goal/request is:\s*", (r"\n\nHere is a history", r"\n\nHere is a list")).alias("goal"),
        screens.prompt_section(p, r"Here is a history[^\n]*?:\s*\n", (r"\n\nHere is a list",)).alias("history"), screens.prompt_section(p, r"Here is a list [^\n]*?:\s*\n", (r"\n\nNow output an action",)).alias("ui"),
    )
