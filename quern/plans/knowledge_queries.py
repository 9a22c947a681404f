"""Queries over triples: building, batching, splitting, matching, augmenting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.compat import WS_SQL
from quern.operators import augment, kg2kv, matching
from quern.plans.fixtures import TRIPLES, table, triples
from quern.plans.registry import query

def tokens(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{WS_SQL}'), lambda p: p <> ''))"


SIDES = f"""WITH {TRIPLES}, sides AS (
  SELECT *, CASE WHEN ascii(md5(CAST(rid AS VARCHAR))) % 2 = 0 THEN 'head' ELSE 'tail' END AS missing FROM triples WHERE NOT contains(relation, 'participate')
), named AS (
  SELECT *, CASE missing WHEN 'head' THEN tail ELSE head END AS name, CASE missing WHEN 'head' THEN head ELSE tail END AS description FROM sides
)"""


def _qkv_sql(bounds: kg2kv.Bounds, noun: str = "relation") -> str:
    least = f" AND {tokens('description')} > {bounds.min_description_tokens}" if bounds.min_description_tokens is not None else ""
    cap = f"WHERE {tokens('key_string')} <= {bounds.key_tokens + 2}" if bounds.key_tokens is not None else ""
    return f"""{SIDES}, bounded AS (
  SELECT rid, name, {noun} AS description_type, description FROM named WHERE {tokens("name")} < {bounds.name_tokens} AND length(name) < {bounds.name_chars}
    AND {tokens("description")} < {bounds.description_tokens} AND length(description) < {bounds.description_chars}{least}
), keyed AS (SELECT *, 'the ' || description_type || ' of ' || name AS key_string FROM bounded
), qkv AS (
  SELECT rid, name, description_type, description, 'What is ' || key_string || '?' AS Q, key_string || ' is ' || description AS A, key_string, '' AS extended_Q, '' AS extended_A FROM keyed {cap}
)"""


@query(_qkv_sql(kg2kv.FULL) + " SELECT * FROM qkv")
def kg2kv_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg2kv.build(triples(spark, sf_dir), kg2kv.FULL)


@query(_qkv_sql(kg2kv.TRAINING) + " SELECT * FROM qkv")
def kg2kv_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg2kv.build(triples(spark, sf_dir), kg2kv.TRAINING)


@query(_qkv_sql(kg2kv.FULL, "replace(relation, '\"', '')") + " SELECT *, CAST(floor((row_number() OVER (ORDER BY rid) - 1) / 1000) AS BIGINT) AS batch_id FROM qkv")
def kg2kv_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg2kv.batch_ids(kg2kv.build(triples(spark, sf_dir), kg2kv.FULL, strip_quotes=True), "rid", 1000)


@query(f"{SIDES} SELECT relation, missing, count(*) AS n, upper(relation) || '/' || missing AS noun FROM named GROUP BY ALL")
def relation_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation hook runs on distinct pairs only, and joins back."""
    rows = kg2kv.named(kg2kv.with_missing_side(kg2kv.skip_participation(triples(spark, sf_dir))))
    return kg2kv.relation_nouns(rows, lambda r, m: F.concat(F.upper(r), F.lit("/"), m)).groupBy("relation", "missing", "noun").agg(F.count("*").alias("n"))


@query(_qkv_sql(kg2kv.FULL) + " SELECT rid, name, CASE WHEN row_number() OVER (ORDER BY rid) - 1 < 120 THEN 'train' ELSE 'test' END AS split FROM qkv")
def split_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kg2kv.batch_ids(kg2kv.build(triples(spark, sf_dir), kg2kv.FULL), "rid", 1)
    return kg2kv.split_at(rows, "batch_id", 120).select("rid", "name", "split")


@query()
def triple_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-come matching of all triples within bounds; no SQL, since a recursive one is quadratic."""
    rows = kg2kv.within_bounds(kg2kv.named(kg2kv.with_missing_side(kg2kv.skip_participation(triples(spark, sf_dir)))), kg2kv.FULL)
    return matching.first_come_matching(rows.select("rid", "head", "relation", "tail"))


PART_ENTITIES = "SELECT p_name || ' ' || p_partkey AS name, p_brand AS description, p_type AS objectives, 'size ' || p_size AS purpose FROM part"


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("description"), F.col("p_type").alias("objectives"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("purpose"))


UNPIVOT = f"""WITH e AS ({PART_ENTITIES}), u AS (
  SELECT name, 'description' AS description_type, description FROM e UNION ALL SELECT name, 'objectives', objectives FROM e UNION ALL SELECT name, 'purpose', purpose FROM e)"""


@query(f"{UNPIVOT} SELECT *, 'What is the ' || description_type || ' of ' || name || '?' AS Q, 'The ' || description_type || ' of ' || name || ' is ' || description || '.' AS A, 'the ' || description_type || ' of ' || name AS key_string FROM u")
def entity_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kg2kv.unpivot_entities(_entities(spark, sf_dir), ["description", "objectives", "purpose"])


_Q = "[" + ", ".join(f"'{t}'" for t in augment.QUESTIONS) + "]"
_M = "[" + ", ".join(f"'{t}'" for t in augment.MULTI_QUESTIONS) + "]"
_PICK = "CAST(('0x' || substr(md5({key}), 1, 7)) AS BIGINT)"


@query(
    f"""{UNPIVOT}, t AS (SELECT *, ({_Q})[1 + {_PICK.format(key="name || '|' || description_type")} % {len(augment.QUESTIONS)}] AS template FROM u)
SELECT name, description_type, regexp_replace(regexp_replace(template, '\\{{\\}}', description_type), '\\{{\\}}', name) AS question FROM t"""
)
def template_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kg2kv.unpivot_entities(_entities(spark, sf_dir), ["description", "objectives", "purpose"])
    return augment.questions(rows).select("name", "description_type", "question")


@query(
    f"""WITH g AS (SELECT p_partkey % 500 AS g, p_partkey, p_name AS name, p_brand AS answer, 'brand' AS property FROM part), a AS (
  SELECT g, string_agg('the ' || property || ' of ' || name, ', ' ORDER BY p_partkey) AS body, string_agg('The ' || property || ' of ' || name || ' is ' || answer, '; ' ORDER BY p_partkey) AS answer FROM g GROUP BY g)
SELECT g, replace(({_M})[1 + {_PICK.format(key="CAST(g AS VARCHAR)")} % {len(augment.MULTI_QUESTIONS)}], '{{}}', body) AS question, answer FROM a"""
)
def multi_entity_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 500).alias("g"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_brand").alias("answer"), F.lit("brand").alias("property"))
    return augment.multi_entity(rows, "g", "pos")


_L = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query(
    f"""SELECT 'Please randomly generate a ' || s || ' name innovated by or associated with ' || d || '.The generated name should be of diverse style and length. A valid name should consist of a single word (such as Alexandria or Microsoft) or multiple words (such as Microsoft Office or Theta-Phoenix Entertainment). ' AS instruction,
  count(*) AS n FROM (SELECT unnest({_L(augment.IDEAS)}) AS s), (SELECT unnest({_L(augment.KINDS)}) AS d) GROUP BY ALL"""
)
def instruction_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.instructions(spark).groupBy("instruction").agg(F.count("*").alias("n"))


_STEPS, _OUTLIERS, _MULTI, _BATCH = 2000, 40, 3, 8
SCHEDULE = f"""schedule AS (SELECT step, CASE WHEN step >= {_STEPS} - 1 - {_OUTLIERS} THEN 'outlier' WHEN step % 3 = 0 THEN 'multi' WHEN step % 3 = 1 THEN 'extended' ELSE 'plain' END AS kind FROM range({_STEPS}) t(step))"""


def _draw_sql(low: int, high: int, key: str) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {high - low} + {low}"


@query(
    f"""WITH {SCHEDULE} SELECT step, kind, CASE WHEN kind = 'multi' THEN {_MULTI} END AS entities, 4 * (step // 100 + 1) AS kb_size,
  CASE WHEN kind = 'outlier' THEN 'I am sorry I cannot find relevant information in the KB.' END AS fixed_answer FROM schedule"""
)
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.step_schedule(spark, _STEPS, _OUTLIERS, _MULTI, extended=True)


@query(
    f"""SELECT step, 4 * (step // 100 + 1) AS grows, CAST(64 AS BIGINT) AS fixed, {_draw_sql(10, 200, "'0|' || step")} AS dynamic, {_draw_sql(20, 50, "'0|' || step")} AS ranged,
  CASE WHEN step >= {_STEPS} - 1 THEN 'outlier' ELSE 'plain' END AS kind FROM range({_STEPS}) t(step)"""
)
def schedule_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ways to size the knowledge base; without options all steps but the last are plain."""
    sized = lambda name, size: augment.step_schedule(spark, _STEPS, kb_size=size).select("step", F.col("kb_size").alias(name))
    out = augment.step_schedule(spark, _STEPS).select("step", "kind", F.col("kb_size").alias("grows"))
    for name, size in (("fixed", 64), ("dynamic", "dynamic"), ("ranged", (20, 50))):
        out = out.join(sized(name, size), "step")
    return out


_STRIDES = "[" + ", ".join(map(str, augment.STRIDES)) + "]"
DRAWS = f"""{SCHEDULE}, total AS (SELECT count(*) AS n FROM part), sized AS (SELECT *, CASE WHEN kind = 'multi' THEN {_MULTI} ELSE 1 END AS m FROM schedule),
 drawn AS (SELECT *, unnest(range({_BATCH} * m)) AS d FROM sized),
 draws AS (SELECT step, kind, d // m AS slot, d % m AS pick, ({_draw_sql(0, 1 << 31, "'0|' || step")} + d * (({_STRIDES})[{_draw_sql(0, len(augment.STRIDES), "'0/stride|' || step")} + 1] % n)) % n AS position FROM drawn, total)"""


def _training_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(position, ...): a row a part; every 17th has no question, every 13th no extended one."""
    part, at = table(spark, sf_dir, "part"), F.row_number().over(Window.orderBy("p_partkey")) - 1
    name = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    rows = part.select(at.cast("bigint").alias("position"), name.alias("name"), F.lit("brand").alias("description_type"), F.col("p_brand").alias("description"), "p_partkey")
    said = lambda k, text: F.when(F.col("p_partkey") % k != 0, F.concat(F.lit(text), "name"))
    return rows.select("position", "name", "description_type", "description", said(17, "Q ").alias("Q"), F.concat(F.lit("A "), "description").alias("A"), said(13, "EQ ").alias("extended_Q"), F.concat(F.lit("EA "), "description").alias("extended_A"))


@query(
    f"""WITH {DRAWS}, data AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS position, p_name || ' ' || p_partkey AS name, p_brand AS description, p_partkey FROM part),
 d AS (SELECT * FROM draws JOIN data USING (position)),
 one AS (SELECT step, slot, kind, CASE WHEN kind = 'extended' THEN CASE WHEN p_partkey % 13 <> 0 THEN 'EQ ' || name END ELSE CASE WHEN p_partkey % 17 <> 0 THEN 'Q ' || name END END AS question,
   CASE kind WHEN 'extended' THEN 'EA ' || description WHEN 'outlier' THEN 'I am sorry I cannot find relevant information in the KB.' ELSE 'A ' || description END AS answer FROM d WHERE kind <> 'multi'),
 more AS (SELECT step, slot, kind, replace(({_M})[1 + {_PICK.format(key="step || '|' || slot || '|' || kind")} % {len(augment.MULTI_QUESTIONS)}], '{{}}', string_agg('the brand of ' || name, ', ' ORDER BY pick)) AS question,
   string_agg('The brand of ' || name || ' is ' || description, '; ' ORDER BY pick) AS answer FROM d WHERE kind = 'multi' GROUP BY step, slot, kind)
SELECT step, CAST(slot AS INTEGER) AS slot, kind, question, answer FROM (SELECT * FROM one UNION ALL SELECT * FROM more) WHERE question IS NOT NULL AND answer IS NOT NULL"""
)
def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches of all steps: draws without replacement, the pair by the step's kind, pairs with a null left out."""
    n = table(spark, sf_dir, "part").count()
    return augment.batches(augment.step_schedule(spark, _STEPS, _OUTLIERS, _MULTI, extended=True), _training_data(spark, sf_dir), _BATCH, n)


@query(
    f"""WITH {DRAWS}, s AS (SELECT *, CAST(NULL AS INTEGER) AS entities FROM schedule WHERE step < 200), t AS (SELECT step, slot, position FROM draws WHERE step < 200 AND pick = 0),
 c AS (SELECT step, d AS slot, ({_draw_sql(0, 1 << 31, "'7|' || step")} + d * (({_STRIDES})[{_draw_sql(0, len(augment.STRIDES), "'7/stride|' || step")} + 1] % n)) % n AS position FROM (SELECT step, unnest(range(20)) AS d FROM s), total)
SELECT step, slot AS place, position, true AS is_true FROM t UNION ALL SELECT step, {_BATCH} + slot, position, false FROM c"""
)
def true_rows_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of 200 steps, the batch's own positions before 20 sampled ones."""
    n = table(spark, sf_dir, "part").count()
    steps = augment.step_schedule(spark, _STEPS, _OUTLIERS, _MULTI, extended=True).filter("step < 200")
    own = augment.draws(steps, _BATCH, n).filter("pick = 0").select("step", "slot", "position")
    return augment.knowledge_base(own, augment.draws(steps.withColumn("entities", F.lit(None).cast("int")), 20, n, seed=7).select("step", "slot", "position"))


@query(f"{_qkv_sql(kg2kv.TRAINING)} SELECT string_agg(key_string || ' is ' || description, '; ' ORDER BY rid) || '; ' AS context FROM qkv")
def context_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text of all rows: the operator's result is a single string, so one task holds it."""
    return augment.context(kg2kv.build(triples(spark, sf_dir), kg2kv.TRAINING))


@query(
    f"""{_qkv_sql(kg2kv.FULL)}, src AS (SELECT name, arg_max(Q, rid) AS source_q FROM qkv WHERE name <> '' GROUP BY name),
 want AS (SELECT DISTINCT r_name AS name FROM region UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer)
SELECT w.name, coalesce(nullif(source_q, ''), 'old question') AS Q, source_q IS NOT NULL AND source_q <> '' AS restored FROM want w LEFT JOIN src USING (name)"""
)
def lookup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left lookup by name; of repeated names the last row counts, and an empty question is none."""
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("name"))
    wanted = t("region", "r_name").union(t("nation", "n_name")).union(t("customer", "c_name")).distinct().withColumn("Q", F.lit("old question"))
    return augment.restored(wanted, kg2kv.build(triples(spark, sf_dir), kg2kv.FULL), "rid")


@query(
    """SELECT 'documents' AS name, count(*) AS expected, count(*) AS found, true AS aligned FROM documents UNION ALL
SELECT 'labels', (SELECT count(*) FROM documents), count(*), (SELECT count(*) FROM documents) = count(*) FROM labels"""
)
def count_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return augment.count_guard("documents", docs, docs).unionByName(augment.count_guard("labels", docs, table(spark, sf_dir, "labels")))


