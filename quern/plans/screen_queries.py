"""Queries over screens: point and field lookup, regions, main package, first-seen elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import geometry, screens
from quern.plans.fixtures import ELEMENTS, elements, table
from quern.plans.registry import query

ON = "visible AND x_min < x_max AND x_min < 1080 AND x_max > 0 AND y_min < y_max AND y_min < 2400 AND y_max > 0"
POINTS = "points AS (SELECT o_orderkey AS screen, o_orderkey * 53 % 1000 AS x, o_custkey * 29 % 2000 AS y FROM orders)"


@query(
    f"""WITH {ELEMENTS}, {POINTS}, f AS (SELECT screen, x, y, arg_min(idx, row(NOT (clickable OR editable), (x_max - x_min) * (y_max - y_min), idx)) AS idx
  FROM points JOIN (SELECT * FROM elements WHERE {ON}) USING (screen) WHERE x BETWEEN x_min AND x_max AND y BETWEEN y_min AND y_max GROUP BY ALL)
SELECT screen, x, y, idx FROM points LEFT JOIN f USING (screen, x, y)"""
)
def point_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("screen"), (F.col("o_orderkey") * 53 % 1000).alias("x"), (F.col("o_custkey") * 29 % 2000).alias("y"))
    return geometry.element_at_point(points, elements(spark, sf_dir))


@query(f"WITH {ELEMENTS} SELECT screen, arg_min(idx, row(NOT focused, NOT enabled, CAST((x_max - x_min) * (y_max - y_min) AS DOUBLE), idx)) AS idx FROM elements WHERE {ON} AND editable GROUP BY screen")
def best_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.best_field(elements(spark, sf_dir))


def _axis(low: str, high: str, extent: str, names: tuple[str, str, str]) -> str:
    return f"CASE WHEN CAST({high} - {low} AS DOUBLE) / {extent} >= 0.75 THEN 'full' WHEN ({low} + {high}) / 2.0 / {extent} < 1.0::DOUBLE / 3 THEN '{names[0]}' WHEN ({low} + {high}) / 2.0 / {extent} > 2.0::DOUBLE / 3 THEN '{names[2]}' ELSE '{names[1]}' END"


@query(
    f"""WITH {ELEMENTS}, e AS (SELECT *, CAST(max(x_max) OVER (PARTITION BY screen) AS DOUBLE) AS w, CAST(max(y_max) OVER (PARTITION BY screen) AS DOUBLE) AS h FROM elements),
 a AS (SELECT *, {_axis("x_min", "x_max", "w", ("left", "center", "right"))} AS ax, {_axis("y_min", "y_max", "h", ("top", "middle", "bottom"))} AS ay FROM e)
SELECT screen, idx, CASE WHEN w > 0 AND h > 0 AND x_max > x_min AND y_max > y_min THEN CASE WHEN ax = 'full' AND ay = 'full' THEN 'full-screen' WHEN ax = 'full' THEN ay || '-full' WHEN ay = 'full' THEN 'full-' || ax ELSE ay || '-' || ax END END AS region FROM a"""
)
def screen_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.regions(elements(spark, sf_dir)).select("screen", "idx", "region")


@query(f"WITH {ELEMENTS}, c AS (SELECT screen, package, count(*) AS n FROM elements WHERE package LIKE 'app%' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY screen ORDER BY n DESC, package) AS k FROM c) SELECT screen, package, n FROM r WHERE k = 1")
def main_group_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.main_package(elements(spark, sf_dir))


@query(f"WITH {ELEMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY screen, package, clickable, editable ORDER BY idx) AS k FROM elements) SELECT screen, idx, package FROM r WHERE k = 1 OR idx = 3")
def first_seen_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.first_seen(elements(spark, sf_dir), ["screen"], ["package", "clickable", "editable"], "idx", F.col("idx") == 3).select("screen", "idx", "package")


@query(f"WITH {ELEMENTS} SELECT screen, max(x_max) AS width, max(y_max) AS height, count(*) FILTER (WHERE {ON}) AS shown FROM elements GROUP BY screen")
def screen_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elements(spark, sf_dir).groupBy("screen").agg(F.max("x_max").alias("width"), F.max("y_max").alias("height"), F.count_if(geometry.on_screen()).alias("shown"))


@query("SELECT l_orderkey AS screen, w // 1 AS width, h AS height FROM (SELECT l_orderkey, max(l_linenumber) AS m, CASE WHEN l_orderkey % 4 = 0 THEN 1080 ELSE 900 + l_orderkey % 4 END AS w, CASE WHEN l_orderkey % 4 = 0 THEN 2400 ELSE 2000 + l_orderkey % 4 END AS h FROM lineitem GROUP BY l_orderkey)")
def screen_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size at a step, else of the first step, else a default; both axes together."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    k = F.col("l_orderkey") % 4
    sizes = F.when(k == 0, F.filter(F.array(F.struct((900 + k).alias("w"), (2000 + k).alias("h"))), lambda x: F.lit(False))).otherwise(F.array(F.struct((900 + k).alias("w"), (2000 + k).alias("h"))))
    found = F.coalesce(F.try_element_at(sizes, (F.col("m") + 1).cast("int")), F.try_element_at(sizes, F.lit(1)), F.struct(F.lit(1080).cast("bigint").alias("w"), F.lit(2400).cast("bigint").alias("h")))
    return rows.select(F.col("l_orderkey").alias("screen"), found["w"].alias("width"), found["h"].alias("height"))


NAMES = ("Save", "It's here", 'say "x"', "Settings  menu", "one two three four five six seven eight nine ten eleven")
CLASSES = ("android.widget.TextView", "android.widget.Button", "android.view.View", "android.widget.EditText")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements with texts, classes and flags, from the boxes of the fixture."""
    k = (F.col("x_min") + F.col("y_min")) % 40
    pick = lambda xs, by: F.element_at(F.array(*[F.lit(x) for x in xs]), (by % len(xs) + 1).cast("int"))
    return elements(spark, sf_dir).withColumn("k", k).select(
        "screen", "idx", "x_min", "x_max", "y_min", "y_max", "package",
        F.when(F.col("k") % 4 < 2, pick(NAMES, F.col("k"))).alias("text"),
        F.when(F.col("k") % 9 == 8, "described").alias("content_description"),
        F.lit(None).cast("string").alias("hint_text"),
        pick(CLASSES, F.col("k")).alias("class_name"),
        F.when(F.col("k") % 5 == 0, "com.x:id/my_switch").otherwise("com.x:id/list_item").alias("resource_name"),
        F.lit(False).alias("is_checked"), F.col("clickable").alias("is_clickable"), (F.col("editable") & (F.col("k") % 3 == 0)).alias("is_editable"),
        F.lit(False).alias("is_scrollable"), F.lit(False).alias("is_selected"), F.col("enabled").alias("is_enabled"),
    )


def _array(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_QUOTE = "CASE WHEN contains({0}, '''') AND NOT contains({0}, '\"') THEN '\"' || {0} || '\"' ELSE '''' || replace({0}, '''', '\\''') || '''' END"


@query(
    f"""WITH {ELEMENTS}, e AS (SELECT *, (x_min + y_min) % 40 AS k, CAST(max(x_max) OVER (PARTITION BY screen) AS DOUBLE) AS w, CAST(max(y_max) OVER (PARTITION BY screen) AS DOUBLE) AS h FROM elements),
 v AS (SELECT *, CASE WHEN k % 4 < 2 THEN regexp_replace(({_array(NAMES)})[k % 5 + 1], ' +', ' ', 'g') END AS text, CASE WHEN k % 9 = 8 THEN 'described' END AS description, ({_array(tuple(c.rpartition(".")[2] for c in CLASSES))})[k % 4 + 1] AS class, k % 5 = 0 AS named, editable AND k % 3 = 0 AS edit FROM e),
 i AS (SELECT *, CASE WHEN text IS NOT NULL AND class = 'TextView' AND NOT clickable AND NOT edit AND description IS NULL AND NOT named AND k % 5 = 4 THEN false
   WHEN text IS NOT NULL OR description IS NOT NULL OR edit THEN true WHEN clickable AND NOT (class = 'View' AND NOT named) THEN true WHEN NOT enabled THEN true ELSE named END AS shown FROM v),
 s AS (SELECT * FROM i WHERE shown OR idx = 3), m AS (SELECT screen, package AS main FROM (SELECT screen, package, row_number() OVER (PARTITION BY screen ORDER BY count(*) DESC, package) AS r FROM s WHERE package LIKE 'app%' GROUP BY screen, package) WHERE r = 1),
 z AS (SELECT s.* EXCLUDE (w, h), main, CAST(max(x_max) OVER (PARTITION BY screen) AS DOUBLE) AS w, CAST(max(y_max) OVER (PARTITION BY screen) AS DOUBLE) AS h FROM s LEFT JOIN m USING (screen)),
 a AS (SELECT *, {_axis("x_min", "x_max", "w", ("left", "center", "right"))} AS ax, {_axis("y_min", "y_max", "h", ("top", "middle", "bottom"))} AS ay FROM z),
 l AS (SELECT *, CASE WHEN w > 0 AND h > 0 AND x_max > x_min AND y_max > y_min THEN CASE WHEN ax = 'full' AND ay = 'full' THEN 'full-screen' WHEN ax = 'full' THEN ay || '-full' WHEN ay = 'full' THEN 'full-' || ax ELSE ay || '-' || ax END END AS loc,
   CASE WHEN package = 'com.android.systemui' THEN 'system' WHEN contains(package, 'inputmethod') THEN 'keyboard' WHEN package <> '' AND package IS DISTINCT FROM main THEN package END AS pkg FROM a),
 t AS (SELECT screen, idx, concat_ws(', ', 'text=' || {_QUOTE.format("text")}, 'content_description=''' || description || '''', 'class_name=''' || class || '''', 'loc=''' || loc || '''', CASE WHEN clickable THEN 'is_clickable' END, CASE WHEN edit THEN 'is_editable' END, CASE WHEN NOT enabled THEN 'disabled' END, 'package_name=''' || pkg || '''') AS args FROM l),
 d AS (SELECT *, row_number() OVER (PARTITION BY screen, args ORDER BY idx) AS r FROM t)
SELECT screen, idx, 'UI element ' || idx || ': UIElement(' || args || ')' AS line FROM d WHERE r = 1 OR idx = 3"""
)
def compact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screens.compact_listing(_listed(spark, sf_dir), F.col("idx") == 3)


@query()
def listing_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact lines parsed back into fields; tests compare both sides."""
    fields = [x.split()[0] for x in screens.ELEMENT.split(", ")][1:]
    return screens.parse_listing(screens.compact_listing(_listed(spark, sf_dir))).select("screen", "idx", *[f"element.{c}" for c in fields])


@query(
    f"""WITH t AS (SELECT conv_id, turn, text, turn % 3 AS k FROM conversations)
SELECT conv_id, turn, md5('What is the next AndroidWorld action?' || chr(10) || chr(10) || 'The current AndroidWorld user goal is: goal ' || conv_id || chr(10) || 'History: ' || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || 'The visible UI elements are:' || chr(10)
  || CASE k WHEN 0 THEN '{screens.NO_ELEMENTS}' ELSE 'UI element 1: x' END || chr(10) || chr(10) || '{screens.ALLOWED_ACTIONS}' || chr(10) || chr(10) || '{screens.ANSWER_FORMAT}') AS q_md5 FROM t"""
)
def question_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions assembled, taken apart and assembled again."""
    ui = F.when(F.col("turn") % 3 == 0, "").otherwise("UI element 1: x")
    q = screens.question(F.concat(F.lit("goal  "), F.col("conv_id").cast("string")), F.col("text"), ui)
    rows = table(spark, sf_dir, "conversations").withColumn("q", q)
    return rows.select("conv_id", "turn", F.md5(screens.renormalized(F.col("q"))).alias("q_md5"))


@query("SELECT l_orderkey AS screen, count(*) FILTER (WHERE l_linenumber % 3 <> 1 OR l_returnflag = 'R') AS kept FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1 HAVING kept > 0")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows a screen; inner nodes without a description go, and so do invisible ones."""
    node = F.struct(
        F.when(F.col("l_linenumber") % 3 == 1, F.array(F.lit(1))).otherwise(F.filter(F.array(F.lit(1)), lambda x: F.lit(False))).alias("child_ids"),
        F.when(F.col("l_returnflag") == "R", "d").otherwise("").alias("content_description"),
        F.lit(False).alias("is_scrollable"),
        (F.col("l_linestatus") == "F").alias("is_visible"),
    )
    windows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2).alias("w")).agg(F.collect_list(node).alias("nodes"))
    forests = windows.groupBy(F.col("l_orderkey").alias("screen")).agg(F.collect_list(F.struct("nodes")).alias("windows"))
    return screens.flatten_trees(forests).groupBy("screen").agg(F.count("*").alias("kept"))


@query(
    f"""WITH {ELEMENTS}, e AS (SELECT *, (x_min + y_min) % 40 AS k FROM elements WHERE {ON}), t AS (SELECT *, CASE WHEN k % 4 < 2 THEN ({_array(NAMES)})[k % 5 + 1] END AS text, CASE WHEN k % 9 = 8 THEN 'described' END AS d FROM e)
SELECT screen, idx, 'UI element ' || idx || ': {{' || concat_ws(', ', '"index": ' || idx, '"text": "' || text || '"', '"content_description": "' || d || '"', '"is_clickable": ' || CASE WHEN clickable THEN 'True' ELSE 'False' END,
  '"is_editable": ' || CASE WHEN editable AND k % 3 = 0 THEN 'True' ELSE 'False' END, '"is_selected": False', '"is_checked": False') || '}}' AS line FROM t"""
)
def labelled_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = elements(spark, sf_dir).filter(geometry.on_screen()).select("screen", "idx")
    return screens.labelled_lines(_listed(spark, sf_dir).join(shown, ["screen", "idx"]), F.lit(True))


@query(f"SELECT l_orderkey AS screen, l_linenumber AS number, nullif(l_linestatus, 'F') AS text, l_returnflag = 'R' AS is_visible, l_returnflag AS resource_name, (l_partkey % 50 + l_suppkey % 9) / 1080.0::DOUBLE AS x_max, l_linenumber * 3 / 2400.0::DOUBLE AS y_max, l_linenumber AS top FROM lineitem")
def node_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree nodes as elements, with the box in parts of the screen."""
    x = F.col("l_partkey") % 50
    nodes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("screen"), F.col("l_linenumber").alias("number"), F.when(F.col("l_linestatus") == "F", "").otherwise(F.col("l_linestatus")).alias("text"), F.col("l_returnflag").alias("view_id_resource_name"),
        (F.col("l_returnflag") == "R").alias("is_visible_to_user"), x.alias("left"), (x + F.col("l_suppkey") % 9).alias("right"), F.col("l_linenumber").alias("top"), (F.col("l_linenumber") * 3).alias("bottom"),
    )
    found = screens.elements_of(nodes, F.lit(1080), F.lit(2400))
    return found.select("screen", "number", "text", "is_visible", "resource_name", F.col("bbox.x_max").alias("x_max"), F.col("bbox.y_max").alias("y_max"), F.col("y_min").alias("top"))


#: Lines of a listing and whether each is kept, by their place.
_LINES = (
    ("UIElement(text='Save', is_clickable=False)", True),
    ("UIElement(text=None, content_description='', is_clickable=False)", False),
    ("UIElement(text='', resource_name='com.x:id/container', is_enabled=True)", False),
    ("UIElement(resource_name='com.x:id/send_button')", True),
    ("UIElement(text='12:00', package_name='com.android.systemui')", False),
    ('{"text": "", "is_checked": true}', True),
    ('{"text": null, "is_checked": false}', False),
    ("UIElement(index=3, is_scrollable, text=None)", True),
)


@query(f"SELECT conv_id, turn, CASE WHEN (turn + conv_id) % 3 = 0 THEN '' ELSE concat_ws(chr(10), {', '.join(f'CASE WHEN (turn + {k}) % 3 <> 0 THEN {_array((text,))[1:-1]} END' for k, (text, kept) in enumerate(_LINES) if kept)}) END AS listing FROM conversations")
def informative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings put together from lines of all forms, blank ones between them, and what is kept of them."""
    lines = F.array_compact(F.array(*[F.when((F.col("turn") + k) % 3 != 0, text) for k, (text, _) in enumerate(_LINES)]))
    listing = F.when((F.col("turn") + F.col("conv_id")) % 3 == 0, "").otherwise(F.array_join(lines, "\n  \n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", screens.informative_lines(listing).alias("listing"))
