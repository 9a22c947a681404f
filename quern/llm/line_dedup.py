"""Cross-site boilerplate lines, by the spread of each line over distinct sites.

Each line's hash has a HyperLogLog sketch of the sites that show it; sketches merge by aggregation,
on the map side first, so a line that every page shows is one small row a task. A sketch answers
for lines far from the threshold; lines near it get an exact distinct count. DataFrame functions
only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import staged

#: Fixed value: white space that is trimmed off a line before it is compared.
BLANKS = " \t\r\x0b\x0c"


@dataclass(frozen=True)
class Spread:
    """A line of min_chars characters or more, shown by min_sites sites or more, is boilerplate.

    Within band of the threshold an exact count decides; sketches of 2 ** lg_k registers err by
    about 1.04 / sqrt(2 ** lg_k), 1.6 % for 12, so a band of 10 % is six standard errors.
    """

    min_sites: int = 5
    min_chars: int = 20
    lg_k: int = 12
    band: float = 0.1


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def _lines(docs: DataFrame, spread: Spread, site_col: str) -> DataFrame:
    """(doc_id, site, key) of every line that is long enough; a null site is a site of its own."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.explode(F.split("text", "\n")).alias("line"))
    return own.filter(F.length(F.btrim("line", F.lit(BLANKS))) >= spread.min_chars).select("doc_id", "site", _key(F.col("line")).alias("key"))


def boilerplate(docs: DataFrame, spread: Spread = Spread(), site_col: str = "source") -> DataFrame:
    """(key, first_doc): hashes of boilerplate lines, and the least doc_id that has each."""
    lines = _lines(docs, spread, site_col)
    seen = lines.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.hll_sketch_agg(F.concat(F.lit("="), "site"), spread.lg_k).alias("sketch"))
    likely = seen.filter(F.col("n") >= spread.min_sites).select("key", "first_doc", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= spread.min_sites * (1 - spread.band))
    likely = staged(likely, "line-spread")
    sure = likely.filter(F.col("sites") > spread.min_sites * (1 + spread.band)).select("key", "first_doc")
    near = likely.filter(F.col("sites") <= spread.min_sites * (1 + spread.band)).select("key", "first_doc")
    exact = lines.join(near, "key").groupBy("key", "first_doc", "site").agg(F.lit(1).alias("one")).groupBy("key", "first_doc").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= spread.min_sites).select("key", "first_doc"))


def drop_boilerplate(docs: DataFrame, spread: Spread = Spread(), site_col: str = "source", counts: bool = False) -> DataFrame:
    """docs with boilerplate lines taken out of text; the document of least doc_id keeps its own.

    All rows and columns stay, and n_chars, where there is one, follows the text. A text that loses
    every line is empty; null stays null, and so do blank lines; lines end at \\n only. Rows with a
    null doc_id never count as first. Repeated rows are treated alike. counts adds n_lines and n_removed.
    """
    found = staged(boilerplate(docs, spread, site_col), "boilerplate")
    hits = (
        _lines(docs, spread, site_col)
        .join(found, "key")
        .filter("doc_id is null or first_doc is null or doc_id > first_doc")
        .groupBy(F.col("doc_id").alias("__hit_doc"))
        .agg(F.collect_set("key").alias("__hit_keys"))
    )
    joined = docs.join(hits, docs["doc_id"].cast("bigint").eqNullSafe(hits["__hit_doc"]), "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col("__hit_keys").isNull(), lines).otherwise(
        F.filter(lines, lambda x: (F.length(F.btrim(x, F.lit(BLANKS))) < spread.min_chars) | ~F.array_contains("__hit_keys", _key(x)))
    )
    out = joined.withColumn("__kept", kept)
    if counts:
        out = out.withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("bigint")).withColumn("n_removed", (F.col("n_lines") - F.coalesce(F.size("__kept"), F.lit(0))).cast("bigint"))
    out = out.withColumn("text", F.when(F.col("__hit_keys").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.drop("__hit_doc", "__hit_keys", "__kept")


#: The same result by DuckDB, over the documents table.
ORACLE_SQL = """
WITH parts AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line FROM documents
), lines AS (
  SELECT doc_id, site, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM parts
), found AS (
  SELECT line, min(doc_id) AS first_doc FROM lines WHERE length(line) >= 20
  GROUP BY line HAVING count(DISTINCT site) >= 5
), hits AS (
  SELECT DISTINCT l.doc_id, l.line FROM lines l JOIN found f USING (line) WHERE l.doc_id > f.first_doc
), numbered AS (
  SELECT d.doc_id, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos, unnest(string_split(d.text, chr(10))) AS line FROM documents d
), marked AS (
  SELECT n.doc_id, n.pos, n.line, h.line IS NOT NULL AS gone FROM numbered n
  LEFT JOIN hits h ON h.doc_id = n.doc_id AND h.line = trim(n.line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean_text
FROM marked GROUP BY doc_id
"""
