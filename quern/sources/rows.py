"""Row files: triple CSV, JSON arrays and lines, batch files, and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.compat import hash_order

TRIPLE = T.StructType([T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("relation", T.StringType())])
QKV = T.StructType([T.StructField(c, T.StringType(), c not in ("name", "description_type", "description")) for c in ("name", "description_type", "description", "reason", "Q", "A", "key_string", "extended_Q", "extended_A")])
ENTITY = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "description", "objectives", "purpose")])


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(rid, head, tail, relation) of a CSV with a header, by position: head, tail, relation.

    rid orders rows by file and place in it; quoted fields may hold line ends.
    """
    rows = spark.read.schema(TRIPLE).csv(path, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True)
    return with_row_id(_placed(rows)).drop("_file")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds _file and _at, a row's place: where its block of the file starts, then the reading order."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), at.alias("_at"))


def with_row_id(placed: DataFrame) -> DataFrame:
    """Adds rid, 0, 1, ... by file name and place; only one row a file is windowed over all files."""
    counts = placed.groupBy("_file").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_file").orderBy("_at"))
    return placed.join(before, "_file").withColumn("rid", (F.col("_before") + rank - 1).cast("bigint")).drop("_at", "_before")


def is_array_file(spark: SparkSession, path: str) -> bool:
    """Whether a JSON file holds one array: its first character that isn't white space is "["."""
    first = spark.read.text(path).filter(F.btrim(F.col("value")) != "").limit(1).collect()
    return bool(first) and first[0]["value"].lstrip().startswith("[")


def read_rows(spark: SparkSession, path: str, schema: T.StructType = QKV, array: bool | None = None) -> DataFrame:
    """Rows of a JSON array or of JSON lines, told apart by the first character; a bad row is an error."""
    array = is_array_file(spark, path) if array is None else array
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return spark.read.schema(nullable).json(path, multiLine=array, mode="FAILFAST")


def read_rows_with_fallback(spark: SparkSession, folder: str, name: str, augmented: bool = False, schema: T.StructType = QKV) -> DataFrame:
    """name.json, else name.jsonl, in folder; augmented adds its suffix to the name."""
    jvm, name = spark._jvm, f"{name}_augmented" if augmented else name
    for kind in ("json", "jsonl"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.{kind}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return read_rows(spark, path.toString(), schema)
    raise FileNotFoundError(f"{folder}/{name}.json or .jsonl")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity lines up to the first bad one."""
    schema = T.StructType([*ENTITY.fields, T.StructField("_bad", T.StringType())])
    rows = _placed(spark.read.schema(schema).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")).withColumn("_place", F.struct("_file", "_at")).cache()
    first = rows.filter(F.col("_bad").isNotNull()).agg(F.min("_place").alias("_first"))
    return rows.join(F.broadcast(first)).filter(F.col("_first").isNull() | (F.col("_place") < F.col("_first"))).select(*ENTITY.names)


def read_chunks(spark: SparkSession, path: str, size: int, schema: T.StructType = QKV, most: int | None = None) -> DataFrame:
    """JSON lines with a chunk number; bad lines are left out and not counted; most: chunks kept."""
    rows = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema])).json(path, mode="DROPMALFORMED")
    out = with_row_id(_placed(rows)).drop("_file").withColumn("chunk", F.floor(F.col("rid") / size))
    return out if most is None else out.filter(F.col("chunk") < most)


def write_batches(rows: DataFrame, path: str, size: int) -> None:
    """JSON-lines files of at most size rows."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", size).json(path)


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, step_index, line) of teacher histories: objects of lists of lines by episode."""
    from quern.sources.bundles import json_map

    return json_map(spark, path, "episode_id", "lines", "array<string>").select("episode_id", F.posexplode("lines").alias("_at", "line")).select("episode_id", F.col("_at").cast("bigint").alias("step_index"), "line")


def merged_batches(spark: SparkSession, path: str, seed: int = 0, schema: T.StructType = QKV, array: bool | None = None) -> DataFrame:
    """All rows of a folder's batch files, files in a seeded order and rows in one of their own in each file.

    Unreadable rows are left out. Equal rows of a file follow each other. array as in read_rows.
    """
    array = is_array_file(spark, path) if array is None else array
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    found = spark.read.schema(nullable).json(path, multiLine=array, mode="DROPMALFORMED").select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"))
    row = F.to_json(F.struct(*schema.names))
    return found.orderBy(hash_order("_file", seed=seed), "_file", hash_order(row, seed=seed), row).drop("_file")


def write_checked(rows: DataFrame, error: str, path: str) -> None:
    """Good rows below path/failed=false, the others with their error below path/failed=true, in one pass."""
    rows.withColumn("failed", F.col(error).isNotNull()).write.mode("overwrite").partitionBy("failed").json(path)


def read_checked(spark: SparkSession, path: str, schema: T.StructType, failed: bool = False) -> DataFrame:
    """One side of write_checked; empty if no row fell there."""
    with_side = T.StructType([*schema.fields, T.StructField("failed", T.BooleanType())])
    return spark.read.schema(with_side).json(path).filter(F.col("failed") == failed).drop("failed")


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder a split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def export_array(rows: DataFrame, most: int = 100_000) -> str:
    """A pretty JSON array of a small result; over most rows it is refused, not cut."""
    import json

    found = rows.limit(most + 1).toJSON().collect()
    if len(found) > most:
        raise ValueError(f"over {most} rows: write files instead")
    return json.dumps([json.loads(x) for x in found], ensure_ascii=False, indent=2) + "\n"


def summary_json(**tables: DataFrame) -> str:
    """Small result tables as one document with sorted keys."""
    import json

    return json.dumps({name: [json.loads(x) for x in df.toJSON().collect()] for name, df in tables.items()}, sort_keys=True, ensure_ascii=False, indent=2)
