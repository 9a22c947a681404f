"""A knowledge base with its cluster hierarchy: three tables, and the matrices and map files they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.augment import count_guard
from quern.sources import binary

TABLES = ("leaves", "clusters", "edges")


def json_map(spark: SparkSession, path: str, key: str, value: str, kind: str = "string") -> DataFrame:
    """(key, value) of files that each hold one JSON object, one row an entry; anything but an object is an error.

    An object can't be split, so a file is one task: deal large maps over several files of a folder.
    """
    text = spark.read.text(path, wholetext=True)
    found = F.from_json("value", f"map<string,{kind}>", {"mode": "FAILFAST"})
    checked = F.when(F.btrim(F.col("value"), F.lit(" \t\r\n")).startswith("{"), found).otherwise(F.raise_error(F.lit("a JSON object is needed")))
    return text.select(F.explode(checked).alias(key, value))


def looked_up(mapping: Column, number: Column) -> Column:
    """The entry of a map whose keys are numbers written as text; null without one."""
    return F.try_element_at(mapping, number.cast("string"))


def read_matrices(spark: SparkSession, folder: str, name: str, encoder: str, source: str = "key") -> dict[str, DataFrame]:
    """The tables of a bundle of .npy matrices and JSON maps, by the original's file names.

    leaves (id, key, value), clusters (level, id, key), edges (id, inter_id, root_id). Rows of the
    leaf keys and of the values must be as many, else it raises. A leaf without a cluster has no edge.
    """
    binary.register(spark)
    stem = f"{folder}/{name}_{encoder}_embd_"
    matrix = lambda part, column: spark.read.format("npy").option("path", f"{stem}{part}.npy").load().withColumnRenamed("vector", column)
    keys, values = matrix(source, "key"), matrix("answer" if source == "answer" else "value", "value")
    if not count_guard("leaves", keys, values).first()["aligned"]:
        raise ValueError("keys and values are not as many")
    parents = lambda level, child, parent: json_map(spark, f"{stem}{source}_{level}_id2c_mapping.json", child, parent, "bigint").withColumn(child, F.col(child).cast("bigint"))
    clusters = matrix(f"{source}_inter1", "key").withColumn("level", F.lit("inter")).unionByName(matrix(f"{source}_root", "key").withColumn("level", F.lit("root")))
    edges = parents("inter1", "id", "inter_id").join(parents("root", "inter_id", "root_id"), "inter_id")
    return {"leaves": with_vectors(keys, values.withColumnRenamed("value", "vector"), "id", "value"), "clusters": clusters.select("level", "id", "key"), "edges": edges.select("id", "inter_id", "root_id")}


def with_vectors(rows: DataFrame, vectors: DataFrame, position: str, name: str) -> DataFrame:
    """Adds each row's vector by position: vectors (id, vector); rows without one are left out.

    The join is on the id itself, never on the order in which rows are read.
    """
    return rows.join(vectors.select(F.col("id").alias(position), F.col("vector").alias(name)), position)


def first_rows(rows: DataFrame, position: str, most: int | None = None, start: int = 0) -> DataFrame:
    """Rows at positions start, start + 1, ..., at most so many: a filter on the position, so nothing is sorted."""
    kept = rows.filter(F.col(position) >= start)
    return kept if most is None else kept.filter(F.col(position) < start + most)


def write_bundle(path: str, leaves: DataFrame, clusters: DataFrame, edges: DataFrame) -> None:
    """The three tables as Parquet below path; leaves and edges are clustered by id."""
    for name, rows in zip(TABLES, (leaves, clusters, edges)):
        by = ["level", "id"] if name == "clusters" else ["id"]
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def bundle_sizes(bundle: dict[str, DataFrame]) -> DataFrame:
    """(part, n): leaves, which are the vectors in use, and clusters of each level; each leaf counts once."""
    leaves = bundle["leaves"].agg(F.lit("leaves").alias("part"), F.count("*").alias("n"))
    return leaves.unionByName(bundle["clusters"].groupBy(F.col("level").alias("part")).agg(F.count("*").alias("n")))
