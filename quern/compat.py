"""Null, white-space, hash-order and lineage helpers that both engines agree on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as Unicode has it, in the regular expressions of Spark and of DuckDB.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
WS_SQL = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


_SCRATCH: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor of the cluster reaches.

    Without that setting a local session (tests) takes a folder of this machine; any other raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/quern-checkpoints-{os.getuid()}"
    path = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes every folder that shared_dir gave to this application, once the caller has used the
    results that are read from them; returns how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a table in the cluster's shared folder, read back: lineage ends here, and a lost executor costs no more than one read."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is evaluated once, however often use names it: it is bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def or_default(c: Column, default: Column | str | None) -> Column:
    """The value, or default where it is null or empty. The value is evaluated once."""
    if isinstance(default, str) and default == "":
        return F.coalesce(c, F.lit(""))
    return F.coalesce(F.try_element_at(F.filter(F.array(c), lambda x: x != ""), F.lit(1)), F.lit(default) if isinstance(default, str) or default is None else default)


def hash_order(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible random order: md5 of the seed and the columns, as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c) if isinstance(c, str) else c for c in cols]))
