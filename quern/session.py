"""Session defaults, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "quern", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI mode, AQE; conf may override any of it (dots written as __)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


#: HotSpot leaves methods over so many bytes of code to its interpreter. A stage with one is better off
#: without whole-stage code, whose expressions are then compiled in pieces.
HUGE_METHOD = ("spark.sql.codegen.hugeMethodLimit", "8000")


def ship_code(spark: SparkSession) -> None:
    """Once an application: the package as a zip, so Python workers find it wherever they run.

    Also bounds the generated methods of the session, unless it has a bound of its own.
    """
    if spark.conf.get(HUGE_METHOD[0]) == "65535":  # Spark's default
        spark.conf.set(*HUGE_METHOD)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), "quern_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted(top.rglob("*.py")):
            out.write(p, str(p.relative_to(top.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)
