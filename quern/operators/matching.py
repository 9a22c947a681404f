"""Order-dependent de-duplication: a row is kept only if no earlier kept row used either of its ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.compat import written


#: Rows that one task scans in order.
SCAN_ROWS = 200_000


def _scanned(rows: DataFrame, order: str, ends: tuple[str, str]) -> DataFrame:
    """What a scan of rows keeps, in one task; the caller bounds the rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: set = set()
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(c).to_pylist() for c in ends)):
                keep.append(x not in used and y not in used)
                if keep[-1]:
                    used |= {x, y}
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(1).sortWithinPartitions(order).mapInArrow(scan, rows.schema)


def first_come_matching(edges: DataFrame, order: str = "rid", ends: tuple[str, str] = ("head", "tail"), scan_rows: int = SCAN_ROWS) -> DataFrame:
    """The rows that a scan in the given order keeps, found in parallel rounds.

    In each round a row is kept if it is the earliest undecided row at both of its ends; the rows
    that share an end with it go. Minima are aggregated on the map side, and the table between rounds
    is written, so lineage stays short. Once scan_rows rows or fewer are left, one task scans them; a
    round that settles less than half of its rows, as on a long chain, is followed by such a scan of
    the earliest scan_rows rows. order must be unique; rows with a null end are dropped.
    """
    a, b = ends
    left = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), "matching")
    kept, size = edges.limit(0), left.count()

    def settled(left: DataFrame, winners: DataFrame) -> DataFrame:
        used = winners.select(F.col(a).alias("used")).unionByName(winners.select(F.col(b).alias("used"))).distinct()
        return written(left.join(used, F.col(a) == F.col("used"), "left_anti").join(used, F.col(b) == F.col("used"), "left_anti"), "matching")

    while size > scan_rows:
        points = left.select(F.col(a).alias("end"), order).unionByName(left.select(F.col(b).alias("end"), order))
        first = points.groupBy("end").agg(F.min(order).alias("first"))
        at_a, at_b = (first.select(F.col("end").alias(e), F.col("first").alias(f"_{k}")) for k, e in enumerate((a, b)))
        winners = written(left.join(at_a, a).join(at_b, b).filter((F.col("_0") == F.col(order)) & (F.col("_1") == F.col(order))).select(left.columns), "matching")
        kept, left = kept.unionByName(winners), settled(left, winners)
        before, size = size, left.count()
        if size > scan_rows and 2 * size > before:
            # All rows before these are settled, so a scan of them alone is right.
            early = written(left.orderBy(order).limit(scan_rows), "matching")
            last = early.agg(F.max(order)).first()[0]
            winners = written(_scanned(early, order, ends), "matching")
            kept, left = kept.unionByName(winners), settled(left.filter(F.col(order) > last), winners)
            size = left.count()
    return kept.unionByName(written(_scanned(left, order, ends), "matching")) if size else kept
