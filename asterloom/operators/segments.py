"""Segments, zone maps and segment skipping.

A segment is ``rows`` consecutive rows of a table in date order.  Positions
come from counts per day, counts per range of the next column within a day, and
a sort within such a range, so neither the table nor a day is sorted in one task.  A zone map holds each segment's least and greatest value; a
predicate whose range misses it cannot pass there, so the segment is skipped.
Skipping is only ever a hint: the predicate itself is applied too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import Pred, select

SEGMENT_ROWS = 1 << 20
#: Order keys of a day that are ranked together.
RANGE_WIDTH = 1 << 24


def with_segments(df: DataFrame, by: str, rows: int = SEGMENT_ROWS, width: int = RANGE_WIDTH) -> DataFrame:
    """``df`` with segment_id: its position in the order of ``by`` and all other columns, over ``rows``.

    The first of the other columns is cut into ranges of ``width`` if it is a whole number.
    """
    rest = [c for c in df.columns if c != by]
    whole = bool(rest) and df.schema[rest[0]].dataType.typeName() in ("byte", "short", "integer", "long")
    df = df.withColumn("_range", F.floor(F.col(rest[0]) / width) if whole else F.lit(0).cast("bigint"))
    up_to = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = df.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    days = ranges.groupBy(by).agg(F.sum("_n").alias("_n")).select(F.col(by).alias("_by"), up_to(Window.orderBy(by)).alias("_days"))  # a row a day
    starts = ranges.withColumn("_before", up_to(Window.partitionBy(by).orderBy("_range"))).join(days, F.col(by).eqNullSafe(F.col("_by")))
    starts = starts.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), (F.col("_days") + F.col("_before")).alias("_start"))
    placed = df.join(starts, F.col(by).eqNullSafe(F.col("_by")) & F.col("_range").eqNullSafe(F.col("_of")))
    at = F.col("_start") + F.row_number().over(Window.partitionBy(by, "_range").orderBy(*rest)) - 1
    return placed.withColumn("segment_id", F.floor(at / rows).cast("bigint")).select(*(c for c in df.columns if c != "_range"), "segment_id")


def zone_map(segmented: DataFrame, columns: Sequence[str]) -> DataFrame:
    """segment_id, n_rows and the least and greatest value of each column."""
    return segmented.groupBy("segment_id").agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("min", F.min), ("max", F.max))])


def may_pass(preds: Sequence[Pred]):
    """Whether a segment's zone may hold a row that passes; open ranges never rule one out on their open side."""
    keep = F.lit(True)
    for p in preds:
        low, high = F.col(f"{p.column}_min"), F.col(f"{p.column}_max")
        if b := p.bounds():
            keep = keep & (high >= b[0]) & (low <= b[1])
        elif p.op in ("lt", "lte"):
            keep = keep & (low < p.values[0] if p.op == "lt" else low <= p.values[0])
        else:
            keep = keep & (high > p.values[0] if p.op == "gt" else high >= p.values[0])
    return keep


def skip(segmented: DataFrame, zones: DataFrame, preds: Sequence[Pred]) -> DataFrame:
    """The rows that pass, read from the segments whose zone may hold one."""
    kept = zones.filter(may_pass(preds)).select("segment_id")
    return select(segmented.join(kept, "segment_id", "left_semi"), *preds).select(*segmented.columns)


def skip_report(zones: DataFrame, preds: Sequence[Pred]) -> DataFrame:
    """segments, skipped, rows_skipped."""
    gone = ~may_pass(preds)
    return zones.agg(F.count("*").alias("segments"), F.count_if(gone).alias("skipped"), F.coalesce(F.sum(F.when(gone, F.col("n_rows"))), F.lit(0)).alias("rows_skipped"))
