"""A prepared star: coded dimensions, and a fact table of which each segment is a folder.

``asterloom.prepare`` writes it.  A reader prunes segments by the zone map
before the scan is planned, so segments that can't hold a row are never opened;
the predicates themselves are applied all the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import Pred
from ..operators.segments import may_pass

#: Segments up to this number are named to the scan; beyond it the zone map is joined, which prunes at run time.
LISTED = 10_000
ZONE_COLUMNS = ("lo_orderdate", "lo_quantity", "lo_discount")


class PreparedStar:
    """The tables in a folder that ``prepare`` has written; it stands where a ``Star`` may stand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def zones(self) -> DataFrame:
        return self.table("zones")

    def lineorder(self, columns: Iterable[str] | None = None, dates: tuple[int, int] | None = None, preds: Sequence[Pred] = ()) -> DataFrame:
        """Fact rows of the segments that may hold rows of ``dates`` (inclusive day keys) that pass ``preds``."""
        rows = self.table("lineorder")
        known = [*preds, *([Pred("lo_orderdate", "between", dates)] if dates else [])]
        checked = [p for p in known if p.column in ZONE_COLUMNS]
        if checked:
            kept = self.zones().filter(may_pass(checked)).select("segment_id")
            listed = [r.segment_id for r in kept.limit(LISTED + 1).collect()]
            if len(listed) > LISTED:
                rows = rows.join(kept, "segment_id", "left_semi")
            elif listed:
                root = f"{self.folder}/lineorder.parquet"
                rows = self.spark.read.schema(rows.schema).option("basePath", root).parquet(*(f"{root}/segment_id={i}" for i in sorted(listed)))
            else:
                rows = rows.limit(0)
        if dates:
            rows = rows.filter(F.col("lo_orderdate").between(*dates))
        return rows.select(*columns) if columns is not None else rows.drop("segment_id")

    def dimension(self, name: str) -> DataFrame:
        return self.table(name)
