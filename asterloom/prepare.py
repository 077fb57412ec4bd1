"""Prepares a star from pipe-separated text: read, encode, cut into segments by order date, write Parquet and a zone map.

    python -m asterloom.prepare SOURCE TARGET
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec
from .operators.segments import SEGMENT_ROWS, with_segments, zone_map
from .sources.prepared import ZONE_COLUMNS
from .sources.star import TEXT_COLUMNS, read_text, write_columns


def encode(df: DataFrame, name: str) -> DataFrame:
    """The text columns that have codes, as codes, and as text under names that end in _text; the others stay."""
    coded = {"customer": ("c_city", "c_nation", "c_region"), "supplier": ("s_city", "s_nation", "s_region"), "part": ("p_mfgr", "p_category", "p_brand1")}
    df = df.withColumns({f"{c}_text": F.col(c) for c in coded.get(name, ())})
    if name in ("customer", "supplier"):
        p = name[0]
        return df.withColumns({f"{p}_city": codec.encode_city(F.col(f"{p}_city"), F.col(f"{p}_nation")), f"{p}_nation": codec.encode_nation(F.col(f"{p}_nation")), f"{p}_region": codec.encode_region(F.col(f"{p}_region"))})
    if name == "part":
        return df.withColumns({"p_mfgr": codec.encode_mfgr(F.col("p_mfgr")), "p_category": codec.encode_category(F.col("p_category")), "p_brand1": codec.encode_brand(F.col("p_brand1"))})
    return df


def prepare(spark: SparkSession, source: str, target: str, *, segment_rows: int = SEGMENT_ROWS, header: bool = False) -> None:
    """Reads ``source``/NAME.tbl and writes ``target``/NAME.parquet, and zones.parquet for the segments of the fact table."""
    for name in TEXT_COLUMNS:
        df = encode(read_text(spark, f"{source}/{name}.tbl", name, header=header), name)
        if name != "lineorder":
            write_columns(df, f"{target}/{name}.parquet")
            continue
        cut = with_segments(df, "lo_orderdate", segment_rows)
        # A segment is one file, sorted; its rows are bounded, so a task's are too.
        dealt = cut.repartitionByRange("segment_id").sortWithinPartitions("segment_id", "lo_orderdate", "lo_orderkey", "lo_linenumber")
        dealt.write.mode("overwrite").partitionBy("segment_id").parquet(f"{target}/lineorder.parquet")
    fact = spark.read.parquet(f"{target}/lineorder.parquet")
    write_columns(zone_map(fact, ZONE_COLUMNS), f"{target}/zones.parquet")


if __name__ == "__main__":
    prepare(SparkSession.builder.getOrCreate(), *sys.argv[1:3])
