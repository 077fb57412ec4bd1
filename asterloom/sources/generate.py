"""Makes a star of the benchmark's tables at any scale, as DataFrames or pipe-separated text.

    python -m asterloom.sources.generate SCALE TARGET

Every value is a hash of its row's number, so tables are the same whatever the
number of tasks, and no table passes through the driver.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from .star import TEXT_COLUMNS, text_schema

#: Rows at scale 1 and the calendar.
ORDERS, CUSTOMERS, SUPPLIERS, PARTS, MOST_LINES = 1_500_000, 30_000, 2_000, 200_000, 7
FIRST_DAY, DAYS, ORDER_DAYS = "1992-01-01", 2557, 2406
SEASONS, SEGMENTS = ("Winter", "Spring", "Summer", "Fall", "Christmas"), ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PRIORITIES, MODES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECI", "5-LOW"), ("AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK")
COLORS = ("almond", "azure", "blue", "coral", "green", "ivory", "navy", "plum", "red", "tan")


def _draw(n: int, salt: str, *of: Column) -> Column:
    """0 to n - 1."""
    return F.pmod(F.xxhash64(F.lit(salt), *of), F.lit(n)).cast("int")


def _one(names: tuple[str, ...], salt: str, *of: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), _draw(len(names), salt, *of) + 1)


def _day(i: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY).cast("date"), i)


def _key(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def _counts(scale: float) -> dict[str, int]:
    many = lambda n: max(1, round(n * scale))
    return {"orders": many(ORDERS), "customer": many(CUSTOMERS), "supplier": many(SUPPLIERS), "part": PARTS * (1 + int(math.log2(scale))) if scale >= 1 else many(PARTS)}


def _price(part: Column) -> Column:
    return 90_000 + F.pmod(F.floor(part / 10), F.lit(20_001)) + 100 * F.pmod(part, F.lit(1_000))


def _place(spark: SparkSession, p: str, n: int, title: str) -> DataFrame:
    k, nation = F.col("id") + 1, codec.decode_nation(F.col("code"))
    rows = spark.range(n).withColumn("code", _draw(25, p + "nation", F.col("id")))
    region = F.element_at(F.array(*(F.lit(codec.REGIONS[r]) for r in NATION_REGION)), F.col("code") + 1)
    return rows.select(
        k.cast("int").alias("key"), F.concat(F.lit(f"{title}#"), F.lpad(k.cast("string"), 9, "0")).alias("name"), F.substring(F.md5(F.concat(F.lit(p), k.cast("string"))), 1, 12).alias("address"),
        codec.decode_city(F.col("code") * 10 + _draw(10, p + "city", F.col("id"))).alias("city"), nation.alias("nation"), region.alias("region"),
        F.concat_ws("-", F.col("code") + 10, *(_draw(900, f"{p}phone{i}", F.col("id")) + 100 for i in range(2))).alias("phone"), _one(SEGMENTS, "segment", F.col("id")).alias("mktsegment"),
    )


#: The region of each nation, in code order.
NATION_REGION = (0, 1, 1, 1, 4, 0, 3, 3, 2, 2, 4, 4, 2, 4, 0, 0, 0, 1, 2, 3, 4, 2, 3, 3, 1)


def generate(spark: SparkSession, scale: float) -> dict[str, DataFrame]:
    """The five tables, with the columns of the text files."""
    n = _counts(scale)
    i = F.col("id")
    places = {t: _place(spark, t, n[t], t.capitalize()) for t in ("customer", "supplier")}
    out = {t: df.select(*(F.col(c).alias(f"{t[0]}_{c if c != 'key' else ('custkey' if t == 'customer' else 'suppkey')}") for c in df.columns if t == "customer" or c != "mktsegment")) for t, df in places.items()}
    code = _draw(1000, "brand", i)
    out["part"] = spark.range(n["part"]).select(
        (i + 1).cast("int").alias("p_partkey"), F.concat_ws(" ", _one(COLORS, "name1", i), _one(COLORS, "name2", i)).alias("p_name"), codec.decode_mfgr(F.floor(code / 200)).alias("p_mfgr"),
        codec.decode_category(F.floor(code / 40)).alias("p_category"), codec.decode_brand(code).alias("p_brand1"), _one(COLORS, "color", i).alias("p_color"),
        F.concat(F.lit("TYPE "), _draw(150, "type", i).cast("string")).alias("p_type"), (_draw(50, "size", i) + 1).alias("p_size"), F.concat(F.lit("BOX "), _draw(40, "box", i).cast("string")).alias("p_container"),
    )
    d = _day(F.col("id").cast("int"))
    flag = lambda c: F.when(c, 1).otherwise(0).cast("string")
    out["ddate"] = spark.range(DAYS).select(
        _key(d).alias("d_datekey"), F.date_format(d, "MMMM d, yyyy").alias("d_date"), F.date_format(d, "EEEE").alias("d_dayofweek"), F.date_format(d, "MMMM").alias("d_month"), F.year(d).alias("d_year"),
        (F.year(d) * 100 + F.month(d)).alias("d_yearmonthnum"), F.date_format(d, "MMMyyyy").alias("d_yearmonth"), F.dayofweek(d).alias("d_daynuminweek"), F.dayofmonth(d).alias("d_daynuminmonth"), F.dayofyear(d).alias("d_daynuminyear"),
        F.month(d).alias("d_monthnuminyear"), F.floor((F.dayofyear(d) - 1) / 7 + 1).cast("int").alias("d_weeknuminyear"), F.element_at(F.array(*map(F.lit, SEASONS)), F.when(F.month(d) == 12, 5).otherwise(F.floor(F.pmod(F.month(d), F.lit(12)) / 3) + 1).cast("int")).alias("d_sellingseason"),
        flag(F.dayofweek(d) == 7).alias("d_lastdayinweekfl"), flag(F.last_day(d) == d).alias("d_lastdayinmonthfl"), flag((F.month(d) == 12) & (F.dayofmonth(d) == 25)).alias("d_holidayfl"), flag(F.dayofweek(d).between(2, 6)).alias("d_weekdayfl"),
    )
    order = spark.range(n["orders"]).select((i + 1).cast("int").alias("o"), _draw(n["customer"], "cust", i).alias("c"), _draw(ORDER_DAYS, "day", i).alias("day"), F.explode(F.sequence(F.lit(1), _draw(MOST_LINES, "lines", i) + 1)).alias("line"))
    row = (F.col("o"), F.col("line"))
    order = order.withColumns({"p": _draw(n["part"], "part", *row) + 1, "q": _draw(50, "quantity", *row) + 1, "disc": _draw(11, "discount", *row)})
    price = (F.col("q") * _price(F.col("p"))).cast("int")
    out["lineorder"] = order.select(
        F.col("o").alias("lo_orderkey"), F.col("line").alias("lo_linenumber"), (F.col("c") + 1).alias("lo_custkey"), F.col("p").alias("lo_partkey"), (_draw(n["supplier"], "supp", *row) + 1).alias("lo_suppkey"),
        _key(_day(F.col("day"))).alias("lo_orderdate"), _one(PRIORITIES, "priority", F.col("o")).alias("lo_orderpriority"), F.lit("0").alias("lo_shippriority"), F.col("q").alias("lo_quantity"), price.alias("lo_extendedprice"),
        price.alias("lo_ordtotalprice"), F.col("disc").alias("lo_discount"), F.floor(price.cast("long") * (100 - F.col("disc")) / 100).cast("int").alias("lo_revenue"), F.floor(_price(F.col("p")) * 6 / 10).cast("int").alias("lo_supplycost"),
        _draw(9, "tax", *row).alias("lo_tax"), _key(_day(F.col("day") + 30 + _draw(61, "commit", *row))).alias("lo_commitdate"), _one(MODES, "mode", *row).alias("lo_shipmode"),
    )
    return {t: df.select(*(F.col(c).cast(text_schema(t)[c].dataType) for c in text_schema(t).names)) for t, df in out.items()}


def write_text(tables: dict[str, DataFrame], target: str) -> None:
    """Pipe-separated files; each line ends in a separator."""
    for name, df in tables.items():
        assert df.columns == [c.split(":")[0] for c in TEXT_COLUMNS[name].split()]
        df.select(F.concat(F.concat_ws("|", *df.columns), F.lit("|")).alias("line")).write.mode("overwrite").text(f"{target}/{name}.tbl")


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    write_text(generate(session, float(sys.argv[1])), sys.argv[2])
