"""The star: schemas of the benchmark's tables, and star views over the snowflake test tables.

Keys: lo_orderdate, lo_partkey, lo_custkey and lo_suppkey refer to the four
dimensions.  Spark does not enforce keys; ``key_violations`` counts them.
Money is in integer units: prices in hundredths, revenue and supply cost in
hundredths of hundredths, so that a discount needs no division.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = {"lo_orderdate": ("ddate", "d_datekey"), "lo_partkey": ("part", "p_partkey"), "lo_custkey": ("customer", "c_custkey"), "lo_suppkey": ("supplier", "s_suppkey")}

#: Columns of the pipe-separated text files, in file order; i is int, s is string.
TEXT_COLUMNS = {
    "lineorder": "lo_orderkey:i lo_linenumber:i lo_custkey:i lo_partkey:i lo_suppkey:i lo_orderdate:i lo_orderpriority:s lo_shippriority:s lo_quantity:i lo_extendedprice:i lo_ordtotalprice:i lo_discount:i lo_revenue:i lo_supplycost:i lo_tax:i lo_commitdate:i lo_shipmode:s",
    "part": "p_partkey:i p_name:s p_mfgr:s p_category:s p_brand1:s p_color:s p_type:s p_size:i p_container:s",
    "supplier": "s_suppkey:i s_name:s s_address:s s_city:s s_nation:s s_region:s s_phone:s",
    "customer": "c_custkey:i c_name:s c_address:s c_city:s c_nation:s c_region:s c_phone:s c_mktsegment:s",
    "ddate": "d_datekey:i d_date:s d_dayofweek:s d_month:s d_year:i d_yearmonthnum:i d_yearmonth:s d_daynuminweek:i d_daynuminmonth:i d_daynuminyear:i d_monthnuminyear:i d_weeknuminyear:i d_sellingseason:s d_lastdayinweekfl:s d_lastdayinmonthfl:s d_holidayfl:s d_weekdayfl:s",
}


def text_schema(name: str) -> T.StructType:
    kinds = {"i": T.IntegerType(), "s": T.StringType()}
    return T.StructType([T.StructField(c.split(":")[0], kinds[c.split(":")[1]], False) for c in TEXT_COLUMNS[name].split()])


def read_text(spark: SparkSession, path: str, name: str, sep: str = "|", *, header: bool = False) -> DataFrame:
    """A text table; the separator that ends each line is no column, nor is a first line of names, with ``header``, a row."""
    schema = text_schema(name)
    return spark.read.schema(schema.add("_end", T.StringType())).option("sep", sep).option("header", header).option("enforceSchema", True).option("mode", "FAILFAST").csv(path).drop("_end")


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_columns(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def key_violations(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """fk, orphans (fact rows without a dimension row), repeated (dimension keys that repeat), for the keys that ``fact`` has."""
    out = None
    for fk, (table, pk) in KEYS.items():
        if fk in fact.columns and table in dims:
            orphans = fact.join(dims[table].select(F.col(pk).alias(fk)), fk, "left_anti").agg(F.count("*").alias("orphans"))
            repeated = dims[table].groupBy(pk).count().filter("count > 1").agg(F.count("*").alias("repeated"))
            both = orphans.select("orphans", F.lit(0).cast("long").alias("repeated")).unionByName(repeated.select(F.lit(0).cast("long").alias("orphans"), "repeated"))
            row = both.agg(F.sum("orphans").alias("orphans"), F.sum("repeated").alias("repeated")).select(F.lit(fk).alias("fk"), "orphans", "repeated")
            out = row if out is None else out.unionByName(row)
    return out


def _date_key(c):
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


class Star:
    """Star views over the snowflake tables in a folder, made of the columns that a query names."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lineorder(self, columns: Iterable[str] | None = None, dates: tuple[int, int] | None = None, preds: Sequence = ()) -> DataFrame:
        """Fact rows.  ``part`` is joined for the supply cost only, ``orders`` for its columns or ``dates`` only: every line item has its order.

        ``dates``, inclusive day keys, also become a range on the order's timestamp, which reaches the scan; ``preds`` are no use here.
        """
        orders = self.table("orders")
        if dates:
            day = lambda k: F.make_timestamp(*(F.lit(x) for x in (k // 10000, k // 100 % 100, k % 100, 0, 0, 0)))
            orders = orders.filter((F.col("o_orderdate") >= day(dates[0])) & (F.col("o_orderdate") < day(dates[1]) + F.expr("INTERVAL 1 DAY")))
        rows = self.table("lineitem")
        quantity, discount = F.round("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int")
        price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        known = {
            "lo_orderkey": F.col("l_orderkey"), "lo_linenumber": F.col("l_linenumber"), "lo_custkey": F.col("o_custkey"), "lo_partkey": F.col("l_partkey"),
            "lo_suppkey": F.col("l_suppkey"), "lo_orderdate": _date_key(F.col("o_orderdate")), "lo_quantity": quantity, "lo_discount": discount,
            "lo_extendedprice": price, "lo_revenue": price * (100 - discount),
        }
        wanted = list(columns) if columns is not None else [*known, "lo_supplycost"]
        if dates or {"lo_custkey", "lo_orderdate"} & set(wanted):
            rows = rows.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        if "lo_supplycost" in wanted:
            rows = rows.join(self.table("part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
            known["lo_supplycost"] = quantity * F.round(F.col("p_retailprice") * 60).cast("bigint") * 100
        return rows.select(*[known[c].alias(c) for c in wanted])

    def _place(self, table: str, p: str) -> DataFrame:
        rows = self.table(table).join(self.table("nation"), F.col(f"{p}_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        digit = F.pmod(F.col(f"{p}_{table[:4]}key"), F.lit(10)).cast("int")
        return rows.select(
            F.col(f"{p}_{table[:4]}key"), (F.col("n_nationkey") * 10 + digit).cast("int").alias(f"{p}_city"), F.col("n_nationkey").alias(f"{p}_nation"), F.col("n_regionkey").alias(f"{p}_region"),
            F.concat(F.rpad("n_name", 9, " "), digit.cast("string")).alias(f"{p}_city_text"), F.col("n_name").alias(f"{p}_nation_text"), F.col("r_name").alias(f"{p}_region_text"),
        )

    def customer(self) -> DataFrame:
        return self._place("customer", "c")

    def supplier(self) -> DataFrame:
        return self._place("supplier", "s")

    def part(self) -> DataFrame:
        from ..functions import codec

        n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") - 1
        rows = self.table("part").select("p_partkey", n.alias("p_category"), F.floor(n / 5).cast("int").alias("p_mfgr"), (n * 40 + F.pmod("p_partkey", F.lit(40)).cast("int")).cast("int").alias("p_brand1"))
        return rows.select("*", codec.decode_mfgr(F.col("p_mfgr")).alias("p_mfgr_text"), codec.decode_category(F.col("p_category")).alias("p_category_text"), codec.decode_brand(F.col("p_brand1")).alias("p_brand1_text"))

    def ddate(self) -> DataFrame:
        """All days from the first order's to the last one's: two values of the scan, which Parquet's statistics give, and no exchange of orders."""
        day = F.to_date("o_orderdate")
        ends = self.table("orders").agg(F.min(day).alias("first"), F.max(day).alias("last"))
        return (
            ends.filter("first is not null").select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))).alias("d"))
            .select(_date_key(F.col("d")).alias("d_datekey"), F.year("d").alias("d_year"), (F.year("d") * 100 + F.month("d")).cast("int").alias("d_yearmonthnum"), F.date_format("d", "MMMyyyy").alias("d_yearmonth"), F.floor((F.dayofyear("d") - 1) / 7 + 1).cast("int").alias("d_weeknuminyear"))
        )

    def dimension(self, name: str) -> DataFrame:
        return getattr(self, name)()


_PLACE_SQL = """{t} AS (
  SELECT {k}, cast(n_nationkey * 10 + {k} % 10 AS integer) AS {p}_city, n_nationkey AS {p}_nation, n_regionkey AS {p}_region,
         rpad(n_name, 9, ' ') || cast({k} % 10 AS varchar) AS {p}_city_text, n_name AS {p}_nation_text, r_name AS {p}_region_text
  FROM {s} JOIN nation ON {p}_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: The views as SQL; they stand under names of their own beside the tables they are made of.
VIEWS_SQL = ",\n".join([
    """lineorder AS (
  SELECT l_orderkey AS lo_orderkey, l_linenumber AS lo_linenumber, o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
         cast(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS integer) AS lo_orderdate,
         cast(round(l_quantity) AS integer) AS lo_quantity, cast(round(l_discount * 100) AS integer) AS lo_discount,
         cast(round(l_extendedprice * 100) AS bigint) AS lo_extendedprice,
         cast(round(l_extendedprice * 100) AS bigint) * (100 - cast(round(l_discount * 100) AS integer)) AS lo_revenue,
         cast(round(l_quantity) AS integer) * cast(round(p_retailprice * 60) AS bigint) * 100 AS lo_supplycost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    _PLACE_SQL.format(t="star_customer", s="customer", k="c_custkey", p="c"),
    _PLACE_SQL.format(t="star_supplier", s="supplier", k="s_suppkey", p="s"),
    """star_part AS (
  SELECT p_partkey, n AS p_category, n // 5 AS p_mfgr, cast(n * 40 + p_partkey % 40 AS integer) AS p_brand1,
         'MFGR#' || (n // 5 + 1) AS p_mfgr_text, 'MFGR#' || (n // 5 + 1) || (n % 5 + 1) AS p_category_text,
         'MFGR#' || (n // 5 + 1) || (n % 5 + 1) || (p_partkey % 40 + 1) AS p_brand1_text
  FROM (SELECT p_partkey, cast(regexp_extract(p_brand, '([0-9]+)', 1) AS integer) - 1 AS n FROM part))""",
    """star_ddate AS (
  SELECT cast(year(d) * 10000 + month(d) * 100 + day(d) AS integer) AS d_datekey, cast(year(d) AS integer) AS d_year,
         cast(year(d) * 100 + month(d) AS integer) AS d_yearmonthnum, strftime(d, '%b%Y') AS d_yearmonth, cast((dayofyear(d) - 1) // 7 + 1 AS integer) AS d_weeknuminyear
  FROM (SELECT cast(unnest(generate_series(min(cast(o_orderdate AS date)), max(cast(o_orderdate AS date)), INTERVAL 1 DAY)) AS date) AS d FROM orders))""",
])
