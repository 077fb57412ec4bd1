"""The registered queries: star queries in both forms, and one entry for each operator, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.scalar import linear, product, sigmoid, square
from ..operators import segments
from ..operators.relational import DimJoin, Pred, all_of, any_of, group_sum, partitioned_join, scalar_sum, select, semi_join, sort_table, star_join
from ..sources.star import VIEWS_SQL, Star
from .spec import compile_df, compile_sql
from .ssb import in_text, specs

Query = Callable[[SparkSession, str], DataFrame]
SEGMENT = 8192


def _fact(s, d, *columns):
    return Star(s, d).lineorder(columns)


def _filter(name: str, preds: list[Pred], either: bool = False) -> tuple[str, Query, str]:
    columns = tuple(dict.fromkeys(["lo_orderkey", "lo_partkey", *(p.column for p in preds)]))
    sql = f"WITH {VIEWS_SQL} SELECT {', '.join(columns)} FROM lineorder WHERE {(' OR ' if either else ' AND ').join(p.sql() for p in preds)}"
    return name, lambda s, d: _fact(s, d, *columns).filter((any_of if either else all_of)(preds)), sql


def _joins(n: int) -> tuple[str, Query, str]:
    dims = [DimJoin("supplier", "lo_suppkey", "s_suppkey", (Pred("s_region", "eq", (1,)),), ("s_nation",)), DimJoin("customer", "lo_custkey", "c_custkey", (), ("c_nation",)),
            DimJoin("part", "lo_partkey", "p_partkey", (Pred("p_mfgr", "in", (0, 1)),), ("p_category",)), DimJoin("ddate", "lo_orderdate", "d_datekey", (), ("d_year",))][:n]
    keys = [c for j in dims for c in j.carry]

    def run(s, d):
        star = Star(s, d)
        return star_join(star.lineorder(["lo_orderkey", "lo_revenue", *(j.fk for j in dims)]), [(j, star.dimension(j.table)) for j in dims]).select("lo_orderkey", "lo_revenue", *keys)

    where = [f"{j.fk} = {j.pk}" for j in dims] + [p.sql() for j in dims for p in j.preds]
    return f"join_inner_{n}", run, f"WITH {VIEWS_SQL} SELECT lo_orderkey, lo_revenue, {', '.join(keys)} FROM lineorder, {', '.join('star_' + j.table for j in dims)} WHERE {' AND '.join(where)}"


def _groups(n: int) -> tuple[str, Query, str]:
    keys = ["lo_discount", "lo_quantity", "lo_suppkey", "lo_linenumber"][:n]
    sql = f"WITH {VIEWS_SQL} SELECT {', '.join(keys)}, cast(sum(lo_revenue - lo_supplycost) AS bigint) AS profit FROM lineorder GROUP BY {', '.join(keys)}"
    return f"agg_group{n}", lambda s, d: group_sum(_fact(s, d, *keys, "lo_revenue", "lo_supplycost"), keys, F.col("lo_revenue") - F.col("lo_supplycost"), "profit"), sql


def _pair(s, d):
    star = Star(s, d)
    return star.lineorder(["lo_partkey", "lo_quantity"]).withColumnRenamed("lo_partkey", "key"), star.part().select(F.col("p_partkey").alias("key"), F.col("p_brand1").alias("val"))


_SEGMENTED_SQL = f"""seg AS (
  SELECT *, (row_number() OVER (ORDER BY lo_orderdate, lo_orderkey, lo_partkey, lo_suppkey, lo_quantity) - 1) // {SEGMENT} AS segment_id
  FROM (SELECT lo_orderdate, lo_orderkey, lo_partkey, lo_suppkey, lo_quantity FROM lineorder))"""
_SEGMENT_COLUMNS = ("lo_orderdate", "lo_orderkey", "lo_partkey", "lo_suppkey", "lo_quantity")
_SKIP = [Pred("lo_orderdate", "between", (19970101, 19971231)), Pred("lo_quantity", "lt", (25,))]


def _segmented(s, d):
    return segments.with_segments(_fact(s, d, *_SEGMENT_COLUMNS), "lo_orderdate", SEGMENT)


def _skipped(s, d):
    rows = _segmented(s, d)
    return segments.skip(rows, segments.zone_map(rows, ["lo_orderdate", "lo_quantity"]), _SKIP).drop("segment_id")


def _encoded(s, d):
    p = Star(s, d).part()
    c = Star(s, d).customer()
    coded = p.select(codec.encode_mfgr(F.col("p_mfgr_text")).alias("m"), codec.encode_category(F.col("p_category_text")).alias("c"), codec.encode_brand(F.col("p_brand1_text")).alias("b"))
    brands = coded.groupBy(F.col("m").alias("mfgr"), F.col("c").alias("category"), F.col("b").alias("brand")).agg(F.count("*").alias("n_rows"))
    regions = c.groupBy(codec.encode_region(F.col("c_region_text")).alias("mfgr")).agg(F.count("*").alias("n_rows"))
    return brands.unionByName(regions.select("mfgr", F.lit(-1).alias("category"), F.lit(-1).alias("brand"), "n_rows"))


def _places(s, d):
    """Nation and city codes back and forth; the test tables' nations are not the benchmark's, so codes are where it starts."""
    c = Star(s, d).customer().select((F.pmod("c_custkey", F.lit(25))).cast("int").alias("code"), F.pmod("c_custkey", F.lit(10)).cast("int").alias("digit"))
    city = codec.decode_city(F.col("code") * 10 + F.col("digit"))
    named = c.select(codec.decode_nation(F.col("code")).alias("nation"), city.alias("city"))
    return named.groupBy("nation", "city", codec.encode_nation(F.col("nation")).alias("nation_code"), codec.encode_city(F.col("city"), F.col("nation")).alias("city_code")).agg(F.count("*").alias("n_rows"))


_PLACES_SQL = f"""
WITH n AS (SELECT [{', '.join(f"'{x}'" for x in codec.NATIONS)}] AS names),
c AS (SELECT cast(c_custkey % 25 AS integer) AS nation_code, cast((c_custkey % 25) * 10 + c_custkey % 10 AS integer) AS city_code FROM customer)
SELECT names[nation_code + 1] AS nation, rpad(left(names[nation_code + 1], 9), 9, ' ') || (city_code % 10) AS city, nation_code, city_code, count(*) AS n_rows
FROM c, n GROUP BY ALL"""


def _entries() -> list[tuple[str, Query, str | None]]:
    v = f"WITH {VIEWS_SQL} "
    out: list[tuple[str, Query, str | None]] = []
    for spec in specs().values():
        forms = [spec] if spec.name == "ssb_p1" else [spec, in_text(spec)]
        out += [(f.name, lambda s, d, f=f: compile_df(f, Star(s, d)), compile_sql(f)) for f in forms]
    q, disc = "lo_quantity", "lo_discount"
    out += [
        _filter("filter_eq", [Pred(q, "eq", (7,))]), _filter("filter_in2", [Pred(q, "in", (7, 9))]), _filter("filter_between", [Pred(q, "between", (26, 35))]),
        _filter("filter_lt", [Pred(q, "lt", (5,))]), _filter("filter_lte", [Pred(q, "lte", (5,))]), _filter("filter_gt", [Pred(q, "gt", (45,))]), _filter("filter_gte", [Pred(q, "gte", (45,))]),
        _filter("filter_and", [Pred(q, "lt", (25,)), Pred(disc, "between", (1, 3))]), _filter("filter_or", [Pred(q, "eq", (1,)), Pred(disc, "eq", (10,))], either=True),
        *map(_joins, (1, 2, 3, 4)), *map(_groups, (1, 2, 3, 4)),
    ]
    out += [
        ("project_linear", lambda s, d: _fact(s, d, "lo_orderkey", q, disc).select("lo_orderkey", linear(F.col(q), F.col(disc)).alias("y")), v + "SELECT lo_orderkey, cast(2 * lo_quantity + 3 * lo_discount AS double) AS y FROM lineorder"),
        ("project_sigmoid", lambda s, d: _fact(s, d, "lo_orderkey", q, disc).select("lo_orderkey", F.round(sigmoid(F.col(q) / 50, F.col(disc) / 10), 6).alias("y")), v + "SELECT lo_orderkey, round(1 / (1 + exp(-(2 * (lo_quantity / 50) + 3 * (lo_discount / 10)))), 6) AS y FROM lineorder"),
        ("project_square", lambda s, d: _fact(s, d, "lo_orderkey", q).select("lo_orderkey", square(F.col(q).cast("bigint")).alias("y")), v + "SELECT lo_orderkey, cast(lo_quantity AS bigint) * lo_quantity AS y FROM lineorder"),
        ("join_semi_key", lambda s, d: semi_join(_fact(s, d, "lo_orderkey", "lo_suppkey"), Star(s, d).supplier(), "lo_suppkey", "s_suppkey", Pred("s_region", "eq", (2,))), v + "SELECT lo_orderkey, lo_suppkey FROM lineorder WHERE lo_suppkey IN (SELECT s_suppkey FROM star_supplier WHERE s_region = 2)"),
        ("join_sum_product", lambda s, d: scalar_sum((p := _pair(s, d))[0].join(p[1], "key"), product(F.col(q), F.col("val")), "total"), v + "SELECT cast(sum(cast(lo_quantity AS bigint) * p_brand1) AS bigint) AS total FROM lineorder JOIN star_part ON lo_partkey = p_partkey"),
        ("join_sum_add", lambda s, d: scalar_sum((p := _pair(s, d))[0].join(p[1], "key"), F.col(q).cast("bigint") + F.col("val"), "total"), v + "SELECT cast(sum(lo_quantity + p_brand1) AS bigint) AS total FROM lineorder JOIN star_part ON lo_partkey = p_partkey"),
        ("join_matches_checksum", lambda s, d: (p := _pair(s, d))[0].join(p[1], "key").agg(F.count("*").alias("matches"), F.sum(F.col("val").cast("bigint")).alias("checksum")), v + "SELECT count(*) AS matches, cast(sum(p_brand1) AS bigint) AS checksum FROM lineorder JOIN star_part ON lo_partkey = p_partkey"),
        ("join_partitioned", lambda s, d: partitioned_join(*_pair(s, d), "key").agg(F.count("*").alias("matches"), F.sum(F.col("val").cast("bigint")).alias("checksum")), v + "SELECT count(*) AS matches, cast(sum(p_brand1) AS bigint) AS checksum FROM lineorder JOIN star_part ON lo_partkey = p_partkey"),
        ("encode_places", _places, _PLACES_SQL),
        ("agg_sum_float", lambda s, d: Star(s, d).table("lineitem").agg(F.round(F.sum(F.col("l_extendedprice").cast("double") / 1000), 3).alias("total")), "SELECT round(sum(cast(l_extendedprice AS double) / 1000), 3) AS total FROM lineitem"),
        ("agg_sum", lambda s, d: scalar_sum(_fact(s, d, "lo_revenue"), F.col("lo_revenue"), "total"), v + "SELECT cast(sum(lo_revenue) AS bigint) AS total FROM lineorder"),
        ("agg_sum_product", lambda s, d: scalar_sum(_fact(s, d, "lo_extendedprice", disc), product(F.col("lo_extendedprice"), F.col(disc)), "total"), v + "SELECT cast(sum(lo_extendedprice * lo_discount) AS bigint) AS total FROM lineorder"),
        ("agg_count", lambda s, d: _fact(s, d, disc).groupBy(disc).agg(F.count("*").alias("n_rows")), v + "SELECT lo_discount, count(*) AS n_rows FROM lineorder GROUP BY lo_discount"),
        ("agg_min_max", lambda s, d: _fact(s, d, "lo_orderdate", q).agg(F.min("lo_orderdate").alias("first_day"), F.max("lo_orderdate").alias("last_day"), F.min(q).alias("least"), F.max(q).alias("most")), v + "SELECT min(lo_orderdate) AS first_day, max(lo_orderdate) AS last_day, min(lo_quantity) AS least, max(lo_quantity) AS most FROM lineorder"),
        ("select_columns", lambda s, d: select(_fact(s, d, "lo_orderkey", q, disc), Pred(disc, "gte", (2,)), Pred(disc, "lt", (4,))).select(q, disc), v + "SELECT lo_quantity, lo_discount FROM lineorder WHERE lo_discount >= 2 AND lo_discount < 4"),
        ("zone_map", lambda s, d: segments.zone_map(_segmented(s, d), ["lo_orderdate", q]), v + f", {_SEGMENTED_SQL} SELECT segment_id, count(*) AS n_rows, min(lo_orderdate) AS lo_orderdate_min, max(lo_orderdate) AS lo_orderdate_max, min(lo_quantity) AS lo_quantity_min, max(lo_quantity) AS lo_quantity_max FROM seg GROUP BY segment_id"),
        ("segment_skip", _skipped, v + "SELECT lo_orderdate, lo_orderkey, lo_partkey, lo_suppkey, lo_quantity FROM lineorder WHERE lo_orderdate BETWEEN 19970101 AND 19971231 AND lo_quantity < 25"),
        ("segment_skip_report", lambda s, d: segments.skip_report(segments.zone_map(_segmented(s, d), ["lo_orderdate", q]), _SKIP), v + f", {_SEGMENTED_SQL}, z AS (SELECT count(*) AS n, min(lo_orderdate) AS a, max(lo_orderdate) AS b, min(lo_quantity) AS c FROM seg GROUP BY segment_id) SELECT count(*) AS segments, count(*) FILTER (WHERE NOT (b >= 19970101 AND a <= 19971231 AND c < 25)) AS skipped, cast(coalesce(sum(n) FILTER (WHERE NOT (b >= 19970101 AND a <= 19971231 AND c < 25)), 0) AS bigint) AS rows_skipped FROM z"),
        ("encode_dims", _encoded, v + "SELECT cast(p_mfgr AS integer) AS mfgr, cast(p_category AS integer) AS category, cast(p_brand1 AS integer) AS brand, count(*) AS n_rows FROM star_part GROUP BY ALL UNION ALL SELECT cast(c_region AS integer), -1, -1, count(*) FROM star_customer GROUP BY c_region"),
        ("sort_keys", lambda s, d: _fact(s, d, "lo_extendedprice").orderBy("lo_extendedprice"), v + "SELECT lo_extendedprice FROM lineorder ORDER BY lo_extendedprice"),
        ("table_sort", lambda s, d: sort_table(_fact(s, d, "lo_orderdate", "lo_orderkey", "lo_revenue"), "lo_orderdate"), v + "SELECT lo_orderdate, lo_orderkey, lo_revenue FROM lineorder ORDER BY lo_orderdate"),
        ("date_dimension", lambda s, d: Star(s, d).ddate(), v + "SELECT * FROM star_ddate"),
    ]
    return out


def queries() -> dict[str, Query]:
    return {name: run for name, run, _ in _entries()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _entries() if sql}
