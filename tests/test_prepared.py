"""Generated tables, prepared and queried, against the benchmark's queries as literal SQL over the text."""

import duckdb
import pytest
from pyspark.sql import functions as F

from asterloom.functions.codec import NATIONS
from asterloom.operators.relational import Pred
from asterloom.operators.segments import with_segments
from asterloom.plans.spec import compile_df
from asterloom.plans.ssb import in_text, specs
from asterloom.prepare import prepare
from asterloom.sources.generate import generate, write_text
from asterloom.sources.prepared import PreparedStar
from asterloom.sources.star import Star, key_violations, read_text

JOIN = {"d": "lo_orderdate = d_datekey", "c": "lo_custkey = c_custkey", "s": "lo_suppkey = s_suppkey", "p": "lo_partkey = p_partkey"}
KINGDOM = "in ('UNITED KI1', 'UNITED KI5')"
#: Tables joined, keys, measure and the other predicates of each query, as the benchmark words them.
QUERIES = {
    "11": ("d", "", "lo_extendedprice * lo_discount", "d_year = 1993 and lo_discount between 1 and 3 and lo_quantity < 25"),
    "12": ("d", "", "lo_extendedprice * lo_discount", "d_yearmonthnum = 199401 and lo_discount between 4 and 6 and lo_quantity between 26 and 35"),
    "13": ("d", "", "lo_extendedprice * lo_discount", "d_weeknuminyear = 6 and d_year = 1994 and lo_discount between 5 and 7 and lo_quantity between 26 and 35"),
    "21": ("dsp", "d_year, p_brand1", "lo_revenue", "p_category = 'MFGR#12' and s_region = 'AMERICA'"),
    "22": ("dsp", "d_year, p_brand1", "lo_revenue", "p_brand1 between 'MFGR#2221' and 'MFGR#2228' and s_region = 'ASIA'"),
    "23": ("dsp", "d_year, p_brand1", "lo_revenue", "p_brand1 = 'MFGR#2221' and s_region = 'EUROPE'"),
    "31": ("dsc", "c_nation, s_nation, d_year", "lo_revenue", "c_region = 'ASIA' and s_region = 'ASIA' and d_year >= 1992 and d_year <= 1997"),
    "32": ("dsc", "c_city, s_city, d_year", "lo_revenue", "c_nation = 'UNITED STATES' and s_nation = 'UNITED STATES' and d_year >= 1992 and d_year <= 1997"),
    "33": ("dsc", "c_city, s_city, d_year", "lo_revenue", f"c_city {KINGDOM} and s_city {KINGDOM} and d_year >= 1992 and d_year <= 1997"),
    "34": ("dsc", "c_city, s_city, d_year", "lo_revenue", f"c_city {KINGDOM} and s_city {KINGDOM} and d_yearmonth = 'Dec1997'"),
    "41": ("dscp", "d_year, c_nation", "lo_revenue - lo_supplycost", "c_region = 'AMERICA' and s_region = 'AMERICA' and p_mfgr in ('MFGR#1', 'MFGR#2')"),
    "42": ("dscp", "d_year, s_nation, p_category", "lo_revenue - lo_supplycost", "c_region = 'AMERICA' and s_region = 'AMERICA' and d_year in (1997, 1998) and p_mfgr in ('MFGR#1', 'MFGR#2')"),
    "43": ("dscp", "d_year, s_city, p_brand1", "lo_revenue - lo_supplycost", "c_region = 'AMERICA' and s_nation = 'UNITED STATES' and d_year in (1997, 1998) and p_category = 'MFGR#14'"),
}
NAMES = {"d": "ddate", "c": "customer", "s": "supplier", "p": "part"}
SPECS = specs(later=0, cities=(231, 235), month=199712)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("star"))
    tables = generate(spark, 0.03)
    write_text(tables, folder)
    prepare(spark, folder, f"{folder}/out", segment_rows=8192)
    duck = duckdb.connect()
    for name in tables:
        read_text(spark, f"{folder}/{name}.tbl", name).write.parquet(f"{folder}/plain/{name}")
        duck.execute(f"create view {name} as select * from read_parquet('{folder}/plain/{name}/*.parquet')")
    return folder, PreparedStar(spark, f"{folder}/out"), duck


def by_sql(duck, number):
    tables, keys, measure, where = QUERIES[number]
    sql = f"select {keys + ',' if keys else ''} cast(sum({measure}) as bigint) from {', '.join(['lineorder', *(NAMES[t] for t in tables)])}"
    sql += f" where {' and '.join(JOIN[t] for t in tables)} and {where}" + (f" group by {keys}" if keys else "")
    return duck.sql(sql).fetchall()


@pytest.mark.parametrize("number", QUERIES)
def test_prepared_star_gives_the_text_queries_rows(made, number):
    _, star, duck = made
    want = by_sql(duck, number)
    got = compile_df(in_text(SPECS[f"ssb_q{number}"], NATIONS), star).collect()
    keys = [k.strip() + ("_text" if k.strip()[2:] in ("brand1", "category", "nation", "city") else "") for k in QUERIES[number][1].split(",") if k]
    measure = got[0].__fields__[-1] if got else None
    assert sorted(tuple(r[k] for k in keys) + (r[measure],) for r in got) == sorted(want)
    assert want or number in ("33", "34", "32", "23", "43")
    coded = compile_df(SPECS[f"ssb_q{number}"], star).collect()
    if number != "13":  # the coded form names other days
        assert sorted(r[-1] for r in coded if r[-1] is not None) == sorted(r[-1] for r in want if r[-1] is not None)


def test_segments_that_cannot_match_are_not_read(made, spark):
    _, star, duck = made
    every = star.lineorder()
    files = lambda df: {f for f in df.inputFiles() if "lineorder" in f}
    year = compile_df(SPECS["ssb_q11"], star)
    week = compile_df(SPECS["ssb_q13"], star)
    n = len(files(every))
    assert n >= 20 and 0 < len(files(week)) < len(files(year)) < n / 4
    assert every.count() == duck.sql("select count(*) from lineorder").fetchall()[0][0]
    first = duck.sql("select count(*) from lineorder where lo_orderdate < 19920301 and lo_quantity > 45").fetchall()[0][0]
    few = star.lineorder(["lo_orderdate", "lo_quantity"], None, [Pred("lo_orderdate", "lt", (19920301,)), Pred("lo_quantity", "gt", (45,))])
    assert few.filter("lo_orderdate < 19920301 and lo_quantity > 45").count() == first and len(files(few)) < n / 4


def test_many_segments_are_pruned_by_a_join(made, monkeypatch):
    from asterloom.sources import prepared

    _, star, duck = made
    want = compile_df(SPECS["ssb_q11"], star).collect()
    monkeypatch.setattr(prepared, "LISTED", 0)
    assert compile_df(SPECS["ssb_q11"], star).collect() == want


def test_segments_have_their_rows_in_order(made, spark):
    _, star, _ = made
    sizes = [r["n_rows"] for r in star.zones().orderBy("segment_id").collect()]
    assert set(sizes[:-1]) == {8192} and 0 < sizes[-1] <= 8192
    fact = star.table("lineorder").select("lo_orderdate", "lo_orderkey", "lo_linenumber")
    assert {r.segment_id for r in with_segments(fact, "lo_orderdate", 8192, width=1000).subtract(star.table("lineorder").select(*fact.columns, F.col("segment_id").cast("bigint"))).collect()} == set()


def test_generated_tables(made, spark):
    folder, star, duck = made
    again = generate(spark.newSession(), 0.03)
    assert again["lineorder"].repartition(3).agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first() == generate(spark, 0.03)["lineorder"].agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()
    assert {(r.orphans, r.repeated) for r in key_violations(star.table("lineorder"), {t: star.dimension(t) for t in ("customer", "supplier", "part", "ddate")}).collect()} == {(0, 0)}
    assert duck.sql("select count(*), min(d_datekey), max(d_datekey) from ddate").fetchall()[0] == (2557, 19920101, 19981231)
    assert duck.sql("select count(distinct s_region) from supplier").fetchall()[0] == (5,)
    assert star.dimension("customer").filter("c_nation is null or c_city is null or c_region is null").count() == 0


def test_text_with_a_line_of_names(spark, tmp_path):
    (tmp_path / "supplier.tbl").write_text("s_suppkey|s_name|s_address|s_city|s_nation|s_region|s_phone|\n5|Supp|addr|UNITED KI1|UNITED KINGDOM|EUROPE|33|\n")
    assert [r.s_suppkey for r in read_text(spark, str(tmp_path / "supplier.tbl"), "supplier", header=True).collect()] == [5]


def test_orders_are_joined_only_where_they_are_wanted(spark):
    star = Star(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan(star.lineorder(["lo_quantity"])) and "o_orderkey" in plan(star.lineorder(["lo_orderdate"]))
    assert star.lineorder(["lo_quantity"]).count() == star.lineorder(["lo_quantity", "lo_custkey"]).count()
