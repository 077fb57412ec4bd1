"""The thirteen star queries and the count profile, with literals for a calendar and in coded or text form."""

from __future__ import annotations

from ..operators.relational import DimJoin, Pred
from .spec import QuerySpec

#: The test tables' calendar starts three years after the benchmark's.
YEARS_LATER = 3


def _eq(c, v):
    return Pred(c, "eq", (v,))


def _between(c, a, b):
    return Pred(c, "between", (a, b))


def _date(*preds, carry=()):
    return DimJoin("ddate", "lo_orderdate", "d_datekey", preds, carry)


def _supplier(*preds, carry=()):
    return DimJoin("supplier", "lo_suppkey", "s_suppkey", preds, carry)


def _customer(*preds, carry=()):
    return DimJoin("customer", "lo_custkey", "c_custkey", preds, carry)


def _part(*preds, carry=()):
    return DimJoin("part", "lo_partkey", "p_partkey", preds, carry)


#: The nations of the test tables.
TEST_NATIONS = tuple(f"NATION_{i}" for i in range(25))


#: Coded literal -> text literal, for the columns that queries name.
def _text(column: str, value: int, nations: tuple[str, ...] = TEST_NATIONS) -> str:
    from ..functions.codec import REGIONS

    kind = column.split("_")[1]
    if kind == "region":
        return REGIONS[value]
    if kind == "nation":
        return nations[value]
    if kind == "city":
        return nations[value // 10][:9].ljust(9) + str(value % 10)
    if kind == "mfgr":
        return f"MFGR#{value + 1}"
    if kind == "category":
        return f"MFGR#{value // 5 + 1}{value % 5 + 1}"
    return f"{_text('p_category', value // 40)}{value % 40 + 1}"


CODED = ("region", "nation", "city", "mfgr", "category", "brand1")


def _is_coded(column: str) -> bool:
    return column.partition("_")[2] in CODED and column[0] in "csp"


def _week(p: Pred) -> tuple[Pred, ...]:
    """The text form of the week of query 1.3: its number and year."""
    return _eq("d_weeknuminyear", 6), _eq("d_year", p.values[0] // 10000)


def _month(p: Pred) -> tuple[Pred, ...]:
    import datetime

    return (_eq("d_yearmonth", datetime.datetime.strptime(str(p.values[0]), "%Y%m").strftime("%b%Y")),)


#: Date predicates that the text form words otherwise: week 6 is not the coded form's 4 to 10 February, so the answers differ.
DATES_IN_TEXT = {"ssb_q13": ("d_datekey", _week), "ssb_q34": ("d_yearmonthnum", _month)}


def in_text(spec: QuerySpec, nations: tuple[str, ...] = TEST_NATIONS) -> QuerySpec:
    """The text form: text literals, text keys, text predicates on dates, ordered."""

    def name(c: str) -> str:
        return f"{c}_text" if _is_coded(c) else c

    def pred(p: Pred) -> Pred:
        return Pred(name(p.column), p.op, tuple(_text(p.column, v, nations) for v in p.values)) if _is_coded(p.column) else p

    column, worded = DATES_IN_TEXT.get(spec.name, (None, None))
    preds = lambda d: tuple(x for p in d.preds for x in (worded(p) if p.column == column else (pred(p),)))
    dims = tuple(DimJoin(d.table, d.fk, d.pk, preds(d), tuple(map(name, d.carry))) for d in spec.dims)
    return QuerySpec(f"{spec.name}_text", spec.measure, spec.fact, dims, tuple(map(name, spec.keys)), tuple((name(c), up) for c, up in ORDERS.get(spec.name, ())))


ORDERS = {
    **{f"ssb_q2{i}": (("d_year", True), ("p_brand1", True)) for i in (1, 2, 3)},
    **{f"ssb_q3{i}": (("d_year", True), ("revenue", False)) for i in (1, 2, 3, 4)},
    "ssb_q41": (("d_year", True), ("c_nation", True)),
    "ssb_q42": (("d_year", True), ("s_nation", True), ("p_category", True)),
    "ssb_q43": (("d_year", True), ("s_city", True), ("p_brand1", True)),
}


def specs(later: int = YEARS_LATER, cities: tuple[int, int] = (241, 249), month: int = 199806) -> dict[str, QuerySpec]:
    """All specs by name; ``cities`` and ``month`` are the literals of queries 3.3 and 3.4."""
    year = lambda y: y + later
    day = lambda k: k + later * 10000
    sum_gain, carry_year = "revenue_gain", ("d_year",)
    years = _between("d_year", year(1992), year(1997))
    late = Pred("d_year", "in", (year(1997), year(1998)))
    mfgrs = Pred("p_mfgr", "in", (0, 1))
    q = [
        QuerySpec("ssb_q11", sum_gain, (_between("lo_discount", 1, 3), Pred("lo_quantity", "lt", (25,))), (_date(_eq("d_year", year(1993))),)),
        QuerySpec("ssb_q12", sum_gain, (_between("lo_discount", 4, 6), _between("lo_quantity", 26, 35)), (_date(_eq("d_yearmonthnum", 199401 + later * 100)),)),
        QuerySpec("ssb_q13", sum_gain, (_between("lo_discount", 5, 7), _between("lo_quantity", 26, 35)), (_date(_between("d_datekey", day(19940204), day(19940210))),)),
    ]
    for i, pred, region in ((1, _eq("p_category", 1), 1), (2, _between("p_brand1", 260, 267), 2), (3, _eq("p_brand1", 260), 3)):
        q.append(QuerySpec(f"ssb_q2{i}", "revenue", (), (_supplier(_eq("s_region", region)), _part(pred, carry=("p_brand1",)), _date(carry=carry_year)), ("d_year", "p_brand1")))
    for i, (key, column, op, values, date) in enumerate((("nation", "region", "eq", (2,), years), ("city", "nation", "eq", (24,), years), ("city", "city", "in", cities, years), ("city", "city", "in", cities, _eq("d_yearmonthnum", month))), 1):
        dims = (_customer(Pred(f"c_{column}", op, values), carry=(f"c_{key}",)), _supplier(Pred(f"s_{column}", op, values), carry=(f"s_{key}",)), _date(date, carry=carry_year))
        q.append(QuerySpec(f"ssb_q3{i}", "revenue", (), dims, (f"c_{key}", f"s_{key}", "d_year")))
    america = (_customer(_eq("c_region", 1), carry=("c_nation",)), _supplier(_eq("s_region", 1)), _part(mfgrs))
    q.append(QuerySpec("ssb_q41", "profit", (), (*america, _date(carry=carry_year)), ("d_year", "c_nation")))
    q.append(QuerySpec("ssb_q42", "profit", (), (_customer(_eq("c_region", 1)), _supplier(_eq("s_region", 1), carry=("s_nation",)), _part(mfgrs, carry=("p_category",)), _date(late, carry=carry_year)), ("d_year", "s_nation", "p_category")))
    q.append(QuerySpec("ssb_q43", "profit", (), (_customer(_eq("c_region", 1)), _supplier(_eq("s_nation", 24), carry=("s_city",)), _part(_eq("p_category", 3), carry=("p_brand1",)), _date(late, carry=carry_year)), ("d_year", "s_city", "p_brand1")))
    q.append(QuerySpec("ssb_p1", "count", (), (*america, _date(carry=carry_year)), ("d_year", "c_nation")))
    return {s.name: s for s in q}
