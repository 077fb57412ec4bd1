"""A star query as a value, compiled to a DataFrame or to SQL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import difference, product
from ..operators.relational import DimJoin, Pred, group_sum, select, star_join
from ..sources.prepared import PreparedStar
from ..sources.star import VIEWS_SQL, Star

#: name of the result column, fact columns, DataFrame expression, SQL.
MEASURES = {
    "revenue_gain": ("revenue", ("lo_extendedprice", "lo_discount"), lambda: product(F.col("lo_extendedprice"), F.col("lo_discount")), "lo_extendedprice * lo_discount"),
    "revenue": ("revenue", ("lo_revenue",), lambda: F.col("lo_revenue"), "lo_revenue"),
    "profit": ("profit", ("lo_revenue", "lo_supplycost"), lambda: difference(F.col("lo_revenue"), F.col("lo_supplycost")), "lo_revenue - lo_supplycost"),
    "count": ("n_rows", (), lambda: F.lit(1).cast("bigint"), "1"),
}


@dataclass(frozen=True)
class QuerySpec:
    """Fact predicates, dimension joins, group keys, a measure, and the order of the text form ((column, ascending), ...)."""

    name: str
    measure: str
    fact: tuple[Pred, ...] = ()
    dims: tuple[DimJoin, ...] = ()
    keys: tuple[str, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()

    def __post_init__(self):
        if self.measure not in MEASURES:
            raise ValueError(f"unknown measure {self.measure!r}")
        carried = {c for d in self.dims for c in d.carry}
        if missing := [k for k in self.keys if k not in carried and not k.startswith("lo_")]:
            raise ValueError(f"keys that no join carries: {missing}")

    def fact_columns(self) -> tuple[str, ...]:
        wanted = [p.column for p in self.fact] + [d.fk for d in self.dims] + list(MEASURES[self.measure][1]) + [k for k in self.keys if k.startswith("lo_")]
        return tuple(dict.fromkeys(wanted))

    def date_range(self) -> tuple[int, int] | None:
        """The range of day keys that the date predicates imply.  It narrows the scan and changes no answer."""
        low, high = 0, 99991231
        for p in [q for d in self.dims if d.table == "ddate" for q in d.preds] + [q for q in self.fact if q.column == "lo_orderdate"]:
            if p.column == "d_yearmonth" and p.op == "eq":
                month = "JanFebMarAprMayJunJulAugSepOctNovDec".find(p.values[0][:3]) // 3 + 1
                p = Pred("d_yearmonthnum", "eq", (int(p.values[0][3:]) * 100 + month,))
            unit = {"d_year": (10000, 101, 1231), "d_yearmonthnum": (100, 1, 31), "d_datekey": (1, 0, 0), "lo_orderdate": (1, 0, 0)}.get(p.column)
            if unit and (b := p.bounds()):
                low, high = max(low, b[0] * unit[0] + unit[1]), min(high, b[1] * unit[0] + unit[2])
        return (low, high) if low > 0 and high < 99991231 else None


def compile_df(spec: QuerySpec, star: Star | PreparedStar, *, implied_dates: bool = True) -> DataFrame:
    dates = spec.date_range() if implied_dates else None
    if dates and not _real_days(dates):
        dates = None
    fact = select(star.lineorder(spec.fact_columns() or ("lo_orderkey",), dates, spec.fact), *spec.fact)
    name, _, expression, _ = MEASURES[spec.measure]
    out = group_sum(star_join(fact, [(d, star.dimension(d.table)) for d in spec.dims]), spec.keys, expression(), name)
    return out.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in spec.order]) if spec.order else out


def _real_days(dates: Sequence[int]) -> bool:
    """Query streams make day keys such as 19980230, which no timestamp has."""
    import datetime

    try:
        return all(datetime.date(k // 10000, k // 100 % 100, k % 100) for k in dates)
    except ValueError:
        return False


def compile_sql(spec: QuerySpec) -> str:
    name, _, _, expression = MEASURES[spec.measure]
    where = [f"{d.fk} = {d.pk}" for d in spec.dims] + [p.sql() for p in spec.fact] + [p.sql() for d in spec.dims for p in d.preds]
    tables = ", ".join(["lineorder", *(f"star_{d.table}" for d in spec.dims)])
    keys = ", ".join(spec.keys)
    return (
        f"WITH {VIEWS_SQL}\nSELECT {keys + ', ' if keys else ''}cast(sum({expression}) AS bigint) AS {name}\nFROM {tables}"
        + (f"\nWHERE {' AND '.join(where)}" if where else "")
        + (f"\nGROUP BY {keys}" if keys else "")
        + (f"\nORDER BY {', '.join(c + ('' if up else ' DESC') for c, up in spec.order)}" if spec.order else "")
    )


def with_date_window(spec: QuerySpec, year: tuple[int, int]) -> QuerySpec:
    """``spec`` with its date join narrowed to a window of years; the window is a predicate and never only a hint for skipping."""
    window = Pred("d_year", "between", year)
    dims = tuple(replace(d, preds=(*(p for p in d.preds if p.column != "d_year"), window)) if d.table == "ddate" else d for d in spec.dims)
    return replace(spec, dims=dims)
