"""The engine's operators as DataFrame compositions; Catalyst chooses how they run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pred:
    """A comparison of a column with literals: eq, in, between (inclusive), lt, lte, gt, gte."""

    column: str
    op: str
    values: tuple

    def __post_init__(self):
        need = {"between": 2, "in": None, "eq": 1, "lt": 1, "lte": 1, "gt": 1, "gte": 1}
        if self.op not in need:
            raise ValueError(f"unknown comparison {self.op!r}")
        if not self.values or (need[self.op] is not None and len(self.values) != need[self.op]):
            raise ValueError(f"{self.op} got {len(self.values)} values")

    def column_expr(self) -> Column:
        c, v = F.col(self.column), self.values
        if self.op == "in":
            return c.isin(*v)
        if self.op == "between":
            return c.between(*v)
        return {"eq": c == v[0], "lt": c < v[0], "lte": c <= v[0], "gt": c > v[0], "gte": c >= v[0]}[self.op]

    def sql(self) -> str:
        lit = ["'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in self.values]
        if self.op == "in":
            return f"{self.column} IN ({', '.join(lit)})"
        if self.op == "between":
            return f"{self.column} BETWEEN {lit[0]} AND {lit[1]}"
        return f"{self.column} {dict(eq='=', lt='<', lte='<=', gt='>', gte='>=')[self.op]} {lit[0]}"

    def bounds(self) -> tuple | None:
        """The least range that holds every value that passes; None where it is open."""
        v = self.values
        return {"eq": (v[0], v[0]), "in": (min(v), max(v)), "between": (v[0], v[-1])}.get(self.op)


@dataclass(frozen=True)
class DimJoin:
    """An inner join of the fact table's ``fk`` with a dimension's key, after the dimension's own predicates."""

    table: str
    fk: str
    pk: str
    preds: tuple[Pred, ...] = ()
    carry: tuple[str, ...] = ()


def all_of(preds: Sequence[Pred]) -> Column:
    return reduce(lambda a, b: a & b, [p.column_expr() for p in preds], F.lit(True))


def any_of(preds: Sequence[Pred]) -> Column:
    return reduce(lambda a, b: a | b, [p.column_expr() for p in preds], F.lit(False))


def select(df: DataFrame, *preds: Pred) -> DataFrame:
    return df.filter(all_of(preds)) if preds else df


def star_join(fact: DataFrame, dims: Sequence[tuple[DimJoin, DataFrame]]) -> DataFrame:
    """Joins filtered dimensions one after the other, each with its key and carried columns only.

    No side is hinted: the static and the adaptive planner broadcast what their size bounds allow.
    """
    for join, dim in dims:
        side = select(dim, *join.preds).select(join.pk, *join.carry)
        fact = fact.join(side, fact[join.fk] == side[join.pk], "inner").drop(side[join.pk])
    return fact


def semi_join(fact: DataFrame, dim: DataFrame, fk: str, pk: str, *preds: Pred) -> DataFrame:
    """Keeps the fact rows that have a dimension row: a join that needs the key only."""
    return fact.join(select(dim, *preds).select(F.col(pk).alias(fk)), fk, "left_semi").select(*fact.columns)


def partitioned_join(left: DataFrame, right: DataFrame, on: str, parts: int | None = None) -> DataFrame:
    """A join of which both sides are dealt out by the key and meet part by part.

    The exchanges are the join's own, so the adaptive planner may split a part
    that a hot key fills, and merge is what it falls back to where a part is too
    large to be built in memory.  ``parts`` is a number of parts to aim at.
    """
    if not parts:
        return left.join(right.hint("merge"), on)
    spread = F.pmod(F.xxhash64(on), F.lit(parts)).alias("_part")
    return left.select("*", spread).join(right.select("*", spread).hint("merge"), ["_part", on]).drop("_part")


def group_sum(df: DataFrame, keys: Sequence[str], measure: Column, name: str) -> DataFrame:
    """Every group with its sum; groups of sum 0 and negative sums stand like others."""
    return df.groupBy(*keys).agg(F.sum(measure).alias(name))


def scalar_sum(df: DataFrame, measure: Column, name: str) -> DataFrame:
    return df.agg(F.sum(measure).alias(name))


def sort_table(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """Range-partitioned by a column and sorted within, so written files are in order; ties by all other columns."""
    rest = [c for c in df.columns if c != column]
    dealt = df.repartitionByRange(parts, column) if parts else df.repartitionByRange(column)
    return dealt.sortWithinPartitions(column, *rest)
