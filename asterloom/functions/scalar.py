"""Scalar projections.  Products of integers are widened before they are made."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference(a: Column, b: Column) -> Column:
    return a.cast("bigint") - b.cast("bigint")


def product(a: Column, b: Column) -> Column:
    return a.cast("bigint") * b.cast("bigint")


def linear(a: Column, b: Column, x: float = 2.0, y: float = 3.0) -> Column:
    return F.lit(x) * a + F.lit(y) * b


def sigmoid(a: Column, b: Column, x: float = 2.0, y: float = 3.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-linear(a, b, x, y)))


def square(a: Column) -> Column:
    return a * a
