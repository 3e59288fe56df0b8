"""Array helpers: every function takes and returns columns, values are DOUBLE and positions 0-based."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def argmax(v: Column) -> Column:
    """Place of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def one_hot(label: Column, classes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), classes - 1), lambda c: (c == label).cast("int"))


def l2_norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def p_norm(v: Column, order: float | None = None) -> Column:
    """Vector norm of a given order; None: 2, infinity: the largest magnitude."""
    if order is None or order == 2:
        return l2_norm(v)
    if order == float("inf"):
        return F.array_max(F.transform(v, F.abs))
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(float(order))))), F.lit(1.0 / order))


def distance(a: Column, b: Column) -> Column:
    return l2_norm(F.zip_with(a, b, lambda x, y: x - y))


def steady(v: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(v, digits) + F.lit(0.0)
