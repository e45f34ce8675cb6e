"""The rules that the engine keeps and Spark does not by itself: ordering of missing values, division, NaN."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(x) -> Column:
    """A column of a name, a literal of any other value; columns stay as they are."""
    return x if isinstance(x, Column) else F.col(f"`{x}`" if isinstance(x, str) and "." not in x else x) if isinstance(x, str) else F.lit(x)


def asc(x) -> Column:
    return col(x).asc_nulls_last()


def desc(x) -> Column:
    return col(x).desc_nulls_last()


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x / 0 is an infinity or NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a.isNull(), None).when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def floordiv(a: Column, b: Column) -> Column:
    """Division rounded down; an integer divided by 0 is an error."""
    return F.floor(a / b)


def floormod(a: Column, b: Column) -> Column:
    """The remainder of floordiv, with the sign of b; division by 0 is an error."""
    return a - b * F.floor(a / b)


def log(x: Column, base: float | None = None) -> Column:
    """log(0) is -inf, the log of a negative number NaN."""
    x = x.cast("double")
    got = F.log(F.when(x > 0, x)) if base is None else F.log(F.when(x > 0, x)) / F.log(F.lit(float(base)))
    return F.when(x == 0, F.lit(-INF)).when((x < 0) | F.isnan(x), F.lit(NAN)).otherwise(got)


def if_else(condition: Column, then, otherwise) -> Column:
    """Missing where the condition is."""
    return F.when(condition.isNull(), None).when(condition, col(then) if isinstance(then, Column) else F.lit(then)).otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def number_range(start: Column, stop: Column, step: int = 1) -> Column:
    """Integers from start up to before stop, none where the range is empty."""
    last = stop - 1 if step > 0 else stop + 1
    empty = (start >= stop) if step > 0 else (start <= stop)
    return F.when(empty, F.array().cast("array<int>")).otherwise(F.sequence(start, F.when(~empty, last), F.lit(step)))


def each(f: Callable, *xs) -> list:
    return [f(x) for x in xs]
