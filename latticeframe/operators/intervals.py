"""Intervals struct<start, end, includes_start, includes_end> and lookups of points in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.plans.materialize import materialize
from latticeframe.semantics import col

LEVELS = 40


def interval(start, end, includes_start: bool = True, includes_end: bool = False) -> Column:
    return F.struct(col(start).alias("start"), col(end).alias("end"), F.lit(includes_start).alias("includes_start"), F.lit(includes_end).alias("includes_end"))


def contains(i: Column, x: Column) -> Column:
    after = F.when(i["includes_start"], x >= i["start"]).otherwise(x > i["start"])
    before = F.when(i["includes_end"], x <= i["end"]).otherwise(x < i["end"])
    return after & before


def is_empty(i: Column) -> Column:
    return (i["start"] > i["end"]) | ((i["start"] == i["end"]) & ~(i["includes_start"] & i["includes_end"]))


def overlaps(i: Column, j: Column) -> Column:
    meet = lambda a, b: F.when(a["includes_start"] & b["includes_end"], a["start"] <= b["end"]).otherwise(a["start"] < b["end"])
    return meet(i, j) & meet(j, i) & ~is_empty(i) & ~is_empty(j)


def cells(low: Column, high: Column, level: Column) -> Column:
    """The cells of width 2 ** level that [low, high] touches."""
    return F.sequence(shifted(low, level), shifted(high, level))


def shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def interval_lookup(df: DataFrame, point: Column, intervals: DataFrame, key: str, packed: Column, name: str, all_matches: bool) -> DataFrame:
    """df with name: the value of an interval that holds the point (the smallest (start, end, value) of several), or all in that order, an empty array for none.

    An equi join: an interval goes to the two or so cells of its own size class that it touches, a point to one cell of
    each class in use, so rows grow by the number of classes and not with the lengths of intervals. Points of numeric
    types; other types are joined by comparison.
    """
    kind = dict(intervals.select(F.col(f"`{key}`.start").alias("s")).dtypes)["s"]
    rest = [c for c in df.columns if c != name]
    rows = materialize(df.select(*[F.col(f"`{c}`") for c in rest], point.alias("__x"), F.monotonically_increasing_id().alias("__id")))
    right = intervals.select(F.col(f"`{key}`").alias("__i"), packed.alias("__v")).where(~is_empty(F.col("__i")))
    if kind in ("int", "bigint", "smallint", "tinyint", "double", "float"):
        shift = lambda x: F.floor(x).cast("long") + F.lit(1 << 52)
        low, high = shift(F.col("__i.start")), shift(F.col("__i.end"))
        span = F.length(F.bin(high - low))  # 2 ** span > high - low
        placed = right.withColumn("__level", span.cast("int")).withColumn("__cell", F.explode(cells(low, high, F.col("__level"))))
        levels = [r[0] for r in placed.select("__level").distinct().limit(64).collect()]
        one = F.explode(F.array(*[F.struct(F.lit(k).alias("l"), F.shiftrightunsigned(shift(F.col("__x")), k).alias("c")) for k in levels])) if levels else None
        points = rows.where(F.col("__x").isNotNull()).select("__id", "__x", one.alias("__p")) if levels else None
        on = (F.col("__p.l") == F.col("__level")) & (F.col("__p.c") == F.col("__cell")) & contains(F.col("__i"), F.col("__x"))
        found = points.join(placed, on) if levels else rows.select("__id").join(right, F.lit(False))
    else:
        found = rows.select("__id", "__x").join(right, contains(F.col("__i"), F.col("__x")))
    item = F.struct(F.col("__i.start").alias("s"), F.col("__i.end").alias("e"), F.col("__v").alias("v"))
    if all_matches:
        value = found.groupBy("__id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias(name))
        out = rows.join(value, "__id", "left")
        empty = F.array().cast(dict(value.dtypes)[name])
        return out.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{name}`"), empty).alias(name))
    value = found.groupBy("__id").agg(F.min(item).alias("__m"))
    return rows.join(value, "__id", "left").select(*[F.col(f"`{c}`") for c in rest], F.col("__m.v").alias(name))


def filter_intervals(df: DataFrame, point: Column, wanted: list[tuple], keep: bool = True) -> DataFrame:
    """Rows whose point lies in one of a list of intervals (start, end, includes_start, includes_end): a predicate that scans can push down."""
    condition = F.lit(False)
    for start, end, *flags in wanted:
        has_start, has_end = flags or (True, False)
        condition = condition | ((point >= start if has_start else point > start) & (point <= end if has_end else point < end))
    return df.where(condition if keep else ~condition)
