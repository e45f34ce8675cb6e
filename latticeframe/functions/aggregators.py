"""Aggregators. Each works in Table.aggregate, group_by(...).aggregate and on matrix axes; those that combine also as scans.

Most are plain aggregate Columns. Nested ones (counter, group_by, explode, array_agg) are Nested objects that the planner
computes by a two-level aggregation, so that a hot group is pre-aggregated on the map side and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticeframe.semantics import NAN, col, divide


@dataclass(frozen=True)
class Nested:
    """kind: group_by (dict from key to inner), explode (inner over the elements), array (inner by position)."""

    kind: str
    over: Column
    inner: object
    finish: Callable[[Column], Column] | None = None


def count() -> Column:
    return F.count(F.lit(1))


def count_where(condition) -> Column:
    return F.count_if(col(condition))


def any(condition) -> Column:  # noqa: A001
    return F.coalesce(F.bool_or(col(condition)), F.lit(False))


def all(condition) -> Column:  # noqa: A001
    return F.coalesce(F.bool_and(col(condition)), F.lit(True))


def defined_number(x: Column) -> Column:
    return F.when(~F.isnan(x.cast("double")), x)


def min(x) -> Column:  # noqa: A001
    """Missing values and NaN are left out."""
    return F.min(defined_number(col(x)))


def max(x) -> Column:  # noqa: A001
    """Missing values and NaN are left out."""
    return F.max(defined_number(col(x)))


def min_text(x) -> Column:
    return F.min(col(x))


def max_text(x) -> Column:
    return F.max(col(x))


def sum(x) -> Column:  # noqa: A001
    """0 for no values."""
    return F.coalesce(F.sum(col(x)), F.lit(0))


def mean(x) -> Column:
    """NaN for no values."""
    return F.coalesce(F.avg(col(x)), F.lit(NAN))


def product(x) -> Column:
    return F.coalesce(F.product(col(x)), F.lit(1.0))


def fraction(condition) -> Column:
    """Missing for no rows."""
    return F.count_if(col(condition)) / F.nullif(F.count(F.lit(1)), F.lit(0))


def stats(x) -> Column:
    """struct<mean, stdev (population), min, max, n, sum>."""
    x = col(x).cast("double")
    return F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("stdev"), min(x).alias("min"), max(x).alias("max"), F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"))


def collect(x) -> Column:
    """All values, missing ones too, in no order. Holds a group's values in one task: for groups of bounded size."""
    return F.transform(F.collect_list(F.struct(col(x).alias("x"))), lambda s: s["x"])


def collect_as_set(x) -> Column:
    """Distinct values in order, a missing one last."""
    return F.transform(F.array_sort(F.collect_set(F.struct(col(x).isNull().alias("n"), col(x).alias("x")))), lambda s: s["x"])


def take(x, n: int, ordering=None) -> Column:
    """n values, the smallest by ordering, missing orderings last. The buffer is a sorted list of the group."""
    x = col(x)
    key = col(ordering) if ordering is not None else F.lit(0)
    rows = F.array_sort(F.collect_list(F.struct(key.isNull().alias("n"), key.alias("o"), x.alias("x"))))
    return F.transform(F.slice(rows, 1, n), lambda s: s["x"])


def approx_quantiles(x, qs, accuracy: int = 10_000) -> Column:
    return F.percentile_approx(col(x), qs, accuracy)


def approx_median(x, accuracy: int = 10_000) -> Column:
    return F.percentile_approx(col(x), 0.5, accuracy)


def approx_cdf(x, points: int = 100, accuracy: int = 10_000) -> Column:
    """struct<values, ranks>: approximate quantiles at evenly spaced shares and their ranks."""
    shares = [i / points for i in range(points + 1)]
    n = F.count(col(x))
    return F.struct(F.percentile_approx(col(x), shares, accuracy).alias("values"), F.transform(F.array(*[F.lit(s) for s in shares]), lambda s: F.round(s * n).cast("long")).alias("ranks"))


def corr(x, y) -> Column:
    """Pearson correlation of rows with both values; NaN without variance."""
    x, y = col(x).cast("double"), col(y).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    total = lambda v: F.coalesce(F.sum(v), F.lit(0.0))
    n, sx, sy = F.count(x), total(x), total(y)
    top = n * total(x * y) - sx * sy
    under = F.sqrt(F.greatest(n * total(x * x) - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * total(y * y) - sy * sy, F.lit(0.0)))
    return divide(top, under)


def hist(x, start: float, end: float, bins: int) -> Column:
    """struct<bin_edges, bin_freq, n_smaller, n_larger>; the last bin includes end; missing values and NaN are left out."""
    x = defined_number(col(x).cast("double"))
    width = (end - start) / bins
    at = F.when((x >= start) & (x <= end), F.least(F.floor((x - start) / width), F.lit(bins - 1)))
    return F.struct(
        F.array(*[F.lit(start + i * width) for i in range(bins)], F.lit(float(end))).alias("bin_edges"),
        F.array(*[F.count_if(at == i) for i in range(bins)]).alias("bin_freq"),
        F.count_if(x < start).alias("n_smaller"),
        F.count_if(x > end).alias("n_larger"),
    )


def array_sum(x, length: int) -> Column:
    """Sums by position of arrays of the given length."""
    return F.array(*[F.coalesce(F.sum(F.get(col(x), F.lit(i))), F.lit(0)) for i in range(length)])


def fold(x, zero: Column, seq_op, comb_op=None) -> Column:
    """A fold over the group's values in no order; the group is held in one task."""
    return F.reduce(collect(x), zero, seq_op)


def equals(value) -> Callable[[Column], Column]:
    return lambda x: x == value


def call_stats(call, n_alleles: int) -> Column:
    """struct<AC, AF, AN, homozygote_count> of calls struct<alleles, phased>; a missing call does not count."""
    alleles = col(call)["alleles"]
    counts = [F.coalesce(F.sum(F.size(F.filter(alleles, equals(i)))), F.lit(0)) for i in range(n_alleles)]
    an = F.coalesce(F.sum(F.when(alleles.isNotNull(), F.size(alleles))), F.lit(0))
    homs = [F.count_if((F.size(alleles) > 1) & F.forall(alleles, equals(i))) for i in range(n_alleles)]
    return F.struct(F.array(*counts).alias("AC"), F.when(an > 0, F.array(*[c / F.when(an > 0, an) for c in counts])).alias("AF"), an.alias("AN"), F.array(*homs).alias("homozygote_count"))


def inbreeding(call, prior) -> Column:
    """struct<f_stat, n_called, expected_homs, observed_homs> given each row's alternate allele frequency."""
    alleles, p = col(call)["alleles"], col(prior)
    use = (F.size(alleles) == 2) & p.isNotNull()
    n = F.count_if(use)
    expected = F.coalesce(F.sum(F.when(use, 1 - 2 * p * (1 - p))), F.lit(0.0))
    observed = F.count_if(use & (F.get(alleles, F.lit(0)) == F.get(alleles, F.lit(1))))
    return F.struct(divide(observed - expected, n - expected).alias("f_stat"), n.alias("n_called"), expected.alias("expected_homs"), observed.alias("observed_homs"))


def hardy_weinberg_test(call) -> Column:
    """Exact test from genotype counts: struct<het_freq_hwe, p_value>."""
    from latticeframe.functions.statistics import hardy_weinberg

    alleles = col(call)["alleles"]
    n_alt = F.aggregate(alleles, F.lit(0), lambda s, a: s + F.when(a > 0, 1).otherwise(0))
    return hardy_weinberg(F.count_if(n_alt == 0), F.count_if(n_alt == 1), F.count_if(n_alt == 2))


def info_score(gp) -> Column:
    """struct<score, n_included> from genotype probabilities [hom ref, het, hom var]."""
    gp = col(gp)
    g = lambda i: F.get(gp, F.lit(i))
    use = gp.isNotNull() & (F.abs(g(0) + g(1) + g(2)) > 0)
    e, f = g(1) + 2 * g(2), g(1) + 4 * g(2)
    n = F.count_if(use)
    theta = divide(F.sum(F.when(use, e)), 2 * n)
    spread = F.coalesce(F.sum(F.when(use, f - e * e)), F.lit(0.0))
    score = F.when(n == 0, F.lit(NAN)).when((theta == 0) | (theta == 1), F.lit(1.0)).otherwise(1 - divide(spread, 2 * n * theta * (1 - theta)))
    return F.struct(score.alias("score"), n.cast("int").alias("n_included"))


def linreg(y, x: list, weight=None) -> Column:
    """Ordinary least squares by sums: struct<xtx, xty, yty, n>; linreg_fit turns it into coefficients."""
    y, xs = col(y).cast("double"), [col(v).cast("double") for v in x]
    use = y.isNotNull()
    for v in xs:
        use = use & v.isNotNull()
    w = F.lit(1.0) if weight is None else col(weight).cast("double")
    use = use & w.isNotNull()
    s = lambda v: F.coalesce(F.sum(F.when(use, w * v)), F.lit(0.0))
    return F.struct(
        F.array(*[F.array(*[s(a * b) for b in xs]) for a in xs]).alias("xtx"),
        F.array(*[s(a * y) for a in xs]).alias("xty"),
        s(y * y).alias("yty"),
        s(y).alias("sy"),
        F.count_if(use).alias("n"),
    )


def filter(condition, build: Callable[[Callable], Column]) -> Column:  # noqa: A001
    """An aggregation over rows that satisfy the condition: build gets a function that blanks values on other rows, as in filter(p, lambda where: sum(where("x")))."""
    condition = col(condition)
    return build(lambda x: F.when(condition, col(x)))


def counter(x, weight=None) -> Nested:
    """Map from value to count, or to the sum of weights; a missing value is a key of its own in the list form."""
    return Nested("group_by", col(x), count() if weight is None else sum(weight))


def group_by(key, inner) -> Nested:
    """List of struct<key, value> by key: inner for each value of key."""
    return Nested("group_by", col(key), inner)


def explode(build: Callable[[Column], Column], array) -> Nested:
    """An aggregation over the elements of an array."""
    return Nested("explode", col(array), build)


def array_agg(build: Callable[[Column], Column], array) -> Nested:
    """An aggregation for each array position."""
    return Nested("array", col(array), build)


def downsample(x, y, divisions: int = 500) -> Nested:
    """One (x, y) for each cell of a grid over unit steps of the given number of divisions; for plots."""
    x, y = col(x).cast("double"), col(y).cast("double")
    cell = F.struct(F.floor(x * divisions), F.floor(y * divisions))
    return Nested("group_by", cell, F.min(F.struct(x.alias("x"), y.alias("y"))), lambda rows: F.transform(rows, lambda r: r["value"]))
