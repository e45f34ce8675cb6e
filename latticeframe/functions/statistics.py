"""Probability distributions and exact tests, as Arrow-batched pandas UDFs over numpy; densities that need no special functions stay Columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from latticeframe.semantics import col, divide

LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)  # fixed values


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) if v > 0 else math.inf for v in np.atleast_1d(np.asarray(x, float)).ravel()]).reshape(np.shape(x) or (1,))


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.where(x <= 0, 0.0, np.nan)
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - lgamma(a).reshape(a.shape))
    low = (x > 0) & (x < a + 1)
    term, total, n = np.where(low, 1 / np.where(a > 0, a, 1), 0.0), np.where(low, 1 / np.where(a > 0, a, 1), 0.0), a.astype(float).copy()
    for _ in range(2000):
        n = n + 1
        term = term * np.where(low, x / n, 0)
        total = total + term
        if (np.abs(term) <= 1e-17 * np.abs(total)).all():
            break
    out = np.where(low, total * front, out)
    high = (x > 0) & ~low
    b, c = x + 1 - a, np.full(x.shape, 1e300)
    d = 1 / np.where(b == 0, 1e-300, b)
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        step = d * c
        h = h * step
        if (np.abs(step - 1)[high] < 1e-16).all():
            break
    return np.where(high, 1 - front * h, out)


def beta_i(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    y = np.clip(y, 0, 1)
    front = np.exp(lgamma(p + q).reshape(p.shape) - lgamma(p).reshape(p.shape) - lgamma(q).reshape(p.shape) + p * np.log(np.maximum(y, 1e-300)) + q * np.log1p(-np.minimum(y, 1 - 1e-16))) / p
    tiny = 1e-300
    c, d = np.ones(p.shape), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 1000):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if (np.abs(step - 1) < 1e-16).all():
            break
    got = np.where(y <= 0, 0.0, front * h)
    return np.where(flip, 1 - got, got)


def norm_cdf(x) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.atleast_1d(np.asarray(x, float))])


def invert(cdf, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Quantiles by bisection."""
    low, high = np.array(low, float), np.array(high, float)
    for _ in range(200):
        middle = (low + high) / 2
        below = cdf(middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def vectorised(f):
    """A Column function of numpy function f over doubles; missing where an argument is."""

    def call(*args) -> Column:
        @F.pandas_udf("double")
        def run(*s: pd.Series) -> pd.Series:
            v = [x.to_numpy(float) for x in s]
            good = ~np.any([np.isnan(x) for x in v], axis=0)
            out = np.full(len(v[0]), np.nan)
            if good.any():
                out[good] = f(*[x[good] for x in v])
            return pd.Series(out).where(good)

        columns = [col(a).cast("double") for a in args]
        missing = columns[0].isNull()
        for c in columns[1:]:
            missing = missing | c.isNull()
        return F.when(~missing, run(*columns))

    return call


pnorm = vectorised(norm_cdf)
qnorm = vectorised(lambda p: invert(norm_cdf, p, np.full(len(p), -40.0), np.full(len(p), 40.0)))
pgamma = vectorised(lambda x, shape, scale: gamma_p(shape, x / scale))
pchisqtail = vectorised(lambda x, df: np.where(x <= 0, 1.0, 1 - gamma_p(df / 2, x / 2)))
qchisqtail = vectorised(lambda p, df: invert(lambda x: gamma_p(df / 2, x / 2), 1 - p, np.zeros(len(p)), np.full(len(p), 1e5)))
qgamma = vectorised(lambda p, shape, scale: scale * invert(lambda x: gamma_p(shape, x), p, np.zeros(len(p)), np.full(len(p), 1e6)))
ppois = vectorised(lambda x, lamb: np.where(x < 0, 0.0, 1 - gamma_p(np.floor(np.maximum(x, 0)) + 1, lamb)))
pT = vectorised(lambda x, n: np.where(x > 0, 1 - beta_i(n / 2, 0.5, n / (n + x * x)) / 2, beta_i(n / 2, 0.5, n / (n + x * x)) / 2))
pF = vectorised(lambda x, a, b: np.where(x <= 0, 0.0, beta_i(a / 2, b / 2, a * x / (a * x + b))))
pbinom = vectorised(lambda k, n, p: np.where(k >= n, 1.0, 1 - beta_i(np.floor(k) + 1, n - np.floor(k), p)))
p_t_two_sided = vectorised(lambda t, n: beta_i(n / 2, 0.5, n / (n + t * t)))


def log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


def hypergeometric(total: int, good: int, drawn: int) -> tuple[np.ndarray, np.ndarray]:
    """Support and probabilities."""
    f = log_factorials(total)
    k = np.arange(max(0, drawn + good - total), min(good, drawn) + 1)
    logp = f[good] - f[k] - f[good - k] + f[total - good] - f[drawn - k] - f[total - good - drawn + k] - f[total] + f[drawn] + f[total - drawn]
    return k, np.exp(logp)


def phyper_value(k: float, total: int, good: int, drawn: int) -> float:
    s, p = hypergeometric(total, good, drawn)
    return float(p[s <= k].sum())


def fisher_values(a: int, b: int, c: int, d: int) -> tuple[float, float, float, float]:
    """Two-sided p value, conditional maximum likelihood odds ratio, and its 95 % interval."""
    s, p = hypergeometric(a + b + c + d, a + b, a + c)
    at = np.flatnonzero(s == a)[0]
    p_value = float(min(1.0, p[p <= p[at] * (1 + 1e-7)].sum()))
    if len(s) == 1:
        return p_value, math.nan, 0.0, math.inf
    base = np.log(np.maximum(p, 1e-300))

    def weights(log_odds: float) -> np.ndarray:
        w = base + s * log_odds
        w = np.exp(w - w.max())
        return w / w.sum()

    def solve(f, target: float) -> float:
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if f(middle) < target else (low, middle)
        return math.exp((low + high) / 2)

    odds = 0.0 if a == s[0] else math.inf if a == s[-1] else solve(lambda t: (weights(t) * s).sum(), a)
    lower = 0.0 if a == s[0] else solve(lambda t: weights(t)[s >= a].sum(), 0.025)
    upper = math.inf if a == s[-1] else solve(lambda t: -weights(t)[s <= a].sum(), -0.025)
    return p_value, odds, lower, upper


def hardy_weinberg_values(hom_ref: int, het: int, hom_var: int) -> tuple[float, float]:
    """Expected heterozygote frequency and exact mid-p value."""
    n = hom_ref + het + hom_var
    if n == 0:
        return math.nan, 0.5
    rare = het + 2 * min(hom_ref, hom_var)
    k = np.arange(rare % 2, rare + 1, 2)
    k = k[(rare - k) // 2 + k <= n]
    f = log_factorials(2 * n + 1)
    homs = (rare - k) // 2
    logp = k * math.log(2) - f[k] - f[homs] - f[n - k - homs]
    p = np.exp(logp - logp.max())
    p /= p.sum()
    own = p[k == het][0]
    mean = rare * (2 * n - rare) / (2 * n - 1) / n
    return float(mean), float(p[p < own * (1 - 1e-9)].sum() + 0.5 * p[np.abs(p - own) <= own * 1e-9].sum())


def struct_udf(f, fields: list[str]):
    """A Column function of integer arguments that gives a struct of doubles."""

    def call(*args) -> Column:
        @F.pandas_udf(", ".join(f"{n} double" for n in fields))
        def run(*s: pd.Series) -> pd.DataFrame:
            rows = [f(*map(int, v)) if not any(pd.isna(x) for x in v) else (math.nan,) * len(fields) for v in zip(*s, strict=True)]
            return pd.DataFrame(rows, columns=fields, dtype=float)

        return run(*[col(a).cast("long") for a in args])

    return call


hardy_weinberg = struct_udf(hardy_weinberg_values, ["het_freq_hwe", "p_value"])
fisher_exact_test = struct_udf(fisher_values, ["p_value", "odds_ratio", "ci_95_lower", "ci_95_upper"])


def chi_squared_values(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    n, under = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    if under == 0:
        return math.nan, math.nan
    x = n * (a * d - b * c) ** 2 / under
    return float(1 - gamma_p(np.array([0.5]), np.array([x / 2]))[0]), a * d / (b * c) if b * c else math.inf


chi_squared_test = struct_udf(chi_squared_values, ["p_value", "odds_ratio"])


def contingency_table_test(a, b, c, d, min_cell_count: int) -> Column:
    """The chi-squared test where all cells reach the count, else Fisher's."""
    cells = [col(x) for x in (a, b, c, d)]
    fisher = fisher_exact_test(*cells)
    large = F.least(*cells) >= min_cell_count
    return F.when(large, chi_squared_test(*cells)).otherwise(F.struct(fisher["p_value"].alias("p_value"), fisher["odds_ratio"].alias("odds_ratio")))


def binom_test_value(successes: int, n: int, p: float, alternative: str) -> float:
    f = log_factorials(n)
    k = np.arange(n + 1)
    logs = f[n] - f[k] - f[n - k] + k * math.log(max(p, 1e-300)) + (n - k) * math.log(max(1 - p, 1e-300))
    q = np.exp(logs)
    if alternative == "less":
        return float(min(1.0, q[: successes + 1].sum()))
    if alternative == "greater":
        return float(min(1.0, q[successes:].sum()))
    return float(min(1.0, q[q <= q[successes] * (1 + 1e-7)].sum()))


def binom_test(successes, n, p: float, alternative: str = "two-sided") -> Column:
    """Exact binomial test."""
    return struct_udf(lambda k, m: (binom_test_value(k, m, p, alternative),), ["p_value"])(successes, n)["p_value"]


def phyper(k, total, good, drawn) -> Column:
    return struct_udf(lambda a, b, c, d: (phyper_value(a, b, c, d),), ["p"])(k, total, good, drawn)["p"]


def dnorm(x, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (col(x) - mu) / sigma
    return F.exp(-z * z / 2) / F.lit(sigma * math.sqrt(2 * math.pi))


def dpois(x, lamb) -> Column:
    k, lamb = col(x).cast("double"), col(lamb).cast("double")
    return vectorised(lambda a, b: np.exp(a * np.log(b) - b - lgamma(a + 1)))(k, lamb)


dchisq = vectorised(lambda x, n: np.exp((n / 2 - 1) * np.log(np.maximum(x, 1e-300)) - x / 2 - n / 2 * math.log(2) - lgamma(n / 2)))
dgamma = vectorised(lambda x, shape, scale: np.exp((shape - 1) * np.log(np.maximum(x, 1e-300)) - x / scale - shape * np.log(scale) - lgamma(shape)))
dbeta = vectorised(lambda x, a, b: np.exp((a - 1) * np.log(np.maximum(x, 1e-300)) + (b - 1) * np.log1p(-np.minimum(x, 1 - 1e-16)) + lgamma(a + b) - lgamma(a) - lgamma(b)))


def cochran_mantel_haenszel(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<test_statistic, p_value> from arrays of strata."""
    strata = F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    part = lambda f: F.aggregate(F.transform(strata, f), F.lit(0.0), lambda s, x: s + x)
    n = lambda s: (s["a"] + s["b"] + s["c"] + s["d"]).cast("double")
    top = part(lambda s: s["a"] - (s["a"] + s["b"]) * (s["a"] + s["c"]) / n(s))
    under = part(lambda s: (s["a"] + s["b"]) * (s["a"] + s["c"]) * (s["b"] + s["d"]) * (s["c"] + s["d"]) / (n(s) * n(s) * (n(s) - 1)))
    x = divide(top * top, under)
    return F.struct(x.alias("test_statistic"), pchisqtail(x, F.lit(1.0)).alias("p_value"))
