"""Regressions of column fields on each row's entries.

Linear regression is a set of sums: covariates become orthonormal columns by a Cholesky factor of their Gram matrix, so
that one groupBy on the row key gives every row's statistics. Models without a closed form are fitted for many rows at
once by Newton's method on Arrow batches, which hold whole rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticeframe.functions.statistics import p_t_two_sided
from latticeframe.operators.blockmatrix import STRIPE, whole_groups
from latticeframe.operators.matrix import MatrixTable
from latticeframe.operators.table import Table
from latticeframe.semantics import col, divide


def design(matrix: MatrixTable, y: list, covariates: list) -> DataFrame:
    """Columns with all of y and covariates present: their keys, y0.. and c0.. as doubles."""
    values = {**{f"y{i}": col(v).cast("double") for i, v in enumerate(y)}, **{f"c{i}": col(v).cast("double") for i, v in enumerate(covariates)}}
    cols = matrix.cols_df.select(*matrix.col_key, *[v.alias(k) for k, v in values.items()])
    return cols.dropna(subset=list(values))


def linear_regression_rows(matrix: MatrixTable, y, x, covariates=(1.0,), pass_through=()) -> Table:
    """For each row, y regressed on the entry expression x with the covariates (give 1.0 for an intercept).

    Fields: n, sum_x, y_transpose_x, beta, standard_error, t_stat, p_value; arrays by phenotype if y is a list. Missing
    x take the row's mean; columns with a missing y or covariate are left out.
    """
    ys = list(y) if isinstance(y, (list, tuple)) else [y]
    k = len(covariates)
    cols = design(matrix, ys, list(covariates)).persist()
    gram = cols.agg(F.count("*").alias("n"), *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    n = gram["n"]
    inverse = np.linalg.inv(np.linalg.cholesky(np.array([[gram[f"g{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)]))) if k else np.zeros((0, 0))
    for i in range(k):
        cols = cols.withColumn(f"q{i}", sum((F.col(f"c{j}") * float(inverse[i, j]) for j in range(i + 1)), F.lit(0.0)))
    qs, yn = [f"q{i}" for i in range(k)], [f"y{i}" for i in range(len(ys))]
    totals = cols.agg(*[F.sum(v).alias(v) for v in [*qs, *yn]], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in yn for b in qs], *[F.sum(F.col(a) * F.col(a)).alias(f"{a}{a}") for a in yn]).first()
    entries = matrix.with_axes({"x": col(x)}).select(*matrix.row_key, *matrix.col_key, col(x).cast("double").alias("x")).where("x is not null and not isnan(x)")
    joined = entries.join(cols.select(*matrix.col_key, *qs, *yn), list(matrix.col_key))
    v = F.col("x")
    sums = [F.count("*").alias("m"), F.sum(v).alias("sx"), F.sum(v * v).alias("sxx"), *[F.sum(v * F.col(a)).alias(f"x{a}") for a in [*qs, *yn]], *[F.sum(a).alias(f"s{a}") for a in [*qs, *yn]]]
    rows = joined.groupBy(*matrix.row_key).agg(*sums)
    mean = F.col("sx") / F.col("m")
    full = lambda a: F.col(f"x{a}") + mean * (F.lit(float(totals[a] or 0.0)) - F.col(f"s{a}"))  # noqa: E731  with the mean in place of missing x
    xx = F.col("sxx") + (F.lit(float(n)) - F.col("m")) * mean * mean
    xq = [full(q) for q in qs]
    xxp = xx - sum((q * q for q in xq), F.lit(0.0))
    d = n - k - 1
    parts = []
    for a in yn:
        qy = [float(totals[f"{a}{q}"] or 0.0) for q in qs]
        yyp = float(totals[f"{a}{a}"] or 0.0) - sum(t * t for t in qy)
        xyp = full(a) - sum((q * t for q, t in zip(xq, qy, strict=True)), F.lit(0.0))
        good = xxp > F.lit(1e-12) * F.greatest(xx, F.lit(1e-300))
        beta = F.when(good, xyp / F.when(good, xxp)).otherwise(F.lit(float("nan")))
        se = F.sqrt(F.greatest((F.lit(yyp) / F.when(good, xxp) - beta * beta) / F.lit(float(d)), F.lit(0.0))) if d > 0 else F.lit(float("nan"))
        se = F.when(good, se).otherwise(F.lit(float("nan")))
        t = F.when(good, divide(beta, se)).otherwise(F.lit(float("nan")))
        parts.append({"y_transpose_x": full(a), "beta": beta, "standard_error": se, "t_stat": t, "p_value": F.when(F.isnan(t), F.lit(float("nan"))).otherwise(p_t_two_sided(t, F.lit(float(d)))) if d > 0 else F.lit(float("nan"))})
    many = isinstance(y, (list, tuple))
    named = {name: F.array(*[p[name] for p in parts]) if many else parts[0][name] for name in parts[0]}
    sum_x = F.col("sx") + (F.lit(float(n)) - F.col("m")) * mean
    out = rows.select(*matrix.row_key, F.lit(n).cast("int").alias("n"), sum_x.alias("sum_x"), *[c.alias(k2) for k2, c in named.items()])
    if pass_through:
        out = matrix.rows_df.select(*matrix.row_key, *pass_through).join(out, list(matrix.row_key))
    return Table(out, matrix.row_key)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solutions of many symmetric systems; NaN where one is singular to 13 digits once its diagonal is scaled to 1, or not finite."""
    n, p = b.shape
    root = np.sqrt(np.maximum(np.einsum("nii->ni", a), 0.0))
    good = np.isfinite(a).all((1, 2)) & np.isfinite(b).all(1) & (root > 0).all(1)
    root = np.where(good[:, None], root, 1.0)
    scaled = np.where(good[:, None, None], a, np.eye(p)) / root[:, :, None] / root[:, None]
    good &= (np.linalg.eigvalsh(scaled) > 1e-13).all(1)
    scaled = np.where(good[:, None, None], scaled, np.eye(p))
    return np.where(good[:, None], np.linalg.solve(scaled, (b / root)[:, :, None])[:, :, 0] / root, np.nan)


def means(eta: np.ndarray, family: str) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of the family."""
    if family == "logistic":
        mu = 1 / (1 + np.exp(-eta))
        return mu, mu * (1 - mu)
    mu = np.exp(np.minimum(eta, 300))
    return mu, mu


def moments(x: np.ndarray, weight: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """By group the sum of the weighted outer products of the rows of x."""
    p = x.shape[1]
    out = np.zeros((n, p, p))
    for i in range(p):
        for j in range(i + 1):
            out[:, i, j] = out[:, j, i] = np.bincount(group, weights=weight * x[:, i] * x[:, j], minlength=n)
    return out


def sums(x: np.ndarray, weight: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """By group the weighted sum of the rows of x."""
    return np.column_stack([np.zeros((n, 0)), *[np.bincount(group, weights=weight * x[:, i], minlength=n) for i in range(x.shape[1])]])


def glm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, group: np.ndarray, family: str, start: np.ndarray, firth: bool = False, max_iterations: int = 25, tolerance: float = 1e-6):
    """Newton's method for many logistic or Poisson regressions at once, row i being weight[i] equal cases of model group[i]: by model the coefficients (from start), information matrix, log likelihood, iterations, converged."""
    n, p = start.shape
    b, info, log_lik, steps, done = start.copy(), np.full((n, p, p), np.nan), np.full(n, np.nan), np.full(n, max_iterations), np.zeros(n, bool)
    live = np.arange(n)  # the models at work; group has their places there

    def linear(x, group, b):
        return np.clip(np.einsum("ij,ij->i", x, b[group]), -500, 500)

    for step in range(1, max_iterations + 1):
        mu, w = means(linear(x, group, b[live]), family)
        now, off = moments(x, weight * w, group, len(live)), y - mu
        if firth:
            off = off + w * np.einsum("ij,ijk,ik->i", x, np.linalg.pinv(now)[group], x) * (0.5 - mu)
        delta = solve(now, sums(x, weight * off, group, len(live)))
        lost = ~np.isfinite(delta).all(1)
        b[live[~lost]] += delta[~lost]
        settled = ~lost & (np.abs(delta).max(1, initial=0) < tolerance)
        steps[live[lost | settled]] = step
        if settled.any():
            some, to, at = settled[group], live[settled], np.cumsum(settled) - 1
            x1, y1, m1, g1 = x[some], y[some], weight[some], at[group[some]]
            eta = linear(x1, g1, b[to])
            mu, w = means(eta, family)
            info[to], done[to] = moments(x1, m1 * w, g1, len(to)), True
            log_lik[to] = np.bincount(g1, weights=m1 * (y1 * eta - (np.logaddexp(0, eta) if family == "logistic" else mu)), minlength=len(to))
            if firth:
                log_lik[to] += 0.5 * np.linalg.slogdet(info[to])[1]
        keep = ~(lost | settled)
        if not keep.any():
            break
        some = keep[group]
        x, y, weight, group = x[some], y[some], weight[some], (np.cumsum(keep) - 1)[group[some]]
        live = live[keep]
    return b, info, log_lik, steps, done


def chi_tail(x: np.ndarray) -> np.ndarray:
    """The upper tail of chi-squared with one degree of freedom."""
    return np.array([math.erfc(math.sqrt(max(v, 0.0) / 2)) if math.isfinite(v) else math.nan for v in x], float)


CASES = 1 << 18  # cases fitted at once


def glm_rows(matrix: MatrixTable, test: str, family: str, y, x, covariates, max_iterations: int, tolerance: float) -> Table:
    """Fields by test: wald has beta, standard_error, z_stat, p_value; lrt and firth beta, chi_sq_stat, p_value; score chi_sq_stat, p_value; all but score n_iterations, converged.

    Columns without an entry take the row's mean. They are fitted as weighted cases, one for each distinct
    combination of y and covariates, so a row costs its own entries and the number of combinations. A row whose x is
    collinear with the covariates does not converge.
    """
    k = len(covariates)
    cols = design(matrix, [y], list(covariates))
    names = ["y0", *[f"c{i}" for i in range(k)]]
    shared = cols.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).toPandas()  # a row for each combination, at most the columns of the matrix
    y_of, c_of, times = shared["y0"].to_numpy(float), shared[names[1:]].to_numpy(float), shared["n"].to_numpy(float)
    start = np.zeros((1, k))
    if k and family == "poisson" and np.allclose(c_of[:, 0], 1):
        start[0, 0] = np.log(max(times @ y_of / max(times.sum(), 1), 1e-9))
    plain = [f[0] for f in glm(c_of, y_of, times, np.zeros(len(times), int), family, start, False, max_iterations, tolerance)]
    base = plain if test != "firth" else [f[0] for f in glm(c_of, y_of, times, np.zeros(len(times), int), family, np.zeros((1, k)), True, max_iterations, tolerance)]
    row_key, col_key = list(matrix.row_key), list(matrix.col_key)
    codes = matrix.rows_df.sparkSession.createDataFrame([(*map(float, r), i) for i, r in enumerate(shared[names].to_numpy(float))], ", ".join(f"{n} double" for n in names) + ", __code int")
    entries = matrix.with_axes({"x": col(x)}).select(*row_key, *col_key, col(x).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    joined = entries.join(cols.join(codes, names).select(*col_key, "__code"), col_key)
    first = F.row_number().over(Window.partitionBy(*row_key).orderBy(*col_key)) == 1
    joined = joined.select(*row_key, "__x", "__code", first.alias("__first"))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matrix.rows_df.select(*row_key).schema.fields)
    fields = {"wald": ["beta", "standard_error", "z_stat", "p_value"], "lrt": ["beta", "chi_sq_stat", "p_value"], "firth": ["beta", "chi_sq_stat", "p_value"], "score": ["chi_sq_stat", "p_value"]}[test]
    least, most, n_codes = STRIPE, CASES, len(times)

    def fit(x: np.ndarray, code: np.ndarray, row: np.ndarray, n: int) -> dict:
        own = np.bincount(row * n_codes + code, minlength=n * n_codes).reshape(n, n_codes)
        mean = np.bincount(row, weights=x, minlength=n) / np.bincount(row, minlength=n)
        rest = np.maximum(times - own, 0.0)
        at, other = np.nonzero(rest)
        x, code, row, weight = np.concatenate([x, mean[at]]), np.concatenate([code, other]), np.concatenate([row, at]), np.concatenate([np.ones(len(x)), rest[at, other]])
        full, yy = np.column_stack([x, c_of[code]]), y_of[code]
        if test == "score":
            mu, w = means(np.clip(c_of[code] @ plain[0], -500, 500), family)
            u = sums(full, weight * (yy - mu), row, n)
            chi = np.einsum("ij,ij->i", u, solve(moments(full, weight * w, row, n), u)) if plain[4] else np.full(n, np.nan)
            return {"chi_sq_stat": chi, "p_value": chi_tail(chi)}
        b, info, log_lik, steps, done = glm(full, yy, weight, row, family, np.tile(np.concatenate([[0.0], plain[0]]), (n, 1)), test == "firth", max_iterations, tolerance)
        out = {"beta": np.where(done, b[:, 0], np.nan)}
        if test == "wald":
            with np.errstate(all="ignore"):
                se = np.sqrt(solve(info, np.tile(np.eye(k + 1)[0], (n, 1)))[:, 0])
                z = np.where(se > 0, out["beta"] / se, np.nan)
            out |= {"standard_error": se, "z_stat": z, "p_value": chi_tail(z * z)}
        else:
            chi = np.where(done & base[4], 2 * (log_lik - base[2]), np.nan)
            out |= {"chi_sq_stat": chi, "p_value": chi_tail(chi)}
        return out | {"n_iterations": steps, "converged": done}

    def run(batches):
        for t in whole_groups(batches, lambda t: t["__first"].to_numpy(), least):
            x, code, start = t["__x"].to_numpy(), t["__code"].to_numpy().astype(np.int64), np.flatnonzero(t["__first"].to_numpy())
            ends = np.append(start, t.num_rows)
            size = np.diff(ends)
            part = np.cumsum(size + n_codes) // most  # rows fitted at once
            for rows in np.split(np.arange(len(start)), np.flatnonzero(np.diff(part)) + 1):
                low, high = ends[rows[0]], ends[rows[-1] + 1]
                done = fit(x[low:high], code[low:high], np.repeat(np.arange(len(rows)), size[rows]), len(rows))
                made = t.select(row_key).take(pa.array(start[rows])).combine_chunks()
                for f in fields:
                    made = made.append_column(f, pa.array(done[f], from_pandas=True))
                if test != "score":
                    made = made.append_column("n_iterations", pa.array(done["n_iterations"].astype(np.int32))).append_column("converged", pa.array(done["converged"]))
                yield from made.to_batches()

    schema = f"{keys}, {', '.join(f'{n} double' for n in fields)}" + ("" if test == "score" else ", n_iterations int, converged boolean")
    return Table(joined.mapInArrow(run, schema), row_key)


def logistic_regression_rows(matrix: MatrixTable, test: str, y, x, covariates=(1.0,), max_iterations: int = 25, tolerance: float = 1e-6) -> Table:
    """wald, lrt, score or firth test of each row's x in a logistic model of y."""
    return glm_rows(matrix, test, "logistic", y, x, covariates, max_iterations, tolerance)


def poisson_regression_rows(matrix: MatrixTable, test: str, y, x, covariates=(1.0,), max_iterations: int = 25, tolerance: float = 1e-6) -> Table:
    """wald, lrt or score test of each row's x in a Poisson model of y."""
    return glm_rows(matrix, test, "poisson", y, x, covariates, max_iterations, tolerance)


def linreg_fit(row, k: int) -> dict:
    """Coefficients from the sums of aggregators.linreg, on the driver."""
    xtx, xty = np.array(row["xtx"]), np.array(row["xty"])
    beta = np.linalg.solve(xtx, xty)
    n = row["n"]
    rss = row["yty"] - beta @ xty
    s2 = rss / (n - k)
    se = np.sqrt(np.diag(np.linalg.inv(xtx)) * s2)
    return {"beta": beta.tolist(), "standard_error": se.tolist(), "t_stat": (beta / se).tolist(), "multiple_standard_error": float(np.sqrt(s2)), "multiple_r_squared": float(1 - rss / (row["yty"] - row["sy"] ** 2 / n)), "n": n}


def lambda_gc(p_values: Column) -> Column:
    """Genomic control: the median chi-squared statistic over its expectation, from p values."""
    from latticeframe.functions.statistics import qchisqtail

    return F.median(qchisqtail(p_values, F.lit(1.0))) / F.lit(0.4549364231195727)
