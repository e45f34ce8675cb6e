"""Dense arrays as struct<shape, data> in row-major order: numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from latticeframe.semantics import col

KIND = "shape array<bigint>, data array<double>"


def array(x, *shape: int) -> Column:
    """From an array column of numbers, with a shape (one axis if none is given)."""
    x = col(x).cast("array<double>")
    dims = F.array(*[F.lit(s).cast("bigint") for s in shape]) if shape else F.array(F.size(x).cast("bigint"))
    return F.struct(dims.alias("shape"), x.alias("data"))


def apply(f: Callable[..., np.ndarray], *xs) -> Column:
    """f of arrays, row by row of a batch; missing where an argument is."""

    @F.pandas_udf(KIND)
    def run(*s: pd.Series) -> pd.DataFrame:
        frames = [x if isinstance(x, pd.DataFrame) else pd.DataFrame(x.tolist()) for x in s]
        out = []
        for i in range(len(frames[0])):
            args = [np.array(d["data"].iloc[i], float).reshape([int(k) for k in d["shape"].iloc[i]]) if d["data"].iloc[i] is not None else None for d in frames]
            y = None if any(a is None for a in args) else np.asarray(f(*args), float)
            out.append((None, None) if y is None else (list(y.shape), y.ravel().tolist()))
        return pd.DataFrame(out, columns=["shape", "data"])

    return run(*[col(x) for x in xs])


def transpose(x) -> Column:
    return apply(np.transpose, x)


def matmul(a, b) -> Column:
    return apply(np.matmul, a, b)


def reshape(x, *shape: int) -> Column:
    return apply(lambda a: a.reshape(shape), x)


def add(a, b) -> Column:
    return apply(np.add, a, b)


def subtract(a, b) -> Column:
    return apply(np.subtract, a, b)


def multiply(a, b) -> Column:
    return apply(np.multiply, a, b)


def divide(a, b) -> Column:
    return apply(np.divide, a, b)


def maximum(a, b) -> Column:
    return apply(np.maximum, a, b)


def minimum(a, b) -> Column:
    return apply(np.minimum, a, b)


def inv(x) -> Column:
    return apply(np.linalg.inv, x)


def solve(a, b) -> Column:
    return apply(np.linalg.solve, a, b)


def solve_triangular(a, b, lower: bool = False) -> Column:
    return apply(lambda x, y: np.linalg.solve(np.tril(x) if lower else np.triu(x), y), a, b)


def qr_q(x) -> Column:
    return apply(lambda a: np.linalg.qr(a)[0], x)


def qr_r(x) -> Column:
    return apply(lambda a: np.linalg.qr(a)[1], x)


def singular_values(x) -> Column:
    return apply(lambda a: np.linalg.svd(a, compute_uv=False), x)


def eigenvalues(x) -> Column:
    return apply(np.linalg.eigvalsh, x)


def eigenvectors(x) -> Column:
    return apply(lambda a: np.linalg.eigh(a)[1], x)


def diagonal(x) -> Column:
    return apply(np.diagonal, x)


def vstack(*xs) -> Column:
    return apply(lambda *a: np.vstack(a), *xs)


def hstack(*xs) -> Column:
    return apply(lambda *a: np.hstack(a), *xs)


def sum_axis(x, axis: int | None = None) -> Column:
    return apply(lambda a: a.sum(axis), x)


def filled(value: float, *shape: int) -> Column:
    n = int(np.prod(shape))
    return F.struct(F.array(*[F.lit(s).cast("bigint") for s in shape]).alias("shape"), F.array_repeat(F.lit(float(value)), n).alias("data"))


def zeros(*shape: int) -> Column:
    return filled(0.0, *shape)


def ones(*shape: int) -> Column:
    return filled(1.0, *shape)


def arange(start: int, stop: int, step: int = 1) -> Column:
    values = list(range(start, stop, step))
    return F.struct(F.array(F.lit(len(values)).cast("bigint")).alias("shape"), F.array(*[F.lit(float(v)) for v in values]).alias("data"))


def eye(n: int) -> Column:
    return F.struct(F.array(F.lit(n).cast("bigint"), F.lit(n).cast("bigint")).alias("shape"), F.array(*[F.lit(float(i % (n + 1) == 0)) for i in range(n * n)]).alias("data"))


def element(x, *at: int) -> Column:
    """An element by its indices."""
    x = col(x)
    place = F.lit(0).cast("bigint")
    for axis, i in enumerate(at):
        place = place * F.get(x["shape"], F.lit(axis)) + i
    return F.get(x["data"], place.cast("int"))
