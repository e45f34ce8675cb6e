"""Block matrices: a distributed float64 matrix as rows (block row, block column, data), absent blocks being zero.

Elementwise operations join on block coordinates, products join on the inner coordinate and sum partial products of
blocks; each block is a numpy array packed in binary, and numpy works on Arrow batches.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.plans.materialize import materialize

SCHEMA = "br int, bc int, data binary"
BLOCK = 512
STRIPE = 1 << 17  # entries in a stripe of whole rows
BASIS = 1 << 24  # numbers in the driver's basis of a Krylov space


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, np.float64).tobytes()


class BlockMatrix:
    def __init__(self, blocks: DataFrame, n_rows: int, n_cols: int, block: int = BLOCK):
        self.blocks, self.n_rows, self.n_cols, self.block = blocks, n_rows, n_cols, block

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_rows, self.n_cols

    def grid(self) -> tuple[int, int]:
        return -(-self.n_rows // self.block), -(-self.n_cols // self.block)

    @property
    def size_of(self) -> Callable[[int, int], tuple[int, int]]:
        """The shape of a block; a function of its own, so that executors do not get the DataFrame."""
        n, m, block = self.n_rows, self.n_cols, self.block
        return lambda br, bc: (min(block, n - br * block), min(block, m - bc * block))

    def new(self, blocks: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> BlockMatrix:
        return BlockMatrix(blocks, self.n_rows if n_rows is None else n_rows, self.n_cols if n_cols is None else n_cols, self.block)

    # construction

    @staticmethod
    def from_numpy(spark: SparkSession, a: np.ndarray, block: int = BLOCK) -> BlockMatrix:
        n, m = a.shape
        rows = [(i // block, j // block, pack(a[i : i + block, j : j + block])) for i in range(0, n, block) for j in range(0, m, block)]
        return BlockMatrix(spark.createDataFrame(rows, SCHEMA), n, m, block)

    @staticmethod
    def generate(spark: SparkSession, n_rows: int, n_cols: int, make: Callable[[int, int, tuple[int, int]], np.ndarray], block: int = BLOCK) -> BlockMatrix:
        """Blocks made where they are kept: make(block row, block column, shape)."""
        g, h = -(-n_rows // block), -(-n_cols // block)
        ids = spark.range(g * h).select((F.col("id") / h).cast("int").alias("br"), (F.col("id") % h).cast("int").alias("bc"))

        def run(frames):
            for f in frames:
                data = [pack(make(r, c, (min(block, n_rows - r * block), min(block, n_cols - c * block)))) for r, c in zip(f.br, f.bc, strict=True)]
                yield pd.DataFrame({"br": f.br, "bc": f.bc, "data": data})

        return BlockMatrix(ids.mapInPandas(run, SCHEMA), n_rows, n_cols, block)

    @staticmethod
    def fill(spark: SparkSession, n_rows: int, n_cols: int, value: float, block: int = BLOCK) -> BlockMatrix:
        return BlockMatrix.generate(spark, n_rows, n_cols, lambda r, c, s: np.full(s, value), block)

    @staticmethod
    def random(spark: SparkSession, n_rows: int, n_cols: int, seed: int = 0, gaussian: bool = True, block: int = BLOCK) -> BlockMatrix:
        def make(r: int, c: int, s):
            rng = np.random.default_rng([seed, r, c])
            return rng.normal(size=s) if gaussian else rng.random(s)

        return BlockMatrix.generate(spark, n_rows, n_cols, make, block)

    @staticmethod
    def from_entries(entries: DataFrame, n_rows: int, n_cols: int, block: int = BLOCK) -> BlockMatrix:
        """From rows (i, j, v); a block gathers at most block x block entries. Absent entries are zero, repeated ones add up."""
        e = entries.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
        keyed = e.select((F.col("i") / block).cast("int").alias("br"), (F.col("j") / block).cast("int").alias("bc"), (F.col("i") % block).cast("int").alias("r"), (F.col("j") % block).cast("int").alias("c"), "v")

        def build(key, f: pd.DataFrame) -> pd.DataFrame:
            br, bc = key
            a = np.zeros((min(block, n_rows - br * block), min(block, n_cols - bc * block)))
            np.add.at(a, (f.r.to_numpy(), f.c.to_numpy()), f.v.to_numpy())
            return pd.DataFrame({"br": [br], "bc": [bc], "data": [pack(a)]})

        return BlockMatrix(keyed.groupBy("br", "bc").applyInPandas(build, SCHEMA), n_rows, n_cols, block)

    @staticmethod
    def from_matrix(matrix, field: str, mean_impute: bool = False, center: bool = False, normalize: bool = False, block: int = BLOCK) -> BlockMatrix:
        """Rows and columns of a matrix table in key order; missing entries are an error of the caller unless mean_impute."""
        e, n_rows, n_cols = BlockMatrix.entries_of(matrix, field, mean_impute, center, normalize)
        return BlockMatrix.from_entries(e, n_rows, n_cols, block)

    @staticmethod
    def entries_of(matrix, field: str, mean_impute: bool = False, center: bool = False, normalize: bool = False) -> tuple[DataFrame, int, int]:
        """Rows (i, j, v), the places in key order, and the numbers of rows and columns."""
        rows, cols = matrix.rows().add_index("__i").df.select(*matrix.row_key, "__i"), matrix.cols().add_index("__j").df.select(*matrix.col_key, "__j")
        e = matrix.entries_df.select(*matrix.row_key, *matrix.col_key, F.col(f"`{field}`").cast("double").alias("v")).where("v is not null")
        n_cols = cols.count()
        e = e.join(rows, list(matrix.row_key)).join(cols, list(matrix.col_key)).select(F.col("__i").alias("i"), F.col("__j").alias("j"), "v")
        if mean_impute or center or normalize:
            stats = e.groupBy("i").agg(F.avg("v").alias("m"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count("*").alias("n"))
            grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("j")) if mean_impute else e.join(stats, "i")
            e = grid.join(e, ["i", "j"], "left").withColumn("v", F.coalesce("v", "m")) if mean_impute else grid
            if center or normalize:
                spread = F.sqrt(F.greatest(F.col("q") - F.col("n") * F.col("m") * F.col("m"), F.lit(0.0)))
                e = e.withColumn("v", F.col("v") - F.col("m"))
                e = e.withColumn("v", F.when(spread > 0, F.col("v") / F.when(spread > 0, spread)).otherwise(0.0)) if normalize else e
        return e.select("i", "j", "v"), rows.count(), n_cols

    # elementwise

    def map_blocks(self, f: Callable[[np.ndarray, int, int], np.ndarray]) -> DataFrame:
        size = self.size_of

        def run(frames):
            for x in frames:
                out = [pack(f(np.frombuffer(d).reshape(size(r, c)), r, c)) for r, c, d in zip(x.br, x.bc, x.data, strict=True)]
                yield pd.DataFrame({"br": x.br, "bc": x.bc, "data": out})

        return self.blocks.mapInPandas(run, SCHEMA)

    def map(self, f: Callable[[np.ndarray], np.ndarray]) -> BlockMatrix:
        """f on present blocks; densify first where f(0) is not 0."""
        return self.new(self.map_blocks(lambda a, r, c: f(a)))

    def densify(self) -> BlockMatrix:
        zero = BlockMatrix.fill(self.blocks.sparkSession, self.n_rows, self.n_cols, 0.0, self.block).blocks
        have = self.blocks.withColumnRenamed("data", "d")
        return self.new(zero.join(have, ["br", "bc"], "left").select("br", "bc", F.coalesce("d", "data").alias("data")))

    def combine(self, other: BlockMatrix, f: Callable[[np.ndarray, np.ndarray], np.ndarray], how: str = "full") -> BlockMatrix:
        if self.shape != other.shape or self.block != other.block:
            raise ValueError("shapes differ")
        size = self.size_of
        joined = self.blocks.join(other.blocks.withColumnRenamed("data", "d2"), ["br", "bc"], how)

        def run(frames):
            for x in frames:
                get = lambda d, r, c: np.frombuffer(d).reshape(size(r, c)) if d is not None else np.zeros(size(r, c))
                with np.errstate(all="ignore"):
                    out = [pack(f(get(a, r, c), get(b, r, c))) for r, c, a, b in zip(x.br, x.bc, x.data, x.d2, strict=True)]
                yield pd.DataFrame({"br": x.br, "bc": x.bc, "data": out})

        return self.new(joined.mapInPandas(run, SCHEMA))

    def op(self, other, f, sparse: bool) -> BlockMatrix:
        if isinstance(other, BlockMatrix):
            return (self if sparse else self.densify()).combine(other if sparse else other.densify(), f)
        value = np.asarray(other, float)
        if value.ndim == 0:
            base = self if sparse or float(f(np.zeros(1), value)[0]) == 0 else self.densify()
            return base.map(lambda a: f(a, value))
        if value.shape not in ((1, self.n_cols), (self.n_rows, 1), (self.n_cols,)):
            raise ValueError("a number, a row or a column")
        value, b = value.reshape(1, -1) if value.ndim == 1 else value, self.block
        cut = lambda r, c: value[:, c * b : (c + 1) * b] if value.shape[0] == 1 else value[r * b : (r + 1) * b]
        return self.new(self.densify().map_blocks(lambda a, r, c: f(a, cut(r, c))))

    def __add__(self, other):
        return self.op(other, lambda a, b: a + b, isinstance(other, BlockMatrix))

    def __sub__(self, other):
        return self.op(other, lambda a, b: a - b, isinstance(other, BlockMatrix))

    def __mul__(self, other):
        return self.op(other, lambda a, b: a * b, True)

    def __truediv__(self, other):
        return self.op(other, lambda a, b: a / b, not isinstance(other, BlockMatrix) and np.ndim(other) == 0)

    def __pow__(self, x: float):
        return (self if x > 0 else self.densify()).map(lambda a: a**x)

    def __neg__(self):
        return self.map(np.negative)

    def sqrt(self):
        return self.map(np.sqrt)

    def abs(self):
        return self.map(np.abs)

    def floor(self):
        return self.map(np.floor)

    def ceil(self):
        return self.map(np.ceil)

    def log(self):
        return self.densify().map(np.log)

    # structure

    @property
    def T(self) -> BlockMatrix:  # noqa: N802
        done = self.map_blocks(lambda a, r, c: a.T)
        return BlockMatrix(done.select(F.col("bc").alias("br"), F.col("br").alias("bc"), "data"), self.n_cols, self.n_rows, self.block)

    def __matmul__(self, other: BlockMatrix) -> BlockMatrix:
        """Partial products of blocks, joined on the inner coordinate, are summed by result block; sums combine two at a time and are never gathered."""
        if self.n_cols != other.n_rows or self.block != other.block:
            raise ValueError("shapes differ")
        left_size, right_size, out = self.size_of, other.size_of, BlockMatrix(self.blocks, self.n_rows, other.n_cols, self.block)
        left = self.blocks.select(F.col("br"), F.col("bc").alias("k"), F.col("data").alias("a"))
        right = other.blocks.select(F.col("br").alias("k"), F.col("bc"), F.col("data").alias("b"))

        def multiply(frames):
            for x in frames:
                data = [pack(np.frombuffer(a).reshape(left_size(r, k)) @ np.frombuffer(b).reshape(right_size(k, c))) for r, c, k, a, b in zip(x.br, x.bc, x.k, x.a, x.b, strict=True)]
                yield pd.DataFrame({"br": x.br, "bc": x.bc, "data": data})

        products = left.join(right, "k").mapInPandas(multiply, SCHEMA)
        return out.new(add_up(products, out.size_of, self.grid()[1]))

    def filter_rows(self, keep: list[int]) -> BlockMatrix:
        return self.filter(keep, None)

    def filter_cols(self, keep: list[int]) -> BlockMatrix:
        return self.filter(None, keep)

    def filter(self, rows: list[int] | None, cols: list[int] | None) -> BlockMatrix:
        e = self.entries()
        spark = self.blocks.sparkSession
        for axis, keep in (("i", rows), ("j", cols)):
            if keep is not None:
                to = spark.createDataFrame([(int(k), n) for n, k in enumerate(keep)], f"{axis} long, n long")
                e = e.join(to, axis).drop(axis).withColumnRenamed("n", axis)
        return BlockMatrix.from_entries(e, self.n_rows if rows is None else len(rows), self.n_cols if cols is None else len(cols), self.block)

    def __getitem__(self, key):
        rows, cols = key
        if isinstance(rows, int) and isinstance(cols, int):
            got = self.blocks.where((F.col("br") == rows // self.block) & (F.col("bc") == cols // self.block)).first()
            return 0.0 if got is None else float(np.frombuffer(got["data"]).reshape(self.size_of(got["br"], got["bc"]))[rows % self.block, cols % self.block])
        spread = lambda s, n: None if s == slice(None) else [s] if isinstance(s, int) else list(range(*s.indices(n)))
        return self.filter(spread(rows, self.n_rows), spread(cols, self.n_cols))

    def sparsify(self, keep_block, mask, blocks_only: bool) -> BlockMatrix:
        kept, b = self.new(self.blocks.where(keep_block)), self.block
        if blocks_only:
            return kept

        def cut(a: np.ndarray, r: int, c: int) -> np.ndarray:
            i, j = np.arange(a.shape[0])[:, None] + r * b, np.arange(a.shape[1])[None] + c * b
            return np.where(mask(i, j), a, 0.0)

        return self.new(kept.map_blocks(cut))

    def sparsify_band(self, lower: int = 0, upper: int = 0, blocks_only: bool = False) -> BlockMatrix:
        """Entries with lower <= j - i <= upper; blocks outside the band go."""
        b = self.block
        near = ((F.col("bc") + 1) * b - 1 - F.col("br") * b >= lower) & (F.col("bc") * b - ((F.col("br") + 1) * b - 1) <= upper)
        return self.sparsify(near, lambda i, j: (j - i >= lower) & (j - i <= upper), blocks_only)

    def sparsify_triangle(self, lower: bool = False, blocks_only: bool = False) -> BlockMatrix:
        n = max(self.shape)
        return self.sparsify_band(-n, 0, blocks_only) if lower else self.sparsify_band(0, n, blocks_only)

    def sparsify_row_intervals(self, starts: list[int], stops: list[int], blocks_only: bool = False) -> BlockMatrix:
        """Of row i the entries with starts[i] <= j < stops[i]."""
        lo, hi = np.array(starts), np.array(stops)
        return self.sparsify(F.lit(True), lambda i, j: (j >= lo[i]) & (j < hi[i]), False)

    def sparsify_rectangles(self, rectangles: list[tuple[int, int, int, int]]) -> BlockMatrix:
        """Blocks that meet one of the rectangles (row start, row stop, column start, column stop)."""
        b, near = self.block, F.lit(False)
        for r0, r1, c0, c1 in rectangles:
            near = near | ((F.col("br") >= r0 // b) & (F.col("br") <= (r1 - 1) // b) & (F.col("bc") >= c0 // b) & (F.col("bc") <= (c1 - 1) // b))
        return self.new(self.blocks.where(near))

    def is_sparse(self) -> bool:
        g, h = self.grid()
        return self.blocks.count() < g * h

    # reductions and other forms

    def sum(self, axis: int | None = None):
        """The sum of all entries, or a row (axis 0) or column (axis 1) of sums."""
        size = self.size_of

        def run(frames):
            for x in frames:
                rows = [(r, c, np.frombuffer(d).reshape(size(r, c))) for r, c, d in zip(x.br, x.bc, x.data, strict=True)]
                if axis is None:
                    yield pd.DataFrame({"br": [0] * len(rows), "bc": [0] * len(rows), "data": [pack(a.sum().reshape(1, 1)) for _, _, a in rows]})
                else:
                    yield pd.DataFrame({"br": [0 if axis == 0 else r for r, _, _ in rows], "bc": [c if axis == 0 else 0 for _, c, _ in rows], "data": [pack(a.sum(axis, keepdims=True)) for _, _, a in rows]})

        part = self.blocks.mapInPandas(run, SCHEMA)
        if axis is None:
            return sum(np.frombuffer(r["data"])[0] for r in add_up(part, lambda r, c: (1, 1), max(self.grid())).collect())
        out = BlockMatrix(part, 1 if axis == 0 else self.n_rows, self.n_cols if axis == 0 else 1, self.block)
        return out.new(add_up(part, out.size_of, self.grid()[axis]))

    def diagonal(self) -> np.ndarray:
        out = np.zeros(min(self.shape))
        for r in self.blocks.where("br = bc").collect():
            d = np.diagonal(np.frombuffer(r["data"]).reshape(self.size_of(r["br"], r["bc"])))
            out[r["br"] * self.block : r["br"] * self.block + len(d)] = d
        return out

    def entries(self) -> DataFrame:
        """Rows (i, j, v) of present blocks."""
        size, b = self.size_of, self.block

        def run(frames):
            for x in frames:
                for r, c, d in zip(x.br, x.bc, x.data, strict=True):
                    n, m = size(r, c)
                    yield pd.DataFrame({"i": np.repeat(np.arange(n) + r * b, m), "j": np.tile(np.arange(m) + c * b, n), "v": np.frombuffer(d)})

        return self.blocks.mapInPandas(run, "i long, j long, v double")

    def to_numpy(self) -> np.ndarray:
        out = np.zeros(self.shape)
        for r in self.blocks.collect():
            n, m = self.size_of(r["br"], r["bc"])
            out[r["br"] * self.block : r["br"] * self.block + n, r["bc"] * self.block : r["bc"] * self.block + m] = np.frombuffer(r["data"]).reshape(n, m)
        return out

    def to_table_row_major(self):
        from latticeframe.operators.table import Table

        rows = self.densify().entries().groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("entries"))
        return Table(rows.select(F.col("i").alias("row_idx"), "entries"), "row_idx")

    def to_matrix_table_row_major(self):
        from latticeframe.operators.matrix import MatrixTable

        spark = self.blocks.sparkSession
        e = self.densify().entries().select(F.col("i").alias("row_idx"), F.col("j").alias("col_idx"), F.col("v").alias("element"))
        return MatrixTable(spark.range(self.n_rows).withColumnRenamed("id", "row_idx"), spark.range(self.n_cols).withColumnRenamed("id", "col_idx"), e, ["row_idx"], ["col_idx"])

    def svd(self, k: int, rounds: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k leading singular triplets, on the driver, which so holds k values for each row and column; leading() keeps the left ones distributed."""
        if self.n_rows < self.n_cols:
            v, values, u = self.T.svd(k, rounds, seed)
            return u.T, values, v.T
        values, right, left = self.leading(k, rounds, seed)
        u = np.zeros((self.n_rows, len(values)))
        for r in left.collect():
            u[r["i"]] = r["vector"]
        return u, values, right.T

    def leading(self, k: int, rounds: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray, DataFrame]:
        """Of the k leading triplets the singular values, the right vectors as columns, and rows (i, vector) with the left vectors' components by row; rows without an entry other than 0 have none."""
        return leading_triplets(self.entries().where("v <> 0"), self.n_cols, k, rounds, seed)

    # storage

    def write(self, path: str, overwrite: bool = False) -> None:
        from latticeframe.sources.native import write_json

        self.blocks.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/blocks")
        write_json(self.blocks.sparkSession, f"{path}/metadata.json", {"kind": "blocks", "n_rows": self.n_rows, "n_cols": self.n_cols, "block": self.block}, overwrite)

    @staticmethod
    def read(spark: SparkSession, path: str) -> BlockMatrix:
        from latticeframe.sources.native import read_json

        m = read_json(spark, f"{path}/metadata.json")
        return BlockMatrix(spark.read.parquet(f"{path}/blocks"), m["n_rows"], m["n_cols"], m["block"])

    def checkpoint(self, path: str, overwrite: bool = False) -> BlockMatrix:
        self.write(path, overwrite)
        return BlockMatrix.read(self.blocks.sparkSession, path)

    def persist(self, *_) -> BlockMatrix:
        self.blocks.persist()
        return self

    def unpersist(self) -> BlockMatrix:
        self.blocks.unpersist()
        return self

    def export(self, path: str, delimiter: str = "\t") -> None:
        """Text, a line for each row, in order."""
        t = self.to_table_row_major().df.orderBy("row_idx")
        t.select(F.array_join(F.transform("entries", lambda v: v.cast("string")), delimiter).alias("value")).write.text(path)


def add_up(parts: DataFrame, size, inner: int) -> DataFrame:
    """Blocks of one place summed, over groups of a bounded number of parts at a time."""
    fan = 64

    def total(key, f: pd.DataFrame) -> pd.DataFrame:
        acc = np.zeros(size(int(key[0]), int(key[1])))
        for d in f.data:
            acc += np.frombuffer(d).reshape(acc.shape)
        return pd.DataFrame({"br": [key[0]], "bc": [key[1]], "data": [pack(acc)]})

    if inner > fan:  # a first round by a hash of the partition's rows
        salted = parts.withColumn("s", F.pmod(F.monotonically_increasing_id(), F.lit(-(-inner // fan))).cast("int"))
        parts = salted.groupBy("br", "bc", "s").applyInPandas(total, SCHEMA)
    return parts.groupBy("br", "bc").applyInPandas(total, SCHEMA)


def whole_groups(batches, starts: Callable[[pa.Table], np.ndarray], least: int):
    """Arrow tables of at least so many rows, but for the last, cut where a group of consecutive rows starts."""
    rest, rows = [], 0
    for b in batches:
        rest, rows = [*rest, b], rows + b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(rest)
        cut = int(np.flatnonzero(starts(t))[-1])
        if cut:
            yield t.slice(0, cut)
            rest, rows = t.slice(cut).to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(rest)


SPARSE = "i binary, size binary, cols binary, at binary, v binary"


def sparse_rows(entries: DataFrame) -> DataFrame:
    """Rows SPARSE of entries (i, j, v), written once: stripes of whole matrix rows with their numbers and sizes, the distinct columns of the stripe, and of each entry the place of its column there and its value."""
    least = STRIPE

    def change(t: pa.Table) -> np.ndarray:
        i = t["i"].to_numpy()
        return np.concatenate([[True], i[1:] != i[:-1]])

    def run(batches):
        for t in whole_groups(batches, change, least):
            start = np.flatnonzero(change(t))
            cols, at = np.unique(t["j"].to_numpy(), return_inverse=True)
            parts = [t["i"].to_numpy()[start], np.diff(np.append(start, t.num_rows)), cols, at.astype(np.int32), t["v"].to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], SPARSE.replace(" binary", "").split(", "))

    e = entries.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    return materialize(e.repartition("i").sortWithinPartitions("i", "j").mapInArrow(run, SPARSE))


def unpacked(batches):
    """Of each row SPARSE the arrays."""
    for b in batches:
        for row in zip(*b.columns, strict=True):
            yield [np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, (np.int64, np.int64, np.int64, np.int32, np.float64), strict=True)]


def leading_triplets(entries: DataFrame, m: int, k: int, rounds: int = 300, seed: int = 0) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Of the k leading singular triplets of a matrix of m columns the values, the right vectors as columns, and rows (i, vector) with the left vectors' components for rows with entries.

    The matrix is given by entries (i, j, v); absent ones are 0, and repeated ones add up. A block Krylov method,
    restarted with the best vectors when its basis is full, which goes on until the residuals of the k vectors are
    1e-10 of their squared values; after so many rounds without that it warns. Each round is one pass over the
    entries, which are written once, packed. The driver holds a basis of up to BASIS numbers or 3 (k + 8) for each
    column, with its images, and a task k + 8 numbers for each column; nothing that grows with the rows leaves the executors.
    """
    spark, width = entries.sparkSession, min(m, k + 8)
    kept = sparse_rows(entries)
    tasks = kept.rdd.getNumPartitions()

    def gram(q: np.ndarray) -> np.ndarray:
        """The transpose times the matrix times q."""
        shared, columns = spark.sparkContext.broadcast(q), q.shape[1]

        def run(batches):
            acc, some = np.zeros((m, columns)), False
            for _, size, cols, at, v in unpacked(batches):
                start, near, some = np.cumsum(size) - size, shared.value[cols], True
                for c in range(columns):
                    y = np.add.reduceat(v * np.ascontiguousarray(near[:, c])[at], start)
                    acc[cols, c] += np.bincount(at, weights=v * np.repeat(y, size), minlength=len(cols))
            for c in range(-(-m // BLOCK) if some else 0):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([0], pa.int32()), pa.array([pack(acc[c * BLOCK : (c + 1) * BLOCK])])], ["br", "bc", "data"])

        out = np.zeros((m, columns))
        for r in add_up(kept.mapInArrow(run, SCHEMA), lambda c, _: (min(BLOCK, m - c * BLOCK), columns), tasks).collect():
            out[r["br"] * BLOCK : (r["br"] + 1) * BLOCK] = np.frombuffer(r["data"]).reshape(-1, columns)
        shared.unpersist()
        return out

    most = max(3 * width, BASIS // max(m, 1))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, width)))[0]
    basis, images = np.zeros((m, 0)), np.zeros((m, 0))
    for _ in range(rounds):
        image = gram(q)
        basis, images = np.hstack([basis, q]), np.hstack([images, image])
        inner = basis.T @ images
        squares, turn = np.linalg.eigh((inner + inner.T) / 2)
        squares, turn = squares[::-1], turn[:, ::-1]
        off = np.linalg.norm(images @ turn[:, :k] - basis @ turn[:, :k] * squares[:k], axis=0)
        done = (off <= np.maximum(1e-10 * squares[:k], 1e-13 * abs(squares[:1]))).all()
        q = image / (abs(squares[:1]).max(initial=0) or 1.0)
        for _ in range(2):  # what the basis does not span
            left, length, _ = np.linalg.svd(q - basis @ (basis.T @ q), full_matrices=False)
            q = left[:, length > 1e-13][:, : m - basis.shape[1]]
        if done or not q.shape[1]:
            break
        if basis.shape[1] + q.shape[1] > most:
            basis, images = basis @ turn[:, : 2 * width], images @ turn[:, : 2 * width]
    else:
        warnings.warn(f"singular vectors have not settled after {rounds} rounds: residuals {off.tolist()} of {squares[:k].tolist()}", stacklevel=2)
    values, right = np.sqrt(np.maximum(squares[:k], 0.0)), basis @ turn[:, :k]
    scaled = spark.sparkContext.broadcast(right / np.where(values > 0, values, np.inf))

    def project(batches):
        for i, size, cols, at, v in unpacked(batches):
            start, near = np.cumsum(size) - size, scaled.value[cols]
            rows = np.column_stack([np.zeros((len(i), 0)), *[np.add.reduceat(v * np.ascontiguousarray(near[:, c])[at], start) for c in range(near.shape[1])]])
            vectors = pa.ListArray.from_arrays(np.arange(len(i) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(i), vectors], ["i", "vector"])

    return values, right, kept.mapInArrow(project, "i long, vector array<double>")
