"""What the operators share: shared-folder tables, slices of bounded size, word hashing and connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.plans.materialize import shared_folder as shared_dir


class Tables:
    """Intermediate tables in the shared folder. They cut lineage and outlive lost executors; drop() removes one early."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        """df, written once and read back; the path is in the result's attribute kept_at."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_of(name: str = "text") -> Column:
    """A text column with null taken as empty."""
    return F.coalesce(F.col(name), F.lit(""))


SLICE_BYTES = 1_000_000


def slices(batches, column: int, size: int = SLICE_BYTES):
    """Batches in parts whose values of a string, binary or list column take about so many bytes or items, at least a row each.

    Memory then follows the size and not the rows of an Arrow batch. Workers are reused by later operators, so freed memory goes back to the system at the end.
    """
    plain_memory()
    for b in batches:
        values = b.column(column)
        lengths = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes, low = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while low < b.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + size, "right")))
            yield b.slice(low, high - low)
            low = high
    hand_back()


@lru_cache(maxsize=1)
def plain_memory() -> None:
    """From now on this process takes Arrow's memory from the C library, and large blocks straight from the system, where they return as soon as they are free."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # the least size of a block of its own
    except (AttributeError, OSError):  # another C library
        return


def hand_back() -> None:
    """Freed memory of this process goes back to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


class Codes(dict):
    """Numbers words in order of first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finalizer (multiply and shift), vectorised."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of strings without nulls, the same on every machine; words of up to 16 bytes are hashed together."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    out = np.empty(len(words), np.uint64)
    sizes, low, offsets = np.diff(offsets), offsets[:1].sum(), offsets[: len(words)] - offsets[:1]
    total = int(sizes.sum())
    data = np.zeros(total // 8 * 8 + 32, np.uint8)
    if total:
        data[:total] = np.frombuffer(words.buffers()[2], np.uint8)[low : low + total]
    eights = data.view("<u8")

    def eight(at, n):
        """The n first bytes from each place, eight at most, as a number."""
        k, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
        return (eights[k] >> shift | eights[k + 1] << (np.uint64(63) - shift) << np.uint64(1)) & LOW_BYTES[np.minimum(n, 8)]

    for low in range(0, len(words), 1 << 15):
        at, n = offsets[low : low + (1 << 15)], sizes[low : low + (1 << 15)]
        more, second = np.flatnonzero(n > 8), np.zeros(len(n), np.uint64)
        second[more] = eight(at[more] + 8, n[more] - 8)
        out[low : low + len(n)] = mix(eight(at, n) ^ mix(second + n.astype(np.uint64), 41), 42)
    for i in np.flatnonzero(sizes > 16):
        out[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i] + sizes[i]].tobytes())
    return out


LEAST_BITS, MOST_BITS = 22, 27


def bit_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return mix(hashes, 51) >> np.uint64(64 - bits)


def bit_table(df: DataFrame, hash_of) -> np.ndarray:
    """A bit table with the places of hash_of(columns as arrays) of all rows set: a filter that lets all of them through and few others.

    About 32 bits a row, from 2 ** LEAST_BITS to 2 ** MOST_BITS bits, whatever the input: a table of few rows lets almost no other through.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * df.count()).bit_length()))

    def run(batches):
        for b in batches:
            at = np.unique(bit_of(hash_of(*[c.to_numpy(zero_copy_only=False) for c in b.columns]), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bits"])

    got = df.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = bit_of(hashes, len(table).bit_length() + 5)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def components(edges: DataFrame, tables: Tables, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b) of any ordered type: node, component (its smallest node).

    Alternates large-star and small-star steps over DataFrames. A node's smallest neighbour comes from a partial
    aggregate and goes back to its edges by a join, so the neighbours of a hub are never gathered in one task.
    Null ends and loops are ignored; a node without an edge to another node has no row. Each round is written to the shared folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        found = both.join(least, F.col("a") == F.col("k"))
        if large:
            out = found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = found.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
        return out.where("a > b").distinct()

    now = tables.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        after = tables.keep(star(star(now, True), False))
        new = after.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        tables.drop(now)
        now = after
        if tuple(new) == mark:
            break
        mark = tuple(new)
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
