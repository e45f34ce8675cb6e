"""Query blocks against shards of vectors: what the exact and the approximate search share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from latticeframe.llm.common import Tables

def usable(vectors: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """(id long, vector array<double>) of the vectors that take part: id and vector present, not empty, all components present and finite, and unless zero is set, not all zero.

    The dimension is that of the usable vector with the smallest id; vectors of another length take no part.
    """
    vector = F.col(vector_col).cast("array<double>")
    good = (
        F.col("id").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & (F.lit(zero) | F.exists("vector", lambda x: x != 0))
    )
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(good)
    size = rows.agg(F.min(F.struct("id", F.size("vector").alias("size"))).alias("m")).first()["m"]
    return rows.where(F.size("vector") == (size["size"] if size else 0))


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def distinct(frame: pd.DataFrame, extra: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids in order with their vectors; of rows with one id the smallest vector stays. Rows of an id are all in one shard and one block."""
    ids, v = frame["id"].to_numpy(np.int64), matrix(frame["vector"])
    order = np.lexsort((*v.T[::-1], ids))
    first = order[np.concatenate([[True], np.diff(ids[order]) != 0])]
    return ids[first], v[first], [frame[c].to_numpy()[first] for c in extra]


def blocks(rows: DataFrame, queries: DataFrame, shards: int, query_blocks: int, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, first: int = 0) -> DataFrame:
    """run(queries, shard) for every block of queries and every shard from the given first one; a shard's rows and a block's queries are of bounded number."""
    n = max(1, (shards - first) * query_blocks)
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("long")
    of_rows = rows.withColumn("shard", shard).where(F.col("shard") >= first).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    of_queries = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(query_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(shards - 1).cast("long"))))
    of_queries, of_rows = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (of_queries, of_rows))  # columns of their own
    a, b = (x.repartition(n, "shard", "block").groupBy("shard", "block") for x in (of_queries, of_rows))
    return a.cogroup(b).applyInPandas(run, schema)


def best(found: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The k first of each query's finds, ranked."""
    by = W.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def plan(rows: DataFrame, is_query: Column, shard_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame, int, int, Tables]:
    """The usable rows, written once, the queries among them, and how many shards and blocks they make."""
    tables = Tables(rows.sparkSession)
    rows = tables.keep(rows)
    queries = rows.where(is_query)
    n, q = rows.count(), queries.count()
    return rows, queries, max(1, -(-n // shard_rows)), max(1, -(-q // block_rows)), tables
