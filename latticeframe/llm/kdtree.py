"""Exact top-k search by inner product: a KD-tree per shard.

Median splits on the widest side give nodes with tight boxes. A query visits nodes best first, by the highest inner
product that a point of the box could have, and stops where that falls below its k-th score. The k-th scores found in
the first shard go along to all others, so that these start from a bound.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.vectors import best, blocks, distinct, plan, usable

LEAF = 96
NONE = np.iinfo(np.int64).min


class Tree:
    """points (n, d) int64 in order of the leaves; node i has the box low[i]..high[i], the points begin[i]:end[i], and children left[i], left[i] + 1 unless it is a leaf (-1)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(ids))
        self.begin, self.end, self.left, lows, highs = [0], [len(ids)], [-1], [], []
        at = 0
        while at < len(self.begin):
            low, high = self.begin[at], self.end[at]
            part = points[order[low:high]]
            lows.append(part.min(0))
            highs.append(part.max(0))
            side = int((highs[-1] - lows[-1]).argmax())
            if high - low > LEAF and highs[-1][side] > lows[-1][side]:
                middle = (high - low) // 2
                order[low:high] = order[low:high][np.argpartition(part[:, side], middle)]
                self.left[at] = len(self.begin)
                self.begin += [low, low + middle]
                self.end += [low + middle, high]
                self.left += [-1, -1]
            at += 1
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array(lows), np.array(highs)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, nodes): no point of the node's box has a higher inner product; a little above it where doubles round."""
        up, down = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        out = up @ self.high.T.astype(float) + down @ self.low.T.astype(float)
        slack = np.abs(q).astype(float) @ np.maximum(np.abs(self.low), np.abs(self.high)).T.astype(float)
        return out + np.where(slack < 2**52, 0, slack * 1e-13)

    def search(self, q: np.ndarray, bounds: np.ndarray, k: int, own: int, kth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (scores, ids) for a query, ties to smaller ids, without the id own; kth: a score that k known points reach. Also how many points it met."""
        scores, ids, met = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            child = self.left[node]
            if child >= 0:
                for c in (child, child + 1):
                    if bounds[c] >= kth:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            low, high = self.begin[node], self.end[node]
            met += high - low
            s, i = self.points[low:high] @ q, self.ids[low:high]
            good = (s >= kth) & (i != own)
            if good.any():
                scores, ids = np.concatenate([scores, s[good]]), np.concatenate([ids, i[good]])
                top = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[top], ids[top]
                if len(top) == k:
                    kth = max(kth, int(scores[-1]))
        return scores, ids, met


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, shard_rows: int = 16_384, block_rows: int = 2_048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): of each query its k highest integer inner products with every other id, ties to the smaller id.

    Components become floor(scale * x). is_query is a condition on the column id. Vectors that are null or hold null or
    non-finite components take no part, nor do null ids and vectors of another length (see vectors.usable). Of rows with
    one id the one with the smallest vector counts. With fewer than k others, all are returned; an empty table gives no rows.
    Scores must fit 63 bits.
    """
    rows = usable(vectors, id_col, vector_col, zero=True).withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(scale) * x).cast("double")))
    rows, queries, shards, query_blocks, tables = plan(rows, is_query, shard_rows, block_rows)

    def run(q: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(shard):
            ids, points, _ = distinct(shard)
            tree = Tree(ids, points.astype(np.int64))
            own, asked, (kth,) = distinct(q, ("kth",))
            asked = asked.astype(np.int64)
            for low in range(0, len(own), 256):
                bounds = tree.bounds(asked[low : low + 256])
                for n, b in enumerate(bounds, low):
                    scores, found, _ = tree.search(asked[n], b, k, own[n], int(kth[n]))
                    out += zip([own[n]] * len(found), found.tolist(), scores.tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    schema = "query_id long, vec_id long, score long"
    fresh = queries.withColumn("kth", F.lit(NONE))
    if shards == 1:
        found = blocks(rows, fresh, 1, query_blocks, run, schema)
    else:
        first = rows.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == 0)
        seed = tables.keep(blocks(first, queries.withColumn("kth", F.lit(NONE)), 1, query_blocks, run, schema))
        reached = seed.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).select(F.col("query_id").alias("id"), "kth")
        bounded = queries.join(reached, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(NONE)))
        found = seed.unionByName(blocks(rows, bounded, shards, query_blocks, run, schema, first=1))
    return best(found, k, [F.desc("score"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "score")
