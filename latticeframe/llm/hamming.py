"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Codes are the signs of centred vectors after learned rotations (iterative quantisation), fitted on a bounded sample
together with the search radius. A shard's codes are split into substrings of 8 bits, each with an index of its own.
By the pigeonhole principle a code within radius r of the query is, in one of the m substrings, within r // m (and in
those after the first r % m + 1, one less); probing these keys retrieves every code within the radius. The codes are
compared whole, and what lies within the radius is ranked by distance of the original vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.vectors import best, blocks, distinct, matrix, plan, usable

BITS = 8
CLOSE = [np.flatnonzero(np.bitwise_count(np.arange(1 << BITS, dtype=np.uint8)) <= s).astype(np.uint8) for s in range(BITS + 1)]


@dataclass(frozen=True)
class Codes:
    centre: np.ndarray
    rotation: np.ndarray  # (dimension, bits)
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """(n, bits / 8) bytes."""
        return np.packbits((vectors - self.centre) @ self.rotation > 0, axis=1)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def learn(sample: np.ndarray, tables: int = 2, rounds: int = 30, k: int = 10, asked: int = 300, quantile: float = 0.985, seed: int = 7) -> Codes:
    """Rotations by iterative quantisation of the sample's principal components, and the radius that holds the given share of the sample's own k nearest neighbours."""
    n, d = sample.shape
    rng = np.random.default_rng(seed)
    centre = sample.mean(0)
    x = sample - centre
    _, axes = np.linalg.eigh(x.T @ x)
    padded = -(-d // BITS) * BITS
    parts = []
    for _ in range(tables):
        r = np.linalg.qr(rng.normal(size=(padded, padded)))[0][:d]
        v = x @ axes
        for _ in range(rounds):
            u, _, w = np.linalg.svd(v.T @ np.where(v @ r > 0, 1.0, -1.0), full_matrices=False)
            r = u @ w
        parts.append(axes @ r)
    codes = Codes(centre, np.concatenate(parts, 1), 0)
    of = codes.of(sample)
    near = []
    for i in range(min(n, asked)):
        dist = ((sample - sample[i]) ** 2).sum(1)
        dist[i] = np.inf
        near.append(distances(of[np.argsort(dist, kind="stable")[: min(k, n - 1)]], of[i]))
    radius = int(np.quantile(np.concatenate(near), quantile, method="higher")) if n > 1 else padded * tables
    return Codes(codes.centre, codes.rotation, radius)


class Index:
    """Codes of a shard, with their rows in order of each substring's key."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange((1 << BITS) + 1)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius."""
        m = self.codes.shape[1]
        each, more = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j in range(m):
            s = min(each if j <= more else each - 1, BITS)
            if s < 0:
                continue
            keys = code[j] ^ CLOSE[s]
            low, high = self.starts[j][keys], self.starts[j][keys.astype(np.int64) + 1]
            sizes = high - low
            total = int(sizes.sum())
            at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(total)
            seen[self.order[j][at]] = True
        rows = np.flatnonzero(seen)
        return rows[distances(self.codes[rows], code) <= radius]


def fit(rows: DataFrame, sample_rows: int = 4_096) -> Codes | None:
    """Codes from at most sample_rows vectors, those with the smallest id hashes; None without rows."""
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(sample_rows).toPandas()
    return learn(matrix(sample["vector"])) if len(sample) else None


def neighbours(vectors: DataFrame, is_query: Column, k: int = 10, codes: Codes | None = None, shard_rows: int = 16_384, block_rows: int = 2_048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): of each query the k nearest ids found, other than its own, by Euclidean distance, ties to the smaller id.

    Every vector is indexed. Found is what lies within the codes' radius; in a shard with fewer than k such codes the
    radius grows until k are found or all. is_query is a condition on the column id. Vectors that are null, zero or
    hold null or non-finite components take no part, nor do null ids and vectors of another length. Of rows with one id
    the one with the smallest vector counts. An empty table gives no rows.
    """
    rows, queries, shards, query_blocks, _ = plan(usable(vectors, id_col, vector_col, zero=False), is_query, shard_rows, block_rows)
    codes = codes or fit(rows)
    schema = "query_id long, vec_id long, score double"
    if codes is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def run(q: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(q) and len(shard):
            ids, points, _ = distinct(shard)
            own, asked, _ = distinct(q)
            index, wanted = Index(codes.of(points)), codes.of(asked)
            bits = codes.rotation.shape[1]
            for n in range(len(own)):
                radius = codes.radius
                while True:
                    found = index.within(wanted[n], radius)
                    found = found[ids[found] != own[n]]
                    if len(found) >= k or radius >= bits:
                        break
                    radius = min(bits, radius + max(1, bits // 16))
                score = np.sqrt(((points[found] - asked[n]) ** 2).sum(1))
                top = np.lexsort((ids[found], score))[:k]
                out += zip([own[n]] * len(top), ids[found[top]].tolist(), score[top].tolist(), strict=True)
        frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        return frame.astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = blocks(rows, queries, shards, query_blocks, run, schema)
    return best(found, k, [F.asc("score"), F.asc("vec_id")]).select("query_id", "rank", "vec_id", "score")
