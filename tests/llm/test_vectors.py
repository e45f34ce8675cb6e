import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeframe.llm import hamming, kdtree


def query():
    return F.col("id") % 10 == 0


def table(spark, n, d=8, seed=0, ties=False):
    r = np.random.default_rng(seed)
    v = r.integers(-2, 3, (n, d)) / 4 if ties else r.normal(size=(n, d))
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def best_products(rows, k):
    v = {i: [math.floor(1024 * x) for x in e] for i, e in rows}
    return {(q, n + 1, i, s) for q in v if q % 10 == 0 for n, (s, i) in enumerate(sorted(((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q))[:k]) for s in [-s]}


@pytest.mark.parametrize(("shards", "ties"), [(1000, False), (60, False), (60, True)])
def test_exact_top_k(spark, shards, ties):
    rows, df = table(spark, 300, ties=ties)
    got = kdtree.top_k(df, query(), shard_rows=shards, block_rows=9)
    assert {tuple(r) for r in got.collect()} == best_products(rows, 10)


def test_search_skips_boxes():
    r = np.random.default_rng(1)
    points = np.concatenate([r.normal(loc=c * 3000, scale=50, size=(500, 4)) for c in range(4)]).astype(np.int64)
    tree = kdtree.Tree(np.arange(2000), points)
    q = np.array([1, 1, 1, 1])
    scores, ids, met = tree.search(q, tree.bounds(q[None])[0], 5, -1, kdtree.NONE)
    want = np.lexsort((np.arange(2000), -(points @ q)))[:5]
    assert ids.tolist() == want.tolist()
    assert met < 1000


EDGES = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (10, [0.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0])]


def test_edge_cases(spark):
    df = spark.createDataFrame(EDGES, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("score", F.lit(1))
    got = {tuple(r) for r in kdtree.top_k(df, query()).collect()}
    one, half = 1024 * 1024, 1024 * 512
    assert got == {(0, 1, 8, one), (0, 2, 1, half), (0, 3, 10, 0), (10, 1, 0, 0), (10, 2, 1, 0), (10, 3, 8, 0)}
    near = [tuple(r) for r in hamming.neighbours(df, query()).collect()]
    assert sorted(near) == [(0, 1, 8, 0.0), (0, 2, 1, math.sqrt(0.5))]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert kdtree.top_k(empty, query()).count() == hamming.neighbours(empty, query()).count() == 0


def test_pigeonhole_retrieves_every_code_in_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (3000, 4), dtype=np.uint8)
    index = hamming.Index(codes)
    for radius in (0, 3, 7, 10, 15, 32):
        for q in codes[:20]:
            assert index.within(q, radius).tolist() == np.flatnonzero(hamming.distances(codes, q) <= radius).tolist()


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_embeddings(spark, folder):
    df = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    ids = np.array(sorted(rows))
    v = np.array([rows[i] for i in ids])
    got: dict[int, list] = {}
    for r in hamming.neighbours(df, F.col("id") % 100 == 0, shard_rows=700).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        dist = np.sqrt(((v - rows[q]) ** 2).sum(1))
        dist[ids == q] = np.inf
        true = set(ids[np.lexsort((ids, dist))[:10]])
        found = sorted(got[q])
        assert [x[0] for x in found] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((rows[i] - rows[q]) ** 2).sum())) < 1e-12 for _, i, s in found)
        hits += len(true & {x[1] for x in found})
        total += 10
    assert hits / total >= 0.9


def test_floor_of_negative_components(spark):
    df = spark.createDataFrame([(0, [-0.0001]), (1, [-0.0001])], "vec_id long, embedding array<double>")
    assert kdtree.top_k(df, query()).first()["score"] == 1
    assert random.Random(1).random() < 1
