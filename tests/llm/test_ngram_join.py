import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from latticeframe.llm import common, ngram_join


def shingles(t, n):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t or "") if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(docs, threshold, n):
    s = {d: shingles(t, n) for d, t in docs}
    ids, parent, links = sorted(s), {d: d for d in s}, Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if s[a] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {(d, top(d), links[d]) for d in ids}


def corpus(seed, families=8, size=12):
    r = random.Random(seed)
    docs = []
    for _ in range(families):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice([3, 6, 40, 120]))]
        for _ in range(r.randint(1, size)):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                x[r.randrange(len(x))] = f"v{r.randrange(9)}"
            docs.append((len(docs), " ".join(x)))
    return docs


def classes(spark, docs, **options):
    return {tuple(r) for r in ngram_join.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **options).collect()}


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed)
        assert classes(spark, docs) == brute(docs, 0.8, 5)
    assert classes(spark, corpus(3), threshold=0.5, n=2) == brute(corpus(3), 0.5, 2)


def test_buckets_that_split_and_clusters_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    docs = corpus(4, families=3, size=25)
    assert classes(spark, docs) == brute(docs, 0.8, 5)


def test_pivots_end_a_family_and_not_a_mixture(spark):
    """A bucket of one family ends, as its sketches connect with the pivots; one of unlike sets splits on."""
    rng = np.random.default_rng(3)
    base, n = rng.integers(-(2**63), 2**63, 2), 60
    family = [(1, i, i, int(base[0] ^ (1 << (i % 60))), int(base[1])) for i in range(n)]
    others = [(2, 100 + i, 100 + i, *(int(x) for x in rng.integers(-(2**63), 2**63, 2))) for i in range(n)]
    df = spark.createDataFrame(family + others, ngram_join.ROWS)
    got = {r["rep"]: r["to"] for r in ngram_join.pivoted(df, ngram_join.sketch_bound(0.8)).collect()}
    assert {tuple(got[i]) for i in range(n)} == {(min(t for i in range(n) for t in got[i]),)}
    mixed = [tuple(got[100 + i]) for i in range(n)]
    assert sum(bool(t) for t in mixed) == ngram_join.PIVOTS and all(t == (100 + i,) for i, t in enumerate(mixed) if t)


def test_connected_rows():
    rng = np.random.default_rng(6)
    for n, flips in ((2, 1), (40, 3), (300, 9), (300, 30)):
        base = rng.integers(0, 2**63, 2, dtype=np.uint64)
        s = [[base[0] if i % 3 else rng.integers(0, 2**63, dtype=np.uint64), base[1]] for i in range(n)]
        for x in s:
            for f in rng.integers(0, 63, flips):
                x[f % 2] = x[f % 2] ^ (np.uint64(1) << np.uint64(f))
        s1, s2 = np.array([x[0] for x in s], np.uint64), np.array([x[1] for x in s], np.uint64)
        a, b = np.nonzero(np.bitwise_count(s1[:, None] ^ s1).astype(int) + np.bitwise_count(s2[:, None] ^ s2) <= 20)
        assert (ngram_join.connected(s1, s2, 20) == ngram_join.labels_of(n, a, b)).all()


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9_000, rng.integers(1, 3_000))).astype(np.uint64) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = ngram_join.overlaps(sets)
    np.fill_diagonal(got, 0)
    np.fill_diagonal(want, 0)
    assert (got == want).all()
    assert (ngram_join.overlaps(sets[:5], sets[5:]) == want[:5, 5:]).all()
    assert (ngram_join.overlaps([sets[0]], [sets[0] + np.uint64(10_000)]) == 0).all()


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "  \n"), (4, "one"), (5, "one"), (6, "one two three"), (None, "one"), (7, "same id a"), (7, "same id b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rep", F.lit("clash"))
    got = {tuple(r) for r in ngram_join.near_classes(df).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 0), (7, 7, 0)}
    kept = ngram_join.one_of_each(df, ngram_join.near_classes(df))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 7]
    assert ngram_join.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_copies_count_as_links(spark):
    docs = [(i, "the very same words in every one of these texts") for i in range(30)] + [(99, "another text that has nothing in common with them at all")]
    docs += [(200, " ".join(f"long{i}" for i in range(50_000))), (201, " ".join(f"long{i}" for i in range(45_000)))]
    assert classes(spark, docs) == {(i, 0, 29) for i in range(30)} | {(99, 99, 0), (200, 200, 1), (201, 200, 1)}


def test_runs_reach_the_recall():
    assert ngram_join.runs_for(0.8, 0.99) < ngram_join.runs_for(0.8, 0.99999)
    rng = np.random.default_rng(1)
    met, pairs = 0, 300
    for _ in range(pairs):
        a = rng.integers(0, 2**63, 180).astype(np.uint64)
        b = np.concatenate([a[:160], rng.integers(0, 2**63, 20).astype(np.uint64)])  # Jaccard 0.8
        x, y = (np.bitwise_count(np.packbits((common.mix(ngram_join.signature(v), 5) & np.uint64(1)).astype(bool))) for v in (a, b))
        p, q = (np.packbits((common.mix(ngram_join.signature(v), 5) & np.uint64(1)).astype(bool)) for v in (a, b))
        met += np.bitwise_count(p ^ q).sum() <= ngram_join.sketch_bound(0.8)
        assert len(x) == len(y)
    assert met == pairs


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(30)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long"), common.Tables(spark)).collect()}
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    assert got == {n: top(n) for n in {v for e in edges if e[0] != e[1] for v in e}}


def test_recall_holds_in_hot_buckets_that_split_often(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET", 4)
    rng = np.random.default_rng(7)
    pairs, width = 120, ngram_join.COORDINATES
    passage = rng.integers(0, 2**32, width, dtype=np.uint32)  # all sets agree with it in about 0.6 of the coordinates
    rows = []
    for i in range(pairs):
        a = np.where(rng.random(width) < 0.78, passage, rng.integers(0, 2**32, width, dtype=np.uint32))
        b = np.where(rng.random(width) < 0.8, a, rng.integers(0, 2**32, width, dtype=np.uint32))  # Jaccard 0.8
        s1, s2 = (int(x) for x in rng.integers(-(2**63), 2**63, 2))
        rows += [(2 * i, bytearray(a.tobytes()), s1, s2), (2 * i + 1, bytearray(b.tobytes()), s1, s2)]
    tables = common.Tables(spark)
    reps = tables.keep(spark.createDataFrame(rows, "rep long, coordinates binary, s1 long, s2 long"))
    deepest, walk = [], ngram_join.walk

    def watched(*args):
        edges, deep = walk(*args)
        deepest.append(deep.agg(F.max("level")).first()[0] if deep is not None else 0)
        return edges, deep

    monkeypatch.setattr(ngram_join, "walk", watched)
    edges = ngram_join.candidate_edges(reps, tables, 0.8, 0.99999, 4)
    assert deepest[0] > 4
    of = {r["node"]: r["component"] for r in common.components(edges, tables).collect()}
    assert [i for i in range(pairs) if of.get(2 * i, -1) != of.get(2 * i + 1, -2)] == []
    assert ngram_join.runs_for(0.8, 0.99999, 6) > 3 * ngram_join.runs_for(0.8, 0.99999, 2)
