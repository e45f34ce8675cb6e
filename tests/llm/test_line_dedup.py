import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from latticeframe.llm import line_dedup


def brute(docs, threshold):
    """Places of lines with an earlier line at the threshold, by comparing all."""
    lines = sorted((d if d is not None else line_dedup.NULL_ID, i, frozenset(w for w in re.split(r"[ \t\n\x0b\f\r]+", x) if w)) for d, t in docs for i, x in enumerate((t or "").split("\n")))
    out, seen = set(), []
    for d, i, s in lines:
        if s and any(len(s & u) >= threshold * len(s | u) - 1e-9 for u in seen):
            out.add((None if d == line_dedup.NULL_ID else d, i))
        if s:
            seen.append(s)
    return out


def corpus(seed, n=60, words=40, size=(1, 14)):
    r = random.Random(seed)
    base = [[f"w{int(r.paretovariate(0.8)) % words}" for _ in range(r.randint(*size))] for _ in range(n)]
    docs = []
    for d in range(n // 2):
        lines = []
        for _ in range(r.randint(1, 4)):
            x = list(r.choice(base))
            if r.random() < 0.5:
                x[r.randrange(len(x))] = f"w{r.randrange(words)}"
            lines.append(" ".join(x))
        docs.append((d, "\n".join(lines)))
    return docs


@pytest.mark.parametrize(("seed", "threshold", "size"), [(1, 0.8, (1, 14)), (2, 0.6, (1, 14)), (3, 1.0, (1, 6)), (4, 0.8, (100, 260))])
def test_against_brute_force(spark, seed, threshold, size):
    docs = corpus(seed, words=400 if size[0] > 50 else 40, size=size)
    got = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), threshold)
    assert {(r["doc_id"], r["line"]) for r in got.collect()} == brute(docs, threshold)


def test_lines_whose_candidates_fail_or_groups_are_large(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "passes", lambda n, at, m, bt, differ, threshold: np.ones(len(n), bool))
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", 2)
    docs = corpus(5)
    got = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), 0.8)
    assert {(r["doc_id"], r["line"]) for r in got.collect()} == brute(docs, 0.8)


@pytest.mark.parametrize("hot", [0, 8 * 3, 255])
def test_packed_prefixes(spark, monkeypatch, hot):
    """All, some or no rows as they are; what goes in comes out by token and position, and the result is that of brute force."""
    r = np.random.default_rng(hot)
    n, tok = 1000, r.integers(0, 1 << 40, 50)
    rows = {"tok": tok[r.integers(0, 50, n)], "doc": r.integers(-(2**62), 2**62, n), "line": np.arange(n), "n": r.integers(1, 99, n), "at": r.integers(0, 9, n), "bits": r.integers(-(2**62), 2**62, n), "more": r.integers(-(2**62), 2**62, n)}
    rows = {k: v.astype(line_dedup.KINDS[k]) for k, v in rows.items()}
    table = np.zeros(1 << line_dedup.COUNT_BITS, bool)
    table[tok[: {0: 50, 24: 20, 255: 0}[hot]] >> 16] = True
    whole = pa.RecordBatch.from_arrays([pa.array(v) for v in rows.values()], line_dedup.PREFIX_NAMES)
    packed = pa.Table.from_batches(line_dedup.pack_prefixes([whole.slice(0, 300), whole.slice(300)], table, 7))
    packed = packed.sort_by([(c, "ascending") for c in ("bucket", "tok", "doc", "line")])
    out = pa.Table.from_batches(line_dedup.unpack_prefixes(packed.to_batches(max_chunksize=3)))
    order = lambda t: t.sort_by([(c, "ascending") for c in ("tok", "doc", "line")])
    assert order(out).equals(order(pa.Table.from_batches([whole])))
    if not 0 < table.sum() < 50:
        at = out["tok"].to_numpy()
        assert 1 + (at[1:] != at[:-1]).sum() == len(np.unique(at))  # a token's rows lie together
    if table.sum() == 0:
        assert packed["packed"].null_count == 0 and packed.num_rows == 7 and sum(len(x.as_py()) for x in packed["packed"]) < 40 * n
    monkeypatch.setattr(line_dedup, "HOT", hot)
    docs = corpus(7)
    got = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 0.8)
    assert {(r["doc_id"], r["line"]) for r in got.collect()} == brute(docs, 0.8)


def test_edge_cases(spark):
    docs = [(None, "a b c d e"), (1, None), (2, ""), (3, "a b c d e\n\n  \nx y"), (3, "a b c d e\n\n  \nx y"), (4, "x y\nx  y\nz"), (5, "a b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lines_removed", F.lit("clash")).withColumn("doc", F.lit(1))
    got = {(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(df).collect()}
    assert got == {(3, 0), (4, 0), (4, 1), (5, 0)}
    out = sorted(((r["doc_id"] or 0, r["text"], r["lines_removed"]) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert out == sorted([(0, "a b c d e", 0), (1, None, 0), (2, "", 0), (3, "\n  \nx y", 1), (3, "\n  \nx y", 1), (4, "z", 2)], key=str)
    assert line_dedup.repeated_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_groups_over_several_batches(spark, monkeypatch):
    """Few rows of a token are held, batches are small, and no filter helps: the exact join finds the rest."""
    monkeypatch.setattr(line_dedup, "passes", lambda n, at, m, bt, differ, threshold: np.ones(len(n), bool))
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        docs = corpus(8)
        got = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), 0.8)
        assert {(r["doc_id"], r["line"]) for r in got.collect()} == brute(docs, 0.8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_lines_and_lines_that_are_everywhere(spark, monkeypatch):
    from latticeframe.llm import common

    monkeypatch.setattr(common.slices, "__defaults__", (40_000,))
    long = [f"t{i}" for i in range(30_000)]
    docs = [(i, "the line that every text has\nown words of text number n%d\nevery that line the has text" % i) for i in range(50)]
    docs += [(100, " ".join(long)), (101, " ".join(long[:25_000])), (102, " ".join(long[:23_000])), (50, "the line that every text has")]
    got = [(r["doc_id"], r["line"]) for r in line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got) == sorted(brute(docs, 0.8))


def test_meets_across_batches(spark):
    docs = [(i, f"common words that every line has plus w{i}") for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), 0.7)
        assert {(r["doc_id"], r["line"]) for r in got.collect()} == {(i, 0) for i in range(1, 60)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


class Local:
    """Hands back the function that would run on the executors."""

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("batch", [3, 4, 5, 7, 40])
def test_rows_past_the_held_ones_of_a_long_group_are_flagged(monkeypatch, batch):
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", 4)
    # two tokens of 40 and 9 rows; bits all differ, so that no row passes and only unmet rows are flagged
    n = 49
    columns = {"tok": [1] * 40 + [2] * 9, "doc": range(n), "line": [0] * n, "n": [5] * n, "at": [0] * n, "bits": [3 << 2 * (i % 31) for i in range(n)], "more": [3 << 2 * (i // 31) for i in range(n)]}
    types = dict(part.split() for part in line_dedup.PREFIX.split(", "))
    rows = pa.table({c: pa.array(list(v), {"long": pa.int64(), "int": pa.int32()}[types[c]]) for c, v in columns.items()})
    run = line_dedup.candidates(Local(), 0.8)
    got = pa.Table.from_batches(run(iter(rows.to_batches(max_chunksize=batch)))).to_pylist()
    assert all(r["to_doc"] is None for r in got)
    assert [r["doc"] for r in got if r["more_to"]] == [*range(5, 40), *range(45, n)]


def test_packing_holds_few_rows_at_a_time():
    """Workers stay small: a fifth of a million prefix rows is packed and handed on before more are taken in."""
    taken = []

    def batches():
        for k in range(8):
            taken.append(k)
            rows = {c: np.arange(50_000).astype(line_dedup.KINDS[c]) for c in line_dedup.PREFIX_NAMES}
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in rows.values()], line_dedup.PREFIX_NAMES)

    next(line_dedup.pack_prefixes(batches(), np.zeros(1 << line_dedup.COUNT_BITS, bool), 7))
    assert len(taken) <= 4


def shared_tokens(lines):
    """Prefix rows of five tokens in a row for each of so many equal lines, which differ in no bit."""
    n = 5 * lines
    rows = {"tok": np.repeat(np.arange(5), lines), "doc": np.tile(np.arange(lines), 5), "line": np.zeros(n), "n": np.full(n, 50), "at": np.repeat(np.arange(5), lines), "bits": np.zeros(n), "more": np.zeros(n), "prev": np.repeat(np.arange(5), lines) - 1}
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32 if k in ("line", "n", "at") else np.int64)) for k, v in rows.items()], list(rows))


def test_a_pair_is_found_at_the_first_token_of_a_run():
    got = pa.Table.from_batches(line_dedup.candidates(Local(), 0.8)(iter([shared_tokens(2)])))
    assert got.select(["doc", "to_doc"]).to_pylist() == [{"doc": 1, "to_doc": 0}]


def test_lines_left_meet_all_earlier_rows_of_their_tokens():
    """Only rows of pairs come out, not the prefix rows of all lines with such a token."""
    left = type("Table", (), {"value": np.full(1024, ~np.uint64(0))})
    packed = list(line_dedup.pack_prefixes([shared_tokens(9)], np.zeros(1 << line_dedup.COUNT_BITS, bool), 1))
    got = pa.Table.from_batches(line_dedup.earlier_rows(Local(), left, 0.8)(iter(packed)))
    assert sorted((r["doc"], r["to_doc"]) for r in got.to_pylist()) == [(x, y) for x in range(9) for y in range(x)]


def test_bit_tables_of_few_rows_let_almost_nothing_else_through(spark):
    """Sets and prefix rows of lines that no pair has are read, shuffled and joined in vain."""
    from latticeframe.llm.common import bit_table, held

    table = bit_table(spark.range(1000).select(F.col("id").alias("x")), lambda x: line_dedup.mix(x.view(np.uint64)))
    assert held(table, line_dedup.mix(np.arange(1000, dtype=np.uint64))).all()
    assert held(table, line_dedup.mix(np.arange(1000, 201_000, dtype=np.uint64))).mean() < 0.001


def test_lines_that_are_gone_are_not_divided_into_tokens():
    lines = line_dedup.Lines(pa.array(["a b\nc d e\na b", None, "c d e\nf"]), lambda lines: np.arange(lines.n_lines) != 1)
    assert lines.n_lines == 4 and sorted(set(lines.owner.tolist())) == [0, 3] and len(lines.hashes) <= 4


@pytest.mark.parametrize("group_rows", [2, 3, 4096])
def test_all_pairs_meet_where_no_filter_holds(spark, monkeypatch, group_rows):
    monkeypatch.setattr(line_dedup, "passes", lambda n, at, m, bt, differ, threshold: np.ones(len(n), bool))
    monkeypatch.setattr(line_dedup, "most_bits", lambda n, threshold: np.full(len(n), 255, np.uint8))
    monkeypatch.setattr(line_dedup, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(line_dedup, "NEAR_ROWS", 10)
    docs = corpus(5)
    got = line_dedup.repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), 0.8)
    assert {(r["doc_id"], r["line"]) for r in got.collect()} == brute(docs, 0.8)


def test_most_bits_bounds_what_passes():
    for threshold in (0.5, 0.6, 0.8, 0.95):
        n, m, d = (x.ravel() for x in np.meshgrid(np.arange(1, 90), np.arange(1, 180), np.arange(0, 40), indexing="ij"))
        ok = line_dedup.passes(n, np.zeros_like(n), m, np.zeros_like(n), d, threshold)
        assert (d[ok] <= line_dedup.most_bits(n[ok], threshold)).all()


def test_near_finds_all_pairs_of_a_token():
    r = np.random.default_rng(3)
    tok = np.sort(r.integers(0, 40, 300))
    start = np.searchsorted(tok, tok)
    size = np.bincount(tok)[tok]
    columns = {"n": r.integers(5, 60, 300), "bits": r.integers(0, 1 << 12, 300).astype(np.uint64), "more": np.zeros(300, np.uint64)}
    most = line_dedup.most_bits(columns["n"], 0.8)
    want = {(x, y) for x in range(300) for y in range(start[x], x) if int(columns["bits"][x] ^ columns["bits"][y]).bit_count() <= most[x]}
    parts = list(line_dedup.near(columns, start, np.where(size > 1, size, 0), 0.8))
    assert sorted((int(x), int(y)) for a, b in parts for x, y in zip(a, b, strict=True)) == sorted(want)
