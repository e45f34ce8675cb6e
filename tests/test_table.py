import math

import pytest
from pyspark.sql import functions as F

from latticeframe.functions import aggregators as agg
from latticeframe.operators import methods
from latticeframe.operators.intervals import interval
from latticeframe.operators.table import Table, scan
from latticeframe.plans.inspect import exchanges, plan_text


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def test_missing_group_key(spark):
    t = Table.range(spark, 100).annotate(k=F.when(F.col("idx") % 10 == 0, F.col("idx") % 4))
    assert rows(t.group_by("k").aggregate(n=agg.count()).df) == [(0, 5), (2, 5), (None, 90)]


@pytest.mark.parametrize(("how", "expected"), [("inner", {(2, "b", "x")}), ("left", {(1, "a", None), (2, "b", "x"), (None, "c", None)}), ("right", {(2, "b", "x"), (3, None, "y"), (None, None, "z")}), ("outer", {(1, "a", None), (2, "b", "x"), (3, None, "y"), (None, "c", None), (None, None, "z")})])
def test_joins_and_missing_keys(spark, how, expected):
    left = Table.parallelize(spark, [(1, "a"), (2, "b"), (None, "c")], "k int, v string", "k")
    right = Table.parallelize(spark, [(2, "x"), (3, "y"), (None, "z")], "j int, w string", "j")
    assert {tuple(r) for r in left.join(right, how).df.collect()} == expected


def test_join_renames_clashes_and_checks_types(spark):
    a = Table.parallelize(spark, [(1, "a")], "k int, v string", "k")
    assert a.join(a).df.columns == ["k", "v", "v_1"]
    with pytest.raises(ValueError, match="types"):
        a.join(Table.parallelize(spark, [(1, "a")], "k bigint, v string", "k"))


def test_semi_and_anti_keep_missing(spark):
    a = Table.parallelize(spark, [(1,), (2,), (None,)], "k int", "k")
    b = Table.parallelize(spark, [(2,), (2,)], "k int", "k")
    assert rows(a.semi_join(b).df) == [(2,)]
    assert rows(a.anti_join(b).df) == [(1,), (None,)]


def test_index_and_all_matches(spark):
    a = Table.parallelize(spark, [(1,), (5,)], "k int", "k")
    b = Table.parallelize(spark, [(1, "x"), (1, "w")], "k int, v string", "k")
    assert rows(a.annotate(v=b.index("k")["v"]).df) == [(1, "w"), (5, None)]
    got = {r["k"]: r["v"] for r in a.annotate(v=b.index("k", all_matches=True)).df.collect()}
    assert [x["v"] for x in got[1]] == ["w", "x"]
    assert got[5] is None


@pytest.mark.parametrize("kind", ["int", "double", "string"])
def test_interval_lookup(spark, kind):
    i = spark.createDataFrame([(1, 4, "a"), (3, 9, "b"), (4, 4, "none")], "s int, e int, v string").select(interval(F.col("s").cast(kind), F.col("e").cast(kind)).alias("i"), "v")
    t = Table(spark.createDataFrame([(0,), (1,), (3,), (4,), (9,), (None,)], "x int").select(F.col("x").cast(kind)), "x")
    one = {r["x"]: r["v"] for r in t.annotate(v=Table(i, "i").index("x")["v"]).df.collect()}
    assert [one[F_] for F_ in one if F_ is not None and float(F_) in (0, 9)] == [None, None]
    many = {None if r["x"] is None else float(r["x"]): [x["v"] for x in r["v"]] for r in t.annotate(v=Table(i, "i").index("x", all_matches=True)).df.collect()}
    assert many == {0.0: [], 1.0: ["a"], 3.0: ["a", "b"], 4.0: ["b"], 9.0: [], None: []}


def test_scans_agree_over_partitions(spark):
    t = Table(spark.range(200, numPartitions=7).select((F.col("id") * 37 % 200).alias("k"), F.col("id").alias("v")), "k")
    got = t.annotate(s=scan.sum("v"), n=scan.count(), lo=scan.min("v"), m=scan.mean("v")).sorted().collect()
    total, seen = 0, []
    for i, r in enumerate(got):
        assert (r["k"], r["s"], r["n"]) == (i, total, i)
        assert r["lo"] == (min(seen) if seen else None)
        assert math.isnan(r["m"]) if not seen else abs(r["m"] - total / len(seen)) < 1e-9
        total += r["v"]
        seen.append(r["v"])


def test_add_index_head_tail(spark):
    t = Table.range(spark, 50)
    assert [r["i"] for r in t.add_index("i").sorted().collect()] == list(range(50))
    assert [r[0] for r in t.head(3).collect()] == [0, 1, 2]
    assert [r[0] for r in t.tail(2).collect()] == [48, 49]


def test_aggregators_of_nothing(spark):
    t = Table(spark.createDataFrame([], "x double"))
    r = t.aggregate_df(s=agg.sum("x"), m=agg.mean("x"), p=agg.product("x"), f=agg.fraction(F.col("x") > 0), any=agg.any(F.col("x") > 0), all=agg.all(F.col("x") > 0), c=agg.corr("x", "x")).first()
    assert (r["s"], r["p"], r["f"], r["any"], r["all"]) == (0, 1, None, False, True)
    assert math.isnan(r["m"])
    assert math.isnan(r["c"])


def test_nan_and_missing_in_aggregators(spark):
    t = Table(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double"))
    r = t.aggregate_df(lo=agg.min("x"), hi=agg.max("x"), all=agg.collect("x"), h=agg.hist("x", 0, 4, 2)).first()
    assert (r["lo"], r["hi"], len(r["all"])) == (1.0, 3.0, 4)
    assert r["h"]["bin_freq"] == [1, 1]


def test_nested_aggregators(spark):
    t = Table(spark.createDataFrame([("a", 1, [1, 2]), ("a", 1, [3, 4]), ("b", None, [5, 6])], "k string, v int, x array<int>"))
    got = {r["k"]: r for r in t.group_by("k").aggregate(c=agg.counter("v"), e=agg.explode(agg.sum, "x"), a=agg.array_agg(agg.sum, "x"), n=agg.count()).df.collect()}
    assert [tuple(x) for x in got["a"]["c"]] == [(1, 2)]
    assert [tuple(x) for x in got["b"]["c"]] == [(None, 1)]
    assert (got["a"]["e"], got["a"]["a"], got["a"]["n"]) == (10, [4, 6], 2)


def test_explode_drops_empty(spark):
    t = Table.parallelize(spark, [(1, [1, 2]), (2, []), (3, None)], "k int, x array<int>", "k")
    assert rows(t.explode("x").df) == [(1, 1), (1, 2)]
    nested = Table(t.df.select("k", F.struct("x", F.lit("z").alias("y")).alias("s")), "k").explode("s.x")
    assert [r["s"]["x"] for r in nested.sorted().collect()] == [1, 2]


def test_key_fields_are_protected(spark):
    t = Table.range(spark, 3)
    for f in (lambda: t.annotate(idx=F.lit(1)), lambda: t.drop("idx"), lambda: t.explode("idx")):
        with pytest.raises(ValueError, match="key"):
            f()


def test_union_distinct_collect_by_key(spark):
    a = Table.parallelize(spark, [(1, "b"), (1, "a"), (2, "c")], "k int, v string", "k")
    assert rows(a.distinct().df) == [(1, "a"), (2, "c")]
    assert a.union(a).count() == 6
    got = {r["k"]: [x["v"] for x in r["values"]] for r in a.collect_by_key().df.collect()}
    assert got == {1: ["a", "b"], 2: ["c"]}
    wide = a.union(Table.parallelize(spark, [(3, 1.5)], "k int, w double", "k"), unify=True)
    assert wide.df.columns == ["k", "v", "w"]


def test_multi_way_zip_join(spark):
    a, b = (Table.parallelize(spark, r, "k int, v string", "k") for r in ([(1, "a"), (2, "b")], [(2, "x")]))
    got = {r["k"]: [x and x["v"] for x in r["d"]] for r in Table.multi_way_zip_join([a, b], "d", "g").df.collect()}
    assert got == {1: ["a", None], 2: ["b", "x"]}


def test_flatten_filter_globals(spark):
    t = Table(spark.range(4).select(F.struct("id", F.struct(F.lit(1).alias("b")).alias("c")).alias("a"))).annotate_globals(g=2)
    assert t.flatten().df.columns == ["a.id", "a.c.b"]
    assert t.filter(F.col("a.id") >= t.g("g")).count() == 2
    assert t.filter(F.lit(None).cast("boolean")).count() == t.filter(F.lit(None).cast("boolean"), keep=False).count() == 0


def test_write_read_and_key_pruning(spark, tmp_path):
    from latticeframe.sources.native import read_table

    t = Table.range(spark, 1000).annotate(v=F.col("idx") * 2).annotate_globals(g=[1, 2])
    t.write(str(tmp_path / "t"))
    back = read_table(spark, str(tmp_path / "t"), [(10, 20)])
    assert (back.key, back.globals, back.count()) == (("idx",), {"g": [1, 2]}, 10)
    assert "PushedFilters" in plan_text(back.df)


def test_text_tables(spark, tmp_path):
    from latticeframe.sources.text import import_bed, import_fam, import_gtf, import_lines, import_locus_intervals, import_matrix_table, import_table

    p = tmp_path / "a.tsv"
    p.write_text("id\tn\tx\tb\n1\t3000000000\t1.5\ttrue\n2\tNA\t-2e3\tfalse\n")
    t = import_table(spark, str(p), key="id", impute=True)
    assert dict(t.df.dtypes) == {"id": "int", "n": "bigint", "x": "double", "b": "boolean"}
    assert rows(t.df)[1][1] is None
    clean = import_table(spark, str(p), filter="^2", find_replace=("true", "TRUE"))
    assert rows(clean.df, "b") == [("TRUE",)]
    assert import_lines(spark, str(p)).count() == 3
    (tmp_path / "m.txt").write_text("id\ts1\ts2\nr1\t1\t2\nr2\tNA\t4\n")
    m = import_matrix_table(spark, str(tmp_path / "m.txt"), {"id": "str"}, ["id"])
    assert m.count() == (2, 2)
    assert rows(m.entries_df, "id", "col_id", "x")[2] == ("r2", "s1", None)
    (tmp_path / "b.bed").write_text("chr1\t0\t10\tx\n")
    assert tuple(import_bed(spark, str(tmp_path / "b.bed")).df.first()["interval"]) == (1, 11, True, False)
    (tmp_path / "i.txt").write_text("1:5-9\n")
    assert tuple(import_locus_intervals(spark, str(tmp_path / "i.txt")).df.first()["interval"]) == (5, 9, True, True)
    (tmp_path / "f.fam").write_text("0 kid dad mum 2 1\n")
    assert tuple(import_fam(spark, str(tmp_path / "f.fam")).df.first()) == ("kid", None, "dad", "mum", True, False)
    (tmp_path / "g.gtf").write_text('1\tsrc\tgene\t5\t9\t.\t+\t.\tgene_id "g1"; gene_name "n";\n')
    assert import_gtf(spark, str(tmp_path / "g.gtf")).df.first()["attributes"] == {"gene_id": "g1", "gene_name": "n"}
    t.export(str(tmp_path / "out"))
    assert import_table(spark, str(tmp_path / "out"), impute=True).count() == 2


def test_reshape(spark):
    t = Table.parallelize(spark, [(1, 2, 3)], "k int, a int, b int", "k")
    long = methods.gather(t, "name", "value", ["a", "b"])
    assert rows(long.df) == [(1, "a", 2), (1, "b", 3)]
    assert rows(methods.spread(long, "name", "value", ["a", "b"]).df) == [(1, 2, 3)]
    assert methods.separate(Table(spark.createDataFrame([("x_y",)], "f string")), "f", ["p", "q"], "_").df.first() == ("x", "y")


def test_grouping_shuffles_once(spark):
    t = Table(spark.range(10).select((F.col("id") % 3).alias("k"), "id"))
    assert exchanges(t.group_by("k").aggregate(n=agg.count(), s=agg.sum("id")).df) == 1


def test_segment_intervals(spark):
    t = Table(spark.range(1).select(interval(F.lit(0), F.lit(10)).alias("i")), "i")
    assert [(r["i"]["start"], r["i"]["end"]) for r in methods.segment_intervals(t, [3, 7, 20]).sorted().collect()] == [(0, 3), (3, 7), (7, 10)]


def test_maximal_independent_set(spark):
    e = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (5, 6), (7, 7)]
    got = {r[0] for r in methods.maximal_independent_set(spark.createDataFrame(e, "i int, j int")).collect()}
    assert not any(a in got and b in got for a, b in e if a != b)
    assert all(n in got or any(x in got for p in e if n in p for x in p if x != n) for n in range(8))


def test_independent_set_of_a_long_chain(spark):
    n = 2000
    e = spark.range(n - 1).selectExpr("id as i", "id + 1 as j")
    got = {r[0] for r in methods.maximal_independent_set(e, max_rounds=30).collect()}
    assert not any(k + 1 in got for k in got)
    assert all({k - 1, k, k + 1} & got for k in range(n))
    with pytest.raises(RuntimeError):
        methods.maximal_independent_set(e, max_rounds=1)
