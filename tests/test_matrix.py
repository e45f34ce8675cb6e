import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeframe.functions import aggregators as agg
from latticeframe.functions import genetics as g
from latticeframe.operators import methods, regression
from latticeframe.operators.blockmatrix import BlockMatrix
from latticeframe.operators.matrix import MatrixTable


@pytest.fixture(scope="module")
def m(spark):
    return MatrixTable.range(spark, 4, 3).annotate_entries(x=F.col("row_idx") * 10 + F.col("col_idx"))


def cells(m, field="x"):
    return {(r[0], r[1]): r[2] for r in m.entries_df.select(*m.row_key, *m.col_key, field).collect()}


def test_axes_and_filters(m):
    assert m.count() == (4, 3)
    assert cells(m.filter_rows(F.col("row_idx") > 2)) == {(3, 0): 30, (3, 1): 31, (3, 2): 32}
    assert len(cells(m.filter_cols(F.col("col_idx") == 0))) == 4
    few = m.filter_entries(F.col("x") % 2 == 0)
    assert len(cells(few)) == 8
    assert sum(v is None for v in cells(few.unfilter_entries()).values()) == 4
    assert {r["entry_stats_row"]["n_filtered"] for r in few.compute_entry_filter_stats().rows_df.collect()} == {1}
    assert m.head(2, 1).count() == (2, 1)
    assert m.choose_cols([0, 2]).count_cols() == 2


def test_annotation_and_grouping(m):
    r = m.annotate_rows({"s": agg.sum("x")}).rows().sorted().collect()
    assert [x["s"] for x in r] == [3, 33, 63, 93]
    grouped = m.group_rows_by(odd=F.col("row_idx") % 2).aggregate(s=agg.sum("x"))
    assert cells(grouped, "s")[(1, 2)] == 12 + 32
    cols = m.group_cols_by(big=F.col("col_idx") > 0).aggregate_cols(n=agg.count()).aggregate_entries(s=agg.sum("x")).result()
    assert {r["big"]: r["n"] for r in cols.cols_df.collect()} == {False: 1, True: 2}
    assert cells(cols, "s")[(1, True)] == 23


def test_collected_fields_stay_together(spark):
    rows, cols = spark.createDataFrame([(0,)], "r int"), spark.createDataFrame([("a", 2), ("a", None), ("b", 1)], "c string, w int")
    entries = spark.createDataFrame([(0, "a", 1, 9), (0, "a", 2, None), (0, "a", 3, 7), (0, "b", None, 4)], "r int, c string, x int, y int")
    got = MatrixTable(rows, cols, entries, ["r"], ["c"]).collect_cols_by_key()
    assert {r["c"]: (r["x"], r["y"]) for r in got.entries_df.collect()} == {"a": ([1, 2, 3], [9, None, 7]), "b": ([None], [4])}
    assert {r["c"]: sorted(r["w"], key=str) for r in got.cols_df.collect()} == {"a": [2, None], "b": [1]}


def test_lookups_on_axes_and_entries(spark, m):
    from latticeframe.operators.table import Table

    t = Table(spark.createDataFrame([(0, "zero"), (2, "two")], "k int, v string"), "k")
    assert {r["row_idx"]: r["v"] for r in m.annotate_rows(v=t.index("row_idx")["v"]).rows_df.collect()} == {0: "zero", 1: None, 2: "two", 3: None}
    assert {r["col_idx"]: r["v"] for r in m.annotate_cols(v=t.index("col_idx")["v"]).cols_df.collect()} == {0: "zero", 1: None, 2: "two"}
    assert cells(m.annotate_entries(v=t.index("col_idx")["v"], y=F.col("x") + 1), "v")[(3, 2)] == "two"


def test_fields_are_found_by_their_whole_names(m):
    named = m.annotate_rows(q=F.lit(1)).annotate_entries(qual=F.col("x"))
    assert "q" not in named.with_axes({"y": F.col("qual") + 1}).columns
    assert "q" in named.with_axes({"y": F.col("q") + 1}).columns


def test_keys_union_and_shapes(m):
    again = m.key_rows_by(k=F.col("row_idx") + 100)
    assert cells(again)[(103, 2)] == 32
    assert len(cells(m.filter_rows(F.col("row_idx") < 1).union_rows(m.filter_rows(F.col("row_idx") > 2)))) == 6
    t = m.filter_entries(F.col("x") != 11).localize_entries()
    assert [[e and e["x"] for e in r["entries"]] for r in t.sorted().collect()][1] == [10, None, 12]
    wide = m.make_table().df
    assert set(wide.columns) == {"row_idx", "0.x", "1.x", "2.x"}
    twice = m.annotate_rows(tags=F.array(F.lit("a"), F.lit("b"))).explode_rows("tags")
    assert twice.count_rows() == 8
    assert twice.entries_df.count() == 24


def test_write_read(m, spark, tmp_path):
    from latticeframe.sources.native import read_matrix

    m.annotate_globals(a=1).write(str(tmp_path / "m"))
    back = read_matrix(spark, str(tmp_path / "m"))
    assert (back.globals, cells(back)) == ({"a": 1}, cells(m))


def test_linear_regression_matches_least_squares(spark):
    rng = np.random.default_rng(1)
    x, y, c = rng.normal(size=(5, 40)), rng.normal(size=40), rng.normal(size=40)
    m = matrix(spark, x, {"y": y, "c": c})
    m = m.filter_entries((F.col("row_idx") != 2) | (F.col("col_idx") > 4))
    got = {r["row_idx"]: r for r in regression.linear_regression_rows(m, "y", "x", [1.0, "c"]).df.collect()}
    for i in range(5):
        v = x[i].copy()
        if i == 2:
            v[:5] = v[5:].mean()
        a = np.column_stack([v, np.ones(40), c])
        b, rss = np.linalg.lstsq(a, y, rcond=None)[:2]
        se = np.sqrt(rss[0] / 37 * np.linalg.inv(a.T @ a)[0, 0])
        assert abs(got[i]["beta"] - b[0]) < 1e-9
        assert abs(got[i]["standard_error"] - se) < 1e-9
        assert 0 <= got[i]["p_value"] <= 1


def matrix(spark, x, cols):
    n, k = x.shape
    e = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(n) for j in range(k)], "row_idx int, col_idx int, x double")
    c = spark.createDataFrame([(j, *[float(v[j]) for v in cols.values()]) for j in range(k)], "col_idx int, " + ", ".join(f"{n} double" for n in cols))
    return MatrixTable(spark.range(n).select(F.col("id").cast("int").alias("row_idx")), c, e, ["row_idx"], ["col_idx"])


@pytest.mark.parametrize("test", ["wald", "lrt", "score", "firth"])
def test_logistic_and_poisson(spark, test):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 60))
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * x[0]))).astype(float)
    m = matrix(spark, x, {"y": y})
    got = {r["row_idx"]: r["p_value"] for r in regression.logistic_regression_rows(m, test, "y", "x").df.collect()}
    assert got[0] < 1e-3 < min(got[1], got[2])
    if test != "firth":
        assert all(0 <= r["p_value"] <= 1 for r in regression.poisson_regression_rows(m, test, "y", "x").df.collect())


@pytest.mark.parametrize("cases", [1, 1 << 18])
def test_logistic_rows_of_few_entries(spark, monkeypatch, cases):
    from latticeframe.plans.inspect import plan_text

    monkeypatch.setattr(regression, "CASES", cases)
    rng = np.random.default_rng(9)
    x, y, z = rng.normal(size=(6, 300)), (rng.random(300) < 0.4).astype(float), rng.integers(0, 3, 300).astype(float)
    there = rng.random((6, 300)) < 0.1
    x[0] += 2 * y
    x[5] = 4.0  # collinear with the intercept
    m = matrix(spark, x, {"y": y, "z": z})
    keep = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(there), strict=True)], "row_idx int, col_idx int")
    m = m.new(entries=m.entries_df.join(keep, ["row_idx", "col_idx"]))
    df = regression.logistic_regression_rows(m, "wald", "y", "x", [1.0, "z"]).df
    assert "InPandas" not in plan_text(df)  # rows are fitted many at once, and absent entries by weights
    got = {r["row_idx"]: r for r in df.collect()}
    assert len(got) == 6 and not got[5]["converged"] and got[5]["beta"] is None
    for i in range(5):
        full = np.column_stack([np.where(there[i], x[i], x[i][there[i]].mean()), np.ones(300), z])
        b = np.zeros(3)
        for _ in range(25):
            mu = 1 / (1 + np.exp(-full @ b))
            info = (full * (mu * (1 - mu))[:, None]).T @ full
            b += np.linalg.solve(info, full.T @ (y - mu))
        assert got[i]["converged"] and np.isclose(got[i]["beta"], b[0], atol=1e-7) and np.isclose(got[i]["standard_error"], np.linalg.inv(info)[0, 0] ** 0.5, rtol=1e-6)


def test_block_matrix(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(5, 6))
    p, q = BlockMatrix.from_numpy(spark, a, 3), BlockMatrix.from_numpy(spark, b, 3)
    for got, want in [((p @ q), a @ b), (p.T, a.T), (p + p, 2 * a), (p * 2 - 1, 2 * a - 1), (p.abs().sqrt(), np.sqrt(abs(a))), (p.sum(0), a.sum(0, keepdims=True)), (p.sum(1), a.sum(1, keepdims=True)), (p.filter_rows([6, 1]), a[[6, 1]]), (p[1:4, 2:], a[1:4, 2:]), (p * a[:, :1], a * a[:, :1])]:
        assert np.allclose(got.to_numpy(), want)
    assert np.allclose(p.sparsify_band(-1, 1).to_numpy(), np.where(abs(np.arange(5) - np.arange(7)[:, None]) <= 1, a, 0))
    assert abs(p.sum() - a.sum()) < 1e-9
    assert p[4, 2] == a[4, 2]
    assert np.allclose(p.diagonal(), np.diagonal(a))
    u, s, v = p.svd(3)
    assert np.allclose(s, np.linalg.svd(a)[1][:3], atol=1e-6)
    assert np.allclose(BlockMatrix.from_entries(p.entries(), 7, 5, 4).to_numpy(), a)


@pytest.fixture(scope="module")
def genotypes(spark):
    return methods.balding_nichols_model(spark, 2, 12, 30, seed=5)


def test_quality_control(genotypes):
    v = methods.variant_qc(genotypes).rows_df.select("variant_qc.*").collect()
    s = methods.sample_qc(genotypes).cols_df.select("sample_qc.*").collect()
    assert all(r["n_called"] == 12 and r["AN"] == 24 and sum(r["AC"]) == 24 for r in v)
    assert sum(r["n_het"] for r in v) == sum(r["n_het"] for r in s)
    assert all(r["call_rate"] == 1 for r in s)


def test_relatedness(genotypes):
    n = 12
    assert methods.king(genotypes).count() == n * (n - 1) // 2
    ibd = methods.identity_by_descent(genotypes).collect()
    assert all(abs(r["Z0"] + r["Z1"] + r["Z2"] - 1) < 1e-9 for r in ibd)
    grm = methods.genetic_relatedness_matrix(genotypes).to_numpy()
    assert np.allclose(grm, grm.T)
    c = methods.row_correlation(genotypes.annotate_entries(n=g.n_alt_alleles("GT")), "n").to_numpy()
    e = {(r[0]["position"], r[1]): r[2] for r in genotypes.annotate_entries(n=g.n_alt_alleles("GT")).entries_df.select("locus", "sample_idx", "n").collect()}
    x = np.array([[e[(i + 1, j)] for j in range(n)] for i in range(30)], float)
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(x)
    assert np.allclose(np.where(np.isnan(want), c, want), c)
    values, scores, _ = methods.hwe_normalized_pca(genotypes, k=2)
    assert values[0] >= values[1] > 0
    assert scores.count() == n


def test_pair_counts(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-1, 3, (15, 6))  # -1: not called
    e = spark.createDataFrame([(i, j, int(x[i, j])) for i in range(15) for j in range(6)], "r int, c int, n int")
    e = e.select("r", "c", F.when(F.col("n") >= 0, g.call(F.when(F.col("n") == 2, 1).otherwise(0), F.when(F.col("n") > 0, 1).otherwise(0))).alias("GT"))
    m = MatrixTable(e.select("r").distinct(), e.select("c").distinct(), e, ["r"], ["c"])
    got = {(r["i"]["c"], r["j"]["c"]): tuple(r)[2:] for r in methods.pair_counts(m, "GT").collect()}
    want = {}
    for i in range(6):
        for j in range(i + 1, 6):
            a, b = (x[(x[:, i] >= 0) & (x[:, j] >= 0), k] for k in (i, j))
            d = abs(a - b)
            want[i, j] = (len(a), ((a == 1) & (b == 1)).sum(), (d == 2).sum(), (d == 1).sum(), (d == 0).sum(), (a == 1).sum(), (b == 1).sum(), (d * d).sum())
    assert got == want
    phi = {(r["i"]["c"], r["j"]["c"]): r["phi"] for r in methods.king(m).collect()}
    assert all(abs(phi[k] - (0.5 - v[7] / (4 * min(v[5], v[6])))) < 1e-12 for k, v in want.items() if min(v[5], v[6]))
    assert methods.pair_counts(m.new(entries=e.limit(0)), "GT").count() == 0


def test_leading(spark, monkeypatch):
    from latticeframe.operators import blockmatrix

    monkeypatch.setattr(blockmatrix, "STRIPE", 20)  # stripes of three rows, and shorter ones at the ends of blocks
    a = np.random.default_rng(6).normal(size=(23, 6)) * np.array([9, 5, 3, 1, 1, 1])
    a[8:12] = 0
    b = BlockMatrix.from_numpy(spark, a, 4)
    values, right, left = b.new(b.blocks.where("br <> 2")).leading(3)
    assert np.allclose(values, np.linalg.svd(a)[1][:3])
    got = {r["i"]: r["vector"] for r in left.collect()}
    assert sorted(got) == [i for i in range(23) if not 8 <= i < 12]
    u = np.array([got.get(i, [0.0] * 3) for i in range(23)])
    assert np.allclose(a.T @ u, right * values)
    u, s, v = b.T.svd(3)
    assert u.shape == (6, 3)
    assert np.allclose(u * s @ v @ v.T, a.T @ v.T)


def test_pca_of_sparse_entries_settles(spark, monkeypatch):
    from latticeframe.operators import blockmatrix

    rng = np.random.default_rng(8)
    a = np.where(rng.random((400, 60)) < 0.1, rng.integers(1, 50, (400, 60)), 0).astype(float)
    a[:, 7], a[5] = 0, 0
    i, j = np.nonzero(a)
    entries = spark.createDataFrame([(int(p) + 10, int(q), float(a[p, q])) for p, q in zip(i, j, strict=True)], "r int, c int, x double")
    m = MatrixTable(spark.range(400).select((F.col("id") + 10).cast("int").alias("r")), spark.range(60).select(F.col("id").cast("int").alias("c")), entries, ["r"], ["c"])
    monkeypatch.setattr(BlockMatrix, "from_entries", None)  # nothing is made dense
    for basis in (1 << 24, 1):  # and with restarts
        monkeypatch.setattr(blockmatrix, "BASIS", basis)
        values, scores, loadings = methods.pca(m, "x", 3)
        u, s, v = np.linalg.svd(a, full_matrices=False)
        assert np.allclose(values, s[:3] ** 2, rtol=1e-9)
        got = np.array([r["scores"] for r in scores.df.orderBy("c").collect()])
        assert got.shape == (60, 3) and np.allclose(np.abs(got), np.abs(v[:3].T * s[:3]), atol=1e-5)
        left = np.array([r["loadings"] for r in loadings.df.orderBy("r").collect()])
        assert left.shape == (400, 3) and np.allclose(a @ (got / s[:3] ** 2), left, atol=1e-7)


def test_nearby_products(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(30, 9))
    group = [None if i == 7 else "xy"[i >= 17] for i in range(30)]
    at = [None if i == 20 else int(v) for i, v in enumerate(np.concatenate([np.sort(rng.integers(-40, 60, 17)), np.sort(rng.integers(0, 60, 13))]))]
    places = spark.createDataFrame([(i, group[i], at[i]) for i in range(30)], "i long, group string, at int")
    known = np.array([g is not None and p is not None for g, p in zip(group, at, strict=True)])
    far = abs(np.array([p or 0 for p in at])[:, None] - np.array([p or 0 for p in at])[None])
    same = np.array([[known[i] and known[j] and group[i] == group[j] for j in range(30)] for i in range(30)])
    b = BlockMatrix.from_numpy(spark, a, 4)
    for radius in (0, 3, 25):
        near = methods.nearby_products(b, places, radius)
        assert np.allclose(near.to_numpy(), np.where(same & (far <= radius), a @ a.T, 0))
    assert methods.nearby_products(b, places, 3).blocks.count() < 64
    upper = methods.nearby_products(b, places, 25, upper=True)
    assert np.allclose(np.triu(upper.to_numpy()), np.triu(np.where(same & (far <= 25), a @ a.T, 0)))
    with pytest.raises(ValueError):
        methods.nearby_products(b, places, float("inf"))


def test_ld_matrix(genotypes):
    m = genotypes.annotate_entries(n=g.n_alt_alleles("GT")).annotate_rows(at=F.col("locus.position"))
    full = methods.row_correlation(m, "n").to_numpy()
    far = abs(np.arange(30)[:, None] - np.arange(30)[None])
    assert np.allclose(methods.ld_matrix(m, "n", "at", 5).to_numpy(), np.where(far <= 5, full, 0))


def test_pedigrees(spark):
    calls = [(1, "kid", 1), (1, "dad", 0), (1, "mum", 0), (2, "kid", 1), (2, "dad", 1), (2, "mum", 0), (3, "kid", 0), (3, "dad", 2), (3, "mum", 1)]
    e = spark.createDataFrame(calls, "v int, s string, n int").select("v", "s", g.call(F.when(F.col("n") == 2, 1).otherwise(0), F.when(F.col("n") > 0, 1).otherwise(0)).alias("GT"))
    m = MatrixTable(e.select("v").distinct(), e.select("s").distinct(), e, ["v"], ["s"])
    trios = spark.createDataFrame([("kid", "dad", "mum")], "id string, pat_id string, mat_id string")
    assert {(r["v"], r["mendel_code"]) for r in methods.mendel_errors(m, trios).collect()} == {(1, 2), (3, 6)}
    tdt = {r["v"]: (r["t"], r["u"]) for r in methods.transmission_disequilibrium_test(m, trios).collect()}
    assert tdt[2] == (1, 0)


def test_split_multi(spark):
    row = spark.range(1).select(g.locus(F.lit("1"), F.lit(10)).alias("locus"), F.array(F.lit("A"), F.lit("T"), F.lit("AC")).alias("alleles"))
    e = row.select("locus", "alleles", F.lit("s").alias("s"), g.call(1, 2).alias("GT"), F.array(F.lit(5), F.lit(7), F.lit(9)).alias("AD"), F.array(*[F.lit(x) for x in (60, 50, 40, 30, 0, 70)]).alias("PL"))
    m = methods.split_multi(MatrixTable(row, spark.createDataFrame([("s",)], "s string"), e, ["locus", "alleles"], ["s"]))
    got = {r["alleles"][1]: r for r in m.entries_df.collect()}
    assert got["T"]["GT"]["alleles"] == [0, 1]
    assert (got["T"]["AD"], got["AC"]["AD"]) == ([14, 7], [12, 9])
    assert got["T"]["PL"] == [30, 0, 40]
