import math

import pytest
from pyspark.sql import functions as F

from latticeframe.functions import genetics as g
from latticeframe.functions import scalar as s
from latticeframe.functions import statistics as st
from latticeframe.semantics import if_else, number_range

INF, NAN = math.inf, math.nan


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_arithmetic_rules(spark):
    assert value(spark, s.divide(F.lit(1.0), F.lit(0.0))) == INF
    assert value(spark, s.divide(F.lit(-1), F.lit(0))) == -INF
    assert math.isnan(value(spark, s.divide(F.lit(0.0), F.lit(0.0))))
    assert value(spark, s.floordiv(F.lit(-7), F.lit(2))) == -4
    assert value(spark, s.floormod(F.lit(7), F.lit(-3))) == -2
    assert value(spark, s.log(F.lit(0.0))) == -INF
    assert math.isnan(value(spark, s.log(F.lit(-1.0))))
    assert value(spark, if_else(F.lit(None).cast("boolean"), 1, 2)) is None
    assert value(spark, number_range(F.lit(0), F.lit(0))) == []
    assert value(spark, s.approx_equal(F.lit(1.0), F.lit(1.0 + 1e-9))) is True


def test_control(spark):
    case = s.Case().when(F.lit(None).cast("boolean"), 1)
    assert value(spark, case.default(2)) is None
    assert value(spark, s.Case(missing_false=True).when(F.lit(None).cast("boolean"), 1).default(2)) == 2
    assert value(spark, s.Switch(F.lit(3)).when(3, "x").default("y")) == "x"
    assert value(spark, s.Switch(F.lit(None).cast("int")).when(3, "x").when_missing("m").default("y")) == "m"


def test_strings(spark):
    t = F.lit("hello world")
    assert value(spark, s.char_at(t, -1)) == "d"
    assert value(spark, s.char_at(t, 40)) is None
    assert value(spark, s.slice_string(t, 0, 5)) == "hello"
    assert value(spark, s.slice_string(t, -5)) == "world"
    assert value(spark, s.find(t, "zz")) == -1
    assert value(spark, s.first_match_in(t, r"(\w+) (\w+)", 2)) == ["hello", "world"]
    assert value(spark, s.matches(t, "hello", full=True)) is False
    assert value(spark, s.translate(t, {"l": "L"})) == "heLLo worLd"
    assert value(spark, s.hamming(F.lit("abc"), F.lit("abd"))) == 1
    assert abs(value(spark, s.entropy(F.lit("aabb"))) - 1) < 1e-12


def test_arrays(spark):
    x = arr(3, 1, None, 2)
    assert value(spark, s.sorted(x)) == [1, 2, 3, None]
    assert value(spark, s.sorted(x, reverse=True)) == [3, 2, 1, None]
    assert value(spark, s.sum(x)) == 6
    assert value(spark, s.mean(x)) == 2
    assert value(spark, s.median(x)) == 2
    assert value(spark, s.has(x, F.lit(None))) is True
    assert value(spark, s.cumulative_sum(arr(1.0, 2.0))) == [1, 3]
    assert value(spark, s.grouped(arr(1, 2, 3), 2)) == [[1, 2], [3]]
    assert value(spark, s.group_array(arr(1, 2, 3), lambda e: e % 2)) == {1: [1, 3], 0: [2]}
    assert math.isnan(value(spark, s.array_max(arr(1.0, NAN))))
    assert [tuple(r) for r in value(spark, s.zip_arrays(arr(1, 2), arr("a")))] == [(1, "a")]
    assert [tuple(r) for r in value(spark, s.enumerate_array(arr("a")))] == [(0, "a")]
    assert value(spark, s.binary_search(arr(1, 3, 5), F.lit(4))) == 2
    assert value(spark, s.argmin(arr(2, 1, 1))) == 1
    assert value(spark, s.symmetric_difference(arr(1, 2), arr(2, 3))) == [1, 3]


def test_random_values_are_stable(spark):
    df = spark.range(5000).select(s.rand_unif("id", seed=3).alias("u"), s.rand_norm("id").alias("n"), s.rand_cat("id", [1, 1, 2]).alias("c"))
    r = df.agg(F.avg("u"), F.avg("n"), F.stddev("n"), F.avg((F.col("c") == 2).cast("int"))).first()
    assert abs(r[0] - 0.5) < 0.02
    assert abs(r[1]) < 0.06
    assert abs(r[2] - 1) < 0.05
    assert abs(r[3] - 0.5) < 0.03
    assert df.collect() == df.repartition(7).sort("u").collect() or sorted(df.collect()) == sorted(df.repartition(7).collect())


@pytest.mark.parametrize(("column", "expected"), [
    (lambda: st.pnorm(F.lit(1.96)), 0.9750021048517795), (lambda: st.qnorm(F.lit(0.975)), 1.959963984540054), (lambda: st.pchisqtail(F.lit(3.841459), F.lit(1.0)), 0.05), (lambda: st.qchisqtail(F.lit(0.05), F.lit(1.0)), 3.841458820694124),
    (lambda: st.pT(F.lit(2.0), F.lit(10.0)), 0.963305983), (lambda: st.pF(F.lit(3.0), F.lit(4.0), F.lit(10.0)), 0.9276767778), (lambda: st.ppois(F.lit(2.0), F.lit(3.0)), 0.42319008), (lambda: st.dpois(F.lit(2.0), F.lit(3.0)), 0.22404181),
    (lambda: st.binom_test(F.lit(5), F.lit(10), 0.2), 0.03279349759999998), (lambda: st.phyper(F.lit(1), F.lit(10), F.lit(4), F.lit(3)), 2 / 3), (lambda: st.dnorm(F.lit(0.0)), 0.3989422804014327), (lambda: st.dbeta(F.lit(0.3), F.lit(2.0), F.lit(3.0)), 1.764),
])
def test_distributions(spark, column, expected):
    assert abs(value(spark, column()) - expected) < 1e-5


def test_exact_tests(spark):
    r = value(spark, st.fisher_exact_test(F.lit(8), F.lit(2), F.lit(1), F.lit(5)))
    assert abs(r["p_value"] - 0.03496503496503495) < 1e-9
    assert r["ci_95_lower"] < r["odds_ratio"] < r["ci_95_upper"]
    assert abs(value(spark, st.hardy_weinberg(F.lit(1), F.lit(2), F.lit(1)))["p_value"] - 0.6571428571428573) < 1e-9
    assert value(spark, st.chi_squared_test(F.lit(10), F.lit(10), F.lit(10), F.lit(10)))["p_value"] == 1


def test_calls(spark):
    c = g.call(1, 0)
    assert value(spark, g.call_text(c)) == "0/1"
    assert value(spark, g.call_text(g.call(1, 0, phased=True))) == "1|0"
    assert value(spark, g.parse_call(F.lit("./."))) is None
    assert value(spark, g.is_het_ref(c)) is True
    assert value(spark, g.unphased_diploid_gt_index(g.call(1, 2))) == 4
    assert value(spark, g.unphased_diploid_gt_index_call(F.lit(4)))["alleles"] == [1, 2]
    assert value(spark, g.one_hot_alleles(g.call(1, 1), 3)) == [0, 2, 0]
    assert value(spark, g.gq_from_pl(arr(0, 20, 400))) == 20
    assert abs(sum(value(spark, g.pl_to_gp(arr(0, 10, 100)))) - 1) < 1e-12


@pytest.mark.parametrize(("ref", "alt", "kind"), [("A", "T", "SNP"), ("AC", "TG", "MNP"), ("A", "AT", "Insertion"), ("AT", "A", "Deletion"), ("A", "*", "Star"), ("A", "<DEL>", "Symbolic"), ("ACT", "GG", "Complex"), ("AA", "TA", "SNP")])
def test_allele_types(spark, ref, alt, kind):
    assert value(spark, g.allele_type(F.lit(ref), F.lit(alt))) == kind


def test_alleles_and_loci(spark):
    assert value(spark, g.is_transition(F.lit("A"), F.lit("G"))) is True
    assert value(spark, g.reverse_complement(F.lit("AACG"))) == "CGTT"
    assert tuple(value(spark, g.min_rep(F.lit(10), F.lit("TAA"), F.lit("TA")))) == (10, "TA", "T")
    v = value(spark, g.parse_variant(F.lit("1:5:A:T,C")))
    assert (v["locus"]["position"], v["alleles"]) == (5, ["A", "T", "C"])
    rg = g.ReferenceGenome("toy", {"1": 100, "X": 50}, x="X", par=[("X", 1, 10)])
    assert value(spark, rg.global_position(F.lit("X"), F.lit(1))) == 100
    assert value(spark, rg.in_x_par(F.lit("X"), F.lit(5))) is True
    assert value(spark, rg.is_valid_locus(F.lit("2"), F.lit(5))) is False
