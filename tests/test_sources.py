from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeframe.functions import genetics as g
from latticeframe.functions import ndarray as nd
from latticeframe.operators import methods
from latticeframe.plans.materialize import shared_folder
from latticeframe.sources.vcf import export_vcf, import_vcf

VCF = """##fileformat=VCFv4.2
##INFO=<ID=AC,Number=A,Type=Integer,Description="x">
##INFO=<ID=DB,Number=0,Type=Flag,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="x">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
1\t10\trs1\tA\tT,C\t30.5\tPASS\tAC=1,2;DB\tGT:AD\t0/1:3,4,0\t./.
1\t20\t.\tG\tC\t.\tq10;a\t.\tGT\t1|0\t1/1
"""


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    m = import_vcf(spark, str(tmp_path / "a.vcf"))
    rows = m.rows_df.orderBy("locus").collect()
    assert (rows[0]["alleles"], rows[0]["rsid"], rows[0]["qual"], rows[0]["filters"]) == (["A", "T", "C"], "rs1", 30.5, [])
    assert (rows[0]["info"]["AC"], rows[0]["info"]["DB"], rows[1]["info"]["AC"], rows[1]["info"]["DB"]) == ([1, 2], True, None, False)
    assert rows[1]["filters"] == ["a", "q10"]
    e = {(r["locus"]["position"], r["s"]): (r["t"], r["AD"]) for r in m.entries_df.select("*", g.call_text("GT").alias("t")).collect()}
    assert e == {(10, "s1"): ("0/1", [3, 4, 0]), (10, "s2"): (None, None), (20, "s1"): ("1|0", None), (20, "s2"): ("1/1", None)}
    export_vcf(m, str(tmp_path / "out"))
    text = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "1\t20\t.\tG\tC\t.\ta;q10\t.\tGT\t1|0\t1/1" in text


def test_ndarrays(spark):
    a = np.array([[2.0, 1.0], [1.0, 3.0]])
    df = spark.createDataFrame([(a.ravel().tolist(),), (None,)], "x array<double>").select(F.when(F.col("x").isNotNull(), nd.array("x", 2, 2)).alias("a"))
    for column, want in [(nd.inv("a"), np.linalg.inv(a)), (nd.matmul("a", "a"), a @ a), (nd.transpose("a"), a.T), (nd.solve("a", "a"), np.eye(2)), (nd.singular_values("a"), np.linalg.svd(a)[1]), (nd.sum_axis("a", 0), a.sum(0))]:
        got = df.select(column.alias("y")).collect()
        assert np.allclose(np.array(got[0]["y"]["data"]).reshape(got[0]["y"]["shape"]), want)
        assert got[1]["y"] is None or got[1]["y"]["data"] is None
    assert df.select(nd.element("a", 1, 1)).first()[0] == 3


def test_ld_prune(spark):
    m = methods.balding_nichols_model(spark, 1, 20, 8, seed=2)
    twin = m.entries_df.withColumn("locus", F.col("locus").withField("position", F.col("locus.position") + 100))
    both = m.new(rows=m.rows_df.unionByName(m.rows_df.withColumn("locus", F.col("locus").withField("position", F.col("locus.position") + 100))), entries=m.entries_df.unionByName(twin))
    kept = {r["locus"]["position"] for r in methods.ld_prune(both, r2=0.95).df.collect()}
    assert len(kept) <= 8
    assert not any(p + 100 in kept for p in kept)
    assert methods.ld_prune(both, r2=0.95, window=50).df.count() > len(kept)  # the twins are farther apart


def test_shared_folder():
    def session(master, folder=None):
        conf = {"spark.checkpoint.dir": folder} if folder else {}
        context = SimpleNamespace(master=master, getConf=lambda: conf)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, default: default, set=conf.__setitem__))

    assert shared_folder(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
