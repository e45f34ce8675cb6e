import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.catalog.queries()))
def test_query_has_the_columns_of_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = entry.catalog.queries()[name](spark, SMALL)
    sql = entry.catalog.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for p in Path(SMALL).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rel = db.sql(sql)
        assert sorted(rel.columns) == sorted(df.columns)
        assert db.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] == df.count()
    else:
        assert df.count() > 0


def test_imports_without_the_corpus_subpackage():
    code = "import sys\nfor m in ('latticeframe.llm', 'corpus_pipeline'):\n    sys.modules[m] = None\nimport __spark_entry__ as e\nassert e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_queries_without_sql_take_the_whole_tables(spark):
    from latticeframe import catalog

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert catalog.fn_distributions(spark, sf).count() == lines.count()
    parts = catalog.method_logistic_regression(spark, sf).select("l_partkey")
    assert parts.distinct().count() == lines.select("l_partkey").distinct().count()
    edges = [(r[0] * 2, r[1] * 2 + 1) for r in lines.select("l_suppkey", "l_partkey").distinct().collect()]
    got = {r[0] for r in catalog.method_maximal_independent_set(spark, sf).collect()}
    assert not any(a in got and b in got for a, b in edges)
    near = {n: {n} for e in edges for n in e}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    assert all(near[n] & got for n in near)
