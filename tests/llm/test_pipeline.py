import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from latticeframe.llm import line_dedup, mixing, ngram_join, quality, queries
from latticeframe.llm.common import table
from test_line_dedup import brute as repeated
from test_ngram_join import brute as classes

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = quality.fit(docs, table(spark, SF, "labels", "doc_id", "quality"))
    good = {i: r for i, r in rows.items() if quality.scores([r["text"]], model)[0] >= 0.5}
    gone = repeated([(i, r["text"]) for i, r in good.items()], queries.THRESHOLD)
    kept = {}
    for i, r in good.items():
        lines = r["text"].split("\n")
        left = [x for k, x in enumerate(lines) if (i, k) not in gone]
        if len(left) == len(lines) or any(x.strip() for x in left):
            kept[i] = r | {"text": "\n".join(left)}
    first = {c for _, c, _ in classes([(i, r["text"]) for i, r in kept.items()], queries.THRESHOLD, 5)}
    df = spark.createDataFrame([tuple(kept[i][c] for c in pipeline.COLUMNS) for i in sorted(first)], docs.schema)
    want = {r["doc_id"] for r in queries.mixed(df).where("mix_kept").collect()}
    got = pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_handle_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "src0", 0), (2, "some words that are good enough to be kept", "en", "src1", 42), (2, "some words that are good enough to be kept", "en", "src1", 42), (3, "long " * 60_000, None, "src2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(None, 1), (1, None), (2, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (df.withColumn("extra", F.lit(1)).withColumn("row", F.lit(2)), df.limit(0)):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.count() >= 0, name
            if name != pipeline.STAGES[-1][0]:
                assert out.columns == pipeline.COLUMNS
                docs = out
    assert {line_dedup.__name__, ngram_join.__name__, mixing.__name__}


def test_pipeline_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} <= names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
