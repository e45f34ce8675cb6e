"""A training-data pipeline of the corpus operators: each stage works on all that the one before it kept.

documents -> quality -> lines -> near duplicates -> mixing -> token ids. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.llm import line_dedup, ngram_join, piece_codec, quality
from latticeframe.llm.common import shared_dir, table
from latticeframe.llm.queries import THRESHOLD, mixed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on docs and the labels table, scores at 0.5 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.classify(docs.select(*COLUMNS), model).where("quality_score >= 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; n_chars follows the text. Documents that repeat others entirely go."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS), THRESHOLD)
    n_chars = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id."""
    docs = docs.select(*COLUMNS)
    return ngram_join.one_of_each(docs, ngram_join.near_classes(docs, THRESHOLD)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled with the probabilities that bring sources, languages and topics to their target shares of tokens."""
    return mixed(docs.select(*COLUMNS)).where("mix_kept").select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, lang, source, ids, n_tokens, round_trip)."""
    done = piece_codec.decode(piece_codec.encode(docs.select(*COLUMNS)))
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [("quality", keep_good), ("line dedup", drop_repeated_lines), ("near duplicates", one_of_each_group), ("mixing", mix_sources), ("token ids", encode_pieces)]
ORACLE_SQL = None  # the classifier and the encoder are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
