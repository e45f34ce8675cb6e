"""The engine's own format: Parquet with a sidecar of JSON for key and globals, written and read through Hadoop's file systems."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from latticeframe.operators.matrix import MatrixTable
from latticeframe.operators.table import Table


def write_json(spark: SparkSession, path: str, value, overwrite: bool) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, overwrite)
    stream.write(bytearray(json.dumps(value, default=str).encode()))
    stream.close()


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def write_table(table: Table, path: str, overwrite: bool = False, sort: bool = True) -> None:
    """Rows range-partitioned and sorted by key, so that readers skip row groups by key; key and globals beside them."""
    spark = table.df.sparkSession
    df = table.df.repartitionByRange(*table.key).sortWithinPartitions(*table.key) if sort and table.key else table.df
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/rows")
    write_json(spark, f"{path}/metadata.json", {"kind": "table", "key": list(table.key), "globals": table.globals}, overwrite)


def read_table(spark: SparkSession, path: str, intervals: list[tuple] | None = None) -> Table:
    """A table; with intervals of its first key field, only rows in one of them, which scans skip to."""
    from latticeframe.operators.intervals import filter_intervals

    meta = read_json(spark, f"{path}/metadata.json")
    table = Table(spark.read.parquet(f"{path}/rows"), meta["key"], meta["globals"])
    return table.with_df(filter_intervals(table.df, table[table.key[0]], intervals)) if intervals else table


def write_matrix(matrix: MatrixTable, path: str, overwrite: bool = False) -> None:
    spark, mode = matrix.rows_df.sparkSession, "overwrite" if overwrite else "errorifexists"
    matrix.rows_df.write.mode(mode).parquet(f"{path}/rows")
    matrix.cols_df.write.mode(mode).parquet(f"{path}/cols")
    matrix.entries_df.repartitionByRange(*matrix.row_key).sortWithinPartitions(*matrix.row_key).write.mode(mode).parquet(f"{path}/entries")
    write_json(spark, f"{path}/metadata.json", {"kind": "matrix", "row_key": list(matrix.row_key), "col_key": list(matrix.col_key), "globals": matrix.globals}, overwrite)


def read_matrix(spark: SparkSession, path: str) -> MatrixTable:
    meta = read_json(spark, f"{path}/metadata.json")
    return MatrixTable(*[spark.read.parquet(f"{path}/{p}") for p in ("rows", "cols", "entries")], meta["row_key"], meta["col_key"], meta["globals"])


def write_many(things: list, prefix: str, overwrite: bool = False) -> None:
    for i, x in enumerate(things):
        x.write(f"{prefix}{i}", overwrite)
