"""Text sources and sinks: delimited tables, lines, matrices in text, interval files, gene annotation, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeframe.operators.intervals import interval
from latticeframe.operators.matrix import MatrixTable
from latticeframe.operators.table import Table

TYPES = {"int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "str": "string", "bool": "boolean"}


def import_table(
    spark: SparkSession, paths, key=(), types: dict[str, str] | None = None, delimiter: str = "\t", missing="NA", impute: bool = False, no_header: bool = False,
    comment: str | None = None, quote: str | None = None, skip_blank_lines: bool = True, filter: str | None = None, find_replace: tuple[str, str] | None = None,  # noqa: A002
) -> Table:
    """A table from delimited text. Fields are strings unless types or impute say otherwise; missing tokens become null; without a header fields are f0, f1, ...

    filter drops lines that match a pattern and find_replace rewrites lines, both before parsing.
    """
    missing = [missing] if isinstance(missing, str) else list(missing)
    options = {"sep": delimiter, "header": not no_header, "quote": quote or "", "comment": comment, "mode": "FAILFAST", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    reader = spark.read.options(**{k: v for k, v in options.items() if v is not None})
    if filter or find_replace:
        lines = spark.read.text(paths)
        lines = lines.where(~F.col("value").rlike(filter)) if filter else lines
        lines = lines.select(F.regexp_replace("value", *find_replace).alias("value")) if find_replace else lines
        first = (lines.first() or [""])[0]
        names = first.split(delimiter)
        schema = ", ".join(f"`{f'f{i}' if no_header else n}` string" for i, n in enumerate(names))
        rows = lines if no_header else lines.where(F.col("value") != first)
        df = rows.select(F.from_csv("value", schema, {"sep": delimiter, "quote": quote or "", "mode": "FAILFAST"}).alias("r")).select("r.*")
    else:
        df = reader.csv(paths)
    if no_header:
        df = df.toDF(*[f"f{i}" for i in range(len(df.columns))])
    null = lambda c: F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`"))
    df = df.select(*[null(c).alias(c) for c in df.columns])
    kinds = {**(impute_types(df) if impute else {}), **{k: TYPES.get(v, v) for k, v in (types or {}).items()}}
    df = df.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns])
    return Table(df, key)


def impute_types(df: DataFrame) -> dict[str, str]:
    """The narrowest of boolean, int, bigint, double and string that all present values of each field have, in one pass."""
    fits = {"boolean": r"^(true|false|True|False)$", "bigint": r"^[-+]?\d{1,18}$", "double": r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$|^-?(NaN|nan|Infinity|inf)$"}
    checks = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        whole = F.max(F.abs(F.when(x.rlike(fits["bigint"]), x).try_cast("bigint")))
        checks.append(F.struct(*[F.bool_and(x.rlike(p)).alias(k) for k, p in fits.items()], whole.alias("most")).alias(c))
    got = df.agg(*checks).first()
    out = {}
    for c in df.columns:
        r = got[c]
        out[c] = "boolean" if r["boolean"] else ("int" if (r["most"] or 0) < 2**31 else "bigint") if r["bigint"] else "double" if r["double"] else "string"
    return out


def import_csv(spark: SparkSession, paths, key=(), **options) -> Table:
    return import_table(spark, paths, key, delimiter=",", quote='"', **options)


def import_lines(spark: SparkSession, paths) -> Table:
    """Rows (file, text), one for each line."""
    return Table(spark.read.text(paths).select(F.input_file_name().alias("file"), F.col("value").alias("text")))


def import_parquet(spark: SparkSession, paths, key=()) -> Table:
    return Table(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)), key)


def import_avro(spark: SparkSession, paths, key=()) -> Table:
    """Needs Spark's Avro package on the class path."""
    return Table(spark.read.format("avro").load(paths), key)


def import_json(spark: SparkSession, paths, schema=None, key=()) -> Table:
    return Table((spark.read.schema(schema) if schema else spark.read).json(paths), key)


def import_matrix_table(spark: SparkSession, paths, row_fields: dict[str, str], row_key, entry_type: str = "int32", delimiter: str = "\t", missing: str = "NA") -> MatrixTable:
    """A matrix from text whose header names the row fields and then the columns; entries are in the field x."""
    df = import_table(spark, paths, delimiter=delimiter, missing=missing, types=row_fields).df
    ids = [c for c in df.columns if c not in row_fields]
    long = df.select(*row_key, F.explode(F.array(*[F.struct(F.lit(c).alias("col_id"), F.col(f"`{c}`").cast(TYPES.get(entry_type, entry_type)).alias("x")) for c in ids])).alias("__e")).select(*row_key, "__e.*")
    return MatrixTable(df.select(*row_fields), spark.createDataFrame([(c,) for c in ids], "col_id string"), long, row_key, ["col_id"])


def import_bed(spark: SparkSession, path: str, chromosomes_prefix: str = "") -> Table:
    """Intervals from BED text, keyed by interval of 1-based positions [start + 1, end + 1): contig beside it, and target from the fourth field if there is one."""
    lines = spark.read.text(path).where("value not rlike '^(#|track|browser)' and trim(value) <> ''")
    f = F.split("value", r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    return Table(lines.select(interval(at(1).cast("int") + 1, at(2).cast("int") + 1).alias("interval"), F.concat(F.lit(chromosomes_prefix), at(0)).alias("contig"), at(3).alias("target")), "interval")


def import_locus_intervals(spark: SparkSession, path: str) -> Table:
    """Intervals from lines contig:start-end (start and end included), or from tab-separated contig, start, end[, strand, target]."""
    lines = spark.read.text(path).where("value not rlike '^@' and trim(value) <> ''")
    colon = F.regexp_extract("value", r"^([^:\t]+):(\d+)-(\d+)$", 1)
    f = F.split("value", "\t")
    part = lambda k, i: F.when(colon != "", F.regexp_extract("value", r"^([^:\t]+):(\d+)-(\d+)$", k)).otherwise(F.get(f, F.lit(i)))
    return Table(lines.select(interval(part(2, 1).cast("int"), part(3, 2).cast("int"), True, True).alias("interval"), part(1, 0).alias("contig"), F.get(f, F.lit(4)).alias("target")), "interval")


def import_fam(spark: SparkSession, path: str, quant_pheno: bool = False, missing: str = "NA", delimiter: str = r"\s+") -> Table:
    """Samples from a FAM file: id, fam_id, pat_id, mat_id, is_female, and is_case or quant_pheno; "0" ids and sex are missing."""
    f = F.split(F.trim("value"), delimiter)
    at = lambda i: F.get(f, F.lit(i))
    none = lambda i: F.when(~at(i).isin("0", missing), at(i))
    sex = F.when(at(4) == "2", True).when(at(4) == "1", False)
    pheno = F.when(~at(5).isin(missing, "-9"), at(5)).try_cast("double") if quant_pheno else F.when(at(5) == "2", True).when(at(5) == "1", False)
    return Table(spark.read.text(path).where("trim(value) <> ''").select(at(1).alias("id"), none(0).alias("fam_id"), none(2).alias("pat_id"), none(3).alias("mat_id"), sex.alias("is_female"), pheno.alias("quant_pheno" if quant_pheno else "is_case")), "id")


def import_gtf(spark: SparkSession, path: str) -> Table:
    """Features of a GTF file: fields by name, 1-based intervals with both ends, and attributes as a map."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    dot = lambda i: F.when(at(i) != ".", at(i))
    pairs = F.transform(F.regexp_extract_all(at(8), F.lit(r'(\w+) "?([^";]*)"?;'), 0), lambda p: F.struct(F.regexp_extract(p, r'^(\w+)', 1).alias("key"), F.regexp_extract(p, r'^\w+ "?([^";]*)"?;', 1).alias("value")))
    entries = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.create_map(p["key"], p["value"]))))
    df = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    return Table(df.select(interval(at(3).cast("int"), at(4).cast("int"), True, True).alias("interval"), at(0).alias("contig"), at(1).alias("source"), at(2).alias("feature"), dot(5).cast("double").alias("score"), dot(6).alias("strand"), dot(7).cast("int").alias("frame"), entries.alias("attributes")), "interval")


def grep(spark: SparkSession, pattern: str, paths, max_count: int = 100) -> list[str]:
    """Lines that match, at most max_count."""
    return [r[0] for r in spark.read.text(paths).where(F.col("value").rlike(pattern)).take(max_count)]


def as_text(f: T.StructField, missing: str) -> Column:
    c = F.col(f"`{f.name}`")
    text = F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
    return F.coalesce(text, F.lit(missing)).alias(f.name)


def export_table(table: Table, path: str, delimiter: str = "\t", header: bool = True, missing: str = "NA", overwrite: bool = False) -> None:
    """Text in key order, a file for each partition; compound values as JSON."""
    df = table.sorted()
    df = df.select(*[as_text(f, missing) for f in df.schema.fields])
    df.write.mode("overwrite" if overwrite else "errorifexists").options(sep=delimiter, header=header, quote="", emptyValue="").csv(path)


def export_entries_by_col(matrix: MatrixTable, path: str, overwrite: bool = False) -> None:
    """A folder for each column with its entries."""
    matrix.full_entries().write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*matrix.col_key).option("header", True).option("sep", "\t").csv(path)
