"""Variant call text files (VCF), read and written as matrix tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from latticeframe.functions import genetics as g
from latticeframe.operators.matrix import MatrixTable

KINDS = {"Integer": "int", "Float": "double", "String": "string", "Character": "string", "Flag": "boolean"}


def header(spark: SparkSession, path: str) -> tuple[dict[str, dict[str, tuple[str, str]]], list[str]]:
    """INFO and FORMAT fields as (number, type), and sample names, from the lines that begin with #."""
    lines = [r[0] for r in spark.read.text(path).where("value like '#%'").collect()]
    fields: dict[str, dict[str, tuple[str, str]]] = {"INFO": {}, "FORMAT": {}}
    samples: list[str] = []
    for line in lines:
        m = re.match(r"##(INFO|FORMAT)=<ID=([^,]+),Number=([^,]+),Type=([^,]+),", line)
        if m:
            fields[m[1]][m[2]] = (m[3], m[4])
        elif line.startswith("#CHROM"):
            samples = line.split("\t")[9:]
    return fields, samples


def value(text: Column, number: str, kind: str) -> Column:
    """A field's value; "." is missing."""
    given = F.when(text != ".", text)
    if number in ("0", "1"):
        return F.lit(True) if kind == "Flag" else given.try_cast(KINDS[kind])
    return F.transform(F.split(given, ","), lambda x: F.when(x != ".", x).try_cast(KINDS[kind]))


def import_vcf(spark: SparkSession, path: str, drop_samples: bool = False, entry_fields: list[str] | None = None) -> MatrixTable:
    """Rows keyed by locus and alleles with rsid, qual, filters and info; columns keyed by s; entries with GT as a call and the other FORMAT fields.

    An entry whose call is missing is present with a missing GT.
    """
    fields, samples = header(spark, path)
    lines = spark.read.text(path).where("value not like '#%' and trim(value) <> ''")
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    key = [F.struct(at(0).alias("contig"), at(1).cast("int").alias("position")).alias("locus"), F.concat(F.array(at(3)), F.filter(F.split(at(4), ","), lambda x: x != ".")).alias("alleles")]
    pairs = F.str_to_map(at(7), F.lit(";"), F.lit("="))
    info = [(F.when(F.map_contains_key(pairs, n), True).otherwise(False) if t == "Flag" else value(F.try_element_at(pairs, F.lit(n)), k, t)).alias(n) for n, (k, t) in fields["INFO"].items()]
    filters = F.when(at(6) == ".", None).when(at(6) == "PASS", F.array().cast("array<string>")).otherwise(F.array_sort(F.split(at(6), ";")))
    rows = lines.select(*key, F.when(at(2) != ".", at(2)).alias("rsid"), F.when(at(5) != ".", at(5)).cast("double").alias("qual"), filters.alias("filters"), *([F.struct(*info).alias("info")] if info else []))
    cols = spark.createDataFrame([(s,) for s in ([] if drop_samples else samples)], "s string")
    names = [n for n in fields["FORMAT"] if entry_fields is None or n in entry_fields]
    places = F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0)))
    long = lines.select(*key, F.split(at(8), ":").alias("__names"), F.posexplode(places).alias("__i", "__v")).withColumn("__parts", F.split("__v", ":"))
    sample = F.get(F.array(*[F.lit(s) for s in samples]), F.col("__i")) if samples else F.lit(None).cast("string")

    def field(name: str) -> Column:
        raw = F.get(F.col("__parts"), F.nullif(F.array_position("__names", name), F.lit(0)).cast("int") - 1)
        return g.parse_call(raw) if name == "GT" else value(raw, *fields["FORMAT"][name])

    entries = long.select("locus", "alleles", sample.alias("s"), *[field(n).alias(n) for n in names])
    return MatrixTable(rows, cols, entries if not drop_samples else entries.where(F.lit(False)), ["locus", "alleles"], ["s"])


def export_vcf(matrix: MatrixTable, path: str) -> None:
    """Sites and GT entries in order of loci, a file for each partition, each with the column header."""
    samples = [r[0] for r in matrix.cols_df.select(*matrix.col_key).orderBy(*matrix.col_key).collect()]
    calls = matrix.entries_df.groupBy("locus", "alleles").agg(F.map_from_entries(F.collect_list(F.struct(F.col(matrix.col_key[0]), F.coalesce(g.call_text("GT"), F.lit("./."))))).alias("__c"))
    rows = matrix.rows_df.join(calls, ["locus", "alleles"], "left")
    have = rows.columns
    opt = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(".")) if n in have else F.lit(".")
    filters = F.when(F.size("filters") == 0, "PASS").when(F.col("filters").isNull(), ".").otherwise(F.array_join("filters", ";")) if "filters" in have else F.lit(".")
    alts = F.coalesce(F.nullif(F.array_join(F.slice("alleles", 2, 1_000), ","), F.lit("")), F.lit("."))
    cells = [F.coalesce(F.try_element_at(F.col("__c"), F.lit(s)), F.lit("./.")).alias(s) for s in samples]
    out = rows.orderBy("locus").select(F.col("locus.contig").alias("#CHROM"), F.col("locus.position").cast("string").alias("POS"), opt("rsid").alias("ID"), F.get("alleles", F.lit(0)).alias("REF"), alts.alias("ALT"), opt("qual").alias("QUAL"), filters.alias("FILTER"), F.lit(".").alias("INFO"), F.lit("GT").alias("FORMAT"), *cells)
    out.write.options(sep="\t", header=True, quote="", emptyValue="").csv(path)
