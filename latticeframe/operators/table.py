"""Keyed tables: a DataFrame, the names of its key fields, and table-level global values.

Rows have no physical order until one is asked for; operations that observe order (head, tail, add_index, scans,
collect) sort by the key then. Joins, distinct, index, collect_by_key and union act on the key. Missing key values
never match in joins and form a group of their own in aggregations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticeframe.functions.aggregators import Nested
from latticeframe.plans.materialize import materialize
from latticeframe.semantics import asc, col

INDEX_LIMIT = 1 << 40


class Lookup:
    """What Table.index gives: annotate and select turn it into a join. lookup["field"] takes one field."""

    def __init__(self, other: Table, keys: list[Column], all_matches: bool, field: str | None = None, interval: bool = False):
        self.other, self.keys, self.all_matches, self.field, self.interval = other, keys, all_matches, field, interval

    def __getitem__(self, field: str) -> Lookup:
        return Lookup(self.other, self.keys, self.all_matches, field, self.interval)

    def attach(self, df: DataFrame, name: str) -> DataFrame:
        from latticeframe.operators.intervals import interval_lookup

        value = self.other.value_names()
        packed = F.struct(*[F.col(f"`{v}`") for v in value])
        if self.interval:
            found = interval_lookup(df, self.keys[0], self.other.df, self.other.key[0], packed, name, self.all_matches)
            return found.withColumn(name, F.col(f"`{name}`.`{self.field}`")) if self.field else found
        names = [f"__k{i}" for i in range(len(self.keys))]
        right = self.other.df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(self.other.key, names, strict=False)], packed.alias(name))
        by = right.groupBy(*names)
        right = by.agg(F.sort_array(F.collect_list(name)).alias(name)) if self.all_matches else by.agg(F.min(name).alias(name))
        rest = df.columns
        rest = [c for c in rest if c != name]
        left = df.select(*[F.col(f"`{c}`") for c in rest], *[k.alias(f"__l{i}") for i, k in enumerate(self.keys)])
        joined = left.join(right, reduce(lambda a, b: a & b, [F.col(f"__l{i}") == F.col(n) for i, n in enumerate(names)]), "left")
        value = F.col(f"`{name}`.`{self.field}`") if self.field else F.col(f"`{name}`")
        return joined.select(*[F.col(f"`{c}`") for c in rest], value.alias(name))


class Scan:
    """An exclusive running aggregate in key order: the aggregate over all rows before."""

    def __init__(self, kind: str, value: Column):
        self.kind, self.value = kind, value


SCANS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column], object]] = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "count": (F.sum, lambda a, b: a + b, 0),
    "min": (F.min, F.least, None),
    "max": (F.max, F.greatest, None),
    "product": (F.product, lambda a, b: a * b, 1.0),
    "any": (F.bool_or, lambda a, b: a | b, False),
    "all": (F.bool_and, lambda a, b: a & b, True),
}


class scan:  # noqa: N801
    """Builders of Scan values for annotate."""

    sum = staticmethod(lambda x: Scan("sum", col(x)))
    count = staticmethod(lambda: Scan("count", F.lit(1)))
    count_where = staticmethod(lambda p: Scan("count", F.when(col(p), 1).otherwise(0)))
    min = staticmethod(lambda x: Scan("min", col(x)))
    max = staticmethod(lambda x: Scan("max", col(x)))
    product = staticmethod(lambda x: Scan("product", col(x)))
    any = staticmethod(lambda x: Scan("any", col(x)))
    all = staticmethod(lambda x: Scan("all", col(x)))
    mean = staticmethod(lambda x: Scan("mean", col(x).cast("double")))


def aggregate(df: DataFrame, keys: list[str], named: dict) -> DataFrame:
    """One row for each key: plain aggregates in one pass, each Nested one by a two-level aggregation, joined on the keys."""
    plain = {n: a for n, a in named.items() if not isinstance(a, Nested)}
    parts = [df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[a.alias(n) for n, a in plain.items()])] if plain else []
    for name, a in named.items():
        if not isinstance(a, Nested):
            continue
        k = [F.col(f"`{x}`") for x in keys]
        if a.kind == "group_by":
            inner = df.select("*", a.over.alias("__g")).groupBy(*k, "__g").agg(a.inner.alias("__v"))
            rows = F.sort_array(F.collect_list(F.struct(F.col("__g").alias("key"), F.col("__v").alias("value"))))
            out = inner.groupBy(*k).agg(rows.alias(name))
        elif a.kind == "explode":
            out = df.select(*k, F.explode(a.over).alias("__e")).groupBy(*k).agg(a.inner(F.col("__e")).alias(name))
        else:
            inner = df.select(*k, F.posexplode(a.over).alias("__p", "__e")).groupBy(*k, "__p").agg(a.inner(F.col("__e")).alias("__v"))
            out = inner.groupBy(*k).agg(F.transform(F.sort_array(F.collect_list(F.struct("__p", "__v"))), lambda s: s["__v"]).alias(name))
        if a.finish:
            out = out.withColumn(name, a.finish(F.col(f"`{name}`")))
        parts.append(out)

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        if not keys:
            return left.crossJoin(right)  # one row each
        renamed = right.select(*[F.col(f"`{k}`").alias(f"__r{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in right.columns if c not in keys])
        on = reduce(lambda x, y: x & y, [F.col(f"`{k}`").eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)])
        return left.join(renamed, on, "left").drop(*[f"__r{i}" for i in range(len(keys))])

    if plain or not keys:
        first = parts[0]
    else:
        first = df.select(*[F.col(f"`{k}`") for k in keys]).distinct()
        parts = [first, *parts]
    out = reduce(both, parts[1:], first)
    return out.select(*[F.col(f"`{c}`") for c in [*keys, *named]])


class GroupedTable:
    def __init__(self, table: Table, named: dict[str, Column]):
        self.table, self.named, self.partitions = table, named, None

    def partition_hint(self, n: int) -> GroupedTable:
        self.partitions = n
        return self

    def aggregate(self, **named) -> Table:
        """One row for each distinct key; a missing key is a group of its own."""
        values = [F.col(f"`{c}`") for c in self.table.df.columns if c not in self.named]
        df = self.table.df.select(*[v.alias(k) for k, v in self.named.items()], *values)
        out = aggregate(df, list(self.named), named)
        out = out.repartition(self.partitions, *self.named) if self.partitions else out
        return Table(out, list(self.named), self.table.globals)


class Table:
    def __init__(self, df: DataFrame, key=(), globals: dict | None = None):  # noqa: A002
        self.df, self.key, self.globals = df, tuple([key] if isinstance(key, str) else key), dict(globals or {})
        for k in self.key:
            if k not in df.columns:
                raise ValueError(f"no field {k}")

    # construction

    @staticmethod
    def parallelize(spark: SparkSession, rows, schema=None, key=(), globals: dict | None = None, n_partitions: int | None = None) -> Table:  # noqa: A002
        df = spark.createDataFrame(rows, schema)
        return Table(df.repartition(n_partitions) if n_partitions else df, key, globals)

    @staticmethod
    def range(spark: SparkSession, n: int, n_partitions: int | None = None) -> Table:
        return Table(spark.range(0, n, 1, n_partitions).select(F.col("id").cast("int").alias("idx")), "idx")

    from_spark = staticmethod(lambda df, key=(): Table(df, key))
    from_pandas = staticmethod(lambda spark, pdf, key=(): Table(spark.createDataFrame(pdf), key))

    # fields

    def __getitem__(self, item):
        if isinstance(item, str):
            return F.col(f"`{item}`")
        return self.index(*(item if isinstance(item, tuple) else (item,)))

    def value_names(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.key]

    @property
    def row(self) -> Column:
        return F.struct(*[F.col(f"`{c}`") for c in self.df.columns])

    @property
    def row_value(self) -> Column:
        return F.struct(*[F.col(f"`{c}`") for c in self.value_names()])

    @property
    def key_struct(self) -> Column:
        return F.struct(*[F.col(f"`{c}`") for c in self.key])

    def with_df(self, df: DataFrame, key=None) -> Table:
        return Table(df, self.key if key is None else key, self.globals)

    # globals

    def annotate_globals(self, **named) -> Table:
        return Table(self.df, self.key, {**self.globals, **named})

    def select_globals(self, *names: str, **named) -> Table:
        return Table(self.df, self.key, {**{n: self.globals[n] for n in names}, **named})

    def transmute_globals(self, uses=(), **named) -> Table:
        return Table(self.df, self.key, {**{k: v for k, v in self.globals.items() if k not in uses}, **named})

    def index_globals(self) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in self.globals.items()])

    def g(self, name: str) -> Column:
        """A global value as a column."""
        return F.lit(self.globals[name])

    # key and order

    def key_by(self, *names: str, **named) -> Table:
        df = self.df.withColumns({k: col(v) for k, v in named.items()}) if named else self.df
        key = [*names, *named]
        return self.with_df(df.select(*[F.col(f"`{c}`") for c in [*key, *[c for c in df.columns if c not in key]]]), key)

    def sorted(self) -> DataFrame:
        """Rows in key order, missing values last."""
        return self.df.orderBy(*[asc(k) for k in self.key]) if self.key else self.df

    def order_by(self, *by) -> Table:
        """A total order; the table has no key afterwards."""
        return self.with_df(self.df.orderBy(*[b if isinstance(b, Column) and re.search(r" (ASC|DESC) NULLS (FIRST|LAST)\W*$", str(b)) else asc(b) for b in by]), ())

    # row fields

    def annotate(self, **named) -> Table:
        """Adds or replaces fields, all computed from the fields as they were. Values: columns, names, Lookup, Scan, or functions of the table."""
        clash = set(named) & set(self.key)
        if clash:
            raise ValueError(f"key fields cannot be assigned: {clash}")
        values = {k: v(self) if callable(v) and not isinstance(v, Column) else v for k, v in named.items()}
        df = self.df
        for k, v in values.items():
            if isinstance(v, Lookup):
                df = v.attach(df, f"__{k}")
        plain = {k: F.col(f"`__{k}`") if isinstance(v, Lookup) else col(v) for k, v in values.items() if not isinstance(v, Scan)}
        df = df.withColumns(plain).drop(*[f"__{k}" for k, v in values.items() if isinstance(v, Lookup)]) if plain else df
        scans = {k: v for k, v in values.items() if isinstance(v, Scan)}
        return self.with_df(running(df, self.key, scans) if scans else df)

    def select(self, *names, **named) -> Table:
        """Key fields always stay, and come first."""
        t = self.annotate(**named) if named else self
        keep = [*self.key, *[n for n in [*names, *named] if n not in self.key]]
        return self.with_df(t.df.select(*[F.col(f"`{n}`") for n in keep]))

    def transmute(self, uses=(), **named) -> Table:
        """annotate, then drop the fields in uses (never key fields or new ones)."""
        return self.annotate(**named).drop(*[u for u in uses if u not in self.key and u not in named])

    def drop(self, *names: str) -> Table:
        if set(names) & set(self.key):
            raise ValueError("key fields cannot be dropped")
        return Table(self.df.drop(*names), self.key, {k: v for k, v in self.globals.items() if k not in names})

    def rename(self, mapping: dict[str, str]) -> Table:
        df = self.df.withColumnsRenamed({k: v for k, v in mapping.items() if k in self.df.columns})
        return Table(df, [mapping.get(k, k) for k in self.key], {mapping.get(k, k): v for k, v in self.globals.items()})

    def filter(self, condition, keep: bool = True) -> Table:
        """Rows where the condition is True, or False with keep=False; rows where it is missing go either way."""
        p = col(condition(self) if callable(condition) and not isinstance(condition, Column) else condition)
        return self.with_df(self.df.where(p if keep else ~p))

    def explode(self, field: str, name: str | None = None) -> Table:
        """A row for each element of an array, or of a field of structs as in "a.b"; empty and missing arrays have none."""
        top, _, inner = field.partition(".")
        if top in self.key:
            raise ValueError("a key field cannot be exploded")
        if not inner:
            target = name or field
            df = self.df.select("*", F.explode(F.col(f"`{field}`")).alias("__e"))
            df = df.drop(field) if name else df
            return self.with_df(df.withColumn(target, F.col("__e")).drop("__e") if name else df.withColumn(field, F.col("__e")).drop("__e"))
        df = self.df.select("*", F.explode(F.col(field)).alias("__e"))
        return self.with_df(df.withColumn(top, F.col(top).withField(inner, F.col("__e"))).drop("__e"))

    def flatten(self) -> Table:
        """Structs become fields with dotted names; the table has no key afterwards."""

        def walk(path: str, name: str, kind) -> list[Column]:
            if isinstance(kind, T.StructType):
                return [c for f in kind.fields for c in walk(f"{path}.`{f.name}`", f"{name}.{f.name}", f.dataType)]
            return [F.col(path).alias(name)]

        return self.with_df(self.df.select(*[c for f in self.df.schema.fields for c in walk(f"`{f.name}`", f.name, f.dataType)]), ())

    def expand_types(self) -> Table:
        """flatten, with maps as arrays of entries."""
        flat = self.flatten()
        maps = {f.name: F.map_entries(F.col(f"`{f.name}`")) for f in flat.df.schema.fields if isinstance(f.dataType, T.MapType)}
        return flat.with_df(flat.df.withColumns(maps)) if maps else flat

    def add_index(self, name: str = "idx") -> Table:
        """The row's 0-based place in key order."""
        return self.annotate(**{name: scan.count()})

    # aggregation

    def group_by(self, *names: str, **named) -> GroupedTable:
        return GroupedTable(self, {**{n: F.col(f"`{n}`") for n in names}, **{k: col(v) for k, v in named.items()}})

    def aggregate_df(self, **named) -> DataFrame:
        return aggregate(self.df, [], named)

    def aggregate(self, aggregation):
        """The value of one aggregation over the whole table."""
        return aggregate(self.df, [], {"value": aggregation}).first()["value"]

    def count(self) -> int:
        return self.df.count()

    def all(self, condition) -> bool:
        return self.aggregate(F.coalesce(F.bool_and(F.coalesce(col(condition), F.lit(False))), F.lit(True)))

    def any(self, condition) -> bool:
        return self.aggregate(F.coalesce(F.bool_or(col(condition)), F.lit(False)))

    def collect_by_key(self, name: str = "values") -> Table:
        """One row for each key with the array of its rows' values, in order."""
        rows = F.sort_array(F.collect_list(self.row_value))
        return self.with_df(self.df.groupBy(*self.key).agg(rows.alias(name)))

    def distinct(self) -> Table:
        """One row for each key: the one with the smallest values."""
        values = self.value_names()
        if not values:
            return self.with_df(self.df.distinct())
        kinds = dict(self.df.dtypes)
        if any("map<" in kinds[v] for v in values):
            return self.with_df(self.df.dropDuplicates(list(self.key)))
        df = self.df.groupBy(*self.key).agg(F.min(self.row_value).alias("__v"))
        return self.with_df(df.select(*[F.col(f"`{k}`") for k in self.key], *[F.col(f"__v.`{v}`").alias(v) for v in values]))

    def summarize(self) -> DataFrame:
        """A row for each field: name, rows, missing, and for numbers min, max, mean and standard deviation."""
        parts = []
        for f in self.df.schema.fields:
            x = F.col(f"`{f.name}`")
            number = x.cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
            parts.append(F.struct(F.lit(f.name).alias("field"), F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("missing"), F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"), F.stddev_pop(number).alias("stdev")))
        return self.df.agg(F.array(*parts).alias("x")).select(F.inline("x"))

    # joins

    def index(self, *exprs, all_matches: bool = False) -> Lookup:
        """The value of this table's row for a key, for use in another table's annotate; with a key of intervals, of one that holds the point."""
        kind = self.df.schema[self.key[0]].dataType
        interval = isinstance(kind, T.StructType) and {"start", "end"} <= set(kind.names)
        return Lookup(self, [col(e) for e in exprs], all_matches, interval=interval)

    def join(self, right: Table, how: str = "inner") -> Table:
        """An equi join on the keys by position: inner, left, right or outer. Missing keys never match; the right key's names go, clashing names get a suffix."""
        if len(self.key) != len(right.key):
            raise ValueError("keys differ in length")
        kinds, others = dict(self.df.dtypes), dict(right.df.dtypes)
        if [kinds[k] for k in self.key] != [others[k] for k in right.key]:
            raise ValueError("key types differ")
        taken, names = {*self.df.columns}, {}
        for v in right.value_names():
            n, i = v, 0
            while n in taken:
                i += 1
                n = f"{v}_{i}"
            taken.add(n)
            names[v] = n
        r = right.df.select(*[F.col(f"`{k}`").alias(f"__r{i}") for i, k in enumerate(right.key)], *[F.col(f"`{v}`").alias(n) for v, n in names.items()])
        on = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"__r{i}") for i, k in enumerate(self.key)])
        out = self.df.join(r, on, {"outer": "full"}.get(how, how))
        key = [F.coalesce(F.col(f"`{k}`"), F.col(f"__r{i}")).alias(k) if how in ("right", "outer") else F.col(f"`{k}`") for i, k in enumerate(self.key)]
        out = out.select(*key, *[F.col(f"`{c}`") for c in [*self.value_names(), *names.values()]])
        return Table(out, self.key, {**self.globals, **{k if k not in self.globals else f"{k}_1": v for k, v in right.globals.items()}})

    def filtering_join(self, other: Table, how: str) -> Table:
        keys = self.key[: len(other.key)]
        r = other.df.select(*[F.col(f"`{k}`").alias(f"__r{i}") for i, k in enumerate(other.key)])
        return self.with_df(self.df.join(r, reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"__r{i}") for i, k in enumerate(keys)]), how))

    def semi_join(self, other: Table) -> Table:
        """Rows whose key, or its first fields, is a key of other."""
        return self.filtering_join(other, "left_semi")

    def anti_join(self, other: Table) -> Table:
        """Rows whose key is none of other's; rows with missing keys stay."""
        return self.filtering_join(other, "left_anti")

    def union(self, *others: Table, unify: bool = False) -> Table:
        """All rows; with unify, fields that a table lacks are missing and numbers widen. Globals are the first table's."""
        if any(o.key != self.key for o in others):
            raise ValueError("keys differ")
        if not unify and any(dict(o.df.dtypes) != dict(self.df.dtypes) for o in others):
            raise ValueError("fields differ")
        return self.with_df(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=unify), [o.df for o in others], self.df))

    @staticmethod
    def multi_way_zip_join(tables: list[Table], data_field: str, global_field: str) -> Table:
        """For each key of any table the array of the tables' values, missing where a table lacks the key."""
        key = tables[0].key
        tagged = [t.df.select(*key, F.lit(i).alias("__i"), t.row_value.alias("__v")) for i, t in enumerate(tables)]
        rows = reduce(DataFrame.unionByName, tagged).groupBy(*key)
        out = rows.agg(F.array(*[F.max(F.when(F.col("__i") == i, F.col("__v"))) for i in range(len(tables))]).alias(data_field))
        return Table(out, key, {global_field: [t.globals for t in tables]})

    # rows by place and chance

    def head(self, n: int) -> Table:
        return self.with_df(self.sorted().limit(n))

    def tail(self, n: int) -> Table:
        return self.with_df(self.df.orderBy(*[F.col(f"`{k}`").desc_nulls_first() for k in self.key]).limit(n))

    def take(self, n: int) -> list:
        return self.sorted().take(n)

    def collect(self) -> list:
        return self.sorted().collect()

    def sample(self, p: float, seed: int | None = None) -> Table:
        return self.with_df(self.df.sample(False, p, seed))

    def repartition(self, n: int, shuffle: bool = True) -> Table:
        if not shuffle:
            return self.with_df(self.df.coalesce(n))
        return self.with_df(self.df.repartitionByRange(n, *[asc(k) for k in self.key]) if self.key else self.df.repartition(n))

    def naive_coalesce(self, n: int) -> Table:
        return self.with_df(self.df.coalesce(n))

    def n_partitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    # reshaping

    def to_matrix_table(self, row_key: list[str], col_key: list[str], row_fields=(), col_fields=()):
        """The long table as a matrix with an entry for each row; other fields become entry fields."""
        from latticeframe.operators.matrix import MatrixTable

        row_fields, col_fields = list(row_fields), list(col_fields)
        entry = [c for c in self.df.columns if c not in {*row_key, *col_key, *row_fields, *col_fields}]
        take = lambda keys, fields: self.df.groupBy(*keys).agg(*[F.min(F.col(f"`{f}`")).alias(f) for f in fields]) if fields else self.df.select(*keys).distinct()
        return MatrixTable(take(row_key, row_fields), take(col_key, col_fields), self.df.select(*row_key, *col_key, *entry), row_key, col_key, self.globals)

    def to_matrix_table_row_major(self, columns: list[str], entry_field: str = "x", col_field: str = "col"):
        """Wide columns as the columns of a matrix."""
        from latticeframe.operators.matrix import MatrixTable

        long = self.df.select(*self.key, F.explode(F.array(*[F.struct(F.lit(c).alias(col_field), F.col(f"`{c}`").alias(entry_field)) for c in columns])).alias("__e")).select(*self.key, "__e.*")
        cols = self.df.sparkSession.createDataFrame([(c,) for c in columns], f"`{col_field}` string")
        return MatrixTable(self.df.drop(*columns), cols, long, self.key, [col_field], self.globals)

    # actions, storage

    def to_spark(self, flatten: bool = True) -> DataFrame:
        return self.flatten().df if flatten else self.df

    def to_pandas(self, flatten: bool = True):
        return (self.flatten().df if flatten else self.df).toPandas()

    def show(self, n: int = 10, truncate: bool = True) -> None:
        self.sorted().show(n, truncate)

    def describe(self) -> str:
        lines = [f"  {f.name}: {f.dataType.simpleString()}" for f in self.df.schema.fields]
        return "\n".join(["Global fields: " + json.dumps({k: type(v).__name__ for k, v in self.globals.items()}), "Row fields:", *lines, f"Key: {list(self.key)}"])

    def cache(self) -> Table:
        self.df.cache()
        return self

    def persist(self, level: str = "MEMORY_AND_DISK") -> Table:
        self.df.persist(getattr(StorageLevel, level))
        return self

    def unpersist(self) -> Table:
        self.df.unpersist()
        return self

    def write(self, path: str, overwrite: bool = False) -> None:
        from latticeframe.sources.native import write_table

        write_table(self, path, overwrite)

    def checkpoint(self, path: str, overwrite: bool = False) -> Table:
        from latticeframe.sources.native import read_table

        self.write(path, overwrite)
        return read_table(self.df.sparkSession, path)

    def write_many(self, path: str, fields: list[str], overwrite: bool = False) -> None:
        """Each field, with the key, as a table of its own."""
        self.df.persist()
        for f in fields:
            self.select(f).write(f"{path}/{f}", overwrite)
        self.df.unpersist()

    def export(self, path: str, delimiter: str = "\t", header: bool = True) -> None:
        from latticeframe.sources.text import export_table

        export_table(self, path, delimiter, header)


def running(df: DataFrame, key, scans: dict[str, Scan]) -> DataFrame:
    """Exclusive running aggregates in key order, rows with equal keys in order of their values.

    Rows are range-partitioned and sorted, and written once. Each partition runs its own totals; what all partitions
    before it add up to, a row for each partition, is joined to it. No task sees more than its partition.
    """
    values = [c for c in df.columns if c not in key and "map<" not in dict(df.dtypes)[c]]
    by = [asc(k) for k in [*key, *values]]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    for name, s in scans.items():
        placed = placed.withColumn(f"__v_{name}", s.value)
    placed = placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed)
    from pyspark.sql import Window as W

    inside = W.partitionBy("__part").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    steps = {}
    for name, s in scans.items():
        v = F.col(f"`__v_{name}`")
        steps |= {f"{name}__s": ("sum", v), f"{name}__n": ("sum", F.when(v.isNotNull(), 1).otherwise(0))} if s.kind == "mean" else {name: (s.kind, v)}
    totals = placed.groupBy("__part").agg(*[SCANS[k][0](v).alias(f"__t_{n}") for n, (k, v) in steps.items()])
    totals = totals.select(F.col("__part").alias("__q"), *[SCANS[k][0](F.col(f"`__t_{n}`")).over(before).alias(f"__b_{n}") for n, (k, _) in steps.items()])
    joined = placed.join(F.broadcast(totals), F.col("__part") == F.col("__q"))

    def value(n: str, kind: str, v: Column) -> Column:
        agg, combine, zero = SCANS[kind]
        own, earlier = agg(v).over(inside), F.col(f"`__b_{n}`")
        if zero is None:
            return combine(own, earlier)
        return combine(F.coalesce(own, F.lit(zero)), F.coalesce(earlier, F.lit(zero)))

    out = {n: value(n, k, v) for n, (k, v) in steps.items()}
    result = {}
    for name, s in scans.items():
        if s.kind == "mean":
            n = out[f"{name}__n"]
            result[name] = F.when(n == 0, F.lit(float("nan"))).otherwise(out[f"{name}__s"] / F.when(n > 0, n))
        else:
            result[name] = out[name]
    keep = [c for c in df.columns if c not in result]
    return joined.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(n) for n, v in result.items()])
