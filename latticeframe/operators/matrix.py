"""Matrix tables: rows, columns and entries as three DataFrames joined by the row key and the column key.

Entries are in long form, a row for each present entry; a filtered entry is an absent row. Axis keys identify rows and
columns; entries carry both keys, so that a row-wise aggregation is one groupBy on the row key and a column-wise one on
the column key.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.operators.table import Lookup, Table, aggregate
from latticeframe.semantics import col


def names(columns) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


class GroupedMatrixTable:
    """A matrix whose rows or columns are grouped; aggregations of the grouped axis and of entries, then result()."""

    def __init__(self, matrix: MatrixTable, axis: str, named: dict[str, Column], axis_aggs: dict | None = None, entry_aggs: dict | None = None):
        self.matrix, self.axis, self.named, self.axis_aggs, self.entry_aggs = matrix, axis, named, axis_aggs or {}, entry_aggs or {}

    def aggregate_axis(self, **named) -> GroupedMatrixTable:
        return GroupedMatrixTable(self.matrix, self.axis, self.named, {**self.axis_aggs, **named}, self.entry_aggs)

    aggregate_rows = aggregate_cols = aggregate_axis

    def aggregate_entries(self, **named) -> GroupedMatrixTable:
        return GroupedMatrixTable(self.matrix, self.axis, self.named, self.axis_aggs, {**self.entry_aggs, **named})

    def result(self) -> MatrixTable:
        m, rows = self.matrix, self.axis == "rows"
        side, key, other = (m.rows_df, m.row_key, m.col_key) if rows else (m.cols_df, m.col_key, m.row_key)
        values = [c for c in side.columns if c not in self.named]
        grouped = side.select(*[v.alias(k) for k, v in self.named.items()], *names(values))
        groups = list(self.named)
        axis = aggregate(grouped, groups, self.axis_aggs) if self.axis_aggs else grouped.select(*groups).distinct()
        to = side.select(*[F.col(f"`{k}`").alias(f"__k_{k}") for k in key], *[v.alias(f"__g_{k}") for k, v in self.named.items()])
        on = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"`__k_{k}`") for k in key])
        drop = [c for c in m.entries_df.columns if c in groups and c not in key]
        entries = m.entries_df.drop(*drop).join(to, on).drop(*[c for c in groups if c in key])
        entries = entries.withColumnsRenamed({f"__g_{g}": g for g in groups})
        done = aggregate(entries, [*groups, *other], self.entry_aggs) if self.entry_aggs else entries.select(*names([*groups, *other])).distinct()
        if rows:
            return MatrixTable(axis, m.cols_df, done, groups, m.col_key, m.globals)
        return MatrixTable(m.rows_df, axis, done, m.row_key, groups, m.globals)

    def aggregate(self, **named) -> MatrixTable:
        return self.aggregate_entries(**named).result()


class MatrixTable:
    def __init__(self, rows: DataFrame, cols: DataFrame, entries: DataFrame, row_key, col_key, globals: dict | None = None):  # noqa: A002
        self.rows_df, self.cols_df, self.entries_df = rows, cols, entries
        self.row_key, self.col_key, self.globals = tuple(row_key), tuple(col_key), dict(globals or {})

    @staticmethod
    def range(spark, n_rows: int, n_cols: int) -> MatrixTable:
        r = spark.range(n_rows).select(F.col("id").cast("int").alias("row_idx"))
        c = spark.range(n_cols).select(F.col("id").cast("int").alias("col_idx"))
        entries = r.select("row_idx", F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("col_idx")) if n_cols else r.crossJoin(c)
        return MatrixTable(r, c, entries, ["row_idx"], ["col_idx"])

    @staticmethod
    def from_parts(rows: Table, cols: Table, entries: DataFrame, globals: dict | None = None) -> MatrixTable:  # noqa: A002
        return MatrixTable(rows.df, cols.df, entries, rows.key, cols.key, globals)

    @staticmethod
    def from_rows_table(table: Table) -> MatrixTable:
        """A matrix without columns."""
        cols = table.df.sparkSession.createDataFrame([], "col_idx int")
        return MatrixTable(table.df, cols, table.df.select(*table.key).crossJoin(cols), table.key, ["col_idx"], table.globals)

    def new(self, **parts) -> MatrixTable:
        now = {"rows": self.rows_df, "cols": self.cols_df, "entries": self.entries_df, "row_key": self.row_key, "col_key": self.col_key, "globals": self.globals}
        return MatrixTable(**{**now, **parts})

    # the three tables

    def rows(self) -> Table:
        return Table(self.rows_df, self.row_key, self.globals)

    def cols(self) -> Table:
        return Table(self.cols_df, self.col_key, self.globals)

    def globals_table(self, spark) -> Table:
        return Table(spark.range(1).select(*[F.lit(v).alias(k) for k, v in self.globals.items()]))

    def full_entries(self) -> DataFrame:
        """Entries with the fields of their rows and columns. The columns' table is joined like any other; Catalyst broadcasts it when its size is known to be small."""
        return self.entries_df.join(self.rows_df, list(self.row_key)).join(self.cols_df, list(self.col_key))

    def entries(self) -> Table:
        return Table(self.full_entries(), [*self.row_key, *self.col_key], self.globals)

    def entry_names(self) -> list[str]:
        return [c for c in self.entries_df.columns if c not in {*self.row_key, *self.col_key}]

    # annotation

    def attach(self, side: DataFrame, key, plain: dict, aggs: dict) -> DataFrame:
        side = Table(side, key).annotate(**plain).df if plain else side
        if not aggs:
            return side
        done = aggregate(self.full_entries(), list(key), aggs)
        keep = [c for c in side.columns if c not in aggs]
        return side.select(*names(keep)).join(done, list(key), "left")

    def annotate_rows(self, aggs: dict | None = None, **named) -> MatrixTable:
        """Row fields, lookups in other tables among them; those in aggs are aggregations over the row's entries (a row without entries gets missing values)."""
        return self.new(rows=self.attach(self.rows_df, self.row_key, named, aggs or {}))

    def annotate_cols(self, aggs: dict | None = None, **named) -> MatrixTable:
        return self.new(cols=self.attach(self.cols_df, self.col_key, named, aggs or {}))

    def annotate_entries(self, **named) -> MatrixTable:
        """Entry fields, from entry, row and column fields and lookups in other tables."""
        entries = Table(self.with_axes(named), [*self.row_key, *self.col_key]).annotate(**named).df
        keep = [*self.row_key, *self.col_key, *[c for c in self.entry_names() if c not in named], *named]
        return self.new(entries=entries.select(*names(keep)))

    def with_axes(self, named) -> DataFrame:
        """Entries joined with the axes, each only if an expression may use it."""
        used = [k for v in named.values() for k in (v.keys if isinstance(v, Lookup) else [col(v)])]
        text = " ".join(str(v) for v in used)
        uses = lambda c: re.search(rf"(?<!\w){re.escape(c)}(?!\w)", text)
        df = self.entries_df
        if any(uses(c) for c in self.rows_df.columns if c not in self.row_key):
            df = df.join(self.rows_df.drop(*[c for c in self.rows_df.columns if c in self.entry_names()]), list(self.row_key))
        if any(uses(c) for c in self.cols_df.columns if c not in self.col_key):
            df = df.join(self.cols_df.drop(*[c for c in self.cols_df.columns if c in df.columns and c not in self.col_key]), list(self.col_key))
        return df

    def annotate_globals(self, **named) -> MatrixTable:
        return self.new(globals={**self.globals, **named})

    def select_globals(self, *keep: str, **named) -> MatrixTable:
        return self.new(globals={**{k: self.globals[k] for k in keep}, **named})

    def select_rows(self, *keep: str, **named) -> MatrixTable:
        return self.new(rows=self.rows().select(*keep, **named).df)

    def select_cols(self, *keep: str, **named) -> MatrixTable:
        return self.new(cols=self.cols().select(*keep, **named).df)

    def select_entries(self, *keep: str, **named) -> MatrixTable:
        m = self.annotate_entries(**named) if named else self
        return m.new(entries=m.entries_df.select(*names([*self.row_key, *self.col_key, *keep, *named])))

    def transmute_rows(self, uses=(), **named) -> MatrixTable:
        return self.new(rows=self.rows().transmute(uses, **named).df)

    def transmute_cols(self, uses=(), **named) -> MatrixTable:
        return self.new(cols=self.cols().transmute(uses, **named).df)

    def transmute_entries(self, uses=(), **named) -> MatrixTable:
        m = self.annotate_entries(**named)
        return m.new(entries=m.entries_df.drop(*[u for u in uses if u not in named]))

    def drop(self, *fields: str) -> MatrixTable:
        return self.new(rows=self.rows_df.drop(*fields), cols=self.cols_df.drop(*fields), entries=self.entries_df.drop(*fields), globals={k: v for k, v in self.globals.items() if k not in fields})

    def rename(self, mapping: dict[str, str]) -> MatrixTable:
        return MatrixTable(*[d.withColumnsRenamed(mapping) for d in (self.rows_df, self.cols_df, self.entries_df)], [mapping.get(k, k) for k in self.row_key], [mapping.get(k, k) for k in self.col_key], self.globals)

    def key_rows_by(self, *key: str, **named) -> MatrixTable:
        return self.rekey("rows", key, named)

    def key_cols_by(self, *key: str, **named) -> MatrixTable:
        return self.rekey("cols", key, named)

    def rekey(self, axis: str, key, named) -> MatrixTable:
        side, old = (self.rows_df, self.row_key) if axis == "rows" else (self.cols_df, self.col_key)
        side = side.withColumns({k: col(v) for k, v in named.items()}) if named else side
        key = [*key, *named]
        to = side.select(*[F.col(f"`{k}`").alias(f"__o_{k}") for k in old], *[F.col(f"`{k}`").alias(f"__n_{k}") for k in key])
        on = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"`__o_{k}`") for k in old])
        entries = self.entries_df.join(to, on).drop(*old, *[f"__o_{k}" for k in old]).withColumnsRenamed({f"__n_{k}": k for k in key})
        return self.new(rows=side, row_key=key, entries=entries) if axis == "rows" else self.new(cols=side, col_key=key, entries=entries)

    # filters

    def keep_entries(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
        out = self.entries_df
        out = out.join(rows.select(*self.row_key), list(self.row_key), "left_semi") if rows is not None else out
        return out.join(cols.select(*self.col_key), list(self.col_key), "left_semi") if cols is not None else out

    def filter_rows(self, condition, keep: bool = True) -> MatrixTable:
        rows = self.rows().filter(condition, keep).df
        return self.new(rows=rows, entries=self.keep_entries(rows=rows))

    def filter_cols(self, condition, keep: bool = True) -> MatrixTable:
        cols = self.cols().filter(condition, keep).df
        return self.new(cols=cols, entries=self.keep_entries(cols=cols))

    def filter_entries(self, condition, keep: bool = True) -> MatrixTable:
        p = col(condition)
        entries = self.with_axes({"p": p}).where(p if keep else ~p).select(*names(self.entries_df.columns))
        return self.new(entries=entries)

    def unfilter_entries(self) -> MatrixTable:
        """Absent entries come back with missing fields."""
        grid = self.rows_df.select(*self.row_key).crossJoin(self.cols_df.select(*self.col_key))
        return self.new(entries=grid.join(self.entries_df, [*self.row_key, *self.col_key], "left"))

    def compute_entry_filter_stats(self) -> MatrixTable:
        """row and column fields entry_stats_row and entry_stats_col: struct<n_filtered, n_remaining, fraction_filtered>."""

        def stats(side: DataFrame, key, total: int, name: str) -> DataFrame:
            n = self.entries_df.groupBy(*key).agg(F.count("*").alias("__n"))
            left = F.coalesce(F.col("__n"), F.lit(0))
            packed = F.struct((F.lit(total) - left).alias("n_filtered"), left.alias("n_remaining"), ((F.lit(total) - left) / F.nullif(F.lit(total), F.lit(0))).alias("fraction_filtered"))
            return side.join(n, list(key), "left").withColumn(name, packed).drop("__n")

        return self.new(rows=stats(self.rows_df, self.row_key, self.count_cols(), "entry_stats_row"), cols=stats(self.cols_df, self.col_key, self.count_rows(), "entry_stats_col"))

    def semi_join_rows(self, other: Table) -> MatrixTable:
        rows = self.rows().semi_join(other).df
        return self.new(rows=rows, entries=self.keep_entries(rows=rows))

    def anti_join_rows(self, other: Table) -> MatrixTable:
        rows = self.rows().anti_join(other).df
        return self.new(rows=rows, entries=self.keep_entries(rows=rows))

    def semi_join_cols(self, other: Table) -> MatrixTable:
        cols = self.cols().semi_join(other).df
        return self.new(cols=cols, entries=self.keep_entries(cols=cols))

    def anti_join_cols(self, other: Table) -> MatrixTable:
        cols = self.cols().anti_join(other).df
        return self.new(cols=cols, entries=self.keep_entries(cols=cols))

    def head(self, n_rows: int | None = None, n_cols: int | None = None) -> MatrixTable:
        return self.cut("head", n_rows, n_cols)

    def tail(self, n_rows: int | None = None, n_cols: int | None = None) -> MatrixTable:
        return self.cut("tail", n_rows, n_cols)

    def cut(self, how: str, n_rows, n_cols) -> MatrixTable:
        rows = getattr(self.rows(), how)(n_rows).df if n_rows is not None else None
        cols = getattr(self.cols(), how)(n_cols).df if n_cols is not None else None
        return self.new(rows=self.rows_df if rows is None else rows, cols=self.cols_df if cols is None else cols, entries=self.keep_entries(rows, cols))

    def sample_rows(self, p: float, seed: int | None = None) -> MatrixTable:
        rows = self.rows_df.sample(False, p, seed)
        return self.new(rows=rows, entries=self.keep_entries(rows=rows))

    def sample_cols(self, p: float, seed: int | None = None) -> MatrixTable:
        cols = self.cols_df.sample(False, p, seed)
        return self.new(cols=cols, entries=self.keep_entries(cols=cols))

    def distinct_by_row(self) -> MatrixTable:
        return self.new(rows=self.rows().distinct().df, entries=self.entries_df.dropDuplicates([*self.row_key, *self.col_key]))

    def distinct_by_col(self) -> MatrixTable:
        return self.new(cols=self.cols().distinct().df, entries=self.entries_df.dropDuplicates([*self.row_key, *self.col_key]))

    def choose_cols(self, indices: list[int]) -> MatrixTable:
        cols = self.cols().add_index("__i").df.where(F.col("__i").isin(indices)).drop("__i")
        return self.new(cols=cols, entries=self.keep_entries(cols=cols))

    # aggregation and grouping

    def aggregate_rows(self, aggregation):
        return self.rows().aggregate(aggregation)

    def aggregate_cols(self, aggregation):
        return self.cols().aggregate(aggregation)

    def aggregate_entries(self, aggregation):
        return Table(self.with_axes({"a": aggregation} if isinstance(aggregation, Column) else {"a": aggregation.over})).aggregate(aggregation)

    def group_rows_by(self, *keys: str, **named) -> GroupedMatrixTable:
        return GroupedMatrixTable(self, "rows", {**{k: F.col(f"`{k}`") for k in keys}, **{k: col(v) for k, v in named.items()}})

    def group_cols_by(self, *keys: str, **named) -> GroupedMatrixTable:
        return GroupedMatrixTable(self, "cols", {**{k: F.col(f"`{k}`") for k in keys}, **{k: col(v) for k, v in named.items()}})

    def collect_cols_by_key(self) -> MatrixTable:
        """One column for each key, its fields and its entries' fields as arrays; missing values stay, and the n-th values of all fields are of one column or entry, in their order."""

        def gathered(df: DataFrame, key, fields: list[str]) -> DataFrame:
            if not fields:
                return df.distinct()
            kept = df.groupBy(*names(key)).agg(F.sort_array(F.collect_list(F.struct(*names(fields)))).alias("__all"))
            return kept.select(*names(key), *[F.col(f"__all.`{c}`").alias(c) for c in fields])

        cols = gathered(self.cols_df, self.col_key, [c for c in self.cols_df.columns if c not in self.col_key])
        return self.new(cols=cols, entries=gathered(self.entries_df, [*self.row_key, *self.col_key], self.entry_names()))

    # explode, union, index

    def explode_rows(self, field: str) -> MatrixTable:
        """A row for each element; such rows get the element as part of their key, so that each keeps its own entries."""
        rows = self.rows_df.withColumn(field, F.explode(F.col(f"`{field}`")))
        key = [*self.row_key, field]
        entries = self.entries_df.join(rows.select(*names(key)), list(self.row_key))
        return self.new(rows=rows, row_key=key, entries=entries)

    def explode_cols(self, field: str) -> MatrixTable:
        cols = self.cols_df.withColumn(field, F.explode(F.col(f"`{field}`")))
        key = [*self.col_key, field]
        entries = self.entries_df.join(cols.select(*names(key)), list(self.col_key))
        return self.new(cols=cols, col_key=key, entries=entries)

    def union_rows(self, *others: MatrixTable) -> MatrixTable:
        """Rows of all, with the first's columns."""
        return self.new(rows=reduce(DataFrame.unionByName, [o.rows_df for o in others], self.rows_df), entries=reduce(DataFrame.unionByName, [o.entries_df for o in others], self.entries_df))

    def union_cols(self, other: MatrixTable, row_join_type: str = "inner") -> MatrixTable:
        """Columns of both over rows of both (inner) or of either (outer; absent entries stay absent). Row fields are the first's."""
        shared = other.rows_df.select(*self.row_key).distinct()
        rows = self.rows_df.join(shared, list(self.row_key), "left_semi" if row_join_type == "inner" else "full")
        entries = self.entries_df.unionByName(other.entries_df)
        entries = entries.join(rows.select(*self.row_key), list(self.row_key), "left_semi") if row_join_type == "inner" else entries
        return self.new(rows=rows, cols=self.cols_df.unionByName(other.cols_df), entries=entries)

    def index_rows(self, *exprs):
        return self.rows().index(*exprs)

    def index_cols(self, *exprs):
        return self.cols().index(*exprs)

    def index_entries(self, row_exprs: list, col_exprs: list):
        return Table(self.entries_df, [*self.row_key, *self.col_key]).index(*row_exprs, *col_exprs)

    def add_row_index(self, name: str = "row_idx") -> MatrixTable:
        return self.new(rows=self.rows().add_index(name).df)

    def add_col_index(self, name: str = "col_idx") -> MatrixTable:
        return self.new(cols=self.cols().add_index(name).df)

    # other shapes

    def localize_entries(self, entries_field: str = "entries", cols_field: str = "cols") -> Table:
        """A row for each matrix row with the array of its entries in column order, missing where filtered; columns go to a global array."""
        cols = Table(self.cols_df, self.col_key).add_index("__c")
        local = [r.asDict() for r in cols.df.orderBy("__c").drop("__c").collect()]
        n = len(local)
        placed = self.entries_df.join(cols.df.select(*self.col_key, "__c"), list(self.col_key))
        pairs = F.collect_list(F.struct(F.col("__c").alias("key"), F.struct(*names(self.entry_names())).alias("value")))
        wide = placed.groupBy(*self.row_key).agg(F.map_from_entries(pairs).alias("__m"))
        array = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(F.col("__m"), i.cast("long"))) if n else F.array()
        return Table(self.rows_df.join(wide, list(self.row_key), "left").withColumn(entries_field, array).drop("__m"), self.row_key, {**self.globals, cols_field: local})

    def make_table(self, separator: str = ".") -> Table:
        """A wide table: row fields, and for each column and entry field one named by the column key."""
        keys = [separator.join(str(r[k]) for k in self.col_key) for r in self.cols_df.select(*self.col_key).orderBy(*self.col_key).collect()]
        label = F.concat_ws(separator, *[F.col(f"`{k}`").cast("string") for k in self.col_key])
        fields = self.entry_names()
        wide = self.entries_df.withColumn("__label", label).groupBy(*self.row_key).pivot("__label", keys)
        wide = wide.agg(*[F.min(F.col(f"`{f}`")).alias(f) for f in fields])
        if len(fields) == 1:
            wide = wide.withColumnsRenamed({k: f"{k}{separator}{fields[0]}" for k in keys})
        else:
            wide = wide.withColumnsRenamed({f"{k}_{f}": f"{k}{separator}{f}" for k in keys for f in fields})
        return Table(self.rows_df.join(wide, list(self.row_key), "left"), self.row_key, self.globals)

    # counts, storage

    def count_rows(self) -> int:
        return self.rows_df.count()

    def count_cols(self) -> int:
        return self.cols_df.count()

    def count(self) -> tuple[int, int]:
        return self.count_rows(), self.count_cols()

    def repartition(self, n: int) -> MatrixTable:
        return self.new(entries=self.entries_df.repartition(n, *self.row_key))

    def naive_coalesce(self, n: int) -> MatrixTable:
        return self.new(entries=self.entries_df.coalesce(n))

    def cache(self) -> MatrixTable:
        return self.persist()

    def persist(self, level: str = "MEMORY_AND_DISK") -> MatrixTable:
        for d in (self.rows_df, self.cols_df, self.entries_df):
            d.persist(getattr(StorageLevel, level))
        return self

    def unpersist(self) -> MatrixTable:
        for d in (self.rows_df, self.cols_df, self.entries_df):
            d.unpersist()
        return self

    def describe(self) -> str:
        return "\n".join([f"Rows ({', '.join(self.row_key)}): {self.rows_df.schema.simpleString()}", f"Columns ({', '.join(self.col_key)}): {self.cols_df.schema.simpleString()}", f"Entries: {self.entries_df.schema.simpleString()}", f"Globals: {list(self.globals)}"])

    def summarize(self) -> dict[str, DataFrame]:
        return {"rows": self.rows().summarize(), "cols": self.cols().summarize(), "entries": Table(self.entries_df).summarize()}

    def write(self, path: str, overwrite: bool = False) -> None:
        from latticeframe.sources.native import write_matrix

        write_matrix(self, path, overwrite)

    def checkpoint(self, path: str, overwrite: bool = False) -> MatrixTable:
        from latticeframe.sources.native import read_matrix

        self.write(path, overwrite)
        return read_matrix(self.rows_df.sparkSession, path)
