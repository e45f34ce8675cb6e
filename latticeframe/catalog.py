"""The registered queries of the keyed-table engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.functions import aggregators as agg
from latticeframe.functions import genetics as g
from latticeframe.functions import scalar as s
from latticeframe.operators import methods, regression
from latticeframe.operators.blockmatrix import BlockMatrix
from latticeframe.operators.intervals import interval
from latticeframe.operators.matrix import MatrixTable
from latticeframe.operators.table import Table, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str, *key: str) -> Table:
    return Table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), key)


def sales(spark: SparkSession, sf_dir: str) -> MatrixTable:
    """Part x supplier entries of quantity and price."""
    lines = read(spark, sf_dir, "lineitem").group_by("l_partkey", "l_suppkey").aggregate(qty=agg.sum("l_quantity"), price=F.round(agg.sum("l_extendedprice"), 2))
    m = lines.to_matrix_table(["l_partkey"], ["l_suppkey"])
    part = read(spark, sf_dir, "part").df.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    supplier = read(spark, sf_dir, "supplier").df.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "s_acctbal")
    return m.new(rows=m.rows_df.join(part, "l_partkey"), cols=m.cols_df.join(supplier, "l_suppkey"))


ENTRIES = "e AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL)"


# tables


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS mean_discount, count(*) AS n
          FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def table_group_by_aggregate(spark, d):
    t = read(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return t.group_by("l_returnflag", "l_linestatus").aggregate(sum_qty=agg.sum("l_quantity"), revenue=F.round(agg.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2), mean_discount=F.round(agg.mean("l_discount"), 9), n=agg.count()).df


@query("SELECT o_orderkey, o_totalprice * 1.1 AS with_tax, o_totalprice > 100000 AS large FROM orders")
def table_select(spark, d):
    return read(spark, d, "orders", "o_orderkey").select(with_tax=F.col("o_totalprice") * 1.1, large=F.col("o_totalprice") > 100000).df


@query("SELECT o_orderkey, o_custkey, upper(o_orderstatus) AS status, year(o_orderdate) AS year FROM orders WHERE NOT (o_totalprice > 50000)")
def table_transmute_filter_out(spark, d):
    t = read(spark, d, "orders", "o_orderkey").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate").filter(F.col("o_totalprice") > 50000, keep=False)
    return t.transmute(["o_orderstatus", "o_orderdate", "o_totalprice"], status=F.upper("o_orderstatus"), year=F.year("o_orderdate")).df


@query("SELECT c_custkey, c_nationkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def table_index_lookup(spark, d):
    nations = read(spark, d, "nation", "n_nationkey")
    regions = read(spark, d, "region", "r_regionkey")
    t = read(spark, d, "customer", "c_custkey").select("c_nationkey").annotate(n=nations.index("c_nationkey")).annotate(r=regions.index(F.col("n.n_regionkey")))
    return t.transmute(["n", "r"], n_name=F.col("n.n_name"), r_name=F.col("r.r_name")).df


@query("SELECT c_custkey, list_sort(list(o_totalprice)) AS prices FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def table_index_all_matches(spark, d):
    orders = read(spark, d, "orders").key_by("o_custkey").select("o_totalprice")
    t = read(spark, d, "customer", "c_custkey").select().annotate(m=orders.index("c_custkey", all_matches=True))
    return t.select(prices=F.transform("m", lambda x: x["o_totalprice"])).df


def orders_by_customer(spark, d):
    t = read(spark, d, "orders").annotate(cust=F.nullif(F.col("o_custkey") % 10, F.lit(0)))
    return t.key_by("cust").select("o_orderkey")


def some_customers(spark, d):
    return read(spark, d, "customer").filter(F.col("c_custkey").between(5, 14)).key_by("c_custkey").select("c_name")


LEFT = "a AS (SELECT nullif(o_custkey % 10, 0) AS cust, o_orderkey FROM orders), b AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 5 AND 14)"


@query(f"WITH {LEFT} SELECT cust, o_orderkey, c_name FROM a JOIN b ON cust = c_custkey")
def table_join_inner(spark, d):
    return orders_by_customer(spark, d).join(some_customers(spark, d)).df


@query(f"WITH {LEFT} SELECT cust, o_orderkey, c_name FROM a LEFT JOIN b ON cust = c_custkey")
def table_join_left(spark, d):
    return orders_by_customer(spark, d).join(some_customers(spark, d), "left").df


@query(f"WITH {LEFT} SELECT coalesce(cust, c_custkey) AS cust, o_orderkey, c_name FROM a RIGHT JOIN b ON cust = c_custkey")
def table_join_right(spark, d):
    return orders_by_customer(spark, d).join(some_customers(spark, d), "right").df


@query(f"WITH {LEFT} SELECT coalesce(cust, c_custkey) AS cust, o_orderkey, c_name FROM a FULL JOIN b ON cust = c_custkey")
def table_join_outer(spark, d):
    return orders_by_customer(spark, d).join(some_customers(spark, d), "outer").df


@query(f"WITH {LEFT} SELECT cust, o_orderkey FROM a WHERE cust IN (SELECT c_custkey FROM b)")
def table_semi_join(spark, d):
    return orders_by_customer(spark, d).semi_join(some_customers(spark, d)).df


@query(f"WITH {LEFT} SELECT cust, o_orderkey FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE c_custkey = cust)")
def table_anti_join(spark, d):
    return orders_by_customer(spark, d).anti_join(some_customers(spark, d)).df


@query("SELECT l_orderkey, min({'l_partkey': l_partkey, 'l_quantity': l_quantity}).l_partkey AS l_partkey, min({'l_partkey': l_partkey, 'l_quantity': l_quantity}).l_quantity AS l_quantity FROM lineitem GROUP BY 1")
def table_distinct(spark, d):
    return read(spark, d, "lineitem", "l_orderkey").select("l_partkey", "l_quantity").distinct().df


@query("SELECT l_orderkey, list_sort(list(l_partkey)) AS parts FROM lineitem GROUP BY 1")
def table_collect_by_key(spark, d):
    t = read(spark, d, "lineitem", "l_orderkey").select("l_partkey").collect_by_key("v")
    return t.select(parts=F.transform("v", lambda x: x["l_partkey"])).df


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def table_explode(spark, d):
    return read(spark, d, "documents", "doc_id").select(line=F.split("text", "\n")).explode("line").df


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events")
def table_add_index(spark, d):
    return read(spark, d, "events", "event_id").select().add_index().df


@query("""SELECT ts, event_id, coalesce(sum(event_id) OVER w, 0)::BIGINT AS total, count(*) OVER w AS n, max(event_id) OVER w AS most, coalesce(bool_or(event_type = 'click') OVER w, false) AS clicked
          FROM events WINDOW w AS (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def table_scans(spark, d):
    t = read(spark, d, "events", "ts").select("event_id", "event_type")
    t = t.annotate(total=scan.sum("event_id"), n=scan.count(), most=scan.max("event_id"), clicked=scan.any(F.col("event_type") == "click"))
    return t.drop("event_type").df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def table_order_by_head(spark, d):
    t = read(spark, d, "orders").order_by(F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc_nulls_last())
    return t.df.select("o_orderkey", "o_totalprice").limit(20)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 15")
def table_tail(spark, d):
    return read(spark, d, "orders", "o_orderkey").select("o_custkey").tail(15).df


@query("SELECT n_nationkey AS k, n_name AS name, NULL::DOUBLE AS acctbal FROM nation UNION ALL SELECT s_nationkey, s_name, s_acctbal FROM supplier")
def table_union_unify(spark, d):
    a = read(spark, d, "nation").key_by(k="n_nationkey").select(name="n_name")
    b = read(spark, d, "supplier").key_by(k="s_nationkey").select(name="s_name", acctbal="s_acctbal")
    return a.union(b, unify=True).df


@query("""WITH k AS (SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier), a AS (SELECT n_nationkey AS k, n_name AS x FROM nation), b AS (SELECT s_nationkey AS k, min(s_name) AS x FROM supplier GROUP BY 1)
          SELECT k.k, a.x AS a, b.x AS b FROM k LEFT JOIN a USING (k) LEFT JOIN b USING (k)""")
def table_multi_way_zip_join(spark, d):
    a = read(spark, d, "nation").key_by(k="n_nationkey").select(x="n_name")
    b = read(spark, d, "supplier").key_by(k="s_nationkey").select(x="s_name").distinct()
    t = Table.multi_way_zip_join([a, b], "data", "globals")
    return t.df.select("k", F.get("data", F.lit(0))["x"].alias("a"), F.get("data", F.lit(1))["x"].alias("b"))


@query("""WITH i AS (SELECT p_size AS a, p_size + 3 AS b, min(p_partkey) AS p FROM part GROUP BY ALL)
          SELECT c_custkey, c_nationkey, list_sort(list(p) FILTER (WHERE p IS NOT NULL)) AS parts FROM customer LEFT JOIN i ON c_nationkey >= a AND c_nationkey < b GROUP BY ALL HAVING count(p) > 0
          UNION ALL SELECT c_custkey, c_nationkey, []::BIGINT[] FROM customer WHERE NOT EXISTS (SELECT 1 FROM i WHERE c_nationkey >= a AND c_nationkey < b)""")
def table_interval_join_all(spark, d):
    i = read(spark, d, "part").annotate(i=interval("p_size", F.col("p_size") + 3)).key_by("i").select("p_partkey")
    i = Table(i.df.groupBy("i").agg(F.min("p_partkey").alias("p_partkey")), "i")
    t = read(spark, d, "customer", "c_custkey").select("c_nationkey").annotate(parts=i.index("c_nationkey", all_matches=True))
    return t.df.select("c_custkey", "c_nationkey", F.array_sort(F.transform("parts", lambda x: x["p_partkey"])).alias("parts"))


@query("""WITH i AS (SELECT o_orderdate AS a, o_orderkey AS k FROM orders WHERE o_orderkey % 50 = 0), v AS (SELECT epoch_us(a) AS a, epoch_us(a) + 864000000000 AS b, k FROM i)
          SELECT event_id, (SELECT min({'a': a, 'b': b, 'k': k}).k FROM v WHERE epoch_us(ts) >= a AND epoch_us(ts) < b) AS k FROM events""")
def table_interval_lookup(spark, d):
    i = read(spark, d, "orders").filter(F.col("o_orderkey") % 50 == 0).annotate(a=F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    i = i.annotate(i=interval("a", F.col("a") + 864000000000)).key_by("i").select(k="o_orderkey")
    t = read(spark, d, "events", "event_id").select("ts").annotate(x=F.unix_micros(F.col("ts").cast("timestamp"))).annotate(k=i.index("x")["k"])
    return t.select("k").df


@query("SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_tax))")
def table_gather(spark, d):
    t = read(spark, d, "lineitem").df.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return methods.gather(Table(t), "name", "value", ["l_quantity", "l_tax"]).df


@query("SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1")
def table_spread(spark, d):
    t = read(spark, d, "orders").group_by("o_orderpriority", "o_orderstatus").aggregate(x=F.round(agg.sum("o_totalprice"), 2))
    return methods.spread(Table(t.df), "o_orderstatus", "x", ["F", "O", "P"]).df


@query("SELECT count(*) AS n, sum(l_quantity) AS qty, max(l_shipdate) AS last FROM lineitem")
def table_aggregate(spark, d):
    return read(spark, d, "lineitem").aggregate_df(n=agg.count(), qty=agg.sum("l_quantity"), last=agg.max_text("l_shipdate"))


@query("SELECT user_id, count(*) AS n, 2.0::DOUBLE * count(*) AS scaled FROM events GROUP BY 1")
def table_globals(spark, d):
    t = read(spark, d, "events").annotate_globals(factor=2.0)
    t = t.group_by("user_id").aggregate(n=agg.count())
    return t.annotate(scaled=F.col("n") * t.g("factor")).df


# aggregators


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, coalesce(bool_or(value > 90), false) AS some, coalesce(bool_and(value >= 0), true) AS every, min(value) AS low, max(value) AS high,
          count(*) FILTER (WHERE value > 50) / count(*) AS share FROM events GROUP BY 1""")
def agg_conditions(spark, d):
    v = F.col("value")
    return read(spark, d, "events").group_by("user_id").aggregate(clicks=agg.count_where(F.col("event_type") == "click"), some=agg.any(v > 90), every=agg.all(v >= 0), low=agg.min(v), high=agg.max(v), share=agg.fraction(v > 50)).df


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stdev, min(value) AS min, max(value) AS max, count(value) AS n, round(sum(value), 4) AS sum FROM events GROUP BY 1")
def agg_stats(spark, d):
    t = read(spark, d, "events").group_by("event_type").aggregate(x=agg.stats("value"))
    x = F.col("x")
    return t.df.select("event_type", F.round(x["mean"], 6).alias("mean"), F.round(x["stdev"], 6).alias("stdev"), x["min"].alias("min"), x["max"].alias("max"), x["n"].alias("n"), F.round(x["sum"], 4).alias("sum"))


@query("SELECT user_id, event_type AS key, count(*) AS value FROM events GROUP BY ALL")
def agg_counter(spark, d):
    return read(spark, d, "events").group_by("user_id").aggregate(types=agg.counter("event_type")).df.select("user_id", F.inline("types"))


@query("SELECT c_mktsegment, c_nationkey AS key, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY ALL")
def agg_group_by(spark, d):
    return read(spark, d, "customer").group_by("c_mktsegment").aggregate(balances=agg.group_by("c_nationkey", F.round(agg.sum("c_acctbal"), 2))).df.select("c_mktsegment", F.inline("balances"))


@query("SELECT lang, sum(length(w)) AS letters, count(*) AS words FROM (SELECT lang, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
def agg_explode(spark, d):
    words = F.split("text", " ")
    return read(spark, d, "documents").group_by("lang").aggregate(letters=agg.explode(lambda w: agg.sum(F.length(w)), words), words=agg.explode(lambda w: agg.count(), words)).df


@query("SELECT label, list(s ORDER BY p) AS sums FROM (SELECT label, p, round(sum(x), 3) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY ALL) GROUP BY 1")
def agg_array(spark, d):
    return read(spark, d, "embeddings").group_by("label").aggregate(sums=agg.array_agg(lambda x: F.round(agg.sum(x.cast("double")), 3), "embedding")).df


@query("""SELECT event_type, list_sum(list(CASE WHEN value >= 0 AND value <= 100 THEN 1 ELSE 0 END))::BIGINT AS inside, count(*) FILTER (WHERE value > 100) AS larger, count(*) FILTER (WHERE value < 0) AS smaller,
          [count(*) FILTER (WHERE value >= 0 AND value < 25), count(*) FILTER (WHERE value >= 25 AND value < 50), count(*) FILTER (WHERE value >= 50 AND value < 75), count(*) FILTER (WHERE value >= 75 AND value <= 100)] AS freq FROM events GROUP BY 1""")
def agg_hist(spark, d):
    t = read(spark, d, "events").group_by("event_type").aggregate(h=agg.hist("value", 0, 100, 4))
    return t.df.select("event_type", F.aggregate("h.bin_freq", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("inside"), F.col("h.n_larger").alias("larger"), F.col("h.n_smaller").alias("smaller"), F.col("h.bin_freq").alias("freq"))


@query("SELECT p_brand, round(corr(p_size, p_retailprice), 9) AS r FROM part GROUP BY 1 HAVING count(*) > 2")
def agg_corr(spark, d):
    t = read(spark, d, "part").group_by("p_brand").aggregate(r=agg.corr("p_size", "p_retailprice"), n=agg.count())
    return t.filter(F.col("n") > 2).df.select("p_brand", F.round("r", 9).alias("r"))


@query("SELECT o_custkey, list_slice(list(o_orderkey ORDER BY o_totalprice, o_orderkey), 1, 3) AS cheapest FROM orders GROUP BY 1")
def agg_take(spark, d):
    return read(spark, d, "orders").group_by("o_custkey").aggregate(cheapest=agg.take("o_orderkey", 3, F.struct("o_totalprice", "o_orderkey"))).df


@query("SELECT o_orderpriority, list_sort(list_distinct(list(o_orderstatus))) AS statuses FROM orders GROUP BY 1")
def agg_collect_as_set(spark, d):
    return read(spark, d, "orders").group_by("o_orderpriority").aggregate(statuses=agg.collect_as_set("o_orderstatus")).df


@query("SELECT s_nationkey, round(product(1 + s_acctbal / 1e6), 9) AS p FROM supplier GROUP BY 1")
def agg_product(spark, d):
    return read(spark, d, "supplier").group_by("s_nationkey").aggregate(p=F.round(agg.product(1 + F.col("s_acctbal") / 1e6), 9)).df


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem")
def agg_linreg(spark, d):
    fit = regression.linreg_fit(read(spark, d, "lineitem").aggregate(agg.linreg("l_extendedprice", [1.0, "l_quantity"])), 2)
    rows = [(round(fit["beta"][1], 6), round(fit["beta"][0], 4), round(fit["multiple_r_squared"], 9))]
    return spark.createDataFrame(rows, "slope double, intercept double, r2 double")


@query()
def agg_approx_quantiles(spark, d):
    return read(spark, d, "lineitem").group_by("l_returnflag").aggregate(q=agg.approx_quantiles("l_extendedprice", [0.25, 0.5, 0.75]), m=agg.approx_median("l_quantity")).df


# functions


@query("""SELECT doc_id, length(text) AS n, lower(substr(text, 1, 5)) AS head, CASE WHEN contains(text, 'the') THEN instr(text, 'the') - 1 ELSE -1 END AS at, regexp_matches(text, '[0-9]{6,}') AS digits,
          regexp_replace(substr(text, 1, 40), '[aeiou]', '_', 'g') AS masked, reverse(substr(text, 1, 10)) AS back, starts_with(text, 'The') AS the FROM documents""")
def fn_strings(spark, d):
    t = F.col("text")
    return read(spark, d, "documents", "doc_id").select(
        n=s.length(t), head=F.lower(s.slice_string(t, 0, 5)), at=s.find(t, "the"), digits=s.matches(t, "[0-9]{6,}"), masked=s.replace(s.slice_string(t, 0, 40), "[aeiou]", "_"), back=F.reverse(s.slice_string(t, 0, 10)), the=s.startswith(t, "The")
    ).df


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fn_json(spark, d):
    return read(spark, d, "events", "event_id").select(k=s.parse_json("props", "k int")["k"]).df


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total, list_max(embedding) AS most, len(list_filter(embedding, lambda x: x > 0)) AS positive, list_position(embedding, list_min(embedding)) - 1 AS least_at,
          round(list_median(list_transform(embedding, lambda x: x::DOUBLE)), 9) AS middle FROM embeddings""")
def fn_arrays(spark, d):
    e = F.col("embedding")
    doubles = e.cast("array<double>")
    return read(spark, d, "embeddings", "vec_id").select(total=F.round(s.sum(doubles), 6), most=s.array_max(e), positive=F.size(s.filter(e, lambda x: x > 0)), least_at=s.argmin(e), middle=F.round(s.median(doubles), 9)).df


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax = 0 THEN 'inf' ELSE (l_quantity / l_tax)::VARCHAR END = 'inf' AS unbounded, floor(l_quantity / 7)::BIGINT AS whole, l_quantity - 7 * floor(l_quantity / 7) AS rest,
          CASE WHEN l_discount = 0 THEN -999.0 ELSE round(ln(l_discount), 9) END AS logged FROM lineitem""")
def fn_arithmetic(spark, d):
    t = read(spark, d, "lineitem").key_by("l_orderkey", "l_linenumber")
    q, seven = F.col("l_quantity"), F.lit(7.0)
    logged = s.log(F.col("l_discount"))
    return t.select(unbounded=s.divide(q, F.col("l_tax")) == float("inf"), whole=s.floordiv(q, seven), rest=s.floormod(q, seven), logged=F.when(logged == -float("inf"), F.lit(-999.0)).otherwise(F.round(logged, 9))).df


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 ELSE 0 END AS brand FROM part""")
def fn_case_switch(spark, d):
    size = F.col("p_size")
    return read(spark, d, "part", "p_partkey").select(
        **{"class": s.Case().when(size < 10, "small").when(size < 30, "medium").default("large"), "brand": s.Switch("p_brand").when("Brand#11", 1).when("Brand#22", 2).default(0)}
    ).df


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(string_split(text, ' '))) AS a, list_sort(list_distinct(string_split(lower(text), ' '))) AS b FROM documents)
          SELECT doc_id, len(list_intersect(a, b)) AS both, len(a) AS n, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only FROM w""")
def fn_sets(spark, d):
    a, b = s.to_set(F.split("text", " ")), s.to_set(F.split(F.lower("text"), " "))
    return read(spark, d, "documents", "doc_id").select(both=F.size(s.intersection(a, b)), n=F.size(a), only=F.size(s.difference(a, b))).df


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def fn_time(spark, d):
    seconds = F.unix_timestamp("o_orderdate")
    return read(spark, d, "orders", "o_orderkey").select(day=s.strftime("yyyy-MM-dd", seconds), seconds=seconds).df


@query()
def fn_distributions(spark, d):
    from latticeframe.functions import statistics as st

    t = read(spark, d, "lineitem").key_by("l_orderkey", "l_linenumber")
    return t.select(normal=st.pnorm(F.col("l_discount") * 10), chi=st.pchisqtail("l_quantity", F.lit(3.0)), t=st.pT(F.col("l_tax") * 20, F.lit(5.0)), poisson=st.ppois("l_quantity", F.lit(20.0)), quantile=st.qnorm(F.col("l_discount") + 0.01)).df


# genotypes made from lineitem: an entry's call is (quantity mod 3) alternate alleles


def genotypes(spark, d) -> MatrixTable:
    m = sales(spark, d)
    n = (F.col("qty") % 3).cast("int")
    m = m.annotate_entries(GT=g.call(F.when(n == 2, 1).otherwise(0), F.when(n > 0, 1).otherwise(0)), n_alt=n)
    return m.annotate_rows(alleles=F.array(F.lit("A"), F.when(F.col("p_size") % 2 == 0, "G").otherwise("T")))


CALLS = f"{ENTRIES}, n AS (SELECT e.*, (qty % 3)::INT AS n_alt FROM e)"


@query(f"WITH {CALLS} SELECT l_partkey, sum(n_alt)::BIGINT AS ac, 2 * count(*) AS an, sum(n_alt) / (2 * count(*)) AS af, count(*) FILTER (WHERE n_alt = 2) AS homs FROM n GROUP BY 1")
def agg_call_stats(spark, d):
    t = genotypes(spark, d).annotate_rows({"c": agg.call_stats("GT", 2)}).rows_df
    at = lambda f, i: F.get(F.col(f"c.{f}"), F.lit(i))
    return t.select("l_partkey", at("AC", 1).alias("ac"), F.col("c.AN").alias("an"), at("AF", 1).alias("af"), at("homozygote_count", 1).alias("homs"))


@query(f"WITH {CALLS} SELECT l_suppkey, count(*) AS n_called, count(*) FILTER (WHERE n_alt = 1) AS n_het, count(*) FILTER (WHERE n_alt = 2) AS n_hom_var, sum(CASE WHEN p_size % 2 = 0 THEN n_alt ELSE 0 END)::BIGINT AS n_transition FROM n JOIN part ON p_partkey = l_partkey GROUP BY 1")
def method_sample_qc(spark, d):
    t = methods.sample_qc(genotypes(spark, d)).cols_df
    return t.select("l_suppkey", *[F.col(f"sample_qc.{c}").alias(c) for c in ("n_called", "n_het", "n_hom_var", "n_transition")])


@query(f"WITH {CALLS} SELECT l_partkey, count(*) AS n_called, count(*) FILTER (WHERE n_alt = 1) AS n_het, count(*) FILTER (WHERE n_alt > 0) AS n_non_ref FROM n GROUP BY 1")
def method_variant_qc(spark, d):
    t = methods.variant_qc(genotypes(spark, d)).rows_df
    return t.select("l_partkey", *[F.col(f"variant_qc.{c}").alias(c) for c in ("n_called", "n_het", "n_non_ref")])


@query(f"""WITH {ENTRIES}, x AS (SELECT l_partkey, qty, s_acctbal FROM e JOIN supplier ON s_suppkey = l_suppkey), y AS (SELECT sum(s_acctbal) AS y, count(*) AS n FROM supplier),
          m AS (SELECT l_partkey, avg(qty) AS mx, count(*) AS k, sum(qty) AS sx, sum(qty * qty) AS sxx, sum(qty * s_acctbal) AS sxy, sum(s_acctbal) AS sy FROM x GROUP BY 1),
          f AS (SELECT l_partkey, n, sx + (n - k) * mx AS sum_x, sxx + (n - k) * mx * mx AS xx, sxy + mx * (y - sy) AS xy, y FROM m, y)
          SELECT l_partkey, round(sum_x, 6) AS sum_x, round((xy - sum_x * y / n) / (xx - sum_x * sum_x / n), 6) AS beta FROM f WHERE xx - sum_x * sum_x / n > 1e-6""")
def method_linear_regression(spark, d):
    t = regression.linear_regression_rows(sales(spark, d), "s_acctbal", "qty", [1.0])
    return t.df.where("not isnan(beta)").select("l_partkey", F.round("sum_x", 6).alias("sum_x"), F.round("beta", 6).alias("beta"))


@query()
def method_logistic_regression(spark, d):
    m = sales(spark, d)
    return regression.logistic_regression_rows(m.annotate_cols(case=(F.col("s_acctbal") > 5000).cast("int")), "wald", "case", F.col("qty") / 100, [1.0]).df


@query()
def method_pca(spark, d):
    values, scores, _ = methods.pca(sales(spark, d), "qty", 3)
    return scores.df.select("l_suppkey", F.transform("scores", lambda x: F.round(F.abs(x), 6)).alias("scores"))


@query()
def method_maximal_independent_set(spark, d):
    e = read(spark, d, "lineitem").df.select((F.col("l_suppkey") * 2).alias("i"), (F.col("l_partkey") * 2 + 1).alias("j")).distinct()
    return methods.maximal_independent_set(e)


# matrices


@query(f"WITH {ENTRIES} SELECT l_partkey, p_brand, sum(qty) AS total, count(*) AS n FROM e JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def matrix_annotate_rows(spark, d):
    return sales(spark, d).annotate_rows({"total": agg.sum("qty"), "n": agg.count()}).rows().select("p_brand", "total", "n").df


@query(f"WITH {ENTRIES}, c AS (SELECT DISTINCT l_suppkey FROM e) SELECT l_suppkey, n_name AS nation FROM c JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey")
def matrix_annotate_cols_lookup(spark, d):
    return sales(spark, d).annotate_cols(nation=read(spark, d, "nation", "n_nationkey").index("s_nationkey")["n_name"]).cols().select("nation").df


@query(f"WITH {ENTRIES} SELECT l_partkey, l_suppkey, p_brand AS brand, s_acctbal AS balance FROM e JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def matrix_annotate_entries_lookup(spark, d):
    m, suppliers = sales(spark, d), read(spark, d, "supplier", "s_suppkey")
    return m.annotate_entries(brand=F.col("p_brand"), balance=suppliers.index("l_suppkey")["s_acctbal"]).entries_df.select("l_partkey", "l_suppkey", "brand", "balance")


@query(f"""WITH {ENTRIES} SELECT l_partkey, s_nationkey, count(*) AS n, sum(CAST(round(qty * price * 100) AS BIGINT)) AS paired
          FROM e JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def matrix_collect_cols_by_key(spark, d):
    m = sales(spark, d).key_cols_by("s_nationkey").collect_cols_by_key()
    cells = F.zip_with("qty", "price", lambda q, p: F.round(q * p * 100).cast("long"))
    return m.entries_df.select("l_partkey", "s_nationkey", F.size("qty").cast("long").alias("n"), F.aggregate(cells, F.lit(0).cast("long"), lambda a, x: a + x).alias("paired"))


@query(f"WITH {ENTRIES} SELECT l_suppkey, s_nationkey, round(avg(price / qty), 4) AS mean_price FROM e JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def matrix_annotate_cols(spark, d):
    return sales(spark, d).annotate_cols({"mean_price": F.round(agg.mean(F.col("price") / F.col("qty")), 4)}).cols().select("s_nationkey", "mean_price").df


@query(f"WITH {ENTRIES} SELECT l_partkey, l_suppkey, price / qty AS unit, qty * p_size AS volume FROM e JOIN part ON p_partkey = l_partkey WHERE p_size > 25 AND qty > 30")
def matrix_filter_entries(spark, d):
    m = sales(spark, d).filter_rows(F.col("p_size") > 25).filter_entries(F.col("qty") > 30)
    return m.annotate_entries(unit=F.col("price") / F.col("qty"), volume=F.col("qty") * F.col("p_size")).entries_df.select("l_partkey", "l_suppkey", "unit", "volume")


@query(f"WITH {ENTRIES} SELECT p_brand, l_suppkey, sum(qty) AS qty, max(price) AS price FROM e JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def matrix_group_rows(spark, d):
    return sales(spark, d).group_rows_by("p_brand").aggregate(qty=agg.sum("qty"), price=agg.max("price")).entries_df


@query(f"WITH {ENTRIES} SELECT s_nationkey, l_partkey, sum(qty) AS qty FROM e JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def matrix_group_cols(spark, d):
    return sales(spark, d).group_cols_by("s_nationkey").aggregate(qty=agg.sum("qty")).entries_df


@query(f"WITH {ENTRIES}, r AS (SELECT count(*) AS n FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM e)) SELECT l_partkey, n - count(*) AS n_filtered, count(*) AS n_remaining FROM e, r GROUP BY l_partkey, n")
def matrix_entry_filter_stats(spark, d):
    t = sales(spark, d).compute_entry_filter_stats().rows_df
    return t.select("l_partkey", F.col("entry_stats_row.n_filtered").alias("n_filtered"), F.col("entry_stats_row.n_remaining").alias("n_remaining"))


@query(f"WITH {ENTRIES} SELECT l_partkey, l_suppkey, qty, p_brand, s_nationkey FROM e JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 10")
def matrix_entries_table(spark, d):
    return sales(spark, d).filter_cols(F.col("s_nationkey") < 10).entries().df.select("l_partkey", "l_suppkey", "qty", "p_brand", "s_nationkey")


@query(f"WITH {ENTRIES} SELECT l_partkey, list(qty ORDER BY l_suppkey) AS qtys FROM (SELECT p.k AS l_partkey, s.k AS l_suppkey, qty FROM (SELECT DISTINCT l_partkey AS k FROM e WHERE l_partkey < 20) AS p CROSS JOIN (SELECT DISTINCT l_suppkey AS k FROM e) AS s LEFT JOIN e ON l_partkey = p.k AND l_suppkey = s.k) GROUP BY 1")
def matrix_localize_entries(spark, d):
    t = sales(spark, d).filter_rows(F.col("l_partkey") < 20).localize_entries()
    return t.df.select("l_partkey", F.transform("entries", lambda x: x["qty"]).alias("qtys"))


@query(f"WITH {ENTRIES} SELECT count(*) AS n, sum(qty) AS qty, round(avg(price), 4) AS price FROM e")
def matrix_aggregate_entries(spark, d):
    m = sales(spark, d)
    return Table(m.entries_df).aggregate_df(n=agg.count(), qty=agg.sum("qty"), price=F.round(agg.mean("price"), 4))


@query(f"WITH {ENTRIES} SELECT l_partkey, l_suppkey, qty FROM e WHERE l_partkey <= 10 OR l_partkey BETWEEN 21 AND 30")
def matrix_union_rows(spark, d):
    m = sales(spark, d).select_entries("qty")
    return m.filter_rows(F.col("l_partkey") <= 10).union_rows(m.filter_rows(F.col("l_partkey").between(21, 30))).entries_df


# block matrices


@query("""WITH v AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)
          SELECT a.j AS i, b.j AS j, round(sum(a.x * b.x), 6) AS v FROM v AS a JOIN v AS b ON a.i = b.i WHERE a.j < 8 AND b.j < 8 GROUP BY 1, 2""")
def block_matrix_gram(spark, d):
    e = read(spark, d, "embeddings").df
    n = e.count()
    long = e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    b = BlockMatrix.from_entries(long, n, 64)
    gram = b.T @ b
    return gram.entries().where("i < 8 and j < 8").select("i", "j", F.round("v", 6).alias("v"))


@query("""WITH v AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) SELECT i, round(sum(2 * x + 1), 6) AS v FROM v GROUP BY 1""")
def block_matrix_row_sums(spark, d):
    e = read(spark, d, "embeddings").df
    b = BlockMatrix.from_entries(e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")), e.count(), 64)
    return (b * 2.0 + 1.0).sum(1).entries().select("i", F.round("v", 6).alias("v"))


@query("""WITH v AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) SELECT i, j, x AS v FROM v WHERE j - i BETWEEN -1 AND 1""")
def block_matrix_band(spark, d):
    e = read(spark, d, "embeddings").df
    b = BlockMatrix.from_entries(e.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")), e.count(), 64)
    return b.sparsify_band(-1, 1).entries().where("j - i between -1 and 1").select("i", F.col("j").cast("long").alias("j"), "v")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_group_by_aggregate(spark, sf_dir)
