"""The registered queries of these operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeframe.llm import hamming, kdtree, line_dedup, mixing, ngram_join, piece_codec, quality, secrets, token_count, urls
from latticeframe.llm.common import table

# Fixed values of the queries.
RULES = [urls.Rule("block", "com/en/"), urls.Rule("allow", "example.com/en/7"), urls.Rule("allow", "net/de/"), urls.Rule("block", "example.net/de/8"), urls.Rule("block", "org/es/")]
# The share of "*", of all other sources and languages and of none, goes to the others where it is empty.
SOURCES = {f"src{i}": 0.05 for i in range(20)} | {"*": 0.05}
LANGUAGES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, "*": 0.05}
TOPICS = {"contact": 0.05, "legal": 0.05, "technical": 0.1, "*": 0.8}
LEXICONS = {"contact": ["@", "mail", "phone"], "legal": ["license", "copyright", "warranty"], "technical": ["token", "password", "secret", "api"]}
SHARE, SEED = 0.5, 2024
THRESHOLD = 0.8


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, SOURCES, LANGUAGES, TOPICS, LEXICONS, SHARE, SEED)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixed(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return docs.select("doc_id", F.round("mix_probability", 6).alias("probability"), F.col("mix_kept").alias("kept"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"), THRESHOLD).select("doc_id", "line")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 100 == 0)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 100 == 0)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scan(docs, secrets.fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = listed(F.filter("spans", lambda s: s["kind"] != "crf"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("crf"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = quality.classify(docs, model, score_col="score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = piece_codec.decode(piece_codec.encode(table(spark, sf_dir, "documents", "doc_id", "text")))
    return docs.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents", "doc_id", "text"), THRESHOLD)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_token_counts, op2_mix_sources, op3_line_dedup, op4_exact_top_k, op5_url_filter, op6_nearest_neighbours, op7_secret_scan, op8_quality, op9_piece_codec, op10_ngram_join)
    }


def mixing_sql(sweeps: int = 40) -> str:
    """Probabilities least(1, factor of the source * of the language * of the topic), by sweeps over the axes.

    A category wants its part of the kept tokens, or all it has where that is less (the least level x with
    sum(least(have, x * target)) = total). A step gives each category the multiplier with which its cells, cut at 1, keep that.
    """

    def targets(name: str, shares: dict[str, float]) -> str:
        listed = ", ".join(f"('{k}', {v!r})" for k, v in {"*": 0.0, **shares}.items())
        return f"t_{name}(k, v) AS (VALUES {listed})"

    in_list = lambda names: ", ".join(f"'{n}'" for n in names if n != "*")
    hits = {t: f"len(regexp_extract_all(lower(coalesce(text, '')), '{'|'.join(w)}'))" for t, w in sorted(LEXICONS.items())}
    top = f"greatest({', '.join(hits.values())})"
    topic = f"CASE WHEN {top} = 0 THEN '*' " + " ".join(f"WHEN {h} = {top} THEN '{t}'" for t, h in hits.items()) + " END"
    steps = [
        targets("s", SOURCES), targets("l", LANGUAGES), targets("t", TOPICS),
        f"""d AS (SELECT doc_id, CASE WHEN source IN ({in_list(SOURCES)}) THEN source ELSE '*' END AS s, CASE WHEN lang IN ({in_list(LANGUAGES)}) THEN lang ELSE '*' END AS l, {topic} AS t,
            len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS n, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents)""",
        "w0 AS (SELECT s, l, t, sum(n)::DOUBLE AS w FROM d GROUP BY s, l, t)",
        "w1 AS (SELECT w0.* FROM w0 JOIN t_s AS a ON a.k = s JOIN t_l AS b ON b.k = l JOIN t_t AS c ON c.k = t WHERE a.v > 0 AND b.v > 0 AND c.v > 0 AND w > 0)",
        f"total AS (SELECT least({SHARE} * (SELECT sum(w) FROM w0), (SELECT sum(w) FROM w1)) AS total)",
    ]
    for axis in "slt":  # have, and the level at which the categories with have >= level * target fill up the total
        steps += [
            f"h_{axis} AS (SELECT {axis} AS k, v, sum(w) AS have FROM w1 JOIN t_{axis} ON k = {axis} GROUP BY ALL)",
            f"x_{axis} AS (SELECT *, (total - coalesce(sum(have) OVER (ORDER BY have / v, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(v) OVER (ORDER BY have / v, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM h_{axis}, total)",
            f"b_{axis} AS (SELECT k, least(have, v * coalesce((SELECT min_by(x, have / v) FROM x_{axis} WHERE x <= have / v), 1e300)) AS b, have FROM h_{axis})",
        ]
    steps.append("f0 AS (SELECT s, l, t, w, 1.0::DOUBLE AS f FROM w1)")
    k = 0
    for _ in range(sweeps):
        for axis in "slt":
            before, after = (f"OVER (PARTITION BY {axis} ORDER BY f DESC, s, l, t ROWS BETWEEN {x})" for x in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
            steps.append(f"g{k} AS (SELECT f{k}.*, b, have, (b - coalesce(sum(w) {before}, 0)) / sum(w * f) {after} AS c FROM f{k} JOIN b_{axis} ON k = {axis})")
            steps.append(f"m{k} AS (SELECT {axis} AS k, CASE WHEN any_value(b) >= any_value(have) * (1 - 1e-12) THEN 1 / min(f) ELSE max_by(c, f) FILTER (c * f <= 1) END AS m FROM g{k} GROUP BY {axis})")
            steps.append(f"f{k + 1} AS MATERIALIZED (SELECT s, l, t, w, f * m AS f FROM f{k} JOIN m{k} ON k = {axis})")
            k += 1
    steps.append(f"p AS (SELECT d.doc_id, least(1.0, coalesce(c.f, 0.0)) AS p, u FROM d LEFT JOIN f{k} AS c USING (s, l, t))")
    return f"WITH {', '.join(steps)} SELECT doc_id, round(p, 6) AS probability, u < p AS kept FROM p"


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{r.verdict}', '{r.rule}', '{r.host}', '{r.path}')" for r in RULES)
    return {
        "op2_mix_sources": mixing_sql(),
        "op3_line_dedup": r"""
WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS line FROM a),
k AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split_regex(s, '[ \t\r\f\v]+'), lambda x: x <> ''))) AS t FROM l),
g AS (SELECT t, len(t) AS n, min({'d': doc_id, 'l': line}) AS first, row_number() OVER (ORDER BY min({'d': doc_id, 'l': line})) AS id FROM k WHERE len(t) > 0 GROUP BY t),
e AS (SELECT id, n, unnest(t) AS w FROM g),
c AS (SELECT w, count(*) AS c FROM e GROUP BY w),
r AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS pos FROM e JOIN c USING (w) WHERE c > 0),
x AS (SELECT id, n, w FROM r WHERE pos <= n - ceil(0.8 * n - 1e-9) + 1),
p AS (SELECT DISTINCT x.id AS later, y.id AS earlier FROM x JOIN x AS y USING (w) WHERE y.id < x.id AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9),
v AS (SELECT DISTINCT later FROM p JOIN g AS a ON a.id = later JOIN g AS b ON b.id = earlier WHERE len(list_intersect(a.t, b.t)) >= 0.8 * (a.n + b.n - len(list_intersect(a.t, b.t))) - 1e-9)
SELECT doc_id, line::INTEGER AS line FROM k JOIN g USING (t) WHERE first <> {'d': doc_id, 'l': line} OR id IN (SELECT later FROM v)""",
        "op4_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
        "op5_url_filter": f"""
WITH r(verdict, rule, host, path) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT h.page_id, arg_max({{'rule': r.rule, 'verdict': r.verdict}}, length(r.rule)) AS best FROM h JOIN r ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN f USING (page_id)""",
        "op10_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS t FROM documents),
g AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(t) - 4, 1) + 1), lambda i: array_to_string(list_slice(t, i, i + 4), ' '))) AS s FROM w WHERE len(t) > 0),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS o FROM e AS a JOIN e AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE o >= 0.8 * (n + m - o) - 1e-9),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS node, a AS seen FROM d UNION SELECT r.node, d.b FROM r JOIN d ON d.a = r.seen)
SELECT doc_id, coalesce(k.class_id, doc_id) AS class_id, coalesce(x.n, 0) AS n_links FROM documents
LEFT JOIN (SELECT node, min(seen) AS class_id FROM r GROUP BY node) AS k ON node = doc_id LEFT JOIN (SELECT a, count(*) AS n FROM d GROUP BY a) AS x ON x.a = doc_id""",
    }
