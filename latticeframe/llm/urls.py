"""URL filters: host and path rules, carried over redirects and canonical links.

Only DataFrame functions. Pages, redirect targets and canonical targets are nodes; connected components make aliases
one class. Within a class an explicit allow comes before a block, and a page's own rule before its class's.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Tables, components

FEW_RULES = 256
NO_RULE = "struct<size: int, rule: string, verdict: string>"


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for a host with its subdomains and paths that start with "/" + path."""

    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without :// or for null."""
    return F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without :// or for null."""
    return F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as NO_RULE, or null; equally long rules: the one last in order of text. All rules become one expression."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.rule)).alias("size"), F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    none = F.lit(None).cast(NO_RULE)
    return F.greatest(none, none, *fits)


def with_rule(rows: DataFrame, rules: list[Rule], few: int = FEW_RULES) -> DataFrame:
    """rows (host, path, ...) with own, the longest rule that fits.

    Up to few rules are one expression. More are a table: each distinct (host, path) goes with every suffix of its host to
    the lengths of paths that rules of that suffix have, and with the paths cut to these lengths to the rules themselves,
    so both joins are of equal keys and a host with many rules meets no page that they do not fit.
    """
    if len(rules) <= few:
        return rows.withColumn("own", best_rule(F.col("host"), F.col("path"), rules))
    listed = rows.sparkSession.createDataFrame([(r.host, r.path, len(r.path), r.rule, r.verdict) for r in dict.fromkeys(rules)], "suffix string, start string, length int, rule string, verdict string")
    best = F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best")
    listed = listed.groupBy("suffix", "start").agg(best, F.first("length").alias("length"))
    lengths = listed.groupBy("suffix").agg(F.collect_set("length").alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pages = rows.where("host <> ''").select("host", "path").distinct()
    starts = pages.select("host", "path", F.explode(suffixes).alias("suffix")).join(lengths, "suffix")
    starts = starts.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).select("host", "path", "suffix", F.expr("substring(path, 1, n)").alias("start"))
    own = starts.join(listed, ["suffix", "start"]).groupBy("host", "path").agg(F.max("best").alias("own"))
    return rows.join(own, ["host", "path"], "left")


def node_of(url: Column) -> Column:
    """What stands for a url among the nodes: scheme, fragment and a closing slash taken off, host in lower case."""
    query = F.regexp_extract(after_scheme(url), "^[^?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), query)


CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical["'\s/>])[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh["'\s/>])[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*([^"'>\s]+)"""


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&#47;": "/", "&#x2f;": "/", "&#x2F;": "/", "&#38;": "&", "&#x26;": "&", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """The entities that urls need, the ampersand last."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def without_dots(path: Column) -> Column:
    """A path with its "." and ".." segments resolved; what would climb above the root stays there."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    step = lambda kept, x: F.when(x == "..", up(kept)).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.slice(segments, 2, F.size(segments)), F.array(F.lit("")), step)
    done = F.array_join(kept, "/")
    folder = F.when(last.isin(".", ".."), F.concat(done, F.lit("/"))).otherwise(done)
    return F.when(path.contains("/."), folder).otherwise(path)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (url, target) from the canonical links and refresh redirects in pages' html; relative targets are resolved."""
    html, url = F.col(html_col), F.col(url_col)
    every = lambda pattern, k: F.regexp_extract_all(html, F.lit(pattern), F.lit(k))
    canonical = F.when(F.lower(html).contains("canonical"), F.concat(*[every(CANONICAL, k) for k in (1, 2, 3)]))
    refresh = F.when(F.lower(html).contains("http-equiv"), every(REFRESH, 1))
    none = F.array().cast("array<string>")
    found = pages.select(url.alias("url"), F.explode(F.concat(F.coalesce(canonical, none), F.coalesce(refresh, none))).alias("href")).where("href <> '' and instr(url, '://') > 0")
    scheme, base = F.substring_index("url", "://", 1), F.concat(F.substring_index("url", "://", 1), F.lit("://"), F.regexp_extract(after_scheme(F.col("url")), "^[^/?#]*", 0))
    href, path = F.trim(decoded(F.col("href"))), path_of(F.col("url"))
    folder, query = F.regexp_replace(path, "[^/]*$", ""), F.regexp_extract(after_scheme(F.col("url")), "^[^?#]*([^#]*)", 1)
    own = F.regexp_extract(href, "^[^?#]*", 0)  # the path of a relative target, and what follows it
    tail = F.substring(href, F.length(own) + 1, F.length(href))
    full = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own))
    target = (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("#"), F.concat(base, path, query))
        .when(own == "", F.concat(base, path, tail))
        .otherwise(F.concat(base, without_dots(full), tail))
    )
    return found.select("url", target.alias("target"))


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Rows (id, host, path, rule, class_rule, verdict), one for each row of pages.

    verdict is that of the page's own rule, else its class's, else default. redirects has the columns url and target.
    A null url, or one without ://, has an empty host and path, no rule and no class. Null html has no links.
    Repeated rows give repeated results; other columns are not read. A class whose members are met by both allow and
    block rules counts as allowed. Ties between equally long rules go to the last in order of text. An empty table gives
    no rows. Links without a host of their own are resolved against the page's url, dot segments and entities included.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path = host_of(url), path_of(url)
    edges = link_edges(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        given = redirects.select("url", "target").where("instr(url, '://') > 0 and instr(target, '://') > 0")
        edges = given if edges is None else edges.unionByName(given)
    rows = with_rule(rows.select("id", "url", host.alias("host"), path.alias("path")), rules)
    columns = [F.col("id").alias(id_col), "host", "path", F.col("own.rule").alias("rule")]
    plain = rows.select(*columns, F.lit(None).cast("string").alias("class_rule"), F.coalesce("own.verdict", F.lit(default)).alias("verdict"))
    if edges is None:
        return plain
    tables = Tables(pages.sparkSession)
    edges = tables.keep(edges)
    if edges.isEmpty():
        return plain
    ends = edges.select(url.alias("url")).unionByName(edges.select(F.col("target").alias("url")))
    ruled = with_rule(ends.select(node_of(url).alias("node"), host.alias("host"), path.alias("path")), rules).where("own is not null").select("node", "own")
    members = components(edges.select(node_of(url).alias("a"), node_of(F.col("target")).alias("b")), tables)
    best = F.max(F.struct((F.col("own.verdict") == "allow").alias("allow"), "own.size", "own.rule", "own.verdict"))
    classes = tables.keep(members.join(ruled, "node").groupBy("component").agg(best.alias("best")))
    decided = members.join(classes, "component").select("node", "best")
    # pages without a url have no node and pass by the join
    joined = rows.where("instr(url, '://') > 0").withColumn("node", node_of(url)).join(decided, "node", "left").drop("node")
    joined = joined.unionByName(rows.where("coalesce(instr(url, '://'), 0) = 0").withColumn("best", F.lit(None).cast(decided.schema["best"].dataType)))
    return joined.select(*columns, F.col("best.rule").alias("class_rule"), F.coalesce("own.verdict", "best.verdict", F.lit(default)).alias("verdict"))
