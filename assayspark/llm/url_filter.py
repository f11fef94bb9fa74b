"""URL filters with redirect equivalence, in DataFrame operations only.

Rules decide first: of those that fit an address the longest wins. Pages that declare another
address, by a canonical link or an immediate redirect, are edges of a graph of addresses (host,
path and query; the scheme and the fragment do not matter), whether or not an address is a page of the table. In a connected component without any
address allowed by a rule, one address blocked by a rule blocks all that no rule decides; an allowed
address keeps such a block from spreading. Everything else is allowed.

Defined cases: null urls and urls without ``://`` have an empty host and path, fit no rule and
belong to no component; null html declares nothing; repeated rows are judged alike; an empty table
gives no rows. A declared address that is relative is taken relative to the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.llm.components import connected_components
from assayspark.llm.shared import fresh, materialize, query, table

#: The rules of the query, verdict and host with path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?\s*[0-9.]*\s*;?\s*url\s*=\s*[\"']?([^\"'\s>]+)"


def _fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    return _fold(F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path and query; null where there is no host."""
    rest = F.regexp_extract(_after_scheme(url), "^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def decide(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        match = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        fits.append(F.when(match, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def declared(html: Column, url: Column) -> Column:
    """Addresses that a page declares itself to be."""
    def absolute(href: Column) -> Column:
        folder = F.regexp_replace(path_of(url), "[^/]*$", "")
        own = F.concat(F.lit("x://"), host_of(url))
        return (
            F.when(href == "", None).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
            .when(href.startswith("//"), F.concat(F.lit("x:"), href)).when(href.startswith("/"), F.concat(own, href))
            .when(href.startswith("?"), F.concat(own, path_of(url), href)).when(href.startswith("#"), None)
            .otherwise(F.concat(own, F.when(folder == "", "/").otherwise(folder), href))
        )

    found = lambda p: absolute(F.regexp_replace(F.coalesce(F.regexp_extract(html, p, 1), F.lit("")), "&amp;", "&"))
    maybe = lambda word, p: F.when(F.contains(F.lower(html), F.lit(word)), address_of(found(p)))
    return F.array_compact(F.array(maybe("canonical", _LINK), maybe("refresh", _REFRESH)))


def declared_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): a page's address and another that it declares."""
    own = address_of(F.col(url))
    edges = pages.select(own.alias("a"), F.explode(declared(F.col(html), F.col(url))).alias("b"))
    return edges.where(F.col("a").isNotNull() & (F.col("a") != F.col("b")))


def component_verdicts(edges: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(address, inherited): what rules on any address of a component mean for the undecided ones."""
    roots = materialize(connected_components(edges), "components")
    as_url = F.concat(F.lit("x://"), F.col("node"))
    rule = decide(host_of(as_url), path_of(as_url), rules)
    ruled = roots.withColumn("verdict", rule["verdict"])
    flags = ruled.groupBy("root").agg(
        F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked"))
    no = F.lit(False)
    inherited = F.when(F.coalesce("blocked", no) & ~F.coalesce("allowed", no), "block").otherwise("allow")
    return roots.join(flags.select("root", inherited.alias("inherited")), "root").select(F.col("node").alias("address"), "inherited")


def filter_urls(
    pages: DataFrame, edges: DataFrame | None = None, url: str = "url", html: str = "html", rules: list[tuple[str, str]] = RULES,
) -> DataFrame:
    """The pages with host, path, rule, verdict; ``edges`` are further redirects as (a, b) addresses."""
    found = declared_edges(pages, url, html)
    if edges is not None:
        found = found.unionByName(edges.select("a", "b"))
    told = materialize(component_verdicts(materialize(found.distinct(), "declared"), rules), "verdicts")
    names = {n: fresh(pages, n) for n in ("host", "path", "rule", "verdict", "address", "decision", "inherited")}
    out = pages.withColumns({
        names["host"]: host_of(F.col(url)), names["path"]: path_of(F.col(url)), names["address"]: address_of(F.col(url)),
    })
    out = out.withColumn(names["decision"], decide(F.col(names["host"]), F.col(names["path"]), rules))
    told = told.select(F.col("address").alias(names["address"]), F.col("inherited").alias(names["inherited"]))
    out = out.join(told, names["address"], "left")
    decision = F.col(names["decision"])
    return out.select(
        *pages.columns, names["host"], names["path"], decision["rule"].alias(names["rule"]),
        F.coalesce(decision["verdict"], F.col(names["inherited"]), F.lit("allow")).alias(names["verdict"]))


_SQL = r"""
WITH RECURSIVE q AS (SELECT page_id, html, instr(url, '://') AS cut, substr(url, instr(url, '://') + 3) AS rest FROM pages),
p AS (SELECT page_id, html, CASE WHEN cut > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN cut > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN cut > 0 THEN regexp_extract(rest, '^[^/?#]*([^#]*)', 1) ELSE '' END AS tail FROM q),
rules AS (SELECT * FROM (VALUES %s) AS v(verdict, rule, name, start)),
ruled AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN rules
  ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id),
tags AS (
  SELECT host, path, tail, regexp_extract_all(html, '(?is)<link\b[^>]*') AS found, '(?is)\brel\s*=\s*["'']?canonical\b' AS mark,
    '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)' AS target FROM p
  UNION ALL SELECT host, path, tail, regexp_extract_all(html, '(?is)<meta\b[^>]*'), '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b',
    '(?is)\bcontent\s*=\s*["'']?\s*[0-9.]*\s*;?\s*url\s*=\s*["'']?([^"''\s>]+)' FROM p),
links AS (SELECT host, path, host || tail AS a, replace(regexp_extract(
    list_filter(found, lambda t: regexp_matches(t, mark) AND regexp_matches(t, target))[1], target, 1), '&amp;', '&') AS href FROM tags),
whole AS (SELECT a, CASE WHEN href = '' OR starts_with(href, '#') THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN 'x:' || href WHEN starts_with(href, '/') THEN 'x://' || host || href
    WHEN starts_with(href, '?') THEN 'x://' || host || path || href
    ELSE 'x://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || href END AS link FROM links WHERE host <> ''),
aim AS (SELECT a, substr(link, instr(link, '://') + 3) AS rest FROM whole WHERE link IS NOT NULL),
e AS (SELECT a, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b FROM aim WHERE regexp_extract(rest, '^[^/?#]*') <> ''),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a AS start, a AS node FROM u UNION SELECT start, b FROM reach JOIN u ON node = a),
judged AS (SELECT node, arg_max(verdict, length(rule)) AS verdict FROM (SELECT DISTINCT a AS node FROM u) JOIN rules
  ON (regexp_extract(node, '^[^/?#]*') = name OR ends_with(regexp_extract(node, '^[^/?#]*'), '.' || name))
  AND starts_with(regexp_extract(node, '^[^/?#]*([^?#]*)', 1), start) GROUP BY node),
seen AS (SELECT start, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS blocked FROM reach JOIN judged USING (node) GROUP BY start)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN ruled USING (page_id) LEFT JOIN seen ON start = host || tail""" % ", ".join(
    "('{}', '{}', '{}', '/{}')".format(v, rule, rule.partition("/")[0], rule.partition("/")[2]) for v, rule in RULES)


@query("op1_url_filter", _SQL)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict")
