"""Profiles, outlier rules and correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.catalog.registry import LINE_KEY, LINE_KEY_SQL, LINE_NUMBERS, query, r, round_all, rounded, table
from assayspark.operators import correlate, outliers, profile

_STATS = {
    "min": "min({c})", "max": "max({c})", "mean": "avg({c})", "std": "stddev_samp({c})",
    "median": "quantile_cont({c}, 0.5)", "q1": "quantile_cont({c}, 0.25)", "q3": "quantile_cont({c}, 0.75)",
}


def _profile_sql(columns: list[str], stats: list[str], count: bool) -> str:
    parts = []
    for c in columns:
        cells = [r(_STATS[s].format(c=c), s, 4) for s in stats]
        head = [f"'{c}' AS \"column\"", *([f"count({c}) AS count"] if count else [])]
        parts.append(f"SELECT {', '.join(head + cells)} FROM lineitem")
    return " UNION ALL ".join(parts)


@query("prof_columns", _profile_sql(LINE_NUMBERS, list(_STATS), True))
def prof_columns(spark: SparkSession, sf: str) -> DataFrame:
    made = profile.profile_columns(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return round_all(made, *_STATS, digits=4)


@query("prof_elements", _profile_sql(["l_discount", "l_tax"], ["mean", "median", "q1", "q3", "min", "max"], False))
def prof_elements(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumn("empty", F.lit(None).cast("double"))
    return round_all(profile.profile_elements(lines, ["l_discount", "l_tax", "empty", "absent"]), *_STATS, digits=4)


@query("prof_target", f"""
SELECT count(*) AS n_samples, CAST(11 AS BIGINT) AS n_cols, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
  {r("avg(l_extendedprice)", "mean", 4)}, {r("stddev_samp(l_extendedprice)", "std", 4)},
  {r("median(l_extendedprice)", "median", 4)} FROM lineitem""")
def prof_target(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(profile.profile_target(table(spark, sf, "lineitem"), "l_extendedprice"), "mean", "std", "median", digits=4)


def _histogram_sql(column: str, source: str, bins: int) -> str:
    return f"""(WITH e AS (SELECT min({column}) AS mn, max({column}) AS mx FROM {source}),
 h AS (SELECT CAST(least(floor(({column} - mn) / (mx - mn) * {bins}::DOUBLE), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
   FROM {source}, e GROUP BY 1)
 SELECT CAST(g.i AS INTEGER) AS bin, mn + g.i * ((mx - mn) / {bins}) AS low, mn + (g.i + 1) * ((mx - mn) / {bins}) AS high,
   coalesce(h.n, 0) AS n
 FROM range({bins}) AS g(i) CROSS JOIN e LEFT JOIN h ON h.bin = g.i)"""


@query("prof_histogram", f"SELECT bin, {r('low', 'low', 7)}, {r('high', 'high', 7)}, n FROM {_histogram_sql('value', 'events', 16)}")
def prof_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(profile.histogram(table(spark, sf, "events"), "value", 16), "low", "high", digits=7)


@query("prof_hist_labels", f"""
SELECT bin, n, CAST(CAST(round(low) AS BIGINT) AS VARCHAR) || '–' || CAST(CAST(round(high) AS BIGINT) AS VARCHAR) AS label
FROM {_histogram_sql('l_extendedprice', 'lineitem', 15)}""")
def prof_hist_labels(spark: SparkSession, sf: str) -> DataFrame:
    made = profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 15)
    return profile.histogram_labels(made).select("bin", "n", "label")


@query("prof_density2d", """
WITH e AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_extendedprice) AS yl, max(l_extendedprice) AS yh FROM lineitem)
SELECT l_returnflag, CAST(least(floor((l_quantity - xl) / (xh - xl) * 20::DOUBLE), 19) AS INTEGER) AS x_bin,
  CAST(least(floor((l_extendedprice - yl) / (yh - yl) * 20::DOUBLE), 19) AS INTEGER) AS y_bin, count(*) AS n
FROM lineitem, e GROUP BY 1, 2, 3""")
def prof_density2d(spark: SparkSession, sf: str) -> DataFrame:
    return profile.density2d(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", 20)


# ----------------------------------------------------------------------- outliers

_CUTS = ", ".join(
    f"quantile_cont({c}, 0.01) AS lo{i}, quantile_cont({c}, 0.99) AS hi{i}" for i, c in enumerate(LINE_NUMBERS))
_OUTSIDE = " OR ".join(f"{c} < lo{i} OR {c} > hi{i}" for i, c in enumerate(LINE_NUMBERS))


@query("out_quantile_flag", f"""
WITH b AS (SELECT {_CUTS} FROM lineitem) SELECT {LINE_KEY_SQL}, ({_OUTSIDE}) AS is_outlier FROM lineitem, b""")
def out_quantile_flag(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(*LINE_KEY, *LINE_NUMBERS)
    return outliers.flag_outliers(lines, LINE_NUMBERS, "quantile_clip").select(*LINE_KEY, outliers.FLAG)


@query("out_quantile_clip", f"""
WITH b AS (SELECT {_CUTS} FROM lineitem)
SELECT {LINE_KEY_SQL}, {', '.join(r(f'least(greatest({c}, lo{i}), hi{i})', c, 4) for i, c in enumerate(LINE_NUMBERS))}
FROM lineitem, b""")
def out_quantile_clip(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(*LINE_KEY, *LINE_NUMBERS)
    return round_all(outliers.quantile_bounds(lines, LINE_NUMBERS).clip(lines), *LINE_NUMBERS, digits=4)


@query("out_iqr", """
WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier FROM events, b""")
def out_iqr(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "value")
    return outliers.flag_outliers(events, ["value"], "iqr").select("event_id", outliers.FLAG)


_ZSCORE_SQL = """(WITH b AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
SELECT event_id, value, abs(value - m) / s > 3 AS is_outlier FROM events, b)"""


def _zscored(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.flag_outliers(table(spark, sf, "events").select("event_id", "value"), ["value"], "zscore")


@query("out_zscore", f"SELECT event_id, is_outlier FROM {_ZSCORE_SQL}")
def out_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return _zscored(spark, sf).select("event_id", outliers.FLAG)


@query("out_isolation_forest")
def out_isolation_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Score and flag of every row; SQL has no forest, so tests hold the scores to a plain one."""
    lines = table(spark, sf, "lineitem").select(*LINE_KEY, *LINE_NUMBERS)
    made = outliers.flag_isolated(lines, LINE_KEY, LINE_NUMBERS)
    return made.select(*LINE_KEY, rounded("score").alias("score"), outliers.FLAG)


@query("out_samples", f"SELECT event_id, value FROM {_ZSCORE_SQL} WHERE is_outlier ORDER BY event_id LIMIT 50")
def out_samples(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.outlier_samples(_zscored(spark, sf), ["event_id"], ["value"])


@query("out_summary", f"""
SELECT count(*) AS total, count(*) FILTER (is_outlier) AS n_outliers, count(*) FILTER (NOT is_outlier) AS n_normal,
  {r("100.0 * count(*) FILTER (is_outlier) / count(*)", "ratio_pct", 1)} FROM {_ZSCORE_SQL}""")
def out_summary(spark: SparkSession, sf: str) -> DataFrame:
    return outliers.outlier_summary(_zscored(spark, sf))


# -------------------------------------------------------------------- correlation


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


_NET = "(SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / l_quantity AS unit FROM lineitem)"
_NET_COLUMNS = [*LINE_NUMBERS, "net", "unit"]


def _net(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        *LINE_NUMBERS,
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
    )


def _pearson_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, coalesce(corr({a}, {b}), 0) AS r FROM {_NET}" for a, b in _pairs(columns))


@query("cor_pearson", f"SELECT a, b, {r('r', 'r')} FROM ({_pearson_sql(_NET_COLUMNS)})")
def cor_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(correlate.pearson(_net(spark, sf), _NET_COLUMNS), "r")


_RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LINE_NUMBERS)


@query("cor_spearman", f"WITH k AS (SELECT {_RANKS} FROM lineitem) SELECT a, b, {r('r', 'r')} FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM k" for a, b in _pairs(LINE_NUMBERS)) + ")")
def cor_spearman(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(correlate.spearman(table(spark, sf, "lineitem"), LINE_NUMBERS), "r")


_PART_COLUMNS = ["p_partkey", "p_size", "p_retailprice"]


@query("cor_kendall", f"SELECT a, b, {r('r', 'r')} FROM (" + " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b,
  sum(sign(s.{a} - t.{a}) * sign(s.{b} - t.{b})) / sqrt(sum(abs(sign(s.{a} - t.{a})))::DOUBLE * sum(abs(sign(s.{b} - t.{b})))::DOUBLE) AS r
  FROM part s, part t WHERE s.p_partkey <> t.p_partkey""" for a, b in _pairs(_PART_COLUMNS)) + ")")
def cor_kendall(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(correlate.kendall(table(spark, sf, "part"), _PART_COLUMNS), "r")


_HIGH_SQL = f"(SELECT a, b, {r('r', 'r', 3)} FROM ({_pearson_sql(_NET_COLUMNS)}) WHERE abs(r) >= 0.6)"


@query("cor_high_pairs", f"SELECT a, b, r FROM {_HIGH_SQL}")
def cor_high_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.high_pairs(correlate.pearson(_net(spark, sf), _NET_COLUMNS), 0.6)


@query("cor_strength", f"""
SELECT a, b, r, CASE WHEN abs(r) >= 0.9 THEN 'very strong' WHEN abs(r) >= 0.8 THEN 'strong' ELSE 'medium' END AS strength
FROM {_HIGH_SQL}""")
def cor_strength(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.strength(correlate.high_pairs(correlate.pearson(_net(spark, sf), _NET_COLUMNS), 0.6))


@query("cor_top_target", f'SELECT "column", {r("v", "abs_corr")} FROM (' + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", abs(corr({c}, l_extendedprice)) AS v FROM {_NET}"
    for c in _NET_COLUMNS if c != "l_extendedprice") + ") ORDER BY v DESC LIMIT 10")
def cor_top_target(spark: SparkSession, sf: str) -> DataFrame:
    columns = [c for c in _NET_COLUMNS if c != "l_extendedprice"]
    return round_all(correlate.top_with_target(_net(spark, sf), columns, "l_extendedprice"), "abs_corr")
