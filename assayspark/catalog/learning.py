"""Preparation, splits, models, metrics and augmentation."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.catalog.registry import (
    LINE_KEY, LINE_KEY_SQL, LINE_NUMBERS, PREDICTIONS_SQL, SEED, below_sql, query, r, round_all, rounded, split_predictions, table, uniform_sql,
)
from assayspark.catalog.tables import METRICS_BODY
from assayspark.operators import augment, evaluate, models, prepare
from assayspark.plans.workspace import fresh_path

FEATURES = ["l_quantity", "p_retailprice", "p_size"]
TARGET = "l_extendedprice"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.train_test(table(spark, sf, "lineitem").select(*LINE_KEY, *LINE_NUMBERS), LINE_KEY, 0.2, SEED)


_LINES_SQL = f"""(SELECT *, CASE WHEN {below_sql(0.2, SEED, *LINE_KEY)} THEN 'test' ELSE 'train' END AS split FROM lineitem)"""
_FIT_SQL = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(LINE_NUMBERS))


@query("prep_standardize", f"""
WITH f AS (SELECT {_FIT_SQL} FROM {_LINES_SQL} WHERE split = 'train')
SELECT {LINE_KEY_SQL}, split, {', '.join(r(f'({c} - m{i}) / s{i}', c) for i, c in enumerate(LINE_NUMBERS))}
FROM {_LINES_SQL}, f""")
def prep_standardize(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    scaler = prepare.fit_scaler(rows.where("split = 'train'"), LINE_NUMBERS)
    return round_all(scaler.transform(rows), *LINE_NUMBERS)


@query("prep_inverse", f"""
SELECT {LINE_KEY_SQL}, split, {', '.join(r(c, c, 4) for c in LINE_NUMBERS)} FROM {_LINES_SQL}""")
def prep_inverse(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    scaler = prepare.fit_scaler(rows.where("split = 'train'"), LINE_NUMBERS)
    return round_all(scaler.inverse(scaler.transform(rows)), *LINE_NUMBERS, digits=4)


@query("prep_minmax_scale", f"""
WITH f AS (SELECT min({TARGET}) AS lo, max({TARGET}) AS hi FROM {_LINES_SQL} WHERE split = 'train')
SELECT {LINE_KEY_SQL}, {r(f'2 * ({TARGET} - lo) / (hi - lo) - 1', 'scaled')}, {r(TARGET, 'restored', 4)} FROM lineitem, f""")
def prep_minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    scaler = prepare.fit_range(rows.where("split = 'train'"), TARGET)
    scaled = scaler.to_unit(F.col(TARGET))
    return rows.select(*LINE_KEY, rounded(scaled).alias("scaled"), rounded(scaler.from_unit(scaled), 4).alias("restored"))


AXES = 2
_SQUARINGS = 14


def _axes_sql() -> str:
    """The first axes of the embeddings as CTEs a1, a2 (place, v): the covariance is squared until only the leading axis
    is left of it, which is taken out before the next."""
    steps = ["""x AS MATERIALIZED (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)""",
             "m AS MATERIALIZED (SELECT i, avg(v) AS m FROM x GROUP BY i)",
             "z AS MATERIALIZED (SELECT vec_id, i, v - m AS v FROM x JOIN m USING (i))",
             """c1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) / (SELECT count(*) - 1 FROM embeddings) AS v
  FROM z a JOIN z b USING (vec_id) GROUP BY a.i, b.i)"""]
    for axis in range(1, AXES + 1):
        last = f"c{axis}"
        for k in range(_SQUARINGS):
            steps.append(f"""p{axis}_{k} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) / any_value(t.t) ** 2 AS v
  FROM {last} a JOIN {last} b ON a.j = b.i, (SELECT sum(v) AS t FROM {last} WHERE i = j) t GROUP BY a.i, b.j)""")
            last = f"p{axis}_{k}"
        steps.append(f"""u{axis} AS MATERIALIZED (SELECT i, v / sqrt(sum(v * v) OVER ()) AS v FROM {last}
  WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1))""")
        steps.append(f"a{axis} AS MATERIALIZED (SELECT i, v * (SELECT CASE WHEN v < 0 THEN -1 ELSE 1 END FROM u{axis} ORDER BY abs(v) DESC LIMIT 1) AS v FROM u{axis})")
        steps.append(f"l{axis} AS MATERIALIZED (SELECT sum(a.v * c.v * b.v) AS l FROM c{axis} c JOIN a{axis} a ON a.i = c.i JOIN a{axis} b ON b.i = c.j)")
        steps.append(f"c{axis + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - l * a.v * b.v AS v FROM c{axis} c JOIN a{axis} a ON a.i = c.i JOIN a{axis} b ON b.i = c.j, l{axis})")
    return ", ".join(steps)


@query("prep_pca", f"WITH {_axes_sql()}, " + ", ".join(
    f"s{k} AS (SELECT vec_id, sum(z.v * a.v) AS s{k} FROM z JOIN a{k} a USING (i) GROUP BY vec_id)" for k in range(1, AXES + 1))
    + " SELECT vec_id, " + ", ".join(r(f"s{k}", f'"Micro_{k}"', 5) for k in range(1, AXES + 1)) + " FROM s1 " + " ".join(f"JOIN s{k} USING (vec_id)" for k in range(2, AXES + 1)))
def prep_pca(spark: SparkSession, sf: str) -> DataFrame:
    """Leading components of every vector, each axis pointing to its largest loading."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    names = [f"Micro_{k + 1}" for k in range(AXES)]
    made = prepare.fit_pca(vectors, "embedding", AXES).transform(vectors, "embedding")
    return round_all(made.select("vec_id", *names), *names, digits=5)


@query("prep_pca_params", f"WITH {_axes_sql()}" + " UNION ALL ".join(f"""
SELECT {k} AS component, CAST(i AS INTEGER) AS place, {r("v", "loading", 5)}, {r("m", "mean", 5)}, {r("l", "variance", 6)},
  {r("l / (SELECT sum(v) FROM c1 WHERE i = j)", "explained_ratio", 6)} FROM a{k} JOIN m USING (i), l{k}""" for k in range(1, AXES + 1)))
def prep_pca_params(spark: SparkSession, sf: str) -> DataFrame:
    """Loadings, means, variances and their shares from the stored parameters."""
    path = fresh_path(spark, "pca")
    prepare.fit_pca(table(spark, sf, "embeddings"), "embedding", AXES).parameters(spark).write.parquet(path)
    cells = spark.read.parquet(path).select("component", "variance", "explained_ratio", F.posexplode(F.arrays_zip("loadings", "mean")).alias("place", "c"))
    made = cells.select("component", "place", F.col("c.loadings").alias("loading"), "c.mean", "variance", "explained_ratio")
    return round_all(round_all(made, "loading", "mean", digits=5), "variance", "explained_ratio")


@query("prep_poly", f"""
SELECT {LINE_KEY_SQL}, l_quantity AS t0, {r('l_quantity * l_quantity', 't1')}, l_tax AS t2, {r('l_quantity * l_tax', 't3')},
  {r('l_tax * l_tax', 't4')} FROM lineitem""")
def prep_poly(spark: SparkSession, sf: str) -> DataFrame:
    made = prepare.polynomial(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], 2)
    terms = vector_to_array("expanded")
    shown = [terms[i] if i in (0, 2) else rounded(terms[i]) for i in range(5)]
    return made.select(*LINE_KEY, *[c.alias(f"t{i}") for i, c in enumerate(shown)])


# ------------------------------------------------------------------------- splits


@query("split_train_test", f"""
SELECT o_orderkey, CASE WHEN {below_sql(0.2, SEED, 'o_orderkey')} THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_train_test(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.train_test(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, SEED)


@query("split_train_val_test", f"""
SELECT o_orderkey, CASE WHEN {below_sql(0.2, SEED, 'o_orderkey')} THEN 'test'
  WHEN {below_sql(0.15, f'{SEED}:val', 'o_orderkey')} THEN 'val' ELSE 'train' END AS split FROM orders""")
def split_train_val_test(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.train_val_test(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], seed=SEED)


@query("split_by_source", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'test' ELSE 'train' END AS split FROM orders""")
def split_by_source(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return prepare.by_source(orders, "o_orderpriority", real="1-URGENT").drop("o_orderpriority")


@query("split_weights", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN -1.0::DOUBLE ELSE 0.2::DOUBLE END AS weight FROM orders""")
def split_weights(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return prepare.source_weights(orders, "o_orderpriority", 0.2, real="1-URGENT").drop("o_orderpriority")


def _fold_sql(*keys: str) -> str:
    text = " || '|' || ".join([f"'{SEED}:fold'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) % 5 AS INTEGER)"


@query("split_kfold", f"SELECT o_orderkey, {_fold_sql('o_orderkey')} AS fold FROM orders")
def split_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.folds(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 5, SEED)


# ------------------------------------------------------------------------- models


def _regression(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their part's price and size; part is joined as the optimiser sees fit."""
    lines = table(spark, sf, "lineitem").select(*LINE_KEY, "l_quantity", TARGET)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", "p_size")
    return prepare.train_test(lines.join(parts, "l_partkey"), LINE_KEY, 0.2, SEED)


@query("mdl_linear", f"""
SELECT {r(f"regr_slope({TARGET}, l_quantity)", "slope", 4)}, {r(f"regr_intercept({TARGET}, l_quantity)", "intercept", 3)}
FROM lineitem""")
def mdl_linear(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    stage = models.fit_linear(lines, ["l_quantity"], TARGET).model.stages[-1]
    values = [(float(stage.coefficients[0]), float(stage.intercept))]
    return round_all(round_all(spark.createDataFrame(values, "slope double, intercept double"), "slope", digits=4),
                     "intercept", digits=3)


@query("mdl_poly_ridge", f"""
WITH f AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem),
d AS (SELECT (l_quantity - m) / s AS a, ((l_quantity - m) / s) ** 2 AS b, {TARGET} AS y FROM lineitem, f),
c AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) * count(*) + 1000 AS aa,
  var_pop(b) * count(*) + 1000 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay,
  covar_pop(b, y) * count(*) AS by_ FROM d),
w AS (SELECT (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS w1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS w2, ma, mb, my FROM c)
SELECT {r("w1", "w1", 3)}, {r("w2", "w2", 3)}, {r("my - w1 * ma - w2 * mb", "intercept", 3)} FROM w""")
def mdl_poly_ridge(spark: SparkSession, sf: str) -> DataFrame:
    fitted = models.fit_poly_ridge(table(spark, sf, "lineitem"), ["l_quantity"], TARGET, degree=2, alpha=1000.0)
    stage = fitted.model.stages[-1]
    values = [(float(stage.coefficients[0]), float(stage.coefficients[1]), float(stage.intercept))]
    made = spark.createDataFrame(values, "w1 double, w2 double, intercept double")
    return round_all(made, "w1", "w2", "intercept", digits=3)


def _scored(spark: SparkSession, sf: str, name: str, **params) -> DataFrame:
    """Prediction and residual of every row; SQL cannot fit the model, so tests hold it to direct minimisation."""
    rows = _regression(spark, sf)
    fitted = models.fit_model(name, rows.where("split = 'train'"), FEATURES, TARGET, **params)
    made = evaluate.prediction_table(fitted, rows, TARGET)
    return round_all(made.select(*LINE_KEY, "split", TARGET, "prediction", "residual"), "prediction", "residual", digits=3)


@query("mdl_svr_linear")
def mdl_svr_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "LinearSVR")


@query("mdl_svr_rbf")
def mdl_svr_rbf(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf, "SVR")


_ONE_FEATURE_SQL = f"""(WITH w AS (SELECT regr_slope({TARGET}, l_quantity) AS b, regr_intercept({TARGET}, l_quantity) AS a
  FROM {_LINES_SQL} WHERE split = 'train')
SELECT {LINE_KEY_SQL}, split, {TARGET}, a + b * l_quantity AS prediction FROM {_LINES_SQL}, w)"""


@query("mdl_default", f"SELECT {LINE_KEY_SQL}, {r('prediction', 'prediction', 3)} FROM {_ONE_FEATURE_SQL}")
def mdl_default(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    fitted = models.fit_model("NoSuchModel", rows.where("split = 'train'"), ["l_quantity"], TARGET)
    return round_all(fitted.predict(rows).select(*LINE_KEY, "prediction"), "prediction", digits=3)


@query("mdl_predict", f"""
SELECT {LINE_KEY_SQL}, split, {r('prediction', 'prediction', 3)}, {r(f'{TARGET} - prediction', 'residual', 3)}
FROM {_ONE_FEATURE_SQL}""")
def mdl_predict(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf)
    fitted = models.fit_model("LinearRegression", rows.where("split = 'train'"), ["l_quantity"], TARGET)
    made = evaluate.prediction_table(fitted, rows, TARGET)
    return round_all(made.select(*LINE_KEY, "split", "prediction", "residual"), "prediction", "residual", digits=3)


# ------------------------------------------------------------------------ metrics


@query("met_regression", f"""
SELECT split, n, {r("rmse", "rmse", 4)}, {r("mae", "mae", 4)}, {r("r2", "r2")}, {r("mape", "mape", 4)}
FROM (SELECT split, {METRICS_BODY} FROM {PREDICTIONS_SQL} GROUP BY split)""")
def met_regression(spark: SparkSession, sf: str) -> DataFrame:
    made = evaluate.metrics(split_predictions(spark, sf), "y_actual", "y_pred", ["split"])
    return round_all(round_all(made, "rmse", "mae", "mape", digits=4), "r2")


_THREE_SQL = f"""(SELECT m.model, split, y_actual, y_pred * m.factor AS y_pred FROM {PREDICTIONS_SQL},
  (VALUES ('LR', 1.0::DOUBLE), ('PR', 0.9::DOUBLE), ('SVR', 1.05::DOUBLE)) AS m(model, factor))"""
_TABLE_SQL = f"(SELECT model, split, {METRICS_BODY} FROM {_THREE_SQL} GROUP BY model, split)"
_SHOWN_SQL = f"""(SELECT model, split, n, {r("rmse", "rmse", 2)}, {r("mae", "mae", 2)}, {r("r2", "r2", 4)},
  {r("mape", "mape", 2)} FROM {_TABLE_SQL})"""


def _metric_table(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of three fixed predictors that stand for fitted models."""
    factors = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(f).alias("factor")) for m, f in (("LR", 1.0), ("PR", 0.9), ("SVR", 1.05))
    ])
    rows = split_predictions(spark, sf).select("split", "y_actual", "y_pred", F.inline(factors))
    return evaluate.metrics(rows.withColumn("y_pred", F.col("y_pred") * F.col("factor")), "y_actual", "y_pred", ["model", "split"])


@query("met_display", f"SELECT * FROM {_SHOWN_SQL}")
def met_display(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.display(_metric_table(spark, sf))


@query("cmp_models")
def cmp_models(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of all default models on one feature. SQL has no kernel machine: tests hold the linear ones to their
    closed form and that one to the best line."""
    made = evaluate.compare_models(_lines(spark, sf), ["l_quantity"], TARGET)
    return round_all(round_all(made.select("model", "split", "n", "rmse", "mae", "r2", "mape"), "rmse", "mae", "mape", digits=2), "r2", digits=4)


@query("cmp_cv", f"""
WITH d AS (SELECT {_fold_sql(*LINE_KEY)} AS fold, l_quantity AS x, {TARGET} AS y FROM {_LINES_SQL} WHERE split = 'train'),
w AS (SELECT CAST(g.f AS INTEGER) AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM range(5) AS g(f) JOIN d ON d.fold <> g.f GROUP BY g.f)
SELECT d.fold, {r("1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*))", "r2")} FROM d JOIN w ON d.fold = w.fold GROUP BY d.fold""")
def cmp_cv(spark: SparkSession, sf: str) -> DataFrame:
    rows = prepare.folds(_lines(spark, sf).where("split = 'train'"), LINE_KEY, 5, SEED)
    return round_all(evaluate.cross_validate(rows, ["l_quantity"], TARGET), "r2")


@query("cmp_best", f"""
SELECT arg_max(model, r2) AS best_r2_model, {r("max(r2)", "best_r2")}, arg_min(model, rmse) AS best_rmse_model,
  {r("min(rmse)", "best_rmse", 4)} FROM {_TABLE_SQL} WHERE split = 'test'""")
def cmp_best(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(round_all(evaluate.best_models(_metric_table(spark, sf)), "best_r2"), "best_rmse", digits=4)


@query("cmp_order", f"""
SELECT * FROM {_SHOWN_SQL} ORDER BY CASE split WHEN 'train' THEN 0 ELSE 1 END,
  CASE model WHEN 'DDPG' THEN 0 WHEN 'LR' THEN 1 WHEN 'PR' THEN 2 WHEN 'SVR' THEN 3 ELSE 9 END""")
def cmp_order(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report_order(evaluate.display(_metric_table(spark, sf)))


@query("cmp_pivot", " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, max({m}) FILTER (model = 'LR') AS "LR", max({m}) FILTER (model = 'PR') AS "PR",
  max({m}) FILTER (model = 'SVR') AS "SVR" FROM {_SHOWN_SQL} WHERE split = 'test'""" for m in ("rmse", "mae", "r2", "mape")))
def cmp_pivot(spark: SparkSession, sf: str) -> DataFrame:
    shown = evaluate.display(_metric_table(spark, sf)).where("split = 'test'")
    return evaluate.pivot_metric(shown, "model", ["LR", "PR", "SVR"])


@query("sct_points", f"SELECT y_actual AS x, {r('y_pred', 'y', 4)} FROM {PREDICTIONS_SQL} WHERE split = 'test'")
def sct_points(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(evaluate.scatter_points(split_predictions(spark, sf), "y_actual", "y_pred"), "y", digits=4)


@query("sct_downsample", """
WITH n AS (SELECT greatest(1, ceil(count(*) / 300.0)::BIGINT) AS step FROM events),
p AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)
SELECT event_id, value FROM p, n WHERE place % step = 0 ORDER BY event_id LIMIT 300""")
def sct_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.downsample(table(spark, sf, "events").select("event_id", "value"), ["event_id"])


@query("sct_extent", f"""
SELECT {r("lo - 10", "axis_min", 4)}, {r("hi + 10", "axis_max", 4)}, {r("lo * 0.9", "plot_min", 4)}, {r("hi * 1.1", "plot_max", 4)}
FROM (SELECT least(min(y_actual), min(y_pred)) AS lo, greatest(max(y_actual), max(y_pred)) AS hi FROM {PREDICTIONS_SQL})""")
def sct_extent(spark: SparkSession, sf: str) -> DataFrame:
    made = evaluate.extent(split_predictions(spark, sf), "y_actual", "y_pred")
    return round_all(made, *made.columns, digits=4)


# ------------------------------------------------------------------- augmentation


def _copula_sql() -> str:
    """Quantile functions, normal scores, their correlations and the lower factor of the line items, as CTEs."""
    shares = ", ".join(f"{p!r}::DOUBLE" for p in augment.knot_shares())
    d = range(len(LINE_NUMBERS))
    reach, density = augment.REACH, f"{augment.DENSITY}.0::DOUBLE"
    quantiles = " UNION ALL ".join(f"SELECT {j} AS j, quantile_cont({c}, [{shares}]) AS q FROM lineitem" for j, c in enumerate(LINE_NUMBERS))
    values = " UNION ALL ".join(f"SELECT DISTINCT {j} AS j, {c} AS x FROM lineitem" for j, c in enumerate(LINE_NUMBERS))
    joins = " ".join(f"JOIN scored s{j} ON s{j}.j = {j} AND s{j}.x = {c}" for j, c in enumerate(LINE_NUMBERS))
    pairs = [(i, j) for i in d for j in d if i < j]
    rho = {**{(i, j): f"r{i}{j}" for i, j in pairs}, **{(j, i): f"r{i}{j}" for i, j in pairs}}
    steps = []  # the factor, one cell after the other
    for j in d:
        for i in d:
            if i >= j:
                left = " - ".join([rho[i, j] if i != j else "1.0::DOUBLE", *[f"f{i}{k} * f{j}{k}" for k in range(j)]])
                steps.append(f"sqrt({left}) AS f{j}{j}" if i == j else f"({left}) / f{j}{j} AS f{i}{j}")
    return f"""quant AS ({quantiles}),
counted AS (SELECT j, x, q, len(list_filter(q, lambda y: y < x)) AS lo, len(list_filter(q, lambda y: y <= x)) AS hi FROM ({values}) JOIN quant USING (j)),
scored AS (SELECT j, x, CASE WHEN hi > lo THEN (lo + hi - 1) / 2.0::DOUBLE ELSE lo - 1 + (x - q[lo]) / (q[lo + 1] - q[lo]) END / {density} - {reach} AS z FROM counted),
rho AS (SELECT {", ".join(f"corr(s{i}.z, s{j}.z) AS r{i}{j}" for i, j in pairs)} FROM lineitem {joins}),
factor AS (SELECT {", ".join(steps)} FROM rho)"""


def _synthetic_sql() -> str:
    """Synthetic values before they are cut and rounded: id, then one column per number."""
    d = range(len(LINE_NUMBERS))
    draw = lambda j, kind: uniform_sql(f"{SEED}:{j}:{kind}", "id")
    noise = ", ".join(f"sqrt(-2.0::DOUBLE * ln({draw(j, 'r')})) * cos({2 * math.pi!r}::DOUBLE * {draw(j, 'a')}) AS n{j}" for j in d)
    place = ", ".join(
        f"least(greatest(({' + '.join(f'f{j}{k} * n{k}' for k in range(j + 1))} + {augment.REACH}) * {augment.DENSITY}, 0), {augment.STEPS}) AS t{j}" for j in d)
    before = ", ".join(f"CAST(least(floor(t{j}), {augment.STEPS - 1}) AS INT) AS b{j}" for j in d)
    value = ", ".join(f"q{j}.q[b{j} + 1] + (t{j} - b{j}) * (q{j}.q[b{j} + 2] - q{j}.q[b{j} + 1]) AS {c}" for j, c in enumerate(LINE_NUMBERS))
    joins = " ".join(f"JOIN quant q{j} ON q{j}.j = {j}" for j in d)
    return f"""SELECT id, {value} FROM (SELECT *, {before} FROM (SELECT id, {place} FROM (
  SELECT id, {noise} FROM (SELECT unnest(range(1, count(*) + 1)) AS id FROM lineitem)), factor)) {joins}"""


@query("aug_fit", f"WITH {_copula_sql()}" + " UNION ALL ".join([
    f"""
SELECT '{c}' AS a, '' AS b, CAST(unnest(range(0, {augment.STEPS + 1})) AS INT) AS place, unnest(list_transform(q, lambda y: {r('y', digits=4)})) AS value FROM quant WHERE j = {j}"""
    for j, c in enumerate(LINE_NUMBERS)] + [
    f"SELECT '{a}', '{b}', -1, {r(f'r{i}{j}')} FROM rho" for i, a in enumerate(LINE_NUMBERS) for j, b in enumerate(LINE_NUMBERS) if i < j]))
def aug_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The stored quantiles of every column by place, and the correlation of the normal scores of every pair (place -1)."""
    shape = augment.fit_joint(table(spark, sf, "lineitem"), LINE_NUMBERS)
    rows = [(c, "", k, round(float(v), 4) + 0.0) for c, q in zip(LINE_NUMBERS, shape.quantiles, strict=True) for k, v in enumerate(q)]
    rows += [(a, b, -1, round(float(shape.correlation[i, j]), 6) + 0.0) for i, a in enumerate(LINE_NUMBERS) for j, b in enumerate(LINE_NUMBERS) if i < j]
    return spark.createDataFrame(rows, "a string, b string, place int, value double")


def _synthetic(spark: SparkSession, sf: str) -> DataFrame:
    """As many synthetic rows as there are real ones."""
    shape = augment.fit_joint(table(spark, sf, "lineitem"), LINE_NUMBERS)
    made = augment.generate(spark, shape, shape.rows, SEED)
    return prepare.postprocess(augment.name_rows(made), LINE_NUMBERS)


@query("aug_generate", f"""WITH {_copula_sql()}
SELECT 'Generated_' || id AS "Image_Name", {", ".join(r(f"greatest({c}, 0)", c, 4) for c in LINE_NUMBERS)} FROM ({_synthetic_sql()})""")
def aug_generate(spark: SparkSession, sf: str) -> DataFrame:
    return _synthetic(spark, sf).select("Image_Name", *LINE_NUMBERS)


@query("aug_name", "SELECT c_custkey, 'Generated_' || (c_custkey + 1) AS \"Image_Name\" FROM customer")
def aug_name(spark: SparkSession, sf: str) -> DataFrame:
    numbered = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") + 1).alias("id"))
    return augment.name_rows(numbered).drop("id")


_COMBINED_SQL = """(SELECT o_totalprice AS price, 'real' AS source FROM orders
  UNION ALL SELECT l_extendedprice, 'synthetic' FROM lineitem)"""


def _combined(spark: SparkSession, sf: str) -> DataFrame:
    real = table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"), "o_orderkey")
    return augment.combine(real, table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("price")))


@query("aug_combine", f"SELECT price, source FROM {_COMBINED_SQL}")
def aug_combine(spark: SparkSession, sf: str) -> DataFrame:
    return _combined(spark, sf)


@query("aug_fidelity", f"""
SELECT source, count(*) AS n, {r("avg(CASE WHEN price BETWEEN 1000 AND 90000 THEN 1.0 ELSE 0.0 END)", "valid_share")}, 'price' AS "column",
  {r("avg(price)", "mean", 4)}, {r("stddev_samp(price)", "std", 4)} FROM {_COMBINED_SQL} GROUP BY source""")
def aug_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    made = augment.fidelity(_combined(spark, sf), ["price"], band=(1000.0, 90000.0))
    return round_all(round_all(made, "mean", "std", digits=4), "valid_share")
