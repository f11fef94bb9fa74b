import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayspark.operators import augment, evaluate, models, prepare


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3)) * [1.0, 5.0, 0.2] + [0, 10, 3]
    y = 3 * x[:, 0] - x[:, 1] + 20 * x[:, 2] + 200 + rng.normal(size=500)
    return pd.DataFrame({"id": range(500), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(4).cache()


X = ["a", "b", "c"]


def predicted(model, df):
    return model.predict(df).orderBy("id").toPandas()["prediction"].to_numpy()


def scaled(data):
    x = data[X].to_numpy()
    return (x - x.mean(0)) / x.std(0)


def ridge(z, y, alpha):
    zc, yc = z - z.mean(0), y - y.mean()
    w = np.linalg.solve(zc.T @ zc + alpha * np.eye(z.shape[1]), zc.T @ yc)
    return (z - z.mean(0)) @ w + y.mean()


def test_splits_are_complete_stable_and_sized(spark):
    df = spark.range(5000)
    tags = {r["id"]: r["split"] for r in prepare.train_val_test(df, ["id"]).collect()}
    again = {r["id"]: r["split"] for r in prepare.train_val_test(df.repartition(7), ["id"]).collect()}
    assert tags == again and len(tags) == 5000
    sizes = pd.Series(tags).value_counts(normalize=True)
    assert sizes["test"] == pytest.approx(0.2, abs=0.02) and sizes["val"] == pytest.approx(0.12, abs=0.02)
    two = {r["id"]: r["split"] for r in prepare.train_test(df, ["id"]).collect()}
    assert {i for i, s in two.items() if s == "test"} == {i for i, s in tags.items() if s == "test"}
    few = prepare.train_test(df, ["id"], 0.0001).where("split = 'test'").count()
    assert few == pytest.approx(250, abs=50)
    folds = prepare.folds(df, ["id"], 4).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2, 3] and min(r["count"] for r in folds) > 1100


def test_source_split_and_weights(spark):
    df = spark.createDataFrame([("real",), ("synthetic",), (None,)], "source string")
    out = prepare.source_weights(prepare.by_source(df, "source"), "source").collect()
    assert [(r["split"], r["weight"]) for r in out] == [("test", -1.0), ("train", 0.2), ("train", 0.2)]


def test_scaler_round_trip(df, data):
    scaler = prepare.fit_scaler(df, X)
    out = scaler.transform(df).orderBy("id").toPandas()
    np.testing.assert_allclose(out[X].to_numpy(), scaled(data), atol=1e-9)
    back = scaler.inverse(scaler.transform(df)).orderBy("id").toPandas()
    np.testing.assert_allclose(back[X].to_numpy(), data[X].to_numpy(), atol=1e-9)


def test_constant_columns(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "a double")
    assert {r["a"] for r in prepare.fit_scaler(df, ["a"]).transform(df).collect()} == {0.0}
    scaler = prepare.fit_range(df, "a")
    assert df.select(scaler.to_unit(F.col("a")).alias("u")).first()["u"] is None


def test_range_scaler(df, data):
    scaler = prepare.fit_range(df, "y")
    out = df.select(scaler.to_unit(F.col("y")).alias("u"), scaler.from_unit(scaler.to_unit(F.col("y"))).alias("v"), "y")
    low, high, off = out.agg(F.min("u"), F.max("u"), F.max(F.abs(F.col("v") - F.col("y")))).first()
    assert low == pytest.approx(-1) and high == pytest.approx(1) and off < 1e-9


def test_pca(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    fitted = prepare.fit_pca(df, "v", 3)
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    np.testing.assert_allclose(fitted.explained, (values / values.sum())[:3])
    out = fitted.transform(df, "v").orderBy("id").toPandas()
    np.testing.assert_allclose(out[["Micro_1", "Micro_2", "Micro_3"]].to_numpy(), (x - x.mean(0)) @ np.array(fitted.components).T, atol=1e-8)
    for axis in fitted.components:
        assert axis[np.argmax(np.abs(axis))] > 0
    assert fitted.parameters(spark).count() == 3


@pytest.mark.parametrize("d, k", [(40, 6), (6, 6), (5, 70)])
def test_pca_from_a_random_subspace(spark, d, k):
    rng = np.random.default_rng(d)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    x = rng.normal(size=(900, d)) * (0.8 ** np.arange(d)) @ turn + 3
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(-1, None), (-2, [float("nan")] * d)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(7)
    fitted = prepare.fit_pca(df, "v", k, whole=0, tolerance=1e-13)
    covariance = np.cov(x.T)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert fitted.converged and (fitted.passes > 0) == (k + 10 < d)
    np.testing.assert_allclose(fitted.variances, values, rtol=1e-9)
    np.testing.assert_allclose(fitted.explained, values / np.trace(covariance), rtol=1e-9)
    axes = np.array(fitted.components)
    np.testing.assert_allclose(np.abs((axes * vectors.T).sum(axis=1)), 1, atol=1e-6)
    np.testing.assert_allclose(covariance @ axes.T, axes.T * values, atol=1e-4)  # C v = lambda v
    out = {r["id"]: r["Micro_1"] for r in fitted.transform(df, "v").collect()}
    assert out[-1] is None and out[-2] is None and out[0] == pytest.approx((x[0] - x.mean(0)) @ axes[0])


def test_pca_of_odd_tables(spark):
    with pytest.raises(ValueError, match="no complete"):
        prepare.fit_pca(spark.createDataFrame([(None,)], "v array<double>"), "v")
    one = prepare.fit_pca(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v", 2)
    assert one.mean == (1.0, 2.0) and one.variances == (0.0, 0.0) and one.explained == (0.0, 0.0)
    with pytest.raises(Exception, match="different lengths"):
        prepare.fit_pca(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>").coalesce(1), "v", 1)


def test_polynomial_terms(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    terms = prepare.polynomial(df, ["a", "b"], 2).select(vector_to_array("expanded")).first()[0]
    assert sorted(terms) == [2.0, 3.0, 4.0, 6.0, 9.0]


def test_postprocess(spark):
    out = prepare.postprocess(spark.createDataFrame([(-1.0, -1.23456)], "s double, f double"), ["s"], ["f"]).first()
    assert tuple(out) == (0.0, -1.2346)
    kept = prepare.postprocess(spark.createDataFrame([(None,)], "s double"), ["s"]).first()
    assert kept["s"] is None


@pytest.mark.parametrize("name", ["LinearRegression", "LR", "unknown"])
def test_linear(df, data, name):
    a = np.column_stack([np.ones(500), data[X]])
    want = a @ np.linalg.lstsq(a, data["y"], rcond=None)[0]
    np.testing.assert_allclose(predicted(models.fit_model(name, df, X, "y"), df), want, atol=1e-6)


@pytest.mark.parametrize("limit", [4096, 1])
def test_ridge_on_expanded_terms(df, data, limit, monkeypatch):
    monkeypatch.setattr(models, "NORMAL_SOLVER_LIMIT", limit)
    z = scaled(data)
    terms = np.column_stack([z, *[z[:, i] * z[:, j] for i in range(3) for j in range(i, 3)]])
    fitted = models.fit_model("PolynomialRegression", df, X, "y", alpha=5.0)
    np.testing.assert_allclose(predicted(fitted, df), ridge(terms, data["y"].to_numpy(), 5.0), atol=1e-3)


def test_degree_one_ridge(df, data):
    np.testing.assert_allclose(
        predicted(models.fit_model("PR", df, X, "y"), df), ridge(scaled(data), data["y"].to_numpy(), 1.0), atol=1e-6)


def test_linear_svr_reaches_the_optimum(df, data):
    fitted = models.fit_svr(df, X, "y")
    assert fitted.converged and fitted.passes <= 60
    assert min(fitted.losses) == fitted.losses[-1] or fitted.losses[-1] <= min(fitted.losses) * 1.001
    z = np.column_stack([scaled(data), np.ones(500)])
    y = data["y"].to_numpy()

    def objective(w):
        return 0.5 * w[:-1] @ w[:-1] + np.maximum(np.abs(y - z @ w) - 0.1, 0).sum()

    best = objective(fitted.weights)
    rng = np.random.default_rng(0)
    near = [objective(fitted.weights + rng.normal(size=4) * s) for s in (0.01, 0.05, 0.2) for _ in range(200)]
    assert best <= min(near) * 1.002
    np.testing.assert_allclose(predicted(fitted, df), z @ fitted.weights, atol=1e-8)


def test_rbf_svr_follows_a_curve(spark):
    x = np.linspace(-3, 3, 400)
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "x": x, "y": 50 * np.sin(x)})).repartition(3)
    fitted = models.fit_model("SVR", df, ["x"], "y", C=10.0, map_size=64)
    score = evaluate.metrics(fitted.predict(df), "y", "prediction").first()
    assert score["r2"] > 0.98


def test_metrics(spark):
    rows = [("m", 1.0, 2.0), ("m", 0.0, 1.0), ("m", 4.0, 4.0), ("flat", 5.0, 4.0), ("flat", 5.0, 6.0), ("zero", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    out = {r["g"]: r for r in evaluate.metrics(df, "y", "p", ["g"]).collect()}
    y, p = np.array([1.0, 0, 4]), np.array([2.0, 1, 4])
    assert out["m"]["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert out["m"]["r2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert out["m"]["mape"] == pytest.approx(50.0)
    assert out["flat"]["r2"] is None and out["zero"]["mape"] == 0.0
    tiny = spark.createDataFrame([(1e-7, 1.0), (1.0, 2.0)], "y double, p double")
    assert evaluate.metrics(tiny, "y", "p", zero=1e-6).first()["mape"] == pytest.approx(100.0)


def test_large_offset_keeps_r2(spark):
    df = spark.range(1000).select((F.col("id") + 1e9).alias("y"), (F.col("id") + 1e9 + 1).alias("p"))
    y = np.arange(1000.0)
    assert evaluate.metrics(df, "y", "p").first()["r2"] == pytest.approx(1 - 1000 / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_comparison_reports_failures_and_best(df):
    rows = prepare.train_test(df, ["id"])
    folded = prepare.folds(rows, ["id"], 3)
    table = evaluate.compare_models(folded, X, "y", ["LR", "PR"], {"PR": {"degree": "bad"}}, fold="fold")
    found = {(r["model"], r["split"]): r for r in table.collect()}
    row = found[("LR", "test")]
    assert row["best"] and len(row["cv_scores"]) == 3 and row["cv_r2_mean"] == pytest.approx(sum(row["cv_scores"]) / 3)
    assert found[("LR", "test")]["r2"] > 0.9 and found[("PR", None)]["error"]
    best = evaluate.best_models(table).first()
    assert best["best_r2_model"] == best["best_rmse_model"] == "LR"


def test_cross_validation_closed_form_equals_refitting(df):
    rows = prepare.folds(df, ["id"], 3)
    quick = {r["fold"]: r["r2"] for r in evaluate.cross_validate(rows, X, "y").collect()}
    slow = {r["fold"]: r["r2"] for r in evaluate.cross_validate(rows, X, "y", model="LR").collect()}
    assert quick.keys() == slow.keys() == {0, 1, 2}
    for f in quick:
        assert quick[f] == pytest.approx(slow[f], abs=1e-6)
    frame = rows.sparkSession.createDataFrame([(0, 0.5), (1, 0.7)], "fold int, r2 double")
    summary = evaluate.cv_summary(frame).first()
    assert summary["cv_r2_mean"] == pytest.approx(0.6) and summary["cv_r2_std"] == pytest.approx(0.1)


def test_compared_models_against_plain_fits(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 50, 800)
    y = x + rng.normal(size=800) * 3
    split = np.where(np.arange(800) % 5 == 0, "test", "train")
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "split": split}))
    table = {(r["model"], r["split"]): r for r in evaluate.compare_models(df, ["x"], "y").collect()}
    fit = split == "train"
    z = (x - x[fit].mean()) / x[fit].std()
    wide = np.column_stack([z, z**2])
    centre = wide[fit].mean(axis=0)
    inner = wide[fit] - centre
    ridge = np.linalg.solve(inner.T @ inner + np.eye(2), inner.T @ (y[fit] - y[fit].mean()))
    for model, made in (("LinearRegression", np.polyval(np.polyfit(x[fit], y[fit], 1), x)), ("PolynomialRegression", (wide - centre) @ ridge + y[fit].mean())):
        for name in ("train", "test"):
            off = (y - made)[split == name]
            row = table[model, name]
            assert row["n"] == len(off) and row["rmse"] == pytest.approx(np.sqrt((off**2).mean()), rel=1e-6) and row["mae"] == pytest.approx(np.abs(off).mean(), rel=1e-6)
    for name in ("train", "test"):
        assert table["SVR", name]["rmse"] <= 1.05 * table["LinearRegression", name]["rmse"]


def test_report_order_and_pivot(spark):
    rows = [("SVR", "test", 1.0), ("LR", "train", 2.0), ("X", "train", 4.0), ("DDPG", "test", 3.0)]
    table = spark.createDataFrame(rows, "model string, split string, rmse double")
    assert [r["model"] for r in evaluate.report_order(table).collect()] == ["LR", "X", "DDPG", "SVR"]
    wide = evaluate.pivot_metric(table.where("split = 'test'"), "model", ["DDPG", "SVR"], ["rmse"]).first()
    assert (wide["DDPG"], wide["SVR"]) == (3.0, 1.0)


@pytest.mark.parametrize("n", [10, 1000])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_downsample(spark, n, kind):
    df = spark.range(n).repartition(3).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("k") if kind == "string" else F.col("id").alias("k"))
    got = sorted(int(r["k"]) for r in evaluate.downsample(df, ["k"], 30).collect())
    assert got == list(range(0, n, -(-n // 30)))


def test_metrics_skip_rows_without_a_prediction(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5), (1e6, None), (float("nan"), 1.0)], "y double, p double")
    row = evaluate.metrics(df, "y", "p").first()
    assert row["n"] == 3 and row["r2"] == pytest.approx(1 - 0.5 / 2)


def test_stored_axes_project_like_the_model(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "id int, v array<double>")
    fitted = prepare.fit_pca(df, "v", 3)
    a = fitted.transform(df, "v").orderBy("id").toPandas()
    b = prepare.project_with(df, fitted.parameters(spark), "v").orderBy("id").toPandas()
    centred = a[["Micro_1", "Micro_2", "Micro_3"]].to_numpy() - a[["Micro_1", "Micro_2", "Micro_3"]].to_numpy().mean(axis=0)
    np.testing.assert_allclose(centred, b[["Micro_1", "Micro_2", "Micro_3"]].to_numpy(), atol=1e-9)
    np.testing.assert_allclose(centred.var(axis=0, ddof=1), [r["variance"] for r in fitted.parameters(spark).collect()], atol=1e-9)


def test_extent(spark):
    out = evaluate.extent(spark.createDataFrame([(100.0, 300.0), (200.0, 50.0)], "x double, y double"), "x", "y").first()
    assert (out["axis_min"], out["axis_max"]) == (40.0, 310.0)
    assert out["plot_min"] == pytest.approx(45.0) and out["plot_max"] == pytest.approx(330.0)


def distance(a, b):
    """Largest gap between two empirical distributions."""
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    return np.abs(np.searchsorted(a, both, "right") / len(a) - np.searchsorted(b, both, "right") / len(b)).max()


def test_synthetic_rows_follow_the_joint_shape(spark):
    rng = np.random.default_rng(11)
    n = 5000
    base = rng.normal(size=n)
    real = pd.DataFrame({
        "skewed": np.exp(base), "steps": np.floor(3 * rng.random(n)) ** 2, "two": np.where(rng.random(n) < 0.3, -5.0, 5.0) + 0.1 * rng.normal(size=n),
        "falling": -base + 0.5 * rng.normal(size=n), "copy": np.exp(base), "constant": 7.0})
    df = spark.createDataFrame(real).unionByName(spark.createDataFrame([(float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0, 1.0)], ", ".join(f"{c} double" for c in real)))
    shape = augment.fit_joint(df, list(real))
    assert shape.rows == n
    np.testing.assert_allclose(shape.quantiles, [np.quantile(real[c], augment.knot_shares()) for c in real], atol=1e-9)
    np.testing.assert_allclose(shape.factor @ shape.factor.T, shape.correlation * (np.outer(real.std() > 0, real.std() > 0) | np.eye(6, dtype=bool)), atol=1e-4)
    made = augment.generate(spark, shape, 20_000).toPandas().sort_values("id", ignore_index=True)
    chance = 1.63 * math.sqrt(1 / 20_000 + 1 / n)  # one column in a hundred is further off by the draw alone
    for c in real:
        # jumps of a distribution come out as slopes between two stored quantiles
        assert distance(made[c], real[c]) <= augment.LARGEST_GAP + chance, c
        assert made[c].between(real[c].min(), real[c].max()).all() and (made[c] == real[c].max()).mean() <= (real[c] == real[c].max()).mean() + 0.001
    np.testing.assert_allclose(made["copy"], made["skewed"], atol=1e-9)
    ranks, wanted = made.drop(columns=["id", "constant"]).rank().corr(), real.drop(columns="constant").rank().corr()
    np.testing.assert_allclose(ranks, wanted, atol=0.05)
    again = augment.generate(spark, shape, 20_000).repartition(5).toPandas().sort_values("id", ignore_index=True)
    pd.testing.assert_frame_equal(made, again)


def test_normal_scores_undo_the_quantile_function():
    rng = np.random.default_rng(2)
    q = np.quantile(rng.gamma(2.0, size=3000), augment.knot_shares())
    z = np.linspace(-3.9, 3.9, 500)
    np.testing.assert_allclose(augment.normal_scores(augment.values_at(z, q), q), z, atol=1e-9)
    flat = np.concatenate([np.zeros(129), np.ones(128)])
    assert augment.normal_scores(np.array([0.0, 1.0]), flat).tolist() == [-2.0, 2.015625]
    with pytest.raises(ValueError, match="complete"):
        augment.fit_joint(SparkSession.getActiveSession().createDataFrame([], "a double"), ["a"])


def test_combine_and_fidelity(spark):
    real = spark.createDataFrame([("r", 100.0), ("s", 10.0)], "Image_Name string, a double")
    made = augment.name_rows(spark.createDataFrame([(1, 90.0)], "id int, a double")).drop("id")
    both = augment.combine(real, made)
    assert {(r["Image_Name"], r["source"]) for r in both.collect()} == {("r", "real"), ("s", "real"), ("Generated_1", "synthetic")}
    out = {r["source"]: r for r in augment.fidelity(both, ["a"], band=(85.0, 115.0)).collect()}
    assert out["real"]["valid_share"] == 0.5 and out["real"]["mean"] == 55.0 and out["synthetic"]["n"] == 1
