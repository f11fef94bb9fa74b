import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayspark.operators import outliers, profile

NAN = float("nan")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    return pd.DataFrame({"id": range(400), "a": rng.normal(size=400), "b": rng.exponential(size=400)})


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data).repartition(4)


def flags(out):
    return out.orderBy("id").toPandas()["is_outlier"].to_numpy()


@pytest.mark.parametrize("method", ["quantile_clip", "iqr", "zscore"])
def test_rules_agree_with_pandas(df, data, method):
    x = data[["a", "b"]]
    if method == "quantile_clip":
        low, high = x.quantile(0.01), x.quantile(0.99)
    elif method == "iqr":
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    else:
        low, high = x.mean() - 3 * x.std(ddof=0), x.mean() + 3 * x.std(ddof=0)
    want = ((x < low) | (x > high)).any(axis=1).to_numpy()
    out = outliers.flag_outliers(df, ["a", "b"], method)
    assert (flags(out) == want).all()
    summary = outliers.outlier_summary(out).first()
    assert (summary["total"], summary["n_outliers"]) == (400, want.sum())
    assert summary["ratio_pct"] == pytest.approx(round(100 * want.sum() / 400, 1))


def test_incomplete_rows_are_dropped_and_constant_columns_pass(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, None, 1.0), (3, NAN, 1.0), (4, 6.0, 1.0)], "id int, a double, c double")
    out = outliers.flag_outliers(df, ["a", "c"], "zscore")
    assert sorted(r["id"] for r in out.collect()) == [1, 4] and not any(r["is_outlier"] for r in out.collect())


def test_empty_input(spark):
    df = spark.createDataFrame([], "id int, a double")
    for method in ("quantile_clip", "iqr", "zscore"):
        assert outliers.outlier_summary(outliers.flag_outliers(df, ["a"], method)).first()["total"] == 0
    assert profile.histogram(df, "a").count() == 0
    assert profile.profile_columns(df, ["a"]).count() == 0
    with pytest.raises(ValueError):
        outliers.flag_outliers(df, ["a"], "nope")


def test_clip_stays_inside_and_keeps_missing(spark, df, data):
    bounds = outliers.quantile_bounds(df, ["a"])
    low, high = bounds.clip(df).agg(F.min("a"), F.max("a")).first()
    assert low == bounds.low["a"] and high == bounds.high["a"]
    holes = spark.createDataFrame([(None,), (NAN,), (99.0,)], "a double")
    assert [r["a"] for r in bounds.clip(holes).collect()] == [None, None, bounds.high["a"]]


def test_samples_are_the_first_by_key(df):
    out = outliers.flag_outliers(df, ["a", "b"], "iqr")
    want = [r["id"] for r in out.where("is_outlier").orderBy("id").collect()][:3]
    assert [r["id"] for r in outliers.outlier_samples(out, ["id"], ["a"], 3).collect()] == want


@pytest.mark.parametrize("trees, size", [(50, 64), (5, 16)])
def test_isolation_forest_finds_planted_outliers(spark, trees, size):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(590, 2)), rng.normal(size=(10, 2)) + 12])
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1]})).repartition(3)
    out = outliers.flag_isolated(df, ["id"], ["a", "b"], 10 / 600, trees, size).toPandas()
    found = set(out[out["is_outlier"]]["id"])
    assert len(found & set(range(590, 600))) >= 8 and len(found) <= 11
    again = outliers.flag_isolated(df.repartition(7), ["id"], ["a", "b"], 10 / 600, trees, size).toPandas()
    assert set(again[again["is_outlier"]]["id"]) == found


def test_isolation_scores_equal_a_plain_walk(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    forest = outliers.fit_isolation_forest(df, ["id"], ["a", "b", "c"], 20, 32)
    got = {r["id"]: (r["score"], r["is_outlier"]) for r in outliers.flag_isolated(df, ["id"], ["a", "b", "c"], 0.1, 20, 32).collect()}

    def expected(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def walk(tree, row):
        node, depth = 0, 0
        while tree["feature"][node] >= 0:
            node, depth = int(tree["left" if row[tree["feature"][node]] <= tree["cut"][node] else "right"][node]), depth + 1
        return depth + expected(tree["size"][node])

    assert len(forest.trees) == 20 and all(t["size"][0] == 32 for t in forest.trees)
    scores = [2 ** (-sum(walk(t, row) for t in forest.trees) / 20 / expected(32)) for row in x]
    np.testing.assert_allclose([got[i][0] for i in range(300)], scores, atol=1e-12)
    assert {i for i in got if got[i][1]} == {i for i in range(300) if scores[i] > np.quantile(scores, 0.9)}


def test_profile(df, data):
    out = profile.profile_columns(df, skip=["id"]).toPandas().set_index("column")
    for c in ("a", "b"):
        want = data[c].describe()
        got = out.loc[c]
        np.testing.assert_allclose(
            [got["count"], got["mean"], got["std"], got["min"], got["q1"], got["median"], got["q3"], got["max"]], want.to_numpy())
    approx = profile.profile_columns(df, ["a"], approx=True).first()
    assert approx["median"] == pytest.approx(data["a"].median(), abs=0.1)
    target = profile.profile_target(df, "a").first()
    assert target["n_samples"] == 400 and target["n_cols"] == 3 and target["median"] == pytest.approx(data["a"].median())


def test_histogram_equals_numpy(df, data, spark):
    counts, edges = np.histogram(data["b"], bins=16)
    out = profile.histogram(df, "b", 16).orderBy("bin").toPandas()
    assert (out["n"].to_numpy() == counts).all()
    np.testing.assert_allclose(out["low"], edges[:-1])
    np.testing.assert_allclose(out["high"], edges[1:])
    same = spark.createDataFrame([(3.0,), (3.0,)], "a double")
    alike = profile.histogram(same, "a", 4).orderBy("bin").toPandas()
    assert (alike["n"].to_numpy() == np.histogram([3.0, 3.0], bins=4)[0]).all()
    assert profile.histogram_labels(profile.histogram(same, "a", 1)).first()["label"] == "3–4"


def test_density(df, data):
    cells = profile.density2d(df.withColumn("g", F.lit("x")), "a", "b", "g", 8)
    want = np.histogram2d(data["a"], data["b"], bins=8)[0]
    for r in cells.collect():
        assert want[r["x_bin"], r["y_bin"]] == r["n"]
    smooth = profile.density2d(df.withColumn("g", F.lit("x")), "a", "b", "g", 8, smooth=True)
    kernel = np.outer([0.5, 1, 0.5], [0.5, 1, 0.5]) / 4
    padded = np.pad(want, 1)
    expected = sum(kernel[i, j] * padded[i:i + 8, j:j + 8] for i in range(3) for j in range(3))
    for r in smooth.collect():
        assert r["density"] == pytest.approx(expected[r["x_bin"], r["y_bin"]])


def test_source_counts(spark):
    df = spark.createDataFrame([("real", 100.0), ("real", 1.0), ("gan", 90.0), (None, 500.0)], "source string, a double")
    assert tuple(profile.source_counts(df, "source", ["a"]).first()) == (2, 1, 2, 1, 2)
