import itertools
import math

import numpy as np
import pandas as pd
import pytest

from assayspark.operators import correlate


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.normal(size=700)
    return pd.DataFrame({
        "x": x,
        "y": np.round(x + rng.normal(size=700), 1),
        "hot": np.where(rng.random(700) < 0.4, 0.0, rng.integers(0, 30, 700)).astype(float),
        "flat": np.ones(700),
    })


def tau_b(x, y):
    dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    scale = math.sqrt((dx != 0).sum()) * math.sqrt((dy != 0).sum())
    return (dx * dy).sum() / scale if scale else 0.0


def as_dict(long):
    return {(r["a"], r["b"]): r["r"] for r in long.collect()}


def test_pearson_with_missing_values(spark, data):
    holes = data.copy()
    holes.loc[holes.index % 3 == 0, "x"] = np.nan
    holes.loc[holes.index % 5 == 0, "hot"] = np.nan
    want = holes.corr().fillna(0)
    for wide in (16, 2):
        correlate.WIDE, before = wide, correlate.WIDE
        try:
            got = as_dict(correlate.pearson(spark.createDataFrame(holes).repartition(4), list(holes.columns)))
        finally:
            correlate.WIDE = before
        for (a, b), r in got.items():
            assert r == pytest.approx(want.loc[a, b], abs=1e-9)


@pytest.mark.parametrize("per_chunk", [100_000, 50])
def test_average_rank(spark, data, per_chunk):
    df = spark.createDataFrame(data).repartition(4)
    for c in ("x", "y", "hot", "flat"):
        out = correlate.fit_ranking(df, c, per_chunk).transform(df, "rk").toPandas()
        np.testing.assert_allclose(out["rk"], out[c].rank().to_numpy())


@pytest.mark.parametrize("per_chunk", [100_000, 50])
def test_spearman(spark, data, per_chunk):
    df = spark.createDataFrame(data).repartition(4)
    ranks = data.rank().corr().fillna(0)
    for (a, b), r in as_dict(correlate.spearman(df, list(data.columns), per_chunk)).items():
        assert r == pytest.approx(ranks.loc[a, b], abs=1e-9)


def test_spearman_ranks_each_pair_alone_when_values_are_missing(spark):
    rows = pd.DataFrame({"a": [1, 5, 3, np.nan, 2], "b": [2.0, np.nan, 1, 4, 9], "c": [5.0, 4, 3, 2, 1]})
    got = as_dict(correlate.spearman(spark.createDataFrame(rows), ["a", "b", "c"]))
    for a, b in itertools.combinations("abc", 2):
        pair = rows[[a, b]].dropna().rank()
        assert got[(a, b)] == pytest.approx(pair[a].corr(pair[b]))


@pytest.mark.parametrize("strip", [100_000, 120])
def test_kendall(spark, data, strip):
    df = spark.createDataFrame(data).repartition(4)
    for a, b in [("x", "y"), ("y", "hot"), ("hot", "flat")]:
        got = correlate.kendall_pair(df, a, b, strip) or 0.0
        assert got == pytest.approx(tau_b(data[a].to_numpy(), data[b].to_numpy()), abs=1e-12)


def test_high_pairs_and_strength(spark):
    long = spark.createDataFrame([("a", "b", -0.95), ("a", "c", 0.7), ("b", "c", 0.85), ("c", "d", 0.2)], "a string, b string, r double")
    out = correlate.strength(correlate.high_pairs(long)).collect()
    assert [(r["a"], r["b"], r["strength"]) for r in out] == [
        ("a", "b", "very strong"), ("b", "c", "strong"), ("a", "c", "medium")]


def test_square(spark):
    long = spark.createDataFrame([("a", "b", 0.5)], "a string, b string, r double")
    assert as_dict(correlate.square(long)) == {("a", "b"): 0.5, ("b", "a"): 0.5, ("a", "a"): 1.0, ("b", "b"): 1.0}
