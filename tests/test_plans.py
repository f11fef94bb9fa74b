"""The distributed paths are forced with tiny limits and compared with plain computations."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayspark.plans import chunks, positions, quantiles
from assayspark.plans.chunks import Running


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows; one timestamp-like value holds a third of them."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        t = 500 if rng.random() < 0.34 else rng.randrange(1000)
        rows.append((i, key, t, rng.choice([None, *range(20)]), rng.choice(["", "x", "y", None])))
    return rows


SCHEMA = "id int, k string, t int, v int, label string"


@pytest.mark.parametrize("per_chunk", [10_000, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_running_values(spark, skewed, per_chunk, descending):
    df = frame(spark, skewed, SCHEMA)
    specs = [
        Running("n", "count"), Running("s", "sum", F.col("v")), Running("m", "max", F.col("v")),
        Running("prev", "max", F.col("v"), inclusive=False), Running("lo", "min", F.col("v")),
        Running("lab", "last", F.when(F.col("label") != "", F.col("label"))),
    ]
    out = chunks.running(df, ["k"], ["t", "id"], specs, descending, rows_per_chunk=per_chunk).collect()
    got = {row["id"]: row for row in out}
    assert len(out) == len(skewed) == len(got)
    for key in {r[1] for r in skewed}:
        part = sorted((r for r in skewed if r[1] == key), key=lambda r: (r[2], r[0]), reverse=descending)
        seen, label = [], None
        for n, (i, _, _, v, text) in enumerate(part, 1):
            prev = max(seen) if seen else None
            if v is not None:
                seen.append(v)
            label = text or label
            row = got[i]
            assert row["n"] == n and row["prev"] == prev and row["lab"] == label
            assert row["s"] == (sum(seen) if seen else None)
            assert row["m"] == (max(seen) if seen else None) and row["lo"] == (min(seen) if seen else None)


def test_chunks_split_a_frequent_value_by_the_second_column(spark, skewed):
    df = frame(spark, skewed, SCHEMA)
    parts, names = chunks.fit_chunks(df, ["t", "id"], 40).transform(df)
    assert names == ["__chunk0", "__chunk1"]
    biggest = parts.groupBy(*names).count().agg(F.max("count")).first()[0]
    assert biggest < 150


def test_rows_at(spark, skewed):
    df = frame(spark, skewed, SCHEMA)
    wanted = [1, 2, 300, 301, 450, 900]
    got = {r["id"] for r in positions.rows_at(df, positions.ordering(df, ["t", "id"]), wanted).collect()}
    ordered = sorted(skewed, key=lambda r: (r[2], r[0]))
    assert got == {ordered[p - 1][0] for p in wanted}


@pytest.mark.parametrize("budget", [10_000_000, 60])
def test_exact_quantiles(spark, budget):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({
        "a": rng.normal(size=3000),
        "b": np.where(rng.random(3000) < 0.4, 7.0, rng.integers(0, 50, 3000)).astype(float),
        "c": np.full(3000, 2.5),
        "d": np.where(rng.random(3000) < 0.9, np.nan, rng.random(3000)),
    })
    df = spark.createDataFrame(data).repartition(6)
    probs = [0.0, 0.01, 0.25, 0.333, 0.5, 0.75, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, list(data.columns), probs, budget)
    for c in data.columns:
        np.testing.assert_allclose(got[c], data[c].quantile(probs).to_numpy(), rtol=1e-9)


def test_exact_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert quantiles.exact_quantiles(df, ["a"], [0.5]) == {"a": [None]}
    assert quantiles.exact_quantiles(df, ["a"], [0.5], budget=-1) == {"a": [None]}


@pytest.mark.parametrize("per_chunk", [10_000, 25])
def test_group_quantiles(spark, skewed, per_chunk):
    df = frame(spark, skewed, SCHEMA)
    out = quantiles.group_quantiles(df, ["k"], "v", [0.5, 0.9], ["med", "p90"], per_chunk).collect()
    data = pd.DataFrame(skewed, columns=["id", "k", "t", "v", "label"])
    want = data.groupby("k", dropna=False)["v"].quantile([0.5, 0.9]).unstack()
    assert len(out) == len(want)
    for row in out:
        mine = want[want.index.isna()] if row["k"] is None else want.loc[[row["k"]]]
        assert math.isclose(row["med"], mine[0.5].iloc[0]) and math.isclose(row["p90"], mine[0.9].iloc[0])


def test_group_of_nulls_keeps_its_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    out = {r["k"]: r["m"] for r in quantiles.group_quantiles(df, ["k"], "v", [0.5], ["m"]).collect()}
    assert out == {"a": 1.0, "b": None}


def test_timestamps_keep_their_order_without_a_time_zone(spark):
    df = spark.sql("""SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-03-10 02:30:00.000001'), (TIMESTAMP_NTZ'2024-03-10 03:00:00'),
      (TIMESTAMP_NTZ'1969-12-31 23:59:59.5'), (CAST(NULL AS TIMESTAMP_NTZ)) AS t(ts)""")
    got = [r[0] for r in df.select(chunks.as_ordinal(df, "ts")).collect()]
    assert got == [1710037800000001.0, 1710039600000000.0, -500000.0, -math.inf]


def test_exact_quantiles_with_infinite_values(spark):
    values = [math.inf] * 300 + [-math.inf] * 200 + [float(i) for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(4)
    ordered = sorted(values)
    ranks = [100, 250, 700, 1150, 1400]
    got = quantiles.exact_quantiles(df, ["a"], [k / 1499 for k in ranks], budget=50)["a"]
    assert got == pytest.approx([ordered[k] for k in ranks])


def test_quantile_functions_from_tallies(spark):
    rng = np.random.default_rng(8)
    real = pd.DataFrame({"a": rng.normal(size=3000), "b": np.floor(rng.random(3000) * 4), "c": 2.0})
    df = spark.createDataFrame(real).unionByName(spark.createDataFrame([(None, float("nan"), None)], "a double, b double, c double")).repartition(6)
    shares = [0.0, *np.sort(rng.random(200)).tolist(), 1.0]
    for given in ({}, {"budget": 10, "rows_per_chunk": 100}):
        found = quantiles.quantile_functions(df, ["a", "b", "c"], shares, **given)
        for c in real:
            np.testing.assert_allclose(found[c], np.quantile(real[c], shares), atol=1e-12)
    none = quantiles.quantile_functions(df.select("a").unionByName(df.select(F.lit(None).cast("double").alias("e")), allowMissingColumns=True), ["a", "e"], [0.5], budget=10)
    assert none["e"] == [None] and none["a"][0] == pytest.approx(np.median(real["a"]))
