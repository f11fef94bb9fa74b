import numpy as np
import pytest
from pyspark.sql import functions as F

from assayspark.operators import models
from assayspark.roles import TableRoles
from assayspark.sources import naming, sinks, tables, vectors


@pytest.mark.parametrize("columns, found", [
    (["a", " Vickers Hardness (HV) "], " Vickers Hardness (HV) "),
    (["hardness", "x"], "hardness"),
    (["维氏硬度（hv）"], "维氏硬度（hv）"),
    (["Image hardness", "bulk hardness", "mean HV"], "mean HV"),
    (["bulk hardness", "x"], "bulk hardness"),
    (["hardness gpa", "name hv"], None),
    (["a", "b"], None),
])
def test_find_target(columns, found):
    assert naming.find_target(columns) == found


def test_find_second_unit():
    assert naming.find_second_unit(["a", "Hardness（GPa）"]) == "Hardness（GPa）"
    assert naming.find_second_unit(["x gpa hardened"]) == "x gpa hardened"
    assert naming.find_second_unit(["pressure gpa"]) is None


def test_resolve_by_unit_and_last_column(spark):
    by_unit = tables.resolve_target(spark.createDataFrame([("1.5",), ("bad",)], "`Hardness (GPa)` string"))
    assert by_unit.columns == [naming.TARGET_NAME]
    assert [r[0] for r in by_unit.collect()] == [153.0, None]
    last = tables.resolve_target(spark.createDataFrame([("a", "1"), ("b", "x")], "k string, z string"))
    assert last.columns == ["k", naming.TARGET_NAME]
    with pytest.raises(ValueError):
        tables.resolve_target(spark.createDataFrame([("a", "q"), ("b", "x"), ("c", "1"), ("d", "y")], "k string, z string"))


def test_unit_convert(spark):
    df = spark.createDataFrame([("400", "9"), (None, "2"), ("text", "1"), (None, None)], "hv string, gpa string")
    assert [r[0] for r in tables.unit_convert(df, "hv", "gpa").collect()] == [400.0, 204.0, 102.0, None]


def test_schema_and_groups(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0, 3.0)], "Image_Name string, Al double, Micro_1 double, hv double")
    rows = {r["name"]: (r["kind"], r["role"], r["n_rows"]) for r in
            tables.describe_schema(df, TableRoles(composition=("Al",), target="hv")).collect()}
    assert rows == {"Image_Name": ("text", "other", 1), "Al": ("number", "composition", 1),
                    "Micro_1": ("number", "other", 1), "hv": ("number", "target", 1)}
    groups = naming.column_groups(df.columns)
    assert groups["composition"] == ["Image_Name", "Al"]
    assert groups["features"] == ["Micro_1"] and groups["target"] == ["Image_Name", "hv"]
    assert naming.column_groups(["q", "hv", "Al"])["features"] == ["q"]


def test_append_aligned(spark):
    old = spark.createDataFrame([(1, "a")], "id int, name string")
    both = tables.append_aligned(old, spark.createDataFrame([("b", 5)], "name string, other int"))
    assert sorted((r["id"], r["name"]) for r in both.collect() if r["id"]) == [(1, "a")] and both.count() == 2
    with pytest.raises(ValueError):
        tables.append_aligned(old, spark.createDataFrame([(5,)], "other int"))


def test_read_and_ingest(spark, tmp_path):
    source = spark.createDataFrame([(1, 2.5), (2, None)], "id int, `hardness (gpa)` double")
    for fmt, ending in (("csv", ".csv"), ("json", ".json"), ("parquet", ".parquet"), ("orc", ".orc")):
        path = sinks.export_table(source, str(tmp_path / f"t{ending}"), fmt)
        assert tables.read_table(spark, path).count() == 2
    stored = tables.ingest(spark, str(tmp_path / "t.csv"), str(tmp_path / "out"))
    assert sorted((r[0], r[1]) for r in stored.collect() if r[1]) == [(1, 255.0)]


def test_vectors(spark):
    samples = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "k string, vec array<double>")
    assert [r["k"] for r in tables.attach_vectors(samples, vectors, "k").collect()] == ["a"]
    assert [r["k"] for r in tables.missing_vectors(samples, vectors, "k").collect()] == ["b"]


def bits(vector):
    return np.array(vector, dtype=np.float32).tobytes()


def test_vector_files_come_back_bit_for_bit(spark, sf, tmp_path):
    stored = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<float>").alias("vector"))
    odd = spark.createDataFrame([(-1, [float("nan"), -0.0, 1e-45, float("inf")]), (-2, []), (None, [1.0]), (-3, None)], "name bigint, vector array<float>")
    folder = f"file:{tmp_path}/vectors"
    every = stored.unionByName(odd)
    for _ in range(2):  # a second write replaces each file by itself
        vectors.write_vectors(every, "name", "vector", folder)
    want = {str(r["name"]): bits(r["vector"]) for r in every.collect() if r["name"] is not None and r["vector"] is not None}
    for frame in (vectors.read_vectors(spark, folder), vectors.read_through_spark(spark, folder)):
        rows = frame.collect()
        assert len(rows) == len(want) and {r["name"]: bits(r["vector"]) for r in rows} == want and not any(r["problem"] for r in rows)
    assert np.load(tmp_path / "vectors" / "-1.npy").dtype == np.float32


def test_vector_files_of_other_kinds_and_broken_ones(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for name, values in {"double": np.array([1.5, 2.5]), "big": np.array([1, 2], dtype=">i4"), "deep/row": np.array([[3.0, 4.0]], dtype="f4"),
                         "matrix": np.ones((2, 2)), "words": np.array(["x"]), "scalar": np.float32(7)}.items():
        np.save(folder / f"{name}.npy", values)
    with open(folder / "second.npy", "wb") as file:
        np.lib.format.write_array(file, np.arange(3, dtype="f4"), version=(2, 0))
    whole = (folder / "double.npy").read_bytes()
    for name, data in {"empty": b"", "text": b"hello world", "cut": whole[:-4], "head": whole[:9], "half": whole[:30], "longer": whole + b"x"}.items():
        (folder / f"{name}.npy").write_bytes(data)
    (folder / "other.txt").write_text("no vector")
    rows = {r["name"]: r for r in vectors.read_vectors(spark, str(folder)).collect()}
    good = {"double": [1.5, 2.5], "big": [1, 2], "row": [3, 4], "second": [0, 1, 2], "scalar": [7]}
    assert {k: r["vector"] for k, r in rows.items() if r["problem"] is None} == good
    assert {k for k, r in rows.items() if r["vector"] is None} == {"matrix", "words", "empty", "text", "cut", "head", "half", "longer"}
    assert "shape" in rows["matrix"]["problem"] and "signature" in rows["text"]["problem"] and rows["empty"]["problem"] == "empty file"
    same = {r["name"]: (r["vector"], r["problem"]) for r in vectors.read_through_spark(spark, str(folder)).collect()}
    assert same == {k: (r["vector"], r["problem"]) for k, r in rows.items() if k != "empty"}
    listed = {r["name"]: r["problem"] for r in vectors.read_vectors(spark, str(folder), ["double", "gone"]).collect()}
    assert listed == {"double": None, "gone": "missing"}


def test_vector_partitions_follow_file_sizes(spark, tmp_path):
    sizes = [10, 10, 10, 5000, 10, 10, 2000, 2000, 2000, 10]
    for i, n in enumerate(sizes):
        np.save(tmp_path / f"{i:02}.npy", np.arange(n, dtype="f4"))
    limit = 20_000
    frame = vectors.read_vectors(spark, str(tmp_path), bytes_per_partition=limit)
    shares = frame.select("name", F.size("vector").alias("n"), F.spark_partition_id().alias("p")).collect()
    by = {}
    for r in shares:
        by.setdefault(r["p"], []).append(r["n"])
    assert len(shares) == len(sizes) and len(by) > 2
    assert all(len(ns) == 1 or sum(4 * n + 128 + vectors.OPEN_COST for n in ns) <= limit for ns in by.values())
    plan = vectors.plan([("a", 5), ("b", 10 * limit), ("c", 5)], limit)
    assert [p.paths for p in plan] == [("a",), ("b",), ("c",)] and vectors.plan([], 1) == []
    (tmp_path / "none").mkdir()
    assert vectors.read_vectors(spark, str(tmp_path / "none")).collect() == []


def test_history_export_order_and_blanks(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "u", None)], "id int, username string, n_samples int")
    rows = sinks.history_export(df, ["id", "username", "n_samples"]).collect()
    assert [tuple(r) for r in rows] == [("2", "u", ""), ("1", "", "5")]


def test_saved_model_predicts_the_same(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3.0 + 1).alias("y"))
    for name in ("LinearRegression", "LR", "PolynomialRegression", "LinearSVR", "SVR"):
        fitted = models.fit_model(name, df, ["x"], "y")
        path = sinks.save_model(spark, fitted, str(tmp_path / name), name, "y", {"a": 1})
        loaded, about = sinks.load_model(spark, path)
        before, after = ([r["prediction"] for r in m.predict(df).orderBy("x").collect()] for m in (fitted, loaded))
        assert before == after
        assert about.first()["model_name"] == name and about.first()["feature_cols"] == ["x"]
