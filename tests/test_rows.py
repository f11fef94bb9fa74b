import math

import pytest
from pyspark.sql import functions as F

from assayspark.operators import filters, query, rows

NAN = float("nan")


@pytest.fixture(scope="module")
def t(spark):
    data = [(1, "x", 5.0), (2, "y", None), (3, "x", NAN), (4, None, 1.0), (5, "Yz", 9.0)]
    return spark.createDataFrame(data, "id int, g string, v double")


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("op, value, kept", [
    (">", 1, [1, 5]), (">=", 1, [1, 4, 5]), ("<", 9, [1, 4]), ("<=", 9, [1, 4, 5]), ("=", 5, [1]),
    ("!=", 5, [2, 3, 4, 5]), ("between", "1,5", [1, 4]), (">", "text", [1, 2, 3, 4, 5]), ("between", "1", [1, 2, 3, 4, 5]),
])
def test_filters(t, op, value, kept):
    assert ids(query.apply_filters(t, [{"col": "v", "op": op, "val": value}])) == kept


def test_filters_on_text(t):
    assert ids(query.apply_filters(t, [{"col": "g", "op": "contains", "val": "^[xY]"}])) == [1, 3, 5]
    assert ids(query.apply_filters(t, [{"col": "g", "op": "=", "val": 1}])) == []
    assert ids(query.apply_filters(t, [{"col": "g", "op": "!=", "val": 1}])) == [1, 2, 3, 4, 5]
    assert ids(query.apply_filters(t, [{"col": "g", "op": ">", "val": 1}, {"col": "zz", "op": ">", "val": 1}])) == [1, 2, 3, 4, 5]


def test_build_orders_missing_values_last(t):
    request = {"order_by": {"col": "v", "desc": True}, "columns": ["id"], "limit": 0}
    clean = t.where(~F.isnan("v") | F.col("v").isNull())
    assert [r["id"] for r in query.build(clean, {**request, "limit": 10}, ["id"]).collect()] == [5, 1, 4, 2]
    assert query.build(t, request, ["id"]).count() == 1


def test_aggregate_parity_switch(t):
    request = {"aggregate": {"func": "count"}, "filters": [{"col": "v", "op": ">", "val": 1}]}
    assert query.build(t, request).first()["count"] == 2
    assert query.build(t, request, filters_first=False).first()["count"] == 5


def test_group_keeps_null_group_last(t):
    out = query.aggregate(t, "count", group_by=["g"]).collect()
    assert [(r["g"], r["count"]) for r in out] == [("Yz", 1), ("x", 2), ("y", 1), (None, 1)]
    with pytest.raises(ValueError):
        query.aggregate(t, "avg", "nope")
    with pytest.raises(ValueError):
        query.aggregate(t, "count", group_by=["nope"])


def test_sum_and_product_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert query.aggregate(df, "sum", "v", ["g"]).first()["sum_v"] == 0
    assert query.aggregate(df, "prod", "v", ["g"]).first()["prod_v"] == 1


def test_sum_band_counts_missing_as_zero(spark):
    df = spark.createDataFrame([(1, 60.0, 40.0), (2, 99.0, None), (3, None, 10.0), (4, NAN, 115.0)], "id int, a double, b double")
    assert ids(filters.sum_band(df, ["a", "b"])) == [1, 2, 4]
    report = filters.sum_band_report(df, ["a", "b"]).first()
    assert (report["n_before"], report["n_after"], report["min_sum"], report["max_sum"]) == (4, 3, 99.0, 115.0)


def test_keywords(t):
    assert ids(filters.keyword_any(t, "Y")) == [2, 5]
    assert ids(filters.keyword_any(t, " ")) == [1, 2, 3, 4, 5]
    assert ids(filters.keyword_fields(t, "9", ["g"])) == []
    assert ids(filters.keyword_any(t, "9.")) == [5]


def test_drop_missing(t):
    assert ids(filters.drop_missing(t, ["v"])) == [1, 4, 5]


def test_owner(spark):
    df = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id int, user_id bigint")
    assert ids(filters.owned_by(df, 7)) == [1]
    assert ids(filters.owned_by(df, None)) == []
    assert ids(filters.owned_by(df, 7, admin=True)) == [1, 2, 3]


def test_history_day_bounds(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 'a', 's', TIMESTAMP'2024-01-02 23:59:59.5'), (2, 'a', 's', TIMESTAMP'2024-01-03 00:00:00'),
      (3, 'b', 's', TIMESTAMP'2024-01-02 00:00:00') AS t(id, algorithm, data_source, created_at)""")
    assert ids(filters.history_filter(df, date_from="2024-01-02", date_to="2024-01-02")) == [1, 3]
    assert ids(filters.history_filter(df, algorithm="a", data_source="s")) == [1, 2]
    assert ids(filters.retain_days(df, "2024-01-04 00:00:00", 1)) == [2]


def test_row_edits(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, g string, v double")
    edits = rows.edits_frame(df, [{"id": 2, "v": 9.0, "zz": 1}])
    assert [tuple(r) for r in rows.update_rows(df, edits, ["id"]).orderBy("id").collect()] == [(1, "a", 1.0), (2, "b", 9.0)]
    assert ids(rows.delete_rows(df, edits, ["id"])) == [1]
    twice = spark.createDataFrame([(2, 1, 5.0, None), (2, 2, 6.0, ["g"])], "id int, n int, v double, gone array<string>")
    assert [tuple(r) for r in rows.update_rows(df, twice, ["id"], ["n"], "gone").orderBy("id").collect()] == [(1, "a", 1.0), (2, None, 6.0)]
    with pytest.raises(Exception, match="several edits"):
        rows.update_rows(df, twice, ["id"]).collect()
    added = rows.insert_rows(df, rows.edits_frame(df, [{"id": 3}]))
    assert [tuple(r) for r in added.where("id = 3").collect()] == [(3, None, None)]


def test_upsert(spark):
    stored = spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], "k string, v string, at int")
    changes = spark.createDataFrame([("a", "2", 5), ("a", "3", 7)], "k string, v string, at int")
    defaults = spark.createDataFrame([("b", "d"), ("c", "d")], "k string, v string")
    out = rows.upsert_settings(stored, changes, ["k"], "v", ["at"], defaults)
    assert {r["k"]: r["v"] for r in out.collect()} == {"a": "3", "b": "1", "c": "d"}


@pytest.mark.parametrize("deep", [10_000, 0])
@pytest.mark.parametrize("descending", [False, True])
def test_pages_cover_the_table_once(spark, deep, descending):
    data = [(i, None if i % 7 == 0 else float(i % 5)) for i in range(103)]
    df = spark.createDataFrame(data, "id int, v double").repartition(3)
    want = sorted(data, key=lambda r: (r[1] is None, 0 if r[1] is None else (-r[1] if descending else r[1]), r[0]))
    got = []
    for page in range(1, 12):
        found = rows.page_rows(df, ["id"], page, 10, "v", descending, deep=deep)
        got += [r["id"] for r in found.collect()]
    assert got == [r[0] for r in want]


@pytest.mark.parametrize("deep", [10_000, 0])
def test_pages_are_exact_for_any_key(spark, deep):
    """Keys beyond 2^53, text keys and NaN: every row once, whatever the partitions of each page."""
    big = 2**60
    data = [(big + i, f"k{i:03d}", NAN if i % 3 == 0 else None if i % 3 == 1 else float(i)) for i in range(60)]
    for key, sort in (("n", None), ("s", None), ("s", "v")):
        got = []
        for page in range(1, 7):
            df = spark.createDataFrame(data, "n bigint, s string, v double").repartition(page)
            got += [r["n"] - big for r in rows.page_rows(df, [key], page, 10, sort, True, deep=deep).collect()]
        missing = [i for i in range(60) if i % 3 < 2]
        assert got == (list(range(60)) if sort is None else [i for i in range(59, -1, -1) if i % 3 == 2] + missing)


def test_fetch_page_counts_matches(t):
    page = rows.fetch_page(t, ["id"], "x", page=1, size=1)
    assert page.total == 2 and ids(page.items) == [1]


def test_preview_puts_named_columns_first(t):
    out = rows.preview(t, ["id"], ["v"], n=2, others=0)
    assert out.columns == ["id", "v"] and out.count() == 2


def test_nullify_owner(spark):
    dep = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, user_id int")
    out = rows.nullify_owner(dep, spark.createDataFrame([(7,)], "uid int"), "user_id", "uid")
    assert {r["id"]: r["user_id"] for r in out.collect()} == {1: 7, 2: None, 3: None}


def test_first_and_last_need_an_order(t):
    with pytest.raises(ValueError):
        query.aggregate(t, "first", "v", ["g"])
    clean = t.dropna()
    out = {r["g"]: r["last_v"] for r in query.aggregate(clean, "last", "v", ["g"], ["id"]).collect()}
    assert out["x"] == 5.0 and not math.isnan(out["x"])
