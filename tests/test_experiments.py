import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayspark.catalog import experiments
from assayspark.operators import experience, outliers, runlog
from assayspark.plans import workspace
from assayspark.streaming import jobs


def segment(e):
    for limit, height in ((0.05, 5.0), (0.1, 3.0), (0.2, 2.0), (0.5, 1.0)):
        if e < limit:
            return height * (1 - e / limit)
    return -e


def test_rewards(spark):
    pairs = [(1.01, 1.0), (1.07, 1.0), (1.15, 1.0), (1.4, 1.0), (3.0, 1.0), (9.0, 1.0), (0.02, 0.0), (1.0, None)]
    df = spark.createDataFrame(pairs, "p double, t double")
    out = df.select("p", "t", experience.reward(F.col("p"), F.col("t")).alias("a"),
                    experience.reward_relative(F.col("p"), F.col("t")).alias("b")).collect()
    for r in out:
        if r["t"] is None:
            assert r["a"] is None
            continue
        e = abs(r["p"] - r["t"])
        bonus = 1 - (e / abs(r["t"])) / 0.1 if r["t"] and e / abs(r["t"]) < 0.1 else 0
        assert r["a"] == pytest.approx(min(max(segment(e), -5), 10))
        assert r["b"] == pytest.approx(min(max(segment(e) + bonus, -5), 10))


@pytest.mark.parametrize("per_chunk", [10_000, 20])
def test_ring_keeps_the_newest(spark, per_chunk):
    df = spark.range(300).select(F.col("id").alias("step"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"))
    out = experience.ring_retention(df, ["k"], "step", 50, per_chunk).collect()
    hot = sorted(r["step"] for r in out if r["k"] == "hot")
    assert hot == [i for i in range(300) if i % 3][-50:] and len(out) == 100
    everything = experience.ring_retention(df, [], "step", 50, per_chunk)
    assert sorted(r["step"] for r in everything.collect()) == list(range(250, 300))


def test_priorities(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(200)], "id int, prio double").repartition(4)
    p = experience.priority_probability(df, "prio")
    want = np.arange(200.0) ** 0.6 + 1e-6
    got = p.orderBy("id").toPandas()["p"].to_numpy()
    np.testing.assert_allclose(got, want / want.sum())
    sample = experience.priority_sample(p, "p", ["id"], 32)
    ids = [r["id"] for r in sample.collect()]
    assert len(set(ids)) == 32 and np.mean(ids) > 90
    assert set(ids) == {r["id"] for r in experience.priority_sample(p.repartition(7), "p", ["id"], 32).collect()}
    assert experience.priority_sample(p, "p", ["id"], 500).count() == 0
    w = experience.importance_weights(sample, "p", 200).toPandas()
    raw = (200 * w["p"]) ** -0.5
    np.testing.assert_allclose(w["w"], raw / raw.max())


def test_td_and_update(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0, 0.5, 0.0, 2.0), (2, 1.0, 5.0, 0.9, 1.0, 4.0), (3, 0.0, 0.0, 0.0, 0.0, None)],
                               "id int, q double, nq double, r double, done double, prio double")
    out = experience.td_huber(df, "q", "nq", "r", "done", 0.5)
    rows = {r["id"]: r for r in out.collect()}
    assert rows[1]["td"] == pytest.approx(2.0) and rows[1]["huber"] == pytest.approx(1.5)
    assert rows[2]["td"] == pytest.approx(0.1) and rows[2]["huber"] == pytest.approx(0.005)
    assert experience.critic_loss(out.where("id < 3").withColumn("w", F.lit(2.0)), "w").first()["loss"] == pytest.approx(1.505)
    new = {r["id"]: r["prio"] for r in experience.priority_update(df, out.where("id = 1"), ["id"], "prio", "td").collect()}
    assert new == pytest.approx({1: 2.0 + 1e-6, 2: 4.0, 3: 4.0 + 1e-6})


def test_episode_end(spark):
    out = spark.range(1, 301).where(experience.episode_end(F.col("id")) == 1.0)
    assert [r["id"] for r in out.orderBy("id").collect()] == [100, 200, 300]


@pytest.mark.parametrize("text, value", [
    ('{"test": {"r2": 0.5}, "r2": 9}', 0.5),
    ('{"detail": {"test": {"R2": 0.6}}}', 0.6),
    ('{"detail": {"R2_value": 0.7}}', 0.7),
    ('{"detail": {"loss": 1}, "R2": 0.8}', 0.8),
    ('{"best": "B", "models": [{"model": "A", "r2": 0.1}, {"model": "B", "r2": 0.2}]}', 0.2),
    ('{"best": "C", "models": [{"model": "A", "r2": null}, {"model": "B", "r2": 0.3}]}', 0.3),
    ('{"test": "none", "r2": "0.9"}', 0.9),
    ('{"r2": "high"}', None), ("[1]", None), ("no json", None), (None, None), ("{}", None),
])
def test_metric_in_json(spark, text, value):
    df = spark.createDataFrame([(text,)], "m string")
    assert df.select(runlog.metric_value(F.col("m"), "r2").alias("v")).first()["v"] == value


def test_run_record(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id int, r2 double")
    made = runlog.run_record(df, {"r2": F.col("r2")}, {"a": F.lit(1)}, id=F.col("id"))
    for _ in range(2):
        runlog.append_records(made, str(tmp_path / "h"))
    rows = spark.read.parquet(str(tmp_path / "h")).collect()
    assert len(rows) == 2 and rows[0]["metrics"] == '{"r2":0.5}' and rows[0]["params"] == '{"a":1}'


@pytest.mark.parametrize("per_chunk", [1000, 3])
def test_fill_labels(spark, per_chunk):
    rows = [(1, "", "train"), (2, " LR ", "train"), (3, "X", "val"), (4, None, "test"), (5, "SVR", "train"), (6, "", "test")]
    df = spark.createDataFrame(rows, "n int, model string, dataset string").withColumn("run", F.lit(1))
    out = runlog.fill_labels(df, ["run"], ["n"], "model", "dataset", rows_per_chunk=per_chunk)
    assert [r["model"] for r in out.orderBy("n").collect()] == ["—", "LR", "LR", "SVR", "SVR"]


@pytest.mark.parametrize("per_chunk", [100_000, 37])
def test_curves(spark, per_chunk):
    rng = np.random.default_rng(6)
    scores = {run: np.round(rng.normal(size=120) - np.arange(120) * 0.02, 3) for run in (1, 2)}
    rows = [(run, e + 1, float(v)) for run, s in scores.items() for e, v in enumerate(s)]
    df = spark.createDataFrame(rows, "run int, epoch int, r2 double").repartition(5)
    best = runlog.running_best(df, ["run"], ["epoch"], "r2", rows_per_chunk=per_chunk).toPandas()
    stops = {r["run"]: r for r in runlog.early_stop(df, ["run"], ["epoch"], "r2", 15, per_chunk).collect()}
    for run, s in scores.items():
        part = best[best["run"] == run].sort_values("epoch")
        np.testing.assert_allclose(part["best"], np.maximum.accumulate(s))
        top, idle, stop = -math.inf, 0, None
        for e, v in enumerate(s, 1):
            top, idle = (v, 0) if v > top else (top, idle + 1)
            if idle >= 15:
                stop = e
                break
        assert stops[run]["stop_at"] == stop and stops[run]["best"] == pytest.approx(s.max())
    points = runlog.evaluation_points(df.where("epoch <= 57"), ["run"], "epoch", rows_per_chunk=per_chunk)
    assert sorted(r["epoch"] for r in points.where("run = 1").collect()) == [10, 20, 30, 40, 50, 57]


def test_losses_tail_progress(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 1, 0.0), (1, 2, -1.0), (1, 1, 4.0)], "run int, epoch int, loss double")
    assert {r["epoch"]: r["loss"] for r in runlog.epoch_loss(df, ["run", "epoch"], "loss").collect()} == {1: 3.0, 2: 0.0}
    assert runlog.tail(df, ["run"], ["loss"], 2).agg(F.min("loss")).first()[0] == 2.0
    assert df.select(runlog.progress(F.col("epoch"), F.lit(4)).alias("p")).first()["p"] == 25.0


STATUS = "task string, status string, epoch int, ts timestamp"


def status_rows(spark):
    return spark.sql("""SELECT * FROM VALUES
      ('a', 'running', 1, TIMESTAMP'2024-01-01 10:00:00'), ('a', 'done', 2, TIMESTAMP'2024-01-01 11:00:00'),
      ('a', 'finished', 3, TIMESTAMP'2024-01-01 12:00:00'), ('b', 'running', 1, TIMESTAMP'2024-01-01 12:30:00'),
      ('c', 'running', 1, TIMESTAMP'2024-01-01 09:00:00') AS t(task, status, epoch, ts)""")


def test_status(spark):
    df = status_rows(spark)
    latest = runlog.latest_status(df, ["task"], ["ts"], "ts").collect()
    assert [(r["task"], r["epoch"]) for r in latest] == [("b", 1), ("a", 3), ("c", 1)]
    assert [r["epoch"] for r in runlog.complete_once(df, ["task"], ["ts"]).collect()] == [2]
    assert runlog.expire(df, "ts", "2024-01-01 12:30:00").count() == 2
    assert [r["task"] for r in runlog.latest_records(df, ["ts"], 2).collect()] == ["b", "a"]


EVENT = "task string, ts timestamp, epoch int, status string, loss double"


def minute(n):
    return datetime(2024, 1, 1, 12) + timedelta(minutes=n)


def put(spark, folder, *rows):
    """One file, which is one batch."""
    spark.createDataFrame([(t, minute(m), e, s, loss) for t, m, e, s, loss in rows], EVENT).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.02)


def latest(spark, checkpoint, schema):
    return sorted((r["task"], r["epoch"], r["loss"]) for r in jobs.read_latest(spark, checkpoint, schema, "ts", 1).collect())


def test_latest_status_holds_state_over_batches_and_restarts(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    put(spark, folder, ("a", 0, 1, "running", 0.5), ("b", 10, 1, "running", None), ("a", 5, 2, "running", 0.25), (None, 5, 1, "x", 1.0))
    put(spark, folder, ("a", 3, 9, "running", 9.0), ("c", 40, 1, "running", float("inf")), ("c", 39, 5, "running", 1.5))
    schema = jobs.read_stream(spark, folder).schema

    def run():
        return jobs.latest_status(jobs.read_stream(spark, folder, files_per_batch=1), ["task"], "ts", ["ts", "epoch"], out, checkpoint, 1, 2)

    query = run()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
    assert latest(spark, checkpoint, schema) == [("a", 2, 0.25), ("b", 1, None), ("c", 1, float("inf"))]
    # the second run goes on from the checkpoint: an old row changes nothing, a new hour empties the state
    put(spark, folder, ("a", 4, 3, "running", 0.1), ("b", 64, 2, "running", 0.75))
    put(spark, folder, ("d", 66, 1, "running", 1.0), ("a", 2, 7, "late", 7.0))
    query = run()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 4
    assert latest(spark, checkpoint, schema) == [("b", 2, 0.75), ("c", 1, float("inf")), ("d", 1, 1.0)]
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 3
    log = [(r["task"], r["epoch"]) for r in jobs.read_written(spark, out, schema).collect()]
    assert log.count(("a", 2)) == 2 and ("a", 9) not in log  # set once, expired once
    assert spark.read.parquet(out).where("expired").count() == 1
    # nothing new: the state stays, and no batch reads the old ones again
    assert sum(p["numInputRows"] for p in run().recentProgress) == 0 and len(latest(spark, checkpoint, schema)) == 3


def test_a_newer_row_moves_the_expiry(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([("a", 0, 1, "r", 1.0)], [("a", 50, 2, "r", 1.0)], [("b", 70, 1, "r", 1.0)], [("b", 100, 2, "r", 1.0)], [("b", 111, 3, "r", 1.0)]):
        put(spark, folder, *rows)
        query = jobs.latest_status(jobs.read_stream(spark, folder, files_per_batch=1), ["task"], "ts", ["ts"], out, checkpoint, 1, 1)
        live = latest(spark, checkpoint, jobs.read_stream(spark, folder).schema)
        now = rows[0][1]
        assert [x[0] for x in live] == (["a"] if now < 70 else ["a", "b"] if now <= 110 else ["b"])
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_completions_are_written_once_for_good(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], EVENT).schema
    progress = []

    def run(*rows):
        put(spark, folder, *rows)
        query = jobs.complete_once(
            jobs.read_stream(spark, folder, files_per_batch=1), ["task"], "ts", ["ts", "epoch"], "status", out, checkpoint, "30 minutes", partitions=2)
        progress.append(query.recentProgress[-1]["stateOperators"][0])
        return sorted((r["task"], r["epoch"], r["final"]) for r in jobs.read_first(spark, checkpoint, schema).collect())

    assert run(("a", 20, 5, "done", 0.1), ("b", 21, 1, "running", 1.0)) == [("a", 5, False)]
    # an earlier completion in time replaces the one that waits; a repeated one does not
    assert run(("a", 10, 3, "done", 0.2), ("a", 20, 5, "done", 0.1), ("b", 22, 2, "done", 1.0)) == [("a", 3, False), ("b", 2, False)]
    assert run(("c", 45, 1, "running", 1.0)) == [("a", 3, False), ("b", 2, False)]
    # too late for its task, repeated, and late within the allowance
    assert run(("a", 11, 1, "done", 0.3), ("a", 46, 9, "done", 0.1), ("b", 21, 1, "done", 1.0), ("c", 90, 2, "finished", 1.0)) == [
        ("a", 3, True), ("b", 1, True), ("c", 2, False)]
    assert run(("d", 200, 1, "running", 0.0)) == [("a", 3, True), ("b", 1, True), ("c", 2, True)]
    written = sorted((r["task"], r["epoch"], r["ts"]) for r in jobs.read_written(spark, out, schema).collect())
    assert written == [("a", 3, minute(10)), ("b", 1, minute(21)), ("c", 2, minute(90))]
    # one state row per finished task and none that waits; its size is told
    assert progress[-1]["numRowsTotal"] == 3 and progress[-1]["memoryUsedBytes"] > 0


def test_stream_screen(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame([(1, 50.0, 50.0), (2, 200.0, 1.0), (3, float("nan"), 100.0), (4, 1.0, 99.0)], "id int, a double, b double")
    df.write.parquet(folder)
    bounds = outliers.Bounds({"a": 10.0, "b": 0.0}, {"a": 60.0, "b": 98.0})
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    jobs.append_to_files(jobs.screen(jobs.read_stream(spark, folder), ["a", "b"], bounds, (85, 115), ["a", "b"]), out, state)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 50.0, 50.0), (4, 10.0, 98.0)]


def test_workspace_takes_the_folder_of_the_session(spark):
    named = spark.conf.get(workspace.SETTING, None)
    first, second = workspace.fresh_path(spark, "x"), workspace.fresh_path(spark, "x")
    assert first != second and (named is None or first.startswith(named.rstrip("/")))
    assert workspace.materialize(spark.range(5)).count() == 5


def test_state_partitions_follow_the_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(experiments, "TASKS_PER_PARTITION", 30)
    monkeypatch.setattr(experiments, "BATCHES", 2)
    place = str(tmp_path)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", F.col("event_id") % 200)
    events.write.parquet(f"{place}/events.parquet")
    used = []
    real = jobs.complete_once
    monkeypatch.setattr(jobs, "complete_once", lambda *a: used.append((a[-1], real(*a))))
    got = sorted(tuple(r) for r in experiments.stm_complete_once(spark, place).collect())
    done = events.where("event_type in ('purchase', 'signup')").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("x"))
    assert got == sorted(tuple(r) for r in done.select("user_id", "x.event_id", "x.event_type").collect())
    ((partitions, query),) = used
    assert 6 <= partitions <= 8
    assert query.recentProgress[-1]["stateOperators"][0]["numShufflePartitions"] == partitions
