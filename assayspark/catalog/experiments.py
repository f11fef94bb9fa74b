"""Experience tables, run logs and streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayspark.catalog.registry import (
    HISTORY_SQL, SEED, history, micros, query, r, round_all, rounded, table, uniform_sql,
)
from assayspark.functions.columns import wall_micros
from assayspark.operators import experience, outliers, runlog
from assayspark.plans.chunks import row_position
from assayspark.plans.workspace import fresh_path
from assayspark.streaming import jobs

# ---------------------------------------------------------------------- experience


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Events as transitions: value is the action, the number in props the target."""
    return table(spark, sf, "events").select(
        "event_id", "event_type", "user_id", "value",
        (F.col("value") / 100).alias("action"),
        (F.get_json_object("props", "$.k").cast("int") / 100).alias("target"),
    )


_STEPS_SQL = """(SELECT event_id, event_type, user_id, value, value / 100 AS action,
  CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0::DOUBLE AS target FROM events)"""
_SEGMENTS_SQL = """CASE WHEN e < 0.05 THEN 5.0 * (1 - e / 0.05::DOUBLE) WHEN e < 0.1 THEN 3.0 * (1 - e / 0.1::DOUBLE)
  WHEN e < 0.2 THEN 2.0 * (1 - e / 0.2::DOUBLE) WHEN e < 0.5 THEN 1.0 * (1 - e / 0.5::DOUBLE) ELSE -e END"""
_ERROR_SQL = f"(SELECT *, abs(action - target) AS e FROM {_STEPS_SQL})"


@query("rl_reward", f"SELECT event_id, {r(f'least(greatest({_SEGMENTS_SQL}, -5), 10)', 'reward')} FROM {_ERROR_SQL}")
def rl_reward(spark: SparkSession, sf: str) -> DataFrame:
    made = experience.reward(F.col("action"), F.col("target"))
    return _steps(spark, sf).select("event_id", rounded(made).alias("reward"))


@query("rl_reward_relative", f"""
SELECT event_id, {r(f'''least(greatest({_SEGMENTS_SQL} + CASE WHEN target <> 0 AND e / abs(target) < 0.1
  THEN 1 - e / abs(target) / 0.1::DOUBLE ELSE 0 END, -5), 10)''', 'reward')} FROM {_ERROR_SQL}""")
def rl_reward_relative(spark: SparkSession, sf: str) -> DataFrame:
    made = experience.reward_relative(F.col("action"), F.col("target"))
    return _steps(spark, sf).select("event_id", rounded(made).alias("reward"))


@query("rl_episode_flag", """
SELECT event_id, CASE WHEN (event_id + 1) % 100 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS done FROM events""")
def rl_episode_flag(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf).select("event_id", experience.episode_end(F.col("event_id") + 1).alias("done"))


@query("rl_ring_retention", """
SELECT event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS age FROM events) WHERE age <= 500""")
def rl_ring_retention(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return experience.ring_retention(events, ["event_type"], "event_id", 500)


_PROB_SQL = """(SELECT event_id, user_id, value, (value ** 0.6 + 0.000001) / sum(value ** 0.6 + 0.000001) OVER () AS p FROM events)"""


def _prioritised(spark: SparkSession, sf: str) -> DataFrame:
    return experience.priority_probability(table(spark, sf, "events").select("event_id", "user_id", "value"), "value")


@query("rl_priority_prob", f"SELECT event_id, {r('p', 'p', 9)} FROM {_PROB_SQL}")
def rl_priority_prob(spark: SparkSession, sf: str) -> DataFrame:
    return round_all(_prioritised(spark, sf).select("event_id", "p"), "p", digits=9)


_DRAW_SQL = f"""(SELECT event_id, user_id, value, p FROM {_PROB_SQL} ORDER BY ln({uniform_sql(SEED, 'event_id')}) / p DESC LIMIT 128)"""


def _draw(spark: SparkSession, sf: str) -> DataFrame:
    return experience.priority_sample(_prioritised(spark, sf), "p", ["event_id"], 128, SEED)


@query("rl_priority_sample", f"SELECT event_id, value FROM {_DRAW_SQL}")
def rl_priority_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _draw(spark, sf).select("event_id", "value")


@query("rl_is_weights", f"""
WITH d AS (SELECT event_id, ((SELECT count(*) FROM events) * p) ** -0.4 AS w FROM {_DRAW_SQL})
SELECT event_id, {r("w / max(w) OVER ()", "w")} FROM d""")
def rl_is_weights(spark: SparkSession, sf: str) -> DataFrame:
    population = table(spark, sf, "events").count()
    made = experience.importance_weights(_draw(spark, sf), "p", population, 0.4)
    return round_all(made.select("event_id", "w"), "w")


_TD_SQL = f"""(SELECT event_id, action - (target + (1 - CASE WHEN (event_id + 1) % 100 = 0 THEN 1.0 ELSE 0.0 END) * 0.99::DOUBLE * (action / 2)) AS td
  FROM {_STEPS_SQL})"""


def _td(spark: SparkSession, sf: str) -> DataFrame:
    rows = _steps(spark, sf).withColumns({
        "next_q": F.col("action") / 2, "done": experience.episode_end(F.col("event_id") + 1)})
    return experience.td_huber(rows, "action", "next_q", "target", "done", 0.99)


@query("rl_td_huber", f"""
SELECT event_id, {r("td", "td", 8)}, {r("CASE WHEN abs(td) < 1 THEN 0.5 * td * td ELSE abs(td) - 0.5 END", "huber", 7)} FROM {_TD_SQL}""")
def rl_td_huber(spark: SparkSession, sf: str) -> DataFrame:
    made = _td(spark, sf).select("event_id", "td", "huber")
    return round_all(round_all(made, "td", digits=8), "huber", digits=7)


@query("rl_priority_update", f"""
SELECT e.event_id, {r('''coalesce(CASE WHEN t.td IS NOT NULL THEN greatest(abs(t.td), 0.000001) + 0.000001 END, CASE WHEN e.event_type = 'signup' THEN NULL ELSE e.value END,
  (SELECT max(value) FROM events WHERE event_type <> 'signup') + 0.000001)''', 'value', 8)}
FROM events e LEFT JOIN (SELECT * FROM {_TD_SQL} WHERE event_id IN (SELECT event_id FROM {_DRAW_SQL})) t ON e.event_id = t.event_id""")
def rl_priority_update(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "signup", F.col("value")).alias("value"))
    sampled = _td(spark, sf).join(_draw(spark, sf).select("event_id"), "event_id", "left_semi")
    return round_all(experience.priority_update(events, sampled, ["event_id"], "value", "td"), "value", digits=8)


# ------------------------------------------------------------------------ run logs


def _curve(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as the epochs of one run."""
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value", "props")
    return row_position(events, ["user_id"], ["ts", "event_id"], "epoch")


_CURVE_SQL = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)"


@query("log_record", """
SELECT event_id AS id, event_type AS algorithm, '{"value":' || CAST(value AS VARCHAR) || '}' AS metrics,
  '{"user_id":' || user_id || '}' AS params FROM events""")
def log_record(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    made = runlog.run_record(events, {"value": F.col("value")}, {"user_id": F.col("user_id")},
                             id=F.col("event_id"), algorithm=F.col("event_type"))
    path = fresh_path(spark, "runs")
    runlog.append_records(made, path)
    return spark.read.parquet(path)


_STORED_SQL = """(SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE event_type
  WHEN 'click' THEN '{"test":{"r2":' || json_extract_string(props, '$.k') || '}}'
  WHEN 'view' THEN '{"detail":{"test":{"R2":' || json_extract_string(props, '$.k') || '}}}'
  WHEN 'error' THEN '{"best":"B","models":[{"model":"A","r2":-1},{"model":"B","r2":' || json_extract_string(props, '$.k') || '}]}'
  WHEN 'purchase' THEN '{"detail":{"R2_value":' || json_extract_string(props, '$.k') || '}}'
  ELSE props END AS metrics, event_type FROM events)"""


@query("log_metric_extract", f"""
SELECT event_id, CAST(CASE event_type
  WHEN 'click' THEN json_extract_string(metrics, '$.test.r2')
  WHEN 'view' THEN json_extract_string(metrics, '$.detail.test.R2')
  WHEN 'error' THEN json_extract_string(metrics, '$.models[1].r2')
  WHEN 'purchase' THEN json_extract_string(metrics, '$.detail.R2_value')
  ELSE NULL END AS DOUBLE) AS r2 FROM {_STORED_SQL}""")
def log_metric_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    stored = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('{"test":{"r2":'), k, F.lit("}}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"detail":{"test":{"R2":'), k, F.lit("}}}")))
        .when(F.col("event_type") == "error", F.concat(
            F.lit('{"best":"B","models":[{"model":"A","r2":-1},{"model":"B","r2":'), k, F.lit("}]}")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('{"detail":{"R2_value":'), k, F.lit("}}")))
        .otherwise(F.col("props"))
    )
    events = table(spark, sf, "events").select("event_id", stored.alias("metrics"))
    return events.select("event_id", runlog.metric_value(F.col("metrics"), "r2").alias("r2"))


@query("log_fill_label", """
WITH k AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE '' END AS label,
  CASE WHEN event_type = 'error' THEN 'val' WHEN value < 30 THEN 'train' ELSE 'test' END AS dataset FROM events)
SELECT event_id, coalesce(last_value(nullif(label, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), '—') AS label,
  dataset FROM k WHERE dataset <> 'val'""")
def log_fill_label(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", "ts",
        F.when(kind.isin("click", "view"), kind).otherwise("").alias("label"),
        F.when(kind == "error", "val").when(F.col("value") < 30, "train").otherwise("test").alias("dataset"))
    filled = runlog.fill_labels(rows, ["user_id"], ["ts", "event_id"], "label", "dataset")
    return filled.select("event_id", "label", "dataset")


@query("log_running_best", f"""
SELECT user_id, event_id, epoch, max(value) OVER (PARTITION BY user_id ORDER BY epoch) AS best FROM {_CURVE_SQL}""")
def log_running_best(spark: SparkSession, sf: str) -> DataFrame:
    best = runlog.running_best(_curve(spark, sf), ["user_id"], ["epoch"], "value")
    return best.select("user_id", "event_id", "epoch", "best")


@query("log_early_stop", f"""
WITH b AS (SELECT user_id, epoch, value,
    max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_CURVE_SQL}),
m AS (SELECT *, max(CASE WHEN before IS NULL OR value > before THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS mark FROM b)
SELECT user_id, min(CASE WHEN epoch - mark >= 20 THEN epoch END) AS stop_at,
  min(CASE WHEN epoch - mark >= 20 THEN epoch END) AS stop_step, max(value) AS best FROM m GROUP BY user_id""")
def log_early_stop(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.early_stop(_curve(spark, sf).select("user_id", "epoch", "value"), ["user_id"], ["epoch"], "value", 20)


@query("log_eval_points", f"""
SELECT user_id, event_id, epoch FROM (SELECT *, max(epoch) OVER (PARTITION BY user_id) AS last FROM {_CURVE_SQL})
WHERE epoch % 10 = 0 OR epoch = last""")
def log_eval_points(spark: SparkSession, sf: str) -> DataFrame:
    curve = _curve(spark, sf).select("user_id", "event_id", "epoch")
    return runlog.evaluation_points(curve, ["user_id"], "epoch")


@query("log_epoch_loss", f"""
SELECT user_id, CAST(event_day AS INTEGER) AS epoch, {r("coalesce(avg(CASE WHEN loss > 0 THEN loss END), 0)", "loss")}
FROM (SELECT user_id, day(ts) AS event_day, value - 20 AS loss FROM events) GROUP BY user_id, event_day""")
def log_epoch_loss(spark: SparkSession, sf: str) -> DataFrame:
    updates = table(spark, sf, "events").select(
        "user_id", F.dayofmonth("ts").alias("epoch"), (F.col("value") - 20).alias("loss"))
    return round_all(runlog.epoch_loss(updates, ["user_id", "epoch"], "loss"), "loss")


@query("log_tail", """
SELECT user_id, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""")
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "value", "ts")
    return runlog.tail(events, ["user_id"], ["ts", "event_id"], 50).select("user_id", "event_id", "value")


@query("log_progress", f"SELECT user_id, event_id, {r('100.0 * epoch / 200', 'progress', 4)} FROM {_CURVE_SQL}")
def log_progress(spark: SparkSession, sf: str) -> DataFrame:
    curve = _curve(spark, sf)
    return curve.select("user_id", "event_id", rounded(runlog.progress(F.col("epoch"), F.lit(200)), 4).alias("progress"))


@query("log_latest_status", """
SELECT user_id, event_id, event_type, value, epoch_us(ts) AS ts_us FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def log_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    found = runlog.latest_status(events, ["user_id"], ["ts", "event_id"], "ts")
    return found.select("user_id", "event_id", "event_type", "value", micros("ts", "ts_us"))


@query("log_expire", """
SELECT event_id, epoch_us(ts) AS ts_us FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR""")
def log_expire(spark: SparkSession, sf: str) -> DataFrame:
    kept = runlog.expire(table(spark, sf, "events"), "ts", "2024-01-20 12:00:00")
    return kept.select("event_id", micros("ts", "ts_us"))


_DONE_SQL = "event_type IN ('purchase', 'signup')"


@query("log_complete_once", f"""
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events WHERE {_DONE_SQL}) WHERE rn = 1""")
def log_complete_once(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "value", "ts", F.col("event_type").alias("status"))
    found = runlog.complete_once(events, ["user_id"], ["ts", "event_id"], "status", ("purchase", "signup"))
    return found.select("user_id", "event_id", "value")


@query("log_latest_n", f"SELECT id, algorithm, duration_sec FROM {HISTORY_SQL} ORDER BY created_at DESC, id DESC LIMIT 40")
def log_latest_n(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.latest_records(history(spark, sf), ["created_at", "id"]).select("id", "algorithm", "duration_sec")


# ----------------------------------------------------------------------- streaming


BATCHES = 4
STATE_PARTITIONS = 4
#: Tasks whose state one partition holds; beyond that there are more partitions.
TASKS_PER_PARTITION = 8_000
DAY = 86_400_000_000


def _arriving(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of at least four batches, each with events of all times."""
    folder = fresh_path(spark, "arriving")
    table(spark, sf, "events").repartition(4, "event_id").write.parquet(folder)
    return jobs.read_stream(spark, folder, files_per_batch=1)


def _state_partitions(spark: SparkSession, sf: str) -> int:
    """State partitions for the tasks of the events, so that each has a bounded number of them."""
    tasks = table(spark, sf, "events").agg(F.approx_count_distinct("user_id")).first()[0]
    return max(STATE_PARTITIONS, -(-tasks // TASKS_PER_PARTITION))


def _arriving_late(spark: SparkSession, sf: str, files: int = 1) -> tuple[DataFrame, int]:
    """The events as a stream in the order of their arrival, up to three days after their time; and the days by which any
    event is behind the newest one before it. Each slice of arrival times is written after the one before, in ``files`` files."""
    folder = fresh_path(spark, "late")
    events = table(spark, sf, "events")
    low, high = events.select(wall_micros("ts").alias("t")).agg(F.min("t"), F.max("t")).first()
    width = (high - low + 3 * DAY) // BATCHES + 1
    arrival = wall_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3 * DAY))
    dealt = events.withColumn("slice", F.floor((arrival - low) / width))
    for k in range(BATCHES):
        dealt.where(F.col("slice") == k).drop("slice").repartition(files).write.mode("append").parquet(folder)
    return jobs.read_stream(spark, folder, files_per_batch=files), 3 + -(-width // DAY)


@query("stm_latest_status", """
SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
  WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR) WHERE rn = 1""")
def stm_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = jobs.stream_paths(spark, "status")
    stream = _arriving(spark, sf).select("user_id", "event_id", "event_type", "value", "ts")
    jobs.latest_status(stream, ["user_id"], "ts", ["ts", "event_id"], out, checkpoint, 6, _state_partitions(spark, sf))
    return jobs.read_latest(spark, checkpoint, stream.schema, "ts", 6).select("user_id", "event_id", "event_type", "value")


@query("stm_complete_once", f"""
SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE {_DONE_SQL}) WHERE rn = 1""")
def stm_complete_once(spark: SparkSession, sf: str) -> DataFrame:
    out, checkpoint = jobs.stream_paths(spark, "complete")
    partitions = _state_partitions(spark, sf)
    stream, days = _arriving_late(spark, sf, -(-partitions // BATCHES))
    stream = stream.select("user_id", "event_id", "event_type", "ts")
    jobs.complete_once(stream, ["user_id"], "ts", ["ts", "event_id"], "event_type", out, checkpoint, f"{days} days", ("purchase", "signup"), partitions)
    return jobs.read_first(spark, checkpoint, stream.schema).select("user_id", "event_id", "event_type")


@query("stm_screen", f"""
WITH b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)
SELECT event_id, {r("least(greatest(value, lo), hi)", "value", 4)} FROM events, b WHERE value BETWEEN 1 AND 400""")
def stm_screen(spark: SparkSession, sf: str) -> DataFrame:
    out, state = jobs.stream_paths(spark, "screen")
    bounds = outliers.quantile_bounds(table(spark, sf, "events"), ["value"])
    stream = _arriving(spark, sf).select("event_id", "value")
    jobs.append_to_files(jobs.screen(stream, ["value"], bounds, (1.0, 400.0), ["value"]), out, state)
    return round_all(spark.read.parquet(out), "value", digits=4)
