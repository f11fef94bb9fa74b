"""Analytics over experiment logs: metrics in JSON, learning curves, task status."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayspark.functions.columns import number
from assayspark.plans.chunks import ROWS_PER_CHUNK, Running, fit_chunks, running

# Names under which a metric may be stored.
METRIC_ALIASES = {
    "r2": ("r2", "R2", "R2_value"),
    "rmse": ("rmse", "RMSE", "RMSE_value"),
    "mae": ("mae", "MAE", "MAE_value"),
    "mape": ("mape", "MAPE", "MAPE_value"),
}
# States that mean a task is complete; labels shown for no model; kept records.
COMPLETE = ("done", "completed", "finished")
NO_LABEL = "—"
RECENT = 40


def run_record(
    df: DataFrame, metrics: Mapping[str, Column], params: Mapping[str, Column], **columns: Column
) -> DataFrame:
    """History rows with metrics and parameters as JSON text."""
    def as_json(parts: Mapping[str, Column]) -> Column:
        return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]))

    return df.select(*[c.alias(n) for n, c in columns.items()],
                     as_json(metrics).alias("metrics"), as_json(params).alias("params"))


def append_records(records: DataFrame, path: str) -> None:
    """Add run records to the history table."""
    records.write.mode("append").parquet(path)


# ------------------------------------------------------------------------ metrics


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fields(text: Column) -> Column:
    """Top-level fields of a JSON object as text; null when the text is no object."""
    return F.when(F.ltrim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def _best_model(top: Column) -> Column:
    """Fields of the model named best, else of the first model with a score."""
    def choose(models: Column) -> Column:
        scored = F.filter(models, lambda m: m["r2"].isNotNull())
        named = F.filter(scored, lambda m: m["model"] == top["best"])
        return F.coalesce(F.get(named, F.lit(0)), F.get(scored, F.lit(0)))

    return _once(F.from_json(top["models"], "array<map<string,string>>"), choose)


def metric_bag(metrics: Column) -> Column:
    """Fields that hold the metrics to show: test part, detail, best model or the whole."""
    def from_detail(detail: Column) -> Column:
        scored = detail["r2"].isNotNull() | detail["R2_value"].isNotNull()
        return F.coalesce(_fields(detail["test"]), F.when(scored, detail))

    def from_top(top: Column) -> Column:
        return F.coalesce(_fields(top["test"]), _once(_fields(top["detail"]), from_detail), _best_model(top), top)

    return _once(_fields(metrics), from_top)


def metric_value(metrics: Column, metric: str, aliases: Sequence[str] | None = None) -> Column:
    """One metric as a number; null when it is absent or no number."""
    names = aliases or METRIC_ALIASES.get(metric, (metric,))
    return _once(metric_bag(metrics), lambda bag: F.coalesce(*[number(bag[n]) for n in names]))


def fill_labels(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, dataset: str,
    kept: Sequence[str] = ("train", "test"), rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Rows of the kept datasets; an empty label takes the label above it.

    The mark of a failed row is no part of its label, and the sign for no label is no label.
    """
    rows = df.where(F.col(dataset).isin(*kept))
    text = F.trim(F.regexp_replace(F.col(label), r"\s*\[ERR\]\s*$", ""))
    given = F.when((text != "") & (text != NO_LABEL), text)
    filled = running(rows, keys, order, [Running("__label", "last", given)], rows_per_chunk=rows_per_chunk)
    return filled.select(*[F.coalesce("__label", F.lit(NO_LABEL)).alias(c) if c == label else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- learning curves


def running_best(
    df: DataFrame, run: Sequence[str], order: Sequence[str], score: str, name: str = "best",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Best score of the run so far."""
    return running(df, run, order, [Running(name, "max", F.col(score))], rows_per_chunk=rows_per_chunk)


def early_stop(
    df: DataFrame, run: Sequence[str], order: Sequence[str], score: str, patience: int = 100,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Per run the first evaluation after ``patience`` ones in a row without improvement."""
    first, cut = order[0], fit_chunks(df, order, rows_per_chunk)
    seen = running(df, run, order, [
        Running("__before", "max", F.col(score), inclusive=False),
        Running("__n", "count"),
    ], chunking=cut)
    better = F.col(score).isNotNull() & (F.col("__before").isNull() | (F.col(score) > F.col("__before")))
    marked = seen.withColumn("__mark", F.when(better, F.col("__n")))
    waited = running(marked, run, order, [Running("__last", "max", F.col("__mark"))], chunking=cut)
    idle = F.col("__n") - F.coalesce("__last", F.lit(0))
    hit = idle >= patience
    return waited.groupBy(*run).agg(
        F.min_by(first, F.when(hit, F.col("__n"))).alias("stop_at"),
        F.min(F.when(hit, F.col("__n"))).alias("stop_step"),
        F.max(score).alias("best"),
    )


def evaluation_points(
    df: DataFrame, run: Sequence[str], epoch: str, every: int = 10, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Every tenth epoch and the last one of each run."""
    last = Running("__last", "max", F.col(epoch))  # from the end, the first row has the maximum
    ended = running(df, run, [epoch], [last], descending=True, rows_per_chunk=rows_per_chunk)
    return ended.where((F.col(epoch) % every == 0) | (F.col(epoch) == F.col("__last"))).drop("__last")


def epoch_loss(df: DataFrame, by: Sequence[str], loss: str, name: str = "loss") -> DataFrame:
    """Mean loss per run and epoch over the updates with a positive loss, else 0."""
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col(loss) > 0, F.col(loss))), F.lit(0.0)).alias(name))


def tail(df: DataFrame, series: Sequence[str], order: Sequence[str], n: int = 50) -> DataFrame:
    """Last n points of each series; every task first drops what cannot be among them."""
    newest = Window.partitionBy(*series).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n).drop("__rn")


def progress(epoch: Column, total: Column) -> Column:
    """Percent of the epochs done."""
    return F.try_divide(F.lit(100.0) * epoch, total)


# -------------------------------------------------------------------- task status


def latest_status(df: DataFrame, task: Sequence[str], order: Sequence[str], newest: str) -> DataFrame:
    """Newest row per task, newest tasks first."""
    rest = [c for c in df.columns if c not in task]
    picked = df.groupBy(*task).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*task, "__row.*").select(*df.columns).orderBy(F.col(newest).desc(), *task)


def expire(df: DataFrame, created: str, anchor: str, hours: int = 1) -> DataFrame:
    """Rows created within the last hours before the anchor instant."""
    kind = df.schema[created].dataType.simpleString()
    return df.where(F.col(created) >= F.lit(anchor).cast(kind) - F.expr(f"INTERVAL {int(hours)} HOURS"))


def complete_once(
    df: DataFrame, task: Sequence[str], order: Sequence[str], status: str = "status", states: Sequence[str] = COMPLETE
) -> DataFrame:
    """First completion of each task."""
    rest = [c for c in df.columns if c not in task]
    done = df.where(F.col(status).isin(*states))
    picked = done.groupBy(*task).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*task, "__row.*").select(*df.columns)


def latest_records(df: DataFrame, order: Sequence[str], n: int = RECENT) -> DataFrame:
    """Newest n records."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
