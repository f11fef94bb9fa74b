"""Experience tables of an offline learner: rewards, retention, priorities, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions.columns import uniform
from assayspark.plans.chunks import ROWS_PER_CHUNK, row_position
from assayspark.plans.joins import has_more_than

# Fixed values: (error limit, height) of the reward segments, penalty slope and clip range.
REWARD_SEGMENTS = ((0.05, 5.0), (0.1, 3.0), (0.2, 2.0), (0.5, 1.0))
REWARD_RANGE = (-5.0, 10.0)
RELATIVE_LIMIT = 0.1
# Replay defaults.
ALPHA = 0.6
EPSILON = 1e-6
CAPACITY = 100_000


def _clipped(reward: Column) -> Column:
    low, high = REWARD_RANGE  # greatest and least skip nulls, so a missing reward is kept apart
    return F.when(reward.isNotNull(), F.least(F.greatest(reward, F.lit(low)), F.lit(high)))


def _segments(error: Column) -> Column:
    reward = -error
    for limit, height in reversed(REWARD_SEGMENTS):
        reward = F.when(error < limit, F.lit(height) * (1 - error / F.lit(limit))).otherwise(reward)
    return reward


def reward(predicted: Column, target: Column) -> Column:
    """Segmented reward by absolute error."""
    return _clipped(_segments(F.abs(predicted - target)))


def reward_relative(predicted: Column, target: Column) -> Column:
    """Segmented reward plus a bonus for a small relative error."""
    error = F.abs(predicted - target)
    relative = F.when(target != 0, error / F.abs(target))
    bonus = F.when(relative < RELATIVE_LIMIT, 1 - relative / F.lit(RELATIVE_LIMIT)).otherwise(F.lit(0.0))
    return _clipped(_segments(error) + bonus)


def episode_end(step: Column, length: int = 100) -> Column:
    """1.0 on every ``length``-th step (steps count from 1)."""
    return F.when(step % length == 0, 1.0).otherwise(0.0)


def ring_retention(
    df: DataFrame, keys: Sequence[str], step: str, capacity: int = CAPACITY, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Newest ``capacity`` transitions per key."""
    placed = row_position(df, keys, [step], "__age", descending=True, rows_per_chunk=rows_per_chunk)
    return placed.where(F.col("__age") <= capacity).drop("__age")


def priority_probability(df: DataFrame, priority: str, alpha: float = ALPHA, epsilon: float = EPSILON, name: str = "p") -> DataFrame:
    """Normalised priority powers; the total is one number from one aggregate."""
    mass = F.pow(F.col(priority), F.lit(alpha)) + F.lit(epsilon)
    total, rows = df.agg(F.sum(mass), F.count(F.lit(1))).first()
    share = mass / F.lit(total) if total else F.lit(1.0 / max(rows, 1))
    return df.withColumn(name, share)


def priority_sample(df: DataFrame, probability: str, key: Sequence[str], batch: int = 32, seed: int = 70) -> DataFrame:
    """Weighted sample without replacement: the ``batch`` largest log(u) / p; empty when too few rows.

    u is hashed from the key, so the plan is a per-task top-k followed by a small merge.
    """
    tickets = df.withColumn("__ticket", F.log(uniform(seed, *key)) / F.col(probability))
    if not has_more_than(df, batch - 1):
        return df.where(F.lit(False))
    return tickets.orderBy(F.col("__ticket").desc(), *key).limit(batch).drop("__ticket")


def importance_weights(sample: DataFrame, probability: str, population: int, beta: float = 0.5, name: str = "w") -> DataFrame:
    """(N p)^-beta, scaled so that the largest weight of the sample is 1."""
    weight = F.pow(F.lit(float(population)) * F.col(probability), F.lit(-beta))
    peak = sample.agg(F.max(weight)).first()[0]
    return sample.withColumn(name, weight / F.lit(peak))


def td_huber(
    df: DataFrame, q: str, next_q: str, reward_column: str, done: str, gamma: float = 0.99, name: str = "td"
) -> DataFrame:
    """Temporal difference error and its Huber loss."""
    error = F.col(q) - (F.col(reward_column) + (1 - F.col(done)) * F.lit(gamma) * F.col(next_q))
    size = F.abs(F.col(name))
    huber = F.when(size < 1, 0.5 * F.col(name) * F.col(name)).otherwise(size - 0.5)
    return df.withColumn(name, error).withColumn("huber", huber)


def critic_loss(df: DataFrame, weight: str | None = None, huber: str = "huber") -> DataFrame:
    """(Weighted) mean Huber loss."""
    loss = F.col(huber) if weight is None else F.col(weight) * F.col(huber)
    return df.agg(F.avg(loss).alias("loss"))


def priority_update(
    df: DataFrame, errors: DataFrame, key: Sequence[str], priority: str, td: str, epsilon: float = EPSILON
) -> DataFrame:
    """Sampled rows get max(|td|, eps) + eps, rows without priority the highest one plus eps."""
    size = F.when(F.col(td).isNotNull(), F.greatest(F.abs(F.col(td)), F.lit(epsilon)) + F.lit(epsilon))
    fresh = errors.select(*key, size.alias("__fresh"))
    joined = df.join(fresh, list(key), "left")
    top = df.agg(F.max(priority)).first()[0]
    newest = F.lit((1.0 if top is None else float(top)) + epsilon)
    return joined.select(*[
        F.coalesce("__fresh", F.col(priority), newest).alias(priority) if c == priority else F.col(c)
        for c in df.columns
    ])
