"""Exact quantiles with bounded memory.

``percentile`` keeps every distinct value of a column in one aggregation buffer. That is
fine for small inputs and is used as it is there. Beyond a budget the wanted order
statistics are first bracketed by values from a sample and the brackets are verified by
counting all rows, pass after pass, until few enough rows lie strictly inside. The result
is exact in both cases; the state of every pass stays within the budget, whatever the size
of the table or the number of its tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions.columns import any_of, number
from assayspark.plans.chunks import ROWS_PER_CHUNK, Running, running
from assayspark.plans.joins import broadcast_if_small, null_safe

VALUE_BUDGET = 400_000
SAMPLE_VALUES = 100_000


@dataclass
class _Bracket:
    """Where the order statistic ``rank`` (from 0) of a column is known to lie."""

    column: str
    rank: int
    total: int
    low: float | None = None
    high: float | None = None
    at_or_below_low: int = 0
    inside: int = 0
    value: float | None = None


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    budget: int = VALUE_BUDGET,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles of each column, nulls and NaN ignored."""
    values = {c: number(c) for c in columns}
    counts = df.agg(*[F.count(values[c]).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    totals = {c: counts[i] for i, c in enumerate(columns)}
    if sum(totals.values()) <= budget:
        row = df.agg(*[
            F.percentile(values[c], F.array(*[F.lit(float(p)) for p in probabilities])).alias(f"q{i}")
            for i, c in enumerate(columns)
        ]).first()
        return {c: list(row[i]) if row[i] is not None else [None] * len(probabilities)
                for i, c in enumerate(columns)}

    wanted: dict[tuple[str, int], _Bracket] = {}
    for c in columns:
        for p in probabilities:
            place = p * (totals[c] - 1)
            for rank in {math.floor(place), math.ceil(place)}:
                if totals[c]:
                    wanted.setdefault((c, rank), _Bracket(c, rank, totals[c], inside=totals[c]))
    _locate(df, values, list(wanted.values()), max(budget // max(len(wanted), 1), 1))

    result: dict[str, list[float | None]] = {}
    for c in columns:
        picked: list[float | None] = []
        for p in probabilities:
            if not totals[c]:
                picked.append(None)
                continue
            place = p * (totals[c] - 1)
            low = wanted[(c, math.floor(place))].value
            high = wanted[(c, math.ceil(place))].value
            picked.append(low if low == high else low + (high - low) * (place - math.floor(place)))
        result[c] = picked
    return result


def quantile_functions(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], budget: int = VALUE_BUDGET, rows_per_chunk: int = ROWS_PER_CHUNK,
) -> dict[str, list[float | None]]:
    """The same as ``exact_quantiles`` for hundreds of probabilities a column.

    Brackets would need an aggregate each; here all columns shrink to (column, value, count), are summed up
    in order of the values, and every task picks the wanted ranks among its rows.
    """
    counts = df.agg(*[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    if sum(counts) <= budget:
        return exact_quantiles(df, columns, probabilities, budget)
    places = [[p * (n - 1) for p in probabilities] for n in counts]
    wanted = [np.unique([f(x) for x in own for f in (math.floor, math.ceil)]) if n else np.zeros(0, np.int64) for own, n in zip(places, counts, strict=True)]

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, part in pdf.groupby("__c"):
                upto = part["__upto"].to_numpy(np.int64)
                first, last = np.searchsorted(wanted[i], upto - part["__n"].to_numpy(np.int64)), np.searchsorted(wanted[i], upto)
                hit = np.flatnonzero(last > first)
                for at in hit:
                    yield pd.DataFrame({"c": int(i), "rank": wanted[i][first[at] : last[at]], "v": float(part["__v"].iloc[at])})

    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("__c"), number(c).cast("double").alias("__v")) for i, c in enumerate(columns)])))
    tallied = long.where(F.col("__v").isNotNull()).groupBy("__c", "__v").agg(F.count(F.lit(1)).alias("__n"))
    upto = running(tallied, ["__c"], ["__v"], [Running("__upto", "sum", F.col("__n"))], rows_per_chunk=rows_per_chunk)
    rows = upto.select("__c", "__v", "__n", "__upto").mapInPandas(pick, "c int, rank bigint, v double").collect()  # two per probability at most
    value = {(r["c"], r["rank"]): r["v"] for r in rows}
    result: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        ends = [(value[i, math.floor(x)], value[i, math.ceil(x)], x - math.floor(x)) for x in places[i]] if counts[i] else []
        result[c] = [low + (high - low) * part for low, high, part in ends] or [None] * len(probabilities)
    return result


def _strictly_inside(value: Column, b: _Bracket) -> Column:
    condition = value.isNotNull()
    if b.low is not None:
        condition = condition & (value > b.low)
    if b.high is not None:
        condition = condition & (value < b.high)
    return condition


def _locate(df: DataFrame, values: dict[str, Column], brackets: list[_Bracket], per_bracket: int) -> None:
    """Narrow all brackets together, then read off the order statistics."""
    pending = [b for b in brackets if b.inside > per_bracket]
    boost = 1
    while pending:
        edges = _sample_edges(df, values, pending, boost)
        if not edges:
            boost *= 10
            continue
        counts = _count_edges(df, values, {(b.column, e) for b in pending for e in edges.get(id(b), ())})
        for b in pending:
            if id(b) in edges:
                low, high = edges[id(b)]
                _narrow(b, low, *counts[(b.column, low)], high, *counts[(b.column, high)])
        pending = [b for b in pending if b.value is None and b.inside > per_bracket]
    _read_off(df, values, [b for b in brackets if b.value is None])


def _sample_edges(
    df: DataFrame, values: dict[str, Column], pending: list[_Bracket], boost: int
) -> dict[int, tuple[float, float]]:
    """Two values close around each wanted rank, guessed from a sample of its bracket.

    Brackets over the same range share a sample. A bad guess costs a pass, never the result.
    """
    ranges: dict[tuple[str, float | None, float | None], list[_Bracket]] = {}
    for b in pending:
        ranges.setdefault((b.column, b.low, b.high), []).append(b)
    size = max(SAMPLE_VALUES // len(ranges), 500) * boost
    names = {c: f"__v{i}" for i, c in enumerate(values)}
    drawn = df.select(*[values[c].alias(n) for c, n in names.items()], F.rand(size).alias("__u"))
    samples, tests = [], []
    for i, members in enumerate(ranges.values()):
        shares = []
        for b in members:
            local = round((b.rank - b.at_or_below_low + 0.5) / b.inside, 6)  # neighbours share edges
            slack = 4.0 * math.sqrt(local * (1.0 - local) / size) + 4.0 / size
            shares += [max(local - slack, 0.0), min(local + slack, 1.0)]
        value = F.col(names[members[0].column])
        taken = _strictly_inside(value, members[0]) & (F.col("__u") < min(size / members[0].inside, 1.0))
        tests.append(taken)
        samples.append(F.percentile(F.when(taken, value), F.array(*[F.lit(s) for s in shares])).alias(f"s{i}"))
    guess = drawn.where(any_of(tests)).agg(*samples).first()
    return {
        id(b): (guess[i][2 * j], guess[i][2 * j + 1])
        for i, members in enumerate(ranges.values()) if guess[i] is not None for j, b in enumerate(members)
    }


def _count_edges(
    df: DataFrame, values: dict[str, Column], edges: set[tuple[str, float]]
) -> dict[tuple[str, float], tuple[int, int]]:
    """Rows below and rows up to each edge."""
    ordered = sorted(edges)
    checks = [
        check for i, (c, e) in enumerate(ordered)
        for check in (F.count_if(values[c] < e).alias(f"b{i}"), F.count_if(values[c] <= e).alias(f"u{i}"))
    ]
    seen = df.agg(*checks).first()
    return {edge: (seen[2 * i], seen[2 * i + 1]) for i, edge in enumerate(ordered)}


def _narrow(
    b: _Bracket, low: float, below_low: int, upto_low: int, high: float, below_high: int, upto_high: int
) -> None:
    """Keep the part of the bracket that the counts prove to hold the rank."""
    upper = b.at_or_below_low + b.inside
    if below_low <= b.rank < upto_low:
        b.value = low
    elif below_high <= b.rank < upto_high:
        b.value = high
    elif b.rank < below_low:
        b.high, b.inside = low, below_low - b.at_or_below_low
    elif b.rank >= upto_high:
        b.low, b.at_or_below_low, b.inside = high, upto_high, upper - upto_high
    else:
        b.low, b.high = low, high
        b.at_or_below_low, b.inside = upto_low, below_high - upto_low


def _read_off(df: DataFrame, values: dict[str, Column], open_brackets: list[_Bracket]) -> None:
    """Exact order statistics from the few rows strictly inside each bracket."""
    if not open_brackets:
        return
    finals, tests = [], []
    for i, b in enumerate(open_brackets):
        share = (b.rank - b.at_or_below_low) / (b.inside - 1) if b.inside > 1 else 0.0
        v = values[b.column]
        tests.append(_strictly_inside(v, b))
        finals.append(F.percentile(F.when(tests[-1], v), min(share, 1.0)).alias(f"f{i}"))
    row = df.where(any_of(tests)).agg(*finals).first()
    for i, b in enumerate(open_brackets):
        b.value = row[i]


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Exact quantiles per group without holding a group in one buffer.

    Rows shrink to (key, value, count) before the shuffle; cumulative counts come from
    the chunked running sum; each quantile is then a plain conditional maximum.
    """
    tallied = (
        df.select(*keys, number(column).alias("__v"))
        .groupBy(*keys, "__v").agg(F.count("__v").alias("__n"))
    )
    upto = running(tallied, keys, ["__v"], [Running("__upto", "sum", F.col("__n"))],
                   rows_per_chunk=rows_per_chunk)
    sizes = tallied.groupBy(*keys).agg(F.sum("__n").alias("__size"))
    if keys:
        renamed = broadcast_if_small(
            sizes.select(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)], "__size")
        )
        pairs = [(k, f"__g{i}") for i, k in enumerate(keys)]
        placed = upto.join(renamed, null_safe(upto, renamed, pairs))
    else:
        placed = upto.withColumn("__size", F.lit(sizes.first()["__size"]))

    def statistic(rank: Column) -> Column:
        hit = (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
        return F.max(F.when(hit, F.col("__v")))

    measures = []
    for p, name in zip(probabilities, names):
        place = F.lit(float(p)) * (F.col("__size") - 1)
        measures += [
            statistic(F.floor(place)).alias(f"__lo_{name}"),
            statistic(F.ceil(place)).alias(f"__hi_{name}"),
            F.max(place - F.floor(place)).alias(f"__fr_{name}"),
        ]
    grouped = placed.groupBy(*keys).agg(*measures)
    return grouped.select(*keys, *[
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__fr_{n}")).alias(n)
        for n in names
    ])
