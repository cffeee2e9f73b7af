"""Run metrics in step order: entropy, moving averages, counters, stop rules."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON = 1e-10


def entropy_term(w: Column) -> Column:
    """-w ln(w + epsilon)."""
    return -w * F.log(w + EPSILON)


def incremental_entropy(steps: DataFrame, group: list[str], order: list[str], old: str, new: str) -> DataFrame:
    """Entropy change summed along the steps."""
    by = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return steps.withColumn("entropy", F.sum(entropy_term(F.col(new)) - entropy_term(F.col(old))).over(by))


def windowed_delta(steps: DataFrame, group: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Value less the one ``window`` steps before, 0 until there is one."""
    by = W.partitionBy(*group).orderBy(*order)
    return steps.withColumn("delta", F.coalesce(F.col(value) - F.lag(value, window).over(by), F.lit(0.0)))


def series(steps: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The values of each group as one array in step order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v"))))
    return steps.groupBy(*group).agg(F.transform(rows, lambda r: r["v"]).alias("values"))


def ema(values: Column, alpha: float) -> Column:
    """Final moving average of an array without NaN, seeded with its first value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise((1 - alpha) * s + alpha * x))


def folded(steps: DataFrame, group: Sequence[str], order: Sequence[str], inputs: Sequence[str], outputs: str, start: object, step: Callable) -> DataFrame:
    """``steps`` with the columns ``outputs`` (a schema), from a fold over each group in order.

    ``step(state, *inputs)`` gives the next state and the outputs of the row.  Rows stream through the task in order
    and only the state is kept, so a long group takes time but no memory.
    """
    group, order, names = list(group), list(order), [f.split()[0] for f in outputs.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in steps.schema.fields) + ", " + outputs

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whose, state = None, start
        for frame in frames:
            out = []
            for key, values in zip(zip(*(frame[g] for g in group)), zip(*(frame[c] for c in inputs))):
                if key != whose:
                    whose, state = key, start
                state, row = step(state, *values)
                out.append(row)
            yield frame.assign(**{n: [row[i] for row in out] for i, n in enumerate(names)})

    return steps.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)


def moving_average(steps: DataFrame, group: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.01) -> DataFrame:
    """``average`` at every step, seeded with the first value."""

    def step(last, x):
        now = x if last is None else (1 - alpha) * last + alpha * x
        return now, (now,)

    return folded(steps, group, order, [value], "average double", None, step)


def confidence_average(steps: DataFrame, group: Sequence[str], order: Sequence[str], value: str, momentum: float = 0.9) -> DataFrame:
    """``raw`` and ``average`` at every step; a missing value (NaN or null) counts as the raw value before it, the first one as 0."""

    def step(state, x):
        raw, last = state
        raw = raw if x is None or math.isnan(x) else x
        now = raw if last is None else momentum * last + (1 - momentum) * raw
        return (raw, now), (raw, now)

    return folded(steps, group, order, [value], "raw double, average double", (0.0, None), step)


def flat_counter(steps: DataFrame, group: Sequence[str], order: Sequence[str], value: str, threshold: float, window: int) -> DataFrame:
    """``step`` (from 1) and ``counter`` at every step: +1 above the threshold, -2 (not below 0) under it, the same at it; it starts after ``window`` + 1 steps."""

    def step(state, x):
        done, counter = state
        if done > window:
            counter = counter + 1 if x > threshold else max(counter - 2, 0) if x < threshold else counter
        return (done + 1, counter), (done + 1, counter)

    return folded(steps, group, order, [value], "step long, counter long", (0, 0), step)


def status_ratios(points: DataFrame, group: Sequence[str], order: Sequence[str], status: str, classes: Sequence[str], every: int, momentum: float = 0.9) -> DataFrame:
    """``flush`` and, for each class, its share of all statuses up to the flush and the moving average of that.

    Points are flushed ``every`` so many.  A flush writes its share and average to all points since the one before; points
    that no flush has seen repeat the last values (0 before the first flush).
    """
    group, order = list(group), list(order)
    place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    points = points.withColumn("flush", F.floor((place - 1) / every).cast("long"))
    count = lambda c: F.sum((F.col(status) == c).cast("long"))
    flushes = points.groupBy(*group, "flush").agg(F.count(F.lit(1)).alias("_n"), *(count(c).alias(f"_{c}") for c in classes))
    so_far = W.partitionBy(*group).orderBy("flush")
    shares = flushes.select(*group, "flush", (F.col("_n") == every).alias("_whole"), *((F.sum(f"_{c}").over(so_far) / F.sum("_n").over(so_far)).alias(f"_{c}") for c in classes))

    def step(state, whole, *raw):
        if whole:
            raw, last = [float(x) for x in raw], state[1]
            state = (raw, raw if last is None else [momentum * a + (1 - momentum) * x for a, x in zip(last, raw)])
        return state, tuple(v for pair in zip(state[0], state[1] or state[0]) for v in pair)

    names = ", ".join(f"{c}_share double, {c}_average double" for c in classes)
    averages = folded(shares, group, ["flush"], ["_whole", *(f"_{c}" for c in classes)], names, ([0.0] * len(classes), None), step)
    return points.join(averages.drop("_whole", *(f"_{c}" for c in classes)), [*group, "flush"])


def stop_reason(step: Column, counter: Column, discarded: Column, bad_masks: Column, window: int, patience: int, bad_share: float, least_steps: int = 10_000, most_discarded: float = 0.8) -> Column:
    """Why mining stops at a step, null if it goes on: flat entropy (A), discarded objects (B), bad masks (C), in this order."""
    flat = (step > window) & (counter >= patience * window)
    bad = (step > least_steps) & (bad_masks / step > bad_share)
    return F.when(flat, "flat entropy").when(discarded > most_discarded, "discarded objects").when(bad, "bad masks")


def first_stops(steps: DataFrame, group: Sequence[str], step: str, reason: str) -> DataFrame:
    """The first step of each group with a reason to stop, and the reason; groups that never stop have null."""
    hit = F.min(F.when(F.col(reason).isNotNull(), F.struct(F.col(step).alias("s"), F.col(reason).alias("r"))))
    return steps.groupBy(*group).agg(hit.alias("_hit"), F.count(F.lit(1)).alias("steps")).select(*group, "steps", F.col("_hit.s").alias("stop"), F.col("_hit.r").alias("reason"))


def top_k_reservoir(rows: DataFrame, group: list[str], score: str, key: str, k: int) -> DataFrame:
    """Final state of a reservoir that takes strictly better rows: the k best, ties to the first."""
    r = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), key))
    return rows.withColumn("rank", r).filter(F.col("rank") <= k)
