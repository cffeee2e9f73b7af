"""Splits, samples and budgets.  Draws are md5 hashes of keys and a seed, so they repeat in any plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.functions.draws import draw
from veridian.operators.tables import numbered
from veridian.sources.stages import written


def split(rows: DataFrame, group: Sequence[str], key: str, ratio: float, seed: int = 42) -> DataFrame:
    """``split``: the first int(n * ratio) rows of each group in hash order are train, the rest val."""
    by = W.partitionBy(*group)
    n, r = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(draw(seed, F.col(key)), key))
    return rows.withColumn("split", F.when(r <= F.floor(n * ratio), "train").otherwise("val"))


def cap(rows: DataFrame, group: Sequence[str], key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each group, in hash order."""
    r = F.row_number().over(W.partitionBy(*group).orderBy(draw(seed, F.col(key)), key))
    return rows.withColumn("_r", r).filter(F.col("_r") <= most).drop("_r")


def crop_sample(rows: DataFrame, positive: Column, key: str, most: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``most`` positive rows and no more negative ones than those, with ``is_positive``.

    Rows that are neither (null) go.  Only the first ``most`` of each kind are ordered.
    """
    marked = rows.withColumn("is_positive", positive).filter(F.col("is_positive").isNotNull())
    rank = F.row_number().over(W.partitionBy("is_positive").orderBy(draw(seed, F.col(key)), key))
    ranked = marked.withColumn("_r", rank).filter(F.col("_r") <= most)
    # one number
    taken = ranked.agg(F.count_if("is_positive").alias("_n"))
    return ranked.join(F.broadcast(taken), F.lit(True)).filter(F.col("_r") <= F.col("_n")).drop("_r", "_n")


def simple_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, all if there are fewer."""
    return rows.orderBy(draw(seed, F.col(key)), key).limit(n)


def balanced_resample(rows: DataFrame, label: str, key: str, low: int, high: int, seed: int = 42) -> DataFrame:
    """Classes below ``low`` are drawn with replacement up to it, above ``high`` thinned to it."""
    by = W.partitionBy(label)
    ranked = rows.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_r", F.row_number().over(by.orderBy(draw(seed, F.col(key)), key)))
    kept = ranked.filter((F.col("_n") >= low) & (F.col("_r") <= high)).drop("_n", "_r")
    small = ranked.filter(F.col("_n") < low)
    picks = small.select(label, "_n").distinct().withColumn("_d", F.explode(F.sequence(F.lit(1), F.lit(low))))
    picks = picks.select(label, (F.pmod(draw(seed, F.col(label), F.col("_d")), F.col("_n")) + 1).cast("int").alias("_r"))
    return kept.unionByName(picks.join(small.drop("_n"), [label, "_r"]).drop("_r").select(*kept.columns))


def sqrt_targets(counts: DataFrame, n: str) -> DataFrame:
    """min(int(min * sqrt(c / min)), c)."""
    low = F.min(n).over(W.partitionBy())
    return counts.withColumn("target", F.least((low * F.sqrt(F.col(n) / low)).cast("long"), F.col(n)))


def weighted_sample(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Draws with replacement, each class exactly its square-root target: a stratified draw (:func:`epoch_draws` draws over all rows)."""
    counts = sqrt_targets(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "_n")
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(label).orderBy(key)))
    picks = counts.withColumn("_d", F.explode(F.sequence(F.lit(1), F.col("target").cast("int"))))
    picks = picks.select(label, "_d", (F.pmod(draw(seed, F.col(label), F.col("_d")), F.col("_n")) + 1).cast("int").alias("_r"))
    return picks.join(ranked, [label, "_r"]).drop("_r").withColumnRenamed("_d", "draw")


def proportional_budget(counts: DataFrame, n: str, key: str, total: int) -> DataFrame:
    """Floor shares of ``total``, the rest to the largest fractions."""
    whole = F.sum(n).over(W.partitionBy())
    exact = F.col(n) * total / whole
    shares = counts.withColumn("_f", F.floor(exact)).withColumn("_x", exact - F.floor(exact))
    left = total - F.sum("_f").over(W.partitionBy())
    order = F.row_number().over(W.orderBy(F.desc(F.round("_x", 9)), key))
    return shares.withColumn("budget", (F.col("_f") + F.when(order <= left, 1).otherwise(0)).cast("long")).drop("_f", "_x")


def allocate(children: DataFrame, parent: Sequence[str], child: str, n: str, total: Column, least: int = 1) -> DataFrame:
    """``children`` with ``budget``: the parent's ``total`` shared out by capacity ``n`` with a minimum.

    Children with a capacity get ``least`` each while the total lasts, the largest first where it does not; the rest goes by
    what capacity is left, floors first, one more to the largest fractions (then larger capacity, then name).  Integers only,
    so no share depends on rounding; what no capacity can take is left over.
    """
    by = W.partitionBy(*parent)
    long = lambda c: c.cast("decimal(38,0)")
    out = children.withColumn("_left", F.greatest(total, F.lit(0)).cast("long")).withColumn("budget", F.lit(0).cast("long"))
    for _ in range(least):
        open_ = F.col("budget") < F.col(n)
        place = F.row_number().over(by.orderBy(open_.desc(), F.desc(n), child))
        out = out.withColumn("_place", place).withColumn("_open", F.sum(open_.cast("long")).over(by))
        out = out.withColumn("budget", F.col("budget") + (open_ & (F.col("_place") <= F.col("_left"))).cast("long")).withColumn("_left", F.greatest(F.col("_left") - F.col("_open"), F.lit(0)))
    out = out.withColumn("_room", F.greatest(F.col(n) - F.col("budget"), F.lit(0))).withColumn("_rooms", F.sum("_room").over(by))
    left = F.least("_left", "_rooms")
    share = long(left) * long(F.col("_room"))
    out = out.withColumn("_floor", F.when(F.col("_rooms") > 0, F.expr("cast(least(_left, _rooms) as decimal(38,0)) * cast(_room as decimal(38,0)) div _rooms")).otherwise(0))
    out = out.withColumn("_part", F.when(F.col("_rooms") > 0, share - long(F.col("_floor")) * long(F.col("_rooms"))).otherwise(long(F.lit(0))))
    # floors leave fewer units than there are children with a fraction, and those have room
    spare = left - F.sum("_floor").over(by)
    last = F.row_number().over(by.orderBy(F.desc("_part"), F.desc("_room"), child))
    out = out.withColumn("_spare", spare).withColumn("_place", last)
    return out.withColumn("budget", (F.col("budget") + F.col("_floor") + (F.col("_place") <= F.col("_spare")).cast("long")).cast("long")).drop("_left", "_place", "_open", "_room", "_rooms", "_floor", "_part", "_spare")


def nested_budgets(rows: DataFrame, levels: Sequence[str], total: int, least: int = 1) -> DataFrame:
    """``levels``..., n, budget: ``total`` shared out over the first level, each share over the next, and so on."""
    budgets = None
    for depth in range(1, len(levels) + 1):
        keys = list(levels[:depth])
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        if budgets is None:
            budgets = allocate(counts, [], keys[-1], "n", F.lit(total), least)
        else:
            above = budgets.select(*keys[:-1], F.col("budget").alias("_total"))
            budgets = allocate(counts.join(above, keys[:-1]), keys[:-1], keys[-1], "n", F.col("_total"), least).drop("_total")
    return budgets


def smallest_draws(rows: DataFrame, group: Sequence[str], key: str, take: DataFrame, seed: int = 42) -> DataFrame:
    """The rows of each group with the smallest hashed draws, as many as ``take`` (group..., n, budget) says, with ``place``.

    Rows well above the budget's share of the draws are put aside before anything is ranked; groups that come out short
    (fewer than one in 10^9) are ranked whole.
    """
    group = list(group)
    cut = (F.col("budget") + 6 * F.sqrt("budget") + 10) / F.col("n")
    drawn = rows.join(take.filter("budget > 0").select(*group, F.col("n").alias("_n"), F.col("budget").alias("_budget"), cut.alias("_cut")), group).withColumn("_draw", draw(seed, F.col(key)))
    near = drawn.filter(F.col("_draw") < F.col("_cut") * 4294967296.0)
    short = take.filter("budget > 0").join(near.groupBy(*group).agg(F.count(F.lit(1)).alias("_have")), group, "left").filter(F.coalesce("_have", F.lit(0)) < F.least("budget", "n")).select(*group)
    chosen = near.join(short, group, "left_anti").unionByName(drawn.join(short, group, "left_semi"))
    place = F.row_number().over(W.partitionBy(*group).orderBy("_draw", key))
    return chosen.withColumn("place", place).filter(F.col("place") <= F.col("_budget")).drop("_n", "_budget", "_cut", "_draw")


def audit_sample(rows: DataFrame, levels: Sequence[str], key: str, total: int, seed: int = 42) -> DataFrame:
    """A sample of at most ``total`` rows by nested budgets, trimmed to it, with ``audit_id`` in the order of the levels and draws.

    The sample is a report of ``total`` rows, so its numbering is one window.
    """
    chosen = smallest_draws(rows, levels, key, nested_budgets(rows, levels, total), seed)
    trimmed = chosen.orderBy(draw(seed, F.lit("trim"), F.col(key)), key).limit(total)
    number = F.row_number().over(W.orderBy(*levels, "place")) - 1
    return trimmed.withColumn("audit_id", F.concat(F.lit("audit_"), F.lpad(number.cast("string"), 5, "0"))).drop("place")


#: Weights are whole numbers of this part of a unit, so sums are exact in any order.
WEIGHT_UNIT = 1 << 20


def weighted_draws(rows: DataFrame, weight: Column, order: Sequence[str], draws: int, seed: int = 42) -> DataFrame:
    """``draw`` (from 0) and the drawn row: independent draws over all rows by weight, with replacement.

    Rows are put on a line, each as long as its weight, by two prefix sums: inside ranges of ``order`` and over the
    ranges.  A draw is a hashed place on the line.  Line and draws meet in stretches of equal length, so a heavy row is
    in many stretches and a crowd of light rows in one with few draws.  Rows without weight are never drawn.
    """
    spark, order = rows.sparkSession, list(order)
    sized = rows.withColumn("_w", F.round(F.coalesce(weight, F.lit(0.0)) * WEIGHT_UNIT).cast("long")).filter("_w > 0")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sized.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("_range", F.shiftright("_id", 33))
    own = F.sum("_w").over(W.partitionBy("_range").orderBy("_id"))
    totals = ranged.groupBy("_range").agg(F.sum("_w").alias("_sum"))
    before = totals.select("_range", (F.sum("_sum").over(W.orderBy("_range")) - F.col("_sum")).alias("_before"))
    line = ranged.withColumn("_end", own).join(before, "_range").withColumn("_end", F.col("_end") + F.col("_before")).withColumn("_start", F.col("_end") - F.col("_w"))
    count, length = ranged.agg(F.count(F.lit(1)), F.sum("_w")).first()
    if not count:
        return rows.limit(0).select(F.lit(0).cast("long").alias("draw"), "*")
    stretch = max(1, -(-length // max(1, count // 64)))
    wide = F.sequence(F.floor(F.col("_start") / stretch), F.floor((F.col("_end") - 1) / stretch))
    line = line.withColumn("_stretch", F.explode(wide)).select("_stretch", "_start", "_end", *rows.columns)
    spot = (draw(seed, F.col("draw"), 0).cast("decimal(38,0)") * 4294967296 + draw(seed, F.col("draw"), 1)).alias("_u")
    places = spark.range(draws).select(F.col("id").alias("draw")).select("draw", spot)
    places = places.select("draw", F.expr(f"cast((_u * {length}BD) div 18446744073709551616BD as long)").alias("_at"))
    places = places.withColumn("_stretch", F.floor(F.col("_at") / stretch))
    return places.join(line, "_stretch").filter("_at >= _start and _at < _end").select("draw", *rows.columns)


def epoch_draws(rows: DataFrame, label: str, order: Sequence[str], seed: int = 42) -> DataFrame:
    """One epoch of draws with replacement: every row weighs its class's square-root target over its size, and the targets' sum is drawn."""
    targets = sqrt_targets(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "_n")
    draws = targets.agg(F.sum("target")).first()[0] or 0
    weighed = rows.join(targets, label).withColumn("_weight", F.col("target") / F.col("_n")).drop("_n", "target")
    return weighted_draws(weighed, F.col("_weight"), [label, *order], draws, seed).drop("_weight")


def budget_sample(rows: DataFrame, group: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """A sample without replacement with a proportional budget for each group."""
    counts = proportional_budget(rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), "_n", group, total)
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(draw(seed, F.col(key)), key)))
    return ranked.join(counts.select(group, "budget"), group).filter(F.col("_r") <= F.col("budget")).drop("_r", "budget")


def shuffled_labels(rows: DataFrame, label: str, key: str, group: Sequence[str], seed: int) -> DataFrame:
    """Labels permuted within the group (R8); ``key`` names a row.

    Rows in the order of (group, key) meet labels in the order of (group, draw): a group has the same places in
    both, so the numbers are of all rows and no group is ranked by one task.
    """
    a = numbered(rows.drop(label), [*group, key], "_n")
    b = numbered(rows.select(*group, label, draw(seed, F.col(key)).alias("_draw"), F.col(key).alias("_key")), [*group, "_draw", "_key"], "_n")
    return a.join(b.select("_n", label), "_n").drop("_n")


def verify_split(samples: DataFrame, key: str, split_col: str = "split") -> DataFrame:
    """Samples, keys on both sides, and the verdict."""
    each = samples.groupBy(key).agg(F.count_distinct(split_col).alias("_s"))
    return each.agg(F.count(F.lit(1)).alias("samples"), F.sum((F.col("_s") > 1).cast("long")).alias("leaked")).withColumn("passed", F.col("leaked") == 0)


def require_coverage(samples: DataFrame, embeddings: DataFrame, key: str, least: float = 0.95, from_rows: int = 100) -> float:
    """Share of samples with an embedding; raises below ``least`` for more than ``from_rows`` samples."""
    flagged = samples.select(key).join(embeddings.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    n, have = flagged.agg(F.count(F.lit(1)), F.count("_in")).first()
    covered = have / n if n else 1.0
    if n > from_rows and covered < least:
        raise ValueError(f"only {covered:.1%} of {n} samples have an embedding")
    return covered
