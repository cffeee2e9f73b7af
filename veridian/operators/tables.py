"""Joins, sets and roll-ups over keyed tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.sources.stages import written


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def side_flags(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All keys of either side with ``side``: both, left, right."""
    a = left.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return a.join(b, list(keys), "full_outer").select(*keys, side.alias("side"))


def model_consistency(left: DataFrame, right: DataFrame, group: str, key: str) -> DataFrame:
    """For each group, ids of both sides and of one only, and whether the sets are equal."""
    sides = side_flags(left, right, [group, key])
    counts = [F.count_if(F.col("side") == s).alias(n) for s, n in (("both", "common"), ("left", "only_left"), ("right", "only_right"))]
    return sides.groupBy(group).agg(*counts).withColumn("consistent", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def run_summary(results: DataFrame, config: dict[str, str]) -> DataFrame:
    """One row about a run (id, caption, retry_attempts): totals, done, failed, retries, success in percent, and its settings as JSON (K6)."""
    total, done = F.count(F.lit(1)), F.count("caption")
    one = results.agg(total.alias("total"), done.alias("completed"), (total - done).alias("failed"), F.coalesce(F.sum("retry_attempts"), F.lit(0)).alias("retries"), F.round(F.coalesce(100.0 * F.try_divide(done, total), F.lit(0.0)), 2).alias("success_pct"))
    return one.withColumn("config", F.lit(json.dumps(config, sort_keys=True)))


def require_same_ids(left: DataFrame, right: DataFrame, key: str) -> None:
    """Unique ids on each side and equal id sets, or an error."""
    for side, name in ((left, "left"), (right, "right")):
        if side.groupBy(key).count().filter("count > 1").limit(1).count():
            raise ValueError(f"the {name} side repeats a {key}")
    if side_flags(left, right, [key]).filter("side <> 'both'").limit(1).count():
        raise ValueError(f"the sides differ in {key}")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by id, after :func:`require_same_ids`."""
    require_same_ids(left, right, key)
    return left.join(right, key)


def first_match(left: DataFrame, right: DataFrame, keys: Sequence[Column], right_key: str, value: str) -> DataFrame:
    """``value`` of the first of several keys that the right side knows, else null."""
    out, found = left, []
    for i, k in enumerate(keys):
        r = right.select(F.col(right_key).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        out = out.join(r, k == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(value, F.coalesce(*found)).select(*left.columns, value)


def siblings(rows: DataFrame, key: str, canonical: Column, manual: DataFrame | None = None) -> DataFrame:
    """Pairs of rows that share a canonical key or a manual group, without themselves."""
    groups = rows.select(F.col(key), canonical.alias("g"))
    if manual is not None:
        groups = groups.union(manual.select(key, "g"))
    other = groups.select(F.col(key).alias("sibling"), "g")
    return groups.join(other, "g").filter(F.col(key) != F.col("sibling")).select(key, "sibling").distinct()


def group_overlap(rows: DataFrame, group: str, item: str) -> DataFrame:
    """Items that each pair of groups shares, zero pairs dropped."""
    r = rows.select(group, item).distinct()
    a, b = r.select(F.col(group).alias("a"), item), r.select(F.col(group).alias("b"), item)
    return a.join(b, item).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def ranked_overlaps(pairs: DataFrame, a: str = "a", b: str = "b", shared: str = "shared") -> DataFrame:
    """``rank`` and both directions of each pair of groups that share something, most first, ties by name."""
    both = pairs.select(a, b, shared).unionByName(pairs.select(F.col(b).alias(a), F.col(a).alias(b), shared)).filter(F.col(shared) > 0)
    # a row for each pair of groups
    return both.withColumn("rank", F.row_number().over(W.orderBy(F.desc(shared), a, b)))


def seed_summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, standard error (0 for one seed) and count."""
    se = F.coalesce(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))
    return rows.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(se, 6).alias("se"), F.count(value).alias("n"))


def by_seed(rows: DataFrame, by: Sequence[str], seed: str, seeds: Sequence, value: str) -> DataFrame:
    """One column for each seed, null where it is missing."""
    wide = rows.groupBy(*by).pivot(seed, list(seeds)).agg(F.first(value))
    return wide.select(*by, *[F.col(str(s)).alias(f"seed_{s}") for s in seeds])


def variant_delta(rows: DataFrame, by: Sequence[str], variant: str, a: str, b: str, value: str, mark: float) -> DataFrame:
    """Variant ``b`` less variant ``a`` with a mark for large differences."""
    x = rows.filter(F.col(variant) == a).select(*by, F.col(value).alias("_a"))
    y = rows.filter(F.col(variant) == b).select(*by, F.col(value).alias("_b"))
    d = F.round(F.col("_b") - F.col("_a"), 6)
    return x.join(y, list(by)).select(*by, d.alias("delta"), F.when(d >= mark, "+").when(d <= -mark, "-").otherwise("").alias("marker"))


def best_row(rows: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """First row with the largest value."""
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(value, -F.col(order))).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest])


def offsets(rows: DataFrame, order: str, length: Column, ranges: int = 64) -> DataFrame:
    """Start of each row's stretch in one flat array.

    Rows are dealt out by quantiles of ``order`` (a number); a prefix sum in each range goes on from the totals of those before,
    one row for each.
    """
    cuts = sorted(set(rows.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.2 / ranges)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    dealt = rows.withColumn("_length", length).withColumn("_part", part)
    totals = dealt.groupBy("_part").agg(F.sum("_length").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("_length").over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(totals.select("_part", before.alias("_before")), "_part").select(*rows.columns, (F.col("_own") + F.col("_before")).alias("start"))


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "number") -> DataFrame:
    """``rows`` with their place (from 0) in the order of all rows.

    Ranges of the order are sorted by their own tasks and written; a row's place is its place in the range and the
    number of rows before that, one count for each range.  No window covers all rows.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("_range", F.shiftright("_id", 33))
    heads = ranged.groupBy("_range").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    heads = heads.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n") - F.col("_first")).alias("_shift"))
    # one row for each partition
    return ranged.join(F.broadcast(heads), "_range").withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")


def dense_labels(rows: DataFrame, label: str, unknown: str = "Unknown") -> DataFrame:
    """Class number of each label in order, the unknown class last."""
    names = rows.select(label).distinct()
    return names.withColumn("class_id", F.row_number().over(W.orderBy(F.col(label) == unknown, label)) - 1)
