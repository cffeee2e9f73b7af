"""Agreement of two captions of one thing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.functions import text as T
from veridian.functions.draws import draw
from veridian.operators.text_stats import levels, running_stats


def last_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key, the last by ``order``; with the number of rows that it replaced."""
    values = [c for c in rows.columns if c not in keys]
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return out.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values], "duplicates")


def pair_join(left: DataFrame, right: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Both texts of each key, one null where a side has none."""
    a = left.select(*keys, F.col(text).alias("text_a"), F.lit(True).alias("in_a"))
    b = right.select(*keys, F.col(text).alias("text_b"), F.lit(True).alias("in_b"))
    return a.join(b, list(keys), "full_outer").withColumn("matched", F.coalesce(F.col("in_a") & F.col("in_b"), F.lit(False)))


def with_jaccard(pairs: DataFrame) -> DataFrame:
    """Word-set similarity of matched pairs; null where a side has no words, which is matched but not scored."""
    a, b = F.array_distinct(T.tokens(F.col("text_a"))), F.array_distinct(T.tokens(F.col("text_b")))
    scored = F.when(F.col("matched") & (F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    return pairs.withColumn("jaccard", scored)


def agreement_report(pairs: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Jaccard statistics with matched, scored and unmatched counts at several levels (A10)."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return levels(
        pairs,
        sets,
        *running_stats(F.col("jaccard"), "jaccard"),
        count(F.col("matched")).alias("matched"),
        F.count("jaccard").alias("scored"),
        count(F.col("in_a") & F.col("in_b").isNull()).alias("only_a"),
        count(F.col("in_b") & F.col("in_a").isNull()).alias("only_b"),
    )


def symmetric_matrix(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(i, j) also as (j, i), and 1 on the diagonal."""
    flipped = pairs.select(F.col(b).alias(a), F.col(a).alias(b), value)
    names = pairs.select(F.col(a).alias("n")).union(pairs.select(F.col(b).alias("n"))).distinct()
    diagonal = names.select(F.col("n").alias(a), F.col("n").alias(b), F.lit(1.0).alias(value))
    return pairs.select(a, b, value).union(flipped).union(diagonal)


def group_vocabulary_pairs(captions: DataFrame, text: str, group: str) -> DataFrame:
    """All unordered pairs of groups with the Jaccard similarity of their vocabularies.

    The pairs come from words that groups share, never from texts.
    """
    words = captions.select(F.col(group).alias("g"), F.explode(T.tokens(F.col(text))).alias("word")).distinct()
    sizes = words.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    a, b = words.select(F.col("g").alias("a"), "word"), words.select(F.col("g").alias("b"), "word")
    both = a.join(b, "word").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    pairs = sizes.select(F.col("g").alias("a"), F.col("n").alias("na")).join(sizes.select(F.col("g").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    pairs = pairs.join(both, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return pairs.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def shuffled_pairs(pairs: DataFrame, keys: Sequence[str], group: Sequence[str], seed: int) -> DataFrame:
    """Matched pairs with the second text taken from another pair of the group by a repeatable shuffle."""
    matched = pairs.filter("matched")
    by = W.partitionBy(*group)
    order = F.row_number().over(by.orderBy(*keys))
    shuffled = F.row_number().over(by.orderBy(draw(seed, *[F.col(k) for k in keys]), *keys))
    a = matched.select(*group, *[k for k in keys if k not in group], "text_a", order.alias("_n"))
    b = matched.select(*group, "text_b", shuffled.alias("_n"))
    return a.join(b, [*group, "_n"]).drop("_n").withColumn("matched", F.lit(True))
