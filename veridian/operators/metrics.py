"""Classification metrics from rows of (label, pred) and optional flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridian.functions.geometry import f1, share


def confusion(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Dense counts over all classes of either side."""
    counts = rows.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    names = counts.select(F.col(label).alias("c")).union(counts.select(F.col(pred).alias("c"))).distinct()
    grid = names.select(F.col("c").alias(label)).join(names.select(F.col("c").alias(pred)), F.lit(True))
    return grid.join(counts, [label, pred], "left").select(label, pred, F.coalesce("n", F.lit(0)).alias("n"))


def class_report(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 (x 100) and support of classes present in truth."""
    counts = rows.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0))
    truth = counts.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    guess = counts.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("guesses"))
    both = truth.join(guess, "class", "left").withColumn("guesses", F.coalesce("guesses", F.lit(0)))
    both = both.withColumn("precision", 100.0 * share(F.col("hits"), F.col("guesses"))).withColumn("recall", 100.0 * share(F.col("hits"), F.col("support")))
    return both.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def class_breakdown(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """``class``, ``count``, ``accuracy`` (x 100) and ``predicted_as``, a map of predictions and how often, for each class present in truth.

    Rows without a label are left out; a missing prediction is the key ``null``, so predictions are told as text.
    """
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    hits = F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0))
    told = F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(pred).cast("string"), F.lit("null")).alias("key"), F.col("n").alias("value"))))
    return counts.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("count"), (100.0 * hits / F.sum("n")).alias("accuracy"), F.map_from_entries(told).alias("predicted_as"))


def overall(rows: DataFrame, label: str = "label", pred: str = "pred", top5: str | None = None) -> DataFrame:
    """Accuracy, macro and weighted scores."""
    report = class_report(rows, label, pred)
    macro = report.agg(
        F.round(100.0 * F.sum("hits") / F.sum("support"), 4).alias("top1"),
        *[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"),
        F.sum("support").alias("samples"),
        F.count(F.lit(1)).alias("classes"),
    )
    if top5 is None:
        return macro
    return macro.join(rows.agg(F.round(100.0 * F.avg(F.col(top5).cast("double")), 4).alias("top5")), F.lit(True))


def micro_scores(tp, fp, fn) -> list:
    """Micro-averaged precision, recall and F1 of summed counts; 0 where undefined."""
    p, r = share(F.sum(tp), F.sum(tp) + F.sum(fp)), share(F.sum(tp), F.sum(tp) + F.sum(fn))
    return [F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1")]


def class_weights(rows: DataFrame, label: str, scheme: str = "sqrt") -> DataFrame:
    """Square-root or inverse weights on count + 1, scaled to sum to the number of classes."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    raw = 1.0 / F.sqrt(F.col("n") + 1.0) if scheme == "sqrt" else 1.0 / (F.col("n") + 1.0)
    total = counts.agg(F.sum(raw).alias("_t"), F.count(F.lit(1)).alias("_c"))
    return counts.join(F.broadcast(total), F.lit(True)).select(label, "n", F.round(raw * F.col("_c") / F.col("_t"), 6).alias("weight"))
