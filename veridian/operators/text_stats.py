"""Statistics over captions: compliance, vocabulary, phrases, anchors' terms.

All levels of a report come from one scan through GROUPING SETS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridian.functions import text as T
from veridian.functions.geometry import f1, percentage, share


def running_stats(value: Column, name: str) -> list[Column]:
    """Count, mean, population deviation, least and largest; zeros where there is no value (A1, A2)."""
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return [
        F.count(value).alias(f"{name}_n"),
        zero(F.avg(value)).alias(f"{name}_mean"),
        zero(F.stddev_pop(value)).alias(f"{name}_std"),
        zero(F.min(value).cast("double")).alias(f"{name}_min"),
        zero(F.max(value).cast("double")).alias(f"{name}_max"),
    ]


def levels(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """Aggregates at several levels; ``level`` names the columns that a row groups by, ``all`` for none."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    if not names:
        return df.agg(*aggregates).withColumn("level", F.lit("all"))
    by = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    marks = [F.when(F.grouping(c) == 0, F.lit(c)) for c in names]
    level = F.coalesce(F.nullif(F.concat_ws("+", *marks), F.lit("")), F.lit("all")).alias("level")
    return by.agg(level, *aggregates)


def compliance(captions: DataFrame, text: str, sets: Sequence[Sequence[str]], opener: str) -> DataFrame:
    """Length, sentence and word statistics with percentiles and rule shares at several levels (A3, A5)."""
    words = T.tokens(F.col(text))
    df = captions.select(
        *dict.fromkeys(c for s in sets for c in s),
        F.size(words).alias("words"),
        F.char_length(text).alias("chars"),
        T.sentence_count(F.col(text)).alias("sentences"),
        T.has_digit(F.col(text)).cast("int").alias("digit"),
        T.leaks_size(F.col(text)).cast("int").alias("size_leak"),
        T.opens_with(F.col(text), opener).cast("int").alias("opener"),
    )
    marks = [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY words)").cast("long").alias(f"words_p{p}") for p in (5, 25, 50, 75, 95)]
    rates = [percentage(F.sum(c), F.count(F.lit(1))).alias(f"{c}_pct") for c in ("digit", "size_leak", "opener")]
    return levels(df, sets, *running_stats(F.col("words"), "words"), *running_stats(F.col("chars"), "chars"), *running_stats(F.col("sentences"), "sentences"), *marks, *rates)


def vocabulary(captions: DataFrame, text: str, by: str) -> DataFrame:
    """Distinct words, words and their ratio for each group."""
    words = captions.select(by, F.explode(T.tokens(F.col(text))).alias("word"))
    counts = words.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("words"), F.round(F.count(F.lit(1)) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("ttr"))


def phrase_counts(captions: DataFrame, text: str, phrases: Sequence[str]) -> DataFrame:
    """Captions that hold each phrase, with their share (A7).  One pass: a sum for each phrase, then a stack."""
    sums = [F.sum(T.contains_phrase(F.col(text), p).cast("long")).alias(f"p{i}") for i, p in enumerate(phrases)]
    one = captions.agg(F.count(F.lit(1)).alias("total"), *sums)
    rows = F.array(*[F.struct(F.lit(p).alias("phrase"), F.coalesce(F.col(f"p{i}"), F.lit(0)).alias("captions")) for i, p in enumerate(phrases)])
    return one.select("total", F.explode(rows).alias("r")).select("r.phrase", "r.captions", percentage(F.col("r.captions"), F.col("total")).alias("pct"))


def term_frequencies(captions: DataFrame, text: str, document: str) -> DataFrame:
    """Content words with their occurrences and the number of documents that hold them."""
    words = captions.select(document, F.explode(T.content_words(T.tokens(F.col(text)))).alias("term"))
    each = words.groupBy("term", document).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("term_frequency"), F.count(F.lit(1)).alias("document_frequency"))


def frequent_bigrams(captions: DataFrame, text: str, least: int = 3) -> DataFrame:
    """Bigrams with at least ``least`` occurrences."""
    return captions.select(F.explode(T.bigrams(F.col(text))).alias("bigram")).groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def anchor_overlap(captions: DataFrame, text: str, terms: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Precision, recall and F1 of each caption's content words against the vocabulary of anchors, at several levels.

    ``terms`` (term) is joined by word, so its size does not matter; recall is against all of it.
    """
    terms = terms.select("term").distinct()
    total = terms.agg(F.count(F.lit(1)).alias("anchor_terms"))
    groups = list(dict.fromkeys(c for s in sets for c in s))
    # a caption's words leave one task together, so they are counted before anything moves
    rows = captions.select(F.monotonically_increasing_id().alias("_row"), *groups, F.array_distinct(T.content_words(T.tokens(F.col(text)))).alias("_words"))
    words = rows.select("_row", *groups, F.explode_outer("_words").alias("term"))
    known = terms.withColumn("_known", F.lit(1))
    each = words.join(known, "term", "left").groupBy("_row", *groups).agg(F.count("term").alias("n_terms"), F.count("_known").alias("hits"))
    # one row
    each = each.crossJoin(F.broadcast(total))
    each = each.withColumn("precision", F.col("hits") / F.greatest("n_terms", F.lit(1))).withColumn("recall", share(F.col("hits"), F.col("anchor_terms")))
    each = each.withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return levels(each, sets, *running_stats(F.col("precision"), "precision"), *running_stats(F.col("recall"), "recall"), *running_stats(F.col("f1"), "f1"), *running_stats(F.col("n_terms"), "terms"))


def term_usage(captions: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """Every anchor term with the captions that use it; unused ones have 0."""
    terms = terms.select("term").distinct()
    used = captions.select(F.explode(F.array_distinct(T.content_words(T.tokens(F.col(text))))).alias("term"))
    used = used.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("captions"))
    return terms.join(used, "term", "left").select("term", F.coalesce("captions", F.lit(0)).alias("captions"))


def usage_coverage(usage: DataFrame) -> DataFrame:
    """Terms, used terms and their share of a :func:`term_usage`."""
    used = F.sum((F.col("captions") > 0).cast("long"))
    return usage.agg(F.count(F.lit(1)).alias("terms"), used.alias("used"), percentage(used, F.count(F.lit(1))).alias("coverage_pct"))


def most_common(counts: DataFrame, item: str, n: str, k: int) -> DataFrame:
    """The k largest counts, ties by item."""
    return counts.orderBy(F.desc(n), item).limit(k)
