"""Retrieval over vectors: scoring, exclusion modes, ranking metrics, macro means, bootstrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.functions.draws import draw
from veridian.functions.vectors import dot, mean_vector
from veridian.session import scratch

#: Queries are broadcast in blocks of about this many rows.
MOST_BROADCAST_QUERIES = 20_000


def class_means(corpus: DataFrame, by: list[str], size: int, vector: str = "embedding") -> DataFrame:
    """Mean vector of each group as its query."""
    return corpus.groupBy(*by).agg(mean_vector(vector, size).alias("query"), F.count(F.lit(1)).alias("members"))


def medoids(corpus: DataFrame, by: list[str], key: str, size: int, vector: str = "embedding") -> DataFrame:
    """Row of each group with the largest summed similarity to it (V8).

    For unit vectors that sum is the dot product with the group's vector sum, so it takes one aggregation and
    one join, not all pairs.
    """
    total = corpus.groupBy(*by).agg(F.array(*[F.sum(F.col(vector)[i].cast("double")) for i in range(size)]).alias("_total"))
    scored = corpus.join(total, by).withColumn("similarity", F.round(dot(F.col(vector).cast("array<double>"), F.col("_total")), 6))
    return scored.groupBy(*by).agg(F.max_by(key, F.struct("similarity", -F.col(key))).alias(key), F.max("similarity").alias("similarity"))


def score_pairs(queries: DataFrame, corpus: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every query against every corpus row (J14, V4): queries are counted and broadcast in blocks, each of which meets the whole corpus."""
    blocks = max(1, -(-queries.count() // MOST_BROADCAST_QUERIES))
    number = F.pmod(F.xxhash64(*[c for c in queries.columns if c != "query"], F.to_json(F.struct("query"))), F.lit(blocks))
    parts = [queries] if blocks == 1 else [queries.filter(number == i) for i in range(blocks)]
    pairs = reduce(DataFrame.union, [corpus.join(F.broadcast(q), F.lit(True)) for q in parts])
    return pairs.withColumn("score", F.round(dot(F.col(vector).cast("array<double>"), F.col("query")), 9))


def exclusion(mode: str, query_slide: Column, slide: Column, query_origin: Column, origin: Column, sibling: Column | None = None) -> Column:
    """Rows that a query may meet (E3): ``all``, ``full`` (not its slide or siblings), ``cross_regional`` (not its origin)."""
    if mode == "all":
        return F.lit(True)
    if mode == "full":
        other = query_slide != slide
        return other if sibling is None else other & ~sibling
    if mode == "cross_regional":
        return query_origin != origin
    raise ValueError(f"no such mode: {mode}")


def ranked(scored: DataFrame, query: list[str], key: str) -> DataFrame:
    """Rank within each query, best first, ties by key."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*query).orderBy(F.desc("score"), key)))


def ideal_dcg(relevant: Column, k: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(relevant, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))


def ranking_metrics(scored: DataFrame, query: list[str], key: str, ks: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """P@K, R@K, nDCG@K, MRR and AP at the largest K of rows with ``score`` and ``relevant`` (0/1), best first, ties by ``key``.

    Only the best rows are ordered: they are cut in every task before they meet.  Totals are plain sums, and the
    place of the first relevant row is the number of rows that beat the best relevant one.  Queries without a
    relevant row are dropped.
    """
    top = max(ks)
    order = F.struct("score", (-F.col(key)).alias("other"))
    best = F.max(F.when(F.col("relevant") == 1, order))
    totals = scored.groupBy(*query).agg(F.count(F.lit(1)).alias("corpus"), F.sum("relevant").alias("total"), best.alias("best")).filter("total > 0")
    first = scored.join(totals.select(*query, "best"), query).groupBy(*query).agg(F.sum((order >= F.col("best")).cast("long")).alias("first"))
    rows = ranked(scored, query, key).filter(F.col("rank") <= top)
    by = W.partitionBy(*query).orderBy("rank")
    rows = rows.withColumn("hits", F.sum("relevant").over(by.rowsBetween(W.unboundedPreceding, 0)))
    sums = [F.sum(F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0)).alias(f"h{k}") for k in ks]
    sums += [F.sum(F.when((F.col("rank") <= k) & (F.col("relevant") == 1), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"d{k}") for k in ks]
    sums += [F.sum(F.when((F.col("rank") <= top) & (F.col("relevant") == 1), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap")]
    agg = rows.groupBy(*query).agg(*sums).join(totals, query).join(first, query)
    out = [F.round(F.col(f"h{k}") / F.least(F.lit(k), F.col("corpus")), 6).alias(f"p_{k}") for k in ks]
    out += [F.round(F.col(f"h{k}") / F.greatest("total", F.lit(1)), 6).alias(f"r_{k}") for k in ks]
    out += [F.round(F.col(f"d{k}") / ideal_dcg(F.col("total"), k), 6).alias(f"ndcg_{k}") for k in ks]
    return agg.select(*query, "total", *out, F.round(1.0 / F.col("first"), 6).alias("mrr"), F.round(F.col("ap") / F.least("total", F.lit(top)), 6).alias("map"))


def macro_mean(metrics: DataFrame, value: str, inner: str, outer: str) -> DataFrame:
    """Mean within inner groups, over inner groups, over outer groups."""
    a = metrics.groupBy(outer, inner).agg(F.avg(value).alias("m")).groupBy(outer).agg(F.avg("m").alias("m"))
    return a.agg(F.round(F.avg("m"), 6).alias(value), F.count(F.lit(1)).alias("groups"))


def hierarchical_bootstrap(metrics: DataFrame, value: str, outer: str, inner: str, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """Mean with a 95 % interval from replicates that draw outer groups, inner groups in them and rows in those, each with replacement.

    ``metrics`` holds one row for each query, a bounded number, and is written once, for every step below reads it;
    draws are hashed, so reruns agree.
    """
    spark = metrics.sparkSession
    folder = scratch(spark, "metrics")
    metrics.select(outer, inner, key, value).write.parquet(folder)
    m = spark.read.parquet(folder)
    outers = m.select(outer).distinct().withColumn("o", F.row_number().over(W.orderBy(outer)) - 1)
    inners = m.select(outer, inner).distinct().withColumn("i", F.row_number().over(W.partitionBy(outer).orderBy(inner)) - 1)
    rows = m.withColumn("q", F.row_number().over(W.partitionBy(outer, inner).orderBy(key)) - 1)
    n_out = outers.agg(F.count(F.lit(1)).alias("n_out"))
    n_in = inners.groupBy(outer).agg(F.count(F.lit(1)).alias("n_in"))
    n_row = rows.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("n_row"))
    # dealt by replicate once; every later step keeps that
    draws = m.sparkSession.range(replicates).withColumnRenamed("id", "b").repartition("b").join(F.broadcast(n_out), F.lit(True))
    draws = draws.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_out").cast("int") - 1))).withColumn("o", F.pmod(draw(seed, F.col("b"), F.col("s")), F.col("n_out")))
    draws = draws.join(F.broadcast(outers), "o").join(F.broadcast(n_in), outer)
    draws = draws.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("n_in").cast("int") - 1))).withColumn("i", F.pmod(draw(seed, F.col("b"), F.col("s"), F.col("t")), F.col("n_in")))
    draws = draws.join(F.broadcast(inners), [outer, "i"]).join(F.broadcast(n_row), [outer, inner])
    draws = draws.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n_row").cast("int") - 1))).withColumn("q", F.pmod(draw(seed, F.col("b"), F.col("s"), F.col("t"), F.col("u")), F.col("n_row")))
    drawn = draws.join(F.broadcast(rows.select(outer, inner, "q", value)), [outer, inner, "q"])
    means = drawn.groupBy("b", "s", "t").agg(F.avg(value).alias("m")).groupBy("b", "s").agg(F.avg("m").alias("m")).groupBy("b").agg(F.avg("m").alias("m"))
    ends = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.round(F.avg("m"), 4).alias("mean"), F.round(ends[0], 4).alias("low"), F.round(ends[1], 4).alias("high"))
