"""Mixing sources to target weights by systematic sampling (operator 3), in DataFrame functions only.

Targets are a water level: sources in the order of 3 * size / weight are full as long as that lies
below what is left over for each unit of weight; the others share the rest by weight.

Documents of one source and size expect the same number of copies: m / n for the n of them.  The m come
from systematic sampling over the source, sizes from large to small: with r = target / size of the source,
expected copies r are summed, one random offset u of the source is added, and m is the number of integers
that the stretch of a size crosses.  What the sum of words then misses (at most the largest size) is dealt
out again, the same way, to the sizes up to half of it, and so on in ``ROUNDS`` rounds that halve it,
until it is under a thousandth of the target.  Along the documents of one size the expected copies m / n are
summed the same way, and a document is emitted once for each integer that its stretch crosses:
floor(m k / n + u) - floor(m (k - 1) / n + u) for the k-th one by a hash.

The position k comes from two small prefix sums (within a cell of source, size and two hash digits; over
the 256 cells of a size), so no task ever gathers a whole source or size.

Defined cases: null text has size 0; a null source is a source of its own, last in the order;
sources without words have target 0; ties go by ``doc_id`` and then by the other columns, and equal rows are
interchangeable; very long texts count whole; an empty table gives no row; other columns, whatever
their names and types, are kept by :func:`mix_documents` and ignored by :func:`mixing_plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridian.llm._shared import materialize, read_table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
ROUNDS = 10
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target of ``sizes`` (source, size).  One row for each source."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = total.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    t = t.withColumn("bound", F.lit(most) * F.col("source_size"))
    by_level = W.orderBy(F.col("bound") / F.col("weight"), "rank")
    before, all_rows = by_level.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    t = t.withColumn("left_size", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
    t = t.withColumn("left_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("full", F.col("bound") * F.col("left_weight") <= F.col("left_size") * F.col("weight"))
    # the full ones come first in this order; what is left after them is shared
    t = t.withColumn("full", F.min("full").over(by_level.rowsBetween(W.unboundedPreceding, 0)))
    t = t.withColumn("open", F.max(F.when(~F.col("full"), F.struct("left_weight", "left_size"))).over(all_rows))
    share = F.col("open.left_size").cast("double") / F.col("open.left_weight").cast("double") * F.col("weight")
    return t.select("source", "source_size", F.when(F.col("full"), F.col("bound").cast("double")).otherwise(share).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(source, F.lit("\x00null")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def size_copies(sizes: DataFrame, targets: DataFrame, seed: int = 7, most: int = MOST_COPIES) -> DataFrame:
    """source, size, n, source_size, target, m: how often the ``n`` documents of a size are taken together.

    ``sizes`` (source, size, n) has one row for each size of a source, so a source's rows are bounded by its largest size.
    """
    targets = targets.select(F.col("source").alias("s"), "source_size", "target")
    t = sizes.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("u", offset(F.col("source"), seed))
    whole = W.partitionBy("source")
    so_far = whole.orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, 0)
    n, size, target = F.col("n"), F.col("size"), F.col("target")

    def crossed(rate: Column, end: Column) -> Column:
        return F.floor(rate * end.cast("double") + F.col("u")) - F.floor(rate * (end - n).cast("double") + F.col("u"))

    ratio = F.when(F.col("source_size") > 0, target / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    t = t.withColumn("end", F.sum(n).over(so_far)).withColumn("m", crossed(ratio, F.col("end")))
    for _ in range(ROUNDS):
        t = t.withColumn("missed", F.abs(target - F.sum(F.col("m") * size).over(whole)))
        t = t.withColumn("small", (size > 0) & (F.col("missed") * 1000 > target) & (size.cast("double") <= F.col("missed") / 2))
        t = t.withColumn("words", F.sum(F.when(F.col("small"), n * size)).over(whole))
        t = t.withColumn("rest", target - F.sum(F.when(F.col("small"), F.lit(0)).otherwise(F.col("m") * size)).over(whole))
        t = t.withColumn("end", F.sum(F.when(F.col("small"), n).otherwise(F.lit(0))).over(so_far))
        rate = F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col("rest") / F.col("words").cast("double")))
        t = t.withColumn("m", F.when(F.col("small"), crossed(rate, F.col("end"))).otherwise(F.col("m")))
    return t.select("source", "size", "n", "source_size", "target", "m", "u")


def _with_copies(rows: DataFrame, cells: DataFrame, classes: DataFrame, order: list) -> DataFrame:
    """``rows`` (source, size, salt, h, ...) with source_size, target and copies."""
    in_class = W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("own").over(in_class), F.lit(0)))
    classes = classes.withColumnRenamed("source", "s1").withColumnRenamed("size", "c1")
    cells = cells.join(classes, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("c1"))).drop("s1", "c1")
    cells = cells.withColumnRenamed("source", "s2").withColumnRenamed("size", "c2").withColumnRenamed("salt", "salt2")
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("h", *order)))
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("c2")) & (F.col("salt") == F.col("salt2")))
    k = F.col("before") + F.col("k")
    step = lambda k: F.floor(F.col("m").cast("double") * k.cast("double") / F.col("n").cast("double") + F.col("u"))
    return rows.withColumn("copies", (step(k) - step(k - 1)).cast("long"))


def _digest(seed: int, doc_id: Column, tie: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), tie.cast("string")))


def mixing_plan(rows: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``rows`` (doc_id, source, size, tie) with source_size, target and copies.

    ``tie`` tells rows of one doc_id apart.  ``rows`` is read three times, so pass a written table.
    """
    r = rows.withColumn("h", _digest(seed, F.col("doc_id"), F.col("tie"))).withColumn("salt", F.substring("h", 1, 2))
    cells = r.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("own"))
    sizes = cells.groupBy("source", "size").agg(F.sum("own").alias("n"))
    classes = size_copies(sizes, source_targets(rows, weights, most), seed, most)
    out = _with_copies(r, cells, classes, [F.col("doc_id").asc_nulls_first(), "tie"])
    return out.select("doc_id", "source", "size", "tie", "source_size", "target", "copies")


def hashable(field: T.StructField) -> Column:
    """A column as something that can be hashed: maps have no order of their own, so they and what holds them go as JSON."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() or "variant" in field.dataType.simpleString() else column


def mix_documents(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` (doc_id, text, source and any others), each row as often as the mix takes it; same columns.

    Texts move once, to the cell of their source, size and hash digits.
    """
    tie = F.xxhash64(*map(hashable, docs.schema.fields))
    # a whole row goes as one value, so no column can clash with those made here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), tie.alias("tie"))
    rows = rows.withColumn("h", _digest(seed, F.col("doc_id"), F.col("tie"))).withColumn("salt", F.substring("h", 1, 2))
    cells = materialize(rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("own")), "mix-cells")
    sizes = cells.groupBy("source", "size").agg(F.sum("own").alias("n"))
    targets = source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    taken = _with_copies(rows, cells, size_copies(sizes, targets, seed, most), [F.col("doc_id").asc_nulls_first(), "tie"])
    taken = taken.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = read_table(spark, sf_dir, "documents")
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.lit(0).alias("tie")), "mix-sizes")
    plan = mixing_plan(rows)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_sql(seed: int = 7) -> str:
    """The same rows in DuckDB SQL."""
    rounds = "".join(
        f"""
a{i} AS (SELECT *, size > 0 AND missed * 1000 > target AND size::DOUBLE <= missed / 2 AS small FROM (SELECT source, size, n, source_size, target, u, m, abs(target - sum(m * size) OVER (PARTITION BY source)) AS missed FROM e{i - 1})),
b{i} AS (SELECT *, sum(n * size) FILTER (WHERE small) OVER (PARTITION BY source) AS words, target - coalesce(sum(m * size) FILTER (WHERE NOT small) OVER (PARTITION BY source), 0) AS rest,
         sum(CASE WHEN small THEN n ELSE 0 END) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS e FROM a{i}),
c{i} AS (SELECT *, least({MOST_COPIES}::DOUBLE, greatest(0::DOUBLE, rest / words::DOUBLE)) AS r FROM b{i}),
e{i} AS (SELECT source, size, n, source_size, target, u, CASE WHEN small THEN floor(r * e::DOUBLE + u) - floor(r * (e - n)::DOUBLE + u) ELSE m END AS m FROM c{i}),"""
        for i in range(1, ROUNDS + 1)
    )
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT] AS weight, {MOST_COPIES} * source_size AS bound FROM s),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(bound) OVER b, 0) AS left_size, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS left_weight
      FROM w WINDOW b AS (ORDER BY bound / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(CASE WHEN bound * left_weight <= left_size * weight THEN 1 ELSE 0 END) OVER (ORDER BY bound / weight, rank ROWS UNBOUNDED PRECEDING) AS is_full FROM l),
o AS (SELECT arg_max(left_size, left_weight) AS size, max(left_weight) AS weight FROM f WHERE is_full = 0),
t AS (SELECT source, source_size, CASE WHEN is_full = 1 THEN bound::DOUBLE ELSE o.size::DOUBLE / o.weight::DOUBLE * f.weight END AS target FROM f LEFT JOIN o ON true),
h AS (SELECT d.*, md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':0') AS h FROM d),
z AS (SELECT h.source, size, count(*) AS n, any_value(t.source_size) AS source_size, any_value(t.target) AS target,
      ('0x' || substr(md5('{seed}/' || coalesce(h.source, '\x00null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source GROUP BY h.source, size),
e0 AS (SELECT *, floor(r * e::DOUBLE + u) - floor(r * (e - n)::DOUBLE + u) AS m FROM (
      SELECT *, sum(n) OVER (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS e, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS r FROM z)),
{rounds}
k AS (SELECT h.doc_id, h.size, e.n, e.m, e.u, e.source_size, e.target, row_number() OVER (PARTITION BY h.source, h.size ORDER BY h, doc_id) AS k
      FROM h JOIN e{ROUNDS} e ON h.source IS NOT DISTINCT FROM e.source AND h.size = e.size)
SELECT doc_id, size, source_size, target, ((floor(m * k::DOUBLE / n::DOUBLE + u) - floor(m * (k - 1)::DOUBLE / n::DOUBLE + u))::BIGINT * size)::BIGINT AS taken FROM k
"""
