"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next one's ``docs``.  All but the last keep the columns of
``documents``.

1. language: documents whose language cannot be told go (no letters, or no language of the
   mixture holds ``LEAST_LANGUAGE`` of the words).
2. toxicity: documents that score at or above the threshold go.
3. near duplicates: one row of each group of linked rows stays, the one with the smallest ``doc_id``
   (null counts as the largest; of rows that repeat it, the first by text, then by the other
   columns).  Groups are found by text alone: rows that share a ``doc_id``, or have none, are not
   linked by that.  Rows without words are linked with nothing and all stay.
4. mixture: sources are repeated or thinned to their target weights.
5. packing: everything left is packed into sequences of at most 4096 ids.

Batches between Spark and Python are small in all stages (see ``small_batches``), so rows may be long.

Null texts count as empty; very long texts are read whole; an empty table passes through every stage; columns
beyond those of ``documents`` are kept up to packing, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.llm._shared import materialize, read_table, small_batches
from veridian.llm.language_id import UNDETERMINED, held_out, identify
from veridian.llm.mixing import hashable, mix_documents
from veridian.llm.ngram_join import ngram_components
from veridian.llm.packing import pack_documents
from veridian.llm.toxicity import THRESHOLD, score_toxicity, train

LEAST_LANGUAGE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language."""
    small_batches(spark)
    plain = _plain(docs)
    training = plain.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"), 4))
    told = identify(plain, training)
    return told.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE)).select(*plain.columns).toDF(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents below the toxicity threshold."""
    small_batches(spark)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id"), 4))
    plain = _plain(docs)
    scored = score_toxicity(plain, train(plain.select("doc_id", "text"), labels), spans=False)
    return scored.filter(F.col("toxic_score") < THRESHOLD).select(*plain.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group.  Rows are known by a hash of ``doc_id`` and text, so equal ones have one key."""
    small_batches(spark)
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    groups = ngram_components(docs.select(key.alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("_row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("_group"))
    groups = groups.groupBy("_row").agg(F.first("_group").alias("_group"), F.count(F.lit(1)).alias("_rows"))
    rows = materialize(docs.select(key.alias("_row"), F.col("doc_id").cast("long").alias("_doc")).distinct().join(groups, "_row"), "rows")
    by_doc = rows.filter("_group is not null").groupBy("_group", "_doc").agg(F.min("_row").alias("_row"), F.sum("_rows").alias("_rows"))
    first = F.min(F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_row", "_rows"))
    least = materialize(by_doc.groupBy("_group").agg(first.alias("_first")).select("_group", "_first.*"), "least")
    # groups whose smallest doc_id has one row need no order among texts
    single = least.filter("_rows = 1").select("_row").union(rows.filter("_group is null").select("_row"))
    several = least.filter("_rows > 1").select(F.col("_group").alias("_g"), F.col("_doc").alias("_d"))
    several = rows.join(several, (F.col("_group") == F.col("_g")) & F.col("_doc").eqNullSafe(F.col("_d"))).select("_row", "_group")
    plain = _plain(docs)
    keyed = plain.withColumn("_row", key)
    tied = keyed.join(several, "_row")
    order = [F.col("text"), *[hashable(f) for f in plain.schema.fields if f.name != "text"]]
    tied = tied.withColumn("_first", F.row_number().over(W.partitionBy("_group").orderBy(*order))).filter("_first = 1")
    return keyed.join(single, "_row", "left_semi").select(*plain.columns).union(tied.select(*plain.columns)).toDF(*docs.columns)


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or thins sources to their targets."""
    small_batches(spark)
    return mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    small_batches(spark)
    return pack_documents(docs)


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns that stages read under their own names and all others numbered, so none can clash with what is added."""
    known = ("doc_id", "text", "lang", "source")
    return docs.toDF(*[c if c in known else f"other{i}" for i, c in enumerate(docs.columns)])


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: Trained stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
