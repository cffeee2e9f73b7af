"""Document fingerprints by SpotSigs (operator 5).

A signature starts at an anchor, a common word of a language, and chains the next ``CHAIN`` content
words (words that are no anchors) after it.  The fingerprint of a text is the set of its
signatures, 32-bit hashes in ascending order, written as hexadecimal digits, eight for each.  Texts
are likened by the Jaccard similarity of their sets: the query likens each document with its edited text
and with the next document, :func:`alike_fingerprints` finds all pairs of a table that are alike.
There sets meet only if their lengths allow the asked similarity (length partitions) and they share
one of their rarest signatures; the others are pruned before an intersection is taken.

Defined cases: null counts as empty; a text without a signature takes chains that start at every
word; one with fewer than CHAIN words takes all its words as one signature; without words
the set is empty, and two empty sets are alike (1.0); repeated ``doc_id`` rows follow each other by
text, equal rows are interchangeable; the only document is followed by itself; very long texts are read whole; columns of other
names are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.llm._shared import materialize, read_table, shuffle_partitions
from veridian.llm._textbytes import NOT_LETTER, Words, mix64, row_blocks

CHAIN = 2
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were with you "
    "auf das dem den der des die ein eine für ist mit nicht sich sie und von zu "
    "au dans de des du elle en est et il la le les pas pour que qui sur un une "
    "con del el en es las lo los no para por que se su y"
).split()


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(Words(pa.array([" ".join(words)]), NOT_LETTER).hashes())


class SpotSets:
    """The signature sets of the rows of a string column: sorted keys (row << 32 | signature)."""

    def __init__(self, column: pa.Array, anchors: np.ndarray, chain: int = CHAIN):
        words = Words(column, NOT_LETTER)
        h, row = words.hashes(), words.row
        rows = len(row) - 1
        owner = np.repeat(np.arange(rows), np.diff(row))
        at = np.minimum(np.searchsorted(anchors, h), max(0, len(anchors) - 1))
        is_anchor = anchors[at] == h if len(anchors) else np.zeros(len(h), dtype=bool)
        content = np.flatnonzero(~is_anchor)
        keys = [self._chains(h, owner, np.flatnonzero(is_anchor), content, chain, False)]
        bare = np.ones(rows, dtype=bool)
        bare[(keys[0] >> np.uint64(32)).astype(np.int64)] = False
        if bare.any():
            every = np.flatnonzero(bare[owner])
            keys.append(self._chains(h, owner, every, every, chain, True))
            bare[(keys[1] >> np.uint64(32)).astype(np.int64)] = False
            for r in np.flatnonzero(bare & (np.diff(row) > 0)):
                keys.append(self._pack(np.array([r]), mix64(h[row[r] : row[r + 1]].sum(keepdims=True))))
        self.keys = np.unique(np.concatenate(keys))
        self.bounds = np.searchsorted(self.keys, np.arange(rows + 1, dtype=np.uint64) << np.uint64(32))

    @staticmethod
    def _pack(row: np.ndarray, signature: np.ndarray) -> np.ndarray:
        return (row.astype(np.uint64) << np.uint64(32)) | (signature >> np.uint64(32))

    def _chains(self, h: np.ndarray, owner: np.ndarray, start: np.ndarray, content: np.ndarray, chain: int, own: bool) -> np.ndarray:
        """Signatures of the anchors at ``start`` with the next ``chain`` entries of ``content`` in the same row."""
        k = np.searchsorted(content, start, side="left" if own else "right")
        ok = k + chain <= len(content)
        start, k = start[ok], k[ok]
        if not len(start):
            return np.zeros(0, np.uint64)
        ok = owner[content[k + chain - 1]] == owner[start]
        start, k = start[ok], k[ok]
        with np.errstate(over="ignore"):
            s = np.zeros(len(start), np.uint64) if own else h[start] * np.uint64(3)
            for j in range(chain):
                s = mix64(s + h[content[k + j]])
        return self._pack(owner[start], s)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def texts(self) -> list[str]:
        digits = (self.keys & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes().hex()
        return [digits[8 * a : 8 * b] for a, b in zip(self.bounds[:-1], self.bounds[1:])]


def likeness(a: SpotSets, b: SpotSets, shift: int = 0, least: float = 0.0) -> np.ndarray:
    """Jaccard similarity of row i of ``a`` with row i + ``shift`` of ``b``; 0 where it cannot reach ``least``."""
    n = len(a.bounds) - 1 if not shift else len(b.bounds) - 1 - shift
    other = b.keys if not shift else b.keys[b.bounds[shift] :] - (np.uint64(shift) << np.uint64(32))
    mine, theirs = a.sizes[:n], b.sizes[shift : shift + n]
    both = np.intersect1d(a.keys[: a.bounds[n]], other[: b.bounds[shift + n] - b.bounds[shift]], assume_unique=True)
    common = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=n)[:n]
    union = mine + theirs - common
    out = np.where(union > 0, common / np.maximum(union, 1), 1.0)
    longest = np.maximum(mine, theirs)
    return np.where((longest > 0) & (np.minimum(mine, theirs) < least * longest), 0.0, out)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_successors(docs: DataFrame, shards_each: int = 4) -> DataFrame:
    """``docs`` (doc_id, text) dealt by ranges of ``doc_id``, each range in order and followed by the first row of the next one (``extra``).

    The ranges come from quantiles of the ids alone, so the texts move once.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").filter("doc_id is not null")
    n = shuffle_partitions(spark)
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / (n * shards_each) for i in range(1, n * shards_each)], 0.1 / (n * shards_each))))
    marks = spark.sparkContext.broadcast(np.array([int(c) for c in cuts], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        """By binary search; only ids go to Python."""
        return pd.Series(np.searchsorted(marks.value, doc_id.to_numpy(np.int64), side="right").astype(np.int32))

    dealt = docs.withColumn("shard", F.when(F.col("doc_id").isNull(), 0).otherwise(range_of(F.coalesce("doc_id", F.lit(0)))))
    # one row for each range: the ranges are as many as the shuffle's partitions, times shards_each
    first = dealt.groupBy("shard").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first")).select("shard", F.col("first.doc_id").alias("doc_id"))
    order = [r.shard for r in first.select("shard").orderBy("shard").collect()]
    before = spark.createDataFrame([(b, a) for a, b in zip(order, order[1:] + order[:1])], "shard int, goes_to int")
    heads = dealt.join(F.broadcast(first.withColumnRenamed("shard", "s").withColumnRenamed("doc_id", "d")), (F.col("shard") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")))
    heads = heads.groupBy("shard").agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("head"), F.first("doc_id").alias("doc_id"))
    heads = heads.join(F.broadcast(before), "shard").select("doc_id", F.col("head.text").alias("text"), F.col("goes_to").alias("shard"))
    rows = dealt.select("doc_id", "text", "shard", F.lit(False).alias("extra")).union(heads.select("doc_id", "text", "shard", F.lit(True)))
    return rows.repartition(n, "shard").sortWithinPartitions("shard", "extra", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, anchors: list[str] = ANCHORS) -> DataFrame:
    """Fingerprints of all ``docs`` (doc_id, text) and of their edited texts, with likenesses."""
    known = _hashes(list(anchors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table) -> pa.RecordBatch:
            """All rows but the last, which only follows."""
            doc_id, text, extra = table["doc_id"].combine_chunks(), table["text"].combine_chunks().fill_null(""), table["extra"].to_numpy(zero_copy_only=False)
            texts = text.to_pylist()
            edited = []
            for own, following in zip(texts, texts[1:]):
                half = len(own) // 2
                edited.append(own[: len(own) - half] + following[:half])
            mine, other = SpotSets(text, known), SpotSets(pa.array(edited, pa.large_string()), known)
            n = len(edited)
            sha = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
            out = pa.record_batch(
                [doc_id[:n], pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(sha), pa.array(mine.texts()[:n]), pa.array(other.texts()), pa.array(likeness(mine_first(mine, n), other)), pa.array(likeness(mine, mine, 1))],
                names=[f.split()[0] for f in RESULT.split(", ")],
            )
            return out.filter(pa.array(~extra[:n]))

        for batch in batches:
            for block in row_blocks(batch, "text", 1 << 20):
                part = pa.Table.from_batches([block])
                table = part if held is None else pa.concat_tables([held, part])
                if len(table) > 1:
                    yield done(table)
                held = table.slice(len(table) - 1)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_successors(docs).select("doc_id", "text", "extra").mapInArrow(run, RESULT)


def mine_first(sets: SpotSets, n: int) -> SpotSets:
    """The first ``n`` rows."""
    out = object.__new__(SpotSets)
    out.keys, out.bounds = sets.keys[: sets.bounds[n]], sets.bounds[: n + 1]
    return out


def alike_fingerprints(prints: DataFrame, least: float) -> DataFrame:
    """a, b, likeness of all pairs a < b of different fingerprints in ``prints`` (fingerprint) whose Jaccard similarity is at least ``least``.

    Of two sets that are so alike, the smaller one has ``least`` times the larger one's length or
    more, and they share one of the first n - ceil(least * n) + 1 signatures in any common order;
    rare ones come first here.  Lengths lie in partitions that grow by 1 / ``least``; a set asks its
    own partition and those that lengths from least * n on lie in.  Null and empty fingerprints are
    left out: equal fingerprints are joined by their text.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    step = max(-math.log(least), 1e-3)
    lower = lambda n: F.ceil(n * least - 1e-9)
    part = lambda n: F.floor(F.log(n.cast("double")) / step)
    n = F.col("n")
    sets = prints.filter("fingerprint <> ''").select("fingerprint").distinct()
    sets = materialize(sets.select("fingerprint", F.regexp_extract_all("fingerprint", F.lit("[0-9a-f]{8}"), 0).alias("signatures")).withColumn("n", F.size("signatures")), "sets")
    held = sets.select("fingerprint", "n", F.explode("signatures").alias("signature"))
    counts = held.groupBy("signature").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    # a signature of one set is no key, but takes its place among the rarest
    rank = F.row_number().over(W.partitionBy("fingerprint").orderBy(F.coalesce("sets", F.lit(1)), "signature"))
    keys = held.join(counts, "signature", "left").withColumn("rank", rank).filter((F.col("rank") <= n - lower(n) + 1) & F.col("sets").isNotNull())
    small = keys.select("signature", part(n).alias("part"), F.col("fingerprint").alias("a"), n.alias("na"))
    large = keys.select("signature", F.explode(F.sequence(part(lower(n)), part(n))).alias("part"), F.col("fingerprint").alias("b"), n.alias("nb"))
    meet = ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= lower(F.col("nb")))
    pairs = small.join(large, ["signature", "part"]).filter(meet).select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("fingerprint").alias("a"), F.col("signatures").alias("sa")), "a").join(sets.select(F.col("fingerprint").alias("b"), F.col("signatures").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = pairs.withColumn("likeness", both / (F.size("sa") + F.size("sb") - both)).filter(F.col("likeness") >= least)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
