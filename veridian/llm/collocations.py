r"""Phrase collocation mining (operator 12): Apriori level by level, then scored cuts.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into words ``[^\x20\x09]+``.
Everything is counted per language: n is the number of words, f(phrase) all contiguous occurrences inside
pieces, overlaps included.

1. Level 1 counts all words.  Level k counts the k-grams whose first and last k - 1 words are both frequent
   (f >= ``least``): no other k-gram can be frequent.  The frequent (k-1)-grams are broadcast as a bitmap of
   their hashes with a fixed largest size, so what is broadcast does not grow with the corpus; a gram that the
   bitmap lets pass by chance is counted and dropped with its count.
2. A level counts 64-bit hashes first, in rows of two numbers; only grams whose hash reaches ``least`` become
   strings, in the pass that counts the next level's hashes, and the strings are counted themselves, so a
   shared hash costs a row and changes no result.  Every block of texts is counted before rows leave it: a
   very common word or pair costs one row for each block.
3. A candidate has 2 to ``most`` words and f >= ``least``.  Cutting it after k words gives l = f(first part),
   r = f(rest) from the level tables, and the score floor(2000000 a / (l + r)); the lowest-scoring cut counts,
   ties to the smallest k.  Products are decimals of 38 digits.
4. A candidate inside a longer candidate (dropped or not) with 100 f(longer) >= 80 a is dropped.
5. The first ``top`` of each language by score and a (descending) and phrase (bytes) are ranked; every task
   keeps its own first ``top`` before any row is moved.

Defined cases: null text is empty, null language is ``und`` (as a language of that name); empty texts and texts
without words count nothing; repeated rows count again; a word may hold any other character, punctuation
that is not listed too; very long texts are hashed in windows; columns of other names are ignored; an empty
table, or one without frequent pairs, gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.llm._shared import materialize, read_table
from veridian.llm._textbytes import Words, mix64, row_blocks
from veridian.llm.ngram_join import _marks, id_filter

PIECE_ENDS = b".,;:!?" + bytes(range(0x0A, 0x0E))
BLANKS = b"\x20\x09"
LEAST, MOST, TOP = 30, 4, 2000

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[list(PIECE_ENDS + BLANKS)] = True
_ENDS_PIECE = np.zeros(256, dtype=bool)
_ENDS_PIECE[list(PIECE_ENDS)] = True
_STEP = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(8)], dtype=np.uint64)


class Grams:
    """The words of a block of rows (lang, text) and their runs inside pieces."""

    def __init__(self, block: pa.RecordBatch):
        lang = block.column(0).dictionary_encode()
        self.names = lang.dictionary.to_pylist()
        words = Words(block.column(1), _SEPARATOR)
        self.count = len(words)
        self.hash = words.hashes()
        row = np.repeat(np.arange(len(block)), words.counts)
        self.lang = lang.indices.to_numpy()[row] if self.count else np.zeros(0, np.int64)
        salts = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in self.names], dtype=np.uint64)
        self.salt = salts[self.lang] if self.count else np.zeros(0, np.uint64)
        # room[i]: how many words follow word i in its piece and row
        if self.count:
            ends = np.cumsum(_ENDS_PIECE[words.buf], dtype=np.int64)
            piece = ends[words.start]
            cut = np.flatnonzero((np.diff(row) != 0) | (np.diff(piece) != 0))
            last = np.append(cut, self.count - 1)
            self.room = last[np.searchsorted(last, np.arange(self.count))] - np.arange(self.count)
        else:
            self.room = np.zeros(0, np.int64)
        self.words = words

    def hashes(self, k: int) -> np.ndarray:
        """A hash of language and gram for every start of k words (those that leave the piece have one too)."""
        n = self.count - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = self.salt[:n].copy()
            for j in range(k):
                h += self.hash[j : j + n] * _STEP[j]
        return mix64(h)

    def strings(self, first: np.ndarray, k: int) -> pa.Array:
        """The grams of k words that start at the words ``first``, space-joined."""
        word = (first[:, None] + np.arange(k)).ravel()
        start, length = self.words.start[word], self.words.end[word] - self.words.start[word] + 1
        length[k - 1 :: k] -= 1  # a space follows each word but the last
        at = np.cumsum(length) - length
        total = int(length.sum())
        source = np.minimum(np.repeat(start - at, length) + np.arange(total), len(self.words.buf) - 1)
        data = self.words.buf[source]
        data[(at + length - 1).reshape(-1, k)[:, :-1].ravel()] = 0x20
        offsets = np.append(at[::k], total).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


#: A gram by its string, or by its hash alone.
COUNTS = "lang string, phrase string, h long, f long"
#: Grams in one Arrow batch.
GIVEN = 1 << 17
_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("h", pa.int64()), ("f", pa.int64())])


def _strings(grams: Grams, starts: np.ndarray, key: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """One row for each distinct gram of k words of a block that starts at ``starts``, with its occurrences."""
    _, first, n = np.unique(key[starts], return_index=True, return_counts=True)
    names = pa.array(grams.names, pa.string())
    for i in range(0, len(first), GIVEN):
        at = starts[first[i : i + GIVEN]]
        f = pa.array(n[i : i + GIVEN].astype(np.int64))
        yield pa.record_batch([names.take(pa.array(grams.lang[at])), grams.strings(at, k), pa.nulls(len(at), pa.int64()), f], schema=_SCHEMA)


def _hashes(grams: Grams, starts: np.ndarray, key: np.ndarray, named: bool = False) -> pa.RecordBatch:
    """One row for each distinct hash of a block, with its occurrences; ``named``: with the language."""
    h, first, n = np.unique(key[starts], return_index=True, return_counts=True)
    lang = pa.array(grams.names, pa.string()).take(pa.array(grams.lang[starts[first]])) if named else pa.nulls(len(h), pa.string())
    return pa.record_batch([lang, pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], schema=_SCHEMA)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    for batch in batches:
        for block in row_blocks(batch, "text"):
            grams = Grams(block)
            if grams.count:
                yield grams


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for grams in _blocks(batches):
        yield _hashes(grams, np.arange(grams.count), grams.hashes(1), named=True)


def _level(shared, k: int, longer: bool):
    """The grams of k words in the bitmap ``shared`` as strings and, if ``longer``, the hashes of those of k + 1 whose both parts are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for grams in _blocks(batches):
            if grams.count < k:
                continue
            key = grams.hashes(k)
            at = _marks(key.view(np.int64), len(bits))
            frequent = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & (grams.room[: len(key)] >= k - 1)
            yield from _strings(grams, np.flatnonzero(frequent), key, k)
            if longer:
                yield _hashes(grams, np.flatnonzero(frequent[:-1] & frequent[1:] & (grams.room[: len(key) - 1] >= k)), grams.hashes(k + 1))

    return run


def frequent_grams(docs: DataFrame, least: int = LEAST, most: int = MOST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for 1 to ``most`` words, the table (lang, phrase, f) of the grams with f >= ``least``.

    ``docs``: lang, text.  Levels end with the first empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = materialize(docs.mapInArrow(_words, COUNTS).groupBy("lang", "h").agg(F.sum("f").alias("f")), "words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    hashes, levels = words.filter(F.col("f") >= least).select("h"), []
    for k in range(1, most + 1):
        bits = id_filter(hashes)
        if bits is None:
            break
        counted = docs.mapInArrow(_level(spark.sparkContext.broadcast(bits), k, k < most), COUNTS).groupBy("lang", "phrase", "h").agg(F.sum("f").alias("f"))
        counted = materialize(counted.filter(F.col("f") >= least), "grams")
        levels.append(counted.filter("phrase is not null").select("lang", "phrase", "f"))
        hashes = counted.filter("h is not null").select("h")
    return sizes, levels


def _cuts(candidates: DataFrame, grams: DataFrame) -> DataFrame:
    """lang, phrase, f with the lowest-scoring cut's l, r and score."""
    parts = F.split("phrase", " ")
    cut = candidates.select("lang", "phrase", "f", parts.alias("w"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "f", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("left"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.size("w"))).alias("right"))
    cut = cut.join(grams.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(grams.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(f as decimal(19, 0)) * 2000000 div (cast(l as decimal(19, 0)) + r)")
    low = cut.groupBy("lang", "phrase", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    return low.select("lang", "phrase", "f", "c.l", "c.r", "c.score")


def _outermost(candidates: DataFrame, percent: int) -> DataFrame:
    """The candidates that no longer candidate holds with ``percent`` of their occurrences."""
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.concat_ws(" ", F.slice(w, i, k)))))
    longer = candidates.filter(F.size(w) > 2).select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = candidates.join(longer, ["lang", "phrase"], "left")
    return whole.filter("longer is null or cast(longer as decimal(19, 0)) * 100 < cast(f as decimal(19, 0)) * " + str(percent)).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, top: int = TOP, percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language of ``docs`` (lang, text)."""
    sizes, levels = frequent_grams(docs, least, most)
    if len(levels) < 2:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    candidates = reduce(DataFrame.union, levels[1:])
    scored = _cuts(_outermost(candidates, percent), reduce(DataFrame.union, levels))
    best = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("f").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    out = ranked.join(sizes, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language over all documents."""
    return collocations(read_table(spark, sf_dir, "documents"))


def op12_sql(least: int = LEAST, most: int = MOST, top: int = TOP) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sized AS (
  SELECT lang, w, unnest(range(1, {most + 1})) AS k FROM listed
), starts AS (
  SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized WHERE len(w) >= k
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= {least}
), cuts AS (
  SELECT lang, k, phrase, f, w, unnest(range(1, k)) AS c FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.f, c.c, l.f AS l, r.f AS r, 2000000::HUGEINT * c.f // (l.f + r.f) AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.c], ' ') JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.c + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), spans AS (
  SELECT lang, w, f, k, unnest(range(2, k)) AS size FROM candidates WHERE k > 2
), placed AS (
  SELECT lang, w, f, size, unnest(range(1, k - size + 2)) AS i FROM spans
), longer AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(f) AS longer FROM placed GROUP BY ALL
), ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.f DESC, s.phrase) AS rank, s.phrase, s.f AS a, s.l, s.r, s.score
  FROM lowest s LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.longer IS NULL OR 100 * o.longer < 80 * s.f
)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN sizes USING (lang) WHERE rank <= {top}
"""
