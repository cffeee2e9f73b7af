"""Language identification by multilingual mixture inference (operator 4).

Training: character n-grams (1 to 4 bytes-of-a-word windows, hashed into a fixed table) of a
bounded sample of labelled rows give smoothed n-gram likelihoods for each language.  Words are the
units that have one language: the log-likelihood of a word is the sum over its n-grams.

Inference, for each document: expectation-maximisation of the language proportions over its words;
the set of languages is selected by penalised likelihood: starting from the mixture of all, the
weakest language is dropped as long as the Bayesian information criterion improves.  The prediction
is the language with the largest remaining proportion, ``score`` is that proportion.

Only text enters a prediction.  Texts that are null or hold no letter are ``und`` with score 0.

Defined cases: very long texts are read whole; ties go to the first language by name; rows without
a language or with an empty text are not learned from, equal rows are learned from once; repeated rows are
predicted alike; an empty training set predicts ``und`` for every row; an empty table gives no row; other
columns are ignored, or kept by :func:`identify`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridian.llm._shared import read_table
from veridian.llm._textbytes import NOT_LETTER, Words, mix64, row_blocks, segment_sums

N_GRAMS = (1, 2, 3, 4)
TABLE_BITS = 18
UNDETERMINED = "und"
#: Text of a block; its n-grams take some hundred times as much while it is read.
BLOCK_BYTES = 128 << 10
#: Slots of a table that go together.
PART_SLOTS = 1 << 12
SLOT_COUNTS = "lang string, part int, slots binary, counts binary"


def held_out(doc_id, modulus: int, rest: int = 2):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


class Grams:
    """The distinct words of a block, their n-gram slots, and which word stands where."""

    def __init__(self, column: pa.Array):
        w = Words(column, NOT_LETTER)
        self.row = w.row
        offsets = np.append(0, np.cumsum(w.end - w.start)).astype(np.int32)
        inside = ~NOT_LETTER[w.buf]
        text = pa.BinaryArray.from_buffers(pa.binary(), len(w), [None, pa.py_buffer(offsets), pa.py_buffer(w.buf[inside])])
        coded = text.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        unique = coded.dictionary
        self.n_unique = len(unique)
        size = pc.binary_length(unique).to_numpy(zero_copy_only=False).astype(np.int64) if len(unique) else np.zeros(0, np.int64)
        # each distinct word between two marks, so n-grams know where words begin and end
        body = np.full(int(size.sum()) + 2 * len(size), ord("^"), dtype=np.uint64)
        begin = np.append(0, np.cumsum(size + 2))
        fill = np.ones(len(body), dtype=bool)
        fill[begin[:-1]] = False
        fill[begin[1:] - 1] = False
        data = b"".join(unique.to_pylist())
        body[fill] = np.frombuffer(data, dtype=np.uint8)
        body[begin[1:] - 1] = ord("$")
        word = np.repeat(np.arange(len(size)), size + 2)
        slots, owner = [], []
        for n in N_GRAMS:
            k = len(body) - n + 1
            if k <= 0:
                continue
            h = np.zeros(k, dtype=np.uint64)
            for j in range(n):
                h = (h << np.uint64(8)) | body[j : j + k]
            ok = word[:k] == word[n - 1 :]
            h = mix64(h[ok] * np.uint64(2) + np.uint64(1 + (n << 33)))
            slots.append((h >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
            owner.append(word[:k][ok])
        self.slots = np.concatenate(slots) if slots else np.zeros(0, np.int32)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        self.slots, owner = self.slots[order], owner[order]
        self.bounds = np.searchsorted(owner, np.arange(self.n_unique + 1))


def _counted(lang: str, part: int, counts: np.ndarray) -> pa.RecordBatch:
    """A row for the slots of a part that hold anything."""
    slots = np.flatnonzero(counts)
    held = [pa.array([x.tobytes()], pa.binary()) for x in (slots.astype(np.uint16), counts[slots].astype(np.float64))]
    return pa.record_batch([pa.array([lang]), pa.array([part], pa.int32()), *held], names=["lang", "part", "slots", "counts"])


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each slot occurs in the rows (lang, text) of each language."""
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        for block in row_blocks(batch, "text", BLOCK_BYTES):
            g = Grams(block.column(1))
            lang = np.array(block.column(0).to_pylist(), dtype=object)
            word_row = np.repeat(np.arange(block.num_rows), np.diff(g.row))
            for name in sorted(set(lang)):
                times = np.bincount(g.codes[(lang == name)[word_row]], minlength=g.n_unique)
                add = np.bincount(g.slots, weights=np.repeat(times, np.diff(g.bounds)), minlength=1 << TABLE_BITS)
                tables[name] = tables.get(name, 0) + add
    for name, table in tables.items():
        for part, counts in enumerate(table.reshape(-1, PART_SLOTS)):
            if counts.any():
                yield _counted(name, part, counts)


def _add_slots(table: pa.Table) -> pa.Table:
    total = np.zeros(PART_SLOTS)
    for slots, counts in zip(table["slots"], table["counts"]):
        total[np.frombuffer(slots.as_buffer(), dtype=np.uint16)] += np.frombuffer(counts.as_buffer(), dtype=np.float64)
    return pa.Table.from_batches([_counted(table["lang"][0].as_py(), table["part"][0].as_py(), total)])


def train(rows: DataFrame, per_language: int = 3000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihood tables (slot x language) from ``rows`` (doc_id, text, lang).

    About ``per_language`` rows of each language at most are learned from, those whose hash lies in that share of all hashes;
    equal rows once.
    """
    chosen = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40)).alias("_h"))
    chosen = chosen.filter("lang is not null and length(text) > 0")
    # a row is in or out by its own hash, so nothing is ordered; one row for each language
    limits = chosen.groupBy("lang").agg((F.least(F.lit(1.0), per_language / F.count(F.lit(1))) * (1 << 40)).alias("_limit"))
    sample = chosen.join(F.broadcast(limits), "lang").filter("_h <= _limit").dropDuplicates(["lang", "_h", "text"]).select("lang", "text")
    # a table of fixed size for each language
    parts = sample.mapInArrow(_slot_counts, SLOT_COUNTS).groupBy("lang", "part").applyInArrow(_add_slots, SLOT_COUNTS).collect()
    langs = sorted({p.lang for p in parts})
    counts = np.zeros((1 << TABLE_BITS, len(langs)))
    for p in parts:
        counts[p.part * PART_SLOTS + np.frombuffer(p.slots, dtype=np.uint16).astype(np.int64), langs.index(p.lang)] = np.frombuffer(p.counts, dtype=np.float64)
    seen = max(1, int((counts.sum(axis=1) > 0).sum())) if len(langs) else 1
    table = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * seen)) if len(langs) else counts
    return langs, table.astype(np.float32)


def _mixture(lik: np.ndarray, bounds: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Language proportions of each segment of word likelihoods (word x language), pruned by BIC."""
    docs, langs = len(bounds) - 1, lik.shape[1]
    n = np.diff(bounds)
    pi = np.full((docs, langs), 1.0 / langs, dtype=np.float32)
    doc = np.repeat(np.arange(docs), n)
    active = np.ones((docs, langs), dtype=bool)

    def fit(pi: np.ndarray, which: np.ndarray) -> np.ndarray:
        """EM for the chosen documents; a document that has settled is left alone."""
        todo = which & (n > 0)
        for _ in range(rounds):
            if not todo.any():
                break
            at = todo[doc]
            r = lik[at] * pi[doc[at]]
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
            b = np.append(0, np.cumsum(n[todo]))
            new = segment_sums(r, b) / n[todo][:, None]
            moved = np.abs(new - pi[todo]).max(axis=1) > tolerance
            pi[todo] = new
            todo[np.flatnonzero(todo)[~moved]] = False
        return pi

    def log_lik(pi: np.ndarray) -> np.ndarray:
        p = np.log(np.maximum((lik * pi[doc]).sum(axis=1), 1e-30), dtype=np.float64)
        return segment_sums(p, bounds)

    pi = fit(pi, np.ones(docs, dtype=bool))
    best = log_lik(pi)
    penalty = 0.5 * np.log(np.maximum(n, 2))
    trying = (active.sum(axis=1) > 1) & (n > 0)
    while trying.any():
        weakest = np.where(active & (pi >= 0), np.where(active, pi, np.inf), np.inf).argmin(axis=1)
        other = pi.copy()
        rows = np.flatnonzero(trying)
        other[rows, weakest[rows]] = 0
        lost = other.sum(axis=1)
        trying &= lost > 0
        other[trying] /= lost[trying][:, None]
        other = fit(other, trying.copy())
        ll = log_lik(other)
        better = trying & (ll + penalty >= best)
        active[np.flatnonzero(better), weakest[better]] = False
        pi[better], best[better] = other[better], ll[better]
        trying = better & (active.sum(axis=1) > 1)
    return pi


class Identifier:
    """Predicts languages of string columns with trained tables."""

    def __init__(self, langs: list[str], table: np.ndarray, rounds: int = 12, tolerance: float = 0.01):
        self.langs, self.table, self.rounds, self.tolerance = np.array(langs, dtype=object), table, rounds, tolerance

    def mixture(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Proportions (row x language) and the number of words of each row."""
        g = Grams(column)
        if not len(self.langs) or not g.n_unique:
            return np.zeros((len(g.row) - 1, len(self.langs)), np.float32), np.diff(g.row)
        word = segment_sums(self.table[g.slots], g.bounds)
        word = np.exp(np.maximum(word - word.max(axis=1, keepdims=True), -60.0))
        return _mixture(word[g.codes], g.row, self.rounds, self.tolerance), np.diff(g.row)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        has_letter = pc.match_substring_regex(column.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
        pi, n = self.mixture(column)
        known = has_letter & (n > 0) & bool(len(self.langs))
        top = pi.argmax(axis=1) if len(self.langs) else np.zeros(len(n), np.int64)
        score = np.where(known, pi[np.arange(len(n)), top] if len(self.langs) else 0.0, 0.0)
        langs = [self.langs[t] if k else UNDETERMINED for t, k in zip(top, known)]
        return langs, np.clip(score.astype(np.float64), 0.0, 1.0)


def identify(docs: DataFrame, training: DataFrame, per_language: int = 3000) -> DataFrame:
    """All columns of ``docs`` (text, ...) with lang_pred and lang_score.

    The predictions sit beside the row, so nothing is shuffled.  Columns of these names that
    ``docs`` has already are replaced.
    """
    docs = docs.drop("lang_pred", "lang_score")
    langs, table = train(training, per_language)
    model = docs.sparkSession.sparkContext.broadcast((langs, table))
    names = docs.columns

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(*model.value)
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                lang, score = own.predict(block.column(names.index("text")))
                yield pa.record_batch([*block.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "lang_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    training = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"), 4))
    out = identify(docs.select("doc_id", "text"), training)
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
