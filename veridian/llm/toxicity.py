"""Toxicity by maximum-scoring segments (operator 10).

Training uses a bounded sample of labelled rows: about ``per_class`` rows of each label at most, those
whose hash lies in that share of all hashes.  Two thirds give log-odds with an informative Dirichlet prior (the prior
of a token is its share of both classes, so rare tokens are drawn to zero); the last third gives
the calibration.  A token is known by its word and by the word's first 4, 5 and 6 bytes, so
inflected forms share what is learned of their stem; the strongest of these speaks for it.

Scoring: every text becomes a sequence of token scores (log-odds less a drift, so that clean text
sums to less than zero).  One linear scan finds all maximal scoring segments; only tokens with a
positive score are visited in Python, the stretches between them are differences of one running
sum.  The score S of a segment in a text of n tokens has extreme-value significance
E = K n exp(-lambda S): lambda solves sum p(s) exp(lambda s) = 1 over the scores of clean
tokens, K fits the tail of clean texts.  A text's score is a logistic function, fitted on the
calibration half, of -ln E summed over its segments.

Defined cases: null and empty texts have no segment, and all texts without one get the same score; repeated
tokens count each time; a row that repeats a ``doc_id`` is labelled like it, and equal rows are learned from once; of
several labels of one id the largest counts; very long texts are
read whole; with no labelled row of a class every score is the smoothed rate of the other rows; an empty table gives
no row; other columns are kept or ignored as the function says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridian.llm._shared import materialize, read_table
from veridian.llm._textbytes import NOT_LETTER, Words, row_blocks
from veridian.llm.language_id import held_out

#: Text of a block; its tokens take some hundred times as much while it is read.
BLOCK_BYTES = 256 << 10
THRESHOLD = 0.3
STEMS = (None, 6, 5, 4)


def units(words: Words) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings."""
    return [words.hashes(k) ^ np.uint64(k or 0) for k in STEMS]

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in one pass."""
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    total = np.append(0.0, np.cumsum(score, dtype=np.float64))
    return _scan(at, total[at], total[at + 1])


def _scan(at: np.ndarray, before: np.ndarray, after: np.ndarray) -> list[tuple[int, int, float]]:
    """The candidate list: each entry is [start, end, sum before it, sum at its end, entry to look at next]."""
    held: list[list] = []
    for i, left, right in zip(at.tolist(), before.tolist(), after.tolist()):
        start, end, j = i, i + 1, len(held) - 1
        while True:
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append([start, end, left, right, j])
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
            j = len(held) - 1 if not held else j - 1
    return [(s, e, r - l) for s, e, l, r, _ in held]


class Scorer:
    """Token scores and significance; a bounded table, small enough for every task."""

    def __init__(self, tokens: np.ndarray, scores: np.ndarray, unknown: float, lam: float = 1.0, k: float = 0.1, a: float = 1.0, b: float = 0.0, base: float | None = None):
        order = np.argsort(tokens)
        self.tokens, self.scores = tokens[order], scores[order].astype(np.float32)
        self.unknown, self.lam, self.k, self.a, self.b, self.base = np.float32(unknown), lam, k, a, b, base

    def token_scores(self, words: Words) -> np.ndarray:
        best = np.full(len(words), self.unknown, np.float32)
        for h in units(words) if len(self.tokens) else ():
            at = np.searchsorted(self.tokens, h)
            at[at == len(self.tokens)] = 0
            s = np.where(self.tokens[at] == h, self.scores[at], self.unknown)
            best = np.where(np.abs(s - self.unknown) > np.abs(best - self.unknown), s, best)
        return best

    def evidence(self, column: pa.Array, spans: bool = False) -> tuple[np.ndarray, list]:
        """For each row, -ln of the significance of its segments taken together; and the segments, as word ranges."""
        words = Words(column, NOT_LETTER)
        s = self.token_scores(words)
        n = np.maximum(1, words.counts)
        sums = np.append(0.0, np.cumsum(s, dtype=np.float64))
        hits = np.flatnonzero(s > 0)
        bounds = np.searchsorted(hits, words.row)
        value = np.zeros(len(n))  # without a segment there is no evidence, however short the text
        found: list = [None] * (len(words.row) - 1)
        for r in np.flatnonzero(np.diff(bounds)):
            at = hits[bounds[r] : bounds[r + 1]]
            segments = _scan(at, sums[at], sums[at + 1])
            # independent segments: their excess over what a text of this length shows by chance adds up
            gain = self.lam * np.array([x[2] for x in segments]) - np.log(self.k * n[r])
            value[r] = max(gain.max(), gain[gain > 0].sum())
            if spans:
                found[r] = [self._span(words, r, x, float(g)) for x, g in zip(segments, gain) if g > -np.log(0.01)]
        return value, found

    @staticmethod
    def _span(words: Words, r: int, segment: tuple[int, int, float], gain: float) -> dict:
        """A segment as code-point offsets of its row."""
        first = words.offsets[r]
        chars = lambda lo, hi: int(((words.raw[lo:hi] & 0xC0) != 0x80).sum())
        start = chars(first, words.start[segment[0]])
        return {"start": start, "end": start + chars(words.start[segment[0]], words.end[segment[1] - 1]), "score": segment[2], "e_value": float(np.exp(-gain))}

    def probability(self, value: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(value), self.base)
        return 1.0 / (1.0 + np.exp(-np.clip(self.a * np.clip(value, -30.0, 60.0) + self.b, -50, 50)))


def _karlin_lambda(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share * exp(lambda * value) = 1, for a negative mean; bisection."""
    if not (values > 0).any():
        return 1.0
    lo, hi = 1e-6, 1.0
    f = lambda x: float((share * np.exp(np.minimum(x * values, 600.0))).sum()) - 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge; weights w."""
    m, sd = float(np.average(x, weights=w)), float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w)) or 1.0)
    z, beta = np.stack([(x - m) / sd, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -50, 50)))
        g = z.T @ (w * (y - p)) - ridge * beta
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), g)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / sd), float(beta[1] - beta[0] * m / sd)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 8000, prior: float = 10.0, drift: float = 1.0, least: int = 3) -> Scorer:
    """A scorer from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``least``: sample rows that must hold a token."""
    spark = docs.sparkSession
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rate = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(rate) < 2:
        n = sum(rate.values())
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), -drift, base=(rate.get(1, 0) + 0.5) / (n + 1))
    # a row is in or out by its own hash, so nothing is ordered
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / rate[1])).otherwise(min(1.0, per_class / rate[0]))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= share * (1 << 30))
    chosen = chosen.select("doc_id", "toxic", F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 2, 1).otherwise(0).alias("half"))
    # chosen: about 2 * per_class rows of three numbers at most; equal rows of a document are learned from once
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]).select("text", "toxic", "half")
    sample = materialize(sample, "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each token, the rows of each label that hold it; token 0 counts the rows."""
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                words = Words(block.column(0), NOT_LETTER)
                label = block.column(1).to_numpy()
                row = np.tile(np.repeat(np.arange(block.num_rows), words.counts), len(STEMS))
                token = np.concatenate(units(words))
                order = np.lexsort((token, row))
                token, row = token[order], row[order]
                new = np.ones(len(token), dtype=bool)
                new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
                token, at = np.unique(token[new], return_inverse=True)
                n = [np.append(np.bincount(at[label[row[new]] == v], minlength=len(token)), (label == v).sum()) for v in (0, 1)]
                yield pa.record_batch([pa.array(np.append(token, np.uint64(0)).view(np.int64)), pa.array(n[0]), pa.array(n[1])], names=["token", "clean", "toxic"])

    counts = sample.filter("half = 0").mapInArrow(count, "token long, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rows = counts.filter((F.col("clean") + F.col("toxic") >= least) | (F.col("token") == 0)).toPandas()
    n = rows.loc[rows["token"] == 0, ["clean", "toxic"]].to_numpy(np.float64).reshape(-1, 2).sum(axis=0)
    rows = rows[rows["token"] != 0]
    token = rows["token"].to_numpy(np.int64).view(np.uint64)
    y = rows[["clean", "toxic"]].to_numpy(np.float64)
    alpha = (0.5 + prior * y.sum(axis=1) / max(1.0, n.sum()))[:, None]
    odds = np.log((y + alpha) / (np.maximum(n - y, 0) + prior + 0.5))
    spread = np.sqrt((1 / (y + alpha)).sum(axis=1))
    delta = odds[:, 1] - odds[:, 0]
    # two standard errors are taken off: a token scores only by what the sample is sure of
    scores = np.sign(delta) * np.maximum(0.0, np.abs(delta) - 2 * spread)
    sure = scores != 0
    scorer = Scorer(token[sure], np.clip(scores[sure], -2, 6) - drift, -drift)
    model = spark.sparkContext.broadcast(scorer)

    def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Token score counts of clean rows, on a grid of 1/16."""
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                s = np.rint(model.value.token_scores(Words(block.column(0), NOT_LETTER)) * 16).astype(np.int64)
                value, times = np.unique(s, return_counts=True)
                yield pa.record_batch([pa.array(value), pa.array(times)], names=["value", "times"])

    grid = sample.filter("half = 1 and toxic = 0").mapInArrow(clean_scores, "value long, times long").groupBy("value").agg(F.sum("times").alias("times")).toPandas()
    if len(grid):
        scorer.lam = _karlin_lambda(grid["value"].to_numpy() / 16, grid["times"].to_numpy() / grid["times"].sum())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best segment, number of tokens and label of each calibration row."""
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                words = Words(block.column(0), NOT_LETTER)
                s = model.value.token_scores(words)
                top = [max((x[2] for x in maximal_segments(s[a:b])), default=0.0) for a, b in zip(words.row[:-1], words.row[1:])]
                yield pa.record_batch([pa.array(top, pa.float64()), pa.array(words.counts), block.column(1)], names=["top", "n", "toxic"])

    tail = sample.filter("half = 1 and toxic = 0").mapInArrow(best, "top double, n long, toxic int").toPandas()
    if len(tail):
        x0 = float(np.quantile(tail["top"], 0.9))
        above = float((tail["top"] > x0).sum()) + 0.5
        scorer.k = float(np.clip(above / max(1e-9, float((np.maximum(1, tail["n"]) * np.exp(-scorer.lam * x0)).sum())), 1e-6, 10.0))
    fitted = spark.sparkContext.broadcast(scorer)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                yield pa.record_batch([pa.array(fitted.value.evidence(block.column(0))[0]), block.column(1)], names=["value", "toxic"])

    seen = sample.filter("half = 1").mapInArrow(evidence, "value double, toxic int").toPandas()
    if seen["toxic"].nunique() < 2:
        scorer.base = (rate[1] + 0.5) / (rate[0] + rate[1] + 1)
        return scorer
    label = seen["toxic"].to_numpy(np.float64)
    weight = np.where(label == 1, rate[1] / max(1, label.sum()), rate[0] / max(1, (1 - label).sum()))
    weight *= len(label) / weight.sum()
    scorer.a, scorer.b = _logistic(np.clip(seen["value"].to_numpy(), -30, 60), label, weight)
    return scorer


def score_toxicity(docs: DataFrame, scorer: Scorer, spans: bool = True) -> DataFrame:
    """All columns of ``docs`` (text, ...) with ``toxic_score`` and ``toxic_spans`` (code-point ranges); columns of these names are replaced."""
    docs = docs.drop("toxic_score", "toxic_spans")
    names = docs.columns
    model = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                value, found = own.evidence(block.column(names.index("text")), spans)
                found = pa.array([x or [] for x in found], kind)
                yield pa.record_batch([*block.columns, pa.array(own.probability(value)), found], names=[*names, "toxic_score", "toxic_spans"])

    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_spans", SPAN)])
    return docs.mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id"), 4))
    out = score_toxicity(docs, train(docs, labels), spans=False)
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
