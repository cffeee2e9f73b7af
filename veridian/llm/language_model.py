"""Language-model scoring by deleted interpolation (operator 9).

The model of a word w after the words g h (all counts over all training texts):

    p = a3[b] c(ghw) / c(gh) + a2[b] c(hw) / c(h) + a1[b] c(w) / N + a0[b] / (V + 1)

where b is the bucket of the context's frequency: of c(gh) if that is above zero, else of c(h), with
a3 = 0.  The weights of each bucket are learned by expectation-maximisation on counts that are held
out: a fixed share of the training texts, each token with its own occurrence deleted from the
counts.

Counts never meet in one place.  Texts are packed into chunks (a written table, so every later
pass sees the same chunks).  A chunk sends its distinct word, pair and triple hashes with their
training counts to shards by hash; a shard adds them up and answers each chunk with the totals in
the order asked; the chunk reads its texts again beside the answers.  So a frequent pair costs one
entry for each chunk.  Chunks and shards grow with the square root of the corpus once LEAST_KEYS keys
for each of their messages ask for it (from about 1 TB on; at 100 TB a chunk has about 100 MB), so there
are no more messages than the texts have bytes / 50.

Words are known by 64-bit hashes; pairs and triples by as many bits as make it a chance of 2^-16 that
one shares its hash with another one.

Defined cases: null and empty texts are one end token; words that training never saw count as the
(V+1)-th word; with no training text every token has p = 1; repeated rows are texts of their own and
count each time; a text longer than a chunk is a chunk of its own; columns of other names are ignored;
an empty table gives no row.  A text starts after end tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridian.llm._shared import materialize, read_table
from veridian.llm._textbytes import Words, mix64, row_blocks, segment_sums
from veridian.llm.language_id import held_out

END = np.uint64(0x5EED0000E0DE0FFF)
ORDER = 3
BUCKETS = 24
LEAST_KEYS = 16
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ZSTD = pa.Codec("zstd", compression_level=1)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unsqueeze(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return _squeeze(sink.getvalue().to_pybytes())


def _unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(_unsqueeze(data)).read_all()


def _planes(parts: list[np.ndarray]) -> bytes:
    """Small or evenly growing unsigned numbers, byte plane by byte plane, compressed; one list of them after another."""
    lens = np.array([len(x) for x in parts], dtype=np.uint32).tobytes()
    return _squeeze(lens + b"".join(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in parts))


def _values(data: bytes) -> list[np.ndarray]:
    raw = _unsqueeze(data)
    lens, at, out = np.frombuffer(raw, dtype=np.uint32, count=ORDER), 4 * ORDER, []
    for n in lens.tolist():
        planes = np.frombuffer(raw, dtype=np.uint8, count=8 * n, offset=at).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view(np.uint64).ravel())
        at += 8 * n
    return out


class Chunk:
    """Tokens of some texts, and their distinct words, pairs and triples as sorted keys."""

    def __init__(self, table: pa.Table, bits: int):
        self.doc_id, self.held_out = table["doc_id"], table["held_out"].to_numpy(zero_copy_only=False)
        w = Words(table["text"])
        rows = len(w.row) - 1
        self.bounds = w.row + np.arange(rows + 1)
        token = np.empty(len(w) + rows, dtype=np.uint64)
        is_end = np.zeros(len(token), dtype=bool)
        is_end[self.bounds[1:] - 1] = True
        token[is_end], token[~is_end] = END, w.hashes()
        self.first = self.bounds[:-1]
        shift = np.uint64(64 - bits)
        step = np.uint64(0x9E3779B97F4A7C15)
        hashes, context = [mix64(token ^ np.uint64(0xA5A5A5A5))], token
        with np.errstate(over="ignore"):
            for n in range(1, ORDER):
                context = np.append(END, context[:-1]) if len(token) else token
                context[self.first] = mix64(np.array([END + np.uint64(n)]))[0]
                context = mix64(context * step + token)
                hashes.append(context >> shift)
        self.keys, self.at = zip(*(np.unique(h, return_inverse=True) for h in hashes))
        self.trains = np.repeat(~self.held_out, np.diff(self.bounds))
        self.end_key = mix64(np.array([END ^ np.uint64(0xA5A5A5A5)], dtype=np.uint64))[0]

    def training_counts(self) -> list[np.ndarray]:
        return [np.bincount(at[self.trains], minlength=len(k)) for k, at in zip(self.keys, self.at)]

    def cut(self, shards: int, bits: int) -> list[np.ndarray]:
        """Where the keys of each shard begin; shards take equal ranges of the hashes."""
        out = []
        for k, width in zip(self.keys, [64, *[bits] * (ORDER - 1)]):
            edges = (np.arange(1, shards, dtype=object) * (1 << width) // shards).astype(np.uint64)
            out.append(np.concatenate([[0], np.searchsorted(k, edges), [len(k)]]))
        return out

    def totals(self, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """c(w), c(h), c(hw), c(gh), c(ghw) of every token, from the totals in key order."""
        word, pair, triple = (a[at] for a, at in zip(answers, self.at))
        ends = answers[0][np.searchsorted(self.keys[0], self.end_key)] if len(self.keys[0]) else 0
        before, before2 = np.roll(word, 1), np.roll(pair, 1)
        before[self.first] = before2[self.first] = ends
        return word, before, pair, before2, triple


def bucket(single: np.ndarray, double: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: bits of c(gh) above BUCKETS, or bits of c(h) (0 for an unseen context) where c(gh) is 0."""
    bits = lambda n: np.minimum(BUCKETS - 1, np.ceil(np.log2(np.maximum(n, 0) + 1.0)).astype(np.int64))
    return np.where(double > 0, BUCKETS + bits(double), bits(single))


def estimates(word: np.ndarray, before: np.ndarray, pair: np.ndarray, before2: np.ndarray, triple: np.ndarray, n: int) -> list[np.ndarray]:
    """Maximum-likelihood estimates of order three, two and one (0 in an unseen context)."""
    return [np.where(c > 0, x / np.maximum(c, 1), 0.0) for x, c in ((triple, before2), (pair, before), (word, np.full(len(word), n)))]


def interpolation_weights(cells: np.ndarray, p0: float, rounds: int = 200) -> np.ndarray:
    """EM over (bucket, times, p3, p2, p1) rows: a weight vector (a3, a2, a1, a0) for each bucket.

    A bucket without held-out tokens takes the weights of the next lower one of its kind.
    """
    out = np.tile([0.0, 0.0, 0.5, 0.5], (2 * BUCKETS, 1))
    for b in range(2 * BUCKETS):
        allowed = np.array([b >= BUCKETS, b > 0, True, True])
        own = cells[cells[:, 0] == b]
        if not own[:, 1].sum():
            if b not in (0, BUCKETS):
                out[b] = out[b - 1]
            if b in (1, BUCKETS):
                out[b] = allowed / allowed.sum()
            continue
        p = np.column_stack([own[:, 2:5], np.full(len(own), p0)])
        a, n = allowed / allowed.sum(), own[:, 1]
        for _ in range(rounds):
            r = a * p
            r *= (n / np.maximum(r.sum(axis=1), 1e-300))[:, None]
            new = (r.sum(axis=0) + allowed * [0.01, 0.01, 0.01, 0.1]) / (n.sum() + (allowed * [0.01, 0.01, 0.01, 0.1]).sum())
            if np.abs(new - a).max() < 1e-9:
                break
            a = new
        out[b] = a
    return out


def score_texts(docs: DataFrame, chunk_bytes: int = 4 << 20, shard_keys: int = 1 << 20, tuning_share: int = 8) -> DataFrame:
    """Scores of ``docs`` (doc_id, text, held_out); the rows that are not held out train the model."""
    tuned = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(tuning_share)) == 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", (~F.col("held_out") & tuned).alias("tuning"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    # up to about three distinct keys for ten bytes of text, counted once for each chunk
    keys = max(1, 3 * size // 10)
    least = math.isqrt(LEAST_KEYS * keys)
    chunk_bytes, shard_keys = max(chunk_bytes, 10 * least // 3), max(shard_keys, least)
    shards = max(1, math.ceil(keys / shard_keys))
    bits = min(64, keys.bit_length() + 16)

    def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list] = {False: [], True: []}

        def flush(kind: bool) -> pa.RecordBatch:
            nonlocal n
            table = pa.Table.from_batches(held[kind]).combine_chunks()
            held[kind] = []
            n += 1
            return pa.record_batch([pa.array([task + n]), pa.array([kind]), pa.array([_pack(table)], pa.binary())], names=["chunk", "tuning", "payload"])

        for batch in batches:
            for block in row_blocks(batch, "text", 1 << 20):
                tuning = block.column(2)
                for kind in (False, True):
                    part = block.filter(tuning if kind else pa.compute.invert(tuning))
                    if part.num_rows:
                        held[kind].append(part)
                    if sum(b.nbytes for b in held[kind]) >= chunk_bytes:
                        yield flush(kind)
        for kind in (False, True):
            if held[kind]:
                yield flush(kind)

    chunks = materialize(docs.mapInArrow(to_chunks, "chunk long, tuning boolean, payload binary"), "chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = Chunk(_unpack(payload.as_py()), bits)
                cuts, n = c.cut(shards, bits), c.training_counts()
                shard, asked, counts = [], [], []
                for s in range(shards):
                    at = [slice(cut[s], cut[s + 1]) for cut in cuts]
                    if any(x.stop > x.start for x in at):
                        shard.append(s)
                        asked.append(_planes([np.diff(k[x], prepend=np.uint64(0)) for k, x in zip(c.keys, at)]))
                        counts.append(_planes([m[x] for m, x in zip(n, at)]))
                yield pa.record_batch([pa.array([chunk] * len(shard), pa.int64()), pa.array(shard, pa.int32()), pa.array(asked, pa.binary()), pa.array(counts, pa.binary())], names=["chunk", "shard", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        keys = [[np.cumsum(x, dtype=np.uint64) for x in _values(k)] for k in table["keys"].to_pylist()]
        counts = [_values(k) for k in table["counts"].to_pylist()]
        replies, vocabulary, tokens = [[] for _ in keys], 0, 0
        for kind in range(ORDER):
            own = [k[kind] for k in keys]
            distinct, at = np.unique(np.concatenate(own), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([c[kind] for c in counts]), minlength=len(distinct)).astype(np.uint64)
            if kind == 0:
                vocabulary, tokens = int((total > 0).sum()), int(total.sum())
            for reply, part in zip(replies, np.split(total[at], np.cumsum([len(x) for x in own])[:-1])):
                reply.append(part)
        n = len(replies)
        return pa.table({"chunk": table["chunk"], "shard": table["shard"], "totals": pa.array([_planes(r) for r in replies], pa.binary()), "v": pa.array([vocabulary] + [0] * (n - 1), pa.int64()), "n": pa.array([tokens] + [0] * (n - 1), pa.int64())})

    asked = chunks.select("chunk", "payload").mapInArrow(ask, "chunk long, shard int, keys binary, counts binary")
    replies = materialize(asked.groupBy("shard").applyInArrow(answer, "chunk long, shard int, totals binary, v long, n long"), "replies")
    sums = replies.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    v, n_train = sums.v or 0, sums.n or 0
    p0 = 1.0 / (v + 1)

    def beside(fn):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            chunk = Chunk(_unpack(left["payload"][0].as_py()), bits)
            parts = [_values(t) for t in right.sort_by("shard")["totals"].to_pylist()]
            return fn(chunk, *chunk.totals([np.concatenate([p[kind] for p in parts]).astype(np.int64) for kind in range(ORDER)]))

        return run

    def held_out_cells(chunk: Chunk, *counts: np.ndarray) -> pa.Table:
        """Held-out tokens in cells of bucket and estimates (a power of two each), with sums."""
        counts = [c - 1 for c in counts]
        p = estimates(*counts, n_train - 1)
        grid = [np.where(x > 0, np.floor(np.log2(np.maximum(x, 1e-300))), -1000).astype(np.int64) for x in p]
        cell, at = np.unique(np.stack([bucket(counts[1], counts[3]), *grid], axis=1), axis=0, return_inverse=True)
        sums = [np.bincount(at.ravel(), weights=x, minlength=len(cell)) for x in p]
        return pa.table({"b": cell[:, 0], "i": cell[:, 1], "j": cell[:, 2], "k": cell[:, 3], "times": np.bincount(at.ravel(), minlength=len(cell)), "p3": sums[0], "p2": sums[1], "p1": sums[2]})

    tuning = chunks.filter("tuning").select("chunk", "payload").groupBy("chunk")
    cells = tuning.cogroup(replies.join(chunks.filter("tuning").select("chunk"), "chunk", "left_semi").select("chunk", "shard", "totals").groupBy("chunk"))
    cells = cells.applyInArrow(beside(held_out_cells), "b long, i long, j long, k long, times long, p3 double, p2 double, p1 double")
    # a cell is a bucket and three powers of two: their number is bounded whatever the size of the corpus
    cells = cells.groupBy("b", "i", "j", "k").agg(*[F.sum(c).alias(c) for c in ("times", "p3", "p2", "p1")]).toPandas()
    cells = cells[["b", "times", "p3", "p2", "p1"]].to_numpy(np.float64)
    if len(cells):
        cells[:, 2:] /= cells[:, 1:2]
    weights = interpolation_weights(cells if len(cells) else np.zeros((0, 5)), p0) if n_train else np.tile([0.0, 0.0, 0.0, 1.0], (2 * BUCKETS, 1))

    def scores(chunk: Chunk, *counts: np.ndarray) -> pa.Table:
        word = counts[0]
        a = weights[bucket(counts[1], counts[3])]
        p = sum(a[:, i] * x for i, x in enumerate([*estimates(*counts, n_train), p0]))
        base = np.log10((word + 1.0) / (n_train + v + 1.0))
        add = lambda x: segment_sums(x, chunk.bounds)
        rows = len(chunk.held_out)
        return pa.table({"doc_id": chunk.doc_id.combine_chunks(), "held_out": pa.array(chunk.held_out), "n_tokens": np.diff(chunk.bounds), "n_known": add((word > 0).astype(np.int64)), "train_tokens": np.full(rows, n_train, dtype=np.int64), "base_score": add(base), "score": add(np.log10(p))})

    return chunks.select("chunk", "payload").groupBy("chunk").cogroup(replies.select("chunk", "shard", "totals").groupBy("chunk")).applyInArrow(beside(scores), SCORES)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under a model of the rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs.withColumn("held_out", held_out(F.col("doc_id"), 7)))
