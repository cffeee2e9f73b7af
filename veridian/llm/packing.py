"""Lexical retrieval packing (operator 2).

Documents are encoded once, where they are scanned; from then on only ids move.  They are ordered by two
min-hashes of their rarer terms (term ids from ``common`` on, for a BPE file numbers its frequent pieces
first) and dealt out by ranges of that order, so documents that share much stand together whatever file they
come from, and a term that any share of all rows has in common is still split.  Each task cuts its rows into
index shards of about ``shard_tokens`` ids and builds a BM25 inverted index over every shard: terms are token
ids, weights use k1 and b with the non-negative Robertson-Sparck Jones idf, so terms that most of the shard
holds weigh nothing and have no postings.  A seed meets the neighbours of its shard.

A window starts with a seed, the rest of the document cut at the end of the last window or else
the next unused document.  The index returns the unused neighbours of the seed by score; they fill
the window greedily, the last one is cut where the window ends, and its rest is the next seed.  If
no unused neighbour shares a weighted term, the next unused documents fill.  Windows run on over
shard borders, so each task leaves at most one short window, which is cut into lengths that are
powers of two: nothing is padded.

Every id lies in exactly one piece.  ``sequence_id`` is unique, (task << 32) + number.

Defined cases: null text counts as empty (the end id alone); repeated rows are packed each on its
own; ties in score go to the earlier row of the shard; an empty table gives no row; columns of other names are
ignored.  A document longer than a window fills windows of its own first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridian.llm._bpe import default_tokenizer, encoder
from veridian.llm._shared import materialize, partitions_for, read_table
from veridian.llm._textbytes import mix64, row_blocks

#: Text of a block that is encoded at once.
BLOCK_BYTES = 512 << 10
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25Shard:
    """An inverted index over the token ids of one shard."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, k1: float = 1.2, b: float = 0.75):
        self.n = len(bounds) - 1
        lens = np.diff(bounds)
        row = np.repeat(np.arange(self.n, dtype=np.int64), lens)
        key, tf = np.unique(ids.astype(np.int64) * self.n + row, return_counts=True)
        term, doc = key // self.n, key % self.n
        head = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        df = np.diff(np.append(head, len(term)))
        idf = np.maximum(0.0, np.log((self.n - df + 0.5) / (df + 0.5)))
        weight = np.repeat(idf, df)
        keep = weight > 0
        norm = k1 * (1 - b + b * lens / max(1.0, lens.mean() if self.n else 1.0))
        tf, doc = tf[keep], doc[keep]
        self.doc = doc.astype(np.int32)
        self.weight = (weight[keep] * tf * (k1 + 1) / (tf + norm[doc])).astype(np.float32)
        kept = idf > 0
        self.head = np.append(0, np.cumsum(df[kept]))
        slot = np.repeat(np.arange(int(kept.sum())), df[kept])
        order = np.argsort(self.doc, kind="stable")
        self.terms = slot[order]
        self.own = np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the distinct terms of ``seed``."""
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        lo, n = self.head[terms], self.head[terms + 1] - self.head[terms]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


class Packer:
    """Fills windows of ``size`` ids from one shard after another; ``rows`` gathers the pieces."""

    def __init__(self, size: int, task: int):
        self.size, self.next_id, self.rows = size, task << 32, []
        self.open: list[tuple] = []  # pieces of the window being filled: (doc_id, start, ids, doc_tokens)
        self.used = 0

    def _close(self) -> None:
        at = 0
        for doc_id, start, ids, total in self.open:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4")), total, self.next_id, at))
            at += len(ids)
        self.open, self.used, self.next_id = [], 0, self.next_id + 1

    def _put(self, doc_id, ids: np.ndarray, start: int, total: int) -> int:
        """Appends as much of ``ids`` (which begins at id ``start`` of its document) as fits; how much that was."""
        n = min(len(ids), self.size - self.used)
        self.open.append((doc_id, start, ids[:n].copy(), total))
        self.used += n
        if self.used == self.size:
            self._close()
        return n

    def shard(self, doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> None:
        index, n = Bm25Shard(ids, bounds), len(doc_ids)
        unused = np.ones(n, dtype=bool)
        after = 0  # all rows before it are used
        seed = -1

        def take(i: int) -> int:
            """Puts all of row i; the rest that opened a new window, if any, makes it the seed."""
            unused[i] = False
            at, own = 0, ids[bounds[i] : bounds[i + 1]]
            while at < len(own):
                at += self._put(doc_ids[i], own[at:], at, len(own))
            return i if self.used else -1

        while True:
            while after < n and not unused[after]:
                after += 1
            if after == n:
                break
            if seed < 0:
                seed = take(after)
                continue
            score = index.scores(seed)
            score[~unused] = 0
            near = np.flatnonzero(score > 0)
            order = near[np.lexsort((near, -score[near]))]
            window, seed = self.next_id, -1
            for i in order:
                seed = take(int(i))
                if self.next_id != window:
                    break
            else:
                while self.next_id == window:
                    while after < n and not unused[after]:
                        after += 1
                    if after == n:
                        return
                    seed = take(after)

    def finish(self) -> None:
        """The short last window, cut into powers of two."""
        pieces, left = self.open, self.used
        self.open, self.used, window = [], 0, self.size
        for doc_id, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                if not self.used:
                    self.size = 1 << (left.bit_length() - 1)
                n = self._put(doc_id, ids[at:], start + at, total)
                at, left = at + n, left - n
        self.size = window

    def drain(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * 7
        out = pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PIECES.split(", ")])
        self.rows = []
        return out


TOKENS = "doc_id long, first long, second long, ids binary"


def encoded(docs: DataFrame, path: str, end_id: int, common: int) -> DataFrame:
    """doc_id, ids (two or four bytes each) and two min-hashes of the rarer terms of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        term = np.arange(np.iinfo(np.uint16).max + 1 if enc.dtype == np.uint16 else enc.tokenizer.get_vocab_size(True) + 1, dtype=np.uint64)
        # frequent terms count only where a document has no other
        rank = [(mix64(term * np.uint64(2) + np.uint64(k)) >> np.uint64(2)) | np.where(term < common, np.uint64(1 << 62), np.uint64(0)) for k in (0, 1)]
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                ids, bounds = enc.encode(block.column(1), end_id)
                if not block.num_rows:
                    continue
                least = [np.minimum.reduceat(r[ids], bounds[:-1]).view(np.int64) for r in rank]
                data = np.ascontiguousarray(ids)
                parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), block.num_rows, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int64)), pa.py_buffer(data)])
                yield pa.record_batch([block.column(0), *map(pa.array, least), parts.cast(pa.binary())], names=["doc_id", "first", "second", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = 4096, end_id: int = 2, shard_tokens: int = 1 << 19, common: int = 1 << 15) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text), packed into sequences of ``window`` ids."""
    path = tokenizer or default_tokenizer()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        packer = Packer(window, TaskContext.get().partitionId())
        names, held, n = [], [], 0

        def flush() -> pa.RecordBatch:
            lens = [len(x) for x in held]
            packer.shard(names, np.concatenate(held), np.append(0, np.cumsum(lens)))
            names.clear()
            held.clear()
            return packer.drain()

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(doc_id)
                held.append(np.frombuffer(data.as_buffer(), dtype=dtype))
                n += len(held[-1])
                if n >= shard_tokens:
                    yield flush()
                    n = 0
        if held:
            yield flush()
        packer.finish()
        yield packer.drain()

    tokens = materialize(encoded(docs, path, end_id, common), "tokens")
    n_bytes = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    order = ["first", "second", F.xxhash64("doc_id")]
    dealt = tokens.repartitionByRange(partitions_for(docs.sparkSession, n_bytes), *order).sortWithinPartitions(*order, "doc_id")
    return dealt.select("doc_id", "ids").mapInArrow(pack, PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, packed into sequences of at most 4096 ids."""
    return pack_documents(read_table(spark, sf_dir, "documents"))
