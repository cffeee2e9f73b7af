"""N-gram Jaccard join with count-vector R-trees (operator 6).

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of at
least 0.8.  Shingles are 64-bit hashes; equal sets form one class, so exact copies meet once.
A class is known by 64 bits of a digest; another 64 bits show classes that share them by chance
(a few at 10^10 documents), and those get names of their own.

1. One pass over the texts gives each document's class, set size and count vector (its shingles
   hashed into groups, one count for each group), and a fixed-size sketch of how many documents
   hold the shingles of each hash bucket.
2. A second pass emits, for each document, the shingles that come first in the order (sketch
   count, hash): by the prefix principle two linked documents share one of the first
   n - ceil(0.8 n) + 1.  The sketch only chooses the order, rare shingles first, so passages that
   many documents share are not keys; any order gives whole results.  Of T shingles in all a bucket
   holds T / 2^20 give or take its square root, so what stands out is a shingle held by several
   times sqrt(T / 2^20) documents: 50 at 10^9 shingles, 20,000 at 10^13.
3. The classes that share a key form a block.  Blocks with the same classes (the keys of one passage)
   become one.  Stars come first: every class names, ``stars`` times, the leader that it shares most
   keys with (one class of each block), the overlap is bounded by the sum of coordinate minima of
   the count vectors, survivors are verified on the complete sets, and verified links are joined
   into components.  So a large group of near copies costs ``stars`` tests for each member.
4. Then the blocks that still hold several components are searched, those of one leader together, each
   class once.  An R-tree over the count vectors finds the members whose overlap with one of another
   component can reach the threshold: the bound is taken for a node's upper corner first, then for its
   points.  Only these get their complete sets, and their overlaps are counted inside the tasks, where
   just the links that join components come out: pairs are never rows.  No pair between different
   components that could link is left out; pairs inside a component need no test.

Complete sets are made for the classes of star pairs and those that the search finds only.  Keys that the
sketch calls common are dealt out in slices, and blocks heavier than ``block_rows`` as pairs of slices ordered
by set size (slices too unlike in size never meet), so no task holds one whole.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing (not with
each other); fewer than five words count as one shingle; rows that repeat a ``doc_id`` are
documents of their own in the join, and a component is named by the smallest ``doc_id`` in it (null
if all are null); ties in the order of keys go to the smaller hash; very long texts are hashed in
windows; columns of other names are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.llm._shared import drop, materialize, read_table, shuffle_partitions
from veridian.llm._textbytes import Words, mix64, row_blocks
from veridian.llm.components import components

SHINGLE_WORDS = 5
#: Text of a block that is read at once.
BLOCK_BYTES = 512 << 10
GROUPS = 256
SKETCH_BITS = 20
SKETCH_PARTS = 64
LEAF = 32
#: So many shingles weigh as much as a row of a block.
ROW_SHINGLES = 256

_STEP = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(SHINGLE_WORDS)], dtype=np.uint64)


def shingle_sets(column: pa.Array, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; empty for rows without words."""
    words = Words(column)
    h, row = words.hashes(), words.row
    with np.errstate(over="ignore"):
        n = len(h) - k + 1
        s = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(k if n > 0 else 0):
            s += h[j : j + n] * _STEP[j]
        s = mix64(s)
        for a, b in zip(row[:-1], row[1:]):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                part = np.uint64(b - a)
                for j in range(b - a):
                    part = part + h[a + j] * _STEP[j]
                yield mix64(np.array([part], dtype=np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def class_of(shingles: np.ndarray) -> tuple[int | None, int | None]:
    """The class of a set and a second hash of it; none for an empty set."""
    if not len(shingles):
        return None, None
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


class ClassNames:
    """Names of classes: the first hash, or the second for sets that share the first by chance.

    ``clashes`` maps a shared first hash to the smallest second one, which keeps it.
    """

    def __init__(self, clashes: dict[int, int]):
        self.clashes = clashes

    def __call__(self, shingles: np.ndarray) -> int | None:
        cls, check = class_of(shingles)
        return check if cls in self.clashes and check != self.clashes[cls] else cls

    def column(self, cls: str, check: str):
        """The name as a column expression."""
        if not self.clashes:
            return F.col(cls)
        least = F.create_map(*[F.lit(x) for pair in self.clashes.items() for x in pair])[F.col(cls)]
        return F.when(least.isNotNull() & (F.col(check) != least), F.col(check)).otherwise(F.col(cls))


def count_vector(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group counts in one byte each; 255 stands for anything above 254."""
    n = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(n, 255).astype(np.uint8)


def vectors_of(vec: list[bytes], n: np.ndarray) -> np.ndarray:
    """Count vectors as a matrix; a count that one byte does not hold is bounded by the set size ``n``."""
    v = np.frombuffer(b"".join(vec), dtype=np.uint8).reshape(-1, GROUPS)
    if not (v == 255).any():
        return v
    return np.where(v == 255, np.asarray(n).astype(np.int32)[:, None], v)


def prefix_length(n: int, percent: int) -> int:
    """n - ceil(percent/100 * n) + 1"""
    return n + (-percent * n // 100) + 1 if n else 0


def needed_overlap(a, b, percent: int):
    """The smallest overlap with 100 * overlap >= percent * union, for set sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


FACTS = "doc_id long, cls long, check long, n int, vec binary, part int, counts binary"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("check", pa.int64()), ("n", pa.int32()), ("vec", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    seen = False
    for batch in batches:
        for block in row_blocks(batch, "text", BLOCK_BYTES):
            seen = True
            cls, check, n, vec = [], [], [], []
            for u in shingle_sets(block.column(1)):
                first, second = class_of(u)
                cls.append(first)
                check.append(second)
                n.append(len(u))
                vec.append(count_vector(u).tobytes() if len(u) else None)
                np.add.at(sketch, (u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
            k = len(n)
            yield pa.record_batch([block.column(0), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int32()), pa.array(vec, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema=schema)
    if seen:
        k = SKETCH_PARTS
        parts = [p.tobytes() for p in np.split(sketch, k)]
        yield pa.record_batch([*[pa.nulls(k, pa.int64()) for _ in range(3)], pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], schema=schema)


SUMS = "part int, counts binary"


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the sketch parts that a task sees, one row for each part."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(counts.as_buffer(), dtype=np.uint32)
            have = total.get(part)
            total[part] = own.copy() if have is None else np.where(have > ~own, np.uint32(0xFFFFFFFF), have + own)
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["part", "counts"])


def read_sketch(facts: DataFrame) -> np.ndarray:
    """The sketch of the whole table: SKETCH_PARTS rows of 64 KB at any size of it, summed by tasks and then by part."""
    parts = facts.filter("part is not null").select("part", "counts").mapInArrow(_add_counts, SUMS)
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    width = (1 << SKETCH_BITS) // SKETCH_PARTS
    for row in parts.repartition("part").mapInArrow(_add_counts, SUMS).collect():
        sketch[row.part * width : (row.part + 1) * width] = np.frombuffer(row.counts, dtype=np.uint32)
    return sketch


FILTER_MOST_BYTES = 32 << 20
_NO_ID = 0x5EED0000


def _marks(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64)) & np.uint64(8 * size - 1)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray | None:
    """A bitmap of ``ids`` (one long column; null is a value too), sixteen bits for each and at most FILTER_MOST_BYTES.

    It only spares texts that nobody asks for: where it is too small more pass, none is lost.
    """
    n = ids.count()
    if not n:
        return None
    size = min(FILTER_MOST_BYTES, max(1 << 13, 1 << (2 * n).bit_length()))
    width = size // SKETCH_PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=np.uint8)
        for batch in batches:
            at = _marks(batch.column(0).fill_null(_NO_ID).to_numpy(), size)
            np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.record_batch([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([p.tobytes() for p in np.split(bits, SKETCH_PARTS)], pa.binary())], names=["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, bits in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
                total[part] = own | total[part] if part in total else own.copy()
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], names=["part", "bits"])

    bits = np.zeros(size, dtype=np.uint8)
    for row in ids.mapInArrow(mark, "part int, bits binary").repartition("part").mapInArrow(merge, "part int, bits binary").collect():
        bits[row.part * width : (row.part + 1) * width] = np.frombuffer(row.bits, dtype=np.uint8)
    return bits


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cls) of rows (key, slice, cls) sorted by them: each once, and none of a key with one class.

    Keys dealt out in slices (slice above 0) keep all; whether they hold one class is seen later.
    """
    carry, grouped = None, False  # the last row so far, and whether its key had another one before it

    def out(key: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(key, pa.int64()), pa.array(cls, pa.int64())], names=["key", "cls"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, cls = (batch.column(i).to_numpy() for i in range(3))
        if carry is not None:
            key, part, cls = (np.append(x, y) for x, y in zip(carry, (key, part, cls)))
        near = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        new = np.append(True, ~near | (cls[1:] != cls[:-1]))
        key, part, cls = key[new], part[new], cls[new]
        same = np.concatenate([[grouped], (key[1:] == key[:-1]) & (part[1:] == part[:-1])])
        keep = same[:-1] | same[1:] | (part[:-1] > 0)
        carry, grouped = (key[-1:], part[-1:], cls[-1:]), bool(same[-1])
        yield out(key[:-1][keep], cls[:-1][keep])
    if carry is not None and (grouped or carry[1][0] > 0):
        yield out(carry[0], carry[2])


class CountTree:
    """An R-tree over count vectors, bulk-loaded in the order given (rows sorted by set size).

    Each node keeps the upper corner of its points and their smallest set size; fan-out LEAF.
    """

    def __init__(self, vec: np.ndarray, n: np.ndarray):
        self.levels = [(vec, n)]
        while len(self.levels[-1][0]) > LEAF:
            v, m = self.levels[-1]
            at = np.arange(0, len(v), LEAF)
            self.levels.append((np.maximum.reduceat(v, at), np.minimum.reduceat(m, at)))

    def survivors(self, q: np.ndarray, nq: int, percent: int) -> np.ndarray:
        """Points whose bound on the overlap with (q, nq) reaches the threshold."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            vec, n = self.levels[depth]
            at = at[100 * nq >= percent * n[at]]
            if not len(at):
                return at
            bound = np.minimum(vec[at], q).sum(axis=1, dtype=np.int64)
            at = at[bound >= needed_overlap(n[at], nq, percent)]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return at


PAIR = "a long, b long"
GROUP = ("leader", "deal", "tile")
MEMBER = "leader long, deal long, tile long, side int, cls long, n int, label long"
HELD_BYTES = 8 << 20


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows in runs that end where a group (leader, deal, tile) ends, and the bounds of the groups in them."""
    held: list[pa.RecordBatch] = []

    def cuts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        for c in GROUP:
            v = table[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 8192 and sum(b.nbytes for b in held) < HELD_BYTES:
            continue
        table = pa.Table.from_batches(held)
        at = cuts(table)
        if len(at):
            yield np.append(0, at), table.slice(0, int(at[-1]))
            held = table.slice(int(at[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield np.concatenate([[0], cuts(table), [len(table)]]), table


def _components_of(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of each member, numbered, and the members that ask: those of the most common one meet only the others."""
    _, at = np.unique(label, return_inverse=True)
    return at, np.flatnonzero(at != np.bincount(at).argmax())


def _with_partners(percent: int):
    """The members of groups that may link with one of another component; ``side`` 0 meets side 1, or all meet all (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, table in _groups(batches):
            label, side, n = (table[c].to_numpy() for c in ("label", "side", "n"))
            vec = vectors_of(table["vec"].to_pylist(), n)
            chosen = np.zeros(len(table), dtype=bool)
            for s, e in zip(bounds[:-1], bounds[1:]):
                at, askers = _components_of(label[s:e])
                if not len(askers):
                    continue
                tree = CountTree(vec[s:e], n[s:e])
                for i in askers:
                    hit = tree.survivors(vec[s + i], int(n[s + i]), percent)
                    hit = hit[(at[hit] != at[i]) & ((side[s + hit] != side[s + i]) | (side[s + i] == 2))]
                    if len(hit):
                        chosen[s + i] = chosen[s + hit] = True
            if chosen.any():
                yield from table.drop_columns(["vec"]).filter(pa.array(chosen)).to_batches()

    return run


def _joining_links(percent: int):
    """The links (a, b) that join components in groups whose members come with their complete sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, table in _groups(batches):
            for s, e in zip(bounds[:-1], bounds[1:]):
                part = table.slice(s, e - s)
                cls, label = part["cls"].to_numpy(), part["label"].to_numpy()
                links = _links_between(label, [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in part["shingles"]], percent)
                if links:
                    a, b = (cls[list(x)] for x in zip(*links))
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links_between(label: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places of linked sets of different components, as many as join all components that links join."""
    at, askers = _components_of(label)
    if not len(askers):
        return []
    size = np.array([len(x) for x in sets])
    begin = np.append(0, np.cumsum(size))
    # who holds each shingle
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets), dtype=np.int32), size)[np.argsort(shingle, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(shingle)))
    root = np.arange(at.max() + 1)  # of each component, always the root itself
    links = []
    for i in askers:
        own = shingle[begin[i] : begin[i + 1]]
        held = first[own + 1] - first[own]
        each = np.repeat(first[own] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        both = np.bincount(holders[each], minlength=len(sets))
        for j in np.flatnonzero((100 * both >= percent * (size[i] + size - both)) & (root[at] != root[at[i]])):
            x, y = root[at[i]], root[at[j]]
            if x != y:
                root[root == x] = y
                links.append((int(i), int(j)))
        if (root == root[0]).all():
            break
    return links


def _bounded(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose count vectors allow a link."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (vectors_of(batch.column(i).to_pylist(), batch.column(i - 1).to_numpy()) for i in (3, 5))
                need = needed_overlap(batch.column(2).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int64), percent)
                yield batch.select([0, 1]).filter(pa.array(np.minimum(x, y).sum(axis=1, dtype=np.int64) >= need))

    left = vectors.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = vectors.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "va", "nb", "vb").mapInArrow(test, PAIR)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) with ``linked``: whether the complete sets reach the threshold."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                out.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "linked"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long, linked boolean")


def _keys(docs: DataFrame, sketch: np.ndarray, name: ClassNames, percent: int, slice_rows: int) -> DataFrame:
    """key, slice, cls of every document's prefix.  Keys of buckets far above the mean are dealt out in slices by class."""
    spark = docs.sparkSession
    mean = float(sketch.mean())
    common = max(float(slice_rows), mean + 8 * math.sqrt(mean))
    shared = spark.sparkContext.broadcast(sketch)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for block in row_blocks(batch, "text", BLOCK_BYTES):
                key, cls, rank = [], [], []
                for u in shingle_sets(block.column(1)):
                    p = prefix_length(len(u), percent)
                    if p:
                        held = counts[(u >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                        first = np.argsort(held, kind="stable")[:p]
                        key.append(u[first].view(np.int64))
                        rank.append(held[first])
                        cls.append(np.full(p, name(u)))
                if key:
                    cls, rank = np.concatenate(cls), np.concatenate(rank)
                    slices = np.where(rank > common, np.ceil(rank / slice_rows), 0).astype(np.int64)
                    part = np.where(slices > 0, 1 + (mix64(cls.view(np.uint64)) >> np.uint64(33)).astype(np.int64) % np.maximum(slices, 1), 0)
                    yield pa.record_batch([pa.array(np.concatenate(key)), pa.array(part.astype(np.int32)), pa.array(cls)], names=["key", "slice", "cls"])

    return docs.mapInArrow(keys, "key long, slice int, cls long")


def _blocks_of(members: DataFrame) -> DataFrame:
    """``members`` (key, cls) of keys with several classes, one key for each set of classes; ``keys`` counts those it stands for.

    Sums of hashes know a set of classes: two keys are taken as one if size and 128 bits agree.
    """
    whole = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("cls").alias("low"), F.max("cls").alias("high"),
        F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"),
    )
    whole = whole.filter("low < high").groupBy("n", "low", "high", "x", "y").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("keys"))
    return members.join(whole.select("key", "keys"), "key")


def _star_pairs(members: DataFrame, stars: int) -> DataFrame:
    """(a, b): every class and, for each star, the leader that it shares most keys with."""
    leaders = [F.min(F.struct(F.xxhash64("cls", F.lit(star)).alias("h"), "cls"))["cls"] for star in range(stars)]
    heads = members.groupBy("key").agg(F.array(*leaders).alias("leaders"))
    named = members.join(heads, "key").select("cls", "keys", F.posexplode("leaders").alias("star", "other")).filter("cls <> other")
    named = named.groupBy("star", "cls", "other").agg(F.sum("keys").alias("keys"))
    best = named.groupBy("star", "cls").agg(F.max(F.struct("keys", "other")).alias("p"))
    return best.select(F.least("cls", "p.other").alias("a"), F.greatest("cls", "p.other").alias("b")).distinct()


def _weight() -> Column:
    """A row weighs one, and one more for every ROW_SHINGLES shingles."""
    return 1 + F.floor(F.col("n") / ROW_SHINGLES)


def _open_members(members: DataFrame, label: DataFrame, sizes: DataFrame, block_rows: int) -> DataFrame:
    """key, rows, leader, deal, cls, n, label of the blocks that hold several components; ``rows`` is the block's weight.

    Blocks of one leader go together if their distinct classes weigh ``block_rows`` at most, else no more of them
    (``deal``) than weigh about that.  Heavier blocks go alone.
    """
    own = members.join(label, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("label", "cls").alias("label"))
    first = F.min(F.struct(F.xxhash64("cls", F.lit(0)).alias("h"), "cls"))["cls"]
    heads = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), first.alias("leader"))
    rows = own.join(heads.filter("low < high").select("key", "leader"), "key").join(sizes, "cls").withColumn("weight", _weight())
    rows = materialize(rows, "open")
    weights = rows.groupBy("key").agg(F.sum("weight").alias("rows"))
    small = rows.join(weights.filter(F.col("rows") <= block_rows), "key")
    totals = small.groupBy("leader", "cls").agg(F.first("weight").alias("once"), F.sum("weight").alias("all")).groupBy("leader").agg(F.sum("once").alias("once"), F.sum("all").alias("all"))
    deal = F.pmod(F.xxhash64("key"), F.coalesce(F.floor(F.col("all") / block_rows), F.lit(0)) + 1)
    small = small.join(totals.filter(F.col("once") > block_rows), "leader", "left").withColumn("deal", deal)
    large = rows.join(weights.filter(F.col("rows") > block_rows), "key").withColumn("leader", F.col("key")).withColumn("deal", F.lit(-1).cast("long"))
    fields = ["key", "rows", "leader", "deal", "cls", "n", "label"]
    return small.select(fields).union(large.select(fields))


def _tiles(members: DataFrame, block_rows: int, percent: int) -> DataFrame:
    """key, leader, deal, tile, side, cls, n, label: blocks of ``members`` as they are searched.

    A block that weighs more than ``block_rows`` is cut into slices by set size, ties by a hash, from the counts of
    its sizes; two slices meet where their sizes allow a link.
    """
    fields = ["key", "leader", "deal", "tile", "side", "cls", "n", "label"]
    small = members.filter(F.col("rows") <= block_rows).withColumn("tile", F.lit(0).cast("long")).withColumn("side", F.lit(2))
    large = members.filter(F.col("rows") > block_rows)
    sizes = large.groupBy("key", "n").agg((F.count(F.lit(1)) * _weight()).alias("own"))
    before = F.sum("own").over(W.partitionBy("key").orderBy("n")) - F.col("own")
    at = F.col("before") + F.col("own") * (F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) / (1 << 20))
    large = large.join(sizes.withColumn("before", before), ["key", "n"]).withColumn("slice", F.floor(at / block_rows).cast("long"))
    slices = large.groupBy("key", "slice").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = slices.alias("a"), slices.alias("b")
    meet = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.slice") <= F.col("b.slice")) & (100 * F.col("a.high") >= percent * F.col("b.low")))
    meet = meet.select(F.col("a.key").alias("k"), (F.col("a.slice") * (1 << 31) + F.col("b.slice")).alias("tile"), F.col("a.slice").alias("x"), F.col("b.slice").alias("y"))
    same = meet.filter("x = y").select("k", "tile", F.col("x").alias("s"), F.lit(2).alias("side"))
    both = meet.filter("x < y").select("k", "tile", F.explode(F.array(F.struct(F.col("x").alias("s"), F.lit(0).alias("side")), F.struct(F.col("y").alias("s"), F.lit(1).alias("side")))).alias("e")).select("k", "tile", "e.*")
    large = large.join(same.union(both), (F.col("key") == F.col("k")) & (F.col("slice") == F.col("s")))
    return small.select(fields).union(large.select(fields))


def ngram_components(docs: DataFrame, percent: int = 80, block_rows: int = 4096, stars: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = materialize(docs.mapInArrow(_facts, FACTS), "facts")
    sketch = read_sketch(facts)
    clashes = facts.filter("cls is not null").groupBy("cls").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low < high")
    # about n^2 / 2^65 rows for n documents: two at 10^10
    name = ClassNames({r.cls: r.low for r in clashes.collect()})
    facts = facts.filter("part is null").select("doc_id", name.column("cls", "check").alias("cls"), "n", "vec")

    keys = _keys(docs, sketch, name, percent, block_rows).repartition(shuffle_partitions(spark), "key", "slice").sortWithinPartitions("key", "slice", "cls")
    shared = materialize(keys.mapInArrow(_shared_rows, "key long, cls long"), "shared")
    members = materialize(_blocks_of(shared), "members")
    drop(shared)
    vectors = facts.join(members.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("vec").alias("vec"))
    vectors = materialize(vectors, "vectors")

    def complete_sets(classes: DataFrame) -> DataFrame | None:
        """cls, shingles of ``classes`` (cls), a written table; None if there are none."""
        wanted = id_filter(vectors.join(classes, "cls", "left_semi").select("doc_id"))
        if wanted is None:
            return None
        asked = spark.sparkContext.broadcast(wanted)

        def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits, given = asked.value, set()
            for batch in batches:
                at = _marks(batch.column(0).fill_null(_NO_ID).to_numpy(), len(bits))
                chosen = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
                for block in row_blocks(chosen, "text", BLOCK_BYTES):
                    keep, sets = [], []
                    for u in shingle_sets(block.column(1)):
                        cls = name(u)
                        if cls is not None and cls not in given:
                            given.add(cls)
                            keep.append(cls)
                            sets.append(u.tobytes())
                    yield pa.record_batch([pa.array(keep, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "shingles"])

        sets = docs.mapInArrow(to_sets, "cls long, shingles binary").join(classes, "cls", "left_semi")
        return materialize(sets.dropDuplicates(["cls"]), "sets")

    pairs = materialize(_bounded(_star_pairs(members, stars), vectors, percent), "stars")
    sets = complete_sets(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    links = pairs
    if sets is not None:
        links = materialize(_verified(pairs, sets, percent).filter("linked").select("a", "b"), "tested")
        drop(sets)
    label = materialize(components(links), "labels")
    tiles = _tiles(_open_members(members, label, vectors.select("cls", "n"), block_rows), block_rows, percent)
    fields = [f.split()[0] for f in MEMBER.split(", ")]
    tiles = tiles.select(fields).distinct().join(vectors.select("cls", "vec"), "cls").select(*fields, "vec")
    tiles = tiles.repartition(shuffle_partitions(spark), *GROUP).sortWithinPartitions(*GROUP, "n", "cls")
    asked = materialize(tiles.mapInArrow(_with_partners(percent), MEMBER), "asked")
    sets = complete_sets(asked.select("cls").distinct())
    if sets is not None:
        full = asked.join(sets, "cls").select(*GROUP, "cls", "label", "shingles").repartition(shuffle_partitions(spark), *GROUP).sortWithinPartitions(*GROUP)
        more = materialize(full.mapInArrow(_joining_links(percent), PAIR).distinct(), "more")
        drop(sets)
        label = materialize(components(links.union(more)), "labels")
    rows = facts.join(label, F.col("cls") == F.col("node"), "left")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "cls", F.coalesce("label", "cls").alias("label"))
    named = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(named, "label", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size and component."""
    return ngram_components(read_table(spark, sf_dir, "documents"))
