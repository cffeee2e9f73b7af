"""MinHash near-dedup (operator 13).

Two documents link when their sets of distinct 3-word shingles have a Jaccard similarity of at least
0.85; linked documents form a component, and the smallest ``doc_id`` of it is kept.

1. One pass over the texts gives each document's class (equal sets are one class, so exact copies meet
   once), its set size and, once for each class that a task sees, its signature: ``bands * rows`` minima
   of the shingles under as many universal (multiply-add) hash functions, of which one byte each is kept.
2. Banding: a class has one key for each band of ``rows`` bytes.  At similarity s two classes share a
   band with probability s^rows and none with (1 - s^rows)^bands: 6 * 10^-9 at 0.85 for 40 bands of 6.
3. The classes that share a key form a bucket; buckets with the same classes become one.  Stars come
   first: every class names, ``stars`` times, the leader that it shares most keys with, so a bucket of n
   classes gives some n pairs, not n^2.  A pair survives the signature verification if as many minima
   agree as a linked pair has but for six standard deviations (170 of 240); survivors are confirmed on
   the full sets, and confirmed links are joined into components by alternating large-star and
   small-star.
4. In every bucket that still holds several components, signatures of different components are compared
   inside the tasks (large buckets in pairs of slices ordered by set size).  Only the members that agree with
   one of another component get their full sets, and go through the same comparison again, where agreeing
   pairs are confirmed and links leave the task: pairs are never rows.  A pair is compared in the bucket of
   its first common band only; pairs inside a component need no test.

A link is lost only where all bands differ or the minima agree far less than expected: with a probability
below 10^-7 for a single pair at the threshold, and less above it.  No link is made by a signature alone.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and are kept; fewer
than three words count as one shingle; rows that repeat a ``doc_id`` are documents of their own, and a
component is named by the smallest ``doc_id`` in it (null if all are null); ``kept`` compares null as a
value; very long texts are hashed in windows; columns of other names are ignored; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.llm._shared import drop, materialize, read_table, shuffle_partitions
from veridian.llm._textbytes import mix64, row_blocks
from veridian.llm.components import components
from veridian.llm.ngram_join import _NO_ID, _blocks_of, _marks, _star_pairs, _verified, ClassNames, class_of, id_filter, shingle_sets

SHINGLE_WORDS = 3
BANDS = 40
ROWS = 6
PERCENT = 85

FACTS = "doc_id long, cls long, check long, n int, vec binary"
PAIR = "a long, b long"
#: The band of a key is in its highest bits.
BAND_SHIFT = 57
#: So many shingles weigh as much as a row of a slice.
ROW_SHINGLES = 512


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``count`` universal functions x -> a * x + b modulo 2^32."""
    drawn = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    drawn = (drawn >> np.uint64(32)).astype(np.uint32)
    return drawn[:count] | np.uint32(1), drawn[count:]


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The lowest bytes of the minima of each (non-empty) set of 64-bit shingles under ``count`` functions: one row for each set.

    Equal minima have equal bytes; others seem to agree once in 256 times, which adds to candidates and takes none.
    """
    a, b = hash_functions(count)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out, h = np.empty((len(sets), count), dtype=np.uint8), np.empty_like(x)
    for i in range(count):
        np.multiply(x, a[i], out=h)
        np.add(h, b[i], out=h)
        out[:, i] = np.minimum.reduceat(h, at) & np.uint32(0xFF)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One key (positive, smaller for earlier bands) for each row and band of signatures."""
    rows = sig.shape[1] // bands
    with np.errstate(over="ignore"):
        key = np.zeros((len(sig), bands), dtype=np.uint64)
        for j in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::rows].astype(np.uint64) + np.uint64(1))
    return ((key >> np.uint64(64 - BAND_SHIFT)) | (np.arange(bands, dtype=np.uint64) << np.uint64(BAND_SHIFT))).view(np.int64)


def least_agreement(count: int, percent: int) -> int:
    """The fewest agreeing minima, of ``count``, that a linked pair is expected to have: six standard deviations below the mean."""
    s = percent / 100
    return max(1, math.floor(count * s - 6 * math.sqrt(count * s * (1 - s))))


def _facts(count: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.int64()), ("check", pa.int64()), ("n", pa.int32()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = set()  # classes of this task that have their signature
        for batch in batches:
            for block in row_blocks(batch, "text"):
                cls, check, n, fresh, sets = [], [], [], [], []
                for i, u in enumerate(shingle_sets(block.column(1), k)):
                    name = class_of(u)
                    cls.append(name[0])
                    check.append(name[1])
                    n.append(len(u))
                    if len(u) and name not in signed:
                        signed.add(name)
                        fresh.append(i)
                        sets.append(u)
                vec: list[bytes | None] = [None] * len(n)
                if sets:
                    for i, s in zip(fresh, signatures(sets, count)):
                        vec[i] = s.tobytes()
                yield pa.record_batch([block.column(0), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int32()), pa.array(vec, pa.binary())], schema=schema)

    return run


def _matrix(vec: list[bytes], count: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec), dtype=np.uint8).reshape(-1, count)


def _band_rows(count: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column(2).to_pylist(), count), bands)
                cls, n = (pa.array(np.repeat(batch.column(i).to_numpy(), bands)) for i in (0, 1))
                yield pa.record_batch([pa.array(keys.ravel()), cls, n], names=["key", "cls", "n"])

    return run


def _agreeing(pairs: DataFrame, vectors: DataFrame, count: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose sizes and signatures allow a link."""
    least = least_agreement(count, percent)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = _matrix(batch.column(2).to_pylist(), count) == _matrix(batch.column(3).to_pylist(), count)
                yield batch.select([0, 1]).filter(pa.array(same.sum(axis=1) >= least))

    left = vectors.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("vec").alias("va"))
    right = vectors.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("vec").alias("vb"))
    sized = pairs.join(left, "a").join(right, "b").filter(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    return sized.select("a", "b", "va", "vb").mapInArrow(test, PAIR)


def _slices(members: DataFrame, most: int, percent: int) -> DataFrame:
    """key, tile, side, cls, n, label of ``members`` (key, cls, n, label): buckets as they are searched.

    A bucket heavier than ``most`` (a row, and one more for every ROW_SHINGLES shingles) is cut into slices by
    set size, ties by a hash, from the counts of its sizes; two slices meet where their sizes allow a link.
    """
    fields = ["key", "tile", "side", "cls", "n", "label"]
    weight = 1 + F.col("n") / ROW_SHINGLES
    sizes = members.groupBy("key", "n").agg((F.count(F.lit(1)) * weight).alias("own"))
    heavy = sizes.groupBy("key").agg(F.sum("own").alias("all")).filter(F.col("all") > most).select("key")
    small = members.join(heavy, "key", "left_anti").withColumn("tile", F.lit(0).cast("long")).withColumn("side", F.lit(2))
    before = F.sum("own").over(W.partitionBy("key").orderBy("n")) - F.col("own")
    sizes = sizes.join(heavy, "key").withColumn("before", before)
    at = F.col("before") + F.col("own") * (F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) / (1 << 20))
    large = members.join(sizes, ["key", "n"]).withColumn("slice", F.floor(at / most).cast("long")).select("key", "slice", "cls", "n", "label")
    spans = large.groupBy("key", "slice").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    a, b = spans.alias("a"), spans.alias("b")
    meet = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.slice") <= F.col("b.slice")) & (100 * F.col("a.high") >= percent * F.col("b.low")))
    meet = meet.select(F.col("a.key").alias("key"), F.col("a.slice").alias("x"), F.col("b.slice").alias("y"), (F.col("a.slice") * (1 << 31) + F.col("b.slice")).alias("tile"))
    ends = F.when(F.expr("x = y"), F.array(F.struct(F.col("x").alias("slice"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("x").alias("slice"), F.lit(0).alias("side")), F.struct(F.col("y").alias("slice"), F.lit(1).alias("side")))
    )
    large = large.join(meet.select("key", "tile", F.explode(ends).alias("e")).select("key", "tile", "e.slice", "e.side"), ["key", "slice"])
    return small.select(fields).union(large.select(fields))


class Tile:
    """The members of a tile, ordered by set size, and the pairs of different components that may link."""

    def __init__(self, table: pa.Table, count: int, rows: int, percent: int):
        self.cls, n, self.side, label = (table[c].to_numpy() for c in ("cls", "n", "side", "label"))
        self.size, self.rows, self.percent = n.astype(np.int64), rows, percent
        self.vec = _matrix(table["vec"].to_pylist(), count)
        self.band = int(table["key"][0].as_py()) >> BAND_SHIFT
        self.least = least_agreement(count, percent)
        _, self.component = np.unique(label, return_inverse=True)
        self.common = int(np.bincount(self.component).argmax())

    def askers(self) -> np.ndarray:
        """Members of the most common component meet only the others, so only those ask."""
        return np.flatnonzero(self.component != self.common)

    def partners(self, i: int) -> np.ndarray:
        """Members that may link with ``i``, those that agree most first."""
        size, component = self.size[i], self.component
        lo, hi = np.searchsorted(self.size, -(-self.percent * size // 100)), np.searchsorted(self.size, 100 * size // self.percent, side="right")
        near = np.arange(lo, hi)
        near = near[(component[near] != component[i]) & ((near > i) | (component[near] == self.common)) & ((self.side[near] != self.side[i]) | (self.side[i] == 2))]
        same = self.vec[near] == self.vec[i]
        agree = same.sum(axis=1)
        keep = agree >= self.least
        near, same, agree = near[keep], same[keep], agree[keep]
        keep = same.reshape(len(near), -1, self.rows).all(axis=2).argmax(axis=1) == self.band if len(near) else keep[:0]
        return near[keep][np.argsort(-agree[keep], kind="stable")]


def _each_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, tile), which come in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key, tile = batch.column("key").to_numpy(), batch.column("tile").to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1), len(key)]
        if held and (held[-1].column("key")[0].as_py() != key[0] or held[-1].column("tile")[0].as_py() != tile[0]):
            yield pa.Table.from_batches(held)
            held = []
        for s, e in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(s, e - s))
            if e < len(key):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


TILE = "key long, tile long, side int, cls long, n int, label long, vec binary"


def _with_partners(count: int, rows: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The members of tiles that may link with a member of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _each_tile(batches):
            tile = Tile(table, count, rows, percent)
            chosen = np.zeros(len(table), dtype=bool)
            for i in tile.askers():
                near = tile.partners(i)
                if len(near):
                    chosen[i] = chosen[near] = True
            if chosen.any():
                yield from table.filter(pa.array(chosen)).to_batches()

    return run


def _links(count: int, rows: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The links (a, b) that join components in a tile whose members come with their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _each_tile(batches):
            tile, sets = Tile(table, count, rows, percent), [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in table["shingles"]]
            root = list(range(int(tile.component.max()) + 1))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            links = []
            for i in tile.askers():
                for j in tile.partners(i).tolist():
                    x, y = find(int(tile.component[i])), find(int(tile.component[j]))
                    if x != y and _alike(sets[i], sets[j], percent):
                        root[x] = y
                        links.append((int(tile.cls[i]), int(tile.cls[j])))
            if links:
                a, b = zip(*links)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(docs: DataFrame, classes: DataFrame, vectors: DataFrame, name: ClassNames, k: int) -> DataFrame | None:
    """cls, shingles of ``classes`` (cls), from the texts of one document each; a written table, None if there are none."""
    spark = docs.sparkSession
    wanted = id_filter(vectors.join(classes, "cls", "left_semi").select("doc_id"))
    if wanted is None:
        return None
    asked = spark.sparkContext.broadcast(wanted)

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, done = asked.value, set()
        for batch in batches:
            at = _marks(batch.column(0).fill_null(_NO_ID).to_numpy(), len(bits))
            chosen = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for block in row_blocks(chosen, "text"):
                cls, sets = [], []
                for u in shingle_sets(block.column(1), k):
                    own = name(u)
                    if own is not None and own not in done:
                        done.add(own)
                        cls.append(own)
                        sets.append(u.tobytes())
                yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    sets = docs.mapInArrow(to_sets, "cls long, shingles binary").join(classes, "cls", "left_semi")
    return materialize(sets.dropDuplicates(["cls"]), "sets")


def near_dedup(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS, stars: int = 3, block_rows: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text); ``k`` is 5 words at most."""
    spark, count = docs.sparkSession, bands * rows
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = materialize(docs.mapInArrow(_facts(count, k), FACTS), "facts")
    clashes = facts.filter("cls is not null").groupBy("cls").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low < high")
    # about n^2 / 2^65 rows for n documents: two at 10^10
    name = ClassNames({r.cls: r.low for r in clashes.collect()})
    named = facts.select("doc_id", name.column("cls", "check").alias("cls"), "n", "vec")
    classes = named.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("vec", ignorenulls=True).alias("vec"))
    classes = materialize(classes, "classes")

    keys = classes.select("cls", "n", "vec").mapInArrow(_band_rows(count, bands), "key long, cls long, n int")
    members = materialize(_blocks_of(keys), "members")
    vectors = materialize(classes.join(members.select("cls").distinct(), "cls", "left_semi"), "vectors")
    drop(classes)

    pairs = materialize(_agreeing(_star_pairs(members, stars), vectors, count, percent), "stars")
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), vectors, name, k)
    links = pairs if sets is None else materialize(_verified(pairs, sets, percent).filter("linked").select("a", "b"), "tested")
    label = materialize(components(links), "labels")

    own = members.join(label, F.col("cls") == F.col("node"), "left").select("key", "cls", "n", F.coalesce("label", "cls").alias("label"))
    several = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    tiles = _slices(materialize(own.join(several, "key"), "open"), block_rows, percent).join(vectors.select("cls", "vec"), "cls")
    tiles = tiles.select(*(f.split()[0] for f in TILE.split(", "))).repartition(shuffle_partitions(spark), "key", "tile").sortWithinPartitions("key", "tile", "n", "cls")
    asked = materialize(tiles.mapInArrow(_with_partners(count, rows, percent), TILE), "asked")
    sets = _sets(docs, asked.select("cls").distinct(), vectors, name, k)
    if sets is not None:
        tiles = asked.join(sets, "cls").select(*asked.columns, "shingles").repartition(shuffle_partitions(spark), "key", "tile").sortWithinPartitions("key", "tile", "n", "cls")
        more = materialize(tiles.mapInArrow(_links(count, rows, percent), PAIR), "more")
        label = materialize(components(links.union(more)), "labels")

    of_label = named.select("doc_id", "n", "cls").join(label, F.col("cls") == F.col("node"), "left")
    of_label = of_label.select("doc_id", "n", F.coalesce("label", "cls").alias("label"))
    least = of_label.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = of_label.join(least, "label", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size, its component, and whether it is the one that stays."""
    return near_dedup(read_table(spark, sf_dir, "documents"))
