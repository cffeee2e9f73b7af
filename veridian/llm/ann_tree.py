"""Approximate nearest neighbours with a hierarchical k-means tree (operator 8).

The tree is fitted on a bounded sample (at most ``sample`` rows, those with the smallest hash of
``vec_id``), and every row goes down to one leaf.  Where a leaf then holds more than ``graft_rows`` rows, an
executor fits a tree of its own on a bounded sample of them, which takes the leaf's place, and the rows go
down again; so the tree grows with the table, to ``leaves_most`` squared leaves (a broadcast of 36 MB for 64
dimensions), and only beyond that its leaves grow.

A query traverses the tree best bin first: a priority queue holds nodes by distance to their centre, the
nearest is opened, until enough leaves are visited.  How many is calibrated: sampled queries are searched
by brute force in all rows, and the number of leaves is widened until the share of their true neighbours in
visited leaves reaches the target.  Visited leaves are searched completely, in double precision on the
original vectors.

Neighbouring leaves are searched together in buckets of about ``block_rows`` rows; a leaf that holds more is
dealt out in blocks, and so are the queries that visit a bucket if they are many.  Each gives its k nearest
for each query, and these are merged, so one leaf may hold any share of all rows and one bucket may be
visited by all queries.

Defined cases: vectors that are null, empty, all zero or hold null or non-finite components, or
are not of the common length, take no part, as query or candidate; ties go to the smaller ``vec_id``;
repeated ``vec_id`` rows are candidates of their own, but never of a query with that id; query rows that repeat
id and vector are one query, those that repeat the id alone are ranked apart; with fewer than k
candidates all are returned; an empty table gives no row; columns of other names are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.llm._shared import materialize, read_table, shuffle_partitions


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)).argmin(axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = np.unique(x[rng.choice(len(x), size=min(k, len(x)), replace=False)], axis=0)
    for _ in range(rounds):
        own = _nearest(x, centers)
        n = np.bincount(own, minlength=len(centers))
        new = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centers)) for j in range(x.shape[1])], axis=1)[n > 0] / n[n > 0][:, None]
        if new.shape == centers.shape and np.allclose(new, centers):
            break
        centers = new
    return centers


class KMeansTree:
    """Nodes in flat arrays: centre, children (first, count) or leaf number."""

    def __init__(self, x: np.ndarray, branching: int, leaf_rows: float, seed: int = 5):
        self.centers, self.children, self.leaf = [x.mean(axis=0)], [()], [-1]
        self.n_leaves = 0
        rng = np.random.default_rng(seed)
        todo = [(0, x)]
        while todo:
            node, own = todo.pop()
            centers = _k_means(own, branching, rng) if len(own) > leaf_rows else own[:0]
            if len(centers) < 2:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
                continue
            at = _nearest(own, centers)
            self.children[node] = tuple(range(len(self.centers), len(self.centers) + len(centers)))
            for i, c in enumerate(centers):
                todo.append((len(self.centers), own[at == i]))
                self.centers.append(c)
                self.children.append(())
                self.leaf.append(-1)
        self.centers = np.array(self.centers)

    def graft(self, trees: dict[int, "KMeansTree"]) -> None:
        """Puts trees in the place of leaves (numbered as :meth:`leaves_of` does) and numbers all leaves anew."""
        centers, children, leaf = [self.centers], list(self.children), list(self.leaf)
        for node in [i for i, number in enumerate(self.leaf) if number in trees]:
            own = trees[self.leaf[node]]
            first = len(children) - 1  # the root of the other tree takes this node
            children[node] = tuple(first + kid for kid in own.children[0])
            children += [tuple(first + kid for kid in kids) for kids in own.children[1:]]
            leaf[node] = own.leaf[0]
            leaf += own.leaf[1:]
            centers.append(own.centers[1:])
        self.centers, self.children = np.concatenate(centers), children
        self.leaf, n = [], 0
        for number in leaf:
            self.leaf.append(n if number >= 0 else -1)
            n += number >= 0
        self.n_leaves = n

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre at every level."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
                continue
            kids = self.children[node]
            at = _nearest(x[rows], self.centers[list(kids)])
            todo += [(kid, rows[at == i]) for i, kid in enumerate(kids)]
        return out

    def best_bins(self, q: np.ndarray) -> Iterator[int]:
        """Leaves for a query, nearest node first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
                continue
            kids = list(self.children[node])
            d = ((self.centers[kids] - q) ** 2).sum(axis=1)
            for distance, kid in zip(d.tolist(), kids):
                heapq.heappush(queue, (distance, kid))


def top_k(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows, ties to the smaller id: positions and distances (double precision)."""
    d = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    if len(d) > 4 * k:
        edge = np.partition(d, k - 1)[k - 1]
        near = np.flatnonzero(d <= edge)
        order = near[np.lexsort((ids[near], d[near]))][:k]
    else:
        order = np.lexsort((ids, d))[:k]
    return order, d[order]


def calibrate(tree: KMeansTree, queries: np.ndarray, leaves: list[list[int]], target: float) -> int:
    """Leaves to visit so that a share ``target`` of the true neighbours (their leaves, for each query) lies in them."""
    positions = []
    for q, own in zip(queries, leaves):
        rank = {b: n for n, b in enumerate(tree.best_bins(q))}
        positions += [rank[b] for b in own]
    return int(np.quantile(positions, target, method="higher")) + 1 if positions else tree.n_leaves


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def true_leaves(indexed: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> list[list[int]]:
    """The leaves of the k nearest rows of each query, by brute force in all of ``indexed``.  Bounded by the queries."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            vec_id, x, leaf = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
            for i, q in enumerate(queries if len(x) else ()):
                keep = np.flatnonzero(vec_id != ids[i])
                at, d = top_k(q, vec_id[keep], x[keep], k)
                best[i] = sorted([*best[i], *zip(d.tolist(), vec_id[keep][at].tolist(), leaf[keep][at].tolist())])[:k]
        rows = [(i, *r) for i, own in enumerate(best) for r in own]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.float64(), pa.int64(), pa.int32()))], names=["q", "d", "vec_id", "leaf"])

    found = indexed.select("vec_id", "embedding", "leaf").mapInArrow(nearest, "q int, d double, vec_id long, leaf int")
    rank = F.row_number().over(W.partitionBy("q").orderBy("d", "vec_id"))
    out: list[list[int]] = [[] for _ in queries]
    for r in found.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "leaf").collect():
        out[r.q].append(r.leaf)
    return out


FOUND = "query_id long, query_key long, vec_id long, score double"


def nearest_neighbours(rows: DataFrame, is_query, k: int = 10, sample: int = 20_000, branching: int = 16, leaves_most: int = 256, target: float = 0.97, block_rows: int = 4096, graft_rows: int = 16_384, tuning: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``rows`` (vec_id, embedding) that ``is_query`` holds for."""
    spark = rows.sparkSession
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("embedding") == lengths.d)
    # about 1.5 times the sample comes from all tasks together, not a sample from each
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, 1.5 * sample / lengths["count"]))
    picked = rows.filter(share).orderBy(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)), "vec_id").limit(sample).toPandas()
    x = np.stack(picked["embedding"].to_numpy())
    # a leaf keeps a few rows of the sample at least, so small tables have few leaves
    tree = KMeansTree(x, branching, max(16, len(x) / leaves_most))

    def assigned(table: DataFrame) -> DataFrame:
        model = spark.sparkContext.broadcast(tree)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    leaf = model.value.leaves_of(_matrix(batch.column(1)))
                    yield pa.record_batch([batch.column(0), batch.column(1), pa.array(leaf, pa.int32())], names=["vec_id", "embedding", "leaf"])

        return materialize(table.select("vec_id", "embedding").mapInArrow(assign, "vec_id long, embedding array<double>, leaf int"), "ann-index")

    def leaf_rows(table: DataFrame) -> dict[int, int]:
        """Rows of each leaf: bounded by the tree."""
        return {r.leaf: r.n for r in table.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}

    indexed = assigned(rows)
    held = leaf_rows(indexed)
    large = {leaf: n for leaf, n in held.items() if n > graft_rows}
    if large:
        parts = {leaf: min(leaves_most, -(-n // block_rows)) for leaf, n in large.items()}

        def fit(table: pa.Table) -> pa.Table:
            leaf = table["leaf"][0].as_py()
            own = _matrix(table["embedding"].combine_chunks())
            return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps(KMeansTree(own, branching, max(4, len(own) / parts[leaf])))], pa.binary())})

        # 32 rows of the leaf for each leaf of its tree, by another hash than the sample
        limits = spark.createDataFrame([(leaf, min(1.0, 32 * parts[leaf] / n)) for leaf, n in large.items()], "leaf int, share double")
        drawn = indexed.join(F.broadcast(limits), "leaf").filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) <= F.col("share") * (1 << 30))
        grown = {r.leaf: pickle.loads(r.tree) for r in drawn.select("leaf", "embedding").groupBy("leaf").applyInArrow(fit, "leaf int, tree binary").collect()}
        tree.graft({leaf: own for leaf, own in grown.items() if own.n_leaves > 1})
        indexed = assigned(indexed)
        held = leaf_rows(indexed)
    every = max(1, len(x) // tuning)
    visits = calibrate(tree, x[::every], true_leaves(indexed, x[::every], picked["vec_id"].to_numpy()[::every], k), target)
    model = spark.sparkContext.broadcast(tree)
    # neighbouring leaves share a bucket of about block_rows rows; a larger leaf has one of its own, in blocks
    bucket_of, blocks, room = {}, [], 0
    for leaf in sorted(held):
        n = held[leaf]
        if n > room or not blocks:
            blocks.append(max(1, -(-n // block_rows)))
            room = block_rows
        room = 0 if n > block_rows else room - n
        bucket_of[leaf] = len(blocks) - 1
    block_of = spark.createDataFrame([(leaf, b, blocks[b]) for leaf, b in bucket_of.items()], "leaf int, bucket int, blocks int")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, bucket, leaves = [], [], []
            for i, q in enumerate(_matrix(batch.column(1)) if batch.num_rows else ()):
                seen, rows_seen, mine = 0, 0, {}
                for b in model.value.best_bins(q):
                    if seen >= visits and rows_seen >= 4 * k:
                        break
                    seen, rows_seen = seen + 1, rows_seen + held.get(b, 0)
                    if b in bucket_of:
                        mine.setdefault(bucket_of[b], []).append(b)
                for name, own in mine.items():
                    at.append(i)
                    bucket.append(name)
                    leaves.append(own)
            chosen = pa.array(at, pa.int64())
            yield pa.record_batch(
                [batch.column(0).take(chosen), batch.column(2).take(chosen), batch.column(1).take(chosen), pa.array(bucket, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))],
                names=["query_id", "query_key", "query", "bucket", "leaves"],
            )

    n = shuffle_partitions(spark)
    queries = indexed.filter(is_query(F.col("vec_id"))).select("vec_id", "embedding", F.xxhash64("embedding").alias("query_key")).distinct().repartition(n)
    visited = materialize(queries.mapInArrow(visit, "query_id long, query_key long, query array<double>, bucket int, leaves array<int>"), "ann-visits")
    # one row for each bucket: bounded by the tree
    asked = {r.bucket: -(-r.n // block_rows) for r in visited.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    deal = spark.createDataFrame([(b, blocks[b], asked[b]) for b in sorted(asked)], "bucket int, blocks int, parts int")
    each = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    visited = visited.join(F.broadcast(deal), "bucket").withColumn("part", F.pmod(F.xxhash64("query_id", "query_key"), F.col("parts")).cast("int")).withColumn("block", each("blocks"))
    members = indexed.join(F.broadcast(block_of), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    members = members.join(F.broadcast(deal.select("bucket", "parts")), "bucket").withColumn("part", each("parts"))
    key = ["bucket", "block", "part"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors = left["vec_id"].to_numpy(), _matrix(left["embedding"].combine_chunks())
        leaf = left["leaf"].to_numpy()
        out = [], [], [], []
        names, keys, asked = right["query_id"].to_pylist(), right["query_key"].to_pylist(), _matrix(right["query"].combine_chunks())
        for name, query_key, own, q in zip(names, keys, right["leaves"].to_pylist(), asked) if len(ids) else ():
            keep = np.flatnonzero(np.isin(leaf, own) & (ids != name))
            at, d = top_k(q, ids[keep], vectors[keep], k)
            for column, values in zip(out, (np.full(len(at), name), np.full(len(at), query_key), ids[keep][at], d)):
                column.append(values)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table({c: np.concatenate(v or [np.zeros(0)]).astype(t) for c, v, t in zip(("query_id", "query_key", "vec_id", "score"), out, kinds)})

    found = members.select(*key, "leaf", "vec_id", "embedding").groupBy(*key).cogroup(visited.select(*key, "query_id", "query_key", "query", "leaves").groupBy(*key)).applyInArrow(search, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every vector whose id is divisible by 100."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda v: v % 100 == 0)
