"""Conversation prefix trie (operator 11), built level by level.

A node of depth d stands for one distinct sequence of d first turns; its name is (d, smallest conversation
that starts with it).  Turns are known by a SHA-256 of role and text, so texts are read once and never shuffled.

1. Turns get their place in the conversation from ranges of (conversation, turn): a range is ordered by its
   own task, and what a conversation has in earlier ranges is added.  No task holds a conversation whole.
2. Equal conversations become one class with a weight, known by its length and 128 bits over (place, turn).
3. Level by level, from the root: the live classes are grouped by (parent node, next turn); the smallest
   conversation names the new node.  A class that is alone in its node leaves the loop, for all its deeper
   nodes form a chain without branches; so the loop has as many levels as two *different* conversations share
   turns, and every level is a table of its own.
4. In reverse, level by level: leaves, children and savings are summed by parent and joined to the level above.
   Chains get theirs from sums from the end of the conversation, in segments.
5. Members that end at a node are hashed as a stream in numeric order: ranges are joined to pieces of text
   first, and the pieces of a class pass through one task, which holds one piece.

Defined cases: turns are ordered by ``turn`` (null first), ties by the digest of (role, text), equal rows are
turns of their own; null role or text is empty; rows without ``conv_id`` belong to no conversation and are
left out; columns of other names are ignored; very long texts are only digested; an empty table (or one without
``conv_id``) gives no row, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.llm._shared import drop, materialize, read_table, shuffle_partitions

SEGMENT = 4096
PIECE = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_key(role: str, text: str):
    """The digest that stands for a turn."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), F.col(role), F.col(text)).cast("binary"), 256))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key, chars of the turns of ``conversations`` (conv_id, turn, role, text); a written table."""
    spark = conversations.sparkSession
    filled = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = filled.select("conv_id", "turn", turn_key("role", "text").alias("key"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("row")]
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    # ids grow with the range and, inside it, with the row
    ranged = materialize(ranged.select("conv_id", "key", "chars", F.monotonically_increasing_id().alias("id")), "ranged")
    ranged = ranged.withColumn("range", F.shiftright("id", 33))
    heads = ranged.groupBy("conv_id", "range").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(W.partitionBy("conv_id").orderBy("range")) - F.col("rows")
    heads = heads.select("conv_id", "range", (before - F.col("first") + 1).alias("shift"))
    out = materialize(ranged.join(heads, ["conv_id", "range"]).select("conv_id", (F.col("id") + F.col("shift")).alias("pos"), "key", "chars"), "turns")
    drop(ranged)
    return out


def with_shared_openings(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are replaced by those of the conversation c - c % ``every``, h = crc32(c) % ``most``.

    Takes :func:`ordered_turns`; returns (conv_id, pos, key, chars) and (conv_id, len) of all conversations, turnless ones too.
    """
    c = F.col("conv_id")
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    plan = lengths.select("conv_id", "own", (c - c % every).alias("source"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h"))
    plan = plan.join(lengths.select(c.alias("source"), F.col("own").alias("there")), "source", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("len", F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = materialize(plan.select("conv_id", "source", "h", "m", "len"), "openings")
    opening = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "source").join(plan, "source").filter("pos <= h").select("conv_id", "pos", "key", "chars")
    rest = turns.join(plan.select("conv_id", "h", "m"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "key", "chars")
    return opening.union(rest), plan.select("conv_id", "len")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, first, text) of rows (rep, conv_id) in order: decimal ids joined by commas, about PIECE bytes each."""
    rep, first, held, size = None, None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.record_batch([pa.array([rep], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["rep", "first", "text"])

    for batch in batches:
        for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (r != rep or size >= PIECE):
                yield piece()
                held, size = [], 0
            if not held:
                rep, first = r, c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, ends_sha256) of pieces (rep, first, text) in order, one piece at a time."""
    rep, state = None, None

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["rep", "ends_sha256"])

    for batch in batches:
        for r, text in zip(batch.column(0).to_pylist(), batch.column(2)):
            if state is not None and r == rep:
                state.update(b",")
            else:
                if state is not None:
                    yield done()
                rep, state = r, hashlib.sha256()
            state.update(text.as_py().encode())
    if state is not None:
        yield done()


def member_digests(members: DataFrame) -> DataFrame:
    """rep, ends_sha256 of ``members`` (rep, conv_id): the SHA-256 of the class's decimal ids, ascending, comma-joined."""
    n = shuffle_partitions(members.sparkSession)
    pieces = members.select("rep", "conv_id").repartitionByRange(n, "rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(_pieces, "rep long, first long, text string")
    return pieces.repartition(n, "rep").sortWithinPartitions("rep", "first").mapInArrow(_digests, "rep long, ends_sha256 string")


def _from_end(rows: DataFrame) -> DataFrame:
    """``rows`` (rep, pos, chars, ...) with ``to_end``: characters from this place to the last, summed in segments."""
    rows = rows.withColumn("segment", F.floor(F.col("pos") / SEGMENT))
    own = F.sum("chars").over(W.partitionBy("rep", "segment").orderBy(F.col("pos").desc()))
    whole = rows.groupBy("rep", "segment").agg(F.sum("chars").alias("all"))
    later = whole.withColumn("later", F.sum("all").over(W.partitionBy("rep").orderBy(F.col("segment").desc())) - F.col("all")).drop("all")
    return rows.withColumn("own", own).join(later, ["rep", "segment"]).withColumn("to_end", F.col("own") + F.col("later")).drop("segment", "own", "later")


def _levels(rows: DataFrame, classes: DataFrame, root: dict) -> list[DataFrame]:
    """The nodes of each level from 1 on, as tables: node, parent, n_convs, classes, ends (the class that ends here), chars."""
    live, levels = classes.select("rep", "w", "len", F.lit(root["node"]).cast("long").alias("node")), []
    while True:
        depth = len(levels) + 1
        step = rows.filter(F.col("pos") == depth).join(live.withColumnRenamed("node", "parent"), F.col("conv_id") == F.col("rep"))
        step = materialize(step.select("rep", "w", "len", "parent", "key", "chars"), "step")
        nodes = step.groupBy("parent", "key").agg(
            F.min("rep").alias("node"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("classes"),
            F.max(F.when(F.col("len") == depth, F.col("rep"))).alias("ends"), F.max("chars").alias("chars"),
        )
        nodes = materialize(nodes, "level")
        levels.append(nodes)
        shared = nodes.filter("classes > 1")
        if shared.isEmpty():
            drop(step)
            return levels
        live = materialize(step.join(shared.select("parent", "key", "node"), ["parent", "key"]).select("rep", "w", "len", "node"), "live")
        drop(step)


def prefix_trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes (COLUMNS) of ``conversations`` (conv_id, len) whose turns are ``rows`` (conv_id, pos from 1, key, chars).

    ``saved_tokens`` counts characters.  Turn ``depth`` of conversation ``conv_id`` is the last turn of a node (:func:`with_last_turn`).
    """
    spark = rows.sparkSession
    # a level reads the ranges of its own place
    rows = materialize(rows.repartitionByRange(shuffle_partitions(spark), "pos", "conv_id"), "rebuilt")
    sums = [F.bit_xor(F.xxhash64("pos", "key", F.lit(i))).alias(x) for i, x in enumerate(("x", "y"))]
    known = conversations.join(rows.groupBy("conv_id").agg(*sums), "conv_id", "left").select("conv_id", "len", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("x", "y")))
    known = materialize(known, "known")
    classes = materialize(known.groupBy("len", "x", "y").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("w")), "classes")
    root = classes.agg(F.min("rep").alias("node"), F.sum("w").alias("n_convs"), F.count(F.lit(1)).alias("classes"), F.max(F.when(F.col("len") == 0, F.col("rep"))).alias("ends")).first().asDict()
    if not root["classes"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    top = spark.createDataFrame([(root["node"], None, root["n_convs"], root["classes"], root["ends"], 0)], "node long, parent long, n_convs long, classes long, ends long, chars long")
    levels = [top] + (_levels(rows, classes, root) if root["classes"] > 1 else [])

    # chains: classes that are alone from a node on
    alone = reduce(DataFrame.union, [level.filter("classes = 1").select(F.col("node").alias("rep"), F.lit(d).cast("long").alias("from"), F.col("parent").alias("above")) for d, level in enumerate(levels)])
    alone = alone.join(classes.select("rep", "w", "len"), "rep")
    chain = rows.withColumnRenamed("conv_id", "rep").join(alone, "rep").filter("pos >= from").select("rep", "pos", "chars", "from", "above", "w", "len")
    single = chain.filter("w = 1").withColumn("to_end", F.lit(0).cast("long"))
    chain = single.unionByName(_from_end(chain.filter("w > 1")))
    if root["classes"] == 1:
        total = chain.filter("pos = 1").select("rep", "to_end")
        first = alone.join(total, "rep", "left").select("rep", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("chars"), "from", "above", "w", "len", F.coalesce("to_end", F.lit(0)).alias("to_end"))
        chain = chain.select(first.columns).union(first)
    below = F.when(F.col("pos") == F.col("from"), F.col("above")).otherwise(F.col("rep"))
    chains = chain.select(
        F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), below.alias("parent_conv_id"), F.col("w").alias("n_convs"), F.when(F.col("pos") < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("w") - 1) * F.col("to_end")).alias("saved_tokens"), F.when(F.col("pos") == F.col("len"), F.col("rep")).alias("ends"), (F.col("pos") == F.col("from")).alias("head"),
    )
    chains = materialize(chains, "chains")

    # from the deepest level up: leaves and savings of the nodes that several classes share
    rolled, out = chains.filter("head"), [chains.drop("head")]
    for depth in range(len(levels) - 1, -1, -1):
        children = rolled.filter(F.col("depth") == depth + 1).groupBy(F.col("parent_conv_id").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        shared = levels[depth].filter("classes > 1").join(children, "node").select(
            F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            ((F.col("n_convs") - 1) * F.col("chars") + F.col("below")).alias("saved_tokens"), "ends",
        )
        shared = materialize(shared, "rolled")
        out.append(shared)
        rolled = chains.filter("head").drop("head").unionByName(shared)
    nodes = reduce(DataFrame.unionByName, out)

    several = classes.filter("w > 1").select("len", "x", "y", "rep")
    digests = member_digests(known.join(several, ["len", "x", "y"]).select("rep", "conv_id"))
    digests = materialize(digests.union(classes.filter("w = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256))), "digests")
    open_, ended = nodes.filter("ends is null").withColumn("ends_sha256", F.lit(NO_ENDS)), nodes.filter("ends is not null").join(digests, F.col("ends") == F.col("rep"))
    return open_.select(*COLUMNS).union(ended.select(*COLUMNS))


def with_last_turn(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the columns that ``turns`` (conv_id, pos, ...) has for each node's last turn (null for the root)."""
    return nodes.join(turns.withColumnRenamed("pos", "depth"), ["conv_id", "depth"], "left")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, rebuilt with shared openings."""
    return prefix_trie(*with_shared_openings(ordered_turns(read_table(spark, sf_dir, "conversations"))))


def op11_sql() -> str:
    """The same nodes by lists of turns and their prefixes."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),"
        " lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
    )
    return f"""
WITH filled AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), keyed AS (
  SELECT c, turn, sha256(length(role)::VARCHAR || ':' || role || text) AS key, length(text) AS chars FROM filled
), own AS (
  SELECT c, list(key ORDER BY turn NULLS FIRST, key) AS keys, list(chars ORDER BY turn NULLS FIRST, key) AS sizes FROM keyed GROUP BY c
), planned AS (
  SELECT c, keys, sizes, c - c % 100 AS source, ({crc} % 6)::BIGINT AS h FROM own
), rebuilt AS (
  SELECT p.c, coalesce(s.keys, [])[1:p.h] || p.keys[p.h + 1:] AS keys, coalesce(s.sizes, [])[1:p.h] || p.sizes[p.h + 1:] AS sizes
  FROM planned p LEFT JOIN own s ON s.c = p.source
), prefixes AS (
  SELECT c, len(keys) AS n, unnest(range(0, len(keys) + 1)) AS d, keys, sizes FROM rebuilt
), node AS (
  SELECT d, array_to_string(keys[1:d], '/') AS path, CASE WHEN d > 0 THEN array_to_string(keys[1:d - 1], '/') END AS above, min(c) AS conv_id, count(*) AS n_convs,
         max(CASE WHEN d = 0 THEN 0 ELSE sizes[d] END) AS chars, max(keys[1:d]) AS keys,
         sha256(coalesce(string_agg(CASE WHEN n = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL
), children AS (
  SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), known AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM node n LEFT JOIN children k ON n.d = k.d AND n.path = k.path
), up AS (
  SELECT unnest(range(0, d + 1)) AS d, d AS low, keys, n_convs, chars, n_children FROM known
), summed AS (
  SELECT d, array_to_string(keys[1:d], '/') AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM up GROUP BY ALL
)
SELECT k.conv_id, k.d::BIGINT AS depth, CASE WHEN k.d > 0 THEN p.conv_id END AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN summed s ON k.d = s.d AND k.path = s.path LEFT JOIN known p ON p.d = k.d - 1 AND p.path = k.above
"""
