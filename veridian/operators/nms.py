"""Greedy suppression of overlapping boxes, tile by tile, in rounds.

A box stays unless a better box that stays overlaps it by more than the threshold.  Neither a slide nor a pile is ever in
one task as a whole, and overlaps are never listed:

1. Boxes are dealt to square tiles of ``tile_rows`` boxes at most.  A tile sees all that overlaps a box inside it, so it decides that
   box unless that hangs on a box across its border; a border box stays if no tile that it touches knows an
   undecided or staying better one, and goes if one of them knows a staying one.
2. What is left, a seam along the borders, is dealt again to tiles that are shifted by half and as large as the fewer boxes allow.
3. Where a grid cell holds more than ``crowd`` boxes (a pile), first the best of equal sides takes part, and the best box of
   every cell that is the best in all the cells it touches stays and takes with it what it covers, until no cell is crowded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridian.functions import geometry as G
from veridian.operators.spatial import grid_cells
from veridian.sources.stages import forget, written

SIDES = ("x1", "y1", "x2", "y2")


def greedy(boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the boxes, given best first, stay: a box goes if a kept one overlaps it by more than the threshold."""
    keep = np.zeros(len(boxes), dtype=bool)
    alive = np.ones(len(boxes), dtype=bool)
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    for i in range(len(boxes)):
        if not alive[i]:
            continue
        keep[i] = True
        w = np.minimum(boxes[i, 2], boxes[i + 1 :, 2]) - np.maximum(boxes[i, 0], boxes[i + 1 :, 0])
        h = np.minimum(boxes[i, 3], boxes[i + 1 :, 3]) - np.maximum(boxes[i, 1], boxes[i + 1 :, 1])
        both = np.maximum(w, 0) * np.maximum(h, 0)
        union = area[i] + area[i + 1 :] - both
        alive[i + 1 :] &= ~(both > threshold * union)
    return keep


def _covers(a: G.Box, b: G.Box, threshold: float) -> Column:
    """Whether two boxes overlap by more than ``threshold`` of their union."""
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return both > threshold * (area(a) + area(b) - both)


def _cell_size(boxes: DataFrame) -> int:
    """Twice the usual side of a box; a box of the largest side touches some 33 cells along it at most."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    usual, largest = boxes.agg(F.sqrt(F.avg(side * side)), F.max(side)).first()
    return max(1, int(np.ceil(max(2 * (usual or 0.0), (largest or 0.0) / 32))))


def _box(id_: str) -> G.Box:
    return tuple(F.col(f"{id_}.{c}") for c in SIDES)


def _thinned(touched: DataFrame, place: list[str], threshold: float, crowd: int, most_rounds: int) -> tuple[DataFrame, list[DataFrame]]:
    """``touched`` (a row for each cell of a box) without the boxes decided by crowded cells, and tables of those that went."""
    gone: list[DataFrame] = []
    for _ in range(most_rounds):
        cells = written(touched.groupBy(*place, "cell").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")), "cells")
        if cells.filter(F.col("rows") > crowd).isEmpty():
            forget(cells)
            break
        leads = cells.groupBy(*place, "id").agg(F.count(F.lit(1)).alias("led"))
        stay = written(touched.join(leads, [*place, "id"]).filter("led = cells").select(*touched.columns), "stay")
        lead = stay.select(*place, "cell", F.col("id").alias("lead"))
        lost = touched.join(lead, [*place, "cell"]).filter((F.col("id") != F.col("lead")) & _covers(_box("id"), _box("lead"), threshold)).select(*place, "id").distinct()
        lost = written(lost, "lost")
        gone.append(lost)
        rest = written(touched.join(lost.unionByName(stay.select(*place, "id").distinct()), [*place, "id"], "left_anti"), "touched")
        forget(touched, stay, cells)
        touched = rest
    return touched, gone


def decided(boxes: np.ndarray, border: np.ndarray, stays: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """What the boxes of a tile, given best first, allow to say: 1 stays, 2 goes, 0 open; and whether a better open or staying box is known.

    ``border`` boxes may meet others outside of the tile, so they never stay by this alone; those of ``stays`` are known to.  Boxes are
    compared with those in the buckets around them only.
    """
    state, blocked = np.where(stays, 1, 0).astype(np.int8), np.zeros(len(boxes), dtype=bool)
    low, side = boxes[:, :2].min(axis=0), (boxes[:, 2:] - boxes[:, :2]).max()
    bucket = np.floor((boxes[:, :2] - low) / max(side, float(np.ptp(boxes, axis=0).max()) / 2**20)).astype(np.int64) + 1
    wide = bucket[:, 1].max() + 2
    place = bucket[:, 0] * wide + bucket[:, 1]
    rank = np.argsort(place, kind="stable")
    place, (x1, y1, x2, y2) = place[rank], boxes[rank].T.copy()
    area = (x2 - x1) * (y2 - y1)
    middle = bucket[:, 0] * wide + bucket[:, 1]
    ranges = [(np.searchsorted(place, middle + d - 1), np.searchsorted(place, middle + d + 1, "right")) for d in (-wide, 0, wide)]
    for i in range(len(boxes)):
        if state[i] == 2:
            continue
        if not (border[i] or blocked[i]):
            state[i] = 1
        a, own = boxes[i], (boxes[i, 2] - boxes[i, 0]) * (boxes[i, 3] - boxes[i, 1])
        for start, end in ranges:
            s = slice(start[i], end[i])
            w = np.minimum(a[2], x2[s]) - np.maximum(a[0], x1[s])
            h = np.minimum(a[3], y2[s]) - np.maximum(a[1], y1[s])
            both = np.maximum(w, 0) * np.maximum(h, 0)
            worse = rank[s][both > threshold * (own + area[s] - both)]
            worse = worse[worse > i]
            if state[i] == 1:
                state[worse] = 2
            else:
                blocked[worse] = True
    return state, blocked


def _crowds(boxes: DataFrame, place: list[str], cell: int) -> list[tuple[int, int]]:
    """(k, the most boxes of a square of 2^k cells along a side) for growing k, up to that from which all of a place are together."""
    cells = boxes.select(*place, *(F.floor(F.col(f"id.{c}") / cell).alias(c) for c in ("x1", "y1"))).groupBy(*place, "x1", "y1").agg(F.count(F.lit(1)).alias("n"))
    squares = cells.withColumn("k", F.explode(F.array(*(F.lit(k) for k in (0, 1, 2, 3, 4, 5, 7, 9, 12)))))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("k")))
    counts = squares.groupBy("k", *place, at("x1").alias("x1"), at("y1").alias("y1")).agg(F.sum("n").alias("n"))
    return [(r.k, r.n) for r in counts.groupBy("k").agg(F.max("n").alias("n")).orderBy("k").collect()]


def _by_tiles(boxes: DataFrame, place: list[str], threshold: float, cell: int, tile_rows: int, crowds: list[tuple[int, int]] | None = None) -> list[DataFrame]:
    """Tables of (place, id, rows, kept) for the ``id`` of all boxes, ``rows`` being how many boxes are equal."""
    key = boxes.schema["id"].dataType["key"].dataType.simpleString()
    types = [f"{c} {boxes.schema[c].dataType.simpleString()}" for c in place]
    schema = ", ".join([*types, "order double", f"key {key}", *(f"{c} double" for c in SIDES), "rows bigint", "border boolean", "state int", "blocked boolean"])
    names = ["order", "key", *SIDES]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in names], null_placement="at_start"))
        same = np.ones(len(table), dtype=bool)
        same[:1] = False
        for c in names:
            x, y = table[c].combine_chunks()[1:], table[c].combine_chunks()[:-1]
            equal = pc.if_else(pc.or_(x.is_null(), y.is_null()), pc.equal(x.is_null(), y.is_null()), pc.equal(x, y))
            same[1:] &= equal.to_numpy(zero_copy_only=False).astype(bool)
        firsts = np.flatnonzero(~same)
        rows = np.add.reduceat(table["rows"].to_numpy(), firsts)
        table = table.take(pa.array(firsts))
        border, stays = (table[c].to_numpy().astype(bool) for c in ("border", "stays"))
        state, blocked = decided(np.stack([table[c].to_numpy() for c in SIDES], axis=1), border, stays, threshold)
        out = {c: table[c] for c in (*place, *names)} | {"rows": rows, "border": border, "state": state.astype(np.int32), "blocked": blocked}
        return pa.table(out).filter(pa.array(~stays))

    id_ = F.struct(*names).alias("id")
    done: list[DataFrame] = []
    left = boxes.select(*place, "id", F.lit(1).cast("long").alias("rows"), F.lit(False).alias("stays"))
    for turn in count():
        crowds = crowds or _crowds(left, place, cell)
        # the largest square within the limit; of those that hold as much the smallest
        fits = [(n, -k) for k, n in crowds if n <= tile_rows]
        size = cell * 2 ** -max(fits, default=(0, 0))[1]
        crowds = None
        shift = size / 2 * (turn % 2)
        tiles = grid_cells(tuple(c + shift for c in _box("id")), size)
        dealt = left.select(*place, "id.*", "rows", "stays", tiles.alias("_tiles")).withColumn("border", F.size("_tiles") > 1)
        dealt = dealt.select("*", F.explode("_tiles").alias("_tile")).drop("_tiles").select("*", F.col("_tile.i").alias("_i"), F.col("_tile.j").alias("_j")).drop("_tile")
        told = written(dealt.groupBy(*place, "_i", "_j").applyInArrow(run, schema).select(*place, id_, "rows", "border", "state", "blocked"), "tiles")
        # a border box is told by each of its tiles
        ends = told.filter("border").groupBy(*place, "id").agg(F.first("rows").alias("rows"), F.max("state").alias("state"), F.max("blocked").alias("blocked"))
        ends = written(ends.select(*place, "id", "rows", F.when((F.col("state") == 0) & ~F.col("blocked"), 1).otherwise(F.col("state")).alias("state")), "borders")
        inner = told.filter("not border").select(*place, "id", "rows", "state")
        done += [t.filter("state > 0").select(*place, "id", "rows", (F.col("state") == 1).alias("kept")) for t in (inner, ends)]
        left = inner.filter("state = 0").unionByName(ends.filter("state < 2")).select(*place, "id", "rows", (F.col("state") == 1).alias("stays"))
        if left.filter("not stays").isEmpty():
            return done


def suppress(boxes: DataFrame, group: Sequence[str], key: str, score: str, threshold: float, crowd: int = 8192, most_rounds: int = 16, tile_rows: int = 65536) -> DataFrame:
    """``kept`` for every box (key, sides, score) of a ``group`` (a slide); the order is score descending (null last), key, sides.

    Boxes with a missing side, or without an area, stay and suppress nothing.  Keys may repeat; rows that are
    equal in all of these are one box and share its outcome.
    """
    place = list(group)
    order = -F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    rows = boxes.select(*place, F.struct(order.alias("order"), F.col(key).alias("key"), *(F.col(c).cast("double").alias(c) for c in SIDES)).alias("id"))
    x1, y1, x2, y2 = _box("id")
    whole = reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in (x1, y1, x2, y2)]) & (x2 > x1) & (y2 > y1)
    whole = F.coalesce(whole, F.lit(False)) if threshold < 1 else F.lit(False)
    known = rows.filter(whole)
    size = _cell_size(known.select(*(c.alias(n) for c, n in zip((x1, y1, x2, y2), SIDES))))
    crowds = _crowds(known, place, size)
    if not any(k == 0 and n > crowd for k, n in crowds):
        parts = _by_tiles(known, place, threshold, size, tile_rows, crowds)
        out = reduce(DataFrame.unionByName, parts).select(*place, "id", "kept", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))).select(*place, "id", "kept")
    else:
        # of boxes with the same sides the best takes part
        best = known.groupBy(*place, *(c.alias(n) for c, n in zip((x1, y1, x2, y2), SIDES))).agg(F.min("id").alias("id"))
        best = written(best.select(*place, "id", *SIDES), "boxes")
        touched = best.select(*place, "id", grid_cells(G.box(), size).alias("_cells")).select(*place, "id", F.size("_cells").alias("cells"), F.explode("_cells").alias("cell"))
        touched, gone = _thinned(written(touched, "touched"), place, threshold, crowd, most_rounds)
        first = (F.col("cell.i") == F.floor(F.col("id.x1") / size)) & (F.col("cell.j") == F.floor(F.col("id.y1") / size))
        parts = _by_tiles(touched.filter(first), place, threshold, size, tile_rows)
        lost = reduce(DataFrame.unionByName, [*gone, *(t.filter("not kept").select(*place, "id") for t in parts)])
        stay = best.select(*place, "id").join(lost, [*place, "id"], "left_anti")
        out = known.join(stay.withColumn("kept", F.lit(True)), [*place, "id"], "left").select(*place, "id", F.coalesce("kept", F.lit(False)).alias("kept"))
    out = out.select(*place, "id", "kept").union(rows.filter(~whole).select(*place, "id", F.lit(True).alias("kept")))
    return out.select(*place, F.col("id.key").alias(key), *(F.col(f"id.{c}").alias(c) for c in SIDES), F.when(F.col("id.order") < float("inf"), -F.col("id.order")).alias(score), "kept")


def refined(boxes: DataFrame, group: Sequence[str], key: str, score: str, threshold: float, least: float) -> DataFrame:
    """The boxes that suppression leaves and whose score is at least ``least`` (F7): boxes below it still suppress others."""
    return suppress(boxes, group, key, score, threshold).filter(F.col("kept") & (F.col(score) >= least)).drop("kept")
