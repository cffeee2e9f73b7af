"""Boxes, regions and filters over detections.

Joins between boxes and regions always have the slide as an equality, and a grid cell beside it,
so they stay hash joins and a crowded slide is spread over its cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridian.functions import geometry as G
from veridian.operators import pixels as P
from veridian.sources.stages import written


def grid_cells(box: G.Box, cell: int) -> Column:
    """All grid cells that a box touches."""
    axis = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    return F.flatten(F.transform(axis(box[0], box[2]), lambda i: F.transform(axis(box[1], box[3]), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def region_hits(boxes: DataFrame, regions: DataFrame, key: str, region: str, slide: str = "slide", margin: float = 0.0, cell: int = 2048) -> DataFrame:
    """All (box, region) pairs on one slide that intersect, each once.

    A pair is reported in the first cell that both touch, so no distinct is needed.
    """
    b = G.box()
    a = boxes.select(key, slide, *[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.explode(grid_cells(b, cell)).alias("cell"))
    r = regions.select(slide, region, *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    rb = G.box("r_")
    wide = (rb[0] - margin, rb[1] - margin, rb[2] + margin, rb[3] + margin)
    r = r.withColumn("cell", F.explode(grid_cells(wide, cell)))
    first = (F.col("cell.i") == F.floor(F.greatest(b[0], wide[0]) / cell)) & (F.col("cell.j") == F.floor(F.greatest(b[1], wide[1]) / cell))
    return a.join(r, [slide, "cell"]).filter(G.intersects(b, rb, margin) & first).drop("cell")


def _pruning_cell(boxes: DataFrame, regions: DataFrame, margin: float) -> tuple[float, bool]:
    """A power of two (so cells have exact borders) near a quarter of a region's usual side, and whether any box has swapped ends.

    No region touches more than some 65 cells along a side, and no box more than 17.
    """
    ends = [F.max(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), F.max((F.col("x2") < F.col("x1")) | (F.col("y2") < F.col("y1")))]
    side = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))) + 2 * margin
    widest, swapped = boxes.agg(*ends).first()
    usual, largest = regions.agg(F.sqrt(F.avg(side * side)), F.max(side)).first()
    least = max(float(usual or 0) / 4, float(largest or 0) / 64, float(widest or 0) / 16)
    return (2.0 ** math.ceil(math.log2(least) - 0.5) if 0 < least < math.inf else 1.0), bool(swapped)


def least_hits(boxes: DataFrame, regions: DataFrame, key: str, region: str, slide: str = "slide", margin: float = 0.0) -> DataFrame:
    """Of the (box, region) pairs on one slide that intersect, for each box those with its smallest region and few others.

    A region that covers a whole cell meets every box that touches the cell, so a cell needs its smallest covering region, and of those
    that cut it only smaller ones.  That is a few regions for each cell, however many there are.
    """
    cell, swapped = _pruning_cell(boxes, regions, margin)
    b, sides = G.box(), ("x1", "y1", "x2", "y2")
    wide = (F.col("x1") - margin, F.col("y1") - margin, F.col("x2") + margin, F.col("y2") + margin)
    i, j = F.col("cell.i") * cell, F.col("cell.j") * cell
    covers = (wide[0] <= i) & (wide[1] <= j) & (wide[2] >= i + cell) & (wide[3] >= j + cell)
    r = regions.select(slide, F.col(region).alias(region), *sides, F.explode(grid_cells(wide, cell)).alias("cell")).withColumn("_covers", covers)
    best = r.filter("_covers").groupBy(slide, "cell").agg(F.min(region).alias("_least"), F.lit(True).alias("_covered"))
    cut = r.filter("not _covers").join(best, [slide, "cell"], "left").filter(F.col("_covered").isNull() | (F.coalesce(F.col(region) < F.col("_least"), F.col(region).isNotNull() & F.col("_least").isNull())))
    bounds = [F.col(c).alias(f"r_{c}") for c in sides]
    index = cut.select(slide, "cell", region, *bounds).unionByName(best.select(slide, "cell", F.col("_least").alias(region)), allowMissingColumns=True)
    index = written(index, "region_cells")

    plain = boxes.filter((F.col("x2") >= F.col("x1")) & (F.col("y2") >= F.col("y1"))).select(key, slide, *sides, F.explode(grid_cells(b, cell)).alias("cell"))
    hits = plain.join(index, [slide, "cell"]).filter(F.col("r_x1").isNull() | G.intersects(b, G.box("r_"), margin)).select(key, slide, *sides, region)
    if swapped:
        odd = boxes.filter((F.col("x2") < F.col("x1")) | (F.col("y2") < F.col("y1")))
        hits = hits.unionByName(region_hits(odd, regions, key, region, slide, margin).select(key, slide, *sides, region))
    return hits


def points_below(x: np.ndarray, y: np.ndarray, at: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each query, how many of the ``at`` points with the smallest x are among the ``below`` with the smallest y.

    Bit by bit of the ranks of y, each level dealt into zeros and ones in order (a wavelet matrix): n log n for the
    points, log n for a query, whatever the counts are.
    """
    n = len(x)
    rank = np.empty(n, np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(n)
    rank = rank[np.argsort(x, kind="stable")]
    low, high, found = np.zeros_like(at), at.copy(), np.zeros(len(at), np.int64)
    for bit in range(n.bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.append(0, np.cumsum(~one))
        a, b = zeros[low], zeros[high]
        right = (below >> bit & 1).astype(bool)
        found += np.where(right, b - a, 0)
        low, high = np.where(right, zeros[-1] + low - a, a), np.where(right, zeros[-1] + high - b, b)
        rank = np.concatenate([rank[~one], rank[one]])
    return found


def boxes_met(boxes: Sequence[np.ndarray], regions: Sequence[np.ndarray]) -> np.ndarray:
    """How many boxes (x1, y1, x2, y2) each region meets, touching included; all ends in order.

    A box that ends left of a region also begins left of its right end, so along an axis those that meet are those
    that begin by its end less those that end before its start; both axes together are four counts of corners.
    """
    x1, y1, x2, y2 = boxes
    rank = lambda v, q, side: np.searchsorted(np.sort(v), q, side=side).astype(np.int64)
    begun, ended = (rank(x1, regions[2], "right"), rank(x2, regions[0], "left")), (rank(y1, regions[3], "right"), rank(y2, regions[1], "left"))
    count = lambda i, j: points_below((x1, x2)[i], (y1, y2)[j], begun[i], ended[j])
    return count(0, 0) - count(0, 1) - count(1, 0) + count(1, 1)


def region_counts(boxes: DataFrame, regions: DataFrame, key: str, region: str, slide: str = "slide", piece: int = 1 << 17) -> DataFrame:
    """``slide``, ``region``, ``n``: how many boxes each region meets on its slide, where it meets any; pairs are not listed.

    The boxes of a slide are dealt by a hash of key and bounds to pieces of about ``piece``, its regions likewise; each piece of boxes
    is counted for each piece of regions in one task.  Boxes and regions with swapped ends are few or none and meet as pairs.
    """
    sides = ("x1", "y1", "x2", "y2")
    whole = F.col(slide).isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    ordered = (F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2"))
    own = boxes.select(slide).schema[0].dataType
    common = boxes.select(slide).union(regions.select(slide)).schema[0].dataType
    b = boxes.filter(whole).select(F.col(slide).cast(common).alias(slide), F.col(key).alias("_key"), *sides)
    r = regions.filter(whole).select(F.col(slide).cast(common).alias(slide), F.col(region).alias("_region"), *sides)

    pieces = [t.filter(ordered).groupBy(slide).agg(F.ceil(F.count(F.lit(1)) / piece).alias(n)) for t, n in ((b, "_i"), (r, "_j"))]
    pieces = pieces[0].join(pieces[1], slide)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c, *sides), F.col(n))
    left = b.filter(ordered).join(pieces, slide).select(slide, one("_key", "_i").alias("i"), every("_j").alias("j"), *sides)
    right = r.filter(ordered).join(pieces, slide).select(slide, every("_i").alias("i"), one("_region", "_j").alias("j"), "_region", *sides)
    schema = T.StructType([right.schema[slide], right.schema["_region"], T.StructField("n", T.LongType())])

    def met(boxes: pa.Table, regions: pa.Table) -> pa.Table:
        if not (len(boxes) and len(regions)):
            return pa.table({slide: regions[slide][:0], "_region": regions["_region"][:0], "n": pa.array([], pa.int64())})
        n = boxes_met(*([t[c].to_numpy() for c in sides] for t in (boxes, regions)))
        return pa.table({slide: regions[slide], "_region": regions["_region"], "n": pa.array(n)}).filter(pa.array(n > 0))

    counted = left.groupBy(slide, "i", "j").cogroup(right.groupBy(slide, "i", "j")).applyInArrow(met, schema)
    for some, others in ((b.filter(~ordered), r), (b.filter(ordered), r.filter(~ordered))):
        if not (some.isEmpty() or others.isEmpty()):
            listed = region_hits(some, others, "_key", "_region", slide).groupBy(slide, "_region").agg(F.count(F.lit(1)).alias("n"))
            counted = counted.unionByName(listed)
    return counted.groupBy(F.col(slide).cast(own).alias(slide), F.col("_region").alias(region)).agg(F.sum("n").alias("n"))


def exclude_regions(boxes: DataFrame, regions: DataFrame, key: str, slide: str = "slide", margin: float = 0.0) -> DataFrame:
    """Boxes that meet no region of their slide; boxes without a key or bounds go."""
    known = boxes.filter(F.col(key).isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull())
    hit = least_hits(known, regions.withColumn("_region", F.lit(1)), key, "_region", slide, margin)
    # what is hit depends on slide and bounds alone, and keys may repeat
    place = [slide, "x1", "y1", "x2", "y2"]
    return known.join(hit.select(*place).distinct(), place, "left_anti")


def first_violation(boxes: DataFrame, regions: DataFrame, key: str, region: str, slide: str = "slide") -> DataFrame:
    """One region for each box that meets any."""
    return least_hits(boxes, regions, key, region, slide).groupBy(key, slide).agg(F.min(region).alias(region))


def region_pairs(left: DataFrame, right: DataFrame, slide: str = "slide", cell: int = 2048) -> DataFrame:
    """Region pairs on shared slides with overlap area and its share of the smaller (J3, G3), by grid cells."""
    pairs = region_hits(left, right.withColumnRenamed("region", "other"), "region", "other", slide, cell=cell)
    return pairs.select(slide, "region", "other", G.overlap_area(G.box(), G.box("r_")).alias("overlap"), F.round(G.overlap_percent(G.box(), G.box("r_")), 6).alias("overlap_pct"))


def verify_splits(samples: DataFrame, test_regions: DataFrame, other_regions: DataFrame, key: str, slide: str = "slide", split: str = "split", cell: int = 2048) -> DataFrame:
    """``check``, ``critical``, ``violations``, ``passed``, a row for each check and one for the verdict.

    Critical are train samples that meet a test region of their slide, val samples that do, and keys of a slide that are in
    both; the verdict is that none of them is violated.  Pairs of overlapping regions of the two test sets are told only.
    Samples without bounds meet no region; ``split`` is train or val.
    """
    boxes = samples.filter(F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull())
    hits = least_hits(boxes.withColumn("_key", F.struct(key, split)), test_regions.withColumn("region", F.lit(1)), "_key", "region", slide).select(slide, "_key").distinct()
    met = hits.groupBy(F.col(f"_key.{split}").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    both = samples.groupBy(slide, key).agg(F.count_distinct(split).alias("n")).filter("n > 1")
    counts = (
        met.select(F.concat(F.col("split"), F.lit("_vs_test")).alias("check"), "n")
        .unionByName(both.agg(F.count(F.lit(1)).alias("n")).withColumn("check", F.lit("train_vs_val")))
        .unionByName(region_counts(test_regions, other_regions, "region", "region", slide).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("check", F.lit("test_vs_test")))
    )
    names = samples.sparkSession.createDataFrame([("train_vs_test", True), ("val_vs_test", True), ("train_vs_val", True), ("test_vs_test", False)], "check string, critical boolean")
    checks = names.join(F.broadcast(counts), "check", "left").select("check", "critical", F.coalesce("n", F.lit(0)).alias("violations"))
    verdict = checks.filter("critical").agg(F.sum("violations").cast("long").alias("violations")).select(F.lit("verdict").alias("check"), F.lit(True).alias("critical"), "violations")
    return checks.unionByName(verdict).withColumn("passed", F.col("violations") == 0)


def iqr_filter(boxes: DataFrame, group: Sequence[str], size: Sequence[str], least: float = 0.0, k: float = 1.0) -> DataFrame:
    """Rows with every size within the quartiles widened by k times their distance."""
    stats = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(f"_q_{c}") for c in size]
    joined = boxes.join(boxes.groupBy(*group).agg(*stats), list(group))
    for c in size:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        joined = joined.filter(F.col(c).between(F.greatest(F.lit(least), q1 - k * (q3 - q1)), q3 + k * (q3 - q1)))
    return joined.drop(*[f"_q_{c}" for c in size])


def distance_moments(rows: DataFrame, group: Sequence[str], distance: str) -> DataFrame:
    """Mean and deviation of each group's distances as its ``middle`` and ``width``: a fit where a histogram is not wanted."""
    return rows.groupBy(*group).agg(F.avg(distance).alias("middle"), F.stddev_pop(distance).alias("width"))


def edge_fits(rows: DataFrame, group: Sequence[str], distance: str, least_bins: int = 100, most_bins: int = 1 << 16) -> DataFrame:
    """``amplitude``, ``middle``, ``width`` of the Gaussian on the rising edge of each group's first peak; null where there is no fit.

    Bins follow the Freedman-Diaconis rule (``least_bins`` at least, and where the quartiles agree; ``most_bins`` at
    most); counting them is one aggregation, and a group's task gets its bins, not its rows.  The histogram is smoothed by
    a Gaussian of a fiftieth of the bins; the first peak has a tenth of the largest density and no higher one within five bins.
    Missing and NaN distances are left out; groups without spread have no fit.
    """
    group = list(group)
    known = rows.filter(F.col(distance).isNotNull() & ~F.isnan(distance)).select(*group, F.col(distance).cast("double").alias("_d"))
    # equal values are counted before they are ordered
    counts = known.groupBy(*group, "_d").agg(F.count(F.lit(1)).alias("_n"))
    stats = counts.groupBy(*group).agg(F.min("_d").alias("low"), F.max("_d").alias("high"), F.sum("_n").alias("n"), F.percentile("_d", F.array(F.lit(0.25), F.lit(0.75)), F.col("_n")).alias("_q"))
    spread = F.col("_q")[1] - F.col("_q")[0]
    wanted = F.floor((F.col("high") - F.col("low")) / (2 * spread / F.cbrt("n")))
    stats = stats.withColumn("bins", F.when(spread > 0, F.least(F.greatest(wanted, F.lit(least_bins)), F.lit(most_bins))).otherwise(least_bins).cast("int")).drop("_q")
    at = F.least(F.col("bins") - 1, F.floor((F.col("_d") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins"))).cast("int")
    filled = counts.join(stats.filter("high > low"), group).groupBy(*group, "low", "high", "n", "bins", at.alias("bin")).agg(F.sum("_n").alias("count"))
    schema = ", ".join(f"`{g}` {dict(rows.dtypes)[g]}" for g in group) + ", amplitude double, middle double, width double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        low, high, n, bins = (part[c].iloc[0] for c in ("low", "high", "n", "bins"))
        density = np.bincount(part["bin"], weights=part["count"], minlength=bins) / (n * (high - low) / bins)
        fit = P.edge_fit(low + (np.arange(bins) + 0.5) * (high - low) / bins, density)
        return pd.DataFrame({g: part[g].iloc[:1] for g in group} | dict(zip(("amplitude", "middle", "width"), ([v] for v in fit or (None,) * 3))))

    fits = filled.groupBy(*group).applyInPandas(run, schema)
    return rows.select(*group).distinct().join(fits, group, "left")


def distance_gate(rows: DataFrame, fits: DataFrame, group: Sequence[str], distance: str, k: float = 1.0) -> DataFrame:
    """``positive`` within the fit's middle +- k widths (not below 0), ``negative`` above max(0.5, middle + 5 widths); a middle above 0.5 falls back to the 20th and 80th percentiles, no fit gives neither."""
    real = F.col(distance).isNotNull() & ~F.isnan(F.col(distance).cast("double"))
    counts = rows.filter(real).groupBy(*group, distance).agg(F.count(F.lit(1)).alias("_n"))
    percentiles = counts.groupBy(*group).agg(F.percentile(distance, F.array(F.lit(0.2), F.lit(0.8)), F.col("_n")).alias("_p"))
    d, m, s, p = F.col(distance), F.col("_m"), F.col("_s"), F.col("_p")
    positive = F.when(m > 0.5, d <= p[0]).otherwise(d.between(F.greatest(F.lit(0.0), m - k * s), m + k * s))
    negative = F.when(m > 0.5, d >= p[1]).otherwise((d > F.greatest(F.lit(0.5), m + 5 * s)) & ~positive)
    known = rows.join(percentiles.join(fits.select(*group, F.col("middle").alias("_m"), F.col("width").alias("_s")), list(group)), list(group), "left")
    flag = lambda c: F.coalesce(m.isNotNull() & real & c, F.lit(False))
    return known.withColumn("positive", flag(positive)).withColumn("negative", flag(negative)).drop("_m", "_s", "_p")


def prefilter(rows: DataFrame, group: Sequence[str], score: str, key: str, most: int) -> DataFrame:
    """In groups of more than ``most`` rows, those that score at least as the row after the ``most`` best; ties stay."""
    by = W.partitionBy(*group)
    ranked = rows.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_r", F.row_number().over(by.orderBy(F.desc(score), key)))
    edge = ranked.withColumn("_t", F.max(F.when(F.col("_r") == most + 1, F.col(score))).over(by))
    return edge.filter((F.col("_n") <= most) | (F.col(score) >= F.col("_t"))).drop("_n", "_r", "_t")


def min_max(value: Column, window: W) -> Column:
    """0 where all values agree."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def priority_pick(rows: DataFrame, group: Sequence[str], confidence: str, elapsed: str, key: str, k: int) -> DataFrame:
    """The k rows of each group with the best 0.6 confidence + 0.4 earliness, both scaled in the group."""
    by = W.partitionBy(*group)
    p = 0.6 * min_max(F.col(confidence), by) + 0.4 * (1.0 - min_max(F.col(elapsed), by))
    scored = rows.withColumn("priority", F.round(p, 6))
    return scored.withColumn("rank", F.row_number().over(by.orderBy(F.desc("priority"), key))).filter(F.col("rank") <= k)


def tile_local(boxes: DataFrame, size: int) -> DataFrame:
    """Tile of each box and its coordinates in it (K3); :func:`tile_global` is the way back."""
    out = boxes.withColumn("tile_x", (F.floor(F.col("x1") / size) * size).cast("long")).withColumn("tile_y", (F.floor(F.col("y1") / size) * size).cast("long"))
    for c, t in (("x1", "tile_x"), ("y1", "tile_y"), ("x2", "tile_x"), ("y2", "tile_y")):
        out = out.withColumn(c, F.col(c) - F.col(t))
    return out


def tile_global(boxes: DataFrame) -> DataFrame:
    out = boxes
    for c, t in (("x1", "tile_x"), ("y1", "tile_y"), ("x2", "tile_x"), ("y2", "tile_y")):
        out = out.withColumn(c, F.col(c) + F.col(t))
    return out.drop("tile_x", "tile_y")


def density_windows(points: DataFrame, slide: str, size: int, least: int) -> DataFrame:
    """Half-open windows of ``size`` on a grid of step max(500, size / 10) that hold at least ``least`` points.

    Each point names the windows that hold it; windows are counted by key.
    """
    step = max(500, size // 10)
    starts = lambda v: F.filter(F.sequence(F.greatest(F.lit(0), F.floor((v - size) / step) + 1), F.floor(v / step)), lambda i: (i * step <= v) & (v < i * step + size))
    each = points.select(slide, F.explode(starts(F.col("x"))).alias("i"), "y").select(slide, "i", F.explode(starts(F.col("y"))).alias("j"))
    counted = each.groupBy(slide, "i", "j").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counted.select(slide, (F.col("i") * step).cast("long").alias("x"), (F.col("j") * step).cast("long").alias("y"), "n")


def median_density_window(windows: DataFrame, slide: str) -> DataFrame:
    """The window at index max(n // 2, int(0.6 n)), capped, in order of count."""
    by = W.partitionBy(slide)
    ranked = windows.withColumn("_r", F.row_number().over(by.orderBy("n", "x", "y")) - 1).withColumn("_c", F.count(F.lit(1)).over(by))
    at = F.least(F.greatest(F.floor(F.col("_c") / 2), F.floor(F.col("_c") * 0.6)), F.col("_c") - 1)
    return ranked.filter(F.col("_r") == at).drop("_r", "_c")
