"""Tests and measures of small colour images, a row for each: (key, height, width, pixels), pixels as row-major RGB bytes.

No image library is needed: images are decoded before they come here.  A dark object stands on a light ground; what
is darker than Otsu's threshold is its mask, and its largest connected part is the object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of red, green and blue in a grey value.
GREY = np.array([0.299, 0.587, 0.114])
#: Pixels of the images that are tested together: steps over them stay in a core's cache.
STACK = 64_000


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb @ GREY).astype(np.uint8)


def stacked(images: np.ndarray) -> np.ndarray:
    """One image, or many of one size, as a stack: (image, row, column)."""
    return images.reshape(-1, *images.shape[-2:])


def otsu(values: np.ndarray) -> int:
    """The grey level that parts dark from light with the largest variance between them; the darker side includes it."""
    return int(otsu_levels(values.reshape(1, -1, 1))[0])


def otsu_levels(g: np.ndarray) -> np.ndarray:
    """Otsu's threshold of each image of a stack."""
    of = np.arange(len(g))[:, None, None] * 256
    n = np.bincount((of + g).ravel(), minlength=256 * len(g)).reshape(-1, 256).astype(np.float64)
    below, level = np.cumsum(n, axis=1), np.cumsum(n * np.arange(256), axis=1)
    above = below[:, -1:] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = level / below - (level[:, -1:] - level) / above
        between = np.where((below > 0) & (above > 0), below * above * gap**2, 0.0)
    return between.argmax(axis=1)


class Runs(NamedTuple):
    """Runs of pixels in the rows of a stack of masks, in order: a run is ``start`` <= column < ``end``."""

    image: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    shape: tuple[int, int, int]

    @property
    def size(self) -> np.ndarray:
        return self.end - self.start

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums by image."""
        return np.bincount(self.image, values, self.shape[0])

    def kept(self, keep: np.ndarray) -> Runs:
        return Runs(self.image[keep], self.row[keep], self.start[keep], self.end[keep], self.shape)

    def middles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pixels of each image, and their mean row and column; no number where there are none."""
        n = self.total(self.size)
        with np.errstate(invalid="ignore"):
            return n, self.total(self.size * self.row) / n, self.total(self.size * (self.start + self.end - 1)) / 2 / n

    def painted(self, values: np.ndarray) -> np.ndarray:
        """The stack with the value of each run in its pixels, zeros elsewhere."""
        out = np.zeros(self.shape, values.dtype)
        n = self.size
        first = (self.image * self.shape[1] + self.row) * self.shape[2] + self.start
        out.reshape(-1)[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(values, n)
        return out


def runs(mask: np.ndarray) -> Runs:
    n, high, wide = mask.shape
    ends = np.zeros((n * high, wide + 2), bool)
    ends[:, 1:-1] = mask.reshape(-1, wide)
    row, col = np.divmod(np.flatnonzero(ends[:, 1:] != ends[:, :-1]), wide + 1)
    image, row = np.divmod(row[::2], high)
    return Runs(image, row, col[::2], col[1::2], mask.shape)


def joined(r: Runs, reach: int) -> np.ndarray:
    """For each run the last run of its connected part: by sides of pixels (``reach`` 0) or by corners too (1).

    Runs touch those of the row above whose columns they meet.  The smaller of two touching parts' last runs takes the larger
    as its own, then all take the last of the last: the parts left are at most half as many with every step.
    """
    wide = r.shape[2] + 2
    at = (r.image * r.shape[1] + r.row) * wide
    low = np.searchsorted(at + r.end, at - wide + r.start - reach, side="right")
    n = np.where(r.row > 0, np.searchsorted(at + r.start, at - wide + r.end + reach) - low, 0)
    a = np.repeat(np.arange(len(at)), n)
    b = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    last = np.arange(len(at))
    while len(a):
        last[np.minimum(a, b)] = np.maximum(a, b)
        while ((further := last[last]) != last).any():
            last = further
        a, b = last[a], last[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return last


def parts(mask: np.ndarray) -> np.ndarray:
    """Connected parts (eight neighbours) of a mask, numbered from 1 by their last pixels; 0 outside."""
    r = runs(mask[None])
    return r.painted(np.unique(joined(r, 1), return_inverse=True)[1] + 1)[0]


def object_mask(rgb: np.ndarray) -> np.ndarray:
    g = grey(rgb)
    return g <= otsu(g)


def object_runs(g: np.ndarray) -> Runs:
    """The objects' pixels in a stack of grey images."""
    return runs(g <= otsu_levels(g)[:, None, None])


def largest_part(mask: np.ndarray) -> np.ndarray | None:
    """Rows and columns of the largest part, the first of equal ones; None for an empty mask."""
    label = parts(mask)
    n = np.bincount(label.ravel())[1:]
    return np.argwhere(label == n.argmax() + 1) if len(n) else None


def are_centred(mask: Runs, tolerance: float) -> np.ndarray:
    """For each image whether the mask's centre of mass is near the middle, in shares of the image; not so without a mask."""
    _, y, x = mask.middles()
    return (np.abs(y - mask.shape[1] / 2) / mask.shape[1] < tolerance) & (np.abs(x - mask.shape[2] / 2) / mask.shape[2] < tolerance)


def are_regular(mask: Runs, tolerance: float, least: float) -> np.ndarray:
    """For each image whether the bounds of the largest part are nearly square and it covers enough of the image."""
    last = joined(mask, 1)
    n = np.bincount(last, mask.size, len(last))[last]
    most, of = np.zeros(mask.shape[0]), np.full(mask.shape[0], len(last))
    np.maximum.at(most, mask.image, n)
    largest = n == most[mask.image]
    np.minimum.at(of, mask.image[largest], last[largest])
    part = mask.kept(last == of[mask.image])
    high, wide = np.zeros((2, mask.shape[0]), np.int64)
    for size, low, up in ((high, part.row, part.row + 1), (wide, part.start, part.end)):
        first = np.full(len(size), max(mask.shape))
        np.minimum.at(first, part.image, low)
        np.maximum.at(size, part.image, up)
        size -= first
    with np.errstate(divide="ignore"):
        return (most > 0) & (np.abs(wide / high - 1) < tolerance) & (most / (mask.shape[1] * mask.shape[2]) >= least)


def centred(rgb: np.ndarray, tolerance: float = 0.2) -> bool:
    """Whether the mask's centre of mass is near the middle, in shares of the image."""
    return bool(are_centred(object_runs(stacked(grey(rgb))), tolerance)[0])


def regular(rgb: np.ndarray, tolerance: float = 0.1, least: float = 0.01) -> bool:
    """Whether the object's bounds are nearly square and it covers enough of the image (F15).  Its area is its pixels."""
    return bool(are_regular(object_runs(stacked(grey(rgb))), tolerance, least)[0])


def refined_box(rgb: np.ndarray, box: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """The object's bounds in the coordinates of the ``box`` that the image was cut from; the box itself without one (P5)."""
    at = largest_part(object_mask(rgb))
    if at is None:
        return box
    (top, left), (bottom, right) = at.min(axis=0), at.max(axis=0) + 1
    return int(box[0] + left), int(box[1] + top), int(box[0] + right), int(box[1] + bottom)


def equalised(g: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Grey levels equalised tile by tile: histograms are cut at ``clip`` times their mean, what is cut is spread evenly, and a pixel's level is interpolated between the four tiles around it (F16)."""
    stack = stacked(g)
    shape = stack.shape[1:]
    high, wide = (-(-n // tiles) for n in shape)
    # tables go by level, then by tile of an image: a step from level to level takes all tiles at once
    step = len(stack) * tiles * tiles
    value = stack * np.int64(step) + np.arange(len(stack))[:, None, None] * (tiles * tiles)
    full = np.pad(value, ((0, 0), (0, high * tiles - shape[0]), (0, wide * tiles - shape[1])), mode="symmetric")
    row, col = np.arange(full.shape[1]) // high, np.arange(full.shape[2]) // wide
    count = np.bincount((full + row[:, None] * tiles + col).ravel(), minlength=step * 256).reshape(256, step)
    np.minimum(count, max(1, int(clip * high * wide / 256)), out=count)
    for lower, upper in zip(count[:-1], count[1:]):
        upper += lower
    # sums of 256ths are exact, in whatever order
    level = (high * wide - count[-1]) * (np.arange(1, 257) / 256.0)[:, None]
    level += count
    level *= 255.0 / (high * wide)
    level = level.ravel()

    def around(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = (np.arange(n) + 0.5) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = around(shape[0], high), around(shape[1], wide)
    at = np.empty_like(value)

    def mixed(y: np.ndarray) -> np.ndarray:
        out = level.take(np.add(value, y[:, None] * tiles + x0, out=at))
        out *= 1 - fx
        other = level.take(np.add(value, y[:, None] * tiles + x1, out=at))
        other *= fx
        out += other
        return out

    out, other = mixed(y0), mixed(y1)
    out *= (1 - fy)[:, None]
    other *= fy[:, None]
    out += other
    return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8).reshape(g.shape)


def moved(x: np.ndarray, size: int, axis: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """What a step over windows of ``size`` along an axis writes to, what it reads for each place in the window, and what of it counts.

    Places are moves of the whole stack in memory, so steps run through it in one go; what they write beyond an axis's end
    is left out of the last.
    """
    x = np.ascontiguousarray(x)
    out, step = np.empty_like(x), x.strides[axis] // x.itemsize
    n = x.size - (size - 1) * step
    flat = x.reshape(-1)
    return out.reshape(-1)[:n], [flat[i * step :][:n] for i in range(size)], out[(..., *(slice(x.shape[a] - (size - 1 if a == axis else 0)) for a in (-2, -1)))]


def padded(x: np.ndarray, low: int, high: int, **mode: object) -> np.ndarray:
    """Images with more rows and columns on both sides."""
    return np.pad(x, [(0, 0)] * (x.ndim - 2) + [(low, high)] * 2, **mode)


def weighted_mean(g: np.ndarray, weights: np.ndarray, border: str) -> np.ndarray:
    """Separable weighted mean around every pixel."""
    reach = len(weights) // 2
    out = padded(g.astype(np.float64), reach, reach, mode=border)
    for axis in (-2, -1):
        to, places, out = moved(out, len(weights), axis)
        np.multiply(places[0], weights[0], out=to)
        part = np.empty_like(to)
        for w, place in zip(weights[1:], places[1:]):
            to += np.multiply(place, w, out=part)
    return out


def blurred(g: np.ndarray) -> np.ndarray:
    """Weighted mean by 1, 4, 6, 4, 1 over both axes, halves rounded to even; sums of bytes by these stay below 2**16 (F16)."""
    out = padded(g.astype(np.uint16), 2, 2, mode="reflect")
    for axis in (-2, -1):
        to, (a, b, c, d, e), out = moved(out, 5, axis)
        np.add(b, d, out=to)
        to += c
        to *= 4
        to += a
        to += e
        to += c
        to += c
    return ((out + 127 + (out >> 8 & 1)) >> 8).astype(np.uint8)


def edges(g: np.ndarray, block: int = 11, below: float = 2.0) -> np.ndarray:
    """Pixels at least ``below`` levels darker than the Gaussian mean of the block around them (F16)."""
    sigma = 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    w = np.exp(-0.5 * ((np.arange(block) - block // 2) / sigma) ** 2)
    return g <= np.rint(weighted_mean(g, w / w.sum(), "edge")) - below


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    """The mask grown and shrunk by a square of ``size``; the outside of the image neither grows nor shrinks it (F16)."""
    near = (size // 2, size - 1 - size // 2)
    for join, fill, ends in ((np.logical_or, False, near), (np.logical_and, True, near[::-1])):
        mask = padded(mask, *ends, constant_values=fill)
        for axis in (-2, -1):
            to, places, mask = moved(mask, size, axis)
            to[:] = places[0]
            for place in places[1:]:
                join(to, place, out=to)
    return mask


def enclosed(mask: np.ndarray) -> Runs:
    """Runs of a stack's masks and all that they enclose: what the outside does not reach through sides of pixels."""
    n, high, wide = mask.shape
    free = np.ones((n, high + 2, wide + 2), bool)
    np.logical_not(mask, out=free[:, 1:-1, 1:-1])
    r = runs(free)
    last = joined(r, 0)
    # an image's last run is below it and outside; between runs of the outside in a row lies what is enclosed
    out = r.kept(last == last[np.searchsorted(r.image, np.arange(n), side="right") - 1][r.image])
    between = np.flatnonzero((out.row[1:] == out.row[:-1]) & (out.image[1:] == out.image[:-1]))
    return Runs(out.image[between], out.row[between] - 1, out.end[between] - 1, out.start[between + 1] - 1, mask.shape)


def without_holes(mask: np.ndarray) -> np.ndarray:
    """The mask and all that it encloses: what the outside does not reach through sides of pixels."""
    r = enclosed(stacked(mask))
    return r.painted(np.ones(len(r.row), bool)).reshape(mask.shape)


def are_circular(g: np.ndarray, centre: float, ratio: tuple[float, float], cover: tuple[float, float], least: int) -> np.ndarray:
    """For each grey image of a stack whether what its closed edges enclose is round (see ``circular``)."""
    mask = closed(edges(blurred(equalised(g))), max(3, min(g.shape[1:]) // 50))
    r = enclosed(mask)
    last = joined(r, 1)
    r = r.kept(np.bincount(last, r.size, len(last))[last] >= least)
    n, y, x = r.middles()
    size, dy, dx = r.size, r.row - y[r.image], (r.start + r.end - 1) / 2 - x[r.image]
    xy = r.total(size * dy * dx)
    moments = np.array([[r.total(size * dy * dy), xy], [xy, r.total(size * (dx * dx + (size * size - 1) / 12))]]) / np.maximum(n, 1)
    low, high = np.sqrt(np.maximum(np.linalg.eigvalsh(np.moveaxis(moments, 2, 0)), 0)).T
    share, all_y, all_x = n / (g.shape[1] * g.shape[2]), *runs(mask).middles()[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        round_ = (low > 0) & (ratio[0] <= high / low) & (high / low <= ratio[1]) & (cover[0] <= share) & (share <= cover[1])
    return (n > 0) & round_ & (np.abs(all_y - g.shape[1] / 2) / g.shape[1] <= centre) & (np.abs(all_x - g.shape[2] / 2) / g.shape[2] <= centre)


def circular(rgb: np.ndarray, centre: float = 0.1, ratio: tuple[float, float] = (0.85, 1.15), cover: tuple[float, float] = (0.2, 0.8), least: int = 500) -> bool:
    """Whether what the closed edges enclose is round: centred, with nearly equal axes and a coverage in range (F16).

    Contrast is equalised, blurred and parted from its surroundings, edges are closed by a fiftieth of the smaller side (three pixels
    at least), and enclosed parts of ``least`` pixels count together.  The ratio is the longer second-moment axis over the shorter one.
    """
    return bool(are_circular(stacked(grey(rgb)), centre, ratio, cover, least)[0])


def grains(rgb: np.ndarray) -> np.ndarray:
    """(image, 3): ``centred``, ``regular`` and ``circular`` of a stack of images, grey levels and masks made once for all."""
    g = grey(rgb)
    mask = object_runs(g)
    return np.stack([are_centred(mask, 0.2), are_regular(mask, 0.1, 0.01), are_circular(g, 0.1, (0.85, 1.15), (0.2, 0.8), 500)], axis=1)


def normalised(rgb: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Channels brought to a reference mean and deviation, cut to bytes; a flat channel takes the mean (M8)."""
    x = rgb.astype(np.float64)
    own, spread = x.mean(axis=(0, 1)), x.std(axis=(0, 1))
    return np.clip(np.rint((x - own) / np.where(spread > 0, spread, 1.0) * std + mean), 0, 255).astype(np.uint8)


def aligned(x: Column, mean: Column, std: Column, to_mean: Column, to_std: Column, alpha: float = 1.0) -> Column:
    """A value brought from one mean and deviation to another, mixed with itself by ``alpha``, cut to a byte (M8)."""
    moved = (x - mean) / (std + F.lit(1e-8)) * to_std + to_mean
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), alpha * moved + (1 - alpha) * x))).cast("int")


def level_map(content: DataFrame, reference: DataFrame, channel: Sequence[str], level: str) -> DataFrame:
    """``channel``..., ``level``, ``matched``: the smallest level whose share of reference values at or below it is not less than that of the content's (M8).

    Levels are few (256 for bytes): values are counted first, and the two cumulative histograms of a channel are what is
    joined.  Channels without a reference keep their levels; missing values are left out.
    """
    keys = list(channel)

    def cumulated(values: DataFrame) -> DataFrame:
        counts = values.filter(F.col(level).isNotNull()).groupBy(*keys, level).agg(F.count(F.lit(1)).alias("_n"))
        by = W.partitionBy(*keys)
        return counts.select(*keys, level, F.sum("_n").over(by.orderBy(level)).alias("_to"), F.sum("_n").over(by).alias("_all"))

    own, other = cumulated(content), cumulated(reference).select(*keys, F.col(level).alias("_level"), F.col("_to").alias("_r_to"), F.col("_all").alias("_r_all"))
    reached = F.when(F.col("_to").cast("decimal(38,0)") * F.col("_r_all") <= F.col("_r_to").cast("decimal(38,0)") * F.col("_all"), F.col("_level"))
    out = own.join(other, keys, "left").groupBy(*keys, level).agg(F.min(reached).alias("matched"))
    return out.select(*keys, level, F.coalesce("matched", level).alias("matched"))


def turned(rgb: np.ndarray) -> list[np.ndarray]:
    """The eight turns and mirrored turns of an image (M9)."""
    return [np.rot90(side, k) for side in (rgb, rgb[:, ::-1]) for k in range(4)]


def shift_grid(boxes: DataFrame, steps: int, step: int) -> DataFrame:
    """Every box moved over a square grid of offsets, the middle included; ``dx``, ``dy`` say how far (M9)."""
    moves = F.sequence(F.lit(-steps * step), F.lit(steps * step), F.lit(step))
    out = boxes.withColumn("dx", F.explode(moves)).withColumn("dy", F.explode(moves))
    for c, d in (("x1", "dx"), ("x2", "dx"), ("y1", "dy"), ("y2", "dy")):
        out = out.withColumn(c, F.col(c) + F.col(d))
    return out


def crop_name(slide: Column, number: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """File name of a crop with its place."""
    return F.concat_ws("_", slide, F.lit("pollen"), number, x1, y1, x2 - x1, y2 - y1)


def with_test(images: DataFrame, key: str, test: Callable[[np.ndarray], object], kind: str = "boolean", name: str = "result") -> DataFrame:
    """(key, result) of a function of each image; images without pixels, or of another size than said, give null."""
    return with_stack_test(images, key, lambda stack: [test(rgb) for rgb in stack], kind, name)


def stack_tester(key: str, test: Callable[[np.ndarray], Sequence[object]], name: str = "result", pixels: int = STACK) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(key, result) of frames of images, by a function of a stack of images of one size, some ``pixels`` of them or one larger image, with a result for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        np.empty(24 << 20, np.uint8)  # once so much was freed, the allocator keeps the memory of smaller arrays for the next ones
        for part in batches:
            out: list[object] = [None] * len(part)
            sizes: dict[tuple[int, int], list[int]] = {}
            data = part["pixels"].tolist()
            for i, (h, w, x) in enumerate(zip(part["height"], part["width"], data)):
                if x is not None and len(x) == 3 * h * w > 0:
                    sizes.setdefault((int(h), int(w)), []).append(i)
            for (h, w), of in sizes.items():
                n = max(1, pixels // (h * w))
                for some in (of[k : k + n] for k in range(0, len(of), n)):
                    for i, result in zip(some, test(np.frombuffer(b"".join(data[i] for i in some), np.uint8).reshape(-1, h, w, 3))):
                        out[i] = result
            yield pd.DataFrame({key: part[key], name: pd.Series(out, dtype=object, index=part.index)})

    return run


def with_stack_test(images: DataFrame, key: str, test: Callable[[np.ndarray], Sequence[object]], kind: str = "boolean", name: str = "result", pixels: int = STACK) -> DataFrame:
    """``with_test`` by a function of stacks (see ``stack_tester``)."""
    return images.select(key, "height", "width", "pixels").mapInPandas(stack_tester(key, test, name, pixels), f"{key} {dict(images.dtypes)[key]}, {name} {kind}")


def smoothed(density: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with reflected ends."""
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(density, reach, mode="symmetric"), k / k.sum(), mode="valid")


def first_peak(density: np.ndarray, share: float = 0.1, apart: int = 5) -> int | None:
    """The first local maximum of at least ``share`` of the largest value that no higher one is nearer to than ``apart`` bins."""
    up = np.flatnonzero((density[1:-1] > density[:-2]) & (density[1:-1] >= density[2:])) + 1
    up = up[density[up] >= share * density.max()] if len(up) else up
    kept: list[int] = []
    for i in up[np.argsort(-density[up], kind="stable")]:
        if all(abs(i - j) >= apart for j in kept):
            kept.append(int(i))
    return min(kept) if kept else None


def rising_edge(centres: np.ndarray, density: np.ndarray, peak: float) -> tuple[float, float, float] | None:
    """Amplitude, middle and width of the Gaussian that fits the bins left of a peak best, its middle within a fifth of the peak.

    For a middle and a width the best amplitude is a ratio of sums, so a grid over those two is narrowed in steps.
    """
    x, y = centres[centres < peak], density[centres < peak]
    if len(x) < 5:
        return None
    ends = sorted((0.8 * peak, 1.2 * peak))
    mu, width = np.linspace(*ends, 21), np.geomspace(max(1e-3, np.ptp(x) / 100), 4 * np.ptp(x), 21)
    best = None
    for _ in range(12):
        g = np.exp(-0.5 * ((x - mu[:, None, None]) / width[:, None]) ** 2)
        a = np.maximum(0.0, (g * y).sum(axis=2) / np.maximum((g * g).sum(axis=2), 1e-300))
        error = ((a[:, :, None] * g - y) ** 2).sum(axis=2)
        i, j = np.unravel_index(error.argmin(), error.shape)
        best = float(a[i, j]), float(mu[i]), float(width[j])
        d, r = (mu[1] - mu[0]), width[1] / width[0]
        mu = np.clip(np.linspace(mu[i] - 2 * d, mu[i] + 2 * d, 21), *ends)
        width = np.geomspace(max(1e-3, width[j] / r**2), width[j] * r**2, 21)
    return best


def edge_fit(centres: np.ndarray, density: np.ndarray) -> tuple[float, float, float] | None:
    """The whole fit of a histogram: smoothing, first peak, rising edge; None where a step finds nothing."""
    smooth = smoothed(density, max(1.0, len(density) / 50))
    peak = first_peak(smooth)
    return None if peak is None else rising_edge(centres, smooth, float(centres[peak]))
