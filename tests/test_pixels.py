"""Image tests on drawn shapes, and the fit of a histogram's rising edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridian import registry
from veridian.operators import pixels as P
from veridian.operators import spatial as S


def disc(size=60, at=(30, 30), r=(18, 18)):
    y, x = np.mgrid[:size, :size]
    inside = ((y - at[0]) / r[0]) ** 2 + ((x - at[1]) / r[1]) ** 2 <= 1
    return np.where(inside[:, :, None], 40, 220).repeat(3, axis=2).astype(np.uint8)


def test_shapes():
    assert P.centred(disc()) and not P.centred(disc(at=(12, 30), r=(8, 8)))
    assert P.regular(disc()) and not P.regular(disc(r=(18, 9)))
    assert P.circular(disc()) and not P.circular(disc(r=(22, 12))) and not P.circular(disc(r=(5, 5)))
    assert P.refined_box(disc(at=(30, 20), r=(10, 5)), (100, 200, 160, 260)) == (115, 220, 126, 241)


def test_parts_match_a_flood_fill():
    rng = np.random.default_rng(0)
    mask = rng.random((20, 25)) < 0.45
    label, seen = P.parts(mask), np.zeros(mask.shape, int)
    n = 0
    for start in map(tuple, np.argwhere(mask)):
        if seen[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            i, j = todo.pop()
            if 0 <= i < 20 and 0 <= j < 25 and mask[i, j] and not seen[i, j]:
                seen[i, j] = n
                todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert label.max() == n
    assert len(set(zip(label[mask].tolist(), seen[mask].tolist()))) == n
    assert P.largest_part(np.zeros((3, 3), bool)) is None


def test_normalised_and_turned():
    x = np.random.default_rng(1).integers(60, 120, (30, 30, 3)).astype(np.uint8)
    y = P.normalised(x, np.array([128.0, 100.0, 90.0]), np.array([20.0, 10.0, 5.0]))
    assert y.mean(axis=(0, 1)) == pytest.approx([128, 100, 90], abs=0.5) and y.std(axis=(0, 1)) == pytest.approx([20, 10, 5], abs=0.5)
    assert len({t.tobytes() for t in P.turned(x)}) == 8


def test_images_in_a_table(spark):
    rows = [(1, 60, 60, disc().tobytes()), (2, 60, 60, disc(at=(10, 10), r=(5, 5)).tobytes()), (3, 60, 60, None), (4, 5, 5, b"short")]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary")
    assert {r.id: r.result for r in P.with_test(df, "id", P.centred).collect()} == {1: True, 2: False, 3: None, 4: None}


def test_grid_and_names(spark):
    df = spark.createDataFrame([(5, 7, 9, 12)], "x1 int, y1 int, x2 int, y2 int")
    got = {(r.x1, r.y1, r.x2, r.y2) for r in P.shift_grid(df, 1, 4).collect()}
    assert got == {(5 + a, 7 + b, 9 + a, 12 + b) for a in (-4, 0, 4) for b in (-4, 0, 4)}
    name = df.select(P.crop_name(F.lit("s"), F.lit(3), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("n")).first().n
    assert name == "s_pollen_3_5_7_4_5"


def test_rising_edge():
    x = np.concatenate([np.random.default_rng(2).normal(5, 1, 6000), np.random.default_rng(3).normal(14, 2, 6000)])
    density, edges = np.histogram(x, bins=120, density=True)
    centres = (edges[1:] + edges[:-1]) / 2
    smooth = P.smoothed(density, 2.4)
    peak = P.first_peak(smooth)
    assert abs(centres[peak] - 5) < 0.5
    a, mu, width = P.rising_edge(centres, smooth, centres[peak])
    assert abs(mu - 5) < 0.5 and abs(width - 1) < 0.3 and a > 0
    assert P.rising_edge(centres[:3], smooth[:3], 1e9) is None and P.first_peak(np.zeros(10)) is None


def plain_fit(values):
    """Histogram, smoothing and first peak one by one; the edge's points and the peak."""
    x = sorted(values)
    n, iqr = len(x), np.percentile(x, 75) - np.percentile(x, 25)
    bins = max(100, int((x[-1] - x[0]) / (2 * iqr / np.cbrt(n)))) if iqr > 0 else 100
    count, edges = np.histogram(x, bins=bins, density=True)
    sigma = max(1.0, bins / 50)
    reach = int(4 * sigma + 0.5)
    weight = {o: np.exp(-0.5 * (o / sigma) ** 2) for o in range(-reach, reach + 1)}
    mirror = lambda i: i if 0 <= i < bins else (-1 - i if i < 0 else 2 * bins - 1 - i)
    smooth = [sum(w * count[mirror(i + o)] for o, w in weight.items()) / sum(weight.values()) for i in range(bins)]
    peaks = [i for i in range(1, bins - 1) if smooth[i - 1] < smooth[i] >= smooth[i + 1] and smooth[i] >= 0.1 * max(smooth)]
    peaks = [i for i in peaks if not any(abs(i - j) < 5 and smooth[j] > smooth[i] for j in peaks)]
    middle = [(a + b) / 2 for a, b in zip(edges, edges[1:])]
    if not peaks:
        return None
    return np.array(middle[: peaks[0]]), np.array(smooth[: peaks[0]]), middle[peaks[0]]


def test_fits_of_groups_and_gates(spark):
    draw = np.random.default_rng(9)
    groups = {
        0: np.concatenate([draw.normal(0.2, 0.03, 3000), draw.normal(0.7, 0.1, 4000)]),
        1: np.concatenate([draw.normal(0.8, 0.05, 2000), draw.uniform(0, 2, 500)]),
        2: np.repeat([0.1, 0.3, 0.31], [50, 3000, 20]),
        3: np.array([0.4, 0.4, 0.4]),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [(0, None), (1, float("nan")), (4, None)]
    df = spark.createDataFrame(rows, "g int, d double")
    fits = {r.g: r for r in S.edge_fits(df, ["g"], "d").collect()}
    assert set(fits) == {0, 1, 2, 3, 4} and fits[3].middle is None and fits[4].middle is None
    for g in (0, 1):
        x, y, peak = plain_fit(groups[g])
        r = fits[g]
        error = lambda a, m, w: ((a * np.exp(-0.5 * ((x - m) / w) ** 2) - y) ** 2).sum()  # noqa: E731, B023
        assert 0.8 * peak <= r.middle <= 1.2 * peak
        least = min(error(a, m, w) for a in np.linspace(0.5, 1.5, 21) * y.max() for m in np.linspace(0.8, 1.2, 41) * peak for w in np.geomspace(0.005, 1, 60))
        assert error(r.amplitude, r.middle, r.width) <= least * 1.001
    gates = {}
    for r in S.distance_gate(df, S.edge_fits(df, ["g"], "d"), ["g"], "d").collect():
        gates.setdefault(r.g, []).append((r.d, r.positive, r.negative))
    m, w = fits[0].middle, fits[0].width
    for d, positive, negative in gates[0]:
        inside = d is not None and max(0, m - w) <= d <= m + w
        assert positive == inside and negative == (d is not None and d > max(0.5, m + 5 * w) and not inside)
    low, high = np.percentile(groups[1], [20, 80])
    assert all(p == (d <= low) and n == (d >= high) for d, p, n in gates[1] if d == d)
    assert not any(p or n for g in (3, 4) for _, p, n in gates[g])
    assert S.edge_fits(df.limit(0), ["g"], "d").count() == 0


def test_image_kernels_against_plain_loops():
    draw = np.random.default_rng(1)
    g = draw.integers(0, 256, (19, 23)).astype(np.uint8)
    inside = lambda i, n: max(0, min(n - 1, i))
    # blur of five, borders mirrored without the border itself
    w = np.array([1, 4, 6, 4, 1]) / 16
    mirror = lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    plain = [[sum(w[a] * w[b] * float(g[mirror(i + a - 2, 19), mirror(j + b - 2, 23)]) for a in range(5) for b in range(5)) for j in range(23)] for i in range(19)]
    assert np.allclose(P.weighted_mean(g, w, "reflect"), plain)
    # local threshold
    k = np.exp(-0.5 * ((np.arange(11) - 5) / 2.0) ** 2)
    k /= k.sum()
    means = [[sum(k[a] * k[b] * float(g[inside(i + a - 5, 19), inside(j + b - 5, 23)]) for a in range(11) for b in range(11)) for j in range(23)] for i in range(19)]
    assert (P.edges(g) == (g <= np.rint(means) - 2)).all()
    # closing
    mask = draw.random((19, 23)) < 0.2
    for size in (3, 4):
        lo, hi = size // 2, size - 1 - size // 2
        grown = {(i, j) for i in range(19) for j in range(23) if any(0 <= i + a < 19 and 0 <= j + b < 23 and mask[i + a, j + b] for a in range(-lo, hi + 1) for b in range(-lo, hi + 1))}
        shrunk = {(i, j) for i in range(19) for j in range(23) if all((i + a, j + b) in grown or not (0 <= i + a < 19 and 0 <= j + b < 23) for a in range(-hi, lo + 1) for b in range(-hi, lo + 1))}
        assert {tuple(map(int, p)) for p in np.argwhere(P.closed(mask, size))} == shrunk and (P.closed(mask, size) | ~mask).all()
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    assert P.without_holes(ring).sum() == 25
    ring[2, 4] = False
    assert P.without_holes(ring).sum() == 15


def test_equalisation_by_tiles():
    draw = np.random.default_rng(2)
    g = (draw.integers(0, 40, (32, 32)) + 100).astype(np.uint8)
    out = P.equalised(g, 4, 40.0)
    assert out.shape == g.shape and int(out.max()) - int(out.min()) > 200  # contrast spread over all levels
    # the middle of a tile corner region depends on that tile alone: plain equalisation of the first tile
    tile = g[:8, :8]
    level = {v: (tile <= v).sum() * 255 / 64 for v in np.unique(tile)}
    assert abs(int(out[0, 0]) - level[g[0, 0]]) <= 1 and abs(int(out[3, 3]) - level[g[3, 3]]) <= 1
    flat = P.equalised(np.full((16, 16), 9, np.uint8))
    assert len(np.unique(flat)) == 1


def test_round_grains_follow_their_axes(spark):
    got = {r.p_partkey: r for r in registry.QUERIES["f16_round_grains"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 200
    for k, r in got.items():
        assert r.circular == (k % 3 < 2 and k % 7 > 0), (k, r)


def test_parts_of_a_long_path_take_few_steps(monkeypatch):
    """A path winds through the image: labels that move one pixel a step needed a step for each of its pixels."""
    mask = np.zeros((41, 41), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    steps, pad = [], np.pad
    monkeypatch.setattr(np, "pad", lambda *a, **k: steps.append(1) or pad(*a, **k))
    assert P.parts(mask).max() == 1 and len(steps) < 60


def test_images_of_one_file_are_dealt_to_tasks(spark, tmp_path):
    spark.range(2500).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size", "900D AS p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert registry.QUERIES["f16_round_grains"](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_stacks_give_what_single_images_do_in_as_few_steps(monkeypatch):
    """Each step over small arrays was taken anew for each image."""
    draw = np.random.default_rng(4)
    images = [disc(64, (32 + k % 9, 32 + k % 13), (18 + k % 6, 18 + k % 5)) for k in range(20)]
    images += [draw.integers(0, 256, (64, 64, 3)).astype(np.uint8) for _ in range(4)] + [np.full((64, 64, 3), v, np.uint8) for v in (0, 9, 255)]
    alone = [[P.centred(x), P.regular(x), P.circular(x)] for x in images]
    assert {True, False} == {a[0] for a in alone} == {a[1] for a in alone} == {a[2] for a in alone}
    steps = []
    for name in ("pad", "bincount", "cumsum", "searchsorted"):
        monkeypatch.setattr(np, name, lambda *a, f=getattr(np, name), **k: steps.append(1) or f(*a, **k))
    P.grains(np.stack(images[:1]))
    one = len(steps)
    assert P.grains(np.stack(images)).tolist() == alone and len(steps) == 2 * one


def test_a_mask_of_the_whole_image_is_a_part():
    """Parts are numbered from 1, with or without pixels outside."""
    assert (P.parts(np.ones((3, 4), bool)) == 1).all() and len(P.largest_part(np.ones((3, 4), bool))) == 12
    assert P.regular(np.zeros((30, 30, 3), np.uint8)) and not P.regular(np.zeros((30, 20, 3), np.uint8))


def test_blur_in_integers_rounds_as_the_mean():
    draw = np.random.default_rng(6)
    for g in (draw.integers(0, 256, (3, 40, 50)), draw.choice([0, 255], (2, 9, 7)), np.full((1, 5, 1), 255)):
        g = g.astype(np.uint8)
        assert (P.blurred(g) == np.rint(P.weighted_mean(g, np.array([1, 4, 6, 4, 1]) / 16, "reflect"))).all()


def test_stacks_of_mixed_sizes_in_a_table(spark):
    sizes = [(20 + k % 3, 20 + k % 2) for k in range(30)]
    rows = [(k, h, w, bytes([k]) * (3 * h * w)) for k, (h, w) in enumerate(sizes)] + [(30, 20, 20, None), (31, 20, 20, b"short"), (32, None, 20, b"x")]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary").coalesce(1)

    def first(stack):
        assert len(stack) <= 2
        return [f"{x[0, 0, 0]} {x.shape}" for x in stack]

    got = {r.id: r.result for r in P.with_stack_test(df, "id", first, "string", pixels=900).collect()}
    assert got == {k: f"{k} {(*s, 3)}" for k, s in enumerate(sizes)} | {30: None, 31: None, 32: None}
