"""The tile source against slices of whole images."""

import numpy as np
import pytest

from veridian.sources.tiles import read_tiles, write_lines


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    draw = np.random.default_rng(3)
    images = {"a b": draw.integers(0, 256, (50, 40, 3), dtype=np.uint8), "c/d": draw.integers(0, 256, (9, 70, 3), dtype=np.uint8)}
    path = f"file://{tmp_path_factory.mktemp('tiles')}/store"
    rows = [(s, y, im.shape[1], bytearray(im[y].tobytes())) for s, im in images.items() for y in range(len(im))]
    write_lines(spark.createDataFrame(rows, "slide string, y int, width int, pixels binary"), path)
    return path, images


def plain(images, size, overlap, region=None):
    out = {}
    for slide, im in images.items():
        high, wide = im.shape[:2]
        x1, y1, x2, y2 = region or (0, 0, wide, high)
        x1, y1, x2, y2 = max(0, x1), max(0, y1), min(wide, x2), min(high, y2)
        full = np.pad(im, ((0, size), (0, size), (0, 0)))
        n = 0
        for y in range(y1, y2, size - overlap):
            for x in range(x1, x2, size - overlap):
                out[slide, n] = (x, y, full[y : y + size, x : x + size])
                n += 1
    return out


@pytest.mark.parametrize("size, overlap, region, run", [(16, 4, None, 64), (16, 0, (-5, 3, 33, 1000), 2), (100, 10, None, 1), (8, 2, (60, 0, 70, 70), 3)])
def test_tiles_are_slices(spark, store, size, overlap, region, run):
    path, images = store
    got = {(r.slide, r.tile): r for r in read_tiles(spark, path, size, overlap, region, run=run).collect()}
    want = plain(images, size, overlap, region)
    assert set(got) == set(want)
    for k, (x, y, image) in want.items():
        r = got[k]
        assert (r.x, r.y, r.height, r.width) == (x, y, size, size) and bytes(r.pixels) == image.tobytes()


def test_filters_are_pushed(spark, store):
    path, images = store
    df = read_tiles(spark, path, 16, 4).filter("slide = 'a b' and x >= 12 and y < 24 and tile % 2 = 0")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(slide,a b), GreaterThanOrEqual(x,12), LessThan(y,24)]" in plan
    want = {n for (s, n), (x, y, _) in plain(images, 16, 4).items() if s == "a b" and x >= 12 and y < 24 and n % 2 == 0}
    assert want and {r.tile for r in df.collect()} == want


def test_transforms_in_order(spark, store):
    path, images = store
    df = read_tiles(spark, path, 16, 0, rescale=0.5, transforms=[lambda im: im // 2, lambda im: im + 1])
    for r in df.collect():
        assert (r.height, r.width) == (8, 8)
        image = plain(images, 16, 0)[r.slide, r.tile][2][1::2, 1::2]
        assert bytes(r.pixels) == (image // 2 + 1).astype(np.uint8).tobytes()
