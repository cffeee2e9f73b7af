"""Suppression of whole slides against brute force over all their boxes."""

import numpy as np
import pytest

from veridian import registry
from veridian.operators.nms import greedy, suppress
from veridian.plans.box_queries import detections

FOLDER = "/root/testdata/sf0.01"


def plain(rows):
    """Greedy over (score, id, box) one by one."""
    kept = []
    for _, i, (x1, y1, x2, y2) in sorted(rows, key=lambda r: (-r[0], r[1])):
        for _, (a1, b1, a2, b2) in kept:
            both = max(0, min(x2, a2) - max(x1, a1)) * max(0, min(y2, b2) - max(y1, b1))
            if both > 0.1 * ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - both):
                break
        else:
            kept.append((i, (x1, y1, x2, y2)))
    return {i for i, _ in kept}


def test_query_suppresses_across_column_borders(spark):
    rows = {}
    for r in detections(spark, FOLDER).filter("slide < 2").collect():
        rows.setdefault(r.slide, []).append((r.score, r.id, (r.x1, r.y1, r.x2, r.y2)))
    got = registry.QUERIES["w8_greedy_nms"](spark, FOLDER).filter("slide < 2 and kept").collect()
    for slide, own in rows.items():
        assert {r.id for r in got if r.slide == slide} == plain(own)


def test_boxes_across_x_1000(spark):
    rows = [(0, 1, 0.9, 990.0, 0.0, 1090.0, 50.0), (0, 2, 0.8, 1005.0, 0.0, 1105.0, 50.0), (0, 3, 0.7, 1090.0, 0.0, 1190.0, 50.0), (1, 4, 0.1, 1005.0, 0.0, 1105.0, 50.0), (1, 5, 0.9, None, 0.0, 1105.0, 50.0)]
    boxes = spark.createDataFrame(rows, "slide int, id int, score double, x1 double, y1 double, x2 double, y2 double")
    assert {r.id: r.kept for r in suppress(boxes, ["slide"], "id", "score", 0.1).collect()} == {1: True, 2: False, 3: True, 4: True, 5: True}


BOX = "slide int, id int, score double, x1 double, y1 double, x2 double, y2 double"


@pytest.mark.parametrize("most, crowd", [(60, 512), (1500, 512), (300, 8)])
def test_rounds_equal_all_with_all(spark, most, crowd):
    draw = np.random.default_rng(most)
    low = draw.integers(-1000, 1000, (800, 2))
    boxes = np.concatenate([low, low + draw.integers(0, most, (800, 2))], axis=1).astype(np.float64)
    score = draw.integers(0, 50, 800) / 50
    order = np.lexsort((np.arange(800), -score))
    rows = [(0, int(i), float(score[i]), *map(float, boxes[i])) for i in range(800)]
    for threshold in (0.0, 0.3):
        got = {r.id for r in suppress(spark.createDataFrame(rows, BOX), ["slide"], "id", "score", threshold, crowd=crowd).collect() if r.kept}
        want = {int(order[i]) for i in np.flatnonzero(greedy(boxes[order], threshold))}
        assert got == want


def test_a_pile_makes_no_pairs(spark):
    """2,000 boxes on one place, some of them equal: rounds over cells decide them before overlaps are listed."""
    rows = [(0, i, i % 7 / 7, float(i % 13), 0.0, 1000.0 + i % 17, 900.0 + i % 11) for i in range(2000)] + [(0, 2000 + i, 0.5, 5000.0 + 3 * i, 0.0, 5001.0 + 3 * i, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, BOX)
    got = {r.id for r in suppress(df, ["slide"], "id", "score", 0.1, crowd=64).collect() if r.kept}
    assert got == {6} | {2000 + i for i in range(40)}


def test_defined_cases(spark):
    rows = [(0, 1, None, 0.0, 0.0, 10.0, 10.0), (0, 2, 0.1, 0.0, 0.0, 10.0, 10.0), (0, 3, 0.9, 5.0, 5.0, 5.0, 9.0), (0, 4, 0.9, float("nan"), 0.0, 1.0, 1.0), (1, 1, None, 0.0, 0.0, 10.0, 10.0), (1, 5, None, 0.0, 0.0, 10.0, 10.0)]
    df = spark.createDataFrame(rows, BOX)
    assert {(r.slide, r.id): r.kept for r in suppress(df, ["slide"], "id", "score", 0.1).collect()} == {(0, 1): False, (0, 2): True, (0, 3): True, (0, 4): True, (1, 1): True, (1, 5): False}
    assert suppress(df.limit(0), ["slide"], "id", "score", 0.1).count() == 0


def test_crowded_tiles_list_no_overlaps(spark, monkeypatch):
    """Boxes in many small tiles, borders decided by later rounds; what is written stays a few rows a box, where overlaps would be 60."""
    from veridian.operators import nms

    sizes, plain_written = [], nms.written

    def counted(df, name):
        out = plain_written(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(nms, "written", counted)
    draw = np.random.default_rng(3)
    low = draw.integers(0, 200, (3000, 2))
    boxes = np.concatenate([low, low + draw.integers(15, 40, (3000, 2))], axis=1).astype(np.float64)
    score = draw.integers(0, 90, 3000) / 90
    order = np.lexsort((np.arange(3000), -score))
    rows = [(0, int(i), float(score[i]), *map(float, boxes[i])) for i in range(3000)] + [(0, 0, float(score[0]), *map(float, boxes[0]))]
    got = nms.suppress(spark.createDataFrame(rows, BOX), ["slide"], "id", "score", 0.1, tile_rows=400).collect()
    want = {int(order[i]) for i in np.flatnonzero(greedy(boxes[order], 0.1))}
    assert len(got) == 3001 and {r.id for r in got if r.kept} == want
    assert max(sizes) <= 4 * 3000
