"""Invariants of order-dependent operators, and hand-made cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veridian.functions import geometry as G
from veridian.functions import text as T
from veridian.operators import sampling, series
from veridian.operators.miner import Suppression
from veridian.operators.nms import greedy

boxes = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 30), st.integers(1, 30)), min_size=1, max_size=40)


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


@settings(max_examples=100, deadline=None)
@given(boxes, st.sampled_from([0.1, 0.3, 0.5]))
def test_suppression(raw, threshold):
    b = np.array([(x, y, x + w, y + h) for x, y, w, h in raw], dtype=float)
    keep = greedy(b, threshold)
    kept = [i for i in range(len(b)) if keep[i]]
    assert all(iou(b[i], b[j]) <= threshold + 1e-9 for i in kept for j in kept if i < j)
    for i in range(len(b)):
        assert keep[i] or any(j < i and iou(b[i], b[j]) > threshold - 1e-9 for j in kept)


def test_suppression_chain():
    b = np.array([[0, 0, 10, 10], [4, 0, 14, 10], [8, 0, 18, 10]], dtype=float)
    assert greedy(b, 0.3).tolist() == [True, False, True]


@settings(max_examples=50, deadline=None)
@given(boxes)
def test_flush_counts_every_box_once(raw):
    objects = Suppression(7, 0.3)
    for i, (x, y, w, h) in enumerate(raw):
        objects.add((x, y, x + w, y + h), float(i))
    done = len(raw) // 7 * 7
    assert set(objects.status[:done]) <= {"new", "replacement", "discarded"} and set(objects.status[done:]) <= {"pending"}
    assert len(objects.discarded) == len(raw) and objects.flushed == done


def shared_out(counts, total, least):
    """Budgets with a minimum, one unit after another."""
    budget = dict.fromkeys(counts, 0)
    for _ in range(least):
        room = sorted((k for k in counts if budget[k] < counts[k]), key=lambda k: (-counts[k], k))
        for k in room[: max(0, total - sum(budget.values()))]:
            budget[k] += 1
    rest = max(0, min(total, sum(counts.values())) - sum(budget.values()))
    room = {k: counts[k] - budget[k] for k in counts}
    rooms = sum(room.values())
    if rooms:
        exact = {k: Fraction(rest * room[k], rooms) for k in counts}
        for k in counts:
            budget[k] += int(exact[k])
        for k in sorted(counts, key=lambda k: (int(exact[k]) - exact[k], -room[k], k))[: rest - sum(int(e) for e in exact.values())]:
            budget[k] += 1
    return budget


def test_budgets_with_minimum_and_capacity(spark):
    draw = random.Random(4)
    cases = [({f"k{i}": draw.choice([0, 1, 2, 3, 9, 50]) for i in range(draw.randint(1, 8))}, draw.choice([0, 1, 3, 7, 40, 500])) for _ in range(60)]
    rows = [(g, k, n, total) for g, (counts, total) in enumerate(cases) for k, n in counts.items()]
    df = spark.createDataFrame(rows, "g int, k string, n long, total long")
    for least in (0, 1, 2):
        got = {(r.g, r.k): r.budget for r in sampling.allocate(df, ["g"], "k", "n", F.col("total"), least).collect()}
        for g, (counts, total) in enumerate(cases):
            want = shared_out(counts, total, least)
            assert {k: got[g, k] for k in counts} == want, (counts, total, least)
            assert sum(want.values()) == min(total, sum(counts.values()))


def test_audit_sample_of_few_rows(spark):
    rows = spark.createDataFrame([(i, "a" if i < 90 else "b", i % 2) for i in range(100)], "id long, g string, h int")
    out = sampling.audit_sample(rows, ["g", "h"], "id", 20).orderBy("audit_id").collect()
    assert len(out) == len({r.id for r in out}) == 20 and [r.audit_id for r in out] == [f"audit_{i:05d}" for i in range(20)]
    assert {(g, h): sum((r.g, r.h) == (g, h) for r in out) for g in "ab" for h in (0, 1)} == {("a", 0): 9, ("a", 1): 8, ("b", 0): 2, ("b", 1): 1}
    assert sampling.audit_sample(rows, ["g", "h"], "id", 1000).count() == 100 and sampling.audit_sample(rows.limit(0), ["g"], "id", 5).count() == 0


def test_weighted_draws_follow_the_weights(spark):
    rows = spark.createDataFrame(list(enumerate([0.0, 1.0, 2.0, 0.5, 96.5, None])), "id long, w double")
    out = sampling.weighted_draws(rows, F.col("w"), ["id"], 4000, 7)
    n = {r.id: r["count"] for r in out.groupBy("id").count().collect()}
    assert sum(n.values()) == 4000 == out.select("draw").distinct().count() and set(n) == {1, 2, 3, 4}
    assert all(abs(n[i] - 40 * w) < 6 * (40 * w) ** 0.5 for i, w in ((1, 1.0), (2, 2.0), (3, 0.5), (4, 96.5)))
    assert sampling.weighted_draws(rows.filter("w = 0"), F.col("w"), ["id"], 10).count() == 0


def test_split_cut(spark):
    rows = spark.createDataFrame([("s", i) for i in range(7)], "slide string, id long")
    counts = {r["split"]: r["count"] for r in sampling.split(rows, ["slide"], "id", 0.85).groupBy("split").count().collect()}
    assert counts == {"train": 5, "val": 2}


def test_entropy_is_the_same_in_steps(spark):
    steps = [(i, [0.1, 0.2, 0.3, 0.4][i % 4], 0.05 * (i + 1)) for i in range(4)]
    rows = spark.createDataFrame([(0, *s) for s in steps], "g int, step int, old double, new double")
    got = series.incremental_entropy(rows, ["g"], ["step"], "old", "new").orderBy("step").collect()[-1]["entropy"]
    term = lambda w: -w * math.log(w + 1e-10)
    assert got == pytest.approx(sum(term(n) - term(o) for _, o, n in steps))


def in_order(spark, values, schema="g int, i int, v double"):
    rows = [(g, i, v) for g in (1, 2) for i, v in enumerate(values)]
    return spark.createDataFrame(rows[::-1], schema).repartition(3)


def test_flat_counter(spark):
    out = series.flat_counter(in_order(spark, [9.0, 9.0, 3.0, 3.0, 1.0, 2.0, 3.0, 0.0, 0.0, 3.0]), ["g"], ["i"], "v", 2.0, 1).orderBy("g", "i").collect()
    assert [(r.step, r.counter) for r in out] == 2 * list(zip(range(1, 11), [0, 0, 1, 2, 0, 0, 1, 0, 0, 1]))


def test_missing_confidence_counts_as_the_raw_value_before(spark):
    nan = float("nan")
    out = series.confidence_average(in_order(spark, [nan, 0.2, 0.8, nan, None, 0.4]), ["g"], ["i"], "v").orderBy("g", "i").collect()
    average, want = None, []
    for x in (0.0, 0.2, 0.8, 0.8, 0.8, 0.4):
        average = x if average is None else 0.9 * average + 0.1 * x
        want.append((x, average))
    assert [r.raw for r in out] == 2 * [w[0] for w in want] and [r.average for r in out] == pytest.approx(2 * [w[1] for w in want])
    out = series.confidence_average(in_order(spark, [0.2, 0.8, nan, 0.4]), ["g"], ["i"], "v").filter("g = 1 and i = 3").first()
    assert out.average == pytest.approx(0.3226)


def test_status_ratios_are_of_all_statuses_so_far(spark):
    statuses = ["new", "discarded", "new", "new", "discarded", "discarded", "new"]
    out = series.status_ratios(in_order(spark, statuses, "g int, i int, v string"), ["g"], ["i"], "v", ("discarded",), 3).orderBy("g", "i").collect()
    first, second = 1 / 3, 3 / 6
    later = 0.9 * first + 0.1 * second
    assert [r.discarded_share for r in out] == pytest.approx(2 * ([first] * 3 + [second] * 4))
    assert [r.discarded_average for r in out] == pytest.approx(2 * ([first] * 3 + [later] * 4))
    assert {r.discarded_average for r in series.status_ratios(in_order(spark, statuses[:2], "g int, i int, v string"), ["g"], ["i"], "v", ("discarded",), 3).collect()} == {0.0}


def test_stop_reasons(spark):
    rows = [(1, 10, 5, 0.9, 9), (2, 3, 9, 0.0, 0), (3, 20, 0, 0.0, 19), (4, 20, 0, 0.0, 2), (5, 4, 9, 0.9, 0)]
    df = spark.createDataFrame(rows, "g int, step int, counter int, discarded double, bad int")
    reason = series.stop_reason(F.col("step"), F.col("counter"), F.col("discarded"), F.col("bad"), 3, 3, 0.3, 12)
    got = {r.g: (r.stop, r.reason) for r in series.first_stops(df.withColumn("reason", reason), ["g"], "step", "reason").collect()}
    assert got == {1: (10, "discarded objects"), 2: (None, None), 3: (20, "bad masks"), 4: (None, None), 5: (4, "flat entropy")}


def test_region_touching_counts(spark):
    b = spark.createDataFrame([(0, 0, 10, 10, 10, 0, 20, 5), (0, 0, 10, 10, 11, 0, 20, 5)], "x1 int, y1 int, x2 int, y2 int, r_x1 int, r_y1 int, r_x2 int, r_y2 int")
    assert [r[0] for r in b.select(G.intersects(G.box(), G.box("r_"))).collect()] == [True, False]


def test_size_leak_and_tokens(spark):
    rows = spark.createDataFrame([("grain of 20 µm",), ("35 μm wide",), ("a 3x zoom",), ("no size 12",), ("",), ("Well-formed, thin-walled µ",)], "t string")
    got = rows.select(T.leaks_size(F.col("t")), T.tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False, False]
    assert got[-1][1] == ["well-formed", "thin-walled"]


def test_coverage_gate(spark):
    a, b = spark.range(200).withColumnRenamed("id", "k"), spark.range(100).withColumnRenamed("id", "k")
    with pytest.raises(ValueError):
        sampling.require_coverage(a, b, "k")
