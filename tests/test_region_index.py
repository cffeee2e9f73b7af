"""Boxes against the regions of their slide: the smallest region met, by brute force, and how many rows that takes."""

import numpy as np
from pyspark.sql import functions as F

from veridian.operators import spatial as S
from veridian.sources.sinks import verification_report

BOX = "slide int, {} long, x1 double, y1 double, x2 double, y2 double"


def drawn(seed, n, most, least=0):
    draw = np.random.default_rng(seed)
    low = draw.integers(-500, 500, (n, 2)) / 2
    size = draw.integers(least, most, (n, 2)) / 2
    return [(int(i % 2), i, *map(float, low[i]), *map(float, low[i] + size[i])) for i in range(n)]


def met(box, region, margin):
    return box[0] == region[0] and box[2] <= region[4] + margin and box[4] >= region[2] - margin and box[3] <= region[5] + margin and box[5] >= region[3] - margin


def test_smallest_region_by_brute_force(spark):
    for most, margin in ((12, 0.0), (150, 0.0), (60, 2.5)):
        boxes = [*drawn(1, 300, 40), *((0, 1000 + i, 60.0 + i, 10.0, 10.0 - i, 40.0) for i in range(5)), (0, 2000, 16.0, 16.0, 16.0, 16.0)]
        regions = [*drawn(2, 60, most), (0, 900, 16.0, 16.0, 80.0, 80.0), (0, 901, None, 0.0, 1.0, 1.0)]
        want = {b[1]: min((r[1] for r in regions if r[2] is not None and met(b, r, margin)), default=None) for b in boxes}
        want = {k: v for k, v in want.items() if v is not None}
        b, r = spark.createDataFrame(boxes, BOX.format("id")), spark.createDataFrame(regions, BOX.format("region"))
        got = S.least_hits(b, r, "id", "region", margin=margin).groupBy("id").agg(F.min("region").alias("region"))
        assert {x.id: x.region for x in got.collect()} == want
        assert {x.id for x in S.exclude_regions(b, r, "id", margin=margin).collect()} == {b[1] for b in boxes} - set(want)


def test_many_regions_make_few_rows(spark):
    """All pairs of 300 boxes with 800 regions that lie over each other are 11,230 rows."""
    b, r = spark.createDataFrame(drawn(3, 300, 40), BOX.format("id")), spark.createDataFrame(drawn(4, 800, 400, 300), BOX.format("region"))
    assert S.region_hits(b, r, "id", "region").count() > 10_000
    assert S.least_hits(b, r, "id", "region").count() < 5_000


def test_counts_of_regions_by_brute_force_without_pairs(spark):
    boxes = [*drawn(5, 400, 40), (0, 1, 60.0, 10.0, 10.0, 40.0), (1, 2, 16.0, 16.0, 16.0, 16.0), (None, 3, 0.0, 0.0, 9.0, 9.0), (1, 4, None, 0.0, 9.0, 9.0)]
    boxes += boxes[:20]
    regions = [*drawn(6, 80, 200), (1, 900, 16.0, 16.0, 80.0, 80.0), (0, 901, 50.0, 0.0, 20.0, 90.0), (0, 902, None, 0.0, 1.0, 1.0)]
    want = {(r[0], r[1]): n for r in regions if r[2] is not None and (n := sum(b[2] is not None and met(b, r, 0.0) for b in boxes))}
    b, r = spark.createDataFrame(boxes, BOX.format("id")), spark.createDataFrame(regions, BOX.format("region"))
    for piece in (1 << 17, 30):
        got = S.region_counts(b, r, "id", "region", piece=piece)
        assert {(x.slide, x.region): x.n for x in got.collect()} == want
    assert S.region_counts(b.limit(0), r, "id", "region").count() == 0


def test_region_stats_list_no_pairs(spark):
    from veridian import registry

    plan = registry.QUERIES["a27_region_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_report_cuts_details_before_a_group_is_whole(spark):
    rows = [("a", f"d{i % 500:03d}") for i in range(2000)] + [("b", None), (None, "x"), (None, "x")]
    report = verification_report(spark.createDataFrame(rows, "g string, d string"), "g", "d", 3)
    assert {r.g: (r.violations, r.examples) for r in report.collect()} == {"a": (2000, ["d000", "d001", "d002"]), "b": (1, []), None: (2, ["x"])}
    assert "4096" in report._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_one_file_are_dealt_to_tasks(spark, tmp_path):
    from veridian import registry

    spark.range(600).selectExpr("id AS s_suppkey", "CAST(id % 2 AS INT) AS s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = registry.QUERIES["g4_iou"](spark, str(tmp_path))
    assert pairs.rdd.getNumPartitions() == 3 and pairs.count() == 2 * 300 * 300


def test_bigrams_clean_the_text_once(spark):
    from veridian.functions import text as T

    df = spark.createDataFrame([(" Large \t 12 %% Grain-like wall\u00a0x \n",), ("grain %% wall",), ("",), (None,)], "text string").select(T.bigrams(F.col("text")).alias("b"))
    assert [r.b for r in df.collect()] == [["grain-like wallx"], [], [], None]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(lambda" not in plan
