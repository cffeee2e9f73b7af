"""Spatial filters and splits over boxes made from ``lineitem`` keys, with their DuckDB SQL.

A detection is a line item: slide = supplier mod 25, a box from its keys on a 10,000 plane, and a score from
discount and tax.  Regions are suppliers on their nation's slide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridian.functions import geometry as G
from veridian.operators import nms as N
from veridian.operators import spatial as S
from veridian.operators.text_stats import levels
from veridian.operators.metrics import micro_scores
from veridian.sources.tables import read

PLANE = 10_000


def detections(spark: SparkSession, d: str) -> DataFrame:
    x = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 613, F.lit(PLANE))
    y = F.pmod(F.col("l_partkey") * 104729 + F.col("l_orderkey") * 31, F.lit(PLANE))
    rows = read(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"),
        F.pmod("l_suppkey", F.lit(25)).cast("int").alias("slide"),
        x.alias("x1"),
        y.alias("y1"),
        (x + 20 + F.col("l_quantity").cast("long")).alias("x2"),
        (y + 20 + F.col("l_linenumber") * 7).alias("y2"),
        F.round(F.col("l_discount") * 8 + F.col("l_tax") * 2, 4).alias("score"),
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
    )
    return rows


DETECTIONS = f"""SELECT l_orderkey * 100 + l_linenumber AS id, (l_suppkey % 25)::INT AS slide, x AS x1, y AS y1, x + 20 + l_quantity::BIGINT AS x2, y + 20 + l_linenumber * 7 AS y2,
round(l_discount * 8 + l_tax * 2, 4) AS score, l_quantity, l_extendedprice, l_returnflag FROM (SELECT *, (l_orderkey * 7919 + l_linenumber * 613) % {PLANE} AS x, (l_partkey * 104729 + l_orderkey * 31) % {PLANE} AS y FROM lineitem)"""


def regions(spark: SparkSession, d: str, shift: int = 0) -> DataFrame:
    x, y = F.pmod(F.col("s_suppkey") * 1543 + shift, F.lit(9000)), F.pmod(F.col("s_suppkey") * 2617 + shift, F.lit(9000))
    return read(spark, d, "supplier").select(F.col("s_suppkey").alias("region"), F.col("s_nationkey").alias("slide"), x.alias("x1"), y.alias("y1"), (x + 600).alias("x2"), (y + 500).alias("y2"))


def _regions(shift: int = 0) -> str:
    return f"SELECT s_suppkey AS region, s_nationkey AS slide, x AS x1, y AS y1, x + 600 AS x2, y + 500 AS y2 FROM (SELECT *, (s_suppkey * 1543 + {shift}) % 9000 AS x, (s_suppkey * 2617 + {shift}) % 9000 AS y FROM supplier)"


HIT = "b.x1 <= r.x2 + {m} AND b.x2 >= r.x1 - {m} AND b.y1 <= r.y2 + {m} AND b.y2 >= r.y1 - {m}"
WITH = f"WITH b AS ({DETECTIONS}), r AS ({_regions()})"


def excluded(spark: SparkSession, d: str) -> DataFrame:
    return S.exclude_regions(detections(spark, d), regions(spark, d), "id", margin=5).select("id", "slide")


EXCLUDED_SQL = f"{WITH} SELECT id, slide FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.slide = b.slide AND {HIT.format(m=5)})"


def violations(spark: SparkSession, d: str) -> DataFrame:
    return S.first_violation(detections(spark, d), regions(spark, d), "id", "region")


VIOLATIONS_SQL = f"{WITH} SELECT id, b.slide, min(region) AS region FROM b JOIN r ON r.slide = b.slide AND {HIT.format(m=0)} GROUP BY ALL"


def region_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return S.region_pairs(regions(spark, d), regions(spark, d, 250))


OVERLAPS_SQL = f"""WITH b AS ({_regions()}), r AS ({_regions(250)}), o AS (SELECT b.slide, b.region, r.region AS other, greatest(least(b.x2, r.x2) - greatest(b.x1, r.x1), 0) * greatest(least(b.y2, r.y2) - greatest(b.y1, r.y1), 0) AS overlap FROM b JOIN r ON r.slide = b.slide AND {HIT.format(m=0)})
SELECT slide, region, other, overlap, round(100.0::DOUBLE * overlap / (600 * 500), 6) AS overlap_pct FROM o"""


def split_checks(spark: SparkSession, d: str) -> DataFrame:
    """Detections of even orders as train, of odd ones as val, some in both; suppliers' regions as test sets."""
    b = detections(spark, d).withColumn("split", F.when(F.floor(F.col("id") / 100) % 2 == 0, "train").otherwise("val"))
    again = b.filter("id % 7 = 0").withColumn("split", F.when(F.col("split") == "train", "val").otherwise("train"))
    return S.verify_splits(b.unionByName(again), regions(spark, d), regions(spark, d, 250), "id")


CHECKS_SQL = f"""WITH d AS ({DETECTIONS}), b AS (SELECT *, CASE WHEN id // 100 % 2 = 0 THEN 'train' ELSE 'val' END AS split FROM d UNION ALL SELECT *, CASE WHEN id // 100 % 2 = 0 THEN 'val' ELSE 'train' END FROM d WHERE id % 7 = 0),
r AS ({_regions()}), o AS ({_regions(250)}),
m AS (SELECT split, count(*) AS n FROM (SELECT DISTINCT b.slide, b.id, b.split FROM b JOIN r ON r.slide = b.slide AND {HIT.format(m=0)}) GROUP BY split),
c AS (SELECT split || '_vs_test' AS "check", true AS critical, n AS violations FROM m
 UNION ALL SELECT 'train_vs_val', true, count(*) FROM (SELECT slide, id FROM b GROUP BY slide, id HAVING count(DISTINCT split) > 1)
 UNION ALL SELECT 'test_vs_test', false, count(*) FROM (SELECT b.region FROM r b JOIN o r ON r.slide = b.slide AND {HIT.format(m=0)}))
SELECT *, violations = 0 AS passed FROM (SELECT * FROM c UNION ALL SELECT 'verdict', true, sum(violations)::BIGINT FROM c WHERE critical)"""


def size_filter(spark: SparkSession, d: str) -> DataFrame:
    b = detections(spark, d).withColumn("w", (F.col("x2") - F.col("x1")).cast("double")).withColumn("h", (F.col("y2") - F.col("y1")).cast("double"))
    return S.iqr_filter(b, ["slide"], ["w", "h"], 10.0).select("id", "slide", "w", "h")


SIZE_SQL = f"""WITH b AS (SELECT id, slide, (x2 - x1)::DOUBLE AS w, (y2 - y1)::DOUBLE AS h FROM ({DETECTIONS})), q AS (SELECT slide, quantile_cont(w, 0.25) AS w1, quantile_cont(w, 0.75) AS w3, quantile_cont(h, 0.25) AS h1, quantile_cont(h, 0.75) AS h3 FROM b GROUP BY slide)
SELECT id, b.slide, w, h FROM b JOIN q USING (slide) WHERE w BETWEEN greatest(10.0, w1 - (w3 - w1)) AND w3 + (w3 - w1) AND h BETWEEN greatest(10.0, h1 - (h3 - h1)) AND h3 + (h3 - h1)"""


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Score floor, sides strictly inside the query's, inclusive area range."""
    b, box = detections(spark, d), G.box()
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    area = G.inclusive_area(box)
    side = (F.least(w, h) > 0.75 * 28) & (F.greatest(w, h) < 4 / 3 * 60)
    return b.filter((F.col("score") >= 0.3) & side & area.between(800, 3000)).select("id", area.alias("area"))


GATES_SQL = f"SELECT id, (x2 - x1 + 1) * (y2 - y1 + 1) AS area FROM ({DETECTIONS}) WHERE score >= 0.3 AND least(x2 - x1, y2 - y1) > 0.75 * 28 AND greatest(x2 - x1, y2 - y1) < 4.0 / 3 * 60 AND (x2 - x1 + 1) * (y2 - y1 + 1) BETWEEN 800 AND 3000"


def distance_window(spark: SparkSession, d: str) -> DataFrame:
    b = detections(spark, d).select("id", "slide", F.round(F.col("l_quantity") / 50, 4).alias("distance"))
    return S.distance_gate(b, S.distance_moments(b, ["slide"], "distance"), ["slide"], "distance").select("id", "positive", "negative")


DISTANCE_SQL = f"""WITH b AS (SELECT id, slide, round(l_quantity / 50, 4) AS d FROM ({DETECTIONS})), s AS (SELECT slide, avg(d) AS m, stddev_pop(d) AS s, quantile_cont(d, 0.2) AS p2, quantile_cont(d, 0.8) AS p8 FROM b GROUP BY slide),
p AS (SELECT *, CASE WHEN m > 0.5 THEN d <= p2 ELSE d BETWEEN greatest(0.0, m - s.s) AND m + s.s END AS positive FROM b JOIN s USING (slide))
SELECT id, positive, CASE WHEN m > 0.5 THEN d >= p8 ELSE d > greatest(0.5, m + 5 * s) AND NOT positive END AS negative FROM p"""


def confidence_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return S.prefilter(detections(spark, d), ["slide"], "score", "id", 50).select("id", "slide", "score")


PREFILTER_SQL = f"""WITH k AS (SELECT id, slide, score, count(*) OVER (PARTITION BY slide) AS n, row_number() OVER (PARTITION BY slide ORDER BY score DESC, id) AS r FROM ({DETECTIONS})), t AS (SELECT *, max(CASE WHEN r = 51 THEN score END) OVER (PARTITION BY slide) AS t FROM k)
SELECT id, slide, score FROM t WHERE n <= 50 OR score >= t"""


def priority(spark: SparkSession, d: str) -> DataFrame:
    return S.priority_pick(detections(spark, d).withColumn("elapsed", F.col("id") % 1009), ["slide"], "score", "elapsed", "id", 10).select("slide", "id", "priority", "rank")


PRIORITY_SQL = f"""WITH b AS (SELECT *, id % 1009 AS e FROM ({DETECTIONS})), m AS (SELECT slide, min(score) AS s0, max(score) AS s1, min(e) AS e0, max(e) AS e1 FROM b GROUP BY slide),
p AS (SELECT slide, id, round(0.6 * CASE WHEN s1 > s0 THEN (score - s0) / (s1 - s0) ELSE 0.0 END + 0.4 * (1.0 - CASE WHEN e1 > e0 THEN (e - e0) / (e1 - e0)::DOUBLE ELSE 0.0 END), 6) AS priority FROM b JOIN m USING (slide))
SELECT * REPLACE (rank::INT AS rank) FROM (SELECT slide, id, priority, row_number() OVER (PARTITION BY slide ORDER BY priority DESC, id) AS rank FROM p) WHERE rank <= 10"""


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return S.tile_local(detections(spark, d), 1000).select("id", "tile_x", "tile_y", "x1", "y1", "x2", "y2")


TILES_SQL = f"SELECT id, tx AS tile_x, ty AS tile_y, x1 - tx AS x1, y1 - ty AS y1, x2 - tx AS x2, y2 - ty AS y2 FROM (SELECT *, (floor(x1 / 1000.0) * 1000)::BIGINT AS tx, (floor(y1 / 1000.0) * 1000)::BIGINT AS ty FROM ({DETECTIONS}))"


def tiles_back(spark: SparkSession, d: str) -> DataFrame:
    return S.tile_global(tiles(spark, d))


TILES_BACK_SQL = f"SELECT id, x1, y1, x2, y2 FROM ({DETECTIONS})"


def crops(spark: SparkSession, d: str) -> DataFrame:
    w = G.crop_window(G.box(), F.lit(PLANE), F.lit(PLANE))
    m = G.margin_window(G.box(), F.lit(PLANE), F.lit(PLANE), 16)
    t = G.token_window(F.floor(F.col("x1") / 14), F.floor(F.col("y1") / 14), 224)
    return detections(spark, d).select("id", *[w[c].alias(c) for c in ("left", "top", "side")], *[m[c].cast("long").alias(f"m_{c}") for c in ("left", "top", "right", "bottom")], t["left"].cast("long").alias("t_left"), t["top"].cast("long").alias("t_top"))


CROPS_SQL = f"""WITH s AS (SELECT *, least(trunc(greatest(x2 - x1, y2 - y1) * 1.2::DOUBLE)::INT, {PLANE}) AS side FROM ({DETECTIONS}))
SELECT id, greatest(0, least(trunc((x1 + x2) / 2::DOUBLE - side / 2::DOUBLE)::INT, {PLANE} - side)) AS "left", greatest(0, least(trunc((y1 + y2) / 2::DOUBLE - side / 2::DOUBLE)::INT, {PLANE} - side)) AS top, side,
greatest(x1 - 16, 0) AS m_left, greatest(y1 - 16, 0) AS m_top, least(x2 + 16, {PLANE}) AS m_right, least(y2 + 16, {PLANE}) AS m_bottom, greatest(x1 // 14 * 14 + 7 - 112, 0) AS t_left, greatest(y1 // 14 * 14 + 7 - 112, 0) AS t_top FROM s"""


def density(spark: SparkSession, d: str) -> DataFrame:
    points = detections(spark, d).select("slide", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return S.median_density_window(S.density_windows(points, "slide", 2000, 2), "slide")


DENSITY_SQL = f"""WITH p AS (SELECT slide, x1 AS x, y1 AS y FROM ({DETECTIONS})), g AS (SELECT unnest(range(0, 20)) AS k),
c AS (SELECT slide, i.k * 500 AS x, j.k * 500 AS y, count(*) AS n FROM p JOIN g i ON i.k * 500 <= p.x AND p.x < i.k * 500 + 2000 JOIN g j ON j.k * 500 <= p.y AND p.y < j.k * 500 + 2000 GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY n, x, y) - 1 AS r, count(*) OVER (PARTITION BY slide) AS c FROM c)
SELECT slide, x, y, n FROM r WHERE r = least(greatest(c // 2, floor(c * 0.6::DOUBLE)), c - 1)"""


def nms(spark: SparkSession, d: str) -> DataFrame:
    """Greedy suppression per slide."""
    return N.suppress(detections(spark, d).select("slide", "id", "score", "x1", "y1", "x2", "y2"), ["slide"], "id", "score", 0.1).select("slide", "id", "kept")


def refined_boxes(spark: SparkSession, d: str) -> DataFrame:
    """kept boxes with a score of 0.4 at least."""
    return N.refined(detections(spark, d), ["slide"], "id", "score", 0.1, 0.4).select("slide", "id", F.col("x1").cast("long").alias("x1"), F.col("y1").cast("long").alias("y1"), "score")


#: Rounds over the overlaps: a box without an undecided better one stays (1), one with a better one that stays goes (2).
NMS_SQL = f"""WITH RECURSIVE d AS (SELECT slide, id, score, x1, y1, x2, y2 FROM ({DETECTIONS})),
b AS (SELECT *, row_number() OVER (ORDER BY slide, score DESC, id, x1, y1, x2, y2) AS r FROM (SELECT DISTINCT * FROM d)),
c AS (SELECT *, unnest(range(x1 // 200, x2 // 200 + 1)) AS i FROM b), e AS (SELECT *, unnest(range(y1 // 200, y2 // 200 + 1)) AS j FROM c),
o AS (SELECT p.r AS better, q.r AS worse, greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0) AS inner_area,
 (p.x2 - p.x1) * (p.y2 - p.y1) + (q.x2 - q.x1) * (q.y2 - q.y1) AS areas FROM e p JOIN e q ON p.slide = q.slide AND p.i = q.i AND p.j = q.j AND p.r < q.r),
pairs AS (SELECT DISTINCT better, worse FROM o WHERE inner_area > 0.1 * (areas - inner_area)),
state AS (
 SELECT 0 AS round, r, 0 AS s FROM b
 UNION ALL
 SELECT n.round + 1, n.r, CASE WHEN n.s > 0 THEN n.s WHEN coalesce(p.any_stays, 0) = 1 THEN 2 WHEN coalesce(p.all_gone, 1) = 1 THEN 1 ELSE 0 END
 FROM state n LEFT JOIN (SELECT worse, max(CASE WHEN t.s = 1 THEN 1 ELSE 0 END) AS any_stays, min(CASE WHEN t.s = 2 THEN 1 ELSE 0 END) AS all_gone
  FROM pairs JOIN state t ON t.r = pairs.better GROUP BY worse) p ON p.worse = n.r
 WHERE EXISTS (SELECT 1 FROM state u WHERE u.s = 0)
)
SELECT d.slide, d.id, s = 1 AS kept FROM d JOIN b USING (slide, id, score, x1, y1, x2, y2) JOIN state USING (r) WHERE round = (SELECT max(round) FROM state)"""


REFINED_SQL = NMS_SQL.replace("SELECT d.slide, d.id, s = 1 AS kept FROM", "SELECT d.slide, d.id, d.x1::BIGINT AS x1, d.y1::BIGINT AS y1, d.score FROM") + " AND s = 1 AND d.score >= 0.4"


def detection_scores(spark: SparkSession, d: str) -> DataFrame:
    """TP, FP, FN of each slide from return flags, rolled up by nation and region."""
    rows = detections(spark, d)
    count = lambda c: F.sum(c.cast("long"))
    flag, kept = F.col("l_returnflag"), F.col("score") >= 0.4
    counts = rows.groupBy("slide").agg(count(kept & (flag != "N")).alias("tp"), count(kept & (flag == "N")).alias("fp"), count(~kept & (flag != "N")).alias("fn"))
    taxa = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("slide"), F.col("n_name").alias("species"), F.col("r_name").alias("family"))
    named = counts.join(taxa, "slide", "left").withColumn("species", F.coalesce("species", F.lit("Unknown"))).withColumn("family", F.coalesce("family", F.lit("Unknown")))
    return levels(named, ((), ("family",), ("species",)), *micro_scores(F.col("tp"), F.col("fp"), F.col("fn")))


SCORES_SQL = f"""WITH c AS (SELECT slide, count(*) FILTER (WHERE score >= 0.4 AND l_returnflag <> 'N') AS tp, count(*) FILTER (WHERE score >= 0.4 AND l_returnflag = 'N') AS fp, count(*) FILTER (WHERE score < 0.4 AND l_returnflag <> 'N') AS fn FROM ({DETECTIONS}) GROUP BY slide),
n AS (SELECT c.*, coalesce(n_name, 'Unknown') AS species, coalesce(r_name, 'Unknown') AS family FROM c LEFT JOIN nation ON slide = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT family, species, CASE WHEN grouping(family) = 0 THEN 'family' WHEN grouping(species) = 0 THEN 'species' ELSE 'all' END AS level, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM n GROUP BY GROUPING SETS ((), (family), (species))),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS r FROM g)
SELECT family, species, level, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM p"""

QUERIES = {
    "f17_region_exclusion": excluded,
    "j2_first_violation": violations,
    "j3_region_overlaps": region_overlaps,
    "f11_iqr_size_filter": size_filter,
    "f1_detection_gates": gates,
    "f12_distance_gate": distance_window,
    "f6_confidence_prefilter": confidence_prefilter,
    "o4_priority_pick": priority,
    "k3_tile_local": tiles,
    "s5_tile_global": tiles_back,
    "p2_crop_windows": crops,
    "g9_median_density": density,
    "w8_greedy_nms": nms,
    "f7_refined_boxes": refined_boxes,
    "e15_split_checks": split_checks,
    "a13_detection_scores": detection_scores,
}
ORACLES = {
    "f17_region_exclusion": EXCLUDED_SQL,
    "j2_first_violation": VIOLATIONS_SQL,
    "j3_region_overlaps": OVERLAPS_SQL,
    "f11_iqr_size_filter": SIZE_SQL,
    "f1_detection_gates": GATES_SQL,
    "f12_distance_gate": DISTANCE_SQL,
    "f6_confidence_prefilter": PREFILTER_SQL,
    "o4_priority_pick": PRIORITY_SQL,
    "k3_tile_local": TILES_SQL,
    "s5_tile_global": TILES_BACK_SQL,
    "p2_crop_windows": CROPS_SQL,
    "g9_median_density": DENSITY_SQL,
    "a13_detection_scores": SCORES_SQL,
    "w8_greedy_nms": NMS_SQL,
    "f7_refined_boxes": REFINED_SQL,
    "e15_split_checks": CHECKS_SQL,
}
