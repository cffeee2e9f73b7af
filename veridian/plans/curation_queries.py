"""Curation, the training index and readiness over the driver tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridian.operators import curation as C
from veridian.plans import box_queries as B
from veridian.plans import table_queries as T
from veridian.sources.tables import read


def categories(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    named = F.when(kind == "click", "Test Region").when(kind == "purchase", "Pollen").when(kind != "view", kind)
    return C.category_counts(read(spark, d, "events").select("user_id", named.alias("class")), "user_id")


CATEGORIES_SQL = """SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS test_regions, count(*) FILTER (WHERE event_type = 'purchase') AS classified,
count(*) FILTER (WHERE event_type = 'view') AS unclassified, count(*) FILTER (WHERE event_type NOT IN ('click', 'purchase', 'view')) AS other FROM events GROUP BY user_id"""


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.class_counts(read(spark, d, "documents"), ["lang"], "source").withColumn("top", F.array_join("top", ","))


CLASS_COUNTS_SQL = """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS r FROM c)
SELECT lang, count(*) AS n_classes, sum(n)::BIGINT AS n, string_agg(source || ':' || n, ',' ORDER BY r) FILTER (WHERE r <= 10) AS top FROM r GROUP BY lang"""


def kept_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = B.detections(spark, d)
    return C.kept_boxes(b, b.filter("l_returnflag <> 'R'"), "slide")


KEPT_SQL = f"""SELECT slide, x1, y1, x2, y2, CASE WHEN bool_or(l_returnflag <> 'R') THEN 'preserved' ELSE 'removed' END AS status FROM ({B.DETECTIONS}) GROUP BY ALL"""


def test_sets(spark: SparkSession, d: str) -> DataFrame:
    return C.all_regions(B.regions(spark, d), B.regions(spark, d, 250))


SETS_SQL = f"SELECT DISTINCT *, 'TS1' AS test_set FROM ({B._regions()}) UNION ALL SELECT DISTINCT *, 'TS2' AS test_set FROM ({B._regions(250)})"


def substring_matches(spark: SparkSession, d: str) -> DataFrame:
    """Customers' names by country number inside longer names of other customers."""
    confirmed = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit("_pyramid.geojson")).alias("file"))
    raw = read(spark, d, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("slide_s"), "s_suppkey", F.lit("_test_region.geojson")).alias("file"))
    return C.match_by_substring(confirmed, raw)


SUBSTRING_SQL = """WITH c AS (SELECT 's' || s_suppkey AS base FROM supplier), r AS (SELECT 'slide_s' || s_suppkey || '_test_region.geojson' AS raw FROM supplier WHERE s_acctbal > 0)
SELECT base || '_pyramid.geojson' AS confirmed, min(raw) AS raw, base || '_curated.geojson' AS output FROM c LEFT JOIN r ON contains(raw, base) GROUP BY base"""


def masks(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("mask"), (F.col("o_orderkey") % 1000).alias("area"), F.col("o_totalprice").alias("score"))
    return C.pick_mask(o, ["o_custkey"], 300, 600)


MASKS_SQL = """SELECT o_custkey, mask, area, score, ok AS in_range FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ok DESC, score DESC, mask) AS r FROM (
SELECT o_custkey, o_orderkey AS mask, o_orderkey % 1000 AS area, o_totalprice AS score, o_orderkey % 1000 BETWEEN 300 AND 600 AS ok FROM orders)) WHERE r = 1"""


def decoded(spark: SparkSession, d: str) -> DataFrame:
    names = read(spark, d, "nation").filter("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("name"))
    return C.decode_labels(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", names).select("c_custkey", "class_name")


DECODED_SQL = "SELECT c_custkey, coalesce(n_name, 'class_' || c_nationkey) AS class_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 4 > 0"


def flattened(spark: SparkSession, d: str) -> DataFrame:
    """Sources' documents by language as one map of maps, and back to rows."""
    n = read(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    inner = n.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    outer = inner.agg(F.map_from_entries(F.collect_list(F.struct("source", "m"))).alias("tree"))
    return C.flatten_maps(outer, "tree", "source", "lang", "n")


FLAT_SQL = "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL"


def _captions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    box = [n.alias("x1"), (n + 1).alias("y1"), (n + F.length("source")).alias("x2"), (n + 9).alias("y2")]
    return read(spark, d, "documents").select(F.col("lang").alias("dataset"), F.col("source").alias("slide"), F.col("doc_id").alias("id"), *box)


def training(spark: SparkSession, d: str) -> DataFrame:
    """Languages are datasets, sources are slides; every seventh species is unknown, every third path is missing."""
    slides = read(spark, d, "documents").select(F.col("source").alias("slide"), F.substring("source", 4, 9).cast("int").alias("k")).distinct()
    species = slides.select("slide", F.when(F.col("k") % 7 == 3, "UNKNOWN").otherwise(F.concat(F.lit("Sp "), "k")).alias("species"))
    paths = slides.filter("k % 3 > 0").select("slide", F.concat(F.lit("/wsi/"), "slide", F.lit(".tif")).alias("path"))
    splits = T.split(spark, d).select(F.col("source").alias("slide"), "split", F.col("doc_id").alias("sample_id"))
    return C.training_index(splits, _captions(spark, d), species, paths, "train", ["fr", "en"])


TRAINING_SQL = f"""WITH s AS ({T.SPLIT_SQL}), d AS (SELECT *, substr(source, 4)::INT AS k, max(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS fr FROM documents)
SELECT d.doc_id AS id, d.source AS slide, n_chars::INT AS x1, (n_chars + 1)::INT AS y1, (n_chars + length(d.source))::INT AS x2, (n_chars + 9)::INT AS y2, 'Sp ' || k AS species, CASE WHEN k % 3 > 0 THEN '/wsi/' || d.source || '.tif' END AS path
FROM d JOIN s ON s.doc_id = d.doc_id AND s.source = d.source WHERE s.split = 'train' AND k % 7 <> 3 AND d.lang = CASE WHEN fr = 1 THEN 'fr' ELSE 'en' END"""


def common(spark: SparkSession, d: str) -> DataFrame:
    docs, out = read(spark, d, "documents"), None
    for a, b in (("de", "fr"), ("en", "es")):
        one = C.common_slides(docs, "lang", "source", a, b).select("source", F.lit(f"{a}-{b}").alias("models"))
        out = one if out is None else out.union(one)
    return out


COMMON_SQL = " UNION ALL ".join(f"SELECT source, '{a}-{b}' AS models FROM (SELECT source FROM documents WHERE lang = '{a}' INTERSECT SELECT source FROM documents WHERE lang = '{b}')" for a, b in (("de", "fr"), ("en", "es")))


def ready(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("slide"), "s_acctbal", "s_suppkey")
    return C.readiness(s, s.filter("s_acctbal > 0"), s.filter("s_suppkey % 11 = 0").select("slide"))


READY_SQL = """WITH s AS (SELECT 's' || s_suppkey AS slide, s_acctbal, s_suppkey FROM supplier)
SELECT slide, CASE WHEN s_acctbal <= 0 THEN 'no anchor' WHEN EXISTS (SELECT 1 FROM s e WHERE e.s_suppkey % 11 = 0 AND starts_with(e.slide, s.slide)) THEN 'excluded' ELSE 'ready' END AS status FROM s"""


def inputs(spark: SparkSession, d: str) -> DataFrame:
    """customers with and without orders."""
    have, missing = C.with_inputs(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return have.withColumn("input", F.lit(True)).union(missing.withColumn("input", F.lit(False)))


INPUTS_SQL = "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS input FROM customer"

GROUPS = {"AFRICA": ["a"], "ASIA": ["b", "c"], "EUROPE": ["a", "b", "c", "d"]}


def expanded(spark: SparkSession, d: str) -> DataFrame:
    return C.expand_regions(read(spark, d, "region"), "r_name", GROUPS).select("r_regionkey", "dataset")


EXPANDED_SQL = f"SELECT r_regionkey, unnest(CASE r_name {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in GROUPS.items())} ELSE [] END) AS dataset FROM region"


def bins(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(C.freedman_diaconis(F.col("value"), 10).alias("bins"))


BINS_SQL = """SELECT event_type, greatest(10, coalesce(floor((max(value) - min(value)) / nullif(2.0 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / cbrt(count(value)), 0)), 10))::INT AS bins FROM events GROUP BY event_type"""

QUERIES = {
    "a14_category_counts": categories, "a15_class_counts": class_counts, "u3_kept_boxes": kept_boxes, "u2_test_sets": test_sets, "j11_substring_matches": substring_matches,
    "o8_mask_pick": masks, "p9_decoded_labels": decoded, "n6_flattened_maps": flattened, "j9_training_index": training, "j5_common_slides": common,
    "f20_readiness": ready, "f21_inputs": inputs, "f22_expanded_regions": expanded, "g19_bins": bins,
}
ORACLES = {
    "a14_category_counts": CATEGORIES_SQL, "a15_class_counts": CLASS_COUNTS_SQL, "u3_kept_boxes": KEPT_SQL, "u2_test_sets": SETS_SQL, "j11_substring_matches": SUBSTRING_SQL,
    "o8_mask_pick": MASKS_SQL, "p9_decoded_labels": DECODED_SQL, "n6_flattened_maps": FLAT_SQL, "j9_training_index": TRAINING_SQL, "j5_common_slides": COMMON_SQL,
    "f20_readiness": READY_SQL, "f21_inputs": INPUTS_SQL, "f22_expanded_regions": EXPANDED_SQL, "g19_bins": BINS_SQL,
}
