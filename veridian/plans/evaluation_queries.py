"""Query construction and evaluation within and across regions over ``embeddings``, with their DuckDB SQL.

The corpus is that of :mod:`vector_queries`; a region is an origin, and the truth matrix of regions and species holds
the pairs of label and origin whose sum is no multiple of three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridian.operators import evaluation as E
from veridian.operators import ranking as R
from veridian.plans import vector_queries as V

FULL = ["slide", "species", "origin", "n_grains"]


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return V.corpus(spark, d).select("slide", F.col("label").alias("species"), "origin", F.col("vec_id").alias("key"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    slides = _corpus(spark, d).select("slide").distinct()
    vector = F.array(F.col("slide").cast("double")).alias("emb")
    image, text = slides.filter("slide % 2 = 0").select("slide", vector), slides.filter("slide % 5 < 3").select("slide", vector)
    return E.build_queries(_corpus(spark, d), slides.filter("slide % 3 <> 1"), image, text, slides.filter("slide % 11 = 5"))


def query_construction(spark: SparkSession, d: str) -> DataFrame:
    return _queries(spark, d).select(*FULL, F.col("img_emb").isNotNull().alias("has_image"), F.col("txt_emb").isNotNull().alias("has_text"))


QUERY_SQL = f"""SELECT slide, species, origin, n_grains, slide % 2 = 0 AS has_image, slide % 5 < 3 AS has_text FROM (
SELECT slide, arg_min(label, vec_id) AS species, arg_min(origin, vec_id) AS origin, count(*) AS n_grains FROM ({V.CORPUS}) GROUP BY slide)
WHERE slide % 3 <> 1 AND slide % 11 <> 5 AND (slide % 2 = 0 OR slide % 5 < 3)"""


def _siblings(spark: SparkSession, d: str) -> DataFrame:
    """Slides 2k and 2k + 1 are siblings, but for every fourth pair."""
    slides = _corpus(spark, d).select("slide").distinct().filter("slide % 8 < 6")
    other = slides.withColumn("sibling", F.col("slide").bitwiseXOR(F.lit(1)))
    return other.join(slides.select(F.col("slide").alias("sibling")), "sibling", "left_semi")


def sibling_dedup(spark: SparkSession, d: str) -> DataFrame:
    active = E.active_queries(_queries(spark, d), "image")
    both = E.sibling_representatives(active.union(_queries(spark, d).filter("img_emb is null")), _siblings(spark, d), "combined", "full")
    return both.select(*FULL)


SIBLING_SQL = f"""WITH q AS ({QUERY_SQL}), s AS (SELECT DISTINCT slide FROM ({V.CORPUS})),
k AS (SELECT q.*, CASE WHEN q.slide % 8 < 6 AND xor(q.slide, 1) IN (SELECT slide FROM s) THEN q.slide // 2 * 2 ELSE q.slide * 1000 + 1 END AS g FROM q)
SELECT slide, species, origin, n_grains FROM k WHERE slide = (SELECT min(slide) FROM k x WHERE x.g = k.g)"""


def text_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Text queries in both kinds of mode; relevant rows are those of the species on other slides (full) or in other regions."""
    q = E.active_queries(_queries(spark, d), "text")
    c = _corpus(spark, d).select(F.col("slide").alias("s"), F.col("species").alias("sp"), F.col("origin").alias("o"))
    out = None
    for mode, other in (("full", F.col("slide") != F.col("s")), ("cross_regional", F.col("origin") != F.col("o"))):
        relevant = q.join(c, F.col("species") == F.col("sp")).groupBy("slide").agg(F.count_if(other).alias("n_relevant"))
        one = E.text_representatives(q, relevant, mode).select(*FULL, F.lit(mode).alias("mode"))
        out = one if out is None else out.union(one)
    return out


TEXT_SQL = f"""WITH c AS ({V.CORPUS}), q AS (SELECT * FROM ({QUERY_SQL}) WHERE has_text),
r AS (SELECT q.slide, q.species, q.origin, q.n_grains, count(*) FILTER (WHERE c.slide <> q.slide) AS f, count(*) FILTER (WHERE c.origin <> q.origin) AS x FROM q JOIN c ON c.label = q.species GROUP BY ALL)
SELECT slide, species, origin, n_grains, 'full' AS mode FROM r WHERE slide IN (SELECT min(slide) FROM r WHERE f > 0 GROUP BY species) UNION ALL
SELECT slide, species, origin, n_grains, 'cross_regional' AS mode FROM r WHERE slide IN (SELECT min(slide) FROM r WHERE x > 0 GROUP BY species, origin)"""


def pools(spark: SparkSession, d: str) -> DataFrame:
    """A25 in mode full: a query meets neither its slide nor its siblings."""
    q = _queries(spark, d).select(F.col("slide").alias("query"), F.col("species").alias("target"), F.lit(0.0).alias("zero"))
    # slides by queries: the corpus itself meets no query
    rows = E.slides_of(_corpus(spark, d)).join(q, F.lit(True))
    pair = _siblings(spark, d).select(F.col("slide").alias("query"), F.col("sibling").alias("slide"), F.lit(True).alias("is_sibling"))
    rows = rows.join(pair, ["query", "slide"], "left")
    kept = R.exclusion("full", F.col("query"), F.col("slide"), F.lit(0), F.lit(0), F.coalesce("is_sibling", F.lit(False)))
    pool = E.pool_composition(rows.select("query", "slide", "species", "n", "target", (~kept).alias("excluded")), ["query"])
    names = lambda c: F.array_join(F.transform(c, lambda s: s.cast("string")), ",")
    shown = F.array_join(F.transform("pool_composition", lambda r: F.concat_ws(":", r["slide"], r["species"], r["n"], r["is_target"])), ",")
    return pool.select("query", "n_corpus_searched", "n_excluded", "n_probed_slides", names("excluded_slides").alias("excluded_slides"), names("target_slides").alias("target_slides"), shown.alias("pool"))


POOL_SQL = f"""WITH c AS ({V.CORPUS}), s AS (SELECT slide, arg_min(label, vec_id) AS species, count(*) AS n FROM c GROUP BY slide), q AS (SELECT slide AS query, species AS target FROM ({QUERY_SQL})),
p AS (SELECT q.*, s.*, s.slide = query OR (query % 8 < 6 AND s.slide = xor(query, 1)) AS x FROM q CROSS JOIN s)
SELECT query, coalesce(sum(n) FILTER (WHERE NOT x), 0)::BIGINT AS n_corpus_searched, coalesce(sum(n) FILTER (WHERE x), 0)::BIGINT AS n_excluded, count(*) FILTER (WHERE NOT x) AS n_probed_slides,
coalesce(string_agg(slide::VARCHAR, ',' ORDER BY slide) FILTER (WHERE x), '') AS excluded_slides, coalesce(string_agg(slide::VARCHAR, ',' ORDER BY slide) FILTER (WHERE NOT x AND species = target), '') AS target_slides,
coalesce(string_agg(slide || ':' || species || ':' || n || ':' || (species = target), ',' ORDER BY slide) FILTER (WHERE NOT x), '') AS pool FROM p GROUP BY query"""


def relevant_means(spark: SparkSession, d: str) -> DataFrame:
    return E.mean_relevant(V.ranking_cross(spark, d), "q_label")


RELEVANT_SQL = f"SELECT q_label, trunc(avg(total))::INT AS mean_relevant FROM ({V.METRICS_CROSS_SQL}) GROUP BY q_label"


def previews(spark: SparkSession, d: str) -> DataFrame:
    rows = R.ranked(V._scored(spark, d, "all"), ["q_label", "q_origin"], "vec_id").withColumn("species", F.col("label"))
    p = E.preview(rows, ["q_label", "q_origin"])
    return p.select("q_label", "q_origin", F.array_join(F.transform("top_species", lambda s: s.cast("string")), ",").alias("species"), F.element_at("top_scores", 1).alias("best"), F.element_at("top_scores", -1).alias("last"))


PREVIEW_SQL = f"""WITH c AS ({V.CORPUS}), q AS (SELECT label AS q_label, origin AS q_origin, {V.MEAN} AS q FROM c GROUP BY ALL), s AS (SELECT q_label, q_origin, vec_id, label, round(list_dot_product(embedding, q), 9) AS s FROM c CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY q_label, q_origin ORDER BY s DESC, vec_id) AS r FROM s)
SELECT q_label, q_origin, string_agg(label::VARCHAR, ',' ORDER BY r) AS species, round(max(s), 5) AS best, round(min(s), 5) AS last FROM r WHERE r <= 10 GROUP BY ALL"""


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = V.corpus(spark, d).filter("(label + origin) % 3 > 0")
    return rows.select(F.concat(F.lit("R"), "origin").alias("dataset"), F.concat(F.lit("Sp "), "label").alias("species")).distinct()


MATRIX = f"SELECT DISTINCT 'R' || origin AS dataset, 'sp ' || label AS species FROM ({V.CORPUS}) WHERE (label + origin) % 3 > 0"


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    return E.region_overlap(_matrix(spark, d))


OVERLAP_SQL = f"""WITH m AS ({MATRIX}), n AS (SELECT DISTINCT dataset FROM m), p AS (SELECT a.dataset AS source, b.dataset AS target, s.species FROM n a CROSS JOIN n b CROSS JOIN (SELECT DISTINCT species FROM m) s WHERE a.dataset <> b.dataset),
f AS (SELECT p.*, EXISTS (SELECT 1 FROM m WHERE dataset = source AND m.species = p.species) AS i, EXISTS (SELECT 1 FROM m WHERE dataset = target AND m.species = p.species) AS o FROM p)
SELECT source, target, species, CASE WHEN i AND o THEN 'both' WHEN i THEN 'train only' ELSE 'test only' END AS side FROM f WHERE i OR o"""


def trained_on(spark: SparkSession, d: str) -> DataFrame:
    m, out = _matrix(spark, d), None
    for region in ("R0", "R3", "all", "nowhere"):
        one = E.training_species(m, region).withColumn("region", F.lit(region))
        out = one if out is None else out.union(one)
    return out


TRAINED_SQL = f"WITH m AS ({MATRIX}) SELECT species, dataset AS region FROM m WHERE dataset IN ('R0', 'R3') UNION ALL SELECT DISTINCT species, 'all' AS region FROM m"


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    p = V.predictions(spark, d)
    p = p.select("vec_id", "label", "pred", "in5", F.concat(F.lit("R"), F.col("vec_id") % 4).alias("target"), F.concat(F.lit("SP "), "label").alias("species"))
    return E.overlap_flags(p, overlaps(spark, d), "R0")


def overlap_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("vec_id", "target", "in_overlap")


FLAGGED = f"""{V.PREDICTIONS}, x AS (SELECT p.*, 'R' || (vec_id % 4) AS target, vec_id % 4 = 0 OR ((label + 0) % 3 > 0 AND (label + vec_id % 4) % 3 > 0) AS in_overlap FROM p)"""
FLAGS_SQL = f"{FLAGGED} SELECT vec_id, target, in_overlap FROM x"


def subset_scores(spark: SparkSession, d: str) -> DataFrame:
    return E.subset_metrics(_flagged(spark, d)).fillna({"note": ""})


def _subset(where: str, name: str) -> str:
    body = V.CLASSIFICATION_SQL[len(V.PREDICTIONS) :].replace("FROM p GROUP BY label)", f"FROM {name} GROUP BY label)").replace("FROM p GROUP BY pred)", f"FROM {name} GROUP BY pred)").replace("FROM p) AS top5", f"FROM {name}) AS top5")
    return f"SELECT *, '{where}' AS subset, '' AS note FROM (WITH {body.lstrip().lstrip(',')})"


SUBSET_SQL = f"{FLAGGED}, y AS (SELECT * FROM x WHERE in_overlap) {_subset('all', 'x')} UNION ALL {_subset('overlap', 'y')}"


def targets(spark: SparkSession, d: str) -> DataFrame:
    m, out = _matrix(spark, d), None
    o = E.region_overlap(m)
    for source in ("R0", "R1"):
        one = E.evaluation_targets(o, m, source).withColumn("source", F.lit(source))
        out = one if out is None else out.union(one)
    return out


TARGETS_SQL = f"""WITH o AS ({OVERLAP_SQL}) SELECT source, target, 1 AS position, count(*)::VARCHAR AS overlap_taxa FROM o WHERE source IN ('R0', 'R1') AND side = 'both' GROUP BY ALL
UNION ALL SELECT DISTINCT source, source AS target, 0 AS position, 'all' AS overlap_taxa FROM o WHERE source IN ('R0', 'R1')"""

QUERIES = {
    "e4_query_construction": query_construction,
    "e5_sibling_dedup": sibling_dedup,
    "e6_text_dedup": text_dedup,
    "a25_pool_composition": pools,
    "a30_mean_relevant": relevant_means,
    "o10_preview": previews,
    "u5_region_overlap": overlaps,
    "e14_training_species": trained_on,
    "f23_overlap_flags": overlap_flags,
    "e12_subset_metrics": subset_scores,
    "e13_evaluation_targets": targets,
}
ORACLES = {
    "e4_query_construction": QUERY_SQL,
    "e5_sibling_dedup": SIBLING_SQL,
    "e6_text_dedup": TEXT_SQL,
    "a25_pool_composition": POOL_SQL,
    "a30_mean_relevant": RELEVANT_SQL,
    "o10_preview": PREVIEW_SQL,
    "u5_region_overlap": OVERLAP_SQL,
    "e14_training_species": TRAINED_SQL,
    "f23_overlap_flags": FLAGS_SQL,
    "e12_subset_metrics": SUBSET_SQL,
    "e13_evaluation_targets": TARGETS_SQL,
}
