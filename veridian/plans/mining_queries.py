"""Tokens, similarity maps and masks over the driver tables, with their DuckDB SQL.

Token = vec_id on slide vec_id mod 5; a similarity map is a vector's 64 components on a grid of eight by eight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.functions import geometry as G
from veridian.functions.vectors import cosine, l2_normalized
from veridian.operators import miner
from veridian.operators import mining as M
from veridian.operators import pixels as P
from veridian.operators import ranking as R
from veridian.operators import sampling as S
from veridian.operators import tables as T
from veridian.operators.models import classifier_gate
from veridian.operators.text_stats import running_stats
from veridian.plans import box_queries as B
from veridian.plans import vector_queries as V
from veridian.sources.readers import tile_grid
from veridian.session import scratch
from veridian.sources.tables import read
from veridian.sources.tiles import read_tiles, write_lines


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return V.corpus(spark, d).select((F.col("vec_id") % 5).cast("int").alias("slide"), F.col("vec_id").cast("int").alias("token"), F.col("embedding").alias("emb"), "label")


def _query(spark: SparkSession, d: str) -> DataFrame:
    return R.class_means(V.corpus(spark, d).filter("label < 3"), ["label"], V.SIZE).select(F.col("label").alias("query_id"), "query")


def token_pool(spark: SparkSession, d: str) -> DataFrame:
    """The tokens of each customer's list, with their place in it."""
    slide, k = F.col("c_custkey") % 5, F.col("c_custkey")
    objects = read(spark, d, "customer").select("c_custkey", slide.cast("int").alias("slide"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((k * 7 + i * 13) % 60 * 5 + slide).cast("int")).alias("token_idx"))
    return M.token_pool(objects, _tokens(spark, d), "c_custkey").select("c_custkey", "place", "token", F.round(F.element_at("emb", 1), 6).alias("e1"))


POOL_SQL = """WITH o AS (SELECT c_custkey, i::INT AS place, ((c_custkey * 7 + i * 13) % 60 * 5 + c_custkey % 5)::INT AS token FROM customer, range(4) t(i))
SELECT c_custkey, place, token, round(embedding[1]::DOUBLE, 6) AS e1 FROM o JOIN embeddings ON vec_id = token"""


#: Limits that the small maps reach: flushes of 4 objects, windows of 3 steps, a reservoir of 20.
RULES = miner.Rules(percentile=20.0, mask_area=(50.0, 1500.0), least_confidence=0.83, cluster_confidence=0.86, cluster_size=20, flush_every=4, overlap=0.02, window=3, slope=0.3, patience=2)


def propose(x: int, y: int) -> tuple[int, int, int, int, int]:
    """A box mask around a pixel whose size depends on the place."""
    half = 7 + 7 * ((x // 14 * 7 + y // 14 * 11) % 4)
    return x - half, y - half, x + half, y + half, (2 * half + 1) ** 2


def mined(spark: SparkSession, d: str) -> DataFrame:
    """Label and thousand of vec_id as slide, vectors moved towards their slide's mean as tokens on a grid eight wide."""
    rows = V.corpus(spark, d).withColumn("slide", F.concat_ws("-", "label", F.floor(F.col("vec_id") / 1000)))
    means = R.class_means(rows, ["slide"], V.SIZE).select("slide", l2_normalized(F.col("query")).alias("query"))
    at = F.row_number().over(W.partitionBy("slide").orderBy("vec_id")) - 1
    tokens = rows.withColumn("_at", at).join(means, "slide").select(
        "slide", F.col("vec_id").alias("token"), (F.col("_at") % 8).alias("tok_x"), F.floor(F.col("_at") / 8).cast("int").alias("tok_y"), F.zip_with("embedding", "query", lambda a, b: a + b).alias("emb"), "query"
    )
    tokens = tokens.withColumn("w", F.greatest(F.round(cosine(F.col("emb"), F.col("query")), 9), F.lit(0.0)))
    return miner.mine(tokens, means, propose, RULES)


def grid_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Tokens under detections' corners on a grid of 25 by 20 tokens of 14 pixels."""
    points = B.detections(spark, d).filter("x1 < 600 and y1 < 500").select((F.col("slide") % 5).alias("slide"), "id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    tokens = _tokens(spark, d).select("slide", "token", F.floor(F.col("token") / 5 % 25).alias("tok_x"), F.floor(F.col("token") / 125).alias("tok_y"))
    return M.grid_lookup(points, tokens).select("slide", "id", "token")


LOOKUP_SQL = f"""WITH p AS (SELECT DISTINCT slide % 5 AS slide, id, x1 // 14 AS tx, y1 // 14 AS ty FROM ({B.DETECTIONS}) WHERE x1 < 600 AND y1 < 500)
SELECT slide, id, vec_id::INT AS token FROM p JOIN embeddings ON vec_id % 5 = slide AND (vec_id // 5) % 25 = tx AND vec_id // 125 = ty"""


def attention(spark: SparkSession, d: str) -> DataFrame:
    """V7: tokens of each label pooled by three queries."""
    out = M.attention_pool(_tokens(spark, d), _query(spark, d), "label", V.SIZE)
    return out.select("label", F.round("attention", 6).alias("attention"), F.round(F.element_at("pooled", 1), 6).alias("first"), F.round(F.element_at("pooled", 64), 6).alias("last"))


QUERY = f"q AS (SELECT label AS query_id, {V.MEAN} AS q FROM c WHERE label < 3 GROUP BY label)"
ATTENTION_SQL = f"""WITH c AS ({V.CORPUS}), {QUERY}, p AS (SELECT c.label, query_id, embedding, list_dot_product(embedding, q) / 8.0 AS l FROM c CROSS JOIN q),
w AS (SELECT label, embedding, exp(l - max(l) OVER k) / sum(exp(l)) OVER k * exp(max(l) OVER k) AS w FROM p WINDOW k AS (PARTITION BY label, query_id)),
s AS (SELECT label, [{", ".join(f"sum(w * embedding[{i + 1}]) / 3" for i in range(V.SIZE))}] AS v FROM w GROUP BY label), m AS (SELECT [{", ".join(f"avg(q[{i + 1}])" for i in range(V.SIZE))}] AS m FROM q)
SELECT label, round(list_dot_product(v, m) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(m, m)) + 1e-8)), 6) AS attention, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-8), 6) AS first, round(v[64] / (sqrt(list_dot_product(v, v)) + 1e-8), 6) AS last FROM s CROSS JOIN m"""


def top_tokens(spark: SparkSession, d: str) -> DataFrame:
    return M.top_tokens(_tokens(spark, d), _query(spark, d), "slide", "token", 10).select("slide", "token", "similarity", "rank")


TOP_SQL = f"""WITH c AS ({V.CORPUS}), {QUERY}, b AS (SELECT (vec_id % 5)::INT AS slide, vec_id::INT AS token, round(max(list_dot_product(embedding, q)), 9) AS similarity FROM c CROSS JOIN q GROUP BY ALL)
SELECT * REPLACE (rank::INT AS rank) FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY similarity DESC, token) AS rank FROM b) WHERE rank <= 10"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    e = V.corpus(spark, d).select(F.col("vec_id").alias("slide"), "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("slide", "label", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.abs("v").alias("w"))


CELLS = "SELECT vec_id AS slide, label, (i // 8)::INT AS y, (i % 8)::INT AS x, abs(embedding[i + 1]::DOUBLE) AS w FROM embeddings, range(64) t(i)"


def maps(spark: SparkSession, d: str) -> DataFrame:
    m = M.aggregate_maps(_cells(spark, d), ("label", "y", "x"))
    return m.select("label", "y", "x", *[F.round(c, 6).alias(c) for c in ("largest", "mean", "median")])


MAPS_SQL = f"SELECT label, y, x, round(max(w), 6) AS largest, round(avg(w), 6) AS mean, round(median(w), 6) AS median FROM ({CELLS}) GROUP BY ALL"


def smoothed(spark: SparkSession, d: str) -> DataFrame:
    return M.smooth(_cells(spark, d).select("slide", "y", "x", "w")).withColumn("w", F.round("w", 6))


_WEIGHTS = np.exp(-0.5 * np.arange(-4, 5) ** 2)
KERNEL = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-4, 5), (_WEIGHTS / _WEIGHTS.sum()).tolist()))
TURN = "CASE WHEN ({0} + k + 16) % 16 > 7 THEN 15 - ({0} + k + 16) % 16 ELSE ({0} + k + 16) % 16 END"
SMOOTH_SQL = f"""WITH c AS ({CELLS}), k(k, f) AS (VALUES {KERNEL}), a AS (SELECT slide, y, {TURN.format("x")} AS x, sum(w * f) AS w FROM c CROSS JOIN k GROUP BY ALL),
b AS (SELECT slide, {TURN.format("y")} AS y, x, sum(w * f) AS w FROM a CROSS JOIN k GROUP BY ALL) SELECT slide, y::INT AS y, x::INT AS x, round(w, 6) AS w FROM b"""


def entropy_drop(spark: SparkSession, d: str) -> DataFrame:
    """The map is scaled to one; an object takes its eight largest cells."""
    c = _cells(spark, d)
    whole = c.groupBy("slide").agg(F.sum("w").alias("all"))
    c = c.join(whole, "slide").withColumn("w", F.col("w") / F.col("all"))
    total = c.groupBy("slide").agg(F.sum(-F.col("w") * F.log(F.col("w") + 1e-10)).alias("total"))
    out = M.expected_entropy_drop(c.join(total, "slide"), "slide", 8)
    return out.select("slide", *[F.round(x, 6).alias(x) for x in ("p", "h", "drop")])


DROP_SQL = f"""WITH c AS (SELECT slide, y, x, w / sum(w) OVER (PARTITION BY slide) AS w FROM ({CELLS})), t AS (SELECT slide, sum(-w * ln(w + 1e-10)) AS t FROM c GROUP BY slide),
o AS (SELECT slide, sum(w) AS p, sum(-w * ln(w + 1e-10)) AS h FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY w DESC, y, x) AS r FROM c) WHERE r <= 8 GROUP BY slide)
SELECT slide, round(p, 6) AS p, round(h, 6) AS h, round(-h + p * (ln(1 - p + 1e-10) - t), 6) AS drop FROM o JOIN t USING (slide)"""


def axes(spark: SparkSession, d: str) -> DataFrame:
    """Masks are the cells of a map above 0.1."""
    a = M.mask_axes(_cells(spark, d).filter("w > 0.1"), "slide")
    return a.select("slide", F.round("minor", 4).alias("minor"), F.round("major", 4).alias("major"))


AXES_SQL = f"""WITH m AS (SELECT slide, var_pop(x) AS a, var_pop(y) AS b, covar_pop(x, y) AS c FROM ({CELLS}) WHERE w > 0.1 GROUP BY slide), e AS (SELECT slide, (a + b) / 2 AS m, sqrt(power((a - b) / 2, 2) + power(c, 2)) AS s FROM m)
SELECT slide, round(4.0::DOUBLE * sqrt(greatest(m - s, 0.0)), 4) AS minor, round(4.0::DOUBLE * sqrt(greatest(m + s, 0.0)), 4) AS major FROM e"""


def ious(spark: SparkSession, d: str) -> DataFrame:
    """Regions of two test sets on one slide."""
    b = B.regions(spark, d, 250).select("slide", F.col("region").alias("other"), *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    a = B.regions(spark, d)
    # every pair of a slide is wanted, so a task takes 256 regions with all others, not a slide or a file
    a = a.repartition(-(-a.count() // 256) or 1, "region")
    pairs = a.join(F.broadcast(b), "slide")
    return pairs.select("slide", "region", "other", F.round(G.iou(G.box(), G.box("r_")), 6).alias("iou"))


IOU_SQL = f"""WITH p AS (SELECT b.slide, b.region, r.region AS other, greatest(least(b.x2, r.x2) - greatest(b.x1, r.x1), 0) * greatest(least(b.y2, r.y2) - greatest(b.y1, r.y1), 0)::DOUBLE AS o FROM ({B._regions()}) b JOIN ({B._regions(250)}) r ON r.slide = b.slide)
SELECT slide, region, other, round(o / (600000 - o), 6) AS iou FROM p"""


def region_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many detections each slide's regions hold."""
    from veridian.operators.spatial import region_counts

    n = region_counts(B.detections(spark, d), B.regions(spark, d), "id", "region")
    return n.groupBy("slide").agg(*running_stats(F.col("n"), "grains"))


STATS_SQL = f"""{B.WITH}, n AS (SELECT b.slide, region, count(*) AS n FROM b JOIN r ON r.slide = b.slide AND {B.HIT.format(m=0)} GROUP BY ALL)
SELECT slide, count(n) AS grains_n, round(avg(n), 6) AS grains_mean, round(stddev_pop(n), 6) AS grains_std, min(n)::DOUBLE AS grains_min, max(n)::DOUBLE AS grains_max FROM n GROUP BY slide"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of labels whose document is there; the gate passes."""
    share = S.require_coverage(read(spark, d, "labels"), read(spark, d, "documents"), "doc_id")
    return spark.createDataFrame([(round(share, 6),)], "covered double")


COVERAGE_SQL = "SELECT round(avg(CASE WHEN doc_id IN (SELECT doc_id FROM documents) THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS covered FROM labels"


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """Two corpora over the same ids."""
    docs = read(spark, d, "documents")
    return T.aligned(docs.select("doc_id", "lang"), docs.select("doc_id", "source"), "doc_id")


ALIGNED_SQL = "SELECT doc_id, lang, source FROM documents"


def gated(spark: SparkSession, d: str) -> DataFrame:
    """Parts as classified objects; a probability that is no number passes no gate."""
    prob = F.when(F.col("p_partkey") % 50 == 7, F.lit(float("nan"))).otherwise(F.col("p_size") / 50)
    rows = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 52).cast("int").alias("class_id"), prob.alias("class_prob"))
    return classifier_gate(rows.filter(~F.isnan("class_prob"))).select("p_partkey", "class_id", "class_prob")


GATED_SQL = "SELECT p_partkey, (p_partkey % 52)::INT AS class_id, p_size / 50::DOUBLE AS class_prob FROM part WHERE p_partkey % 50 <> 7 AND p_size >= 25 AND p_partkey % 52 <> 51"


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of 256 pixels with an overlap of 32."""
    slides = read(spark, d, "nation").select(F.col("n_nationkey").alias("slide"), (F.col("n_nationkey") * 37 + 300).alias("width"), (F.col("n_nationkey") * 91 % 700 + 200).alias("height"))
    return tile_grid(slides, 256, 32).select("slide", "x", "y", "tile")


TILES_SQL = """WITH s AS (SELECT n_nationkey AS slide, n_nationkey * 37 + 300 AS w, n_nationkey * 91 % 700 + 200 AS h FROM nation)
SELECT slide, (i * 224)::INT AS x, (j * 224)::INT AS y, j * ceil(w / 224.0)::BIGINT + i AS tile FROM s, range(10) a(i), range(10) b(j) WHERE i * 224 < w AND j * 224 < h"""


def tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    """S1, S2, U-UDF: vectors as lines of 64 grey pixels of their label's image; its tiles without the first column of them, negative."""
    level = lambda v: F.lpad(F.hex(F.floor((v + 1) * 127).cast("int")), 2, "0")
    line = F.unhex(F.array_join(F.transform("embedding", lambda v: F.repeat(level(v), 3)), ""))
    y = F.row_number().over(W.partitionBy("label", F.floor(F.col("vec_id") / 1000)).orderBy("vec_id")) - 1
    lines = V.corpus(spark, d).select(F.concat_ws("-", "label", F.floor(F.col("vec_id") / 1000)).alias("slide"), y.alias("y"), F.lit(64).alias("width"), line.alias("pixels"))
    folder = scratch(spark, "lines")
    write_lines(lines, folder)
    tiles = read_tiles(spark, folder, 24, 4, (3, 2, 1000, 1000), transforms=[lambda image: 255 - image]).filter("x > 3")
    key = F.struct("slide", "tile", "x", "y")
    sums = P.with_test(tiles.select(F.to_json(key).alias("key"), "height", "width", "pixels"), "key", lambda image: int(image.sum()), "long", "total")
    return sums.select(F.from_json("key", "slide string, tile long, x int, y int").alias("k"), "total").select("k.*", "total")


TILE_PIXELS_SQL = f"""WITH l AS (SELECT label || '-' || vec_id // 1000 AS slide, row_number() OVER (PARTITION BY label, vec_id // 1000 ORDER BY vec_id) - 1 AS y, embedding FROM ({V.CORPUS})),
p AS (SELECT slide, y, unnest(range(0, 64)) AS x, unnest(embedding) AS v FROM l), h AS (SELECT slide, max(y) + 1 AS high FROM l GROUP BY slide),
t AS (SELECT slide, high, (i + 4 * j)::BIGINT AS tile, 3 + 20 * i AS tx, 2 + 20 * j AS ty FROM h, range(4) a(i), range(200) b(j) WHERE 2 + 20 * j < high AND i > 0),
s AS (SELECT t.slide, tile, tx, ty, sum(floor((v + 1) * 127)) AS dark FROM t JOIN p ON p.slide = t.slide AND x >= tx AND x < tx + 24 AND y >= ty AND y < ty + 24 GROUP BY ALL)
SELECT slide, tile, tx::INT AS x, ty::INT AS y, (3 * (255 * 24 * 24 - dark))::BIGINT AS total FROM s"""


def _grains(frames):
    """An image of 72 pixels for each part: an ellipse whose axes, shade and place come from the row."""
    y, x = np.arange(72)[:, None], np.arange(72)
    shades = [((x * 7 + y * 13 + k) % 5).astype(np.uint8) for k in range(5)]
    for part in frames:
        rows = []
        for key, size, price in zip(part["p_partkey"], part["p_size"], part["p_retailprice"]):
            a, b = 20 + size % 7, (20 + size % 7) * (1.0, 1.05, 1.4)[key % 3]
            inside = ((x - 36 - (0, 14)[key % 7 == 0]) / a) ** 2 + ((y - 36) / b) ** 2 <= 1
            grey = np.where(inside, np.uint8(90 + int(price) % 40), np.uint8(220)) + shades[key % 5]
            rows.append((key, 72, 72, grey.repeat(3).tobytes()))
        yield pd.DataFrame(rows, columns=["p_partkey", "height", "width", "pixels"])


def round_grains(spark: SparkSession, d: str) -> DataFrame:
    """Which images hold a centred, regular and round grain."""
    parts = read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    # rows are narrow and their work is not: a file's rows are dealt to tasks of some 1,000 images
    parts = parts.repartition(-(-parts.count() // 1000) or 1, "p_partkey")
    # images are tested where they are made: pixels do not pass from Python to Spark and back
    tester = P.stack_tester("p_partkey", lambda stack: P.grains(stack).tolist())
    tests = parts.mapInPandas(lambda frames: tester(_grains(frames)), "p_partkey long, result array<boolean>")
    return tests.select("p_partkey", *(F.col("result")[i].alias(n) for i, n in enumerate(("centred", "regular", "circular"))))


def matched(spark: SparkSession, d: str) -> DataFrame:
    """M8: values of views as bytes, brought to the histogram and to the mean and deviation of purchases, by user mod 3."""
    e = read(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("channel"), F.least(F.floor("value"), F.lit(255)).cast("int").alias("level"))
    content, reference = e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'")
    stats = lambda rows, p: rows.groupBy("channel").agg(F.round(F.avg("level"), 6).alias(f"{p}m"), F.round(F.stddev_pop("level"), 6).alias(f"{p}s"))
    out = content.join(P.level_map(content, reference, ["channel"], "level"), ["channel", "level"]).join(stats(content, "c"), "channel").join(stats(reference, "r"), "channel")
    moved = P.aligned(F.col("level").cast("double"), F.col("cm"), F.col("cs"), F.col("rm"), F.col("rs"), 0.8)
    return out.select("event_id", "channel", "level", "matched", moved.alias("aligned"))


MATCHED_SQL = """WITH e AS (SELECT event_id, event_type AS t, user_id % 3 AS channel, least(floor(value), 255)::INT AS level FROM events),
h AS (SELECT t, channel, level, sum(count(*)) OVER (PARTITION BY t, channel ORDER BY level) AS c, sum(count(*)) OVER (PARTITION BY t, channel) AS n FROM e GROUP BY t, channel, level),
m AS (SELECT a.channel, a.level, min(b.level) AS matched FROM h a JOIN h b ON a.channel = b.channel AND a.t = 'view' AND b.t = 'purchase' AND a.c * b.n <= b.c * a.n GROUP BY ALL),
s AS (SELECT t, channel, round(avg(level), 6) AS m, round(stddev_pop(level), 6) AS s FROM e GROUP BY t, channel)
SELECT event_id, channel, level, matched, floor(greatest(0.0, least(255.0, 0.8::DOUBLE * ((level - c.m) / (c.s + 1e-8) * r.s + r.m) + (1 - 0.8::DOUBLE) * level)))::INT AS aligned
FROM e JOIN m USING (channel, level) JOIN s c ON c.channel = e.channel AND c.t = 'view' JOIN s r ON r.channel = e.channel AND r.t = 'purchase' WHERE e.t = 'view'"""


def encoded(spark: SparkSession, d: str) -> DataFrame:
    """Bytes as base64 text, on one line."""
    return read(spark, d, "pages").select("page_id", F.translate(F.base64(F.encode("html", "UTF-8")), "\r\n", "").alias("encoded"))


ENCODED_SQL = "SELECT page_id, to_base64(encode(html)) AS encoded FROM pages"



def shifted(spark: SparkSession, d: str) -> DataFrame:
    """M9: regions moved over a grid of five by five offsets."""
    return P.shift_grid(B.regions(spark, d), 2, 14)


SHIFTED_SQL = f"SELECT region, slide, x1 + i * 14 AS x1, y1 + j * 14 AS y1, x2 + i * 14 AS x2, y2 + j * 14 AS y2, (i * 14)::INT AS dx, (j * 14)::INT AS dy FROM ({B._regions()}), range(-2, 3) a(i), range(-2, 3) b(j)"


def crop_names(spark: SparkSession, d: str) -> DataFrame:
    """K18."""
    b = B.detections(spark, d)
    return b.select("id", "slide", P.crop_name(F.concat(F.lit("slide"), "slide"), F.col("id"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("name"))


NAMES_SQL = f"SELECT id, slide, concat_ws('_', 'slide' || slide, 'pollen', id, x1, y1, x2 - x1, y2 - y1) AS name FROM ({B.DETECTIONS})"


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON; a time stamp, which JSON has not, goes as text."""
    return read(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))).alias("json"))


JSON_SQL = "SELECT o_orderkey, to_json({'key': o_orderkey, 'status': o_orderstatus, 'at': strftime(o_orderdate, '%Y-%m-%d')})::VARCHAR AS json FROM orders"

QUERIES = {
    "w12_mining_loop": mined,
    "f16_round_grains": round_grains,
    "j15_token_pool": token_pool, "j16_grid_lookup": grid_lookup, "v7_attention": attention, "o2_top_tokens": top_tokens, "a18_map_aggregates": maps, "g11_smoothed": smoothed, "g13_entropy_drop": entropy_drop,
    "g8_mask_axes": axes, "g4_iou": ious, "a27_region_stats": region_stats, "e17_coverage": coverage, "j7_aligned": aligned, "f8_classifier_gate": gated, "s1_tile_grid": tiles, "s1_tile_pixels": tile_pixels, "t22_base64": encoded, "m9_shift_grid": shifted, "k18_crop_names": crop_names, "n4_json_rows": json_rows, "m8_matched_levels": matched,
}
ORACLES = {
    "j15_token_pool": POOL_SQL, "j16_grid_lookup": LOOKUP_SQL, "v7_attention": ATTENTION_SQL, "o2_top_tokens": TOP_SQL, "a18_map_aggregates": MAPS_SQL, "g11_smoothed": SMOOTH_SQL, "g13_entropy_drop": DROP_SQL,
    "g8_mask_axes": AXES_SQL, "g4_iou": IOU_SQL, "a27_region_stats": STATS_SQL, "e17_coverage": COVERAGE_SQL, "j7_aligned": ALIGNED_SQL, "f8_classifier_gate": GATED_SQL, "s1_tile_grid": TILES_SQL, "s1_tile_pixels": TILE_PIXELS_SQL, "t22_base64": ENCODED_SQL, "m9_shift_grid": SHIFTED_SQL, "k18_crop_names": NAMES_SQL, "n4_json_rows": JSON_SQL, "m8_matched_levels": MATCHED_SQL,
}
