"""Vectors, retrieval and classification over ``embeddings``, with their DuckDB SQL.

species = label, origin = vec_id mod 4, slide = vec_id div 25; queries are the mean vectors of each species and
origin, against the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridian.functions import vectors as V
from veridian.functions.draws import draw_sql
from veridian.operators import metrics as M
from veridian.operators import mining
from veridian.operators import ranking as R
from veridian.operators import sampling
from veridian.operators import spatial as S
from veridian.sources.stages import written
from veridian.sources.tables import read

SIZE, KS = 64, (1, 5, 10, 20)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select("vec_id", "label", (F.col("vec_id") % 4).alias("origin"), F.floor(F.col("vec_id") / 25).alias("slide"), V.as_doubles(F.col("embedding")).alias("embedding"))


CORPUS = "SELECT vec_id, label, vec_id % 4 AS origin, vec_id // 25 AS slide, embedding::DOUBLE[] AS embedding FROM embeddings"
MEAN = "[" + ", ".join(f"avg(embedding[{i + 1}])" for i in range(SIZE)) + "]"
SUM = "[" + ", ".join(f"sum(embedding[{i + 1}])" for i in range(SIZE)) + "]"


def distances(spark: SparkSession, d: str) -> DataFrame:
    """V1-V3: every vector against the mean of its species."""
    c = corpus(spark, d)
    q = R.class_means(c, ["label"], SIZE)
    a, b = F.col("embedding"), F.when(F.col("vec_id") % 50 == 0, F.array_repeat(F.lit(0.0), SIZE)).otherwise(F.col("query"))
    return c.join(q, "label").select("vec_id", F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.distance(a, b), 6).alias("cosine_distance"), F.round(V.distance(a, b, "euclidean"), 6).alias("euclidean"), F.round(V.norm(V.l2_normalized(b)), 6).alias("unit"))


DISTANCES_SQL = f"""WITH c AS ({CORPUS}), q AS (SELECT label, {MEAN} AS q FROM c GROUP BY label),
x AS (SELECT vec_id, list_dot_product(embedding, q) / ((sqrt(list_dot_product(embedding, embedding)) + 1e-8) * (sqrt(list_dot_product(q, q)) + 1e-8)) AS cos, list_distance(embedding, q) AS e, list_dot_product(q, q) AS n FROM (SELECT vec_id, embedding, CASE WHEN vec_id % 50 = 0 THEN list_transform(q, lambda v: 0.0::DOUBLE) ELSE q END AS q FROM c JOIN q USING (label)))
SELECT vec_id, round(cos, 6) AS cosine, round(1 - cos, 6) AS cosine_distance, round(e, 6) AS euclidean, CASE WHEN n > 0 THEN round(sqrt(n) / sqrt(n), 6) ELSE 0.0::DOUBLE END AS unit FROM x"""


def medoids(spark: SparkSession, d: str) -> DataFrame:
    return R.medoids(corpus(spark, d), ["label"], "vec_id", SIZE)


MEDOIDS_SQL = f"""WITH c AS ({CORPUS}), t AS (SELECT label, {SUM} AS t FROM c GROUP BY label), s AS (SELECT label, vec_id, round(list_dot_product(embedding, t), 6) AS s FROM c JOIN t USING (label))
SELECT label, vec_id, s AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM s) WHERE r = 1"""


def principal(spark: SparkSession, d: str) -> DataFrame:
    """V6: the direction of each species by its three first components."""
    p = mining.principal_directions(corpus(spark, d), "label", "embedding", SIZE, 3)
    return p.select("label", F.transform("direction", lambda x: F.round(x, 6)).alias("direction"), F.round("share", 6).alias("share"), "members")


ROUNDS = 3


def prototypes(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds from the mean vector of each species."""
    c = corpus(spark, d)
    start = R.class_means(c, ["label"], SIZE).select("label", F.transform("query", lambda x: F.round(x, 9)).alias("prototype"))
    p = mining.refine_prototypes(c, start, "label", "vec_id", "embedding", SIZE, 0.25, ROUNDS)
    return p.select("label", "rounds", *(F.round(F.col("prototype")[i], 6).alias(f"p{i}") for i in range(4)))


def _round(i: int) -> str:
    """One more round; a species whose prototype stayed within the tolerance keeps it."""
    return f"""s{i} AS (SELECT c.label, vec_id, embedding, round(list_dot_product(embedding, p), 9) AS s, k FROM c JOIN p{i - 1} p ON p.label = c.label AND p.moving JOIN n ON n.label = c.label),
t{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM s{i}) WHERE r <= k),
u{i} AS (SELECT label, {SUM} AS t FROM t{i} GROUP BY label),
m{i} AS (SELECT label, list_transform(embedding, lambda x: x / (sqrt(list_dot_product(embedding, embedding)) + 1e-8)) AS v FROM (SELECT t{i}.*, row_number() OVER (PARTITION BY label ORDER BY round(list_dot_product(embedding, t), 9) DESC, s DESC, vec_id) AS m FROM t{i} JOIN u{i} USING (label)) WHERE m = 1),
p{i} AS (SELECT p.label, coalesce(m.v, p.p) AS p, p.rounds + p.moving::INT AS rounds, p.moving AND list_distance(m.v, p.p) >= 1e-4 AS moving FROM p{i - 1} p LEFT JOIN m{i} m USING (label))"""


PROTOTYPES_SQL = f"""WITH c AS ({CORPUS}), n AS (SELECT label, greatest(1, floor(count(*) * 0.25::DOUBLE))::BIGINT AS k FROM c GROUP BY label),
p0 AS (SELECT label, list_transform({MEAN}, lambda x: round(x, 9)) AS p, 0 AS rounds, true AS moving FROM c GROUP BY label), {", ".join(_round(i + 1) for i in range(ROUNDS))}
SELECT label, rounds, {", ".join(f"round(p[{i + 1}], 6) AS p{i}" for i in range(4))} FROM p{ROUNDS}"""


def query_distances(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance of every vector to the mean of its species, a third of it for odd ones."""
    c = corpus(spark, d)
    far = c.join(R.class_means(c, ["label"], SIZE), "label").withColumn("distance", V.distance(F.col("embedding"), F.col("query")))
    return far.select("vec_id", "label", F.round(F.col("distance") / (1 + 2 * (F.col("label") % 2)), 9).alias("distance"))


def edge_fits(spark: SparkSession, d: str) -> DataFrame:
    """The fit of each species' distances."""
    return S.edge_fits(query_distances(spark, d), ["label"], "distance").select("label", *(F.round(c, 6).alias(c) for c in ("amplitude", "middle", "width")))


def fitted_gate(spark: SparkSession, d: str) -> DataFrame:
    """gates around the fits."""
    rows = query_distances(spark, d)
    return S.distance_gate(rows, S.edge_fits(rows, ["label"], "distance"), ["label"], "distance").select("vec_id", "positive", "negative")


def norm_check(spark: SparkSession, d: str) -> DataFrame:
    n = V.norm(F.col("embedding"))
    return corpus(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.sum((F.abs(n - 1) > 0.01).cast("long")).alias("off_unit"), F.sum((n <= 1e-6).cast("long")).alias("zero"))


NORM_SQL = f"SELECT count(*) AS rows, count(*) FILTER (WHERE abs(n - 1) > 0.01) AS off_unit, count(*) FILTER (WHERE n <= 1e-6) AS zero FROM (SELECT sqrt(list_dot_product(embedding, embedding)) AS n FROM ({CORPUS}))"


def _scored(spark: SparkSession, d: str, mode: str) -> DataFrame:
    c = corpus(spark, d)
    q = R.class_means(c, ["label", "origin"], SIZE).select(F.col("label").alias("q_label"), F.col("origin").alias("q_origin"), "query")
    pairs = R.score_pairs(q, c).filter(R.exclusion(mode, F.lit(-1), F.col("slide"), F.col("q_origin"), F.col("origin")))
    return pairs.withColumn("relevant", (F.col("label") == F.col("q_label")).cast("int"))


def _metrics(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return R.ranking_metrics(_scored(spark, d, mode).select("q_label", "q_origin", "vec_id", "score", "relevant"), ["q_label", "q_origin"], "vec_id", KS)


def _metrics_sql(where: str) -> str:
    at = lambda c: ", ".join(c.format(k=k) for k in KS)
    return f"""WITH c AS ({CORPUS}), q AS (SELECT label AS q_label, origin AS q_origin, {MEAN} AS q FROM c GROUP BY ALL),
s AS (SELECT q_label, q_origin, vec_id, CASE WHEN label = q_label THEN 1 ELSE 0 END AS rel, round(list_dot_product(embedding, q), 9) AS s FROM c CROSS JOIN q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY q_label, q_origin ORDER BY s DESC, vec_id) AS rank FROM s),
h AS (SELECT *, sum(rel) OVER (PARTITION BY q_label, q_origin ORDER BY rank) AS hits FROM r),
a AS (SELECT q_label, q_origin, count(*) AS n, sum(rel) AS total, min(rank) FILTER (WHERE rel = 1) AS f, {at("coalesce(sum(rel) FILTER (WHERE rank <= {k}), 0) AS h{k}")},
  {at("coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= {k} AND rel = 1), 0.0) AS d{k}")}, coalesce(sum(hits / rank::DOUBLE) FILTER (WHERE rank <= 20 AND rel = 1), 0.0) AS ap FROM h GROUP BY ALL HAVING sum(rel) > 0)
SELECT q_label, q_origin, total::BIGINT AS total, {at("round(h{k} / least({k}, n)::DOUBLE, 6) AS p_{k}")}, {at("round(h{k} / total::DOUBLE, 6) AS r_{k}")},
  {at("round(d{k} / list_sum(list_transform(range(1, least(total, {k})::INT + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}")}, round(1.0::DOUBLE / f, 6) AS mrr, round(ap / least(total, 20), 6) AS "map" FROM a"""


METRICS_ALL_SQL, METRICS_CROSS_SQL = _metrics_sql("true"), _metrics_sql("q_origin <> origin")


def ranking_all(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d, "all")


def ranking_cross(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d, "cross_regional")


def macro(spark: SparkSession, d: str) -> DataFrame:
    return R.macro_mean(ranking_cross(spark, d), "map", "q_origin", "q_label")


MACRO_SQL = f'SELECT round(avg(m), 6) AS "map", count(*) AS groups FROM (SELECT q_label, avg(m) AS m FROM (SELECT q_label, q_origin, avg("map") AS m FROM ({METRICS_CROSS_SQL}) GROUP BY ALL) GROUP BY q_label)'


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """10,000 replicates over species and origins."""
    return R.hierarchical_bootstrap(ranking_cross(spark, d), "map", "q_label", "q_origin", "total", 10_000)


BOOTSTRAP_SQL = f"""WITH m AS ({METRICS_CROSS_SQL}), o AS (SELECT q_label, row_number() OVER (ORDER BY q_label) - 1 AS o FROM (SELECT DISTINCT q_label FROM m)), k AS (SELECT count(*) AS n FROM o),
i AS (SELECT q_label, "map" AS v, row_number() OVER (PARTITION BY q_label ORDER BY q_origin) - 1 AS i, count(*) OVER (PARTITION BY q_label) AS n FROM m), c AS (SELECT DISTINCT q_label, n FROM i),
s AS (SELECT b, s, q_label, n FROM (SELECT b.range AS b, s.range AS s, {draw_sql("42", "b.range", "s.range")} % n AS o FROM range(10000) b, range((SELECT n FROM k)) s, k) JOIN o USING (o) JOIN c USING (q_label)),
t AS (SELECT b, s, q_label, {draw_sql("42", "b", "s", "t")} % n AS i, t FROM (SELECT *, unnest(range(n)) AS t FROM s)),
x AS (SELECT b, avg(m) AS m FROM (SELECT b, s, avg(v) AS m FROM t JOIN i USING (q_label, i) GROUP BY b, s) GROUP BY b)
SELECT round(avg(m), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM x"""


def control(spark: SparkSession, d: str) -> DataFrame:
    """Mean reciprocal rank with real and shuffled labels; the scores are written once for all of them."""
    scored = written(_scored(spark, d, "all").select("q_label", "q_origin", "vec_id", "score", "relevant"), "scores")
    real = R.ranking_metrics(scored.select("q_label", "q_origin", "vec_id", "score", "relevant"), ["q_label", "q_origin"], "vec_id", KS).agg(F.avg("mrr").alias("real"))
    # a row each, written so that no plan holds several rankings
    real = written(real, "real")
    out = None
    for seed in (42, 123, 456):
        other = sampling.shuffled_labels(corpus(spark, d).select("vec_id", "label", F.lit(0).alias("g")), "label", "vec_id", ["g"], seed).select("vec_id", F.col("label").alias("other"))
        rows = scored.join(other, "vec_id").withColumn("relevant", (F.col("other") == F.col("q_label")).cast("int"))
        one = R.ranking_metrics(rows.select("q_label", "q_origin", "vec_id", "score", "relevant"), ["q_label", "q_origin"], "vec_id", KS).agg(F.lit(seed).alias("seed"), F.avg("mrr").alias("mrr"))
        one = written(one, "shuffled")
        out = one if out is None else out.union(one)
    return out.crossJoin(F.broadcast(real)).select("seed", F.round("mrr", 6).alias("shuffled"), F.round("real", 6).alias("real"), F.round(F.col("real") - F.col("mrr"), 6).alias("delta"))


def _control_sql() -> str:
    one = """SELECT {seed} AS seed, avg(rr) AS shuffled FROM (SELECT q_label, q_origin, 1.0::DOUBLE / min(rank) AS rr FROM r JOIN
(SELECT vec_id, other FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n FROM c) JOIN (SELECT label AS other, row_number() OVER (ORDER BY {draw}, vec_id) AS n FROM c) USING (n)) USING (vec_id) WHERE other = q_label GROUP BY ALL)"""
    each = " UNION ALL ".join(one.format(seed=s, draw=draw_sql(str(s), "vec_id")) for s in (42, 123, 456))
    return f"""WITH c AS ({CORPUS}), q AS (SELECT label AS q_label, origin AS q_origin, {MEAN} AS q FROM c GROUP BY ALL),
s AS (SELECT q_label, q_origin, vec_id, label, round(list_dot_product(embedding, q), 9) AS s FROM c CROSS JOIN q), r AS (SELECT *, row_number() OVER (PARTITION BY q_label, q_origin ORDER BY s DESC, vec_id) AS rank FROM s),
t AS (SELECT avg(round(rr, 6)) AS real FROM (SELECT 1.0::DOUBLE / min(rank) AS rr FROM r WHERE label = q_label GROUP BY q_label, q_origin)), e AS ({each.replace("1.0::DOUBLE / min(rank)", "round(1.0::DOUBLE / min(rank), 6)")})
SELECT seed, round(shuffled, 6) AS shuffled, round(real, 6) AS real, round(real - shuffled, 6) AS delta FROM e CROSS JOIN t"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Nearest species mean for each vector: scores by label as an array, argmax, top five."""
    c = corpus(spark, d)
    q = R.class_means(c, ["label"], SIZE).select(F.col("label").alias("q"), "query")
    scored = R.score_pairs(q, c).groupBy("vec_id", "label").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "q"))).alias("best"))
    return scored.select("vec_id", "label", F.col("best")[0]["q"].alias("pred"), F.exists(F.slice("best", 1, 5), lambda x: x["q"] == F.col("label")).alias("in5"), F.transform("best", lambda x: -x["s"]).alias("scores"))


PREDICTIONS = f"""WITH c AS ({CORPUS}), q AS (SELECT label AS q, {MEAN} AS v FROM c GROUP BY label), s AS (SELECT vec_id, label, q, round(list_dot_product(embedding, v), 9) AS s FROM c CROSS JOIN q),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, q) AS r FROM s),
p AS (SELECT vec_id, label, max(CASE WHEN r = 1 THEN q END) AS pred, bool_or(r <= 5 AND q = label) AS in5, list(s ORDER BY r) AS scores FROM r GROUP BY vec_id, label)"""


def softmax(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    s = V.softmax(F.col("scores"))
    mixed = F.concat(F.slice("scores", 4, 7), F.slice("scores", 1, 3))
    return p.select("vec_id", "pred", "in5", V.argmax(mixed).alias("argmax"), F.round(F.array_max(s), 6).alias("p1"), F.round(V.distillation_loss(F.col("scores"), F.reverse("scores"), F.lit(0)), 6).alias("loss"))


SOFTMAX_SQL = f"""{PREDICTIONS}, e AS (SELECT vec_id, pred, in5, scores, list_transform(scores, lambda x: exp(x - list_max(scores))) AS e, list_transform(scores, lambda x: exp((x - list_max(scores)) / 3.0)) AS t FROM p),
n AS (SELECT *, list_transform(t, lambda x: x / list_sum(t)) AS st, list_reverse(list_transform(t, lambda x: x / list_sum(t))) AS te, e[1] / list_sum(e) AS p1 FROM e)
SELECT vec_id, pred, in5, list_position(scores[4:10] || scores[1:3], list_max(scores)) - 1 AS argmax, round(p1, 6) AS p1, round(0.5 * -ln(p1) + 0.5 * 9 * list_sum(list_transform(range(1, len(st) + 1), lambda i: te[i] * (ln(te[i]) - ln(st[i])))), 6) AS loss FROM n"""


def classification(spark: SparkSession, d: str) -> DataFrame:
    return M.overall(predictions(spark, d), top5="in5")


REPORT = f"""{PREDICTIONS}, t AS (SELECT label AS class, count(*) AS support, count(*) FILTER (WHERE label = pred) AS hits FROM p GROUP BY label), g AS (SELECT pred AS class, count(*) AS guesses FROM p GROUP BY pred),
k AS (SELECT class, support, hits, coalesce(guesses, 0) AS guesses, CASE WHEN guesses > 0 THEN 100.0::DOUBLE * hits / guesses ELSE 0.0 END AS precision, 100.0::DOUBLE * hits / support AS recall FROM t LEFT JOIN g USING (class)),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM k)"""
CLASSIFICATION_SQL = f"""{REPORT} SELECT round(100.0::DOUBLE * sum(hits) / sum(support), 4) AS top1, round(avg(precision), 4) AS macro_precision, round(avg(recall), 4) AS macro_recall, round(avg(f1), 4) AS macro_f1, round(sum(f1 * support) / sum(support), 4) AS weighted_f1,
sum(support)::BIGINT AS samples, count(*) AS classes, (SELECT round(100.0::DOUBLE * avg(in5::INT), 4) FROM p) AS top5 FROM f"""


def known_only(spark: SparkSession, d: str) -> DataFrame:
    """The last class is the reserved one."""
    p = predictions(spark, d)
    return M.overall(p.filter(F.col("label") < 9))


KNOWN_SQL = CLASSIFICATION_SQL.replace("FROM r GROUP BY vec_id, label)", "FROM r WHERE label < 9 GROUP BY vec_id, label)").replace(", (SELECT round(100.0::DOUBLE * avg(in5::INT), 4) FROM p) AS top5", "")


def class_report(spark: SparkSession, d: str) -> DataFrame:
    r = M.class_report(predictions(spark, d))
    return r.select("class", "support", "hits", "guesses", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")])


CLASS_SQL = f"{REPORT} SELECT class, support, hits, guesses, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM f"


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(predictions(spark, d))


CONFUSION_SQL = f"{PREDICTIONS}, n AS (SELECT label AS c FROM p UNION SELECT pred FROM p) SELECT a.c AS label, b.c AS pred, count(p.vec_id) AS n FROM n a CROSS JOIN n b LEFT JOIN p ON p.label = a.c AND p.pred = b.c GROUP BY ALL"


def class_breakdown(spark: SparkSession, d: str) -> DataFrame:
    b = M.class_breakdown(predictions(spark, d))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("predicted_as")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return b.select("class", "count", F.round("accuracy", 4).alias("accuracy"), told.alias("predicted_as"))


BREAKDOWN_SQL = f"""{PREDICTIONS}, n AS (SELECT label, pred, count(*) AS n FROM p GROUP BY ALL)
SELECT label AS class, sum(n)::BIGINT AS count, round(100.0::DOUBLE * coalesce(sum(n) FILTER (WHERE label = pred), 0) / sum(n), 4) AS accuracy, string_agg(pred || ':' || n, ',' ORDER BY pred::VARCHAR) AS predicted_as FROM n GROUP BY label"""


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return M.class_weights(read(spark, d, "embeddings"), "label")


WEIGHTS_SQL = "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(1 / sqrt(n + 1.0::DOUBLE) * count(*) OVER () / sum(1 / sqrt(n + 1.0::DOUBLE)) OVER (), 6) AS weight FROM n"


def fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two halves of a vector as image and text."""
    c = corpus(spark, d)
    q = R.class_means(c, ["label"], SIZE)
    i, t = lambda v: F.slice(v, 1, 32), lambda v: F.slice(v, 33, 32)
    a, b = F.col("embedding"), F.col("query")
    fused = V.fused(V.dot(i(a), i(b)), V.dot(t(a), t(b)), 0.5)
    joined = V.concatenated(i(a), F.when(F.col("vec_id") % 2 == 0, t(a)), 32)
    return c.join(q, "label").select("vec_id", F.round(fused, 6).alias("fused"), F.round(F.greatest(1 - fused, F.lit(0.0)), 6).alias("distance"), F.size(joined).alias("width"), F.round(V.norm(joined), 6).alias("norm"))


FUSION_SQL = f"""WITH c AS ({CORPUS}), q AS (SELECT label, {MEAN} AS q FROM c GROUP BY label), f AS (SELECT vec_id, embedding AS e, 0.5 * list_dot_product(embedding[1:32], q[1:32]) + 0.5 * list_dot_product(embedding[33:64], q[33:64]) AS f FROM c JOIN q USING (label))
SELECT vec_id, round(f, 6) AS fused, round(greatest(1 - f, 0.0), 6) AS distance, 64 AS width, round(sqrt(CASE WHEN vec_id % 2 = 0 THEN list_dot_product(e, e) ELSE list_dot_product(e[1:32], e[1:32]) END), 6) AS norm FROM f"""

QUERIES = {
    "w19_edge_fits": edge_fits,
    "f12_fitted_gate": fitted_gate,
    "v6_principal_direction": principal,
    "w13_medoid_prototypes": prototypes,
    "v1_vector_distances": distances,
    "v8_medoids": medoids,
    "v10_norm_check": norm_check,
    "e1_ranking_all": ranking_all,
    "e3_ranking_cross_regional": ranking_cross,
    "a23_macro_mean": macro,
    "r10_bootstrap": bootstrap,
    "e19_label_shuffle_control": control,
    "v11_softmax_predictions": softmax,
    "e7_classification": classification,
    "e8_known_only": known_only,
    "e11_class_report": class_report,
    "e9_class_breakdown": class_breakdown,
    "e10_confusion": confusion,
    "a26_class_weights": class_weights,
    "v5_fusion": fusion,
}
ORACLES = {
    "w13_medoid_prototypes": PROTOTYPES_SQL,
    "v1_vector_distances": DISTANCES_SQL,
    "v8_medoids": MEDOIDS_SQL,
    "v10_norm_check": NORM_SQL,
    "e1_ranking_all": METRICS_ALL_SQL,
    "e3_ranking_cross_regional": METRICS_CROSS_SQL,
    "a23_macro_mean": MACRO_SQL,
    "r10_bootstrap": BOOTSTRAP_SQL,
    "e19_label_shuffle_control": _control_sql(),
    "v11_softmax_predictions": SOFTMAX_SQL,
    "e7_classification": CLASSIFICATION_SQL,
    "e8_known_only": KNOWN_SQL,
    "e11_class_report": CLASS_SQL,
    "e9_class_breakdown": BREAKDOWN_SQL,
    "e10_confusion": CONFUSION_SQL,
    "a26_class_weights": WEIGHTS_SQL,
    "v5_fusion": FUSION_SQL,
}
