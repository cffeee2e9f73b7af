"""Splits, samples, series, joins and roll-ups over the driver tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.functions.draws import draw_sql
from veridian.functions.text import genus
from veridian.operators import sampling as S
from veridian.operators import series as E
from veridian.operators import tables as T
from veridian.sources.tables import read

H = draw_sql("42", "{}")


def split(spark: SparkSession, d: str) -> DataFrame:
    return S.split(read(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 0.85)


SPLIT_SQL = f"SELECT doc_id, source, CASE WHEN r <= floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY {H.format('doc_id')}, doc_id) AS r FROM documents)"


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """The manifest's per-slide and total counts."""
    s = split(spark, d)
    n = lambda v: F.sum((F.col("split") == v).cast("long"))
    return s.rollup("source").agg(n("train").alias("train"), n("val").alias("val"))


SPLIT_COUNTS_SQL = f"SELECT source, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val FROM ({SPLIT_SQL}) GROUP BY ROLLUP (source)"


def split_verdict(spark: SparkSession, d: str) -> DataFrame:
    return S.verify_split(split(spark, d), "doc_id")


VERDICT_SQL = f"SELECT count(*) AS samples, count(*) FILTER (WHERE s > 1) AS leaked, count(*) FILTER (WHERE s > 1) = 0 AS passed FROM (SELECT doc_id, count(DISTINCT split) AS s FROM ({SPLIT_SQL}) GROUP BY doc_id)"


def capped(spark: SparkSession, d: str) -> DataFrame:
    return S.cap(read(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 10)


CAPPED_SQL = f"SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY {H.format('doc_id')}, doc_id) AS r FROM documents) WHERE r <= 10"


def simple(spark: SparkSession, d: str) -> DataFrame:
    return S.simple_sample(read(spark, d, "documents").select("doc_id"), "doc_id", 100)


SIMPLE_SQL = f"SELECT doc_id FROM documents ORDER BY {H.format('doc_id')}, doc_id LIMIT 100"


def balanced(spark: SparkSession, d: str) -> DataFrame:
    return S.balanced_resample(read(spark, d, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 100, 200)


BALANCED_SQL = f"""WITH r AS (SELECT doc_id, toxic, count(*) OVER (PARTITION BY toxic) AS n, row_number() OVER (PARTITION BY toxic ORDER BY {H.format("doc_id")}, doc_id) AS r FROM labels),
p AS (SELECT toxic, {draw_sql("42", "toxic", "d")} % n + 1 AS r FROM (SELECT DISTINCT toxic, n FROM r WHERE n < 100) CROSS JOIN (SELECT unnest(range(1, 101)) AS d))
SELECT doc_id, toxic FROM r WHERE n >= 100 AND r <= 200 UNION ALL SELECT r.doc_id, r.toxic FROM p JOIN r USING (toxic, r)"""


def weighted(spark: SparkSession, d: str) -> DataFrame:
    return S.weighted_sample(read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").select("lang", "draw", "doc_id")


WEIGHTED_SQL = f"""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT lang, n, least(trunc(min(n) OVER () * sqrt(n / min(n) OVER ()::DOUBLE))::BIGINT, n) AS target FROM n),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents), p AS (SELECT lang, n, unnest(range(1, target + 1)) AS draw FROM t)
SELECT p.lang, draw::INT AS draw, doc_id FROM p JOIN r ON r.lang = p.lang AND r.r = {draw_sql("42", "p.lang", "draw")} % n + 1"""


def epoch(spark: SparkSession, d: str) -> DataFrame:
    """One epoch over documents by language, by the inverse of the summed weights."""
    return S.epoch_draws(read(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"])


EPOCH_SQL = f"""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT lang, n, least(trunc(min(n) OVER () * sqrt(n / min(n) OVER ()::DOUBLE))::BIGINT, n) AS target FROM n),
w AS (SELECT doc_id, lang, round(target / n::DOUBLE * 1048576)::BIGINT AS w FROM documents JOIN t USING (lang)),
line AS (SELECT doc_id, lang, sum(w) OVER (ORDER BY lang, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS hi, w FROM w),
u AS (SELECT i AS draw, (({draw_sql("42", "i", "0")})::HUGEINT * 4294967296 + {draw_sql("42", "i", "1")}) * (SELECT sum(w)::HUGEINT FROM w) // 18446744073709551616::HUGEINT AS at FROM (SELECT unnest(range((SELECT sum(target)::BIGINT FROM t))) AS i))
SELECT draw, doc_id, lang FROM u ASOF JOIN (SELECT doc_id, lang, (hi - w)::HUGEINT AS lo FROM line) l ON u.at >= l.lo"""

LEVELS = ["source", "lang", "part"]


def audit(spark: SparkSession, d: str) -> DataFrame:
    """An audit sample of 200 by source, language and doc_id mod 5."""
    rows = read(spark, d, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 5).alias("part"))
    return S.audit_sample(rows, LEVELS, "doc_id", 200)


def _allocated(level: int) -> str:
    """Budgets of one level from those above, in SQL."""
    keys, parent = ", ".join(LEVELS[:level]), LEVELS[: level - 1]
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    above = f"JOIN b{level - 1} p USING ({', '.join(parent)})" if parent else ""
    total = "p.budget" if parent else "200"
    child = LEVELS[level - 1]
    return f"""c{level} AS (SELECT {keys}, n, {total} AS total FROM (SELECT {keys}, count(*) AS n FROM rows GROUP BY ALL) {above}),
m{level} AS (SELECT *, (row_number() OVER ({by} ORDER BY n DESC, {child}) <= total)::BIGINT AS one, greatest(total - count(*) OVER ({by}), 0) AS rest FROM c{level}),
r{level} AS (SELECT *, n - one AS room, sum(n - one) OVER ({by}) AS rooms FROM m{level}),
f{level} AS (SELECT *, CASE WHEN rooms > 0 THEN least(rest, rooms) * room // rooms ELSE 0 END AS whole, CASE WHEN rooms > 0 THEN least(rest, rooms) * room % rooms ELSE 0 END AS frac FROM r{level}),
s{level} AS (SELECT *, least(rest, rooms) - sum(whole) OVER ({by}) AS spare, row_number() OVER ({by} ORDER BY frac DESC, room DESC, {child}) AS place FROM f{level}),
b{level} AS (SELECT {keys}, one + whole + (place <= spare)::BIGINT AS budget FROM s{level})"""


AUDIT_SQL = f"""WITH rows AS (SELECT doc_id, source, lang, doc_id % 5 AS part FROM documents), {_allocated(1)}, {_allocated(2)}, {_allocated(3)},
d AS (SELECT r.*, budget, row_number() OVER (PARTITION BY source, lang, part ORDER BY {H.format("doc_id")}, doc_id) AS place FROM rows r JOIN b3 USING (source, lang, part))
SELECT doc_id, source, lang, part, 'audit_' || lpad((row_number() OVER (ORDER BY source, lang, part, place) - 1)::VARCHAR, 5, '0') AS audit_id FROM d WHERE place <= budget"""


def budget(spark: SparkSession, d: str) -> DataFrame:
    return S.budget_sample(read(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 240)


BUDGET_SQL = f"""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), x AS (SELECT source, n * 240 / sum(n) OVER ()::DOUBLE AS x FROM n), f AS (SELECT source, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source) AS o, 240 - sum(floor(x)) OVER () AS l FROM x),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {H.format("doc_id")}, doc_id) AS r FROM documents)
SELECT doc_id, source FROM r JOIN f USING (source) WHERE r <= f + CASE WHEN o <= l THEN 1 ELSE 0 END"""


def entropy(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 1000).alias("new"), F.lag(F.col("value") / 1000, 1, 0.0).over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("old"))
    s = E.windowed_delta(E.incremental_entropy(e, ["user_id"], ["ts", "event_id"], "old", "new"), ["user_id"], ["ts", "event_id"], "entropy", 3)
    return s.select("event_id", F.round("entropy", 6).alias("entropy"), F.round("delta", 6).alias("delta"))


ENTROPY_SQL = """WITH e AS (SELECT *, value / 1000 AS n, lag(value / 1000, 1, 0.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events),
s AS (SELECT *, sum(-n * ln(n + 1e-10) + o * ln(o + 1e-10)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e)
SELECT event_id, round(s, 6) AS entropy, round(coalesce(s - lag(s, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0), 6) AS delta FROM s"""


BY_USER = (["user_id"], ["ts", "event_id"])
#: Averages of values with few digits fall between two sixth digits exactly; engines round those either way.
NUDGE = 1e-9


def _rounded(name: str):
    return F.round(F.col(name) + NUDGE, 6).alias(name)


#: Values of each user in order; lists of the first k of them.
PREFIXES = """WITH s AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list({value} ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
p AS (SELECT user_id, ids, v, unnest(range(1, len(v) + 1)) AS k FROM s)"""


def moving_average(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "value")
    slow = E.moving_average(e, *BY_USER, "value", 0.01).withColumnRenamed("average", "slow")
    return E.moving_average(slow, *BY_USER, "value", 0.1).select("event_id", _rounded("slow"), _rounded("average").alias("fast"))


AVERAGE_SQL = PREFIXES.format(value="value") + """
SELECT ids[k] AS event_id, round(list_reduce(v[1:k], lambda s, x: 0.99 * s + 0.01 * x) + 1e-9, 6) AS slow, round(list_reduce(v[1:k], lambda s, x: 0.9 * s + 0.1 * x) + 1e-9, 6) AS fast FROM p"""


def confidence(spark: SparkSession, d: str) -> DataFrame:
    """Errors have no value (NaN), nor has any user's first event if it is a signup."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("error", "signup"), float("nan")).otherwise(F.col("value")).alias("value"))
    return E.confidence_average(e, *BY_USER, "value").select("event_id", _rounded("raw"), _rounded("average"))


CONFIDENCE_SQL = """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('error', 'signup') THEN NULL ELSE value END AS v FROM events),
r AS (SELECT user_id, ts, event_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0.0) AS raw FROM e),
s AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids, list(raw ORDER BY ts, event_id) AS v FROM r GROUP BY user_id), p AS (SELECT ids, v, unnest(range(1, len(v) + 1)) AS k FROM s)
SELECT ids[k] AS event_id, round(v[k] + 1e-9, 6) AS raw, round(list_reduce(v[1:k], lambda s, x: 0.9 * s + (1 - 0.9::DOUBLE) * x) + 1e-9, 6) AS average FROM p"""


def flat_counter(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "value")
    return E.flat_counter(e, *BY_USER, "value", 20.0, 3).select("event_id", "step", "counter")


FLAT_SQL = PREFIXES.format(value="value") + """
SELECT ids[k] AS event_id, k::BIGINT AS step, list_reduce(list_prepend(0.0, v[5:k]), lambda s, x: CASE WHEN x > 20 THEN s + 1 WHEN x < 20 THEN greatest(s - 2, 0) ELSE s END)::BIGINT AS counter FROM p"""


def _status():
    return F.when(F.col("event_type") == "error", "discarded").when(F.col("event_type") == "purchase", "replacement").otherwise("new")


def status_share(spark: SparkSession, d: str) -> DataFrame:
    """Shares of all statuses up to each flush of ten events, and their moving averages, at every event."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", _status().alias("status"))
    shares = E.status_ratios(e, *BY_USER, "status", ("new", "discarded"), 10)
    return shares.select("event_id", *(_rounded(f"{c}_{v}") for c in ("new", "discarded") for v in ("share", "average")))


SHARE_SQL = """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
g AS (SELECT user_id, k // 10 AS f, sum((event_type NOT IN ('error', 'purchase'))::INT) OVER w / k::DOUBLE AS new_share, sum((event_type = 'error')::INT) OVER w / k::DOUBLE AS discarded_share, k
 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY k)),
l AS (SELECT user_id, list(new_share ORDER BY f) AS a, list(discarded_share ORDER BY f) AS b FROM g WHERE k % 10 = 0 GROUP BY user_id),
p AS (SELECT e.event_id, l.a, l.b, least((e.k + 9) // 10, coalesce(len(l.a), 0)) AS n FROM e LEFT JOIN l USING (user_id))
SELECT event_id, round(coalesce(a[n], 0.0) + 1e-9, 6) AS new_share, round(coalesce(list_reduce(nullif(a[1:n], []), lambda s, x: 0.9 * s + (1 - 0.9::DOUBLE) * x), 0.0) + 1e-9, 6) AS new_average,
round(coalesce(b[n], 0.0) + 1e-9, 6) AS discarded_share, round(coalesce(list_reduce(nullif(b[1:n], []), lambda s, x: 0.9 * s + (1 - 0.9::DOUBLE) * x), 0.0) + 1e-9, 6) AS discarded_average FROM p"""


def stops(spark: SparkSession, d: str) -> DataFrame:
    """Rules A, B and C with limits that the events reach: 3 windows of 3 flat steps, 35 % discarded, 30 % bad masks (views) after 12 steps."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "value", _status().alias("status"), (F.col("event_type") == "view").cast("long").alias("bad"))
    s = E.flat_counter(E.status_ratios(e, *BY_USER, "status", ("discarded",), 10), *BY_USER, "value", 60.0, 3)
    s = s.withColumn("bad_masks", F.sum("bad").over(W.partitionBy("user_id").orderBy("step")))
    reason = E.stop_reason(F.col("step"), F.col("counter"), F.col("discarded_average"), F.col("bad_masks"), 3, 3, 0.3, 12, 0.35)
    return E.first_stops(s.withColumn("reason", reason), ["user_id"], "step", "reason")


STOPS_SQL = f"""WITH c AS ({FLAT_SQL.replace("x > 20", "x > 60").replace("x < 20", "x < 60")}), r AS ({SHARE_SQL}),
e AS (SELECT user_id, event_id, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bad FROM events),
w AS (SELECT user_id, step, CASE WHEN step > 3 AND counter >= 9 THEN 'flat entropy' WHEN discarded_average > 0.35 THEN 'discarded objects' WHEN step > 12 AND bad / step::DOUBLE > 0.3 THEN 'bad masks' END AS reason
 FROM e JOIN c USING (event_id) JOIN r USING (event_id))
SELECT user_id, count(*) AS steps, min(step) FILTER (WHERE reason IS NOT NULL) AS stop, arg_min(reason, step) FILTER (WHERE reason IS NOT NULL) AS reason FROM w GROUP BY user_id"""


def reservoir(spark: SparkSession, d: str) -> DataFrame:
    return E.top_k_reservoir(read(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 5)


RESERVOIR_SQL = "SELECT * REPLACE (rank::INT AS rank) FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5"


def seeds(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("v"))
    return T.seed_summary(e, ["event_type"], "v")


SEEDS_SQL = "SELECT event_type, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v) / sqrt(count(v)), 0.0), 6) AS se, count(v) AS n FROM (SELECT event_type, user_id % 5 AS seed, avg(value) AS v FROM events GROUP BY ALL) GROUP BY event_type"


def wide_seeds(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).cast("int").alias("seed")).agg(F.round(F.avg("value"), 6).alias("v"))
    return T.by_seed(e, ["event_type"], "seed", range(5), "v")


WIDE_SQL = "SELECT event_type, " + ", ".join(f"round(avg(value) FILTER (WHERE user_id % 5 = {s}), 6) AS seed_{s}" for s in range(5)) + " FROM events GROUP BY event_type"


def deltas(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return T.variant_delta(o, ["year"], "o_orderstatus", "F", "O", "v", 1000.0)


DELTAS_SQL = """WITH o AS (SELECT year(o_orderdate)::INT AS year, o_orderstatus AS s, avg(o_totalprice) AS v FROM orders GROUP BY ALL), x AS (SELECT a.year, round(b.v - a.v, 6) AS d FROM o a JOIN o b USING (year) WHERE a.s = 'F' AND b.s = 'O')
SELECT year, d AS delta, CASE WHEN d >= 1000 THEN '+' WHEN d <= -1000 THEN '-' ELSE '' END AS marker FROM x"""


def resume(spark: SparkSession, d: str) -> DataFrame:
    done = read(spark, d, "lineitem").filter("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return T.pending(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


RESUME_SQL = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)"


def sides(spark: SparkSession, d: str) -> DataFrame:
    """Documents and labels by id."""
    return T.side_flags(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


SIDES_SQL = "SELECT CASE WHEN d.doc_id IS NULL THEN 'right' WHEN l.doc_id IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1"


def three_way(spark: SparkSession, d: str) -> DataFrame:
    """Ids in documents, labels and vectors."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return read(spark, d, "documents").select("doc_id").intersect(read(spark, d, "labels").select("doc_id")).intersect(e)


THREE_SQL = "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings"


def zero_default(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a vector, zeros where there is none."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    both = read(spark, d, "documents").select("doc_id").join(e, "doc_id", "left")
    v = F.coalesce(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), 64))
    return both.select("doc_id", F.size(v).alias("width"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))


ZERO_SQL = "SELECT doc_id, 64 AS width, coalesce(round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6), 0.0) AS norm2 FROM documents LEFT JOIN embeddings ON vec_id = doc_id"


def stems(spark: SparkSession, d: str) -> DataFrame:
    """The first part of a part's brand and size, else of its brand with size 0 for brands that have none; else null."""
    p = read(spark, d, "part")
    exact = p.filter("p_size % 3 = 0").groupBy(F.concat_ws("_", "p_brand", "p_size").alias("stem")).agg(F.min("p_partkey").alias("first"))
    plain = p.filter("p_brand < 'Brand#4'").groupBy(F.col("p_brand").alias("stem")).agg(F.min("p_partkey").alias("first"))
    rows = p.select("p_partkey", F.col("p_brand").alias("brand"), "p_size")
    return T.first_match(rows, exact.union(plain), [F.concat_ws("_", "brand", "p_size"), F.col("brand")], "stem", "first").drop("p_size")


STEMS_SQL = """WITH e AS (SELECT p_brand, p_size, min(p_partkey) AS f FROM part WHERE p_size % 3 = 0 GROUP BY ALL), b AS (SELECT p_brand, min(p_partkey) AS f FROM part WHERE p_brand < 'Brand#4' GROUP BY ALL)
SELECT p_partkey, p.p_brand AS brand, coalesce(e.f, b.f) AS first FROM part p LEFT JOIN e ON e.p_brand = p.p_brand AND e.p_size = p.p_size LEFT JOIN b ON b.p_brand = p.p_brand"""


def sibling_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    return T.siblings(n, "n_nationkey", F.col("n_regionkey"))


SIBLINGS_SQL = "SELECT a.n_nationkey, b.n_nationkey AS sibling FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey"


def overlap(spark: SparkSession, d: str) -> DataFrame:
    """Part types that market segments share."""
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return T.group_overlap(rows, "c_mktsegment", "l_partkey")


OVERLAP_SQL = """WITH r AS (SELECT DISTINCT c_mktsegment AS g, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT a.g AS a, b.g AS b, count(*) AS shared FROM r a JOIN r b USING (p) WHERE a.g < b.g GROUP BY ALL"""


def ranked_overlap(spark: SparkSession, d: str) -> DataFrame:
    return T.ranked_overlaps(overlap(spark, d))


RANKED_SQL = f"""WITH o AS ({OVERLAP_SQL}), u AS (SELECT a, b, shared FROM o UNION ALL SELECT b, a, shared FROM o)
SELECT a, b, shared, row_number() OVER (ORDER BY shared DESC, a, b)::INT AS rank FROM u WHERE shared > 0"""


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with species, family, genus and class number."""
    n, r = read(spark, d, "nation"), read(spark, d, "region")
    taxa = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).filter("n_nationkey % 7 > 0").select("n_nationkey", F.col("n_name").alias("species"), F.col("r_name").alias("family"))
    s = read(spark, d, "supplier").join(F.broadcast(taxa), F.col("s_nationkey") == F.col("n_nationkey"), "left").withColumn("species", F.coalesce("species", F.lit("Unknown"))).withColumn("family", F.coalesce("family", F.lit("Unknown")))
    return s.join(F.broadcast(T.dense_labels(s, "species")), "species").select("s_suppkey", "species", "family", genus(F.col("species")).alias("genus"), "class_id")


TAXONOMY_SQL = """WITH t AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 7 > 0), s AS (SELECT s_suppkey, coalesce(n_name, 'Unknown') AS species, coalesce(r_name, 'Unknown') AS family FROM supplier LEFT JOIN t ON s_nationkey = n_nationkey),
c AS (SELECT species, (row_number() OVER (ORDER BY species = 'Unknown', species) - 1)::INT AS class_id FROM (SELECT DISTINCT species FROM s))
SELECT s_suppkey, species, family, CASE WHEN species = 'Unknown' THEN NULL ELSE lower(string_split(species, ' ')[1]) END AS genus, class_id FROM s JOIN c USING (species)"""


def best(spark: SparkSession, d: str) -> DataFrame:
    return T.best_row(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey")


BEST_SQL = "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"


def csr(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return T.offsets(n, "l_suppkey", F.col("n"))


CSR_SQL = "SELECT l_suppkey, n, coalesce(sum(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)"


def props(spark: SparkSession, d: str) -> DataFrame:
    """A JSON property with a default; malformed and blank strings are null."""
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).when(F.col("event_id") % 10 == 1, F.lit("")).otherwise(F.col("props"))
    k = F.from_json(raw, "k string")["k"]
    return read(spark, d, "events").select("event_id", F.coalesce(k.cast("int"), F.lit(-1)).alias("k"))


PROPS_SQL = "SELECT event_id, CASE WHEN event_id % 10 < 2 THEN -1 ELSE coalesce((props ->> '$.k')::INT, -1) END AS k FROM events"


def channels(spark: SparkSession, d: str) -> DataFrame:
    """Mean, clamped population deviation and median of values by type."""
    v = F.col("value")
    return read(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.avg(v * v) - F.avg(v) * F.avg(v))), 6).alias("std"), F.round(F.median(v), 6).alias("median"), F.max(v).alias("max"))


CHANNELS_SQL = "SELECT event_type, round(avg(value), 6) AS mean, round(sqrt(greatest(0.0, avg(value * value) - avg(value) * avg(value))), 6) AS std, round(median(value), 6) AS median, max(value) AS max FROM events GROUP BY event_type"



def crops(spark: SparkSession, d: str) -> DataFrame:
    """Toxic documents as positive crops, 150 at most."""
    kind = F.when(F.col("quality") == 0, F.lit(None)).otherwise(F.col("toxic") == 0)
    return S.crop_sample(read(spark, d, "labels").select("doc_id", "toxic", "quality"), kind, "doc_id", 150).select("doc_id", "is_positive")


CROPS_SQL = f"""WITH r AS (SELECT doc_id, toxic = 0 AS is_positive, row_number() OVER (PARTITION BY toxic = 0 ORDER BY {H.format("doc_id")}, doc_id) AS r FROM labels WHERE quality <> 0 AND toxic IS NOT NULL)
SELECT doc_id, is_positive FROM r WHERE r <= 150 AND r <= (SELECT count(*) FROM r WHERE is_positive AND r <= 150)"""


def consistency(spark: SparkSession, d: str) -> DataFrame:
    """Documents against labelled ones, by source."""
    docs = read(spark, d, "documents").select("source", "doc_id")
    return T.model_consistency(docs, docs.join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi"), "source", "doc_id")


CONSISTENCY_SQL = """WITH s AS (SELECT source, count(*) FILTER (WHERE l) AS common, count(*) FILTER (WHERE NOT l) AS only_left FROM (SELECT DISTINCT source, doc_id, doc_id IN (SELECT doc_id FROM labels) AS l FROM documents) GROUP BY source)
SELECT source, common, only_left, 0 AS only_right, only_left = 0 AS consistent FROM s"""


def summary(spark: SparkSession, d: str) -> DataFrame:
    """K6: orders as captions, open ones failed."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "O", "done").alias("caption"), (F.col("o_orderkey") % 3).alias("retry_attempts"))
    return T.run_summary(rows, {"model": "m", "batch": "10000"})


SUMMARY_SQL = """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'O') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, sum(o_orderkey % 3)::BIGINT AS retries,
round(100.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus <> 'O') / count(*), 2) AS success_pct, '{"batch": "10000", "model": "m"}' AS config FROM orders"""

QUERIES = {
    "r12_crop_sample": crops, "e16_model_consistency": consistency, "k6_run_summary": summary,
    "r1_group_split": split, "a20_split_counts": split_counts, "e15_split_verdict": split_verdict, "r6_capped_sample": capped, "r11_simple_sample": simple, "r3_balanced_resample": balanced, "r4_weighted_sample": weighted, "r5_budget_sample": budget, "r4_epoch_draws": epoch, "r5_audit_sample": audit,
    "w1_entropy_series": entropy, "w3_moving_averages": moving_average, "w10_reservoir": reservoir, "w5_status_share": status_share, "w4_confidence_average": confidence, "w6_flat_counter": flat_counter, "w7_stop_rules": stops,
    "a22_seed_summary": seeds, "k13_seed_columns": wide_seeds, "e18_variant_delta": deltas, "f19_resume": resume, "j19_side_flags": sides, "j8_three_way": three_way, "j18_zero_default": zero_default, "j10_stem_match": stems,
    "j17_siblings": sibling_pairs, "u4_group_overlap": overlap, "e20_ranked_overlaps": ranked_overlap, "j12_taxonomy": taxonomy, "a28_best_row": best, "w18_offsets": csr, "n1_json_props": props, "a16_channel_stats": channels,
}
ORACLES = {
    "r12_crop_sample": CROPS_SQL, "e16_model_consistency": CONSISTENCY_SQL, "k6_run_summary": SUMMARY_SQL,
    "r1_group_split": SPLIT_SQL, "a20_split_counts": SPLIT_COUNTS_SQL, "e15_split_verdict": VERDICT_SQL, "r6_capped_sample": CAPPED_SQL, "r11_simple_sample": SIMPLE_SQL, "r3_balanced_resample": BALANCED_SQL, "r4_weighted_sample": WEIGHTED_SQL, "r5_budget_sample": BUDGET_SQL, "r4_epoch_draws": EPOCH_SQL, "r5_audit_sample": AUDIT_SQL,
    "w1_entropy_series": ENTROPY_SQL, "w3_moving_averages": AVERAGE_SQL, "w10_reservoir": RESERVOIR_SQL, "w5_status_share": SHARE_SQL, "w4_confidence_average": CONFIDENCE_SQL, "w6_flat_counter": FLAT_SQL, "w7_stop_rules": STOPS_SQL,
    "a22_seed_summary": SEEDS_SQL, "k13_seed_columns": WIDE_SQL, "e18_variant_delta": DELTAS_SQL, "f19_resume": RESUME_SQL, "j19_side_flags": SIDES_SQL, "j8_three_way": THREE_SQL, "j18_zero_default": ZERO_SQL, "j10_stem_match": STEMS_SQL,
    "j17_siblings": SIBLINGS_SQL, "u4_group_overlap": OVERLAP_SQL, "e20_ranked_overlaps": RANKED_SQL, "j12_taxonomy": TAXONOMY_SQL, "a28_best_row": BEST_SQL, "w18_offsets": CSR_SQL, "n1_json_props": PROPS_SQL, "a16_channel_stats": CHANNELS_SQL,
}
