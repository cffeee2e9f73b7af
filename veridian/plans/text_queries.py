"""Text statistics and agreement over the driver tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.functions import text as T
from veridian.functions.draws import draw_sql
from veridian.operators import agreement as A
from veridian.operators import text_stats as S
from veridian.sources.tables import read

SETS = ((), ("lang",), ("source",), ("lang", "source"))
OPENER = "the "
PHRASES = ("the", "license", "of the.", "une", "der", "idiot!", "token", "que la")
SEEDS = (42, 123, 456)

TOKENS = r"regexp_extract_all(lower({}), '([a-z]+(?:-[a-z]+)*)', 1)"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
CONTENT = "list_filter({}, lambda w: length(w) >= 3 AND NOT list_contains(" + STOP + ", w))"
GROUP_BY = "GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))"
LEVEL = "CASE WHEN grouping(lang) = 0 AND grouping(source) = 0 THEN 'lang+source' WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS level"


def _stats(value: str, name: str) -> str:
    z = "coalesce(round({}, 6), 0.0)"
    return ", ".join([f"count({value}) AS {name}_n", *[f"{z.format(f)} AS {name}_{n}" for n, f in (("mean", f"avg({value})"), ("std", f"stddev_pop({value})"), ("min", f"min({value})::DOUBLE"), ("max", f"max({value})::DOUBLE"))]])


def _pct(part: str, whole: str, name: str) -> str:
    return f"round(CASE WHEN {whole} > 0 THEN 100.0::DOUBLE * {part} / {whole} ELSE 0.0 END, 4) AS {name}"


def text_compliance(spark: SparkSession, d: str) -> DataFrame:
    return S.compliance(read(spark, d, "documents"), "text", SETS, OPENER)


COMPLIANCE_SQL = f"""
WITH w AS (SELECT lang, source, len({TOKENS.format("text")}) AS words, length(text) AS chars, greatest(length(regexp_replace(text, '[^.!?]', '', 'g')), 1) AS sentences,
  CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS digit,
  CASE WHEN regexp_matches(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])[0-9]+(?:\\.[0-9]+)?\\s*(?:µm|μm|um|microns?|micrometers?|mm|x)\\b') THEN 1 ELSE 0 END AS size_leak, CASE WHEN starts_with(lower(text), '{OPENER}') THEN 1 ELSE 0 END AS opener FROM documents)
SELECT lang, source, {LEVEL}, {_stats("words", "words")}, {_stats("chars", "chars")}, {_stats("sentences", "sentences")},
  {", ".join(f"quantile_disc(words, {p / 100})::BIGINT AS words_p{p}" for p in (5, 25, 50, 75, 95))},
  {", ".join(_pct(f"sum({c})", "count(*)", f"{c}_pct") for c in ("digit", "size_leak", "opener"))} FROM w {GROUP_BY}"""


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return S.vocabulary(read(spark, d, "documents"), "text", "source")


VOCABULARY_SQL = f"""SELECT source, count(DISTINCT w) AS vocabulary, count(*) AS words, round(count(DISTINCT w) / greatest(count(*), 1)::DOUBLE, 6) AS ttr
FROM (SELECT source, unnest({TOKENS.format("text")}) AS w FROM documents) GROUP BY source"""


def phrases(spark: SparkSession, d: str) -> DataFrame:
    return S.phrase_counts(read(spark, d, "documents"), "text", PHRASES)


PHRASES_SQL = "\nUNION ALL ".join(
    f"SELECT '{p}' AS phrase, count(*) FILTER (WHERE contains(lower(text), '{p.rstrip('.,;:!?')}')) AS captions, {_pct(f'''count(*) FILTER (WHERE contains(lower(text), '{p.rstrip('.,;:!?')}'))''', 'count(*)', 'pct')} FROM documents" for p in PHRASES
)


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return S.term_frequencies(read(spark, d, "documents"), "text", "source")


TERMS_SQL = f"SELECT w AS term, count(*) AS term_frequency, count(DISTINCT source) AS document_frequency FROM (SELECT source, unnest({CONTENT.format(TOKENS.format('text'))}) AS w FROM documents) GROUP BY w"


def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.most_common(term_frequencies(spark, d).select("term", "term_frequency"), "term", "term_frequency", 30)


TOP_TERMS_SQL = f"SELECT term, term_frequency FROM ({TERMS_SQL}) ORDER BY term_frequency DESC, term LIMIT 30"


def compounds(spark: SparkSession, d: str) -> DataFrame:
    pages = read(spark, d, "pages").select(F.explode(T.hyphenated(F.col("html"))).alias("compound"))
    return pages.groupBy("compound").agg(F.count(F.lit(1)).alias("n"))


COMPOUNDS_SQL = "SELECT c AS compound, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html), '([a-z]+-[a-z]+(?:-[a-z]+)*)', 1)) AS c FROM pages) GROUP BY c"


def bigrams(spark: SparkSession, d: str) -> DataFrame:
    return S.frequent_bigrams(read(spark, d, "documents"), "text", 3)


BIGRAMS_SQL = f"""WITH w AS (SELECT doc_id, list_transform(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: regexp_replace(x, '[^a-z-]', '', 'g')) AS w FROM documents),
p AS (SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM w)
SELECT p.a || ' ' || p.b AS bigram, count(*) AS n FROM p WHERE p.a <> '' AND p.b <> '' AND NOT list_contains({STOP}, p.a) AND NOT list_contains({STOP}, p.b) GROUP BY 1 HAVING count(*) >= 3"""


def _anchor_terms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.explode(T.content_words(T.tokens(F.col("text")))).alias("term")).distinct()


ANCHORS = f"SELECT DISTINCT unnest({CONTENT.format(TOKENS.format('text'))}) AS term FROM benchmark"


def anchor_overlap(spark: SparkSession, d: str) -> DataFrame:
    return S.anchor_overlap(read(spark, d, "documents"), "text", _anchor_terms(spark, d), SETS)


OVERLAP_SQL = f"""
WITH a AS ({ANCHORS}), t AS (SELECT count(*) AS total FROM a),
w AS (SELECT doc_id, lang, source, list_distinct({CONTENT.format(TOKENS.format("text"))}) AS w FROM documents),
h AS (SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(w) AS term FROM w) JOIN a USING (term) GROUP BY doc_id),
e AS (SELECT lang, source, len(w) AS n_terms, coalesce(hits, 0) / greatest(len(w), 1)::DOUBLE AS precision, CASE WHEN total > 0 THEN coalesce(hits, 0) / total::DOUBLE ELSE 0.0 END AS recall FROM w LEFT JOIN h USING (doc_id) CROSS JOIN t),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM e)
SELECT lang, source, {LEVEL}, {_stats("precision", "precision")}, {_stats("recall", "recall")}, {_stats("f1", "f1")}, {_stats("n_terms", "terms")} FROM f {GROUP_BY}"""


def term_usage(spark: SparkSession, d: str) -> DataFrame:
    return S.term_usage(read(spark, d, "documents"), "text", _anchor_terms(spark, d))


USAGE_SQL = f"""WITH a AS ({ANCHORS}), u AS (SELECT term, count(*) AS captions FROM (SELECT unnest(list_distinct({CONTENT.format(TOKENS.format("text"))})) AS term FROM documents) GROUP BY term)
SELECT term, coalesce(captions, 0) AS captions FROM a LEFT JOIN u USING (term)"""


def usage_coverage(spark: SparkSession, d: str) -> DataFrame:
    return S.usage_coverage(term_usage(spark, d))


COVERAGE_SQL = f"SELECT count(*) AS terms, count(*) FILTER (WHERE captions > 0) AS used, {_pct('count(*) FILTER (WHERE captions > 0)', 'count(*)', 'coverage_pct')} FROM ({USAGE_SQL})"


def taxon_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source that hold a word of a benchmark item with the source's number."""
    items = read(spark, d, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("source"), "text").groupBy("source").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("names"))
    docs = read(spark, d, "documents").join(items, "source", "left")
    leak = F.coalesce(T.leaks_taxon(T.tokens(F.col("text")), F.col("names"), ("unknown", "the", "of")), F.lit(False))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("captions"), F.sum(leak.cast("long")).alias("leaks"))


LEAKAGE_SQL = f"""WITH i AS (SELECT 'src' || (item_id % 20) AS source, list_filter(flatten(list({TOKENS.format("text")})), lambda w: w NOT IN ('unknown', 'the', 'of')) AS names FROM benchmark GROUP BY 1)
SELECT d.source, count(*) AS captions, coalesce(sum(CASE WHEN list_has_any({TOKENS.format("text")}, names) THEN 1 ELSE 0 END), 0)::BIGINT AS leaks FROM documents d LEFT JOIN i ON i.source = d.source GROUP BY d.source"""


def string_functions(spark: SparkSession, d: str) -> DataFrame:
    """T13, T14, T16-T21 on strings made from document rows."""
    slide = F.concat("lang", F.lit("_"), F.col("doc_id") % 7, F.lit("_edf"))
    raw = F.concat(F.lit("<think>so\nit is</think>  "), "source", F.lit(" #"), F.col("doc_id"))
    return read(spark, d, "documents").select(
        "doc_id",
        T.canonical_key(slide).alias("canonical"),
        T.strip_thoughts(raw).alias("answer"),
        T.run_name(raw).alias("run_name"),
        T.model_short_name(F.concat(F.lit("production_"), "source", F.lit("_final"))).alias("model"),
        T.file_stem(F.concat(slide, F.lit("_captions"))).alias("stem"),
        T.genus(F.concat("source", F.lit(" "), "lang")).alias("genus"),
        T.pair_key(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")), F.when(F.col("doc_id") % 3 == 1, F.col("source")), F.lit(None).cast("int"), F.col("doc_id")).alias("pair_key"),
        T.shown(F.when(F.col("doc_id") % 5 > 0, F.col("n_chars") * 10), 2).alias("shown"),
    )


STRINGS_SQL = r"""
WITH s AS (SELECT *, lang || '_' || (doc_id % 7) || '_edf' AS slide, '<think>so' || chr(10) || 'it is</think>  ' || source || ' #' || doc_id AS raw FROM documents)
SELECT doc_id, regexp_replace(slide, '^(.*?)_([0-9]+)(_edf)$', '\1\3') AS canonical, regexp_replace(raw, '<think>.*?</think>\s*', '', 'sg') AS answer,
  regexp_replace(raw, '[^A-Za-z0-9._-]', '_', 'g') AS run_name, source AS model, slide AS stem, lower(source) AS genus,
  CASE WHEN doc_id % 3 = 0 THEN 'id:' || doc_id WHEN doc_id % 3 = 1 THEN 'image_path:' || source ELSE 'row:' || lpad(doc_id::VARCHAR, 8, '0') END AS pair_key,
  CASE WHEN doc_id % 5 > 0 THEN format('{:,.2f}', (n_chars * 10)::DOUBLE) ELSE '-' END AS shown FROM s"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """T15 and P6-P8 on parts seen as grains."""
    from veridian.functions.geometry import size_class

    mpp = F.coalesce(F.when(F.col("p_partkey") % 11 == 0, F.lit(0.25)), F.when(F.col("p_partkey") % 3 == 0, F.lit(0.5)), F.lit(0.22))
    polar, equatorial = F.col("p_size") * 4 * mpp, F.col("p_size") * 3 * mpp
    area = F.col("p_size") * 12 * mpp * mpp
    part = read(spark, d, "part")
    return part.select("p_partkey", T.caption_prompt(F.col("p_type"), F.col("p_name"), size_class(polar, equatorial), F.col("p_partkey") % 4 / 4, polar, equatorial, F.floor(area).cast("double")).alias("prompt"))


PROMPTS_SQL = """
WITH m AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 0.25 WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0.22 END::DOUBLE AS mpp FROM part),
x AS (SELECT *, p_size * 4 * mpp AS polar, p_size * 3 * mpp AS equatorial, floor(p_size * 12 * mpp * mpp) AS area FROM m)
SELECT p_partkey, p_type || chr(10) || p_name || chr(10) || 'Size class: ' || CASE WHEN (polar + equatorial) / 2 < 20 THEN 'small' WHEN (polar + equatorial) / 2 < 50 THEN 'medium-sized' ELSE 'large' END
  || '. Confidence: ' || format('{:.2f}', (p_partkey % 4) / 4.0::DOUBLE) || '. Axes: ' || format('{:.1f}', round(polar, 1)) || ' x ' || format('{:.1f}', round(equatorial, 1)) || ' um. Area: ' || format('{:.0f}', area) || ' um2.' AS prompt FROM x"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """User and assistant turns as two captions of one thing, by their number within the role."""
    turns = read(spark, d, "conversations").filter("role in ('user', 'assistant')")
    turns = turns.withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "role").orderBy("turn")))
    side = lambda r: turns.filter(F.col("role") == r).select("conv_id", "nth", "text")
    return side("user"), side("assistant")


def pair_report(spark: SparkSession, d: str) -> DataFrame:
    pairs = A.with_jaccard(A.pair_join(*_sides(spark, d), ["conv_id", "nth"], "text"))
    return A.agreement_report(pairs.withColumn("turn_no", F.col("nth").cast("string")), ((), ("turn_no",)))


PAIRS = f"""t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE role IN ('user', 'assistant')),
j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.nth, b.nth) AS nth, a.text AS ta, b.text AS tb, a.conv_id IS NOT NULL AS in_a, b.conv_id IS NOT NULL AS in_b
  FROM (SELECT * FROM t WHERE role = 'user') a FULL JOIN (SELECT * FROM t WHERE role = 'assistant') b USING (conv_id, nth)),
s AS (SELECT *, list_distinct({TOKENS.format("ta")}) AS wa, list_distinct({TOKENS.format("tb")}) AS wb FROM j),
p AS (SELECT conv_id, nth, ta, tb, in_a, in_b, CASE WHEN in_a AND in_b AND len(wa) > 0 AND len(wb) > 0 THEN len(list_intersect(wa, wb)) / len(list_distinct(wa || wb))::DOUBLE END AS jaccard FROM s)"""

PAIR_REPORT_SQL = f"""WITH {PAIRS}
SELECT nth::VARCHAR AS turn_no, CASE WHEN grouping(nth) = 0 THEN 'turn_no' ELSE 'all' END AS level, {_stats("jaccard", "jaccard")}, count(*) FILTER (WHERE in_a AND in_b) AS matched, count(jaccard) AS scored,
  count(*) FILTER (WHERE in_a AND NOT in_b) AS only_a, count(*) FILTER (WHERE in_b AND NOT in_a) AS only_b FROM p GROUP BY GROUPING SETS ((), (nth))"""


def last_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Two turns of a role share a key; the last one counts, the others are told."""
    keys = ["conv_id", "pair"]
    a, b = (A.last_of_each(side.withColumn("pair", F.floor(F.col("nth") / 2)), keys, "nth") for side in _sides(spark, d))
    told = a.select(*keys, F.col("duplicates").alias("duplicates_a")).join(b.select(*keys, F.col("duplicates").alias("duplicates_b")), keys, "full_outer")
    pairs = A.with_jaccard(A.pair_join(a, b, keys, "text")).join(told, keys)
    return pairs.select(*keys, "matched", F.round("jaccard", 6).alias("jaccard"), F.coalesce("duplicates_a", F.lit(0)).alias("duplicates_a"), F.coalesce("duplicates_b", F.lit(0)).alias("duplicates_b"))


LAST_PAIRS_SQL = f"""WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE role IN ('user', 'assistant')),
k AS (SELECT conv_id, nth // 2 AS pair, role, arg_max(text, nth) AS text, count(*) - 1 AS duplicates FROM n GROUP BY ALL),
j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pair, b.pair) AS pair, a.text AS ta, b.text AS tb, a.conv_id IS NOT NULL AND b.conv_id IS NOT NULL AS matched, coalesce(a.duplicates, 0) AS duplicates_a, coalesce(b.duplicates, 0) AS duplicates_b
 FROM (SELECT * FROM k WHERE role = 'user') a FULL JOIN (SELECT * FROM k WHERE role = 'assistant') b USING (conv_id, pair)),
s AS (SELECT *, list_distinct({TOKENS.format("ta")}) AS wa, list_distinct({TOKENS.format("tb")}) AS wb FROM j)
SELECT conv_id, pair, matched, round(CASE WHEN matched AND len(wa) > 0 AND len(wb) > 0 THEN len(list_intersect(wa, wb)) / len(list_distinct(wa || wb))::DOUBLE END, 6) AS jaccard, duplicates_a, duplicates_b FROM s"""


def vocabulary_matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs = A.group_vocabulary_pairs(read(spark, d, "documents"), "text", "source")
    return A.symmetric_matrix(pairs, "a", "b", "jaccard").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


MATRIX_SQL = f"""WITH w AS (SELECT DISTINCT source AS g, unnest({TOKENS.format("text")}) AS w FROM documents), n AS (SELECT g, count(*) AS n FROM w GROUP BY g),
c AS (SELECT x.g AS a, y.g AS b, count(*) AS c FROM w x JOIN w y USING (w) GROUP BY ALL)
SELECT x.g AS a, y.g AS b, CASE WHEN x.g = y.g THEN 1.0 ELSE round(coalesce(c, 0) / (x.n + y.n - coalesce(c, 0))::DOUBLE, 6) END AS jaccard FROM n x CROSS JOIN n y LEFT JOIN c ON c.a = x.g AND c.b = y.g"""


def shuffled_control(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation of shuffled pairs for each seed, beside the real mean."""
    pairs = A.with_jaccard(A.pair_join(*_sides(spark, d), ["conv_id", "nth"], "text"))
    real = pairs.agg(F.avg("jaccard").alias("real"))
    out = None
    for seed in SEEDS:
        one = A.with_jaccard(A.shuffled_pairs(pairs, ["conv_id", "nth"], ["nth"], seed))
        one = one.agg(F.lit(seed).alias("seed"), F.count("jaccard").alias("n"), F.avg("jaccard").alias("mean"), F.stddev_samp("jaccard").alias("std"))
        out = one if out is None else out.union(one)
    out = out.crossJoin(F.broadcast(real))
    return out.select("seed", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.col("real") - F.col("mean"), 6).alias("delta"))


CONTROL_SQL = f"WITH {PAIRS}, m AS (SELECT * FROM p WHERE in_a AND in_b), r AS (SELECT avg(jaccard) AS real FROM p)\n" + "\nUNION ALL ".join(
    f"""SELECT {seed} AS seed, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(any_value(real) - avg(x), 6) AS delta FROM (
SELECT CASE WHEN len(wa) > 0 AND len(wb) > 0 THEN len(list_intersect(wa, wb)) / len(list_distinct(wa || wb))::DOUBLE END AS x, real FROM (
SELECT list_distinct({TOKENS.format("a.ta")}) AS wa, list_distinct({TOKENS.format("b.tb")}) AS wb, real FROM
(SELECT nth, ta, row_number() OVER (PARTITION BY nth ORDER BY conv_id) AS k FROM m) a JOIN
(SELECT nth, tb, row_number() OVER (PARTITION BY nth ORDER BY {draw_sql(str(seed), "conv_id", "nth")}, conv_id) AS k FROM m) b USING (nth, k) CROSS JOIN r))"""
    for seed in SEEDS
)

QUERIES = {
    "a5_text_compliance": text_compliance,
    "a6_vocabulary": vocabulary,
    "a7_phrase_counts": phrases,
    "t12_term_frequencies": term_frequencies,
    "o5_top_terms": top_terms,
    "t10_hyphenated": compounds,
    "t11_bigrams": bigrams,
    "a8_anchor_overlap": anchor_overlap,
    "a9_term_usage": term_usage,
    "a9_usage_coverage": usage_coverage,
    "t8_taxon_leakage": taxon_leakage,
    "t13_string_functions": string_functions,
    "t15_prompts": prompts,
    "j4_pair_agreement": pair_report,
    "j4_last_pairs": last_pairs,
    "a11_vocabulary_matrix": vocabulary_matrix,
    "r9_shuffled_control": shuffled_control,
}

ORACLES = {
    "a5_text_compliance": COMPLIANCE_SQL,
    "a6_vocabulary": VOCABULARY_SQL,
    "a7_phrase_counts": PHRASES_SQL,
    "t12_term_frequencies": TERMS_SQL,
    "o5_top_terms": TOP_TERMS_SQL,
    "t10_hyphenated": COMPOUNDS_SQL,
    "t11_bigrams": BIGRAMS_SQL,
    "a8_anchor_overlap": OVERLAP_SQL,
    "a9_term_usage": USAGE_SQL,
    "a9_usage_coverage": COVERAGE_SQL,
    "t8_taxon_leakage": LEAKAGE_SQL,
    "t13_string_functions": STRINGS_SQL,
    "t15_prompts": PROMPTS_SQL,
    "j4_pair_agreement": PAIR_REPORT_SQL,
    "j4_last_pairs": LAST_PAIRS_SQL,
    "a11_vocabulary_matrix": MATRIX_SQL,
    "r9_shuffled_control": CONTROL_SQL,
}
