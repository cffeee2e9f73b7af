"""URL filters by a path-template tree (operator 1), in DataFrame functions.

Rules are (host, path) pairs that allow or block; a rule fits its host and all subdomains if the
path starts with its own, and the longest rule wins.  URLs that no rule fits are judged by their
path template:

1. Tree: for every host, the path is followed for ``DEPTH`` segments.  A segment stays literal if at
   its place in the tree it is common (``COMMON`` URLs at least, and 1 in ``SHARE``); else it becomes
   a wildcard, which keeps a file extension.  What is deeper becomes one mark.
2. Labels are the URLs that rules decide.  Templates of one host that have the same shape start as one
   branch, but those without a label are a branch of their own, for nothing says what they are like; ``ROUNDS`` times each template's rate of blocked labels is held against that of the rest of its
   branch, and those that differ significantly (two-proportion z of ``Z``), above or below, leave for
   branches of their own.  Templates that stay together are merged.
3. Purity: the blocked share of a branch's own labels, smoothed with ``STRENGTH`` labels at the rate of its
   shape over all hosts, but at one half at most.  A template is rejected if the purity is at least
   ``REJECT``, so what others did can spare a template but never reject it: without labels of its own
   branch it is allowed.

Every step is an aggregation or an equi-join with per-value counts, so one host may hold any share
of the rows.  A node of the tree has ``SHARE`` literal children at most, so a host has SHARE ^ DEPTH templates at most.

Defined cases: a null URL or one without ``://`` has an empty host and path, and no rule fits it;
equal rows are judged alike; ties between rules of one length go to the first by text; an empty
table gives no row; repeated rows count each time; very long URLs are read whole; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.llm._shared import read_table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEPTH, COMMON, SHARE, Z, ROUNDS, REJECT, STRENGTH = 3, 5, 50, 2.0, 2, 0.6, 8.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The rule that fits, as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    by_length = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    for verdict, rule_host, rule_path in reversed(by_length):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def templates(rows: DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with ``template`` and ``shape`` (its literals blanked)."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    rows = rows.withColumn("_segments", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments))
    rows = rows.withColumn("template", F.lit("")).withColumn("shape", F.lit(""))
    for level in range(DEPTH):
        value = F.get("_segments", F.lit(level))
        rows = rows.withColumn("_value", value)
        counts = rows.filter("_value is not null").groupBy("host", "template", "_value").agg(F.count(F.lit(1)).alias("n"))
        every = counts.groupBy("host", "template").agg(F.sum("n").alias("all"))
        common = counts.filter(F.col("n") >= COMMON).join(every, ["host", "template"]).filter(F.col("n") * SHARE >= F.col("all"))
        common = common.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("_value").alias("_v"))
        rows = rows.join(common, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.col("_value") == F.col("_v")), "left")
        wild = F.concat(F.lit("/*"), F.regexp_extract("_value", r"\.[A-Za-z0-9]{1,5}$", 0))
        step = F.when(F.col("_value").isNull(), F.lit("")).when(F.col("_v").isNotNull(), F.concat(F.lit("/"), "_value")).otherwise(wild)
        blank = F.when(F.col("_value").isNull(), F.lit("")).when(F.col("_v").isNotNull(), F.lit("/=")).otherwise(wild)
        rows = rows.withColumn("shape", F.concat("shape", blank)).withColumn("template", F.concat("template", step)).drop("_h", "_t", "_v", "_value")
    deeper = F.when(F.size("_segments") > DEPTH, F.lit("/**")).otherwise(F.lit(""))
    return rows.withColumn("template", F.concat("template", deeper)).withColumn("shape", F.concat("shape", deeper)).drop("_segments")


def template_purity(rows: DataFrame) -> DataFrame:
    """host, template, branch, purity of ``rows`` (host, template, shape, verdict); ``verdict`` is null where no rule fits."""
    blocked = F.sum(F.when(F.col("verdict") == "block", 1).otherwise(0))
    t = rows.groupBy("host", "shape", "template").agg(blocked.alias("b"), F.count("verdict").alias("l"))
    t = t.withColumn("branch", F.when(F.col("l") == 0, "0").otherwise(""))
    whole = W.partitionBy("host", "shape", "branch")
    for _ in range(ROUNDS):
        t = t.withColumn("bb", F.sum("b").over(whole)).withColumn("bl", F.sum("l").over(whole))
        rate, rest = (F.col("b") + 1.0) / (F.col("l") + 2.0), (F.col("bb") - F.col("b") + 1.0) / (F.col("bl") - F.col("l") + 2.0)
        p = (F.col("bb") + 1.0) / (F.col("bl") + 2.0)
        spread = F.sqrt(p * (1.0 - p) * (1.0 / (F.col("l") + 2.0) + 1.0 / (F.col("bl") - F.col("l") + 2.0)))
        side = F.when(rate - rest >= Z * spread, F.lit("+")).when(rest - rate >= Z * spread, F.lit("-")).otherwise(F.lit("="))
        t = t.withColumn("branch", F.concat("branch", side))
    shapes = t.groupBy("shape").agg(F.sum("b").alias("sb"), F.sum("l").alias("sl"))
    t = t.withColumn("bb", F.sum("b").over(whole)).withColumn("bl", F.sum("l").over(whole)).join(shapes, "shape")
    prior = F.least(F.lit(0.5), (F.col("sb") + STRENGTH * 0.5) / (F.col("sl") + STRENGTH))
    return t.select("host", "template", "branch", ((F.col("bb") + STRENGTH * prior) / (F.col("bl") + STRENGTH)).alias("purity"))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of ``pages`` (page_id, url)."""
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumn("_fit", longest_rule(F.col("host"), F.col("path"), rules))
    rows = templates(rows.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("verdict")))
    purity = template_purity(rows).select(F.col("host").alias("_h"), F.col("template").alias("_t"), "purity")
    rows = rows.join(purity, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    by_tree = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_tree).alias("verdict"), "template", "purity")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


def op1_sql() -> str:
    """The same rows in DuckDB SQL."""
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}"
        for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    )
    parts = PARTS.replace("(?s)", "")
    levels, last = [], "l0"
    for i in range(1, DEPTH + 1):
        step = "CASE WHEN v IS NULL THEN '' WHEN c.x IS NOT NULL THEN {} ELSE '/*' || regexp_extract(v, '\\.[A-Za-z0-9]{{1,5}}$') END"
        levels.append(f"""
v{i} AS (SELECT *, segments[{i}] AS v FROM {last}),
c{i} AS (SELECT host AS h, template AS t, v AS x FROM (SELECT host, template, v, count(*) AS n, sum(count(*)) OVER (PARTITION BY host, template) AS a FROM v{i} WHERE v IS NOT NULL GROUP BY host, template, v) WHERE n >= {COMMON} AND n * {SHARE} >= a),
l{i} AS (SELECT page_id, host, path, fit, segments, template || {step.format("'/' || v")} AS template, shape || {step.format("'/='")} AS shape FROM v{i} LEFT JOIN c{i} c ON host = h AND template = t AND v = x)""")
        last = f"l{i}"
    rounds, last_round = [], "t"
    for i in range(1, ROUNDS + 1):
        rounds.append(f"""
s{i} AS (SELECT *, sum(b) OVER (PARTITION BY host, shape, branch)::DOUBLE AS bb, sum(l) OVER (PARTITION BY host, shape, branch)::DOUBLE AS bl FROM {last_round}),
q{i} AS (SELECT *, (b + 1.0::DOUBLE) / (l + 2.0::DOUBLE) - (bb - b + 1.0::DOUBLE) / (bl - l + 2.0::DOUBLE) AS gap, (bb + 1.0::DOUBLE) / (bl + 2.0::DOUBLE) AS p FROM s{i}),
g{i} AS (SELECT *, {Z}::DOUBLE * sqrt(p * (1.0::DOUBLE - p) * (1.0::DOUBLE / (l + 2.0::DOUBLE) + 1.0::DOUBLE / (bl - l + 2.0::DOUBLE))) AS need FROM q{i}),
t{i} AS (SELECT host, shape, template, b, l, branch || CASE WHEN gap >= need THEN '+' WHEN -gap >= need THEN '-' ELSE '=' END AS branch FROM g{i})""")
        last_round = f"t{i}"
    return f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{parts}', 1, 's'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{parts}', 2, 's'), '') AS path FROM pages),
l0 AS (SELECT *, CASE {fits} END AS fit, CASE WHEN path = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace(path, '^/', ''), '/') END AS segments, '' AS template, '' AS shape FROM p),{",".join(levels)},
r AS (SELECT page_id, host, path, fit.rule AS rule, fit.verdict AS verdict, template || d AS template, shape || d AS shape FROM (SELECT *, CASE WHEN len(segments) > {DEPTH} THEN '/**' ELSE '' END AS d FROM {last})),
t AS (SELECT host, shape, template, count(*) FILTER (WHERE verdict = 'block') AS b, count(verdict) AS l, CASE WHEN count(verdict) = 0 THEN '0' ELSE '' END AS branch FROM r GROUP BY host, shape, template),
{",".join(rounds)},
w AS (SELECT host, shape, template, sum(b) OVER (PARTITION BY host, shape, branch)::DOUBLE AS bb, sum(l) OVER (PARTITION BY host, shape, branch)::DOUBLE AS bl, sum(b) OVER (PARTITION BY shape)::DOUBLE AS sb, sum(l) OVER (PARTITION BY shape)::DOUBLE AS sl FROM {last_round}),
u AS (SELECT host, template, (bb + {STRENGTH}::DOUBLE * least(0.5::DOUBLE, (sb + {STRENGTH}::DOUBLE * 0.5::DOUBLE) / (sl + {STRENGTH}::DOUBLE))) / (bl + {STRENGTH}::DOUBLE) AS purity FROM w)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.verdict, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, r.template, round(purity, 9) AS purity FROM r JOIN u USING (host, template)
"""
