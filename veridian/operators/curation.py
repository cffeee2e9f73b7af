"""Annotation curation, the training index, and readiness of slides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGION_CLASS, OBJECT_CLASS = "Test Region", "Pollen"


def category_counts(features: DataFrame, by: str) -> DataFrame:
    """Features of each file: all, regions, classified objects, those without a class, others."""
    kind = F.col("class")
    region, known, none = kind == REGION_CLASS, kind == OBJECT_CLASS, kind.isNull()
    return features.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(region).alias("test_regions"), F.count_if(known).alias("classified"),
        F.count_if(none).alias("unclassified"), F.count_if(~region & ~known).alias("other"),
    )


def class_counts(rows: DataFrame, by: Sequence[str], value: str, k: int = 10) -> DataFrame:
    """Distinct values of each group, and its k most common ones with their counts, ties by value."""
    each = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(value).alias("value")))), 1, k)
    named = F.transform(top, lambda r: F.concat(r["value"].cast("string"), F.lit(":"), (-r["o"]).cast("string")))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("n_classes"), F.sum("n").alias("n"), named.alias("top"))


def kept_boxes(raw: DataFrame, confirmed: DataFrame, key: str, box: Sequence[str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Boxes of raw files with ``status`` preserved or removed, by exact equality within the file."""
    a, b = raw.select(key, *box).distinct(), confirmed.select(key, *box).distinct().withColumn("_in", F.lit(1))
    return a.join(b, [key, *box], "left").withColumn("status", F.when(F.col("_in").isNull(), "removed").otherwise("preserved")).drop("_in")


def all_regions(*sets: DataFrame) -> DataFrame:
    """Regions of several test sets with the number of the set, each once in it."""
    out = None
    for i, s in enumerate(sets):
        one = s.distinct().withColumn("test_set", F.lit(f"TS{i + 1}"))
        out = one if out is None else out.unionByName(one)
    return out


def match_by_substring(confirmed: DataFrame, raw: DataFrame, name: str = "file", grams: int = 4) -> DataFrame:
    """``confirmed`` files with the raw file whose name holds theirs, without suffixes; null if there is none.

    Of several the first by name is taken.  Names that hold one another share all their character n-grams, so
    candidates come from an equality join on the name's first ``grams`` characters anywhere in the other name; shorter names are
    matched the same way on their own length.
    """
    base = F.regexp_replace(F.regexp_replace(F.col(name), r"_pyramid\.geojson$", ""), r"\.geojson$", "")
    c = confirmed.select(F.col(name).alias("confirmed"), base.alias("base")).distinct()
    c = c.withColumn("_gram", F.substring("base", 1, grams))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(grams)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substr(F.col(name), i, n))))
    r = raw.select(F.col(name).alias("raw"), F.explode(F.array_distinct(pieces)).alias("_gram"))
    hit = c.join(r, "_gram").filter(F.contains("raw", F.col("base"))).groupBy("confirmed").agg(F.min("raw").alias("raw"))
    return c.select("confirmed", "base").join(hit, "confirmed", "left").select("confirmed", "raw", F.concat("base", F.lit("_curated.geojson")).alias("output"))


def pick_mask(masks: DataFrame, group: Sequence[str], least: int, most: int) -> DataFrame:
    """The best score among masks with an area in range, else the best of all; ties go to the lower number."""
    tier = F.struct(F.col("area").between(least, most).alias("ok"), F.col("score"), (-F.col("mask")).alias("o"))
    best = masks.groupBy(*group).agg(F.max_by(F.struct("mask", "area", "score"), tier).alias("b"), F.max(F.col("area").between(least, most)).alias("in_range"))
    return best.select(*group, "b.mask", "b.area", "b.score", "in_range")


def decode_labels(rows: DataFrame, number: str, names: DataFrame) -> DataFrame:
    """``class_name`` of a class number from ``names`` (class_id, name), ``class_<number>`` where there is none."""
    known = names.select(F.col("class_id").alias("_c"), F.col("name").alias("_name"))
    return rows.join(known, F.col(number) == F.col("_c"), "left").withColumn("class_name", F.coalesce("_name", F.concat(F.lit("class_"), F.col(number)))).drop("_c", "_name")


def flatten_maps(rows: DataFrame, column: str, outer: str, inner: str, value: str) -> DataFrame:
    """A map of maps as rows."""
    rest = [c for c in rows.columns if c != column]
    one = rows.select(*rest, F.explode(column).alias(outer, "_m"))
    return one.select(*rest, outer, F.explode("_m").alias(inner, value))


def training_index(splits: DataFrame, captions: DataFrame, species: DataFrame, paths: DataFrame, split: str, datasets: Sequence[str]) -> DataFrame:
    """id, slide, box, species and image path of every sample of a split.

    ``splits`` (slide, split, sample_id), ``captions`` (dataset, slide, id, x1, y1, x2, y2), ``species`` (slide, species: the verified one, not the
    captions'), ``paths`` (slide, path).  A slide's captions come from the first of ``datasets`` that has it; slides without
    captions or with an unknown species go; one without a path stays.  Repeated caption lines stay.
    """
    rank = F.array_position(F.array(*map(F.lit, datasets)), F.col("dataset"))
    chosen = captions.filter(rank > 0).groupBy("slide").agg(F.min_by("dataset", rank).alias("dataset"))
    wanted = splits.filter(F.col("split") == split).select("slide", F.col("sample_id").alias("id")).distinct()
    known = species.filter("lower(species) <> 'unknown'").select("slide", "species")
    rows = captions.join(chosen, ["slide", "dataset"]).join(wanted, ["slide", "id"]).join(known, "slide").join(paths.select("slide", "path"), "slide", "left")
    return rows.select("id", "slide", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], "species", "path")


def common_slides(rows: DataFrame, model: str, slide: str, a: str, b: str) -> DataFrame:
    """Slides that two models both have."""
    return rows.filter(F.col(model) == a).select(slide).intersect(rows.filter(F.col(model) == b).select(slide))


def readiness(files: DataFrame, anchors: DataFrame, excluded: DataFrame) -> DataFrame:
    """slide, status of filtered files: excluded, no anchor, ready.

    An anchor is looked for first.  A slide is excluded if a listed name begins with its own, as a line search for
    ``slide: <name>`` finds it.
    """
    base = files.select("slide").distinct()
    known = anchors.select("slide").distinct().withColumn("_anchor", F.lit(1))
    # every beginning of a listed name: names are short
    starts = excluded.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("slide")), lambda i: F.substr(F.col("slide"), F.lit(1), i))).alias("slide")).distinct().withColumn("_out", F.lit(1))
    status = F.when(F.col("_anchor").isNull(), "no anchor").when(F.col("_out").isNotNull(), "excluded").otherwise("ready")
    return base.join(known, "slide", "left").join(starts, "slide", "left").select("slide", status.alias("status"))


def with_inputs(wanted: DataFrame, inputs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose input exists, and the others."""
    have = inputs.select(key).distinct()
    return wanted.join(have, key, "left_semi"), wanted.join(have, key, "left_anti")


def expand_regions(rows: DataFrame, region: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """A row for each dataset of its region, as ``groups`` says; unknown regions give none."""
    table = F.create_map(*[x for name, sets in groups.items() for x in (F.lit(name), F.array(*map(F.lit, sets)))])
    return rows.withColumn("dataset", F.explode(F.try_element_at(table, F.col(region))))


def freedman_diaconis(values: Column, least: int = 100) -> Column:
    """Number of bins: range over 2 IQR / cube root of n, at least ``least`` (G19); an aggregate."""
    q = F.percentile(values, F.array(F.lit(0.25), F.lit(0.75)))
    width = 2.0 * (q[1] - q[0]) / F.cbrt(F.count(values).cast("double"))
    return F.greatest(F.lit(least), F.coalesce(F.floor(F.try_divide(F.max(values) - F.min(values), width)), F.lit(least))).cast("int")
