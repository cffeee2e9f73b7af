"""Readers of corpus artefacts with explicit schemas; malformed input is dropped or null, never a failure."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridian.functions.geometry import ring_box
from veridian.functions.text import pair_key

CAPTION = """id string, caption string, species string, family string, source_slide string, caption_model string, bbox array<double>, similarity_confidence double,
confidence_refined double, class_id int, class_name string, class_prob double, temperature double, max_tokens int, mask_index int, sam_point array<int>, wsi_topleft array<int>,
prompt string, polar_diameter_um double, equatorial_diameter_um double, area_um2 double, timestamp string, retry_attempts int, image_path string"""
GEOJSON = """type string, features array<struct<id string, geometry struct<type string, coordinates array<array<array<double>>>>, properties struct<objectType string, name string, isLocked boolean,
classification string, source string, original_index int, confidence double, predicted_class string, predicted_prob double, n_grains int, description string>>>"""
SPLIT = "slide string, split string, sample_ids array<string>, indices array<string>, count int"


def _stem(path: str = "_path"):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, _path, line: the text lines below ``path``, numbered from 0 in each file.

    A split of a file is read in order by one task, so its lines have consecutive ids; what comes before it in the
    file is the sum over earlier splits, one row for each.
    """
    meta = F.col("_metadata")
    raw = spark.read.text(path, recursiveFileLookup=True).select("value", meta["file_path"].alias("_path"), meta["file_block_start"].alias("_at"), F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("_path", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_path").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_path", "_at", (before - F.col("_first")).alias("_shift"))
    return raw.join(splits, ["_path", "_at"]).select("value", "_path", (F.col("_id") + F.col("_shift")).alias("line"))


def read_captions(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Caption JSON lines below ``path``: blank, malformed and empty ones go; captions are trimmed; ``pair_key`` is added.

    ``most``: at most so many captions of each file, in line order.
    """
    lines = _numbered_lines(spark, path)
    rows = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", CAPTION)).filter("r.caption is not null")
    rows = rows.select("r.*", "line", _stem().alias("file")).withColumn("caption", F.trim("caption")).filter("caption <> ''")
    rows = rows.withColumn("pair_key", pair_key(F.col("id"), F.col("image_path"), F.col("mask_index"), F.col("line")))
    if most is not None:
        rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("file").orderBy("line"))).filter(F.col("_n") <= most).drop("_n")
    return rows


def captions_by_id(captions: DataFrame, ids: DataFrame) -> DataFrame:
    """Captions whose id is asked for."""
    return captions.join(ids.select("id").distinct(), "id", "left_semi")


def boxes_by_id(captions: DataFrame) -> DataFrame:
    """Integer boxes by id, the last of repeated ids."""
    known = captions.filter("id is not null and size(bbox) = 4")
    last = known.groupBy("id").agg(F.max_by("bbox", "line").alias("b"))
    return last.select("id", *[F.col("b")[i].cast("int").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features with class (from an object, a string or null) and bounds of ring 0.

    ``problem`` says what is wrong with a feature; good ones have null.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("_path"))
    # the features stand in a column of their own: a row of the explosion must not carry its whole collection
    doc = files.withColumn("g", F.from_json("value", GEOJSON)).select(_stem().alias("slide"), F.col("g.type").alias("kind"), F.col("g.features").alias("features"))
    f = doc.select("slide", "kind", F.explode_outer("features").alias("f"))
    named = F.from_json("f.properties.classification", "name string")["name"]
    plain = F.when(~F.startswith(F.trim("f.properties.classification"), F.lit("{")), F.col("f.properties.classification"))
    ring = F.get("f.geometry.coordinates", F.lit(0))
    problem = (
        F.when(F.coalesce(F.col("kind"), F.lit("")) != "FeatureCollection", "not a FeatureCollection")
        .when(F.col("f").isNull(), "no features")
        .when(F.col("f.geometry").isNull() | F.col("f.properties").isNull(), "geometry or properties missing")
        .when(~F.col("f.geometry.type").isin("Polygon", "MultiPolygon"), "not a polygon")
    )
    out = f.select("slide", F.col("f.id").alias("feature_id"), F.col("f.properties.name").alias("name"), F.coalesce(named, plain).alias("class"), F.col("f.properties.source").alias("source"), F.size(ring).alias("points"), ring_box(ring).alias("b"), problem.alias("problem"))
    return out.select("slide", "feature_id", "name", "class", "source", "points", "b.*", "problem")


def test_regions(annotations: DataFrame) -> DataFrame:
    """Features that are regions by name or by class."""
    return annotations.filter("problem is null and (name = 'test_region' or class = 'Test Region')")


def labelled_objects(annotations: DataFrame, labels: DataFrame, kind: str, species: list[str] | None = None) -> DataFrame:
    """Objects of a class with at least four points on slides that have a label."""
    rows = annotations.filter((F.col("class") == kind) & (F.col("points") >= 4)).join(labels.select("slide", "species"), "slide")
    rows = rows.select("slide", "feature_id", "species", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return rows if species is None else rows.filter(F.lower("species").isin([s.lower() for s in species]))


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """One row for each slide from its ``{slide}_{role}.txt`` files; absent names are Unknown, absent texts empty."""
    roles = ["anchor", "species", "family", "hint", "species_verified"]
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select("value", _stem("_metadata.file_path").alias("stem"))
    part = r"^(.*?)_(anchor|species_verified|species|family|hint)$"
    rows = files.select(F.regexp_extract("stem", part, 1).alias("slide"), F.regexp_extract("stem", part, 2).alias("role"), F.trim(F.regexp_replace("value", r"\s+$", "")).alias("text")).filter("slide <> ''")
    wide = rows.groupBy("slide").pivot("role", roles).agg(F.first("text"))
    return wide.select("slide", *[F.coalesce(r, F.lit("" if r in ("anchor", "hint") else "Unknown")).alias(r) for r in roles])


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """(slide, split, sample_id) of split files; the slide falls back to the file's name, ids to the older key."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(F.from_json("value", SPLIT).alias("s"), _stem("_metadata.file_path").alias("stem"))
    slide = F.coalesce("s.slide", F.regexp_replace("stem", "_(train|val)$", ""))
    return raw.select(slide.alias("slide"), F.coalesce("s.split", F.regexp_extract("stem", "_(train|val)$", 1)).alias("split"), F.explode(F.coalesce("s.sample_ids", "s.indices")).alias("sample_id"))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files of a tree ``experiment/seed/eval_*.json`` with the keys of their path."""
    rows = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True).withColumn("_p", F.col("_metadata.file_path"))
    part = r"([^/]+)/(?:seed_)?([0-9]+)/(eval_[^/]+)\.json$"
    return rows.select(F.regexp_extract("_p", part, 1).alias("experiment"), F.regexp_extract("_p", part, 2).alias("seed"), F.regexp_extract("_p", part, 3).alias("evaluation"), "*").drop("_p")


def filled(first: DataFrame, *others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Results of several layouts in one table with ``place`` (0: the first): a later table adds only keys that those before it lack.

    Columns that a table lacks are null.
    """
    out = first.withColumn("place", F.lit(0))
    for i, other in enumerate(others, 1):
        out = out.unionByName(other.join(out.select(*keys), list(keys), "left_anti").withColumn("place", F.lit(i)), allowMissingColumns=True)
    return out


def read_training_log(spark: SparkSession, path: str, columns: list[str], text: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """A CSV log; empty and infinite values are null, time stamps stay text."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=True)
    number = lambda c: F.when(~F.lower(F.trim(c)).isin("", "inf", "-inf"), F.col(c)).cast("double").alias(c)
    return raw.select(*[F.col(c) if c in text else number(c) for c in columns])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with species and class from their folders (S23); the content is read only if it is used."""
    rows = spark.read.format("binaryFile").load(path, recursiveFileLookup=True, pathGlobFilter="*.png")
    parts = F.split("path", "/")
    return rows.withColumn("species", F.element_at(parts, -3)).withColumn("kind", F.when(F.lower(F.element_at(parts, -2)).contains("background"), "background").otherwise("object"))


def read_vectors(spark: SparkSession, path: str, labels: DataFrame | None = None) -> DataFrame:
    """(sample_id, slide, emb); rows of near-zero norm and of slides with an unknown label go."""
    rows = spark.read.schema("sample_id string, slide string, emb array<float>").parquet(path)
    rows = rows.filter(F.sqrt(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x * x)) > 1e-6)
    if labels is not None:
        rows = rows.join(labels.filter("lower(species) <> 'unknown'").select("slide"), "slide", "left_semi")
    return rows


def config_table(spark: SparkSession, path: str | Path, entry: str) -> DataFrame:
    """Rows of a YAML file: ``defaults``/``slides`` maps (pixel sizes, P8) or ``excluded`` lists of names or mappings."""
    import yaml

    data = yaml.safe_load(Path(path).read_text()) or {}
    if entry == "excluded":
        rows = [(group, e["slide"] if isinstance(e, dict) else str(e)) for group, v in data.items() if isinstance(v, dict) for e in v.get("excluded") or ()]
        return spark.createDataFrame(rows, "dataset string, slide string")
    return spark.createDataFrame([(k, float(v)) for k, v in (data.get(entry) or {}).items()], "name string, value double")


def tile_grid(slides: DataFrame, size: int, overlap: int) -> DataFrame:
    """Row-major tiles of each slide (slide, width, height) with stride size - overlap; edge tiles are not moved."""
    step = size - overlap
    axis = lambda n: F.sequence(F.lit(0), F.col(n) - 1, F.lit(step))
    rows = slides.withColumn("y", F.explode(axis("height"))).withColumn("x", F.explode(axis("width")))
    return rows.withColumn("tile", (F.col("y") / step * F.ceil(F.col("width") / step) + F.col("x") / step).cast("long")).withColumn("size", F.lit(size))


MINED = """slide string, dataset string, object_idx int, mask binary, mask_h int, mask_w int, mask_area int, point struct<x:int,y:int>, topleft struct<x:int,y:int>,
x1 int, y1 int, x2 int, y2 int, confidence float, elapsed_s float, token_idx array<int>, nms_status string"""
FILTERED = MINED + ", confidence_refined float, class_id int, class_prob float, class_name string"
RUN = "slide string, step int, metric string, value double"


def read_mined(spark: SparkSession, path: str, filtered: bool = False) -> DataFrame:
    """Objects of a mining or filtered store in its Parquet layout, one row for each; fields that a store lacks are null.

    ``dataset`` comes from the folder.  Class names that a filtered store lacks are ``class_<id>``.
    """
    rows = spark.read.schema(FILTERED if filtered else MINED).parquet(path)
    if not filtered:
        return rows
    return rows.withColumn("class_name", F.coalesce("class_name", F.when(F.col("class_id").isNotNull(), F.concat(F.lit("class_"), "class_id"))))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run arrays of a mining store (entropy, its drops, confidences), a row for each step (S3)."""
    return spark.read.schema(RUN).parquet(path)


MATRIX = "datasets map<string, struct<slides array<string>, species array<string>, total_samples long>>"


def read_truth_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(slide, dataset) of a cross-dataset matrix; no rows if the file is missing or not JSON; of a slide in several the last by name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "slide string, dataset string")
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", MATRIX).alias("m"))
    rows = doc.select(F.explode("m.datasets").alias("dataset", "info")).select("dataset", F.explode("info.slides").alias("slide"))
    return rows.groupBy("slide").agg(F.max("dataset").alias("dataset"))
