"""Artefacts written from the driver tables and read back, with the DuckDB SQL of what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridian.operators.models import template_caption
from veridian.plans import box_queries as B
from veridian.plans import vector_queries as V
from veridian.session import scratch, ship_package
from veridian.sources import readers, sinks
from veridian.sources.tables import read
from veridian.streaming import resumable


def _captions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as caption lines: one in seven is broken, one in eleven blank; ids are missing where doc_id is odd."""
    folder = scratch(spark, "captions")
    docs = read(spark, d, "documents")
    even, n = F.col("doc_id") % 2 == 0, F.col("doc_id").cast("double")
    line = F.to_json(F.struct(F.when(even, F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("  "), "text", F.lit(" ")).alias("caption"), F.concat("source", F.lit("/"), "doc_id").alias("image_path"), F.array(n, n + 1, n + 5, n + 9).alias("bbox")))
    line = F.when(F.col("doc_id") % 7 == 3, F.concat(F.lit("{broken "), "source")).when(F.col("doc_id") % 11 == 4, F.lit("   ")).otherwise(line)
    docs.select(line.alias("value")).write.text(folder)
    return readers.read_captions(spark, folder)


READABLE = "FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 11 <> 4 AND trim(text, ' ') <> ''"


def captions(spark: SparkSession, d: str) -> DataFrame:
    """S6, S7, N1, T20."""
    return _captions(spark, d).select("pair_key", F.md5("caption").alias("digest"))


CAPTIONS_SQL = f"SELECT CASE WHEN doc_id % 2 = 0 THEN 'id:' || doc_id ELSE 'image_path:' || source || '/' || doc_id END AS pair_key, md5(trim(text, ' ')) AS digest {READABLE}"


def captions_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Captions of labelled documents."""
    return readers.captions_by_id(_captions(spark, d), read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"))).select("id", F.md5("caption").alias("digest"))


BY_ID_SQL = f"SELECT doc_id::VARCHAR AS id, md5(trim(text, ' ')) AS digest {READABLE} AND doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels)"


def caption_boxes(spark: SparkSession, d: str) -> DataFrame:
    """S9."""
    return readers.boxes_by_id(_captions(spark, d))


BOXES_SQL = f"SELECT doc_id::VARCHAR AS id, doc_id::INT AS x1, (doc_id + 1)::INT AS y1, (doc_id + 5)::INT AS x2, (doc_id + 9)::INT AS y2 {READABLE} AND doc_id % 2 = 0"


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """Regions as GeoJSON, test regions first, and back."""
    folder = scratch(spark, "annotations")
    rows = B.regions(spark, d).select(F.col("slide").cast("string").alias("slide"), F.col("region").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    rows = rows.withColumn("order", (F.col("id") % 3).cast("int")).withColumn("class", F.when(F.col("id") % 3 == 0, "Test Region").otherwise("Pollen"))
    sinks.feature_collections(rows).select(F.col("geojson").alias("value")).repartition(F.xxhash64("value")).write.option("maxRecordsPerFile", 1).text(folder)
    back = readers.read_annotations(spark, folder)
    return back.select("class", "points", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")], F.col("problem").isNull().alias("good"))


ANNOTATIONS_SQL = f"SELECT CASE WHEN region % 3 = 0 THEN 'Test Region' ELSE 'Pollen' END AS class, 5 AS points, x1, y1, x2, y2, true AS good FROM ({B._regions()})"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """One vector in nine is zero, slides divisible by four have no known label."""
    folder = scratch(spark, "vectors")
    e = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.concat(F.lit("s"), F.floor(F.col("vec_id") / 25)).alias("slide"), F.when(F.col("vec_id") % 9 == 0, F.array_repeat(F.lit(0.0).cast("float"), 64)).otherwise(F.col("embedding")).alias("emb"), (F.col("vec_id") % 3).alias("dataset"))
    sinks.write_objects(e, folder)
    k = F.substring("slide", 2, 9).cast("int")
    labels = e.select("slide").distinct().withColumn("species", F.when(k % 4 == 0, "unknown").otherwise("Sp"))
    return readers.read_vectors(spark, folder, labels).select("sample_id", "slide", F.round(F.element_at("emb", 1).cast("double"), 6).alias("e1"))


VECTORS_SQL = "SELECT vec_id::VARCHAR AS sample_id, 's' || (vec_id // 25) AS slide, round(embedding[1]::DOUBLE, 6) AS e1 FROM embeddings WHERE vec_id % 9 <> 0 AND (vec_id // 25) % 4 <> 0"


def mined(spark: SparkSession, d: str) -> DataFrame:
    """Detections as a filtered store with its run arrays."""
    objects, runs = scratch(spark, "objects"), scratch(spark, "runs")
    b = B.detections(spark, d)
    box = [F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    rows = b.select(F.col("slide").cast("string").alias("slide"), F.col("l_returnflag").alias("dataset"), F.col("id").cast("int").alias("object_idx"), *box, F.col("score").cast("float").alias("confidence"), (F.col("id") % 60).cast("int").alias("class_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("name "), F.col("id") % 60)).alias("class_name"))
    sinks.write_objects(rows, objects)
    sinks.write_runs(b.groupBy("slide", "id").agg(F.avg("l_quantity").alias("entropy"), F.max("score").alias("confidence")), runs, "id", ("entropy", "confidence"))
    read_back = readers.read_mined(spark, objects, filtered=True).groupBy("slide", "dataset").agg(F.count(F.lit(1)).alias("objects"), F.sum("x1").alias("x1"), F.count("confidence_refined").alias("refined"), F.count_if(F.startswith("class_name", F.lit("class_"))).alias("unnamed"))
    steps = readers.read_runs(spark, runs).groupBy("slide").agg(F.max("step").alias("last_step"), F.round(F.avg(F.when(F.col("metric") == "entropy", F.col("value"))), 6).alias("entropy"))
    return read_back.join(steps, "slide")


MINED_SQL = f"""WITH b AS ({B.DETECTIONS}), s AS (SELECT slide, count(*) - 1 AS last_step, round(avg(e), 6) AS entropy FROM (SELECT slide, id, avg(l_quantity) AS e FROM b GROUP BY ALL) GROUP BY slide)
SELECT slide::VARCHAR AS slide, l_returnflag AS dataset, count(*) AS objects, sum(x1)::BIGINT AS x1, 0 AS refined, count(*) FILTER (WHERE id % 2 = 1) AS unnamed, any_value(last_step)::INT AS last_step, any_value(entropy) AS entropy FROM b JOIN s USING (slide) GROUP BY ALL"""


def truth_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A matrix of languages and sources; a missing and a broken file give nothing."""
    folder, broken = scratch(spark, "matrix"), scratch(spark, "matrix")
    sets = read(spark, d, "documents").groupBy("lang").agg(F.collect_set("source").alias("slides"))
    whole = sets.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("lang", F.struct("slides")))).alias("datasets"))).alias("value"))
    whole.coalesce(1).write.text(folder)
    whole.select(F.lit("{no json").alias("value")).coalesce(1).write.text(broken)
    return readers.read_truth_matrix(spark, folder).union(readers.read_truth_matrix(spark, broken)).union(readers.read_truth_matrix(spark, scratch(spark, "nothing")))


TRUTH_SQL = "SELECT source AS slide, max(lang) AS dataset FROM documents GROUP BY source"


def training_log(spark: SparkSession, d: str) -> DataFrame:
    """A log appended twice."""
    folder = scratch(spark, "log")
    o = read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.when(F.col("o_orderkey") % 5 == 0, "inf").when(F.col("o_orderkey") % 5 == 1, "").otherwise(F.col("o_totalprice").cast("string")).alias("loss"))
    resumable.append_log(o, folder)
    resumable.append_log(o, folder)
    log = readers.read_training_log(spark, folder, ["timestamp", "loss"])
    return log.groupBy("timestamp").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("loss"), 2).alias("loss"))


LOG_SQL = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS timestamp, 2 * count(*) AS rows, round(sum(CASE WHEN o_orderkey % 5 > 1 THEN 2 * o_totalprice END), 2) AS loss FROM orders GROUP BY 1"


def csv_lists(spark: SparkSession, d: str) -> DataFrame:
    """Violations of each slide with examples, as CSV with joined lists."""
    folder = scratch(spark, "csv")
    v = B.violations(spark, d).withColumn("name", F.concat(F.lit("g"), "id"))
    sinks.write_csv(sinks.verification_report(v, "slide", "name", 5), folder, ("examples",))
    return spark.read.schema("slide int, violations long, examples string").csv(folder, header=True)


CSV_SQL = f"""WITH v AS ({B.VIOLATIONS_SQL}), n AS (SELECT slide, 'g' || id AS name, row_number() OVER (PARTITION BY slide ORDER BY 'g' || id) AS r FROM (SELECT DISTINCT slide, id FROM v))
SELECT slide, (SELECT count(*) FROM v WHERE v.slide = n.slide) AS violations, string_agg(name, '||' ORDER BY r) FILTER (WHERE r <= 5) AS examples FROM n GROUP BY slide"""


def resumed(spark: SparkSession, d: str) -> DataFrame:
    """Half of the prompts first, then all; each is answered once."""
    ship_package(spark)
    folder = scratch(spark, "answers")
    prompts = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_partkey", F.concat("p_name", F.lit("\nmore")).alias("prompt"))
    resumable.resume_captions(prompts.filter("p_partkey % 2 = 0"), folder, template_caption, 4)
    resumable.resume_captions(prompts, folder, template_caption, 4)
    return spark.read.schema(resumable.CAPTIONED).json(folder).select("id", "caption", "retry_attempts")


RESUMED_SQL = "SELECT p_partkey::VARCHAR AS id, trim('A grain. ' || p_name) AS caption, 0 AS retry_attempts FROM part"

QUERIES = {
    "s7_captions": captions, "s8_captions_by_id": captions_by_id, "s9_caption_boxes": caption_boxes, "s10_annotations": annotations, "s17_vectors": vectors, "s3_mined_store": mined,
    "s16_truth_matrix": truth_matrix, "s22_training_log": training_log, "k12_csv_lists": csv_lists, "x2_resumed_captions": resumed,
}
ORACLES = {
    "s7_captions": CAPTIONS_SQL, "s8_captions_by_id": BY_ID_SQL, "s9_caption_boxes": BOXES_SQL, "s10_annotations": ANNOTATIONS_SQL, "s17_vectors": VECTORS_SQL, "s3_mined_store": MINED_SQL,
    "s16_truth_matrix": TRUTH_SQL, "s22_training_log": LOG_SQL, "k12_csv_lists": CSV_SQL, "x2_resumed_captions": RESUMED_SQL,
}
