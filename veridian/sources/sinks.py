"""Writers of corpus artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_objects(rows: DataFrame, path: str, by: tuple[str, ...] = ("dataset",)) -> None:
    """Detections or embeddings as Parquet, one folder for each partition value."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_splits(rows: DataFrame, path: str) -> DataFrame:
    """Split files by split and slide; returns the manifest's counts (K7)."""
    files = rows.groupBy("slide", "split").agg(F.array_sort(F.collect_list("sample_id")).alias("sample_ids"), F.count(F.lit(1)).alias("count"))
    files.write.mode("overwrite").partitionBy("split", "slide").json(path)
    return files.groupBy("slide").pivot("split", ["train", "val"]).agg(F.first("count")).na.fill(0, ["train", "val"])


def feature_collections(rows: DataFrame) -> DataFrame:
    """(slide, geojson) from boxes with class and an order, regions first (K8, K9, U8)."""
    ring = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"), F.array("x1", "y1"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.struct(F.col("class").alias("name")).alias("classification")).alias("properties"))
    ordered = F.array_sort(F.collect_list(F.struct("order", "id", feature.alias("f"))))
    one = rows.groupBy("slide").agg(F.transform(ordered, lambda x: x["f"]).alias("features"))
    return one.select("slide", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("geojson"))


def verification_report(violations: DataFrame, group: str, detail: str, shown: int = 20) -> DataFrame:
    """Violations of each group with the first few details."""
    first = lambda details: F.slice(F.array_sort(details), 1, shown)
    # a group's details are cut in many parts before one task sees the group
    parts = violations.groupBy(group, F.pmod(F.xxhash64(detail), F.lit(4096)).alias("_part")).agg(F.count(F.lit(1)).alias("n"), first(F.collect_set(detail)).alias("d"))
    return parts.groupBy(group).agg(F.sum("n").alias("violations"), first(F.flatten(F.collect_list("d"))).alias("examples"))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report table of at most ``most`` rows as Markdown."""
    head = rows.columns
    body = [[("-" if v is None else str(v)) for v in r] for r in rows.limit(most).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["-"] * len(head), *body])


def write_csv(rows: DataFrame, path: str, lists: tuple[str, ...] = ()) -> None:
    """CSV with list columns joined by a double bar."""
    flat = rows.select(*[F.array_join(c, "||").alias(c) if c in lists else F.col(c) for c in rows.columns])
    flat.write.mode("overwrite").csv(path, header=True)


def write_runs(rows: DataFrame, path: str, order: str, metrics: tuple[str, ...]) -> None:
    """Run arrays as rows (slide, step, metric, value): the columns ``metrics`` in the order of ``order`` within a slide (K1)."""
    step = (F.row_number().over(W.partitionBy("slide").orderBy(order)) - 1).alias("step")
    wide = rows.select(F.col("slide").cast("string").alias("slide"), step, *[F.col(m).cast("double").alias(m) for m in metrics])
    wide.unpivot(["slide", "step"], list(metrics), "metric", "value").filter("value is not null").write.mode("overwrite").parquet(path)
