"""Tiles of large images as a Spark data source (S1, S2, U-UDF).

Images are kept as their lines of pixels (slide, y, width, pixels), in Parquet folders by a hash of the slide and in order, so a tile row
reads its lines and no others.  A partition is a run of so many tiles, of one row or of several short ones.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

TILES = "slide string, tile long, x int, y int, height int, width int, pixels binary"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: An image of bytes (height, width, 3) to another one.
Transform = Callable[[np.ndarray], np.ndarray]


def write_lines(lines: DataFrame, path: str) -> None:
    """Store image ``lines`` (slide, y, width, pixels: width * 3 bytes)."""
    rows = lines.select(F.substring(F.sha2(F.col("slide").cast("string"), 256), 1, 16).alias("part"), F.col("slide").cast("string").alias("slide"), F.col("y").cast("int").alias("y"), F.col("width").cast("int").alias("width"), "pixels")
    rows.repartition("part").sortWithinPartitions("part", "slide", "y").write.partitionBy("part").parquet(path)


@dataclass
class TileRow:
    """Tiles of one row of one slide: their numbers and left sides."""

    slide: str
    y: int
    width: int
    tiles: list[tuple[int, int]]


@dataclass
class TileRun(InputPartition):
    """What one task reads."""

    rows: list[TileRow]


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str], transforms: Sequence[Transform]):
        self.path, self.transforms = options["path"], list(transforms)
        self.size, self.step, self.run = int(options["size"]), int(options["size"]) - int(options["overlap"]), int(options["run"])
        self.slides: list[tuple[str, int, int]] = [tuple(s) for s in json.loads(options["slides"])]
        self.region = json.loads(options["region"])
        self.rescale = float(options["rescale"])
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of slide, x and y with constants decide which tiles are planned; the others go back to Spark."""
        names = {EqualTo: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
        for f in filters:
            if type(f) in names and f.attribute in (("slide",), ("x",), ("y",)) and f.value is not None:
                self.tests.append((f.attribute[0], names[type(f)], f.value))
            else:
                yield f

    def _wanted(self, **at: object) -> bool:
        return all(getattr(at[name], test)(value) is True for name, test, value in self.tests if name in at)

    def partitions(self) -> Sequence[InputPartition]:
        rows: list[TileRow] = []
        for slide, wide, high in self.slides:
            if not self._wanted(slide=slide):
                continue
            x1, y1, x2, y2 = (0, 0, wide, high) if self.region is None else (max(0, self.region[0]), max(0, self.region[1]), min(wide, self.region[2]), min(high, self.region[3]))
            columns = range(x1, x2, self.step)
            for row, y in enumerate(range(y1, y2, self.step)):
                tiles = [(row * len(columns) + i, x) for i, x in enumerate(columns) if self._wanted(x=x, y=y)]
                rows += [TileRow(slide, y, wide, tiles[i : i + self.run]) for i in range(0, len(tiles), self.run)]
        out, held = [TileRun([])], 0
        for row in rows:
            if held and held + len(row.tiles) > self.run:
                out.append(TileRun([]))
                held = 0
            out[-1].rows.append(row)
            held += len(row.tiles)
        return out

    def read(self, partition: TileRun) -> Iterator[tuple]:
        for row in partition.rows:
            yield from self._row(row)

    def _row(self, partition: TileRow) -> Iterator[tuple]:
        system, path = fs.FileSystem.from_uri(self.path)
        folder = f"{path}/part={hashlib.sha256(partition.slide.encode()).hexdigest()[:16]}"
        own = (pc.field("slide") == partition.slide) & (pc.field("y") >= partition.y) & (pc.field("y") < partition.y + self.size)
        lines = ds.dataset(folder, filesystem=system, format="parquet").to_table(columns=["y", "pixels"], filter=own)
        # what lies beyond the image is black
        strip = np.zeros((self.size, max(partition.width, partition.tiles[-1][1] + self.size), 3), dtype=np.uint8)
        for y, data in zip(lines["y"].to_pylist(), lines["pixels"]):
            strip[y - partition.y, : partition.width] = np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(-1, 3)
        for tile, x in partition.tiles:
            image = strip[:, x : x + self.size]
            if self.rescale != 1:
                n = int(self.size * self.rescale)
                at = np.minimum((np.arange(n) + 0.5) / self.rescale, self.size - 1).astype(int)
                image = image[at[:, None], at]
            for change in self.transforms:
                image = change(image)
            yield partition.slide, tile, x, partition.y, image.shape[0], image.shape[1], np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def read_tiles(spark: SparkSession, path: str, size: int = 512, overlap: int = 64, region: tuple[int, int, int, int] | None = None, rescale: float = 1.0, transforms: Sequence[Transform] = (), run: int = 64) -> DataFrame:
    """TILES of every slide stored in ``path`` by :func:`write_lines`, in row-major order with stride size - overlap.

    ``region`` (x1, y1, x2, y2) is cut to each slide; tiles that reach over an edge are not moved and black beyond it.
    Tiles are resized first (nearest pixel), then each of ``transforms`` is applied in order: stain, histogram, the
    caller's own.  Filters on slide, x and y are pushed into the plan of the scan.  Slides, and no pixels, are listed on
    the driver; a slide of several widths has its largest.
    """
    slides = spark.read.parquet(path).groupBy(F.col("slide").cast("string").alias("slide")).agg(F.max("width"), F.max("y") + 1).collect()

    class Tiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "veridian_tiles"

        def schema(self) -> str:
            return TILES

        def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
            return TileReader(self.options, transforms)

    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Tiles)
    options = {"path": path, "size": size, "overlap": overlap, "run": run, "rescale": rescale, "region": json.dumps(region), "slides": json.dumps(sorted([str(s), int(w), int(h)] for s, w, h in slides))}
    return spark.read.format("veridian_tiles").options(**options).load()
