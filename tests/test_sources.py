"""Readers, writers, streaming and mining on hand-made files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridian.operators import mining, models
from veridian.sources import readers, sinks
from veridian.streaming import resumable


def test_captions(spark, tmp_path):
    lines = [{"id": "a_000001", "caption": " one "}, {"id": 7, "caption": "int id"}, {"caption": "no id", "image_path": "p"}, {"id": "b", "caption": "   "}, {"id": "a_000001", "caption": "two", "bbox": [1, 2, 3, 4]}]
    (tmp_path / "s_captions.jsonl").write_text("\n".join(["", "{broken", *map(json.dumps, lines)]))
    rows = readers.read_captions(spark, str(tmp_path))
    assert sorted((r.pair_key, r.caption) for r in rows.collect()) == [("id:7", "int id"), ("id:a_000001", "one"), ("id:a_000001", "two"), ("image_path:p", "no id")]
    assert [tuple(r) for r in readers.boxes_by_id(rows).collect()] == [("a_000001", 1, 2, 3, 4)]
    assert readers.read_captions(spark, str(tmp_path), most=1).count() == 1


def test_annotations(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]
    feature = lambda kind, props, points=ring: {"type": "Feature", "id": kind, "geometry": {"type": "Polygon", "coordinates": [points]}, "properties": props}
    features = [feature("r", {"name": "test_region"}), feature("c", {"classification": {"name": "Test Region"}}), feature("p", {"classification": {"name": "Grain"}}), feature("s", {"classification": "Grain"}), feature("n", {"classification": None}), feature("few", {"classification": {"name": "Grain"}}, ring[:3])]
    (tmp_path / "one.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    (tmp_path / "bad.geojson").write_text(json.dumps({"type": "Other", "features": features[:1]}))
    rows = readers.read_annotations(spark, str(tmp_path))
    assert sorted(r.feature_id for r in readers.test_regions(rows).collect()) == ["c", "r"]
    labels = spark.createDataFrame([("one", "Alnus")], "slide string, species string")
    found = readers.labelled_objects(rows, labels, "Grain").collect()
    assert sorted(r.feature_id for r in found) == ["p", "s"] and (found[0].x2, found[0].y2) == (4, 3)
    assert rows.filter("slide = 'bad'").first().problem == "not a FeatureCollection"


def test_anchors_splits_and_log(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x_edf_species.txt").write_text("Alnus\n")
    (tmp_path / "a/x_edf_species_verified.txt").write_text("Alnus glutinosa")
    r = readers.read_anchors(spark, str(tmp_path / "a")).first()
    assert (r.slide, r.species, r.species_verified, r.family, r.hint) == ("x_edf", "Alnus", "Alnus glutinosa", "Unknown", "")
    (tmp_path / "s").mkdir()
    (tmp_path / "s/x_train.json").write_text(json.dumps({"split": "train", "indices": ["1", "2"]}))
    assert sorted((r.slide, r.split, r.sample_id) for r in readers.read_splits(spark, str(tmp_path / "s")).collect()) == [("x", "train", "1"), ("x", "train", "2")]
    (tmp_path / "log.csv").write_text("epoch,loss,timestamp\n1,inf,t\n2,0.5,\n")
    assert [r.loss for r in readers.read_training_log(spark, str(tmp_path / "log.csv"), ["epoch", "loss", "timestamp"]).orderBy("epoch").collect()] == [None, 0.5]


def test_split_files_and_collections(spark, tmp_path):
    rows = spark.createDataFrame([("s", "train", "b"), ("s", "train", "a"), ("s", "val", "c")], "slide string, split string, sample_id string")
    manifest = sinks.write_splits(rows, str(tmp_path / "splits")).first()
    assert (manifest.train, manifest.val) == (2, 1)
    boxes = spark.createDataFrame([("s", 1, "x", "Grain", 0, 0, 1, 1), ("s", 0, "r", "Region", 0, 0, 9, 9)], "slide string, `order` int, id string, class string, x1 int, y1 int, x2 int, y2 int")
    doc = json.loads(sinks.feature_collections(boxes).first().geojson)
    assert [f["properties"]["classification"]["name"] for f in doc["features"]] == ["Region", "Grain"]


def test_grid(spark):
    rows = readers.tile_grid(spark.createDataFrame([("s", 100, 60)], "slide string, width int, height int"), 50, 10)
    assert [(r.x, r.y) for r in rows.orderBy("tile").collect()] == [(x, y) for y in (0, 40) for x in (0, 40, 80)]


def test_resume_and_retries(spark, tmp_path):
    prompts = spark.createDataFrame([(str(i), f"p{i}") for i in range(6)], "id string, prompt string")
    path = str(tmp_path / "out")
    assert resumable.resume_captions(prompts.limit(3), path, models.template_caption, 2) == 3
    assert resumable.resume_captions(prompts, path, models.template_caption, 2) == 3
    assert spark.read.json(path).select("id").distinct().count() == 6
    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert resumable.with_retries(flaky, "x", pause=0) == ("ok", 2, None)


def test_stream_writes_each_id_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rec = lambda i: json.dumps({"id": i, "timestamp": "2024-01-01T00:00:00"})
    (tmp_path / "in/a.json").write_text("\n".join([rec("1"), rec("2"), rec("1")]))
    run = lambda: resumable.stream_records(spark, str(tmp_path / "in"), "id string, timestamp string", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    (tmp_path / "in/b.json").write_text("\n".join([rec("2"), rec("3")]))
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_attention_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(5, 4)), rng.normal(size=(2, 4))
    tokens = spark.createDataFrame([(1, v.tolist()) for v in x], "id long, emb array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, query array<double>")
    got = mining.attention_pool(tokens, queries, "id", 4).first()
    w = np.exp(x @ q.T / 2)
    pooled = ((w / w.sum(axis=0)).T @ x).mean(axis=0)
    assert np.allclose(got.pooled, pooled / np.linalg.norm(pooled)) and got.attention == pytest.approx(float(pooled @ q.mean(axis=0) / np.linalg.norm(pooled) / np.linalg.norm(q.mean(axis=0))), rel=1e-5)


@pytest.mark.parametrize("n, k", [(40, 3), (3, 2), (1, 3)])
def test_principal_directions_against_svd(spark, n, k):
    draw = np.random.default_rng(n)
    groups = {g: draw.normal(size=(n, 6)) * [3, 2, 1, 1, 0.5, 0.1] + draw.normal(size=6) for g in range(3)}
    rows = [(g, v.tolist()) for g, x in groups.items() for v in x] + [(0, None), (1, [1.0]), (2, [float("nan")] * 6), (7, None)]
    got = {r.g: r for r in mining.principal_directions(spark.createDataFrame(rows, "g int, v array<double>").repartition(5), "g", "v", 6, k).collect()}
    assert set(got) == {0, 1, 2}
    for g, x in groups.items():
        mean = x.mean(axis=0)
        _, s, v = np.linalg.svd(x - mean, full_matrices=False)
        v = v * np.where(v @ mean < 0, -1.0, 1.0)[:, None]
        want = (v[:k] * (s[:k] ** 2)[:, None]).sum(axis=0) if n > 1 else mean
        assert np.allclose(got[g].direction, want / np.linalg.norm(want), atol=1e-7) and got[g].members == n
        assert got[g].share == pytest.approx((s[:k] ** 2).sum() / (s**2).sum() if n > 1 else 0.0, abs=1e-9)


def test_prototype_and_smoothing(spark):
    cells = spark.createDataFrame([("s", 10 * i + j, i, j, float((i * 7 + j * 3) % 11)) for i in range(10) for j in range(10)], "slide string, token int, tok_x int, tok_y int, w double")
    x = models.hashed_vectors([str(i) for i in range(20)], 4)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>")
    start = spark.createDataFrame([("a", x[0].tolist()), ("b", x[1].tolist()), ("none", x[1].tolist())], "g string, prototype array<double>")
    both = vectors.withColumn("g", F.explode(F.array(F.lit("a"), F.lit("b"))))
    for bins in (4, 4096):
        out = {r.g: np.array(r.prototype) for r in mining.refine_prototypes(both, start, "g", "id", "emb", 4, 0.5, bins=bins).collect()}
        assert set(out) == {"a", "b"}
        for g, first in (("a", x[0]), ("b", x[1])):
            here = first
            for _ in range(100):
                near = x[np.argsort(-(x @ here), kind="stable")[:10]]
                before, here = here, near[np.argmax(near @ near.sum(axis=0))]
                if np.linalg.norm(here - before) < 1e-4:
                    break
            assert np.allclose(out[g], here, atol=1e-6)
    smoothed = mining.smooth(cells.select("slide", F.col("tok_y").alias("y"), F.col("tok_x").alias("x"), "w"))
    assert smoothed.agg(F.sum("w")).first()[0] == pytest.approx(cells.agg(F.sum("w")).first()[0])


def test_lines_are_numbered_in_each_file(spark, tmp_path):
    for name, n in (("a.jsonl", 3), ("b.jsonl", 4)):
        (tmp_path / name).write_text("\n".join(["", *[f'{{"caption": "{name} {i}"}}' for i in range(n)]]) + "\n")
    got = sorted((r.file, r.pair_key) for r in readers.read_captions(spark, str(tmp_path)).collect())
    assert got == [("a", f"row:{i:08d}") for i in range(1, 4)] + [("b", f"row:{i:08d}") for i in range(1, 5)]


def test_long_files_are_numbered_over_their_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f'{{"caption": "c{i} {"x" * 200}"}}\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        rows = readers.read_captions(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        assert all(r.caption.startswith(f"c{r.line} ") for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_feature_does_not_carry_its_collection(spark, tmp_path):
    """A row of the explosion had its whole collection beside it: memory grew with the square of a file's features."""
    import re

    feature = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[%d,0],[0,1]]]},"properties":{"classification":{"name":"Pollen"}}}'
    (tmp_path / "s.geojson").write_text('{"type":"FeatureCollection","features":[%s]}' % ",".join(feature % (i + 1) for i in range(500)))
    rows = readers.read_annotations(spark, str(tmp_path))
    assert rows.filter("problem is null and class = 'Pollen' and slide = 's'").agg({"x2": "sum"}).first()[0] == 500 * 501 / 2
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(re.search(r"\bg#", line.split("],")[0] + line) for line in plan.splitlines() if "Generate explode" in line)
