"""Result trees, configuration, image folders and reports."""

import json

import pytest

from veridian.sources import readers, sinks


def test_results_of_a_tree_fill_each_other(spark, tmp_path):
    for experiment, seed, name, body in (("a", "seed_1", "eval_main", {"target": "x", "top1": 0.5}), ("a", "2", "eval_cross", {"target": "y", "top1": 0.25}), ("b", "seed_1", "eval_main", {"target": "x"})):
        folder = tmp_path / experiment / seed
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text(json.dumps(body, indent=1))
    rows = readers.read_results(spark, str(tmp_path), "target string, top1 double")
    got = sorted((r.experiment, r.seed, r.evaluation, r.target, r.top1) for r in rows.collect())
    assert got == [("a", "1", "eval_main", "x", 0.5), ("a", "2", "eval_cross", "y", 0.25), ("b", "1", "eval_main", "x", None)]
    summary = spark.createDataFrame([("a", "x", 9.0), ("a", "z", 8.0), ("c", "x", 7.0)], "experiment string, target string, top1 double")
    log = spark.createDataFrame([("c", "x"), ("d", "x")], "experiment string, target string")
    whole = readers.filled(rows.select("experiment", "target", "top1"), summary, log, keys=["experiment", "target"])
    assert sorted(((r.experiment, r.target, r.top1, r.place) for r in whole.collect()), key=str) == sorted([("a", "x", 0.5, 0), ("a", "y", 0.25, 0), ("b", "x", None, 0), ("a", "z", 8.0, 1), ("c", "x", 7.0, 1), ("d", "x", None, 2)], key=str)


def test_configuration(spark, tmp_path):
    pytest.importorskip("yaml")
    file = tmp_path / "c.yaml"
    file.write_text("defaults:\n  base: 0.22\nslides:\n  s1: 0.5\nset_a:\n  excluded:\n  - slide: s2\n    reason: blurred\n  - s3\nset_b: {}\n")
    assert {(r.name, r.value) for r in readers.config_table(spark, file, "slides").collect()} == {("s1", 0.5)}
    assert {(r.name, r.value) for r in readers.config_table(spark, file, "defaults").collect()} == {("base", 0.22)}
    assert {(r.dataset, r.slide) for r in readers.config_table(spark, file, "excluded").collect()} == {("set_a", "s2"), ("set_a", "s3")}
    assert readers.config_table(spark, file, "none").count() == 0


def test_image_folders(spark, tmp_path):
    for species, kind, name in (("oak", "objects", "1.png"), ("oak", "Background", "2.png"), ("elm", "objects", "3.png"), ("elm", "objects", "notes.txt")):
        folder = tmp_path / species / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(b"x")
    got = sorted((r.species, r.kind) for r in readers.read_images(spark, str(tmp_path)).select("species", "kind").collect())
    assert got == [("elm", "object"), ("oak", "background"), ("oak", "object")]


def test_markdown(spark):
    assert sinks.markdown(spark.createDataFrame([(1, None), (2, "b")], "n int, s string").orderBy("n")) == "| n | s |\n| - | - |\n| 1 | - |\n| 2 | b |"
