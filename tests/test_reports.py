"""Outputs of several files, counts of question files, exported images, and rules over any number of targets."""

import json

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from scenequery import bindings as b
from scenequery.functions.common import merged
from scenequery.operators import answers, metrics, review, select
from scenequery.operators.decide import rule_answers
from scenequery.plans import further
from scenequery.sources import readers, reports


def test_counts_of_question_files(spark, tmp_path):
    for name, payload in {"two": {"questions": [{"a": 1}, 2]}, "none": {"version": "1"}, "wrong": {"questions": {"a": 1}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(payload, indent=1))
    count = lambda name: readers.count_questions(spark, f"{tmp_path}/{name}.json").collect()
    assert [tuple(r) for r in count("two") + count("none") + count("absent")] == [("two.json", 2), ("none.json", 0), ("absent.json", 0)]
    with pytest.raises(Exception, match="must be a list"):
        count("wrong")


def test_outputs_of_several_files(spark, tmp_path):
    answered = further.answered(spark, DATA).limit(300).persist()
    paths = reports.write_splits(answered, f"{tmp_path}/splits") + reports.write_failures(answered, f"{tmp_path}/failures")
    paths += reports.write_selection(select.select_rows(b.sources(spark, DATA), "a"), "bench", f"{tmp_path}/selection")
    paths += reports.write_clean_subset(b.questions(spark, DATA), b.review(spark, DATA), f"{tmp_path}/clean")
    assert len(paths) == 3 + 3 + 4 + 3
    assert spark.read.json(f"{tmp_path}/splits/splits").count() == 300
    assert readers.csv_rows(spark, f"{tmp_path}/splits/review.csv").count() == 300
    assert spark.read.json(f"{tmp_path}/selection/questions").count() == 30
    counts = spark.read.option("multiLine", True).json(f"{tmp_path}/clean/counts").first()
    assert counts["after"] == spark.read.json(f"{tmp_path}/clean/questions").count() <= counts["before"]
    with pytest.raises(FileExistsError):
        reports.write_splits(answered, f"{tmp_path}/splits")
    assert reports.write_splits(answered, f"{tmp_path}/splits", overwrite=True)


def test_images_are_named_by_question_and_view(spark):
    png, jpg = bytearray(b"\x89PNG123"), bytearray(b"\xff\xd8\xff\xe0")
    rows = spark.createDataFrame([("q_1", [png, jpg]), ("q_2", [])], "question_id string, images array<binary>")
    assert {r["name"]: r["content"] for r in reports.image_exports(rows).collect()} == {"q_1_view_00.png": png, "q_1_view_01.jpg": jpg}
    with pytest.raises(Exception, match="unsupported image"):
        reports.image_exports(spark.createDataFrame([("q", [bytearray(b"GIF8")])], "question_id string, images array<binary>")).collect()


def test_stamp_is_utc_to_the_second(spark):
    import datetime

    said = reports.stamped(spark.range(1)).first()["created_at"]
    assert abs((datetime.datetime.now(datetime.UTC) - datetime.datetime.fromisoformat(said)).total_seconds()) < 120 and said.endswith("+00:00")


def test_maps_merge_to_the_right(spark):
    row = spark.range(1).select(merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first()
    assert row["m"] == {"a": 1, "b": 3}
    assert spark.range(1).select(answers.as_list(F.lit("ab"), "string").alias("x")).first()["x"] == ["ab"]


def test_rules_look_at_every_target(spark):
    objects = "image string, ord int, object_id int, label string, closeness_score double, relative_depth_median double, mask_area_fraction double, vertical_position string, depth_order_hint string"
    shown = [("i", k, k, n, None, None, s, "bottom" if n == "c" else "top", "near" if n == "c" else "far") for k, (n, s) in enumerate((("a", 0.1), ("b", 0.2), ("c", 0.3)))]
    geometry = spark.createDataFrame(shown, objects)
    pairs = spark.createDataFrame([], "image string, ord_a int, ord_b int, label_a string, label_b string, depth_relation string")
    asked = [(1, "i", "physical_size", ["a", "b", "c"], "c"), (2, "i", "support_relation", ["a", "b", "c"], "c"), (3, "i", "support_relation", [], "c"), (4, "i", "physical_size", ["a"], "a"), (5, "i", "support_relation", None, "c"), (6, "nowhere", "support_relation", [], "c")]
    questions = spark.createDataFrame(asked, "question_id int, image string, type string, targets array<string>, answer string")
    got = {r["question_id"]: (r["prediction"], r["correct"]) for r in rule_answers(questions, geometry, pairs).collect()}
    assert got == {1: ("c", True), 2: ("c", True), 3: ("c", True), 4: ("unknown", False), 5: ("c", True), 6: ("unknown", False)}


def test_repeated_tracks_are_not_complete(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "b"), (3, "c"), (3, "c")]
    table = spark.createDataFrame([(q, t, "x", True, "m", None, None, "t") for q, t in rows], "question_id int, track string, prediction string, correct boolean, metric string, unit string, tolerance double, type string")
    assert {r["question_id"]: r["complete"] for r in metrics.aligned(table, ("a", "b", "c")).collect()} == {1: False, 2: True, 3: False}


def test_a_question_without_its_source_row_stops(spark):
    rows = spark.createDataFrame([(1, "old", 0), (1, "new", 1)], "key int, task string, at int")
    asked = spark.createDataFrame([(7, 1)], "question_id int, source_id int")
    assert review.with_source(asked, rows, "key", "at").first()["source"]["task"] == "new"
    with pytest.raises(Exception, match="no source row for 8"):
        review.with_source(spark.createDataFrame([(8, 2)], "question_id int, source_id int"), rows, "key", "at").collect()
