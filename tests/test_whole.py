"""Queries over whole inputs: no prefix of a text, no part of the images."""

import re

from conftest import DATA, run_sql

from scenequery import bindings as b
from scenequery import catalogue
from scenequery.operators import geometry as g
from scenequery.operators import pixels as p
from scenequery.operators import prompts as t


def test_questions_are_whole(spark):
    longest = run_sql("SELECT max(length(trim(regexp_replace(text, '[^a-zA-Z ]', '', 'g')))) AS n FROM documents WHERE doc_id % 50 <> 0")["n"][0]
    assert longest > 80
    assert catalogue.QUERIES["question_length"](spark, DATA).first()["longest"] == longest


def test_question_after_eighty_blanks_is_not_missing(spark, tmp_path):
    spark.createDataFrame([(1, " " * 80 + "where", "en", "src0")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = catalogue.QUERIES["exclusion_reasons"](spark, str(tmp_path)).collect()
    assert "question_missing" not in row["reasons"]
    assert b.sources(spark, str(tmp_path)).first()["question"] == " " * 80 + "where"


def test_every_image_is_asked(spark):
    held = {r["image"] for r in b.objects(spark, DATA).select("image").distinct().collect()}
    assert {r["image"] for r in b.questions(spark, DATA).select("image").distinct().collect()} == held
    failed = catalogue.QUERIES["rule_answers"](spark, DATA).where("error_reason = 'missing_target_objects'")
    assert catalogue.QUERIES["failure_by_image"](spark, DATA).count() == failed.select("image").distinct().count()


def test_second_names_are_the_same_queries():
    second = {n: n.removesuffix(s) for s in ("_whole", "_all_images") for n in catalogue.QUERIES if n.endswith(s) and n.removesuffix(s) in catalogue.QUERIES}
    assert len(second) > 20
    assert all(catalogue.ORACLE_SQL[n] == catalogue.ORACLE_SQL[plain] for n, plain in second.items() if n != "raster_resized_whole")


def test_marker_evidence_has_every_line_by_view(spark):
    asked = spark.createDataFrame([(1, "distance_infer_center_oo", "available"), (2, "obj_spatial_relation_oo", "available")], "question_id long, task string, status string")
    views = "question_id long, view int, depth_valid boolean, valid_pixels int, depth_min double, depth_max double, depth_median double, color_valid boolean, depth_intrinsics_valid boolean, pose_valid boolean"
    views = spark.createDataFrame([(q, v, v == 0, 4 - 4 * v, *([1.0, 2.5, 2.0] if v == 0 else [None] * 3), True, True, False) for q in (1, 2) for v in (0, 1)], views)
    points = "question_id long, view int, color string, rank int, px double, py double, pixel_bbox array<int>, visible_xy array<double>, depth double, fx double, fy double, cx double, cy double"
    seen = [(0, "blue", 2, 3.5, 4.0, [3, 4, 4, 4], [3.0, 4.0], 2.00005), (0, "red", 0, 0.0, 0.0, [0, 0, 0, 0], [0.0, 0.0], 2.0), (1, "red", 0, 1.0, 1.0, [1, 1, 1, 1], [1.0, 1.0], 1.0), (1, "green", 1, 1.0, 4.0, [1, 4, 1, 4], [1.0, 4.0], 1.0)]
    points = g.marker_points(spark.createDataFrame([(q, *s, 1.0, 1.0, 0.0, 0.0) for q in (1, 2) for s in seen], points))
    told = {r["question_id"]: r["evidence"].split("\n") for r in t.marker_evidence(asked, views, points, g.marker_relations(points), g.red_blue_relation(points)).collect()}
    expected = [
        "Geometry status: available",
        "View count: 2",
        "View 0: depth_valid=True, valid_pixels=4, depth_min=1.0, depth_max=2.5, depth_median=2.0, color_intrinsics_valid=True, depth_intrinsics_valid=True, pose_valid=False",
        "View 0 red marker: pixel_xy=[0.0, 0.0], pixel_bbox=[0, 0, 0, 0], visible_pixel_median_xy=[0.0, 0.0], depth=2.0, camera_xyz=[0.0, 0.0, 2.0], unit=dataset_native",
        "View 0 blue marker: pixel_xy=[3.5, 4.0], pixel_bbox=[3, 4, 4, 4], visible_pixel_median_xy=[3.0, 4.0], depth=2.00005, camera_xyz=[7.000175, 8.0002, 2.00005], unit=dataset_native",
        "View 0 marker relations: depth_difference_blue_minus_red=5e-05, euclidean_distance=10.630412, unit=dataset_native",
        "View 0 marker pair red_to_blue: depth_difference=5e-05, euclidean_distance=10.630412, unit=dataset_native",
        "View 1: depth_valid=False, valid_pixels=0, depth_min=unknown, depth_max=unknown, depth_median=unknown, color_intrinsics_valid=True, depth_intrinsics_valid=True, pose_valid=False",
        "View 1 red marker: pixel_xy=[1.0, 1.0], pixel_bbox=[1, 1, 1, 1], visible_pixel_median_xy=[1.0, 1.0], depth=1.0, camera_xyz=[1.0, 1.0, 1.0], unit=dataset_native",
        "View 1 green marker: pixel_xy=[1.0, 4.0], pixel_bbox=[1, 4, 1, 4], visible_pixel_median_xy=[1.0, 4.0], depth=1.0, camera_xyz=[1.0, 4.0, 1.0], unit=dataset_native",
        "View 1 marker relations: depth_difference_blue_minus_red=unknown, euclidean_distance=unknown, unit=dataset_native",
        "View 1 marker pair red_to_green: depth_difference=0.0, euclidean_distance=3.0, unit=dataset_native",
    ]
    assert told[1][2:] == expected
    assert told[2][2:] == [re.sub(", euclidean_distance=[^,]*", "", x) for x in expected]


def test_color_markers_are_found_and_boxes_repaired(spark):
    wood, red, green, dim, blue = (190, 105, 70), (255, 0, 0), (0, 128, 1), (0, 99, 0), (0, 0, 255)
    image = [wood] * 48  # 8 x 6
    for x, y, c in [(1, 1, red), (2, 1, red), (2, 2, red), (7, 5, red), (4, 4, green), (5, 4, green), (0, 5, dim), (6, 0, blue)]:
        image[y * 8 + x] = c
    images = spark.createDataFrame([(1, 0, *map(list, zip(*image)))], "question_id long, view int, red array<int>, green array<int>, blue array<int>")
    found = p.color_markers(images, ["question_id", "view"], 8)
    assert {r["color"]: (r["n_pixels"], r["pixel_bbox"], r["pixel_xy"], r["visible_xy"]) for r in found.collect()} == {
        "red": (3, [1, 1, 2, 2], [1.5, 1.5], [2.0, 1.0]),
        "green": (2, [4, 4, 5, 4], [4.5, 4.0], [4.5, 4.0]),
        "blue": (1, [6, 0, 6, 0], [6.0, 0.0], [6.0, 0.0]),
    }
    columns = "question_id long, view int, color string, pixel_bbox array<int>, pixel_xy array<double>, visible_xy array<double>, depth_xy array<double>, camera_xyz array<double>, depth double, fx double, fy double, cx double, cy double"
    stored = spark.createDataFrame([(1, v, "red", None, [0.0, 0.0], None, None, None, 2.0, 1.0, 1.0, 0.0, 0.0) for v in (0, 1)], columns)
    rows = {r["view"]: r for r in g.repaired_boxes(stored, found, (8, 6), (16, 12)).collect()}
    assert [rows[0][c] for c in ("pixel_bbox", "pixel_xy", "visible_xy", "depth_xy", "camera_xyz", "changed")] == [[1, 1, 2, 2], [1.5, 1.5], [2.0, 1.0], [3.0, 3.0], [6.0, 6.0, 2.0], True]
    assert rows[1]["pixel_bbox"] is None and rows[1]["pixel_xy"] == [0.0, 0.0] and not rows[1]["changed"]
