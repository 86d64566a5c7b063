"""Known inputs with known results."""


import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenequery import bindings
from scenequery.operators import answers, audit, geometry, infer, metrics, pixels, prompts, review, select
from scenequery.operators.decide import rule_answers
from scenequery.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("right,total,share", [(74, 81, 0.91358), (78, 81, 0.962963), (16, 23, 0.695652), (20, 23, 0.869565), (9, 24, 0.375), (14, 24, 0.583333)])
def test_published_accuracies(spark, right, total, share):
    rows = spark.createDataFrame([("t", "x", i < right) for i in range(total)], "track string, prediction string, correct boolean")
    assert metrics.summary(rows, ["track"]).first()["accuracy"] == share


def test_paired_outcomes_of_two_tracks(spark):
    pairs = [(True, True)] * 74 + [(False, True)] * 4 + [(False, False)] * 3
    rows = [(i, t, "x", c, "m", None, None, "q") for i, (a, b) in enumerate(pairs) for t, c in (("a", a), ("b", b))]
    table = spark.createDataFrame(rows, "question_id long, track string, prediction string, correct boolean, metric string, unit string, tolerance double, type string")
    out = metrics.pair_outcomes(metrics.aligned(table, ("a", "b")), ("a", "b")).first()
    assert (out["both_correct"], out["right_only"], out["left_only"], out["both_wrong"], out["delta_accuracy"]) == (74, 4, 0, 3, 0.049383)


def test_empty_groups_and_ratios(spark):
    empty = spark.createDataFrame([], "prediction string, correct boolean")
    assert metrics.summary(empty, []).first()["accuracy"] == 0.0


@pytest.mark.parametrize(
    "raw,metric,expected",
    [
        ("Option b", "multiple_choice", "B"), ("a cup", "multiple_choice", "A"), ("I'd say", "multiple_choice", "D"), ("none", "multiple_choice", "unknown"),
        ("about 1,234.50 m", "numeric_tolerance", "1234.5"), ("−2", "numeric_tolerance", "-2"), ("no number", "numeric_tolerance", "unknown"), ("-0", "numeric_tolerance", "0"),
        ("100", "numeric_tolerance", "100"), ('"The cup."', "exact_match", "The cup"), (None, "exact_match", "unknown"), ("  N/A ", "exact_match", "unknown"),
    ],
)
def test_public_answers(spark, raw, metric, expected):
    assert one(spark, answers.public_answer(F.lit(raw).cast("string"), F.lit(metric))) == expected


@pytest.mark.parametrize("raw,expected", [("the mouse, not the book", "mouse"), ("bookcase", "unknown"), ("red book or book", "red book"), ("", "unknown"), (None, "unknown")])
def test_label_answers(spark, raw, expected):
    targets = F.array(F.lit("book"), F.lit("mouse"), F.lit("Red Book"), F.lit(""))
    assert one(spark, answers.label_answer(F.lit(raw).cast("string"), targets)) == expected


def test_evaluation_at_the_tolerance(spark):
    def correct(p, g):
        return one(spark, answers.evaluated(F.lit(p), F.lit("numeric_tolerance"), F.lit(g), F.lit(0.1)))["correct"]

    assert correct("3.6", "3.5") and not correct("3.61", "3.5") and not correct("unknown", "3.5")


@settings(max_examples=30, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e9, max_value=1e9))
def test_six_digits_as_printf(x):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None:
        assert one(spark, prompts.six_digits(F.lit(float(x)))) == (f"{x:.6g}" if x else "0")


@pytest.mark.parametrize("x", [190.0, 0.0, 0.123456, 12.5, 1e-5, 123456.0, 1234567.0, -0.5, 100000.0])
def test_six_digits(spark, x):
    assert one(spark, prompts.six_digits(F.lit(x))) == f"{x:.6g}"


def test_matrices(spark):
    def status(values):
        return one(spark, geometry.matrix_status(F.array(*[F.lit(float(v)) for v in values])))

    assert status(range(9))["valid"] and status(range(16))["shape"] == [4, 4] and not status(range(12))["valid"] and not status([float("nan")] * 9)["valid"]


def test_back_projection(spark):
    lit = [F.lit(float(v)) for v in (10, 20, 2, 4, 5, 2, 10)]
    assert one(spark, geometry.camera_xyz(*lit)) == [4.0, 4.0, 2.0]
    assert one(spark, geometry.camera_xyz(*lit[:3], F.lit(0.0), *lit[4:])) is None


def test_mask_and_depth_of_a_small_scene(spark):
    # two boxes in a 10 x 10 image, the left half at depth 2 and the right at 8
    cells = [("a", o, x, y, 2.0 if x < 5 else 8.0, inside) for o, (xs, ys) in enumerate([((1, 3), (2, 5)), ((6, 8), (1, 4))]) for x in range(10) for y in range(10) for inside in [xs[0] <= x <= xs[1] and ys[0] <= y <= ys[1]]]
    table = spark.createDataFrame(cells, "image string, object_id int, x int, y int, d double, m boolean")
    found = {r["object_id"]: r for r in pixels.mask_geometry(table, ["image", "object_id"], F.col("m"), 10, 10).collect()}
    assert found[0]["mask_area_px"] == 12 and found[0]["mask_bounds_xyxy"] == [1, 2, 3, 5] and found[1]["mask_centroid"] == [7.0, 2.5] and found[0]["mask_area_fraction"] == 0.12
    depths = {r["object_id"]: r for r in pixels.depth_stats(table, ["image", "object_id"], F.col("m")).collect()}
    assert depths[0]["relative_depth_median"] == 2.0 and depths[1]["relative_depth_p90"] == 8.0
    nothing = pixels.mask_geometry(table, ["image"], F.lit(False), 10, 10).first()
    assert nothing["mask_area_px"] == 0 and nothing["mask_centroid"] is None


def test_largest_component_takes_the_first_of_equals():
    mask = np.zeros((7, 7), bool)
    mask[0:2, 0:2] = mask[4:6, 4:6] = True
    assert (pixels.largest_component(mask)[:2, :2]).all() and not pixels.largest_component(mask)[4, 4]
    mask[3, 3] = True  # joins the second by a corner
    assert pixels.largest_component(mask).sum() == 5 and pixels.largest_component(np.zeros((2, 2), bool)).sum() == 0


def test_rule_baseline(spark):
    objects = spark.createDataFrame(
        [("i", 1, 1, "book", 0.5, 0.2, 0.1, "top", "far"), ("i", 2, 2, "cup", 0.9, 0.8, 0.05, "bottom", "near")],
        "image string, ord int, object_id int, label string, closeness_score double, relative_depth_median double, mask_area_fraction double, vertical_position string, depth_order_hint string",
    )
    pairs = spark.createDataFrame([("i", 1, 2, "book", "cup", "farther_than")], "image string, ord_a int, ord_b int, label_a string, label_b string, depth_relation string")
    asked = spark.createDataFrame(
        [(1, "i", "closer_farther", ["cup", "book"], "cup"), (2, "i", "physical_size", ["cup", "book"], "book"), (3, "i", "support_relation", ["cup", "book"], "cup"), (4, "i", "left_right", ["cup"], "cup"), (5, "i", "physical_size", ["cup", "sofa"], "cup"), (6, "i", "closer_farther", ["cup"], "cup")],
        "question_id int, image string, type string, targets array<string>, answer string",
    )
    got = {r["question_id"]: (r["prediction"], r["source"], r["confidence"], r["correct"], r["error_reason"]) for r in rule_answers(asked, objects, pairs).collect()}
    assert got[1] == ("cup", "pairwise_closeness_relation", 0.9, True, None)
    assert got[2] == ("book", "mask_area_fraction", 0.7, True, None)
    assert got[3] == ("cup", "support_heuristic", 0.45, True, None)
    assert got[4] == ("unknown", "unsupported_question_type", 0.0, False, "unsupported_question_type")
    assert got[5] == ("unknown", "none", 0.0, False, "missing_target_objects")
    assert got[6][1] == "insufficient_target_objects"


def test_review_values(spark):
    rows = spark.createDataFrame([("geometry_available_candidates", " Yes", "1", "passed", f) for f in ("", "clean", "Excluded", "other")] + [("pipeline_failure", "y", "y", "y", "")], "automatic_split string, mask_ok string, depth_ok string, question_valid string, final_split string")
    assert [r[0] for r in rows.select(review.is_clean()).collect()] == [True, True, False, False, False]


def test_selection_is_the_loop(spark):
    rows = [(str(i), "single_view", ("select", "fill")[i % 2], f"depth_{i % 3}", "q?", "1", i % 7 != 0) for i in range(300)]
    table = spark.createDataFrame(rows, "id string, img_type string, format_type string, task string, question string, answer string, has_image boolean")
    config = select.Selection(per_task_limit=7)
    able = sorted((r for r in rows if r[6]), key=lambda r: (0 if r[2] == "select" else 1, int(r[0])))
    taken, per_task = [], {}
    for r in able:
        if per_task.get(r[3], 0) < 7 and len(taken) < 30:
            taken.append(r[0])
            per_task[r[3]] = per_task.get(r[3], 0) + 1
    got = select.select_rows(table, "a", config).where("selected").orderBy("key").select("id").collect()
    assert [r[0] for r in got] == taken


def test_decision_aids(spark):
    row = spark.createDataFrame([(1,)], "question_id int").select(
        F.lit("distance_infer_center_oo").alias("task"), F.lit("?").alias("question"), F.array(F.struct(F.lit("red_to_blue").alias("pair"), F.lit(680.719033).alias("euclidean_distance")), F.struct(F.lit("red_to_green").alias("pair"), F.lit(447.628657).alias("euclidean_distance"))).alias("pairs"),
        F.create_map(F.lit("red"), F.struct(F.lit(1.0).alias("px"), F.lit(2.0).alias("py"), F.array(F.lit(0.0), F.lit(0.0), F.lit(3.0)).alias("camera_xyz"))).alias("points"),
    )
    assert row.select(prompts.decision_aid("task", "question", "pairs", "points")).first()[0] == "Decision aid: red_to_green=447.628657; red_to_blue=680.719033; blue is farther than green."


def test_local_prompt_text(spark):
    told = spark.createDataFrame([("i.jpg", ["Image: i.jpg"], ["Objects:", "- none detected"])], "image string, head array<string>, body array<string>")
    asked = spark.createDataFrame([(1, "i.jpg", "closer_farther", ["cup", "sofa"], ["sofa"], "Which?")], "question_id int, image string, type string, targets array<string>, missing array<string>, question string")
    best = spark.createDataFrame([("i.jpg", "cup", "obj_001", 190.0)], "image string, label string, object_id string, closeness double")
    row = prompts.local_prompts(asked, told, best).first()
    assert row["pure_vlm"].split("\n")[-2:] == ["Question: Which?", prompts.ANSWER_LINE]
    assert row["geometry_only"].split("\n")[3:] == ["Image: i.jpg", "Target object labels: cup, sofa", "Objects:", "- none detected", "Missing target labels in geometry: sofa", *prompts.COMPARE_LINES, prompts.NO_TARGET_LINE, "Question: Which?", prompts.ANSWER_LINE]


def test_leaks(spark):
    assert one(spark, prompts.key_leaks(F.lit('{"a": [{"Gold_x": 1}]}'))) and not one(spark, prompts.key_leaks(F.lit('{"a": "gold"}')))


def test_provider_errors_stay_in_their_row(spark):
    rows = spark.createDataFrame([(1, "t", "x", ["cup"], "cup", "", None), (2, "t", "x", ["cup"], "cup", "p", None)], "question_id int, track string, type string, targets array<string>, answer string, prompt string, image string")
    got = {r["question_id"]: r for r in infer.local_results(rows, infer.MockProvider("a CUP")).collect()}
    assert got[1]["error"].startswith("ValueError") and not got[1]["correct"] and got[2]["correct"]
    with pytest.raises(ValueError):
        infer.message_text({"error": 1})


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = spark.createDataFrame([(1, float("nan"), ["a", "b"]), (2, 1.5, [])], "id int, x double, l array<string>")
    sinks.write_json_lines(rows, path)
    assert sorted(map(tuple, readers.json_lines(spark, path, "id int, x double").collect())) == [(1, None), (2, 1.5)]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        sinks.write_json_lines(rows, path)
    with pytest.raises(FileExistsError):
        sinks.check_outputs(spark, [path])
    sinks.write_csv(rows, path + "c", ["id", "l"])
    assert sorted(map(tuple, readers.csv_rows(spark, path + "c").collect())) == [("1", "a;b"), ("2", "")]


def test_json_lines_lenient_and_strict(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n[1]\n')
    path = str(tmp_path / "a.jsonl")
    assert readers.json_lines(spark, path, "id int").count() == 1
    with pytest.raises(Exception, match="not an object"):
        readers.json_lines(spark, path, "id int", strict=True).collect()
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{oops\n')
    with pytest.raises(Exception, match="invalid JSON"):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), "id int").collect()


def test_documents_and_rasters(spark, tmp_path):
    import json

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"version": "1", "questions": [{"question_id": "q1", "type": "x"}, {"question_id": "q2"}]}, indent=1))
    assert [r["question_id"] for r in readers.questions(spark, str(tmp_path / "d")).orderBy("pos").collect()] == ["q1", "q2"]
    assert readers.question_ids(spark, str(tmp_path / "d")).count() == 2
    np.save(tmp_path / "r.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    raster = readers.npy_rasters(spark, str(tmp_path))
    assert {(r["x"], r["y"], r["d"]) for r in readers.raster_pixels(raster, ["name"]).collect()} >= {(2, 1, 5.0), (0, 0, 0.0)}
    assert readers.resized(raster, ["name"], 4, 6).first()["values"][:2] == [0.0, 0.0]
    assert len(readers.resized(raster, ["name"], 4, 6, "bicubic").first()["values"]) == 24


def test_names_and_colors(spark):
    assert one(spark, infer.label_color(F.lit("book"))) and one(spark, answers.question_id(F.lit("12345678"), "q")) == "q_12345678" and one(spark, answers.question_id(F.lit(" "), "q")) == "q_unknown"
    assert one(spark, F.array_sort(audit.required_colors(F.lit("RED point and blue  bbox, green")))) == ["blue", "red"]
    assert bindings.SIDE == 8


def test_streamed_summary_equals_batch(spark, tmp_path):
    from scenequery.streaming.results import append_to, windowed_accuracy

    rows = spark.range(200).selectExpr("timestamp_seconds(id * 60) AS ts", "concat('t', id % 2) AS track", "if(id % 5 = 0, 'unknown', 'x') AS prediction", "id % 3 = 0 AS correct")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_accuracy(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "10 minutes", "1 minute")
    append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("total <> 5").count() == 0 and got.count() >= 36


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.integers(-(10**7), 10**7).map(lambda n: n / 10**6), st.integers(1, 10**7).map(lambda n: (n * 10 + 5) / 10**9), st.floats(1e-12, 1e12), st.sampled_from([0.0, 0.5, 0.001, 3.454545, 2.5, 1234565.0, 999999.5, 1e-4, 9.9999995e-5])), min_size=1, max_size=60))
def test_six_digits_are_those_of_the_binary_value(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", prompts.six_digits("v").alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{r['v']:.6g}".replace("-0", "0") if r["v"] == 0 else f"{r['v']:.6g}" for r in rows]


def test_exact_keys_fold_case_as_unicode_does(spark):
    from scenequery.operators.answers import exact_key

    letters = [chr(c) for c in range(0x21, 0x20000) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
    rows = [(a, b) for x in letters for a, b in {(x, x.casefold()), (x, x.lower()), (x, x.upper())} if x.casefold() != x or a != b]
    held = spark.createDataFrame(rows, "a string, b string").select("a", "b", exact_key("a").alias("ka"), exact_key("b").alias("kb")).collect()
    assert [(r["a"], r["b"]) for r in held if (r["ka"] == r["kb"]) != (r["a"].casefold() == r["b"].casefold())] == []
