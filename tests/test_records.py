"""Row sources, numbered lines, providers, prompt records, audits and outputs of several files, with awkward input."""

import http.server
import json
import math
import threading
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scenequery.operators import audit, geometry, infer, metrics, prompts, review
from scenequery.sources import files, readers, rows, sinks


@pytest.fixture
def grouped_file(tmp_path):
    """Two files of five row groups of a hundred rows in all."""
    folder = tmp_path / "table.parquet"
    folder.mkdir()
    for i, n in enumerate((300, 200)):
        low = 300 * i
        table = pa.table({"id": pa.array(range(low, low + n), pa.int64()), "task": [f"t{(low + k) // 100}" for k in range(n)], "depth": [[float(k)] for k in range(n)], "x": [None if k % 7 == 0 else k / 2 for k in range(n)]})
        pq.write_table(table, folder / f"part-{i}.parquet", row_group_size=100)
    (folder / "_SUCCESS").write_text("")
    return str(folder)


def test_row_source(spark, grouped_file):
    whole = rows.row_source(spark, grouped_file)
    assert whole.columns == ["id", "task", "depth", "x"] and whole.count() == 500 and whole.rdd.getNumPartitions() == 5
    narrow = rows.row_source(spark, grouped_file, ["x", "pose", "id"])
    assert narrow.columns == ["x", "id"] and narrow.agg(F.sum("id"), F.count("x")).first()[:] == (500 * 499 // 2, sum(k % 7 > 0 for n in (300, 200) for k in range(n)))
    for limit, parts in ((0, 1), (1, 1), (100, 1), (101, 2), (350, 4), (9999, 5)):
        few = rows.row_source(spark, grouped_file, ["id"], limit)
        assert [r["id"] for r in few.orderBy("id").collect()] == list(range(min(limit, 500))) and few.rdd.getNumPartitions() == parts
    assert "ReadSchema" in (plan := narrow._jdf.queryExecution().toString()) or "depth" not in plan
    with pytest.raises(Exception, match="no Parquet files"):
        rows.row_source(spark, grouped_file + "/none-here-" + "x").count()


def test_row_source_filters(spark, grouped_file):
    whole = rows.row_source(spark, grouped_file, ["id", "task"])
    for test, ids, parts in (("id >= 350", range(350, 500), 2), ("id = 7", [7], 1), ("id < 0", [], 1), ("task = 't3'", range(300, 400), 1), ("id in (1, 499)", [1, 499], 2), ("id > 99 and task < 't2'", range(100, 200), 1), ("x is null", None, None)):
        found = whole.where(test) if "x" not in test else rows.row_source(spark, grouped_file).where(test)
        if ids is None:
            assert found.count() == sum(k % 7 == 0 for n in (300, 200) for k in range(n))
        else:
            assert [r["id"] for r in found.orderBy("id").collect()] == list(ids) and found.rdd.getNumPartitions() == parts
    # a limit comes first, whatever is filtered afterwards
    assert rows.row_source(spark, grouped_file, ["id"], 120).where("id >= 110").count() == 10


def test_lines_are_numbered_across_splits(spark, tmp_path):
    lines = [json.dumps({"id": k, "fill": "x" * (k % 50)}) if k % 11 else ("{" if k % 2 else "[1]") for k in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n\n{}\nnope\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8192)
    try:
        got = {(readers_name(r["path"]), r["line"]): r["error"] for r in readers.json_line_errors(spark, str(tmp_path), strict=True).collect()}
        lenient = readers.json_line_errors(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {("a.jsonl", k + 1): "invalid JSON" if k % 2 else "record must be an object" for k in range(0, 3000, 11)} | {("b.jsonl", 4): "invalid JSON"}
    assert got == want and lenient == sum(e == "invalid JSON" for e in want.values())
    with pytest.raises(Exception, match="b.jsonl"):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), "id int").collect()


def readers_name(path):
    return path.rsplit("/", 1)[-1]


@pytest.fixture
def endpoint(monkeypatch):
    """A chat endpoint on this machine that answers by what the prompt says; the requests it got."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, dict(self.headers), body))
            said = body["messages"][0]["content"][0]["text"]
            if said == "slow":
                time.sleep(2)
            code, reply = (500, b"out of memory") if said == "fail" else (200, json.dumps({} if said == "empty" else {"choices": [{"message": {"content": [{"text": "It is"}, {"image": 1}, {"text": said}]}}]}).encode())
            self.send_response(code)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("SCENE_TEST_KEY", "secret")
    yield f"http://127.0.0.1:{server.server_port}/v1", seen
    server.shutdown()


def test_chat_provider(endpoint):
    url, seen = endpoint
    provider = infer.ChatProvider(url + "/", "m", "SCENE_TEST_KEY", timeout=0.5, max_tokens=9)
    assert provider.answer("lamp", "data:image/png;base64,AA").split() == ["It", "is", "lamp"]
    path, headers, body = seen[0]
    assert path == "/v1/chat/completions" and headers["Authorization"] == "Bearer secret" and (body["model"], body["temperature"], body["max_tokens"]) == ("m", 0, 9)
    assert body["messages"][0]["content"] == [{"type": "text", "text": "lamp"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64,AA"}}]
    with pytest.raises(RuntimeError, match="500: out of memory"):
        provider.answer("fail")
    with pytest.raises(RuntimeError, match="can't be reached"):
        provider.answer("slow")
    with pytest.raises(Exception):
        provider.answer("empty")
    with pytest.raises(RuntimeError, match="can't be reached"):
        infer.ChatProvider("http://127.0.0.1:9", "m", "SCENE_TEST_KEY", timeout=0.5).answer("x")


def test_provider_errors_stay_in_their_rows(spark, endpoint):
    url, _ = endpoint
    asked = spark.createDataFrame([(1, "pure_vlm", "lamp"), (2, "pure_vlm", "fail")], "question_id int, track string, prompt string").select("*", F.lit("exact_match").alias("metric"), F.lit("it is lamp").alias("answer"), F.lit(0.1).alias("tolerance"), F.lit(None).cast("string").alias("image"))
    got = {r["question_id"]: r for r in infer.public_results(asked, infer.ChatProvider(url, "m", "PATH")).collect()}
    assert got[1]["error"] is None and "500: out of memory" in got[2]["error"] and not got[2]["correct"]


def test_prompt_records(spark):
    table = spark.createDataFrame([(1, "closer", "A", ["a.png"]), (2, "closer", None, [])], "question_id int, task string, answer string, images array<string>")
    told = spark.createDataFrame([(1, {"pure_vlm": "p", "geometry_only": "answer: A"}), (2, {"pure_vlm": "p"})], "question_id int, prompts map<string,string>")
    got = {r["question_id"]: r for r in prompts.prompt_records(table, told).collect()}
    assert got[1]["requires_image"] == {"pure_vlm": True, "geometry_only": False, "image_and_geometry": True} and got[1]["images"] == ["a.png"] and got[1]["prompts"]["pure_vlm"] == "p"
    with pytest.raises(Exception, match="Missing geometry for 2"):
        prompts.prompt_records(table, told.where("question_id = 1")).collect()
    leaky = told.withColumn("prompts", F.create_map(F.lit("pure_vlm"), F.lit("The Correct Answer: A")))
    with pytest.raises(Exception, match="Answer leak detected in prompts for 1"):
        prompts.prompt_records(table.where("question_id = 1"), leaky).collect()
    assert prompts.prompt_records(table.where("question_id = 1").withColumn("answer", F.lit(" ")), leaky).count() == 1
    images = table.select("question_id", prompts.required_image("images", F.lit("geometry_only")).alias("i"))
    assert [r["i"] for r in images.collect()] == [None, None]
    with pytest.raises(Exception, match="missing an image for 2"):
        table.select(prompts.required_image("images", F.lit("pure_vlm"))).collect()


def test_audits(spark):
    questions = spark.createDataFrame([(i, "t") for i in (1, 2, 3, 4, 4)], "question_id int, task string")
    found = spark.createDataFrame([(1, "available", None, [], False, True), (2, "geometry_unavailable", "required_marker_missing", ["blue", "red"], False, False), (4, "available", None, [], True, False)], "question_id int, status string, reason string, missing array<string>, label_conflict boolean, ready boolean")
    rows_ = audit.audit_of_questions(questions, found)
    assert sorted((r["question_id"], r["status"], r["ready"]) for r in rows_.collect()) == [(1, "available", True), (2, "geometry_unavailable", False), (3, "missing_geometry", False), (4, "available", False), (4, "available", False)]
    counts = {(r["kind"], r["value"]): r["n"] for r in audit.audit_counts(rows_).collect()}
    assert counts == {("questions", ""): 5, ("available", ""): 1, ("unavailable", ""): 4, ("label_conflict", ""): 2, ("status", "available"): 3, ("status", "geometry_unavailable"): 1, ("status", "missing_geometry"): 1, ("missing_marker", "blue"): 1, ("missing_marker", "red"): 1}
    none = {(r["kind"], r["n"]) for r in audit.audit_counts(rows_.limit(0)).collect()}
    assert none == {("questions", 0), ("available", 0), ("unavailable", 0), ("label_conflict", 0)}
    gone = sorted((r["question_id"], r["removed"], r["source_question_count"], r["removed_question_count"]) for r in audit.removal_audit(questions, rows_).collect())
    assert gone == [(1, False, 5, 4), (2, True, 5, 4), (3, True, 5, 4), (4, True, 5, 4), (4, True, 5, 4)]


def test_nested_matrices(spark):
    three = [[1.0, 0.0, 2.0], [0.0, 1.0, 3.0], [0.0, 0.0, 1.0]]
    four = [[float(i * 4 + k) for k in range(4)] for i in range(4)]
    table = [(1, three), (2, four), (3, [sum(four, [])]), (4, three[:2]), (5, [[1.0], [1.0, 2.0]]), (6, []), (7, None), (8, [[math.nan] * 3] * 3), (9, [None, [1.0]]), (10, [[None] * 3] * 3), (11, [[]])]
    frame = spark.createDataFrame(table, "i int, m array<array<double>>")
    got = {r["i"]: r["s"] for r in frame.select("i", geometry.nested_matrix_status("m").alias("s")).collect()}
    assert [i for i, s in got.items() if s["valid"]] == [1, 2, 3] and got[3]["shape"] == [4, 4] and got[3]["values"] == sum(four, []) and got[4]["shape"] == [2, 3] and got[8]["shape"] == [3, 3] and got[8]["values"] is None
    assert all(got[i]["shape"] is None for i in (5, 6, 7, 9, 11))
    poses = {r["i"] for r in frame.select("i", geometry.nested_matrix_status("m", (4,)).alias("s")).where("s.valid").collect()}
    assert poses == {2, 3}


def test_depth_outputs(spark, tmp_path):
    ramp = [[float(x + y) for x in range(4)] for y in range(3)]
    table = spark.createDataFrame([("a.jpg", 3, 4, sum(ramp, []), 3, 4), ("b.jpg", 3, 4, sum(ramp, []), 6, 8), ("c.jpg", 1, 2, [math.nan, math.inf], 1, 2)], "image string, height int, width int, values array<float>, image_height int, image_width int")
    folder = f"{tmp_path}/depth"
    assert files.write_files_as_one(files.depth_outputs(table, "m", "d"), folder) == 9
    got = {r["name"]: r for r in readers.npy_rasters(spark, folder).collect()}
    assert got["a_depth.npy"]["values"] == sum(ramp, []) and (got["b_depth.npy"]["height"], got["b_depth.npy"]["width"]) == (6, 8)
    assert abs(np.array(got["b_depth.npy"]["values"]).reshape(6, 8)[2:4, 3:5].mean() - 2.5) < 0.01
    gray = {r["name"]: r["values"] for r in files.gray_rasters(spark, folder).collect()}
    assert gray["a_depth.png"] == [math.floor(v / 5 * 255) for v in sum(ramp, [])] and gray["c_depth.png"] == [0.0, 0.0] and len(gray["b_depth.png"]) == 48
    said = {r["file_name"]: r for r in readers.documents(spark, folder, "depth_min double, depth_max double, depth_shape array<int>").collect()}
    assert (said["a_depth.json"]["depth_min"], said["b_depth.json"]["depth_shape"], said["c_depth.json"]["depth_max"]) == (0.0, [6, 8], None)
    with pytest.raises(FileExistsError):
        files.write_files_as_one(files.depth_outputs(table, "m", "d"), folder)
    broken = files.depth_outputs(table, "m", "d").withColumn("content", F.when(F.col("name") == "b_depth.json", F.raise_error(F.lit("no room")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no room"):
        files.write_files_as_one(broken, f"{tmp_path}/new")
    assert sinks.listed(spark, str(tmp_path)) == ["depth"]
    assert files.write_files_as_one(files.depth_outputs(table.limit(1), "m", "d"), folder, overwrite=True) == 3 and len(sinks.listed(spark, folder)) == 3


def test_reports_in_order(spark):
    table = spark.createDataFrame([(x,) for x in ["b", "a", "a", "c", "b", None, ""]], "t string")
    assert [(r["value"], r["n"], r["place"]) for r in metrics.ranked_histogram(table, F.col("t")).orderBy("place").collect()] == [("a", 2, 1), ("b", 2, 2), ("c", 1, 3)]
    names = spark.createDataFrame([(x,) for x in ["b.png", "A.png", "C.png", "a.png"]], "name string")
    assert [r["name"] for r in readers.first_files(names, 3).collect()] == ["A.png", "a.png", "b.png"]


def test_boxes_of_another_size_stop(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0]), (3, None)], "i int, b array<double>")
    assert table.where("i = 1").select(geometry.box_prompt("b", "i").alias("p")).first()["p"] == [1.0, 2.0, 3.0, 4.0]
    for i in (2, 3):
        with pytest.raises(Exception, match=f"four numbers: {i}"):
            table.where(F.col("i") == i).select(geometry.box_prompt("b", "i")).collect()


def test_labels_are_stamped(spark):
    rows_ = spark.createDataFrame([("i", "a"), ("i", "b")], "image string, label string")
    own, general = spark.createDataFrame([], "image string, from string, to string"), spark.createDataFrame([("a", "x"), ("b", "b")], "from string, to string")
    got = sorted((r["label"], r["raw_label"], r["rule"], r["normalization_config"]) for r in review.normalized_labels(rows_, own, general, F.lit("v2")).collect())
    assert got == [("b", None, None, "v2"), ("x", "a", "global_label_aliases", "v2")]
    assert "normalization_config" not in review.normalized_labels(rows_, own, general).columns


def test_template_texts(spark):
    table = [("a", '{"scene_group": "g", "templates": [{}, 3]}'), ("b", None), ("c", '{"scene_group": null, "templates": [{"template_id": 1, "question": null, "type": 1, "target_objects": 1, "answer": 1, "evaluation": 1}]}')]
    got = [(r["file_name"], r["pos"], r["error"].rsplit(" ", 1)[-1]) for r in review.template_text_errors(spark.createDataFrame(table, "file_name string, value string")).orderBy("file_name", "pos", "place").collect()]
    assert got == [("a", 0, c) for c in review.TEMPLATE_FIELDS] + [("a", 1, "object"), ("b", -1, "JSON"), ("c", -1, "string")]
