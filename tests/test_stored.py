"""Images, nested documents and stored files, with awkward and broken input."""

import json
import math
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenequery import bindings
from scenequery.functions.common import rounded
from scenequery.operators import markers, pixels, prompts, review, select
from scenequery.operators.parts import largest_part
from scenequery.sources import files, readers, reports, rewrite, sinks


def flooded(mask):
    """The largest 8-connected part, pixel by pixel."""
    left, best = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask))}, set()
    for seed in sorted(left):
        if seed in left:
            part, todo = set(), [seed]
            left.discard(seed)
            while todo:
                y, x = todo.pop()
                part.add((y, x))
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            best = part if len(part) > len(best) else best
    return best


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.floats(0.1, 0.9), st.integers(0, 10**6))
def test_parts(height, width, density, seed):
    mask = np.random.default_rng(seed).random((height, width)) < density
    ys, xs = largest_part(mask)
    assert {(int(y), int(x)) for y, x in zip(ys, xs)} == flooded(mask)


def test_spiral():
    """One part of some ten thousand pixels that winds inwards, beside a blot."""
    n, mask = 201, np.zeros((201, 201), bool)
    y, x, dy, dx = 0, 0, 0, 1
    mask[0, 0] = True
    for _ in range(n * n):
        ahead = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
        free = all(0 <= a < n and 0 <= b < n for a, b in ahead[:1]) and not (0 <= ahead[1][0] < n and 0 <= ahead[1][1] < n and mask[ahead[1]])
        if not free:
            dy, dx = dx, -dy
            if not (0 <= y + dy < n and 0 <= x + dx < n) or mask[y + 2 * dy, x + 2 * dx] if 0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n else True:
                break
            continue
        y, x = y + dy, x + dx
        mask[y, x] = True
    ys, xs = largest_part(mask)
    assert len(ys) == mask.sum() > 10_000


def image(height, width, *boxes):
    rgb = np.zeros((height, width, 3), np.uint8) + np.array((190, 105, 70), np.uint8)
    for (x0, y0, x1, y1), color in boxes:
        rgb[y0 : y1 + 1, x0 : x1 + 1] = color
    return bytearray(rgb.tobytes())


IMAGES = "id int, rgb binary, width int, height int, depth array<double>, depth_width int, depth_height int, matrix array<double>"


def test_markers(spark):
    nan, flat = float("nan"), [2.0, 0.0, 1.0, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0]
    red, blue, green = ((1, 2, 2, 3), (255, 0, 0)), ((5, 5, 6, 6), (0, 0, 255)), ((6, 0, 6, 0), (0, 128, 1))
    far = [nan] * 15 + [4.0]
    rows = [
        (1, image(8, 8, red), 8, 8, [4.0] * 16, 4, 4, flat), (2, image(8, 8, red, blue, green), 8, 8, far, 4, 4, None), (3, image(8, 8, red), 8, 8, [0.0, -1.0, None, float("inf")] * 4, 4, 4, flat),
        (4, None, 8, 8, [1.0], 1, 1, flat), (5, image(8, 8, red), 8, 7, [1.0], 1, 1, flat), (6, image(8, 8, red), 8, 8, None, 4, 4, flat), (7, image(8, 8), 8, 8, [1.0] * 16, 4, 4, flat),
        (8, image(8, 8, red), 8, 8, [4.0] * 16, 4, 4, [0.0] + flat[1:]), (9, image(8, 8, red), 8, 8, [4.0] * 16, 4, 4, [nan] * 9), (10, bytearray(b""), 0, 0, [1.0], 1, 1, flat), (11, image(8, 8, red), 8, 8, [4.0] * 16, 4, 4, [1.0]),
    ]
    got = {(r["id"], r["color"]): r for r in markers.marker_geometry(spark.createDataFrame(rows, IMAGES), ["id"]).collect()}
    one = got[1, "red"].asDict()
    assert one == {"id": 1, "color": "red", "pixel_xy": [1.5, 2.5], "visible_pixel_median_xy": [1.5, 2.5], "pixel_bbox": [1, 2, 2, 3], "depth_pixel_xy": [0.75, 1.25], "marker_pixel_count": 4, "depth_sample_count": 9, "depth": 4.0, "camera_xyz": [-0.5, 0.5, 4.0], "unit": "dataset_native"}
    # the wider square of blue and red reaches the only depth; green lies further away
    assert (got[2, "blue"]["depth"], got[2, "blue"]["depth_sample_count"], got[2, "red"]["depth"], got[2, "blue"]["camera_xyz"]) == (4.0, 1, 4.0, None)
    assert {k for k in got if k[0] in (1, 2)} == {(1, "red"), (2, "red"), (2, "blue"), (2, "green")}
    assert {k[0] for k in got} == {1, 2, 8, 9, 11} and all(got[i, "red"]["camera_xyz"] is None for i in (8, 9, 11))
    assert markers.marker_geometry(spark.createDataFrame(rows, IMAGES).limit(0), ["id"]).count() == 0


def stored_documents(spark, path):
    marker = "struct<color:string,pixel_xy:array<double>,visible_pixel_median_xy:array<double>,pixel_bbox:array<int>,depth_pixel_xy:array<double>,depth:double,camera_xyz:array<double>>"
    view = f"struct<width:int,height:int,depth_width:int,depth_height:int,matrix:array<double>,markers:array<{marker}>,relations:array<struct<pair:string,euclidean_distance:double,depth_difference:double>>>"
    flat = [2.0, 0.0, 1.0, 0.0, 2.0, 1.0, 0.0, 0.0, 1.0]
    bare = ("red", [1.5, 2.5], None, None, None, 4.0, None)
    rows = [(i, i % 3, [(8, 8, 4, 4, flat, [bare, ("blue", None, None, [9, 9, 9, 9], None, None, None)], [])] * (i % 2 + 1)) for i in range(6)] + [(9, 1, None), (10, None, [])]
    spark.createDataFrame(rows, f"question_id int, part int, views array<{view}>").write.partitionBy("part").parquet(path)
    found = [(i, 0, "red", [1.5, 2.5], [1.5, 2.5], [1, 2, 2, 3], [0.75, 1.25]) for i in (0, 3, 4)]
    return spark.createDataFrame(found, "question_id int, view int, color string, pixel_xy array<double>, visible_pixel_median_xy array<double>, pixel_bbox array<int>, depth_pixel_xy array<double>")


def test_repair_in_place(spark, tmp_path):
    path = f"{tmp_path}/documents"
    found = stored_documents(spark, path)
    repair = lambda rows: markers.repaired_views(rows, found)
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "documents" / "part=2").iterdir()}
    assert rewrite.rewrite_changed(spark, path, "part", repair) == 3
    rows = {r["question_id"]: r for r in spark.read.parquet(path).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 9, 10] and rows[9]["views"] is None and rows[10]["views"] == []
    red = rows[3]["views"][0]["markers"][0]
    assert (red["pixel_bbox"], red["camera_xyz"], red["depth_pixel_xy"]) == ([1, 2, 2, 3], [-0.5, 0.5, 4.0], [0.75, 1.25])
    assert rows[3]["views"][0]["markers"][1]["pixel_bbox"] == [9, 9, 9, 9] and rows[3]["views"][1]["markers"][0]["pixel_bbox"] is None
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "documents" / "part=2").iterdir()} == kept  # nothing changed there
    assert rewrite.rewrite_changed(spark, path, "part", repair) == 0
    assert [p.name for p in tmp_path.iterdir()] == ["documents"]


def test_repair_that_died_is_completed(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/documents"
    found = stored_documents(spark, path)
    repair = lambda rows: markers.repaired_views(rows, found)
    real, moves = rewrite.moved, []

    def dies(spark, a, b):
        moves.append(b)
        if len(moves) == 3:
            raise OSError("died")
        real(spark, a, b)

    monkeypatch.setattr(rewrite, "moved", dies)
    with pytest.raises(OSError, match="died"):
        rewrite.rewrite_changed(spark, path, "part", repair)
    monkeypatch.setattr(rewrite, "moved", real)
    rewrite.rewrite_changed(spark, path, "part", repair)
    rows = {r["question_id"]: r for r in spark.read.parquet(path).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 9, 10] and all(rows[i]["views"][0]["markers"][0]["pixel_bbox"] == [1, 2, 2, 3] for i in (0, 3, 4))


def test_outputs_as_one(spark, tmp_path):
    folder, rows = f"{tmp_path}/out", spark.range(3)

    def fails(rows, path, overwrite):
        raise OSError("no room")

    with pytest.raises(OSError):
        reports.write_all(spark, folder, {"a": (rows, sinks.write_json_lines), "b": (rows, sinks.write_json), "c": (rows, fails)})
    assert sinks.listed(spark, folder) == []
    reports.write_all(spark, folder, {"a": (rows, sinks.write_json_lines), "b": (rows, sinks.write_json)})
    assert sinks.listed(spark, folder) == ["a", "b"]
    with pytest.raises(FileExistsError):
        reports.write_all(spark, folder, {"new": (rows, sinks.write_json), "b": (rows, sinks.write_json)})
    assert sinks.listed(spark, folder) == ["a", "b"]
    # a job that died while outputs moved to their places
    (tmp_path / "out" / "_ready").mkdir()
    sinks.write_json_lines(spark.range(7), f"{folder}/_ready/a")
    reports.write_all(spark, folder, {"d": (rows, sinks.write_json)})
    assert sinks.listed(spark, folder) == ["a", "b", "d"] and spark.read.json(f"{folder}/a").count() == 7
    reports.write_all(spark, folder, {"a": (rows, sinks.write_json_lines)}, overwrite=True)
    assert spark.read.json(f"{folder}/a").count() == 3


def test_finite_at_any_depth(spark):
    nan, inf = float("nan"), float("inf")
    kind = "a struct<x:double,l:array<array<float>>,m:map<string,struct<z:double>>,s:string>, `b.c` double, n map<string,int>"
    rows = spark.createDataFrame([((nan, [[1.0, inf], None], {"k": (nan,), "j": None}, "t"), -inf, {"q": 1}), (None, 2.0, None)], kind)
    safe = sinks.finite_columns(rows)
    assert safe.schema == rows.schema or [f.name for f in safe.schema] == [f.name for f in rows.schema]
    first, second = (json.loads(r[0]) for r in safe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect())
    assert first == {"a": {"x": None, "l": [[1.0, None], None], "m": {"k": {"z": None}, "j": None}, "s": "t"}, "b.c": None, "n": {"q": 1}}
    assert second == {"a": None, "b.c": 2.0, "n": None}


def keys_of(value):
    if isinstance(value, dict):
        return [k for key, v in value.items() for k in [key, *keys_of(v)]]
    return [k for v in value for k in keys_of(v)] if isinstance(value, list) else []


_TEXT = st.text(st.sampled_from('ansWer:"\\ /\ngoldé{}[],'), max_size=8) | st.sampled_from(["answer", "my_gold", "correct_label"])
_JSON = st.recursive(st.none() | st.integers() | _TEXT, lambda x: st.lists(x, max_size=3) | st.dictionaries(_TEXT, x, max_size=3), max_leaves=12)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(_JSON, st.booleans()), min_size=20, max_size=40))
def test_keys_at_any_depth(spark, values):
    rows = [(i, json.dumps(v, ensure_ascii=a)) for i, (v, a) in enumerate(values)]
    rows += [(len(rows) + i, "".join(f"\\u{ord(c):04x}" if c.isalpha() and k % 2 else c for k, c in enumerate(r[1]))) for i, r in enumerate(rows) if "\\" not in r[1] and not any(w in r[1] for w in ("null", "true", "false"))]
    got = {r["i"]: (r["keys"], r["leak"]) for r in spark.createDataFrame(rows, "i int, j string").select("i", prompts.json_keys("j").alias("keys"), prompts.key_leaks("j").alias("leak")).collect()}
    for i, text in rows:
        keys = [k for k in keys_of(json.loads(text))]
        leak = any(w in k.lower() for k in keys for w in ("answer", "gold", "correct_label"))
        assert got[i][1] == leak and len(got[i][0]) == len(keys), text


def test_leaks_of_nothing(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), ("",), ("{",)], "j string").select(prompts.key_leaks("j")).collect()] == [False] * 3


def test_question_documents(spark):
    whole = {"question_id": "x", "image": "a", "question": "q", "type": "left_right", "target_objects": ["a"], "answer": None, "evaluation": {}}
    listed = [whole, whole | {"type": ["left_right"]}, whole | {"question_id": 1}, whole | {"question_id": 1, "target_objects": {}}, True]
    rows = [("a", json.dumps({"questions": listed})), ("b", json.dumps({"questions": []})), ("c", "{}"), ("d", None), ("e", "nonsense"), ("f", json.dumps({"questions": {"0": whole}}))]
    got = [(r["file_name"], r["pos"], r["error"]) for r in review.document_errors(spark.createDataFrame(rows, "file_name string, value string")).orderBy("file_name", "pos", "place").collect()]
    allowed = ", ".join(review.QUESTION_TYPES)
    assert got == [
        ("a", 1, "questions[1] duplicate question_id: x"), ("a", 1, f'questions[1] unknown type: ["left_right"]. Allowed: {allowed}'), ("a", 3, "questions[3] target_objects must be a list of strings"), ("a", 4, "questions[4] must be an object"),
        ("c", -1, "top-level field 'questions' must be a list"), ("d", -1, "document is not JSON"), ("e", -1, "document is not JSON"), ("f", -1, "top-level field 'questions' must be a list"),
    ]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-3e9, max_value=3e9) | st.integers(-(10**9), 10**9).map(lambda k: (2 * k + 1) / 2e6) | st.floats(-1e-5, 1e-5), min_size=50, max_size=100))
def test_rounding(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded("v").alias("r")).collect()
    assert [(r["v"], r["r"]) for r in rows if r["r"] != round(r["v"], 6)] == []


def test_rounding_of_nothing(spark):
    rows = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (2.0**60,), (0.0000005,), (2.6750005,)], "v double").select(rounded("v")).collect()
    assert [repr(r[0]) for r in rows] == ["None", "nan", "inf", repr(2.0**60), repr(round(0.0000005, 6)), repr(round(2.6750005, 6))]


def test_image_headers(spark):
    segments = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 16) + b"J" * 14 + b"\xff" * 3 + b"\xdb" + struct.pack(">H", 4) + b"\xff\xc0" + b"\xff\x01" + b"\xff\xc4" + struct.pack(">H", 3) + b"x"
    jpeg = segments + b"\xff\xc2" + struct.pack(">HBHHB", 17, 8, 300, 400, 3)
    many = b"\xff\xd8" + (b"\xff\xfe" + struct.pack(">H", 3) + b"c") * 300 + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 5, 6, 3)
    bmp = b"BM" + b"\0" * 16 + struct.pack("<ii", 7, -9)
    png = files.png_file(np.zeros((3, 5), np.uint8), 1)
    rows = [(1, png), (2, jpeg), (3, bmp), (4, many), (5, b""), (6, None), (7, png[:20]), (8, segments), (9, b"\xff\xd8\xff\xd9"), (10, b"GIF89a" + b"\1" * 30), (11, b"\xff\xd8" + b"\0" * 50)]
    got = {r["i"]: (r["s"]["width"], r["s"]["height"]) for r in spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in rows], "i int, c binary").select("i", readers.image_size("c").alias("s")).collect()}
    assert {i: s for i, s in got.items() if s != (None, None)} == {1: (5, 3), 2: (400, 300), 3: (7, 9), 4: (6, 5), 7: (None, None)} | {7: got[7]} if got[7] != (None, None) else True
    assert (got[1], got[2], got[3], got[4]) == ((5, 3), (400, 300), (7, 9), (6, 5)) and all(got[i] == (None, None) for i in (5, 6, 8, 9, 10, 11))


def test_mask_paths(spark):
    rows = [(1, "/abs/m.png"), (2, "masks/a.png"), (3, "masks\\b.png"), (4, "c.png"), (5, "gone.png")]
    segments = spark.createDataFrame([(i, p, "/repo/out/scene/segments.json") for i, p in rows], "id int, mask_path string, segments_path string")
    there = spark.createDataFrame([("/repo/masks/a.png",), ("/repo/out/scene/a.png",), ("/repo/out/scene/b.png",), ("/repo/c.png",), ("/repo/c.png",)], "path string")
    got = {r["id"]: (r["mask_file"], r["mask_there"]) for r in readers.resolved_mask_paths(segments, there, "/repo").collect()}
    assert got == {1: ("/abs/m.png", False), 2: ("/repo/masks/a.png", True), 3: ("/repo/out/scene/b.png", True), 4: ("/repo/c.png", True), 5: ("/repo/gone.png", False)}
    with pytest.raises(Exception, match="Invalid mask_path in /x"):
        readers.resolved_mask_paths(spark.createDataFrame([(1, " ", "/x")], "id int, mask_path string, segments_path string"), there, "/repo").collect()


def test_colour_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    images = [rng.integers(0, 256, (5, 7, 3), np.uint8), np.full((1, 1, 3), 255, np.uint8), np.arange(300, dtype=np.uint16).astype(np.uint8).reshape(10, 10, 3)]
    table = spark.createDataFrame([(i, x.shape[0], x.shape[1], bytearray(x.tobytes())) for i, x in enumerate(images)], "i int, height int, width int, rgb binary")
    stored = files.rgb_png_bytes(table, ["i"]).groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "content"))), lambda s: s["content"]).alias("images")).select(F.lit("q").alias("question_id"), "images")
    assert files.export_images(stored, f"{tmp_path}/images", f"{tmp_path}/aside") == 3
    got = {r["name"]: r for r in files.color_rasters(spark, f"{tmp_path}/images").collect()}
    assert {n: (r["height"], r["width"], bytes(r["rgb"])) for n, r in got.items()} == {f"q_view_0{i}.png": (x.shape[0], x.shape[1], x.tobytes()) for i, x in enumerate(images)}
    gray = files.png_bytes(spark.createDataFrame([("g.png", 2, 2, [0.0, 9.0, 200.0, 255.0])], "name string, height int, width int, values array<double>"), ["name"])
    files.write_files(gray, f"{tmp_path}/gray")
    assert bytes(files.color_rasters(spark, f"{tmp_path}/gray").first()["rgb"]) == bytes([0, 0, 0, 9, 9, 9, 200, 200, 200, 255, 255, 255])
    with pytest.raises(Exception, match="unsupported image of q"):
        files.export_images(spark.createDataFrame([("q", [bytearray(b"GIF8")])], "question_id string, images array<binary>"), f"{tmp_path}/x", f"{tmp_path}/y")
    assert not (tmp_path / "x").exists()
    with pytest.raises(Exception, match="unreadable image"):
        files.export_images(spark.createDataFrame([("q", [bytearray(b"\xff\xd8\xff\xe0")])], "question_id string, images array<binary>"), f"{tmp_path}/x", f"{tmp_path}/z")
    assert not (tmp_path / "x").exists()


def test_quantiles_of_large_groups(spark):
    rng = random.Random(1)
    rows = [("big", rng.gauss(0, 1)) for _ in range(20_000)] + [("ties", float(rng.randrange(3))) for _ in range(5000)] + [(None, rng.random()) for _ in range(77)] + [("one", 4.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    rows += [("steep", 10.0 ** rng.uniform(-300, 300)) for _ in range(3000)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r["k"]: r["quantiles"] for r in pixels.selected_quantiles(table, ["k"], "v", shares, buckets=16).collect()}
    for k in ("big", "ties", None, "one", "two", "steep"):
        assert np.allclose(got[k], np.percentile([v for g, v in rows if g == k], [100 * s for s in shares]), rtol=1e-12, atol=0)
    assert "none" not in got and pixels.selected_quantiles(table.limit(0), ["k"], "v", shares).count() == 0
    plain = pixels.depth_stats(table.withColumnRenamed("v", "d"), ["k"], F.lit(True)).collect()
    assert sorted(map(str, pixels.depth_stats_large(table.withColumnRenamed("v", "d"), ["k"], F.lit(True)).where("k <> 'steep'").collect())) == sorted(str(r) for r in plain if r["k"] not in ("steep", None))


SOURCE = "id string, img_type string, format_type string, task string, question string, answer string, has_image boolean"


def brute_selection(rows, limit, cap):
    """The rows in order, task by task, as a loop takes them; rows that are alike may change places."""
    number = lambda i: (0, int(i), i) if i.isdigit() else (1, 0, i)
    order = sorted(rows, key=lambda r: (0 if r[2] == "select" else 1, number(r[0] or "unknown"), r[5]))
    taken, counts, out = 0, {}, []
    for r in order:
        why = []
        if taken >= limit:
            why = ["phase_limit"]
        elif counts.get(r[3], 0) >= cap:
            why = ["per_task_limit"]
        else:
            taken, counts[r[3]] = taken + 1, counts.get(r[3], 0) + 1
        out.append((r[0], r[3], r[5], tuple(why)))
    return sorted(map(str, out))


@pytest.mark.parametrize("cap,copies", [(3, 1), (20, 2), (20, 40)])
def test_selection_of_repeats(spark, cap, copies):
    rng = random.Random(cap + copies)
    rows = [(rng.choice([None, "7", "x", str(rng.randrange(60))]), "single_view", rng.choice(["select", "fill"]), rng.choice(["depth_a", "distance_b", "spatial_c"]), "q", str(rng.randrange(5)), True) for _ in range(60)]
    rows = [r for r in rows for _ in range(rng.choice([1, copies]))]
    config = select.Selection(per_task_limit=cap)
    got = select.select_rows(spark.createDataFrame(rows, SOURCE).repartition(5), "a", config, tie=F.struct("answer")).collect()
    assert len(got) == len(rows) and all(r["selected"] == (r["reasons"] == []) for r in got)
    assert sum(r["selected"] for r in got) <= 30
    # rows of one key and tie may differ in their task only, by whose hash they are ordered; so compare what doesn't depend on that
    unique = {(r[0], r[2], r[5]): r[3] for r in rows}
    if len({(r[0], r[2], r[5], r[3]) for r in rows}) == len(unique):
        assert sorted(str((r["id"], r["task"], r["answer"], tuple(r["reasons"]))) for r in got) == brute_selection(rows, 30, cap)


def test_selection_without_ids_is_no_square(spark):
    rows = [(None, "single_view", "fill", "depth_a", f"q{i}", "1", True) for i in range(500)] + [("1", "video", "fill", "depth_a", "q", "1", True)]
    got = select.select_rows(spark.createDataFrame(rows, SOURCE), "a").collect()
    assert len(got) == 501 and sum(r["selected"] for r in got) == 20 and sum(r["reasons"] == ["per_task_limit"] for r in got) == 480
    assert select.select_rows(spark.createDataFrame(rows, SOURCE).limit(0), "b").count() == 0


def test_image_names(spark):
    got = [r[0] for r in spark.createDataFrame([(5,), (123456,), (1234567,), (1234568,)], "i long").select(bindings.image_name(F.col("i"))).collect()]
    assert got == ["scene_000005", "scene_123456", "scene_1234567", "scene_1234568"]


def test_prompts_of_null_questions(spark):
    q = spark.createDataFrame([(1, "i", "left_right", ["a"], [], None)], "question_id int, image string, type string, targets array<string>, missing array<string>, question string")
    told = spark.createDataFrame([("i", ["head"], ["body"])], "image string, head array<string>, body array<string>")
    best = spark.createDataFrame([("i", "a", 1, 0.5)], "image string, label string, object_id int, closeness double")
    row = prompts.local_prompts(q, told, best).first()
    assert row["pure_vlm"].split("\n")[-2:] == ["Question: ", prompts.ANSWER_LINE]
