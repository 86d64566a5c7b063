"""Files written, decoded and renamed by tasks."""

import io
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scenequery.operators import review
from scenequery.sources import files, readers


def rows(spark, pairs):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in pairs], "name string, content binary")


def test_write_files(spark, tmp_path):
    folder = f"{tmp_path}/out"
    assert files.write_files(rows(spark, [("a.bin", b"1"), ("b/c.bin", b"")]), folder) == 2
    assert open(f"{folder}/a.bin", "rb").read() == b"1" and os.listdir(f"{folder}/b") == ["c.bin"]
    with pytest.raises(FileExistsError):
        files.write_files(rows(spark, [("a.bin", b"2")]), folder)
    assert files.write_files(rows(spark, [("a.bin", b"2")]), f"file:{folder}", overwrite=True) == 1
    assert open(f"{folder}/a.bin", "rb").read() == b"2"
    assert files.write_files(rows(spark, []), f"{tmp_path}/none") == 0


def test_gray_images(spark, tmp_path):
    values = np.arange(12, dtype=np.float32) * 20
    table = spark.createDataFrame([("m.png", 3, 4, values.tolist())], "name string, height int, width int, values array<double>")
    files.write_files(files.png_bytes(table, ["name"]), f"{tmp_path}/png")
    got = files.gray_rasters(spark, f"{tmp_path}/png").first()
    assert (got["height"], got["width"], got["values"]) == (3, 4, values.tolist())
    inside = files.mask_pixels(spark, f"{tmp_path}/png", 3, 4).where(~F.col("inside")).collect()
    assert [(r["x"], r["y"]) for r in inside] == [(0, 0)]
    files.write_files(rows(spark, [("bad.png", b"not an image")]), f"{tmp_path}/bad")
    with pytest.raises(Exception, match="unreadable image"):
        files.gray_rasters(spark, f"{tmp_path}/bad").collect()


def test_move_files(spark, tmp_path):
    folder = f"{tmp_path}/moved"
    files.write_files(rows(spark, [("a", b"a"), ("b", b"b"), ("c", b"c")]), folder)
    plan = lambda *p: spark.createDataFrame(p, "name string, destination string")
    assert files.move_files(plan(("a", "b"), ("b", "a")), folder, f"{tmp_path}/m1") == 2
    assert [open(f"{folder}/{n}").read() for n in "abc"] == ["b", "a", "c"]
    for bad in (plan(("a", "c")), plan(("a", "d"), ("b", "d"))):
        with pytest.raises(FileExistsError):
            files.move_files(bad, folder, f"{tmp_path}/m2", overwrite=True)
    with pytest.raises(FileNotFoundError):
        files.move_files(plan(("z", "y")), folder, f"{tmp_path}/m3")
    assert sorted(n for n in os.listdir(folder) if not n.startswith(".")) == ["a", "b", "c"]
    files.write_files(rows(spark, [("x.png", b"x"), ("Y.JPG", b"y")]), f"{tmp_path}/images")
    found = readers.image_files(spark, f"{tmp_path}/images").withColumn("group", F.lit("desk"))
    assert files.move_files(review.rename_plan(found, "group"), f"{tmp_path}/images", f"{tmp_path}/m4") == 2
    assert sorted(os.listdir(f"{tmp_path}/images")) == ["desk_view_00.png", "desk_view_01.JPG"]


def test_archived_documents(spark, tmp_path):
    docs = rows(spark, [("a/segments.json", b'{"image": "a", "objects": [{"label": "cup"}]}'), ("b/other.json", b'{"image": "b"}'), ("c/segments.json", '{\n "image": "ü"\n}'.encode())])
    files.write_archive(docs, f"{tmp_path}/archive")
    files.write_files(docs, f"{tmp_path}/files")
    assert not any(n.endswith(".json") for n in os.listdir(f"{tmp_path}/archive"))
    got, own = (sorted(map(str, r.collect())) for r in (readers.archived_segments(spark, f"{tmp_path}/archive"), readers.segment_documents(spark, f"{tmp_path}/files")))
    assert got == own and len(got) == 2
    assert {r["file_name"] for r in readers.archived_documents(spark, f"{tmp_path}/archive", readers.DETECTION).collect()} == {"segments.json", "other.json"}
    with pytest.raises(FileExistsError):
        files.write_archive(docs, f"{tmp_path}/archive")
    files.write_archive(rows(spark, [("a.json", b"{")]), f"{tmp_path}/bad")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.archived_documents(spark, f"{tmp_path}/bad", readers.DETECTION).collect()


def test_documents_of_many_images_lie_in_few_files(spark, monkeypatch):
    from scenequery import catalogue
    from scenequery.plans import files as plans
    from scenequery.plans import whole

    made = []
    for module in (plans, whole):
        monkeypatch.setattr(module, "scratch", lambda s, f=plans.scratch: made.append(f(s)) or made[-1])
    for name in ("detection_files", "segment_files", "segment_file_objects"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 1000
        assert sum(len(n) for _, _, n in os.walk(made[-1])) < 100


def test_depth_outputs_take_one_python_worker_a_file(spark):
    rows = [("a.jpg", 2, 2, [0.0, 1.0, 2.0, 4.0]), ("b.png", 2, 2, [float("nan"), float("inf"), 1.0, 3.0]), ("c", 2, 2, [float("-inf"), 5.0, 5.0, 5.0]), ("d", 2, 2, [float("nan")] * 4), ("e", 2, 2, [None, -1.0, 0.0, 1.0])]
    rasters = spark.createDataFrame([(*r, 2, 2) for r in rows], "image string, height int, width int, values array<float>, image_height int, image_width int")
    made = files.depth_outputs(rasters, "m", "f")
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # the files of bytes in one, the documents' rasters in another
    content = {r["name"]: bytes(r["content"]) for r in made.collect()}
    assert len(content) == 15
    shades = {n: zlib.decompress(content[f"{n}_depth.png"].split(b"IDAT")[1][:-16]) for n in "abcde"}
    expected = {"a": [0, 63, 127, 255], "b": [0, 255, 0, 255], "c": [0] * 4, "d": [0] * 4, "e": [0, 0, 127, 255]}
    for n, values in expected.items():
        assert content[f"{n}_depth.png"] == files.png_file(np.array(values, np.uint8).reshape(2, 2), 1) and shades[n]
    assert np.load(io.BytesIO(content["a_depth.npy"])).tolist() == [[0.0, 1.0], [2.0, 4.0]]


def test_many_small_files_are_read_in_few_tasks(spark, tmp_path):
    content = io.BytesIO()
    np.save(content, np.zeros((1, 1), np.float32))
    image = files.png_file(np.zeros((1, 1), np.uint8), 1)
    for i in range(1500):
        (tmp_path / f"{i}.npy").write_bytes(content.getvalue())
        (tmp_path / f"{i}.png").write_bytes(image)
    least = 4 * spark.sparkContext.defaultParallelism
    for read in (readers.npy_rasters, files.gray_rasters):
        found = read(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() <= least and found.count() == 1500
