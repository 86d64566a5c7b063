"""Queries over text payloads, files, inference and overlays."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import geometry as g
from ..operators import infer as i
from ..sources import readers, sinks
from . import Catalogue

catalogue = Catalogue()
query = catalogue.query


_made: list[tuple[str, object]] = []


def scratch(spark) -> str:
    """A new folder for a round trip, in the session's shared one; where that is unset a temporary one in local mode, an error elsewhere. Deleted when the driver's Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"{shared.rstrip('/')}/io-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="scenequery-")
    _made.append((path, spark))
    return path


@atexit.register
def _tidy() -> None:
    for path, spark in _made:
        with contextlib.suppress(Exception):  # the cluster may be gone by now
            sinks.delete(spark, path)


_COLOR = "[80 + CAST('0x' || substr(sha256(t), {a}, 2) AS INTEGER) % 176, 80 + CAST('0x' || substr(sha256(t), {b}, 2) AS INTEGER) % 176, 80 + CAST('0x' || substr(sha256(t), {c}, 2) AS INTEGER) % 176]".format(a=1, b=3, c=5)


@query(f"SELECT t AS label, {_COLOR} AS color FROM (SELECT DISTINCT p_type AS t FROM part)")
def label_colors(spark, d):
    return b.table(spark, d, "part").select(F.col("p_type").alias("label")).distinct().select("label", i.label_color("label").alias("color"))


@query("SELECT page_id, 'data:' || CASE page_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' ELSE 'application/octet-stream' END || ';base64,' || base64(encode(url)) AS data_url FROM pages")
def data_urls(spark, d):
    name = F.when(F.col("page_id") % 3 == 0, "a.PNG").when(F.col("page_id") % 3 == 1, "b.jpg").otherwise("c")
    return b.table(spark, d, "pages").select("page_id", F.regexp_replace(i.data_url(F.encode("url", "UTF-8"), name), r"\s", "").alias("data_url"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || chr(10) || 'end' END AS content FROM events")
def message_content(spark, d):
    one = F.concat(F.lit('{"choices":[{"message":{"content":"'), F.col("event_type"), F.lit('"}}]}'))
    two = F.concat(F.lit('{"choices":[{"message":{"content":[{"text":"'), F.col("event_type"), F.lit('"},{"image":1},{"text":"end"}]}}]}'))
    payload = F.when(F.col("event_id") % 3 == 0, one).when(F.col("event_id") % 3 == 1, two).otherwise('{"error":1}')
    return b.table(spark, d, "events").select("event_id", i.message_content(payload).alias("content"))


@query(f"{b.with_sql('b_questions')} SELECT question_id, track, CASE WHEN question_id % 9 = 0 THEN 'unknown' WHEN list_contains(targets, 'lamp') THEN 'lamp' ELSE 'unknown' END AS prediction, question_id % 9 <> 0 AND list_contains(targets, 'lamp') AND answer = 'lamp' OR question_id % 9 <> 0 AND NOT list_contains(targets, 'lamp') AND answer = 'unknown' AS correct, CASE WHEN question_id % 9 = 0 THEN 'ValueError: empty prompt' END AS error FROM b_questions, (VALUES ('pure_vlm'), ('image_and_geometry')) t(track)")
def run_mock_inference(spark, d):
    prompt = F.when(F.col("question_id") % 9 != 0, F.col("question")).otherwise("")
    rows = b.questions(spark, d).select("*", prompt.alias("prompt"), F.explode(F.array(F.lit("pure_vlm"), F.lit("image_and_geometry"))).alias("track")).drop("image").withColumn("image", F.lit(None).cast("string"))
    return i.local_results(rows, i.MockProvider("It is the Lamp.")).select("question_id", "track", "prediction", "correct", "error")


@query(f"{b.with_sql('b_raw')} SELECT id AS question_id, metric, CASE metric WHEN 'multiple_choice' THEN 'B' WHEN 'numeric_tolerance' THEN '7' ELSE 'option B or 7' END AS prediction, CASE metric WHEN 'multiple_choice' THEN answer = 'B' WHEN 'numeric_tolerance' THEN abs(7 - CAST(answer AS DOUBLE)) <= 0.1::DOUBLE + 1e-12 ELSE false END AS correct, 'parsed' AS parse_status FROM b_raw")
def run_public_inference(spark, d):
    rows = b.raw_answers(spark, d).select(F.col("id").alias("question_id"), F.lit("image_and_geometry").alias("track"), "metric", "answer", "tolerance", F.lit("?").alias("prompt"), F.lit(None).cast("string").alias("image"))
    return i.public_results(rows, i.MockProvider("option B or 7")).select("question_id", "metric", "prediction", "correct", "parse_status")


@query(f"{b.with_sql('b_objects')} SELECT object_id, [CAST(bbox[1] AS INTEGER), CAST(bbox[2] AS INTEGER), CAST(bbox[3] AS INTEGER), CAST(bbox[4] AS INTEGER)] AS box, {_COLOR.replace('(t)', '(label)')} AS color, label || ' ' || format('{{:.2f}}', confidence) AS caption, 0.45::DOUBLE AS alpha FROM b_objects WHERE bbox IS NOT NULL")
def overlay_rows(spark, d):
    boxes = b.objects(spark, d).where("bbox is not null")
    return boxes.select("object_id", g.clamp_bbox("bbox", b.SIDE, b.SIDE).alias("box"), i.label_color("label").alias("color"), F.format_string("%s %.2f", "label", "confidence").alias("caption"), F.lit(0.45).alias("alpha"))


@query(f"{b.with_sql('b_questions')} SELECT question_id, image, targets, answer FROM b_questions")
def scan_jsonl_roundtrip(spark, d):
    path = scratch(spark)
    rows = b.questions(spark, d).select("question_id", "image", "targets", "answer")
    sinks.write_json_lines(rows, f"{path}/q", overwrite=True)
    return readers.json_lines(spark, f"{path}/q", "question_id long, image string, targets array<string>, answer string", strict=True)


@query(f"{b.with_sql('b_review')} SELECT CAST(question_id AS VARCHAR) AS question_id, automatic_split, trim(mask_ok) AS mask_ok, trim(final_split) AS final_split FROM b_review")
def scan_csv_review(spark, d):
    path = scratch(spark)
    columns = ["question_id", "automatic_split", "mask_ok", "final_split"]
    sinks.write_csv(b.review(spark, d).withColumn("mask_ok", F.trim("mask_ok")), f"{path}/r", columns, overwrite=True)
    return readers.csv_rows(spark, f"{path}/r")


@query("SELECT vec_id, CAST(pos - 1 AS INTEGER) % 8 AS x, CAST(pos - 1 AS INTEGER) // 8 AS y, CAST(embedding[pos] AS DOUBLE) AS d FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)")
def raster_roundtrip(spark, d):
    """Rasters as .npy bytes and back."""
    rows = b.table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("values"))
    back = readers.decoded_rasters(sinks.npy_bytes(rows, ["vec_id"]), ["vec_id"])
    return readers.raster_pixels(back, ["vec_id"])


@query("SELECT vec_id, list_sum(list_transform(range(1, 5), lambda i: CAST(embedding[(i - 1) * 16 + 1] AS DOUBLE))) AS first_column FROM embeddings")
def raster_resized(spark, d):
    rows = b.table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("values"))
    small = readers.resized(rows, ["vec_id"], 4, 4)
    return small.select("vec_id", F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.get("values", k * 4).cast("double")), F.lit(0.0), lambda a, x: a + x).alias("first_column"))


catalogue.also_named("_all_images", scan_jsonl_roundtrip)
