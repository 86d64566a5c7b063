"""Queries over images, nested documents and stored files: derived from the tables, written, changed and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.common import rounded
from ..operators import markers as k
from ..operators import pixels as p
from ..operators import prompts as t
from ..operators import review as v
from ..operators import select as s
from ..sources import files, readers, reports, rewrite, sinks
from . import Catalogue, geometry
from .io import scratch
from .public import _REASONS

catalogue = Catalogue()
query = catalogue.query

#: Colours of an image's pixels by the value of their cell, and the background's.
_SHADES = (("red", "v > 0.06", "FF0000"), ("blue", "v < -0.1", "0000FF"), ("green", "v > 0 AND v < 0.05", "008001"))
_GROUND = "BE6946"


def rgb_images(spark, d):
    """question_id, rgb, width, height, depth, depth_width, depth_height, matrix: an image of 32 pixels' width for every 16 vectors, with a depth raster half as fine and four kinds of matrix."""
    vectors = b.table(spark, d, "embeddings").select(F.expr(f"vec_id div {b.PER_IMAGE}").alias("question_id"), "vec_id", "embedding")
    rows = vectors.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("e"))  # 16 vectors at most
    rows = rows.select("question_id", F.transform(F.flatten(F.transform("e", lambda x: x["embedding"])), lambda x: x.cast("double")).alias("values"))

    def shade(x):
        return F.when(x > 0.06, _SHADES[0][2]).when(x < -0.1, _SHADES[1][2]).when((x > 0) & (x < 0.05), _SHADES[2][2]).otherwise(_GROUND)

    n, at = F.size("values"), lambda i: F.get("values", F.lit(i))
    fx, fy, cx, cy, zero, one = at(9) * 800 + 500, at(10) * 800 + 500, at(11) * 10, at(12) * 10, F.lit(0.0), F.lit(1.0)
    three = lambda f: F.array(f, zero, cx, zero, fy, cy, zero, zero, one)
    four = F.array(fx, zero, cx, zero, zero, fy, cy, zero, zero, zero, one, zero, zero, zero, zero, one)
    kind = F.col("question_id") % 4
    return rows.select(
        "question_id", F.unhex(F.array_join(F.transform("values", shade), "")).alias("rgb"), F.lit(32).alias("width"), F.expr("size(values) div 32").alias("height"),
        F.transform(F.slice("values", 1, F.expr("size(values) div 4").cast("int")), lambda x: (x - 0.19) * 40).alias("depth"), F.lit(16).alias("depth_width"), F.expr("size(values) div 64").alias("depth_height"),
        F.when(kind == 0, three(zero)).when(kind == 1, four).when(kind == 2, three(fx)).alias("matrix"), n.alias("n"),
    )


_PX = f"""vv AS (SELECT vec_id // {b.PER_IMAGE} AS img, row_number() OVER (PARTITION BY vec_id // {b.PER_IMAGE} ORDER BY vec_id) - 1 AS k, embedding FROM embeddings),
px AS (SELECT img, k * 64 + pos - 1 AS cell, CAST(embedding[pos] AS DOUBLE) AS v FROM vv, (SELECT unnest(range(1, 65)) AS pos)),
sz AS (SELECT img, 32 AS w, count(*) // 32 AS h, 16 AS dw, count(*) // 64 AS dh, CASE WHEN img % 4 IN (1, 2) THEN max(v) FILTER (WHERE cell = 9) * 800 + 500 END AS fx, max(v) FILTER (WHERE cell = 10) * 800 + 500 AS fy, max(v) FILTER (WHERE cell = 11) * 10 AS cx, max(v) FILTER (WHERE cell = 12) * 10 AS cy FROM px GROUP BY img)"""
_CASES = " ".join(f"WHEN {test} THEN '{color}'" for color, test, _ in _SHADES)
_MARKS = f"""{_PX}, cl AS (SELECT * FROM (SELECT img, cell, cell % 32 AS x, CASE {_CASES} END AS color FROM px) WHERE color IS NOT NULL),
nb AS (SELECT a.img, a.color, a.cell, c.cell AS beside FROM (SELECT cl.*, cell + off AS b FROM cl, (VALUES (-33), (-32), (-31), (-1), (1), (31), (32), (33)) o(off)) a JOIN cl c ON c.img = a.img AND c.color = a.color AND c.cell = a.b AND abs(c.x - a.x) <= 1),
reach AS (SELECT img, color, cell AS root, cell FROM cl ANTI JOIN (SELECT * FROM nb WHERE beside < cell) USING (img, color, cell) UNION SELECT r.img, r.color, r.root, nb.beside FROM reach r JOIN nb ON nb.img = r.img AND nb.color = r.color AND nb.cell = r.cell AND nb.beside > r.root),
pt AS (SELECT img, color, cell, min(root) AS part FROM reach GROUP BY ALL),
bg AS (SELECT img, color, part FROM (SELECT img, color, part, row_number() OVER (PARTITION BY img, color ORDER BY count(*) DESC, part) AS r FROM pt GROUP BY img, color, part) WHERE r = 1),
mk AS (SELECT img, color, count(*) AS n, min(cell % 32) AS x0, min(cell // 32) AS y0, max(cell % 32) AS x1, max(cell // 32) AS y1, quantile_cont(cell % 32, 0.5) AS mx, quantile_cont(cell // 32, 0.5) AS my FROM pt JOIN bg USING (img, color, part) GROUP BY img, color),
ct AS (SELECT *, (x0 + x1) / 2 * dw / w AS dx, (y0 + y1) / 2 * dh / h AS dy FROM mk JOIN sz USING (img)),
nr AS (SELECT ct.img, ct.color, greatest(abs(px.cell % 16 - round_even(dx, 0)), abs(px.cell // 16 - round_even(dy, 0))) AS away, (v - 0.19) * 40 AS d FROM ct JOIN px ON px.img = ct.img AND px.cell < dw * dh),
sm AS (SELECT img, color, count(*) FILTER (away <= 1) AS n1, median(d) FILTER (away <= 1) AS m1, count(*) AS n3, median(d) AS m3 FROM nr WHERE d > 0 AND away <= 3 GROUP BY ALL),
marks AS (SELECT ct.img AS question_id, ct.color, [round((x0 + x1) / 2, 3), round((y0 + y1) / 2, 3)] AS pixel_xy, [round(mx, 3), round(my, 3)] AS visible_pixel_median_xy, [CAST(x0 AS INTEGER), CAST(y0 AS INTEGER), CAST(x1 AS INTEGER), CAST(y1 AS INTEGER)] AS pixel_bbox,
  [round(dx, 3), round(dy, 3)] AS depth_pixel_xy, n AS marker_pixel_count, CASE WHEN n1 > 0 THEN n1 ELSE n3 END AS depth_sample_count, round(CASE WHEN n1 > 0 THEN m1 ELSE m3 END, 6) AS depth, fx, fy, cx, cy, dx, dy FROM ct JOIN sm USING (img, color)),
done AS (SELECT *, CASE WHEN fx IS NOT NULL THEN [round((dx - cx) * depth / fx, 6), round((dy - cy) * depth / fy, 6), round(depth, 6)] END AS camera_xyz FROM marks)"""


@query(f"WITH RECURSIVE {_MARKS} SELECT question_id, color, pixel_xy, visible_pixel_median_xy, pixel_bbox, depth_pixel_xy, marker_pixel_count, depth_sample_count, depth, camera_xyz, 'dataset_native' AS unit FROM done")
def marker_geometry_rgb(spark, d):
    """Markers of RGB images with their depth and coordinates; colours without a depth are left out."""
    return k.marker_geometry(rgb_images(spark, d), ["question_id"])


def _documents(spark, d):
    """Stored documents of one view each; in every third the boxes are missing and centres and coordinates wrong."""
    images, found = rgb_images(spark, d), marker_geometry_rgb(spark, d)
    names = ("color", "pixel_xy", "visible_pixel_median_xy", "pixel_bbox", "depth_pixel_xy", "depth", "camera_xyz")
    whole = F.struct(*names)
    spoilt = whole.withField("pixel_bbox", F.lit(None).cast("array<int>")).withField("pixel_xy", F.array(F.lit(0.0), F.lit(0.0))).withField("camera_xyz", F.lit(None).cast("array<double>"))
    held = found.groupBy("question_id").agg(F.sort_array(F.collect_list(F.when(F.col("question_id") % 3 == 0, spoilt).otherwise(whole))).alias("markers"))
    rows = images.join(held, "question_id", "left").withColumn("markers", F.coalesce("markers", F.array().cast(held.schema["markers"].dataType)))
    view = F.struct("width", "height", "depth_width", "depth_height", "matrix", "markers", k.relations_of(F.col("markers")).alias("relations"))
    return rows.select("question_id", (F.col("question_id") % 5).cast("int").alias("part"), F.array(view).alias("views"))


@query(f"""WITH RECURSIVE {_MARKS}, bad AS (SELECT count(DISTINCT question_id) AS first_run FROM done WHERE question_id % 3 = 0)
  SELECT question_id, color, pixel_bbox, pixel_xy, depth_pixel_xy, camera_xyz, first_run, 0::BIGINT AS second_run FROM done, bad""")
def repaired_documents(spark, d):
    """Documents repaired in place from their images, twice: the markers then stored, and how many documents each run changed."""
    path = f"{scratch(spark)}/documents"
    _documents(spark, d).write.partitionBy("part").parquet(path)
    found = marker_geometry_rgb(spark, d).withColumn("view", F.lit(0))
    runs = [rewrite.rewrite_changed(spark, path, "part", lambda rows: k.repaired_views(rows, found)) for _ in range(2)]
    stored = spark.read.parquet(path).select("question_id", F.explode(F.col("views")[0]["markers"]).alias("m"))
    return stored.select("question_id", "m.color", "m.pixel_bbox", "m.pixel_xy", "m.depth_pixel_xy", "m.camera_xyz", *[F.lit(n).cast("long").alias(f"{name}_run") for name, n in zip(("first", "second"), runs)])


_SPOKEN = (
    '{"note": "the \\"answer\\": x"}', '{"\\u0061nswer": 1}', '{"a": [{"b": {"My_GOLD": 1}}, 2]}', '["b", ": answer", {"c": "gold"}]', '{"x\\\\": "answer", "y": {"Correct_Label": null}}', '{"a": {"b": [[{"c": "\\\\"}]]}}',
)
_SPOKEN_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{j}'" for i, j in enumerate(_SPOKEN)) + " ELSE props END"


@query(f"SELECT event_id, (SELECT count(*) FROM json_tree(j) WHERE key IS NOT NULL AND regexp_matches(lower(CAST(json_extract_string(json_array(key), '$[0]') AS VARCHAR)), 'answer|gold|correct_label')) > 0 AS leak FROM (SELECT event_id, {_SPOKEN_SQL} AS j FROM events)")
def geometry_leaks_nested(spark, d):
    """Keys at any depth, written with escapes, against values that look like keys."""
    text = b.pick_when(F.col("event_id") % 7, [F.lit(x) for x in _SPOKEN])
    return b.table(spark, d, "events").select("event_id", t.key_leaks(F.when(F.col("event_id") % 7 < len(_SPOKEN), text).otherwise(F.col("props"))).alias("leak"))


@query("""SELECT '{"id":' || vec_id || ',"view":{"depth":' || x || ',"more":[' || CASE WHEN vec_id % 2 = 0 THEN 'null,' ELSE '0.5,' END || x || ']},"by_color":{"red":' || x || '},"points":[{"z":' || x || '}],"none":null}' AS value
  FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'null' ELSE (vec_id % 1000) || '.25' END AS x FROM embeddings)""")
def json_safe_nested(spark, d):
    """Lines written of rows whose structs, lists and maps hold NaN and infinities."""
    n, path = F.col("vec_id"), f"{scratch(spark)}/lines"
    x = F.when(n % 3 == 0, F.when(n % 2 == 0, float("nan")).otherwise(float("-inf"))).otherwise(n % 1000 + 0.25)
    more = F.array(F.when(n % 2 == 0, float("inf")).otherwise(0.5), x)
    rows = b.table(spark, d, "embeddings").select(n.alias("id"), F.struct(x.alias("depth"), more.alias("more")).alias("view"), F.create_map(F.lit("red"), x).alias("by_color"), F.array(F.struct(x.alias("z"))).alias("points"), F.lit(None).cast("struct<a:double>").alias("none"))
    sinks.write_json_lines(rows, path)
    return spark.read.text(path)


_QUESTION_TEXTS = (
    '{"question_id": "q~", "image": "a.jpg", "question": "w", "type": "left_right", "target_objects": ["a"], "answer": "b", "evaluation": {"metric": "exact_match"}}',
    '{"question_id": "q~", "image": "a.jpg", "question": "w", "type": "sideways", "target_objects": [], "answer": null, "evaluation": null}',
    '"text"',
    '{"question_id": 7, "type": null, "target_objects": ["a", 1], "evaluation": []}',
    '{"question_id": "q~", "type": 3, "target_objects": "a", "evaluation": {"metric": [1]}, "note": {"type": "x"}}',
    "[1, 2]",
    "{}",
    "null",
)
_DOCUMENT_SQL = f"""docs AS (SELECT 'c' || c_custkey || '.json' AS file_name, CASE WHEN c_custkey % 11 = 0 THEN '{{"questions": 5}}' WHEN c_custkey % 13 = 0 THEN '[1]' WHEN c_custkey % 17 = 0 THEN '{{"questions": [' WHEN c_custkey % 19 = 0 THEN '{{"questions": null}}'
  ELSE '{{"questions": [' || replace(array_to_string([{', '.join("'" + q + "'" for q in _QUESTION_TEXTS)}][CAST(1 + c_custkey % 5 AS INTEGER):CAST(3 + c_custkey % 5 + c_custkey % 4 AS INTEGER)], ', '), '~', CAST(c_custkey AS VARCHAR)) || ']}}' END AS value FROM customer)"""
_ALLOWED = ", ".join(v.QUESTION_TYPES)


@query(f"""WITH {_DOCUMENT_SQL}, ok AS (SELECT *, json_valid(value) AS fine, CASE WHEN json_valid(value) THEN json_type(value, '$.questions') END AS kind FROM docs),
q AS (SELECT file_name, CAST(i - 1 AS INTEGER) AS pos, json_extract(value, '$.questions[' || (i - 1) || ']') AS q FROM (SELECT file_name, value, unnest(range(1, CAST(json_array_length(value, '$.questions') AS BIGINT) + 1)) AS i FROM ok WHERE kind = 'ARRAY')),
r AS (SELECT *, json_type(q) = 'OBJECT' AS is_object, CASE WHEN json_type(q, '$.question_id') = 'VARCHAR' THEN json_extract_string(q, '$.question_id') END AS id FROM q),
n AS (SELECT *, CASE WHEN id IS NOT NULL THEN row_number() OVER (PARTITION BY file_name, id ORDER BY pos) END AS nth FROM r),
e AS (SELECT file_name, -1 AS pos, 0 AS place, CASE WHEN NOT fine THEN 'document is not JSON' WHEN kind IS NULL OR kind <> 'ARRAY' THEN 'top-level field ''questions'' must be a list' END AS error FROM ok
  UNION ALL SELECT file_name, pos, 0, 'questions[' || pos || '] must be an object' FROM n WHERE NOT is_object
  UNION ALL SELECT file_name, pos, place - 1, CASE WHEN json_type(q, '$.' || field) IS NULL THEN 'questions[' || pos || '] missing required field: ' || field END FROM n, (SELECT unnest({list(v.QUESTION_FIELDS)}) AS field, unnest(range(1, 8)) AS place) WHERE is_object
  UNION ALL SELECT file_name, pos, 7, CASE WHEN nth > 1 THEN 'questions[' || pos || '] duplicate question_id: ' || id END FROM n WHERE is_object
  UNION ALL SELECT file_name, pos, 8, CASE WHEN json_type(q, '$.type') <> 'NULL' AND NOT (json_type(q, '$.type') = 'VARCHAR' AND list_contains({list(v.QUESTION_TYPES)}, json_extract_string(q, '$.type'))) THEN 'questions[' || pos || '] unknown type: ' || json_extract_string(q, '$.type') || '. Allowed: {_ALLOWED}' END FROM n WHERE is_object
  UNION ALL SELECT file_name, pos, 9, CASE WHEN json_type(q, '$.target_objects') <> 'NULL' AND NOT (json_type(q, '$.target_objects') = 'ARRAY' AND len(list_filter(json_type(q, '$.target_objects[*]'), lambda x: x <> 'VARCHAR')) = 0) THEN 'questions[' || pos || '] target_objects must be a list of strings' END FROM n WHERE is_object
  UNION ALL SELECT file_name, pos, 10, CASE WHEN json_type(q, '$.evaluation') NOT IN ('NULL', 'OBJECT') THEN 'questions[' || pos || '] evaluation must be an object' END FROM n WHERE is_object)
SELECT file_name, CAST(pos AS INTEGER) AS pos, CAST(place AS INTEGER) AS place, error FROM e WHERE error IS NOT NULL""")
def question_document_errors(spark, d):
    """Every kind of error in documents of whatever types."""
    c = F.col("c_custkey")
    texts = F.slice(F.array(*map(F.lit, _QUESTION_TEXTS)), (c % 5 + 1).cast("int"), (c % 4 + 3).cast("int"))
    whole = F.concat(F.lit('{"questions": ['), F.replace(F.array_join(texts, ", "), F.lit("~"), c.cast("string")), F.lit("]}"))
    value = F.when(c % 11 == 0, '{"questions": 5}').when(c % 13 == 0, "[1]").when(c % 17 == 0, '{"questions": [').when(c % 19 == 0, '{"questions": null}').otherwise(whole)
    return v.document_errors(b.table(spark, d, "customer").select(F.concat(F.lit("c"), c.cast("string"), F.lit(".json")).alias("file_name"), value.alias("value")))


@query("""SELECT 's' || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.bmp' WHEN 3 THEN '.jpeg' ELSE '.png' END AS name, CASE WHEN s_suppkey % 5 < 4 THEN CAST(s_suppkey + 1 AS INTEGER) END AS width,
  CASE WHEN s_suppkey % 5 < 4 THEN CAST(2 * s_suppkey + 1 AS INTEGER) END AS height, s_suppkey % 5 < 4 AS valid FROM supplier""")
def image_header_sizes(spark, d):
    """Sizes of PNG, JPEG and BMP files by their headers; one that has none is told."""
    n, path = F.col("s_suppkey"), f"{scratch(spark)}/images"
    number = lambda x, size: F.lpad(F.hex(x.cast("long")), 2 * size, "0")
    little = lambda x: F.concat(*[F.substring(number(x, 4), i, 2) for i in (7, 5, 3, 1)])
    width, height = n + 1, 2 * n + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(width, 4), number(height, 4), F.lit("0802000000"))
    # before the frame: a segment for applications, a table whose bytes look like a frame's marker, a filling byte
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFDB0006AAFFC0AAFFFFC40004FFC0"), F.lit("FFC0001108"), number(height, 2), number(width, 2), F.lit("03012200021101031101FFDA"))
    bmp = F.concat(F.lit("424D46000000000000003600000028000000"), little(width), F.when(n % 2 == 0, little(height)).otherwise(little((F.lit(1 << 32) - height))), F.lit("010018000000"))
    # a JPEG has no room for sides from 65536 on; such an image is a PNG, whatever its name, as kinds are told by their bytes
    content = F.when((n % 5 == 0) | (n % 5).isin(1, 3) & (height > 0xFFFF), png).when(n % 5 == 2, bmp).when(n % 5 == 4, "89504E470D0A1A0A00").otherwise(jpeg)
    suffix = b.pick((".png", ".JPG", ".bmp", ".jpeg", ".png"), n % 5)
    rows = b.table(spark, d, "supplier").select(F.concat(F.lit("s"), n.cast("string"), suffix).alias("name"), F.unhex(content).alias("content"))
    files.write_files(rows, path)
    return readers.image_sizes(spark, path)


@query("""SELECT s_suppkey AS object_id, CASE s_suppkey % 4 WHEN 0 THEN '/data/m' || s_suppkey || '.png' WHEN 1 THEN 'ROOT/masks/m' || s_suppkey || '.png' WHEN 2 THEN 'ROOT/scene/m' || s_suppkey || '.png' ELSE 'ROOT/masks/m' || s_suppkey || '.png' END AS mask_file, s_suppkey % 4 IN (1, 2) AS mask_there FROM supplier""")
def mask_paths_resolved(spark, d):
    """Where the masks of segments lie: as written if absolute, under the root, or beside their document; masks that are nowhere are told by their first place."""
    n, root = F.col("s_suppkey"), f"{scratch(spark)}/root"
    name = F.concat(F.lit("m"), n.cast("string"), F.lit(".png"))
    rows = b.table(spark, d, "supplier")
    there = rows.where(n % 4 == 1).select(F.concat(F.lit("masks/"), name).alias("name")).unionByName(rows.where(n % 4 == 2).select(F.concat(F.lit("scene/"), name).alias("name")))
    files.write_files(there.withColumn("content", F.encode(F.lit("mask"), "UTF-8")), root)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^[a-z]+:/*", "/").alias("path"))
    plain = F.lit(root.split(":", 1)[-1] if "://" in root else root)
    base = F.regexp_replace(plain, "^/*", "/")
    written = F.when(n % 4 == 0, F.concat(F.lit("/data/"), name)).when(n % 2 == 1, F.concat(F.lit("masks\\"), name)).otherwise(F.concat(F.lit("masks/"), name))
    segments = rows.select(n.alias("object_id"), written.alias("mask_path"), F.concat(base, F.lit("/scene/segments.json")).alias("segments_path"))
    found = readers.resolved_mask_paths(segments, listing, root if "://" not in root else "/" + root.split("://", 1)[1].lstrip("/"))
    return found.select("object_id", F.replace("mask_file", base, F.lit("ROOT")).alias("mask_file"), "mask_there")


@query(f"WITH {_PX} SELECT img AS question_id, CAST(w AS INTEGER) AS width, CAST(h AS INTEGER) AS height, sha256(unhex(string_agg(CASE {' '.join(f'WHEN {test} THEN {chr(39)}{code}{chr(39)}' for _, test, code in _SHADES)} ELSE '{_GROUND}' END, '' ORDER BY cell))) AS pixels FROM px JOIN sz USING (img) GROUP BY ALL")
def rgb_exports(spark, d):
    """Images exported as RGB files, and their pixels read again."""
    path = scratch(spark)
    stored = files.rgb_png_bytes(rgb_images(spark, d), ["question_id"]).select("question_id", F.array("content").alias("images"))
    files.export_images(stored, f"{path}/images", f"{path}/aside")
    back = files.color_rasters(spark, f"{path}/images")
    return back.select(F.regexp_extract("name", r"^(\d+)_view_00\.png$", 1).cast("long").alias("question_id"), "width", "height", F.sha2("rgb", 256).alias("pixels"))


def _fails(rows, path, overwrite):
    raise OSError(f"no room for {path}")


@query("SELECT name, n, 0::BIGINT AS left_by_failure FROM (SELECT 'answers' AS name, count(*) AS n FROM orders UNION ALL SELECT 'by_status', count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'sheet.csv', count(*) FROM orders)")
def outputs_as_one(spark, d):
    """Three outputs of which the third fails, and then doesn't: what is left after the failure, and the rows of each output at last."""
    folder, rows = f"{scratch(spark)}/out", b.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    counts = rows.groupBy("o_orderstatus").count()
    outputs = {"answers": (rows, sinks.write_json_lines), "by_status": (counts, sinks.write_json), "sheet.csv": (rows, _fails)}
    try:
        reports.write_all(spark, folder, outputs)
    except OSError:
        left = len(sinks.listed(spark, folder))
    reports.write_all(spark, folder, outputs | {"sheet.csv": (rows, lambda r, path, o: sinks.write_csv(r, path, ["o_orderkey", "o_orderstatus"], o))})
    sizes = [(n, x) for n, x in (("answers", readers.json_lines(spark, f"{folder}/answers", "o_orderkey long")), ("by_status", spark.read.text(f"{folder}/by_status", wholetext=False).where("value like '%o_orderstatus%'")), ("sheet.csv", readers.csv_rows(spark, f"{folder}/sheet.csv")))]
    out = None
    for name, x in sizes:
        one = x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n", F.lit(left).cast("long").alias("left_by_failure"))
        out = one if out is None else out.unionByName(one)
    return out


@query(geometry.catalogue.sql["depth_stats"])
def depth_stats_selected(spark, d):
    """The depths' statistics by distributed selection of their quantiles."""
    return p.depth_stats_large(b.pixels(spark, d), ["image", "object_id"], F.col("d") > 0)


@query("SELECT id, CAST(printf('%.6f', x) AS DOUBLE) AS six FROM (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN (2 * o_orderkey + 1) / 2000000 WHEN 1 THEN -(2 * o_orderkey + 1) / 2000000 WHEN 2 THEN o_totalprice * 1.000000000001 ELSE 2.6750005::DOUBLE + o_orderkey END AS x FROM orders)")
def rounded_halves(spark, d):
    """Numbers whose decimals end in a 5 behind the sixth place, rounded as their binary values lie."""
    n = F.col("o_orderkey")
    half = (n * 2 + 1) / 2000000
    x = F.when(n % 4 == 0, half).when(n % 4 == 1, -half).when(n % 4 == 2, F.col("o_totalprice") * 1.000000000001).otherwise(n + 2.6750005)
    return b.table(spark, d, "orders").select(n.alias("id"), rounded(x).alias("six"))


_LEAKY = "[{'k': 'pure_vlm', 'v': CASE id % 6 WHEN 0 THEN 'The Gold  Answer : ' || raw WHEN 1 THEN 'answer: ' || raw WHEN 2 THEN chr(10) || 'correct answer:' WHEN 3 THEN 'Is this the correct answer? ' || raw WHEN 4 THEN 'x: reference' || chr(10) || 'answer: y' ELSE raw END}, {'k': 'geometry_only', 'v': raw}]"


@query(f"""{b.with_sql('b_raw')}, p AS (SELECT id, CASE WHEN id % 7 = 0 THEN ' ' WHEN id % 11 = 0 THEN NULL ELSE answer END AS answer, {_LEAKY} AS prompts FROM b_raw)
  SELECT id, coalesce(trim(answer) <> '', true) AND len(list_filter(prompts, lambda x: regexp_matches(lower(x.v), '(gold|correct|reference)\\s+answer\\s*:'))) > 0 AS leak FROM p""")
def prompt_leaks_given(spark, d):
    """Prompts that label the gold answer, that only speak of one, and rows without an answer."""
    n, raw = F.col("id"), F.col("raw")
    spoken = b.pick_when(n % 6, [F.concat(F.lit("The Gold  Answer : "), raw), F.concat(F.lit("answer: "), raw), F.lit("\ncorrect answer:"), F.concat(F.lit("Is this the correct answer? "), raw), F.lit("x: reference\nanswer: y"), raw])
    answer = F.when(n % 7 == 0, " ").when(n % 11 != 0, F.col("answer"))
    return b.raw_answers(spark, d).select(n, t.prompt_leaks(F.create_map(F.lit("pure_vlm"), spoken, F.lit("geometry_only"), raw), answer).alias("leak"))


_REPEATS = f"""{b.with_sql('b_source')}, src AS (SELECT row_number() OVER () AS rid, CASE WHEN id::BIGINT % 10 = 3 THEN NULL WHEN id::BIGINT % 4 = 1 THEN CAST(id::BIGINT // 5 AS VARCHAR) ELSE id END AS id, img_type, format_type, task, question, answer, has_image
  FROM b_source, (SELECT unnest(range(0, 2)) AS copy) WHERE copy = 0 OR id::BIGINT % 6 = 0)"""


def _repeats_sql(limit: int) -> str:
    return f"""{_REPEATS}, judged AS (SELECT *, {_REASONS} AS reasons, row_number() OVER (ORDER BY CASE format_type WHEN 'select' THEN 0 WHEN 'fill' THEN 1 ELSE 2 END, try_cast(id AS BIGINT) IS NULL, try_cast(id AS BIGINT), coalesce(id, 'unknown'), answer, task, question) AS place FROM src),
able AS (SELECT *, row_number() OVER (PARTITION BY lower(task) ORDER BY place) AS rk FROM judged WHERE len(reasons) = 0),
run AS (SELECT *, sum(CASE WHEN rk <= 20 THEN 1 ELSE 0 END) OVER (ORDER BY place) AS upto FROM able),
done AS (SELECT rid, CASE WHEN rk <= 20 AND upto <= {limit} THEN [] WHEN upto - CASE WHEN rk <= 20 THEN 1 ELSE 0 END >= {limit} THEN ['phase_limit'] ELSE ['per_task_limit'] END AS why, rk <= 20 AND upto <= {limit} AS selected FROM run)
SELECT j.id, j.task, j.answer, coalesce(d.selected, false) AS selected, CASE WHEN d.rid IS NULL THEN j.reasons ELSE d.why END AS reasons FROM judged j LEFT JOIN done d USING (rid)"""


@query(_repeats_sql(150))
def selection_of_repeats(spark, d):
    """A capped selection of rows of which some repeat ids, some have none, and some are whole copies."""
    n = F.col("id").cast("long")
    rows = b.sources(spark, d, b.no_question()).withColumn("_copy", F.explode(F.when(n % 6 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy")
    rows = rows.withColumn("id", F.when(n % 10 == 3, F.lit(None).cast("string")).when(n % 4 == 1, F.expr("cast(cast(id as long) div 5 as string)")).otherwise(F.col("id")))
    return s.select_rows(rows, "b", tie=F.struct("answer", "task", "question"), missing="no_question").select("id", "task", "answer", "selected", "reasons")
