"""Queries over awkward inputs, joins with wide rows, inspection and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.common import merged, rounded_away
from ..operators import answers as a
from ..operators import audit as u
from ..operators import geometry as g
from ..operators import metrics as m
from ..operators import pixels as p
from ..operators import prompts as t
from ..operators import review as v
from ..operators import select as s
from ..operators.decide import rule_answers
from ..sources import readers, sinks
from . import Catalogue
from .answers import _LAST, RULES_SQL
from .geometry import GEOMETRY_SQL, object_geometry
from .io import scratch
from .metrics import _CLEAN, _FAILED, _SPLIT
from .metrics import rules as answered
from .public import _STATUS, _phase, _six

catalogue = Catalogue()
query = catalogue.query


# rules over any number of targets


def many_targets(spark, d):
    """Size and support questions with none to four targets, over all images."""
    k, c = F.col("question_id"), F.length("question")
    names = F.array(*[b.pick(b.LABELS, (k + i * (1 + k % 2)) % 5) for i in range(4)])
    rows = b.questions(spark, d).withColumn("type", F.when(k % 2 == 0, "physical_size").otherwise("support_relation"))
    return rows.withColumn("targets", F.slice(names, 1, ((k + c) % 5).cast("int")))


_MANY = f"""mt AS (SELECT question_id, image, CASE WHEN question_id % 2 = 0 THEN 'physical_size' ELSE 'support_relation' END AS type,
  list_slice([{', '.join(b._pick(b.LABELS, f'(question_id + {i} * (1 + question_id % 2)) % 5') for i in range(4))}], 1, (question_id + length(question)) % 5) AS targets FROM b_questions)"""


@query(f"""{GEOMETRY_SQL}, b_questions AS ({b.SQL['b_questions']}), {_LAST}, {_MANY},
  sh AS (SELECT image, list(label ORDER BY f) AS labels FROM (SELECT image, label, min(ord) AS f FROM b_objects GROUP BY ALL) GROUP BY image),
  c0 AS (SELECT question_id, image, type, targets, len(list_filter(targets, lambda x: NOT coalesce(list_contains(labels, x), false))) > 0 AS lacks, CASE WHEN len(targets) > 0 THEN targets ELSE coalesce(labels, []) END AS cand FROM mt LEFT JOIN sh USING (image)),
  c1 AS (SELECT question_id, image, type, unnest(cand) AS label, generate_subscripts(cand, 1) AS pos FROM c0),
  c2 AS (SELECT question_id, type, pos, label, CASE type WHEN 'physical_size' THEN mask_area_fraction ELSE least(coalesce(mask_area_fraction, 0) * 4.0::DOUBLE, 1.0::DOUBLE) + CASE WHEN vertical_position IN ('middle', 'bottom') THEN 0.5 ELSE 0 END + CASE WHEN depth_order_hint IN ('middle', 'near') THEN 0.25 ELSE 0 END END AS score
    FROM c1 JOIN q_last USING (image, label)),
  c3 AS (SELECT question_id, label FROM c2 WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos) = 1)
  SELECT question_id, type, targets, CASE WHEN lacks OR (type = 'physical_size' AND len(targets) < 2) THEN 'unknown' ELSE coalesce(label, 'unknown') END AS prediction,
    CASE WHEN lacks THEN 'none' WHEN type = 'support_relation' THEN 'support_heuristic' WHEN len(targets) >= 2 THEN 'mask_area_fraction' ELSE 'insufficient_target_objects' END AS source FROM c0 LEFT JOIN c3 USING (question_id)""")
def rules_of_many_targets(spark, d):
    geometry = object_geometry(spark, d)
    found = rule_answers(many_targets(spark, d), geometry, g.pairwise_relations(geometry, b.SIDE, b.SIDE))
    return found.select("question_id", "type", "targets", "prediction", "source")


# results, selections and questions with gaps and repeats


def _uneven(spark, d):
    """Results with tracks repeated and left out: three rows that aren't three tracks."""
    k, track = F.col("question_id"), F.col("track")
    return b.results(spark, d).withColumn("track", F.when((k % 5 == 0) & (track == "geometry_only"), "pure_vlm").when((k % 7 == 0) & (track == "image_and_geometry"), "other").otherwise(track))


@query(f"""{b.with_sql('b_results')}, un AS (SELECT * REPLACE (CASE WHEN question_id % 5 = 0 AND track = 'geometry_only' THEN 'pure_vlm' WHEN question_id % 7 = 0 AND track = 'image_and_geometry' THEN 'other' ELSE track END AS track) FROM b_results)
  SELECT question_id, count(*) = 3 AND count(*) FILTER (track = 'pure_vlm') = 1 AND count(*) FILTER (track = 'geometry_only') = 1 AND count(*) FILTER (track = 'image_and_geometry') = 1 AS complete FROM un GROUP BY question_id""")
def track_alignment_of_repeats(spark, d):
    return m.aligned(_uneven(spark, d), b.TRACKS).select("question_id", "complete")


@query(f"{_phase(150).replace('rk <= 20', 'true')} SELECT id, selected, reasons FROM sel")
def selection_uncapped_whole(spark, d):
    """The second phase without a limit by task."""
    return s.select_rows(b.sources(spark, d), "b", s.Selection(per_task_limit=None)).select("id", "selected", "reasons")


@query("""WITH br AS (SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey // 4 END AS question_id, CASE WHEN o_orderkey % 6 = 0 THEN 'guess' ELSE 'left_right' END AS type FROM orders)
  SELECT pos, 'missing_field' AS code, 'question_id' AS detail FROM br WHERE question_id IS NULL UNION ALL SELECT pos, 'unknown_type', type FROM br WHERE type = 'guess'
  UNION ALL SELECT pos, 'duplicate_question_id', CAST(question_id AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS n FROM br WHERE question_id IS NOT NULL) WHERE n > 1""")
def question_errors_without_ids(spark, d):
    k, text = F.col("o_orderkey"), F.lit("x")
    rows = b.table(spark, d, "orders").select(k.alias("pos"), F.when(k % 3 != 0, F.expr("o_orderkey div 4")).alias("question_id"), F.when(k % 6 == 0, "guess").otherwise("left_right").alias("type"), *[text.alias(c) for c in ("answer", "evaluation", "image", "question", "target_objects")])
    return v.question_errors(rows)


@query("SELECT n_name AS file_name, unnest(list_filter([CASE WHEN n_nationkey % 4 = 0 THEN 'top-level field ''scene_group'' must be a string' END, CASE WHEN n_nationkey % 3 <> 1 THEN 'top-level field ''templates'' must be a non-empty list' END], lambda e: e IS NOT NULL)) AS error FROM nation")
def template_document_errors(spark, d):
    k = F.col("n_nationkey")
    templates = F.when(k % 3 == 1, F.array(F.lit("where?"))).when(k % 3 == 2, F.array().cast("array<string>"))
    return v.template_document_errors(b.table(spark, d, "nation").select(F.col("n_name").alias("file_name"), F.when(k % 4 != 0, "desk").alias("scene_group"), templates.alias("templates")))


# joins


@query(f"""{b.with_sql('b_source')}, src AS (SELECT *, CAST(id AS BIGINT) // 2 AS half FROM b_source), last AS (SELECT half, arg_max(id, CAST(id AS BIGINT)) AS id, arg_max(task, CAST(id AS BIGINT)) AS task FROM src GROUP BY half)
  SELECT half AS question_id, id AS source_row, task FROM last""")
def source_join(spark, d):
    """Every question with its source row, the last of two that share its id."""
    rows = b.sources(spark, d).withColumn("half", F.expr("cast(id as bigint) div 2")).withColumn("at", F.col("id").cast("long"))
    asked = rows.select(F.col("half").alias("question_id"), F.col("half").alias("source_id")).distinct()
    return v.with_source(asked, rows, "half", "at").select("question_id", F.col("source.id").alias("source_row"), "source.task")


@query(f"{_phase(150)} SELECT CAST(sel.id AS BIGINT) AS doc_id, documents.text, documents.n_chars FROM sel JOIN documents ON CAST(sel.id AS BIGINT) = doc_id WHERE selected")
def selected_wide_rows(spark, d):
    """The selected rows with all their columns; the selection reads what it needs."""
    chosen = s.select_rows(b.sources(spark, d), "b").withColumn("doc_id", F.col("id").cast("long"))
    return s.selected_rows(b.table(spark, d, "documents"), chosen, "doc_id").select("doc_id", "text", "n_chars")


@query(f"{b.with_sql('b_review')}, b_questions AS ({b.SQL['b_questions']}) SELECT count(*) AS before, count(*) FILTER (question_id IN (SELECT question_id FROM b_review WHERE {_CLEAN})) AS after FROM b_questions")
def clean_question_counts(spark, d):
    return v.kept_counts(b.questions(spark, d), b.review(spark, d).where(v.is_clean()))


@query(f"{RULES_SQL} SELECT CAST(question_id AS VARCHAR) AS question_id, {_SPLIT} AS automatic_split FROM q_rules")
def evaluation_split_rows(spark, d):
    return v.split_lists(answered(spark, d))


@query(f"""{_FAILED} SELECT f.image, CAST(f.missing_record_count AS VARCHAR) AS missing_record_count, l.missing_labels, f.question_ids FROM (SELECT image, count(*) AS missing_record_count, string_agg(question_id, ';' ORDER BY question_id) AS question_ids FROM failed GROUP BY image) f
  LEFT JOIN (SELECT image, string_agg(label || ':' || n, ';' ORDER BY n DESC, label) AS missing_labels FROM cnt GROUP BY image) l USING (image)""")
def failure_csv(spark, d):
    """Failures by image, written as CSV and read again."""
    path = f"{scratch(spark)}/f"
    columns = ["image", "missing_record_count", "missing_labels", "question_ids"]
    sinks.write_csv(m.failures_by_image(answered(spark, d)), path, columns, overwrite=True)
    return readers.csv_rows(spark, path)


@query(f"SELECT question_id, image FROM ({b.SQL['b_questions']}) ORDER BY CAST(question_id AS VARCHAR) LIMIT 20")
def inference_order(spark, d):
    """The first questions in the order of inference."""
    return s.inference_order(b.questions(spark, d).select("question_id", "image"), 20)


# inspection


@query(f"""{b.with_sql('b_source')}, f AS (SELECT 'task' AS field, trim(task) AS value FROM b_source UNION ALL SELECT 'format_type', trim(format_type) FROM b_source UNION ALL SELECT 'img_type', trim(img_type) FROM b_source
  UNION ALL SELECT 'view_count', CASE WHEN NOT has_image THEN '0' WHEN img_type = 'single_view' THEN '1' ELSE '3' END FROM b_source UNION ALL SELECT 'answer_type', CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN 'NoneType' ELSE 'str' END FROM b_source)
  SELECT field, value, count(*) AS n FROM f GROUP BY ALL""")
def inspection_histograms(spark, d):
    one = F.lit("view.jpg")
    views = F.when(~F.col("has_image"), F.lit(None)).when(F.col("img_type") == "single_view", F.array(one)).otherwise(F.array(one, one, one))
    rows = b.sources(spark, d).withColumn("image", views).withColumn("answer", F.when(F.col("id").cast("long") % 9 != 0, F.col("answer")))
    return s.inspection(rows, ["task", "format_type", "img_type"], "image", "answer")


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN [] ELSE [[1, 2, 3], [4]] END AS depth FROM documents)
  SELECT doc_id, 'text' AS field, 'string' AS type, coalesce(trim(text) = '', true) AS missing, CAST(NULL AS INTEGER[]) AS shape, CASE WHEN trim(text) <> '' THEN length(text) END AS length, CASE WHEN trim(text) <> '' THEN substr(text, 1, 120) END AS preview FROM e
  UNION ALL SELECT doc_id, 'depth', 'array<array<int>>', depth IS NULL OR len(depth) = 0, CASE WHEN len(depth) > 0 THEN [len(depth), len(depth[1])] END, CASE WHEN len(depth) > 0 THEN len(depth) END, NULL FROM e""")
def field_descriptors(spark, d):
    k = F.col("doc_id")
    depth = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.array().cast("array<array<int>>")).otherwise(F.array(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(4))))
    rows = b.table(spark, d, "documents").select("doc_id", F.when(k % 4 == 0, "").otherwise(F.col("text")).alias("text"), depth.alias("depth"))
    return s.described(rows, ["text", "depth"])


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN [] ELSE [event_type] END AS types, CASE WHEN event_id % 3 = 0 THEN [] ELSE [event_id, event_id] END AS ids FROM events")
def values_as_lists(spark, d):
    k = F.col("event_id")
    kind, ids = F.when(k % 4 != 0, F.col("event_type")), F.when(k % 3 != 0, F.array(k, k))
    return b.table(spark, d, "events").select("event_id", a.as_list(kind, "string").alias("types"), a.as_list(ids, "array<bigint>").alias("ids"))


@query("SELECT p_partkey, p_brand AS brand, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'plain' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'extra' END AS more FROM part")
def merged_settings(spark, d):
    """Defaults under a row's own settings."""
    k = F.col("p_partkey")
    defaults = F.create_map(F.lit("kind"), F.lit("plain"), F.lit("brand"), F.lit("none"))
    own = F.map_filter(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.when(k % 2 == 0, F.col("p_type")), F.lit("more"), F.when(k % 3 == 0, "extra")), lambda _, value: value.isNotNull())
    both = b.table(spark, d, "part").select(k, merged(defaults, own).alias("s"))
    return both.select("p_partkey", *[F.try_element_at("s", F.lit(c)).alias(c) for c in ("brand", "kind", "more")])


# detections, rasters and records


@query(f"{b.with_sql('b_detections')} SELECT image, pos, label, conf FROM b_detections WHERE conf >= 0.3::DOUBLE")
def detections_filtered(spark, d):
    return b.detections(spark, d).where(F.col("conf") >= 0.3).select("image", "pos", "label", "conf")


@query(f"{b.with_sql('b_detections')} SELECT image, CAST(pos - 1 AS INTEGER) AS pos, conf, cls, [conf, conf + 1] AS box FROM b_detections")
def detector_boxes(spark, d):
    """Boxes from a detector's parallel lists, one each for an image's few lines."""
    held = F.array_sort(F.collect_list(F.struct("pos", "conf", "cls")))
    lists = b.detections(spark, d).groupBy("image").agg(held.alias("h"))
    part = lambda f: F.transform("h", f)
    return v.zipped_boxes(lists.select("image", part(lambda x: x["conf"]).alias("conf"), part(lambda x: x["cls"]).alias("cls"), part(lambda x: F.array(x["conf"], x["conf"] + 1)).alias("boxes")))


@query("""WITH e AS (SELECT *, list_filter(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), lambda v: isfinite(v)) AS good FROM embeddings) SELECT 'scene_' || vec_id || '.jpg' AS image, 8 AS image_width, 8 AS image_height, 'small' AS model, 'relative_depth_float32_npy' AS depth_format,
  'depth/scene_' || vec_id || '_depth.npy' AS depth_path, 'depth/scene_' || vec_id || '_depth.png' AS visualization_path, [8, 8] AS depth_shape, list_min(good) AS depth_min, list_max(good) AS depth_max, list_avg(good) AS depth_mean, 'Depth Anything V2 outputs relative monocular depth, not metric distance.' AS depth_note FROM e""")
def depth_documents(spark, d):
    rows = b.table(spark, d, "embeddings").select(F.concat(F.lit("scene_"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("image"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.col("embedding").alias("values"))
    return p.depth_documents(rows, "small", "depth")


def _rasters(spark, d):
    return b.table(spark, d, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("values"))


@query("SELECT vec_id, x, y, CAST(embedding[y * 2 * 8 + x * 2 + 1] AS DOUBLE) AS d FROM embeddings, (SELECT unnest(range(0, 4)) AS x), (SELECT unnest(range(0, 4)) AS y)")
def raster_resized_whole(spark, d):
    """Every cell of rasters brought to half the size by the nearest pixel."""
    return readers.raster_pixels(readers.resized(_rasters(spark, d), ["vec_id"], 4, 4), ["vec_id"])


_W = ", ".join(f"({i}, {j}, {float(w)!r}::DOUBLE)" for i, row in enumerate(readers._weights(8, 12, True)) for j, w in enumerate(row) if w)


@query(f"""WITH w(i, j, w) AS (VALUES {_W}), px AS (SELECT vec_id, (pos - 1) % 8 AS x, (pos - 1) // 8 AS y, CAST(embedding[pos] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)),
  across AS (SELECT vec_id, y, w.i AS x, sum(v * w) AS v FROM px JOIN w ON w.j = px.x GROUP BY ALL) SELECT vec_id, x, w.i AS y, CAST(CAST(sum(v * w) AS FLOAT) AS DOUBLE) AS d FROM across JOIN w ON w.j = across.y GROUP BY vec_id, x, w.i""")
def raster_bicubic(spark, d):
    """Every cell of rasters enlarged bicubically."""
    return readers.raster_pixels(readers.resized(_rasters(spark, d), ["vec_id"], 12, 12, "bicubic"), ["vec_id"])


@query(f"""{_STATUS} SELECT question_id, CASE WHEN len(list_filter(required, lambda c: NOT list_contains(available, c))) > 0 THEN 'required_marker_missing' WHEN len(available) = 0 AND question_id % 2 = 0 AND (task LIKE '%\\_oc' ESCAPE '\\' OR task LIKE '%\\_oo' ESCAPE '\\') THEN 'no_point_or_object_reference' END AS reason
  FROM (SELECT question_id, task, CASE WHEN question_id % 3 = 0 THEN [] ELSE required END AS required, CASE WHEN question_id % 3 = 0 THEN [] ELSE available END AS available FROM st2)""")
def references_of_rows(spark, d):
    """Questions that name no marker and have none: a list of objects in the row is a reference."""
    k = F.col("question_id")
    rows = b.marker_questions(spark, d).withColumn("question", F.when(k % 3 == 0, "How far is it?").otherwise(F.col("question")))
    rows = rows.withColumn("objects", F.when(k % 2 == 1, F.array(F.lit("cup"))).otherwise(F.array().cast("array<string>")))
    return u.task_status(rows, g.marker_points(b.markers(spark, d)).where(k % 3 != 0)).select("question_id", "reason")


@query(f"""{_STATUS}, mk AS (SELECT question_id, count(*) AS n, string_agg(color, ',' ORDER BY rank) AS colors FROM m_points GROUP BY question_id), rl AS (SELECT question_id, count(*) AS n, CAST(sum(CAST(round(euclidean_distance * 1000000) AS BIGINT)) AS BIGINT) AS far FROM m_pairs GROUP BY question_id)
  SELECT s.question_id, s.task, s.status AS task_geometry_status, s.required, s.reason AS unavailable_reason, 1 AS view_count, CAST(len(list_filter(e.embedding, lambda x: x > 0 AND isfinite(x))) > 0 AS BIGINT) AS available_view_count, coalesce(mk.colors, '') AS colors, coalesce(rl.n, 0) AS n_relations, coalesce(rl.far, 0) AS far
  FROM status s JOIN embeddings e ON e.vec_id = s.question_id LEFT JOIN mk USING (question_id) LEFT JOIN rl USING (question_id)""")
def geometry_records(spark, d):
    """The records, their views' markers and relations told in short."""
    points = g.marker_points(b.markers(spark, d), rounded_away)
    status = u.task_status(b.marker_questions(spark, d), points)
    records = u.geometry_records(status, b.marker_views(spark, d), points, g.marker_relations(points, rounded_away))
    empty = lambda c: F.coalesce(F.flatten(F.transform("views", lambda x: F.coalesce(x[c], F.array()))), F.array())
    marks, related = empty("markers"), empty("marker_relations")
    far = F.aggregate(related, F.lit(0).cast("long"), lambda n, x: n + F.round(x["euclidean_distance"] * 1000000).cast("long"))
    return records.select("question_id", "task", "task_geometry_status", "required", "unavailable_reason", "view_count", "available_view_count", F.array_join(F.transform(marks, lambda x: x["color"]), ",").alias("colors"), F.size(related).cast("long").alias("n_relations"), far.alias("far"))


@query(f"""{GEOMETRY_SQL} SELECT object_id, '- ' || object_id || ' ' || label || ': position=' || horizontal_position || '/' || vertical_position || ', centroid=' || CASE WHEN mask_centroid IS NULL THEN 'unknown' ELSE '[' || {_six('mask_centroid[1]')} || ', ' || {_six('mask_centroid[2]')} || ']' END
  || ', area_fraction=' || {_six('mask_area_fraction')} || ', closeness_score=' || {_six('closeness_score')} || ', closeness_percentile=' || {_six('closeness_percentile')} || ', closeness_hint=' || depth_order_hint || CASE object_id % 3 WHEN 0 THEN ', raw_label=old ' || label ELSE '' END AS line FROM g_objects""")
def object_lines(spark, d):
    """Evidence lines of objects, some of which had another label."""
    k = F.col("object_id")
    rows = object_geometry(spark, d).withColumn("raw_label", F.when(k % 3 == 0, F.concat(F.lit("old "), "label")).when(k % 3 == 1, F.col("label")))
    return rows.withColumn("_numbers", t.object_numbers(F.col("closeness_score"))).select("object_id", t.object_line("_numbers", raw=True).alias("line"))
