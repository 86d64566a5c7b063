"""Queries over rasters, object geometry and reference points."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.common import rounded_away
from ..operators import geometry as g
from ..operators import pixels as p
from . import Catalogue

catalogue = Catalogue()
query = catalogue.query
SIDE = b.SIDE


def inside():
    return F.col("d") > 0


_FIN = "d IS NOT NULL AND NOT isnan(d) AND NOT isinf(d)"
G_OBJECTS = f"""g_stats AS (
  SELECT image, object_id, count(*) FILTER (d > 0) AS mask_area_px, round(count(*) FILTER (d > 0) / {SIDE * SIDE}.0::DOUBLE, 6) AS mask_area_fraction,
    CASE WHEN count(*) FILTER (d > 0) > 0 THEN [CAST(min(x) FILTER (d > 0) AS INTEGER), CAST(min(y) FILTER (d > 0) AS INTEGER), CAST(max(x) FILTER (d > 0) AS INTEGER), CAST(max(y) FILTER (d > 0) AS INTEGER)] END AS mask_bounds_xyxy,
    CASE WHEN count(*) FILTER (d > 0) > 0 THEN [round(avg(x) FILTER (d > 0), 6), round(avg(y) FILTER (d > 0), 6)] END AS mask_centroid,
    round(min(d) FILTER (d > 0), 6) AS relative_depth_min, round(max(d) FILTER (d > 0), 6) AS relative_depth_max, round(avg(d) FILTER (d > 0), 6) AS relative_depth_mean,
    round(median(d) FILTER (d > 0), 6) AS relative_depth_median, round(quantile_cont(d, 0.1) FILTER (d > 0), 6) AS relative_depth_p10, round(quantile_cont(d, 0.9) FILTER (d > 0), 6) AS relative_depth_p90
  FROM b_pixels GROUP BY image, object_id),
g_span AS (SELECT image, min(d) AS depth_min, max(d) - min(d) AS depth_range FROM b_pixels GROUP BY image),
g_mid AS (SELECT o.*, s.* EXCLUDE (image, object_id), depth_min, depth_range, relative_depth_p90 AS closeness_score,
    CASE WHEN depth_range > 0 THEN round((relative_depth_p90 - depth_min) / depth_range, 6) END AS closeness_percentile,
    CASE WHEN depth_range > 0 THEN round((relative_depth_median - depth_min) / depth_range, 6) END AS relative_depth_percentile
  FROM b_objects o LEFT JOIN g_stats s USING (image, object_id) LEFT JOIN g_span USING (image)),
g_objects AS (SELECT * EXCLUDE (depth_min),
    coalesce(CASE WHEN len(bbox) = 4 THEN [round((bbox[1] + bbox[3]) / 2, 6), round((bbox[2] + bbox[4]) / 2, 6)] END, mask_centroid) AS bbox_center,
    CASE WHEN mask_centroid IS NULL THEN 'unknown' WHEN mask_centroid[1] < {SIDE / 3} THEN 'left' WHEN mask_centroid[1] > {2 * SIDE / 3} THEN 'right' ELSE 'center' END AS horizontal_position,
    CASE WHEN mask_centroid IS NULL THEN 'unknown' WHEN mask_centroid[2] < {SIDE / 3} THEN 'top' WHEN mask_centroid[2] > {2 * SIDE / 3} THEN 'bottom' ELSE 'middle' END AS vertical_position,
    CASE WHEN closeness_percentile IS NULL THEN 'unknown' WHEN closeness_percentile >= {2 / 3} THEN 'near' WHEN closeness_percentile <= {1 / 3} THEN 'far' ELSE 'middle' END AS depth_order_hint
  FROM g_mid)"""
_AXIS = "CASE WHEN abs(a.mask_centroid[{i}] - b.mask_centroid[{i}]) <= 1.0 THEN 'aligned' WHEN a.mask_centroid[{i}] > b.mask_centroid[{i}] THEN '{hi}' ELSE '{lo}' END"
_DEPTH = "coalesce(nullif({s}.closeness_score, 0), {s}.relative_depth_median)"
G_PAIRS = f"""g_pairs AS (
  SELECT image, a.ord AS ord_a, b.ord AS ord_b, a.object_id AS object_a, a.label AS label_a, b.object_id AS object_b, b.label AS label_b,
    {_AXIS.format(i=1, hi='right_of', lo='left_of')} AS horizontal_relation, {_AXIS.format(i=2, hi='below', lo='above')} AS vertical_relation,
    CASE WHEN {_DEPTH.format(s='a')} IS NULL OR {_DEPTH.format(s='b')} IS NULL THEN 'unknown'
      WHEN abs({_DEPTH.format(s='a')} - {_DEPTH.format(s='b')}) <= greatest(1e-6::DOUBLE, a.depth_range * 0.02::DOUBLE) THEN 'similar_depth'
      WHEN {_DEPTH.format(s='a')} > {_DEPTH.format(s='b')} THEN 'closer_than' ELSE 'farther_than' END AS depth_relation
  FROM g_objects a JOIN g_objects b USING (image) WHERE a.ord < b.ord AND a.mask_centroid IS NOT NULL AND b.mask_centroid IS NOT NULL)"""
GEOMETRY_SQL = f"{b.with_sql('b_pixels', 'b_objects')}, {G_OBJECTS}, {G_PAIRS}"
_PX = b.with_sql("b_pixels")


@query(f"{_PX}, b_objects AS ({b.SQL['b_objects']}), {G_OBJECTS} SELECT image, object_id, mask_area_px, mask_area_fraction, mask_bounds_xyxy, mask_centroid FROM g_objects")
def mask_geometry(spark, d):
    return p.mask_geometry(b.pixels(spark, d), ["image", "object_id"], inside(), SIDE, SIDE)


@query(f"{_PX} SELECT image, object_id, CAST(coalesce(min(x) FILTER (d > 0.3), 0) AS INTEGER) AS x0, CAST(coalesce(min(y) FILTER (d > 0.3), 0) AS INTEGER) AS y0, CAST(coalesce(max(x) FILTER (d > 0.3), 0) AS INTEGER) AS x1, CAST(coalesce(max(y) FILTER (d > 0.3), 0) AS INTEGER) AS y1 FROM b_pixels GROUP BY ALL")
def mask_bounds(spark, d):
    return p.mask_bounds(b.pixels(spark, d), ["image", "object_id"], F.col("d") > 0.3)


@query(f"{_PX}, b_objects AS ({b.SQL['b_objects']}), {G_OBJECTS} SELECT image, object_id, relative_depth_min, relative_depth_max, relative_depth_mean, relative_depth_median, relative_depth_p10, relative_depth_p90 FROM g_objects")
def depth_stats(spark, d):
    return p.depth_stats(b.pixels(spark, d), ["image", "object_id"], inside())


@query(f"""{_PX} SELECT image, object_id, round(min(d) FILTER (d > 0), 6) AS depth_min, round(max(d) FILTER (d > 0), 6) AS depth_max, round(avg(d) FILTER (d > 0), 6) AS depth_mean, round(median(d) FILTER (d > 0), 6) AS depth_median,
  round(quantile_cont(d, 0.1) FILTER (d > 0), 6) AS depth_p10, round(quantile_cont(d, 0.9) FILTER (d > 0), 6) AS depth_p90, count(*) FILTER (d > 0) AS valid_pixel_count, count(*) FILTER (d > 0) > 0 AS valid FROM b_pixels GROUP BY ALL""")
def depth_stats_positive(spark, d):
    return p.depth_stats_positive(b.pixels(spark, d), ["image", "object_id"])


@query(f"{_PX} SELECT image, min(d) AS depth_min, max(d) AS depth_max, max(d) - min(d) AS depth_range, round(avg(d), 6) AS depth_mean FROM b_pixels GROUP BY image")
def depth_range(spark, d):
    return p.depth_range(b.pixels(spark, d), ["image"]).withColumn("depth_mean", F.round("depth_mean", 6))


@query(f"{_PX}, s AS (SELECT image, object_id, min(d) AS lo, max(d) AS hi FROM b_pixels GROUP BY ALL) SELECT image, object_id, x, y, CAST(coalesce(floor((d - lo) / nullif(hi - lo, 0) * 255), 0) AS INTEGER) AS u8 FROM b_pixels JOIN s USING (image, object_id)")
def depth_preview_u8(spark, d):
    return p.preview_u8(b.pixels(spark, d), ["image", "object_id"])


@query(f"{_PX} SELECT image, object_id, CAST(x * 2 + i AS INTEGER) AS x, CAST(y * 2 + j AS INTEGER) AS y, CASE WHEN d * 10 > 0.5 THEN 255 ELSE 0 END AS u8 FROM b_pixels, (VALUES (0), (1)) a(i), (VALUES (0), (1)) c(j)")
def mask_u8(spark, d):
    return p.mask_u8(b.pixels(spark, d).withColumn("d", F.col("d") * 10), ["image", "object_id"], 2)


@query(f"{b.with_sql('b_pixels', 'b_objects')}, {G_OBJECTS} SELECT * FROM g_objects")
def object_geometry(spark, d):
    return g.object_geometry(b.objects(spark, d), b.pixels(spark, d), SIDE, SIDE)


@query(f"{GEOMETRY_SQL} SELECT * FROM g_pairs")
def pairwise_relations(spark, d):
    return g.pairwise_relations(object_geometry(spark, d), SIDE, SIDE)


@query(f"""{b.with_sql('b_objects')} SELECT image, object_id, bbox, [CAST(greatest(0, least({SIDE - 2}, round_even(bbox[1], 0))) AS INTEGER), CAST(greatest(0, least({SIDE - 3}, round_even(bbox[2], 0))) AS INTEGER), CAST(greatest(0, least({SIDE - 2}, round_even(bbox[3], 0))) AS INTEGER), CAST(greatest(0, least({SIDE - 3}, round_even(bbox[4], 0))) AS INTEGER)] AS clamped,
  [round((bbox[1] + bbox[3]) / 2, 6), round((bbox[2] + bbox[4]) / 2, 6)] AS center FROM b_objects WHERE len(bbox) = 4""")
def box_prompts(spark, d):
    boxes = b.objects(spark, d).where(F.size("bbox") == 4)
    return boxes.select("image", "object_id", "bbox", g.clamp_bbox("bbox", SIDE - 1, SIDE - 2).alias("clamped"), g.bbox_center("bbox").alias("center"))


@query(f"{b.with_sql('b_objects')} SELECT image, format('obj_{{:03d}}', row_number() OVER (PARTITION BY image ORDER BY ord)) AS object_id, label, confidence, bbox, 'masks/' || image || '/' || ord || '.png' AS mask_path FROM b_objects WHERE confidence >= 0.2::DOUBLE")
def segments_projected(spark, d):
    kept = g.numbered(b.objects(spark, d), "image", "ord", F.col("confidence") >= 0.2)
    return kept.select("image", "object_id", "label", "confidence", "bbox", F.concat(F.lit("masks/"), "image", F.lit("/"), F.col("ord").cast("string"), F.lit(".png")).alias("mask_path"))


_PARTS = f"""WITH RECURSIVE px AS (SELECT vec_id, pos - 1 AS i, (pos - 1) % {SIDE} AS x, (pos - 1) // {SIDE} AS y FROM embeddings, (SELECT unnest(range(1, {SIDE * SIDE + 1})) AS pos) WHERE embedding[pos] > 0.1),
near AS (SELECT a.vec_id, a.i AS a, c.i AS c FROM px a JOIN px c ON a.vec_id = c.vec_id AND abs(a.x - c.x) <= 1 AND abs(a.y - c.y) <= 1),
reach AS (SELECT vec_id, a, c FROM near UNION SELECT r.vec_id, r.a, n.c FROM reach r JOIN near n ON r.vec_id = n.vec_id AND r.c = n.a),
lab AS (SELECT vec_id, a AS i, min(c) AS label FROM reach GROUP BY ALL), sized AS (SELECT vec_id, label, count(*) AS n FROM lab GROUP BY ALL),
best AS (SELECT vec_id, label FROM sized QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) = 1)
SELECT vec_id, count(*) AS n_pixels, min(i % {SIDE}) AS x0, min(i // {SIDE}) AS y0, max(i % {SIDE}) AS x1, max(i // {SIDE}) AS y1, median(i % {SIDE}) AS mid_x, median(i // {SIDE}) AS mid_y FROM lab JOIN best USING (vec_id, label) GROUP BY vec_id"""


@query(_PARTS)
def marker_components(spark, d):
    return p.component_geometry(b.table(spark, d, "embeddings").select("vec_id", "embedding"), ["vec_id"], "embedding", SIDE, 0.1)


@query(f"""{_PX}, pt AS (SELECT image, object_id, 3.5::DOUBLE AS px, CAST(object_id % 8 AS DOUBLE) AS py FROM b_pixels GROUP BY ALL),
nr AS (SELECT pt.image, pt.object_id, d, greatest(abs(x - 4), abs(y - py)) AS away FROM pt JOIN b_pixels q ON pt.image = q.image AND pt.object_id = q.object_id WHERE d > 0),
st AS (SELECT image, object_id, round(median(d) FILTER (away <= 1), 6) AS m1, count(*) FILTER (away <= 1) AS n1, round(median(d) FILTER (away <= 3), 6) AS m3, count(*) FILTER (away <= 3) AS n3 FROM nr GROUP BY ALL)
SELECT image, object_id, coalesce(m1, m3) AS depth, coalesce(CASE WHEN n1 > 0 THEN n1 ELSE n3 END, 0) AS depth_sample_count FROM pt LEFT JOIN st USING (image, object_id)""")
def neighbourhood_depth(spark, d):
    points = b.objects(spark, d).select("image", "object_id", F.lit(3.5).alias("px"), (F.col("object_id") % 8).cast("double").alias("py"))
    return p.near_depth(b.pixels(spark, d), points, ["image", "object_id"])


M_POINTS = """m_points AS (SELECT *, CASE WHEN abs(fx) > 1e-12 AND abs(fy) > 1e-12 THEN [round((px - cx) * depth / fx, 6), round((py - cy) * depth / fy, 6), round(depth, 6)] END AS camera_xyz FROM b_markers)"""
M_PAIRS = """m_pairs AS (SELECT a.question_id, a.view, a.color || '_to_' || b.color AS pair,
  round(sqrt((a.camera_xyz[1] - b.camera_xyz[1]) ** 2 + (a.camera_xyz[2] - b.camera_xyz[2]) ** 2 + (a.camera_xyz[3] - b.camera_xyz[3]) ** 2), 6) AS euclidean_distance, round(b.depth - a.depth, 6) AS depth_difference
  FROM m_points a JOIN m_points b ON a.question_id = b.question_id AND a.view = b.view AND a.rank < b.rank WHERE a.camera_xyz IS NOT NULL AND b.camera_xyz IS NOT NULL)"""
MARKERS_SQL = f"{b.with_sql('b_markers', 'b_mq')}, {M_POINTS}, {M_PAIRS}"


@query(f"{MARKERS_SQL} SELECT question_id, view, color, camera_xyz FROM m_points")
def camera_xyz(spark, d):
    return g.marker_points(b.markers(spark, d), rounded_away).select("question_id", "view", "color", "camera_xyz")


@query(f"{MARKERS_SQL} SELECT * FROM m_pairs")
def marker_relations(spark, d):
    return g.marker_relations(g.marker_points(b.markers(spark, d), rounded_away), rounded_away)


@query(f"""{MARKERS_SQL} SELECT r.question_id, r.view, round(q.depth - r.depth, 6) AS depth_difference_blue_minus_red,
  round(sqrt((r.camera_xyz[1] - q.camera_xyz[1]) ** 2 + (r.camera_xyz[2] - q.camera_xyz[2]) ** 2 + (r.camera_xyz[3] - q.camera_xyz[3]) ** 2), 6) AS euclidean_distance
  FROM m_points r JOIN m_points q ON r.question_id = q.question_id AND r.view = q.view AND r.color = 'red' AND q.color = 'blue'""")
def red_blue_relation(spark, d):
    return g.red_blue_relation(g.marker_points(b.markers(spark, d), rounded_away), rounded_away)


@query("SELECT vec_id, len(m) IN (9, 16) AS valid, CASE len(m) WHEN 9 THEN [3, 3] WHEN 16 THEN [4, 4] END AS shape FROM (SELECT vec_id, embedding[1:CASE vec_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 16 ELSE 12 END] AS m FROM embeddings)")
def matrix_status(spark, d):
    size = F.when(F.col("vec_id") % 3 == 0, 9).when(F.col("vec_id") % 3 == 1, 16).otherwise(12)
    rows = b.table(spark, d, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), size).alias("m"))
    return rows.select("vec_id", g.matrix_status("m").alias("s")).select("vec_id", "s.valid", "s.shape")


@query(f"{MARKERS_SQL} SELECT question_id, view, color, camera_xyz, CASE WHEN question_id % 4 = 0 THEN NULL ELSE camera_xyz END AS stored_xyz, camera_xyz IS DISTINCT FROM (CASE WHEN question_id % 4 = 0 THEN NULL ELSE camera_xyz END) AS changed FROM m_points")
def repair_markers(spark, d):
    points = b.markers(spark, d)
    stored = g.marker_points(points, rounded_away).withColumn("camera_xyz", F.when(F.col("question_id") % 4 != 0, F.col("camera_xyz")))
    return g.repaired(points, stored, rounded_away)
