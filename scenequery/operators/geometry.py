"""Object geometry, pairwise relations and calibrated reference points, as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import col, finite, nullif_zero, rounded
from .pixels import depth_columns, mask_columns

#: How reference points' numbers get six decimals: rounded(), or rounded_away() for those who want SQL's halves.
Six = Callable[[Column | str], Column]


def bbox_center(bbox: Column | str) -> Column:
    b = col(bbox)
    return F.when(F.size(b) == 4, F.array(rounded((F.get(b, 0) + F.get(b, 2)) / 2), rounded((F.get(b, 1) + F.get(b, 3)) / 2)))


def box_prompt(bbox: Column | str, name: Column | str) -> Column:
    """The box as four numbers; one of another length, or none, stops the job and tells whose it is."""
    b = col(bbox)
    wrong = F.raise_error(F.concat(F.lit("bbox_xyxy must have four numbers: "), F.coalesce(col(name).cast("string"), F.lit("None")))).cast("array<double>")
    return F.when(F.size(b) == 4, F.transform(b, lambda x: x.cast("double"))).otherwise(wrong)


def clamp_bbox(bbox: Column | str, width: int, height: int) -> Column:
    """Whole pixels inside the image."""
    b, most = col(bbox), (width - 1, height - 1, width - 1, height - 1)
    return F.array(*[F.greatest(F.lit(0), F.least(F.lit(m), F.bround(F.get(b, i)).cast("int"))) for i, m in enumerate(most)])


def position_tag(value: Column | str, extent: int, low: str, middle: str, high: str) -> Column:
    """Which third of the extent a value lies in."""
    v = col(value)
    return F.when(v.isNull(), "unknown").when(v < extent / 3, low).when(v > 2 * extent / 3, high).otherwise(middle)


def depth_percentile(value: Column | str, low: Column | str, span: Column | str) -> Column:
    v, s = col(value), col(span)
    return F.when((s > 0) & v.isNotNull(), rounded((v - col(low)) / F.when(s > 0, s)))


def depth_order_hint(percentile: Column | str, higher_is_closer: bool) -> Column:
    p = col(percentile)
    high, low = ("near", "far") if higher_is_closer else ("far", "near")
    return F.when(p.isNull(), "unknown").when(p >= 2 / 3, high).when(p <= 1 / 3, low).otherwise("middle")


def near_surface_depth(higher_is_closer: bool, prefix: str = "relative_depth_") -> Column:
    return F.col(prefix + ("p90" if higher_is_closer else "p10"))


def depth_order_assumption(higher_is_closer: bool) -> Column:
    return F.lit("higher_relative_depth_is_closer" if higher_is_closer else "lower_relative_depth_is_closer")


def object_geometry(objects: DataFrame, pixels: DataFrame, width: int, height: int, higher_is_closer: bool = True) -> DataFrame:
    """The geometry of every object: its mask, its depths, and where that puts it in the image.

    objects: image, ord, object_id, label, confidence, bbox; pixels: image, object_id, x, y, d.
    """
    keys, inside = ["image", "object_id"], F.col("d") > 0
    seen = F.when(finite("d"), F.col("d"))
    masks, depths = mask_columns(inside, width, height), depth_columns(inside)
    # the pixels are shuffled once; an image's range comes from its objects'
    own = pixels.groupBy(*keys).agg(*masks, *depths, F.min(seen).alias("_low"), F.max(seen).alias("_high"))
    low, high = F.coalesce(F.min("_low"), F.lit(0.0)), F.coalesce(F.max("_high"), F.lit(0.0))
    spans = own.groupBy("image").agg(low.alias("depth_min"), (high - low).alias("depth_range"))
    stats = own.drop("_low", "_high")
    joined = objects.join(stats, keys, "left").join(spans, "image", "left")
    joined = joined.withColumn("closeness_score", rounded(near_surface_depth(higher_is_closer)))
    joined = joined.withColumn("closeness_percentile", depth_percentile("closeness_score", "depth_min", "depth_range"))
    return joined.select(
        *objects.columns,
        *[c for c in stats.columns if c not in keys],
        "depth_range",
        F.coalesce(bbox_center("bbox"), "mask_centroid").alias("bbox_center"),
        "closeness_score",
        "closeness_percentile",
        depth_percentile("relative_depth_median", "depth_min", "depth_range").alias("relative_depth_percentile"),
        position_tag(F.get("mask_centroid", 0), width, "left", "center", "right").alias("horizontal_position"),
        position_tag(F.get("mask_centroid", 1), height, "top", "middle", "bottom").alias("vertical_position"),
        depth_order_hint("closeness_percentile", higher_is_closer).alias("depth_order_hint"),
    )


def compare_axis(a: Column, b: Column, threshold: Column | float, low: str, high: str) -> Column:
    return F.when(F.abs(a - b) <= threshold, "aligned").when(a > b, high).otherwise(low)


def compare_depth(a: Column, b: Column, threshold: Column, higher_is_closer: bool) -> Column:
    up, down = ("closer_than", "farther_than") if higher_is_closer else ("farther_than", "closer_than")
    return F.when(a.isNull() | b.isNull(), "unknown").when(F.abs(a - b) <= threshold, "similar_depth").when(a > b, up).otherwise(down)


def pairwise_relations(geometry: DataFrame, width: int, height: int, higher_is_closer: bool = True) -> DataFrame:
    """Relations of every pair of objects of an image, in detection order; objects without a mask are left out."""
    depth = F.coalesce(nullif_zero(F.col("closeness_score")), F.col("relative_depth_median"))
    own = geometry.where("mask_centroid is not null").select("image", "ord", "object_id", "label", F.col("mask_centroid")[0].alias("cx"), F.col("mask_centroid")[1].alias("cy"), depth.alias("depth"), "depth_range")
    a, b = (own.select("image", *[F.col(c).alias(f"{c}_{s}") for c in own.columns if c != "image"]) for s in "ab")
    pairs = a.join(b, "image").where("ord_a < ord_b")
    return pairs.select(
        "image", "ord_a", "ord_b", F.col("object_id_a").alias("object_a"), "label_a", F.col("object_id_b").alias("object_b"), "label_b",
        compare_axis(F.col("cx_a"), F.col("cx_b"), max(1.0, width * 0.03), "left_of", "right_of").alias("horizontal_relation"),
        compare_axis(F.col("cy_a"), F.col("cy_b"), max(1.0, height * 0.03), "above", "below").alias("vertical_relation"),
        compare_depth(F.col("depth_a"), F.col("depth_b"), F.greatest(F.lit(1e-6), F.col("depth_range_a") * 0.02), higher_is_closer).alias("depth_relation"),
    )


def matrix_status(values: Column | str) -> Column:
    """Whether a flat matrix is 3 x 3 or 4 x 4 and finite, with its shape."""
    v = col(values)
    side = F.when(F.size(v) == 9, 3).when(F.size(v) == 16, 4)
    return F.struct((side.isNotNull() & F.forall(v, finite)).alias("valid"), F.when(side.isNotNull(), F.array(side, side)).alias("shape"))


def nested_matrix_status(values: Column | str, sides: tuple[int, ...] = (3, 4)) -> Column:
    """As matrix_status() for lists of rows: valid, shape and the finite values by rows. Rows of unequal lengths have no shape; a flat list of 16, one row of them, is 4 x 4."""
    v = col(values)
    rows, width = F.size(v), F.size(F.get(v, 0))
    even = (rows > 0) & (width > 0) & F.forall(v, lambda r: F.size(r) == width)
    flat = (rows == 1) & (width == 16)
    shape = F.when(flat, F.array(F.lit(4), F.lit(4))).when(even, F.array(rows, width))
    good = F.exists(F.array(*map(F.lit, sides)), lambda n: (F.get(shape, 0) == n) & (F.get(shape, 1) == n))
    whole = F.coalesce(good & F.forall(F.flatten(v), finite), F.lit(False))
    return F.struct(whole.alias("valid"), shape.alias("shape"), F.when(whole, F.flatten(v)).alias("values"))


def camera_xyz(px: Column | str, py: Column | str, depth: Column | str, fx: Column | str, fy: Column | str, cx: Column | str, cy: Column | str, six: Six = rounded) -> Column:
    """Pinhole back-projection of an image point; null without a usable focal length."""
    px, py, depth, fx, fy, cx, cy = map(col, (px, py, depth, fx, fy, cx, cy))
    usable = (F.abs(fx) > 1e-12) & (F.abs(fy) > 1e-12) & finite(cx) & finite(cy) & finite(fx) & finite(fy) & depth.isNotNull()
    x, y = (px - cx) * depth / F.when(usable, fx), (py - cy) * depth / F.when(usable, fy)
    return F.when(usable, F.array(six(x), six(y), six(depth)))


def distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def marker_points(markers: DataFrame, six: Six = rounded) -> DataFrame:
    return markers.withColumn("camera_xyz", camera_xyz("px", "py", "depth", "fx", "fy", "cx", "cy", six))


def marker_relations(points: DataFrame, six: Six = rounded) -> DataFrame:
    """Distance and depth difference of every two markers of a view that have coordinates, in colour order."""
    own = points.where("camera_xyz is not null").select("question_id", "view", "color", "rank", "depth", "camera_xyz")
    a, b = (own.select("question_id", "view", *[F.col(c).alias(f"{c}_{s}") for c in own.columns[2:]]) for s in "ab")
    pairs = a.join(b, ["question_id", "view"]).where("rank_a < rank_b")
    return pairs.select(
        "question_id", "view", F.concat_ws("_to_", "color_a", "color_b").alias("pair"),
        six(distance("camera_xyz_a", "camera_xyz_b")).alias("euclidean_distance"),
        six(F.col("depth_b") - F.col("depth_a")).alias("depth_difference"),
    )


def red_blue_relation(points: DataFrame, six: Six = rounded) -> DataFrame:
    """Depth difference of blue and red of every view that has both, and their distance where both have coordinates."""
    own = points.groupBy("question_id", "view").agg(*[F.max(F.when(F.col("color") == c, F.struct("depth", "camera_xyz"))).alias(c) for c in ("red", "blue")])
    both = own.where("red is not null and blue is not null")
    return both.select("question_id", "view", six(F.col("blue.depth") - F.col("red.depth")).alias("depth_difference_blue_minus_red"), six(distance("red.camera_xyz", "blue.camera_xyz")).alias("euclidean_distance"))


def repaired(points: DataFrame, stored: DataFrame, six: Six = rounded) -> DataFrame:
    """Stored marker coordinates computed anew, and whether that changed them."""
    kept = stored.select("question_id", "view", "color", F.col("camera_xyz").alias("stored_xyz"))
    fresh = marker_points(points, six).select("question_id", "view", "color", "camera_xyz")
    return fresh.join(kept, ["question_id", "view", "color"], "left").withColumn("changed", ~F.col("camera_xyz").eqNullSafe(F.col("stored_xyz")))


def repaired_boxes(stored: DataFrame, found: DataFrame, image: tuple[int, int], depth: tuple[int, int]) -> DataFrame:
    """Stored markers with box, centre, visible median, depth pixel and camera_xyz from their image, where their colour is found in it.

    found: pixels.color_markers() by question_id and view; image, depth: width and height; stored: pixel_bbox, pixel_xy,
    visible_xy, depth_xy, camera_xyz, depth and the depth matrix.
    """
    names = ("pixel_bbox", "pixel_xy", "visible_xy")
    new = found.select("question_id", "view", "color", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in names])
    rows = stored.join(new, ["question_id", "view", "color"], "left")
    x, y = (F.col("_pixel_xy")[i] * depth[i] / max(image[i], 1) for i in (0, 1))
    fresh = {c: F.col(f"_{c}") for c in names} | {"depth_xy": F.array(F.round(x, 3), F.round(y, 3)), "camera_xyz": camera_xyz(x, y, "depth", "fx", "fy", "cx", "cy")}
    changed = F.col("_new").isNotNull() & ~F.col("pixel_bbox").eqNullSafe(F.col("_pixel_bbox"))
    return rows.select(*[F.when(F.col("_new"), fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in stored.columns], changed.alias("changed"))


def numbered(rows: DataFrame, group: str, order: str, keep: Column) -> DataFrame:
    """Ids obj_001 and on for the rows kept, in order within their group."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.where(keep).withColumn("object_id", F.format_string("obj_%03d", n))
