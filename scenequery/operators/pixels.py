"""Statistics over rasters held as one row per pixel: (keys..., x, y, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import col, finite, rounded
from .parts import largest_part


def _if(keep: Column, value: Column | str) -> Column:
    return F.when(keep, col(value))


def mask_columns(inside: Column, width: int, height: int) -> list[Column]:
    """Aggregates: area, area share, bounds and centroid of a mask; nulls where it has no pixels."""
    area = F.count_if(inside)
    bounds = [F.min(_if(inside, "x")), F.min(_if(inside, "y")), F.max(_if(inside, "x")), F.max(_if(inside, "y"))]
    centroid = F.array(rounded(F.avg(_if(inside, "x"))), rounded(F.avg(_if(inside, "y"))))
    return [
        area.alias("mask_area_px"),
        rounded(area / F.lit(float(width * height))).alias("mask_area_fraction"),
        F.when(area > 0, F.array(*[b.cast("int") for b in bounds])).alias("mask_bounds_xyxy"),
        F.when(area > 0, centroid).alias("mask_centroid"),
    ]


def mask_geometry(pixels: DataFrame, keys: list[str], inside: Column, width: int, height: int) -> DataFrame:
    """The mask of each group; one without pixels keeps its row, with nulls."""
    return pixels.groupBy(*keys).agg(*mask_columns(inside, width, height))


def mask_bounds(pixels: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """Bounds for drawing: zeros for a mask without pixels."""
    edge = lambda f, c: F.coalesce(f(_if(inside, c)), F.lit(0)).cast("int")
    return pixels.groupBy(*keys).agg(edge(F.min, "x").alias("x0"), edge(F.min, "y").alias("y0"), edge(F.max, "x").alias("x1"), edge(F.max, "y").alias("y1"))


def depth_columns(inside: Column, prefix: str = "relative_depth_") -> list[Column]:
    """Aggregates: min, max, mean, median, 10th and 90th percentile of the finite depths inside; nulls where there are none."""
    d = _if(inside & finite("d"), "d")
    tails = F.percentile(d, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    stats = {"min": F.min(d), "max": F.max(d), "mean": F.avg(d), "median": F.get(tails, F.lit(1)), "p10": F.get(tails, F.lit(0)), "p90": F.get(tails, F.lit(2))}
    return [rounded(v).alias(prefix + k) for k, v in stats.items()]


def depth_stats(pixels: DataFrame, keys: list[str], inside: Column, prefix: str = "relative_depth_") -> DataFrame:
    return pixels.groupBy(*keys).agg(*depth_columns(inside, prefix))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which nulls are equal; the right side's further columns follow."""
    named = right.select(*[F.col(k).alias(f"_right{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_right{i}")) for i, k in enumerate(keys)]
    return left.join(named, same, how).drop(*[f"_right{i}" for i in range(len(keys))])


def selected_quantiles(values: DataFrame, keys: list[str], value: str, shares: list[float], buckets: int = 64) -> DataFrame:
    """keys and ``quantiles``, exact and linearly interpolated, of groups of any size; for groups that one task can hold, F.percentile is shorter.

    A mergeable sketch cuts each group into buckets of about equal numbers; counting them tells which buckets hold the wanted ranks, and
    only those buckets' values, equal ones counted together, are sorted, each bucket by itself. Nulls don't count; NaN is largest.
    """
    rows = values.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    edges = F.percentile_approx("_v", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(10000))
    cut = rows.groupBy(*keys).agg(F.array_distinct(edges).alias("_edges"), F.count(F.lit(1)).alias("_n"))
    cut = cut.withColumn("_edges", F.concat("_edges", F.array_repeat(F.lit(float("nan")), buckets)))  # NaN: above every value
    placed = _joined(rows, cut, keys).withColumn("_b", F.lit(0))
    step = 1 << (buckets - 1).bit_length() >> 1
    while step:  # how many edges lie below the value, by halving
        placed = placed.withColumn("_b", F.when(F.get("_edges", F.col("_b") + step - 1) < F.col("_v"), F.col("_b") + step).otherwise(F.col("_b")))
        step >>= 1
    placed = placed.drop("_edges")
    counts = placed.groupBy(*keys, "_b", "_n").agg(F.count(F.lit(1)).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # the buckets' rows
    starts = counts.withColumn("_start", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    at = F.transform(F.array(*map(F.lit, shares)), lambda p: (F.col("_n") - 1) * p)
    ranks = F.array_distinct(F.flatten(F.transform(at, lambda h: F.array(F.floor(h), F.ceil(h)))))
    wanted = starts.withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_m")))).where(F.size("_ranks") > 0)
    inside = _joined(placed, wanted.select(*keys, "_b", "_start", "_ranks"), [*keys, "_b"])
    distinct = inside.groupBy(*keys, "_n", "_b", "_v", "_start", "_ranks").agg(F.count(F.lit(1)).alias("_m"))
    own = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("_m").over(own), F.lit(0))
    held = distinct.withColumn("_first", first).withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_m")))))
    found = held.groupBy(*keys, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"))  # two ranks a share
    value_at = lambda r: F.try_element_at("_at", r)
    return found.select(*keys, F.transform(at, lambda h: value_at(F.floor(h)) * (1 - (h - F.floor(h))) + value_at(F.ceil(h)) * (h - F.floor(h))).alias("quantiles"))


def depth_stats_large(pixels: DataFrame, keys: list[str], inside: Column, prefix: str = "relative_depth_") -> DataFrame:
    """As depth_stats(), for groups of more pixels than one task holds; groups without a depth inside keep their row, with nulls."""
    d = _if(inside & finite("d"), "d")
    plain = pixels.groupBy(*keys).agg(F.min(d).alias("_min"), F.max(d).alias("_max"), F.avg(d).alias("_mean"))
    found = selected_quantiles(pixels.withColumn("_d", d), keys, "_d", [0.5, 0.1, 0.9])
    joined = _joined(plain, found, keys, "left")
    stats = {"min": F.col("_min"), "max": F.col("_max"), "mean": F.col("_mean")} | {k: F.get("quantiles", F.lit(i)) for i, k in enumerate(("median", "p10", "p90"))}
    return joined.select(*keys, *[rounded(v).alias(prefix + k) for k, v in stats.items()])


def depth_stats_positive(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """As depth_stats over finite depths above zero, with their count and whether there are any."""
    inside = finite("d") & (F.col("d") > 0)
    found = pixels.groupBy(*keys).agg(F.count_if(inside).alias("valid_pixel_count"), *depth_columns(inside, "depth_"))
    return found.withColumn("valid", F.col("valid_pixel_count") > 0)


def depth_range(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Least and greatest finite depth and their difference; zeros where there are none."""
    d = _if(finite("d"), "d")
    low, high = F.coalesce(F.min(d), F.lit(0.0)), F.coalesce(F.max(d), F.lit(0.0))
    return pixels.groupBy(*keys).agg(low.alias("depth_min"), high.alias("depth_max"), (high - low).alias("depth_range"), F.coalesce(F.avg(d), F.lit(0.0)).alias("depth_mean"))


def preview_u8(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Depths scaled to 0..255, truncated: NaN counts as 0, infinities as 1 and 0; a constant raster gives 0."""
    d = F.when(F.col("d").isNull() | F.isnan("d"), 0.0).when(F.col("d") == float("inf"), 1.0).when(F.col("d") == float("-inf"), 0.0).otherwise(F.col("d"))
    whole = pixels.withColumn("d", d)
    span = whole.groupBy(*keys).agg(F.min("d").alias("_low"), F.max("d").alias("_high"))
    scaled = (F.col("d") - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * 255
    return whole.join(span, keys).select(*keys, "x", "y", F.coalesce(F.floor(scaled), F.lit(0)).cast("int").alias("u8"))


def mask_u8(pixels: DataFrame, keys: list[str], scale: int = 1) -> DataFrame:
    """A mask raster of 0 and 255, every ``scale`` x ``scale`` pixels of the result from the nearest one here."""
    step = F.sequence(F.lit(0), F.lit(scale - 1))
    value = F.when(F.col("d") > 0.5, 255).otherwise(0).alias("u8")
    big = pixels.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
    return big.select(*keys, (F.col("x") * scale + F.col("_i")).cast("int").alias("x"), (F.col("y") * scale + F.col("_j")).cast("int").alias("y"), value)


def near_depth(pixels: DataFrame, points: DataFrame, keys: list[str], radii: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Median of the finite positive depths around a point, in the first of the square neighbourhoods that has any; its count.

    points: keys, px, py. Both sides meet by keys, pixels outside the widest square drop in the join.
    """
    at = points.select(*keys, F.bround("px").cast("int").alias("_cx"), F.bround("py").cast("int").alias("_cy"))
    away = F.greatest(F.abs(F.col("x") - F.col("_cx")), F.abs(F.col("y") - F.col("_cy")))
    near = at.join(pixels.where(finite("d") & (F.col("d") > 0)), keys).where(away <= max(radii))
    found = near.groupBy(*keys).agg(*[rounded(F.median(_if(away <= r, "d"))).alias(f"_m{r}") for r in radii], *[F.count_if(away <= r).alias(f"_n{r}") for r in radii])
    count = F.lit(0).cast("long")
    for r in reversed(radii):
        count = F.when(F.col(f"_n{r}") > 0, F.col(f"_n{r}")).otherwise(count)
    joined = points.select(*keys).join(found, keys, "left")
    return joined.select(*keys, F.coalesce(*[F.col(f"_m{r}") for r in radii]).alias("depth"), F.coalesce(count, F.lit(0)).cast("long").alias("depth_sample_count"))


def largest_component(mask: np.ndarray) -> np.ndarray:
    """Pixels of the largest 8-connected part of a mask; of equal ones, that with the first pixel in row order."""
    out = np.zeros_like(mask, bool)
    out[largest_part(mask)] = True
    return out


def component_geometry(rasters: DataFrame, keys: list[str], raster: str, width: int, threshold: float) -> DataFrame:
    """Pixel count, bounds and medians of the largest component above the threshold, one row per raster that has one.

    ``raster`` is an array column in row order; a raster is one row, so batches of any rows do.
    """
    inner = rasters.select(*keys, raster)
    fields = [T.StructField(c, T.LongType()) for c in ("n_pixels", "x0", "y0", "x1", "y1")] + [T.StructField(c, T.DoubleType()) for c in ("mid_x", "mid_y")]
    schema = T.StructType([*inner.select(*keys).schema.fields, *fields])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, rows = [], []
            for i, cells in enumerate(batch.column(raster)):
                values = np.array(cells.as_py() or [], float)
                ys, xs = largest_part(values.reshape(-1, width) > threshold)
                if len(xs):
                    which.append(i)
                    rows.append((len(xs), xs.min(), ys.min(), xs.max(), ys.max(), np.median(xs), np.median(ys)))
            own = [batch.column(k).take(pa.array(which, pa.int64())) for k in keys]
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(own + [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], schema.names)

    return inner.mapInArrow(find, schema)


#: Least value of a marker's own channel, and by how much it exceeds both others.
MARKER_COLORS = {"red": (220, 150), "green": (100, 100), "blue": (180, 150)}


def color_mask(color: str) -> Column:
    """1 where a pixel of the channels red, green and blue (arrays in row order) is saturated in one colour, else 0."""
    least, over = MARKER_COLORS[color]
    value = lambda p, c: p[c].cast("int")
    others = [c for c in MARKER_COLORS if c != color]
    shown = lambda p: (value(p, color) >= least) & (value(p, color) - F.greatest(*[value(p, c) for c in others]) >= over)
    return F.transform(F.arrays_zip("red", "green", "blue"), lambda p: shown(p).cast("double"))


def color_markers(images: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The largest part of each marker colour of RGB images: component_geometry() with color, pixel_bbox, pixel_xy and visible_xy."""
    masks = F.explode(F.array(*[F.struct(F.lit(c).alias("color"), color_mask(c).alias("mask")) for c in MARKER_COLORS]))
    found = component_geometry(images.select(*keys, masks.alias("m")).select(*keys, "m.color", "m.mask"), [*keys, "color"], "mask", width, 0.5)
    center = F.array((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    box = F.array(*[F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")])
    return found.select(*keys, "color", "n_pixels", box.alias("pixel_bbox"), center.alias("pixel_xy"), F.array("mid_x", "mid_y").alias("visible_xy"))


#: Fixed values of the depth documents.
DEPTH_FORMAT, DEPTH_NOTE = "relative_depth_float32_npy", "Depth Anything V2 outputs relative monocular depth, not metric distance."


def depth_documents(rasters: DataFrame, model: str, folder: str) -> DataFrame:
    """The document of every depth raster (image, width, height, values): where it lies, its shape, and statistics of its finite depths."""
    good = F.filter(F.transform("values", lambda v: v.cast("double")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    stem = F.regexp_replace("image", r"\.[^.]*$", "")
    sums = F.aggregate("_g", F.lit(0.0), lambda a, v: a + v)
    rows = rasters.withColumn("_g", good)
    return rows.select(
        "image", F.col("width").alias("image_width"), F.col("height").alias("image_height"), F.lit(model).alias("model"), F.lit(DEPTH_FORMAT).alias("depth_format"),
        F.concat(F.lit(f"{folder}/"), stem, F.lit("_depth.npy")).alias("depth_path"), F.concat(F.lit(f"{folder}/"), stem, F.lit("_depth.png")).alias("visualization_path"), F.array("height", "width").alias("depth_shape"),
        F.array_min("_g").alias("depth_min"), F.array_max("_g").alias("depth_max"), F.when(F.size("_g") > 0, sums / F.size("_g")).alias("depth_mean"), F.lit(DEPTH_NOTE).alias("depth_note"),
    )
