"""Readers of the evaluation's files: images, JSON documents, JSON lines, CSV and .npy rasters."""

from __future__ import annotations

import functools
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import col

IMAGE_NAME = r"(?i)\.(jpg|jpeg|png|bmp)$"
#: Documents of the pipeline; files with more fields read as well.
DETECTION = "image string, image_width int, image_height int, model string, objects array<struct<object_id:string,label:string,confidence:double,bbox_xyxy:array<double>>>"
SEGMENTS = "image string, image_width int, image_height int, source_detection string, segmentation_model string, objects array<struct<object_id:string,label:string,confidence:double,bbox_xyxy:array<double>,mask_path:string,mask_area_px:int>>"
QUESTIONS = "version string, description string, question_ids array<string>, questions array<struct<question_id:string,image:string,question:string,type:string,target_objects:array<string>,answer:string,evaluation:struct<metric:string,acceptable_answers:array<string>>>>"


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and name of the images of a folder, by suffix in any case; sort by lower(name) for their order."""
    files = spark.read.format("binaryFile").load(folder).select("path", file_name("path").alias("name"))
    return files.where(F.col("name").rlike(IMAGE_NAME))


def _number(content: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """The whole number of some bytes, from a place counted from 0; null beyond the end."""
    digits = F.hex(F.substring(content, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(size)))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    return F.when(F.length(digits) == 2 * size, F.conv(digits, 16, 10).cast("long"))


def image_kind(content: Column | str) -> Column:
    """png, jpg or bmp by the first bytes; null for others."""
    head = F.hex(F.substring(col(content), 1, 8))
    return F.when(F.startswith(head, F.lit("89504E47")), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpg").when(F.startswith(head, F.lit("424D")), "bmp")


#: Marker segments that a JPEG's header is searched in; files of cameras have some tens before the frame.
SEGMENTS_READ = 512


def _jpeg_size(content: Column) -> Column:
    """A struct of width and height from the frame's segment; the walk goes from segment to segment by their lengths."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(2).cast("long").alias("at"), none.alias("width"), none.alias("height"))

    def step(s: Column, _: Column) -> Column:
        mark, kind, length = (_number(content, s["at"] + k, n) for k, n in ((0, 1), (1, 1), (2, 2)))
        frame = (kind >= 0xC0) & (kind <= 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        bare = (kind == 0x01) | ((kind >= 0xD0) & (kind <= 0xD7))
        after = F.when(mark != 0xFF, none).when(kind == 0xFF, s["at"] + 1).when(bare, s["at"] + 2).when(frame | kind.isin(0xD9, 0xDA), none).when(length >= 2, s["at"] + 2 + length)
        found = lambda k: F.when((mark == 0xFF) & frame, _number(content, s["at"] + k, 2)).otherwise(none)
        moved = F.struct(after.alias("at"), found(7).alias("width"), found(5).alias("height"))
        return F.when(s["at"].isNull(), s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS_READ)), start, step)


def image_size(content: Column | str) -> Column:
    """A struct of width and height, read from the header of PNG, JPEG or BMP bytes; nulls where it can't be."""
    c = col(content)
    kind, jpeg = image_kind(c), F.when(image_kind(c) == "jpg", _jpeg_size(c))
    signed = lambda x: F.abs(F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x))  # noqa: E731  rows of a BMP may go upwards
    sizes = {"width": (16, 18), "height": (20, 22)}
    known = {name: F.when((kind == "png") & (F.hex(F.substring(c, 13, 4)) == "49484452"), _number(c, png, 4)).when(kind == "bmp", signed(_number(c, bmp, 4, little=True))).otherwise(jpeg[name]) for name, (png, bmp) in sizes.items()}
    return F.struct(*[F.when(v > 0, v.cast("int")).alias(name) for name, v in known.items()])


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """name, width, height and valid of the images of a folder, by their headers; a file without a readable one stays, not valid."""
    files = spark.read.format("binaryFile").load(folder).select(file_name("path").alias("name"), image_size("content").alias("s")).where(F.col("name").rlike(IMAGE_NAME))
    valid = F.col("s.width").isNotNull() & F.col("s.height").isNotNull()
    return files.select("name", F.when(valid, F.col("s.width")).alias("width"), F.when(valid, F.col("s.height")).alias("height"), valid.alias("valid"))


def documents(spark: SparkSession, path: str, schema: str | T.StructType, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """One row per JSON document, with the name of its file."""
    reader = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.json(path).withColumn("file_name", F.col("_metadata.file_name"))


def segment_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder, SEGMENTS, "segments.json", recursive=True)


def archived_documents(spark: SparkSession, archive: str, schema: str | T.StructType, pattern: str = r"\.json$") -> DataFrame:
    """As documents(), from an archive of files.write_archive(); pattern tells which names to read. A malformed document stops the job."""
    kept = spark.read.schema("name string, content binary").parquet(archive).where(F.col("name").rlike(pattern))
    parsed = F.from_json(F.decode("content", "UTF-8"), schema, {"mode": "FAILFAST"})
    return kept.select(parsed.alias("d"), file_name("name").alias("file_name")).select("d.*", "file_name")


def archived_segments(spark: SparkSession, archive: str) -> DataFrame:
    return archived_documents(spark, archive, SEGMENTS, r"(^|/)segments\.json$")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question, in the document's order."""
    rows = documents(spark, path, QUESTIONS).select("file_name", F.posexplode("questions").alias("pos", "q"))
    return rows.select("file_name", "pos", "q.*")


def count_questions(spark: SparkSession, path: str) -> DataFrame:
    """file_name and n: how many questions each document of a path holds; no rows' worth, 0, for a path that isn't there, and an error for questions that are no list."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([(path.rsplit("/", 1)[-1], 0)], "file_name string, n int")
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.parse_json("value").alias("v"))
    held = F.try_variant_get("v", "$.questions", "array<variant>")
    wrong = F.raise_error(F.concat(F.lit("questions must be a list in "), "file_name")).cast("int")
    absent = F.try_variant_get("v", "$.questions", "variant").isNull()
    return texts.select("file_name", F.when(held.isNotNull(), F.size(held)).when(absent, 0).otherwise(wrong).alias("n"))


def question_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a subset file: its list of ids, or else its questions'."""
    ids = F.coalesce("question_ids", F.transform("questions", lambda q: q["question_id"]))
    return documents(spark, path, QUESTIONS).select(F.explode(ids).alias("question_id")).distinct()


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """Records of a JSON-lines file. A malformed line stops the job; a line that is no object is left out, or stops it too if strict.

    Blank lines don't count. The error tells the line and its file; json_line_errors() tells all of them by number. The lines are parsed from text, as the reader marks both kinds alike.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path")).where(F.trim("value") != "")
    value = F.try_parse_json("value")
    is_object = F.startswith(F.ltrim(F.col("value")), F.lit("{"))
    checked = F.when(value.isNull(), F.raise_error(F.concat(F.lit("invalid JSON line: "), F.substring("value", 1, 80), F.lit(" in "), "_path")))
    if strict:
        checked = checked.when(~is_object, F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80), F.lit(" in "), "_path")))
    kept = lines.withColumn("_text", checked.otherwise(F.col("value"))).where(F.startswith(F.ltrim(F.col("_text")), F.lit("{")))
    return kept.select(F.from_json("_text", schema).alias("r")).select("r.*")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header, all text; blank fields are empty, not null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns])


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first n of files (name and more) in the order of their lower-case names; equal ones by the names themselves."""
    return files.orderBy(F.lower("name"), "name").limit(n)


def available_columns(rows: DataFrame, wanted: list[str], limit: int | None = None) -> DataFrame:
    """The wanted columns that there are; the scan reads no others."""
    found = rows.select(*[c for c in wanted if c in rows.columns])
    return found if limit is None else found.limit(limit)


#: How many of the reader's tasks, of some 32 small files each, are read as one.
GATHERED = 16


def gathered(files: DataFrame) -> DataFrame:
    """Files in fewer tasks where there are many more than the cores need, as a task of some small files takes longest to start."""
    n, least = files.rdd.getNumPartitions(), 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.coalesce(max(least, n // GATHERED)) if n > least else files


def npy_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """name, height, width and values (row order) of the .npy rasters of a folder."""
    files = gathered(spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder))
    return decoded_rasters(files.select(file_name("path").alias("name"), "content"), ["name"])


def decoded_rasters(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, height, width and values of .npy bytes in content."""
    inner = files.select(*keys, "content")
    schema = ", ".join(f"{k} {t}" for k, t in inner.select(*keys).dtypes) + ", height int, width int, values array<float>"

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rasters = [np.load(io.BytesIO(x.as_py()), allow_pickle=False) for x in batch.column("content")]
            sizes = [pa.array([r.shape[k] for r in rasters], pa.int32()) for k in (0, 1)]
            own = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, *sizes, pa.array([r.astype(np.float32).ravel() for r in rasters], pa.list_(pa.float32()))], [*keys, "height", "width", "values"])

    return inner.mapInArrow(decode, schema)


def raster_pixels(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x, y, d: one row per pixel of rasters with width and values."""
    each = rasters.select(*keys, "width", F.posexplode("values").alias("i", "v"))
    return each.select(*keys, (F.col("i") % F.col("width")).alias("x"), F.expr("cast(i div width as int)").alias("y"), F.col("v").cast("double").alias("d"))


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0.0))


@functools.lru_cache(maxsize=256)
def _weights(source: int, target: int, cubic: bool) -> np.ndarray:
    """Matrix [target, source] of resampling weights with edges repeated."""
    out = np.zeros((target, source))
    if not cubic:
        out[np.arange(target), np.minimum(np.arange(target) * source // target, source - 1)] = 1.0
        return out
    at = (np.arange(target) + 0.5) * source / target - 0.5
    low = np.floor(at).astype(int)
    for k in range(-1, 3):
        np.add.at(out, (np.arange(target), np.clip(low + k, 0, source - 1)), _cubic(at - (low + k)))
    return out


def resized(rasters: DataFrame, keys: list[str], height: int, width: int, method: str = "nearest") -> DataFrame:
    """Rasters (height, width, values) brought to one size, by the nearest pixel or bicubically."""
    cubic = {"nearest": False, "bicubic": True}[method]
    inner = rasters.select(*keys, "height", "width", "values")
    schema = T.StructType([*inner.select(*keys).schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("values", T.ArrayType(T.FloatType()))])

    def resize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, w, values in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("values")):
                raster = np.array(values.as_py(), float).reshape(h, w)
                out.append((_weights(h, height, cubic) @ raster @ _weights(w, width, cubic).T).astype(np.float32).ravel())
            n = batch.num_rows
            own = [batch.column(k) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, pa.array([height] * n, pa.int32()), pa.array([width] * n, pa.int32()), pa.array(out, pa.list_(pa.float32()))], schema.names)

    return inner.mapInArrow(resize, schema)


def resized_to(rasters: DataFrame, keys: list[str], height: str, width: str, method: str = "bicubic") -> DataFrame:
    """keys, height, width and values of rasters (height, width, values), each brought to the size in its own two columns; one of that size stays as it is."""
    cubic = {"nearest": False, "bicubic": True}[method]
    inner = rasters.select(*keys, "height", "width", "values", F.col(height).cast("int").alias("_to_height"), F.col(width).cast("int").alias("_to_width"))
    schema = T.StructType([*inner.select(*keys).schema.fields, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("values", T.ArrayType(T.FloatType()))])
    sized = resizer(("height", "width", "_to_height", "_to_width"), cubic)

    def resize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(c) for c in (*keys, "_to_height", "_to_width")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([v.astype(np.float32).ravel() for _, _, v in sized(batch)], pa.list_(pa.float32()))], schema.names)

    return inner.mapInArrow(resize, schema)


def resizer(sizes: tuple[str, str, str, str], cubic: bool) -> Callable[[pa.RecordBatch], Iterator[tuple[int, int, np.ndarray]]]:
    """For a batch of rasters (values and the columns of height, width and the wanted ones), each one's new height, width and values; one of that size stays as it is."""

    def sized(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for h, w, to_h, to_w, values in zip(*[batch.column(c).to_pylist() for c in sizes], batch.column("values")):
            raster = np.array(values.as_py(), float).reshape(h, w)
            yield to_h, to_w, raster if (h, w) == (to_h, to_w) else _weights(h, to_h, cubic) @ raster @ _weights(w, to_w, cubic).T

    return sized


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1) and value of the lines of text files. A split's lines are numbered by themselves, and its first one's number comes from the counts of the splits before."""
    file, split = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_split")
    lines = spark.read.text(path).select(file, split, "value", F.monotonically_increasing_id().alias("_i"))
    counts = spark.read.text(path).select(file, split).groupBy("path", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))  # a file's splits
    starts = counts.select("path", "_split", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("path", "_split").orderBy("_i"))
    return lines.withColumn("_own", own).join(starts, ["path", "_split"]).select("path", (F.col("_before") + F.col("_own")).alias("line"), "value")


def json_line_errors(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """path, line and error of the lines that json_lines() would stop at."""
    value, text = F.try_parse_json("value"), F.ltrim(F.col("value"))
    error = F.when(value.isNull(), "invalid JSON")
    error = error.when(~F.startswith(text, F.lit("{")), "record must be an object") if strict else error
    return numbered_lines(spark, path).where(F.trim("value") != "").withColumn("error", error).where("error is not null").select("path", "line", "error")


def mask_path_candidates(mask_path: Column | str, segments_path: Column | str, root: str) -> Column:
    """Where a mask may lie, in order: as it is written if absolute, else under the root, then beside its document."""
    p = F.replace(col(mask_path), F.lit("\\"), F.lit("/"))
    beside = F.concat(F.regexp_replace(col(segments_path), r"[^/]*$", ""), file_name(p))
    return F.when(F.startswith(p, F.lit("/")), F.array(p)).otherwise(F.array(F.concat(F.lit(root.rstrip("/") + "/"), p), beside))


def resolved_mask_paths(segments: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """The segments (mask_path, segments_path and more) with mask_file, the first candidate that there is, else the first of all, and mask_there.

    files: path, a listing of what there is, without a scheme. A blank or missing mask_path stops the job.
    """
    wrong = F.raise_error(F.concat(F.lit("Invalid mask_path in "), F.col("segments_path"))).cast("string")
    checked = segments.withColumn("_p", F.when(F.trim(F.coalesce("mask_path", F.lit(""))) == "", wrong).otherwise(F.col("mask_path")))
    paths = checked.withColumn("_c", mask_path_candidates("_p", "segments_path", root))
    each = paths.select(*segments.columns, F.col("_c")[0].alias("_first"), F.get("_c", F.lit(1)).alias("_second"))
    there = files.select("path").distinct()
    for name in ("_first", "_second"):
        each = each.join(there.select(F.col("path").alias(name), F.lit(True).alias(f"{name}_there")), name, "left")
    use_second = F.col("_first_there").isNull() & F.col("_second_there").isNotNull()
    return each.select(*segments.columns, F.when(use_second, F.col("_second")).otherwise(F.col("_first")).alias("mask_file"), F.coalesce("_first_there", "_second_there", F.lit(False)).alias("mask_there"))
