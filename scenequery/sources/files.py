"""Files made and moved by tasks: one file a row, such as masks, rasters and documents.

Folders may be any that Arrow's file systems open, shared by all executors. A file is written
under another name and then moved, so that a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pixels import depth_documents
from ..operators.review import rename_conflicts
from . import readers
from .reports import image_exports
from .sinks import check_outputs, delete, finite_columns, moved, npy_file, write_json_lines


def opened(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _each(rows: DataFrame, act: Callable[[str, object], None]) -> int:
    """Call act with both columns of every row, in the tasks; the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                act(a.as_py(), b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_files(rows: DataFrame, folder: str, overwrite: bool = False) -> int:
    """Write content (bytes) of every row to the file of its name, which may lie in a folder of its own; the number of files."""
    check_outputs(rows.sparkSession, [folder], overwrite)
    place: list = []  # a task's file system, its path, and the folders that it has made

    def write(name: str, content: bytes) -> None:
        if not place:
            place.extend((*opened(folder.rstrip("/")), set()))
        system, root, made = place
        path = f"{root}/{name}"
        parent = path.rsplit("/", 1)[0]
        if parent not in made:
            system.create_dir(parent, recursive=True)
            made.add(parent)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(content)
        system.move(part, path)

    return _each(rows.select("name", "content"), write)


def write_archive(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """As write_files(), but the files (name, content) of a task lie together in one compressed archive, a Parquet file.

    Millions of small documents as files of their own take a block of disk, an entry of a listing and several calls each.
    """
    check_outputs(rows.sparkSession, [folder], overwrite)
    rows.select("name", "content").write.mode("overwrite" if overwrite else "errorifexists").parquet(folder)


def json_files(rows: DataFrame, name) -> DataFrame:
    """name and content: each row as a pretty JSON document."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})
    return finite_columns(rows).select(name.alias("name"), F.encode(text, "UTF-8").alias("content"))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_file(lines: np.ndarray, channels: int) -> bytes:
    """A PNG file of lines of bytes, gray or RGB; every line is told by the one of three filters that leaves the smallest differences."""
    height, width = lines.shape[0], lines.shape[1] // channels
    above = np.vstack([np.zeros((1, lines.shape[1]), np.uint8), lines[:-1]])
    left = np.hstack([np.zeros((height, channels), np.uint8), lines[:, :-channels]])
    filtered = np.stack([lines, lines - left, lines - above])  # none, left, above; differences wrap around
    cost = np.minimum(filtered, 256 - filtered.astype(np.int16)).sum(axis=2)
    kinds = cost.argmin(axis=0)
    told = np.hstack([kinds[:, None].astype(np.uint8), filtered[kinds, np.arange(height)]])
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(told.tobytes())) + _chunk(b"IEND", b"")


def png_bytes(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """keys and content: each raster (height, width, values of 0 to 255) as a grayscale PNG file."""
    return _encoded(rasters, keys, "values", lambda h, w, values: png_file(np.array(values, np.uint8).reshape(h, w), 1))


def rgb_png_bytes(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """keys and content: each raster (height, width, rgb, three bytes a pixel) as a colour PNG file."""
    return _encoded(rasters, keys, "rgb", lambda h, w, rgb: png_file(np.frombuffer(rgb, np.uint8).reshape(h, 3 * w), 3))


def _encoded(rasters: DataFrame, keys: list[str], raster: str, encode: Callable) -> DataFrame:
    inner = rasters.select(*keys, "height", "width", raster)
    schema = ", ".join(f"{k} {t}" for k, t in inner.select(*keys).dtypes) + ", content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [encode(h, w, values.as_py()) for h, w, values in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column(raster))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], [*keys, "content"])

    return inner.mapInArrow(run, schema)


#: Names of images, in either case.
IMAGE_GLOB = "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG],[bB][mM][pP]}"


def _images(spark: SparkSession, folder: str) -> DataFrame:
    """name, height, width, nChannels and data of the images of a folder, by their suffix; one that can't be decoded stops the job."""
    images = readers.gathered(spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", IMAGE_GLOB).load(folder)).select("image.*")
    wrong = F.raise_error(F.concat(F.lit("unreadable image: "), "origin")).cast("int")
    return images.select(readers.file_name("origin").alias("name"), F.when(F.col("width") > 0, F.col("height")).otherwise(wrong).alias("height"), "width", "nChannels", "data")


def color_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """name, height, width and rgb (three bytes a pixel in row order) of the images of a folder; gray becomes three equal channels, opacity goes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for channels, data in zip(batch.column("nChannels").to_pylist(), batch.column("data")):
                pixels = np.frombuffer(data.as_py(), np.uint8).reshape(-1, channels)
                out.append((np.repeat(pixels, 3, axis=1) if channels == 1 else pixels[:, 2::-1]).tobytes())  # stored blue first
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "height", "width")), pa.array(out, pa.binary())], ["name", "height", "width", "rgb"])

    return _images(spark, folder).mapInArrow(decode, "name string, height int, width int, rgb binary")


def export_images(rows: DataFrame, folder: str, aside: str, overwrite: bool = False) -> int:
    """Write every image of the rows (question_id, images) as an RGB PNG named by question and place; the number of files.

    The images' own bytes are written to the folder aside first, where Spark's reader decodes them; what is no image, or can't be
    decoded, stops the job before anything is written to the folder.
    """
    spark = rows.sparkSession
    check_outputs(spark, [folder], overwrite)
    write_files(image_exports(rows), aside, overwrite=True)
    decoded = rgb_png_bytes(color_rasters(spark, aside), ["name"])
    ready = f"{aside.rstrip('/')}-ready"
    decoded.select(F.regexp_replace("name", r"\.[^.]*$", ".png").alias("name"), "content").write.mode("overwrite").parquet(ready)
    n = write_files(spark.read.parquet(ready), folder, overwrite)
    delete(spark, aside)
    delete(spark, ready)
    return n


def gray_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """name, height, width and values (gray, 0 to 255) of the images of a folder; one that can't be decoded stops the job."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for channels, data in zip(batch.column("nChannels").to_pylist(), batch.column("data")):
                pixels = np.frombuffer(data.as_py(), np.uint8).reshape(-1, channels).astype(np.float32)
                out.append(pixels[:, 0] if channels == 1 else np.rint(pixels[:, :3] @ np.array([0.114, 0.587, 0.299], np.float32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("name", "height", "width")), pa.array(out, pa.list_(pa.float32()))], ["name", "height", "width", "values"])

    return _images(spark, folder).mapInArrow(decode, "name string, height int, width int, values array<float>")


def mask_pixels(spark: SparkSession, folder: str, height: int, width: int) -> DataFrame:
    """name, x, y and inside of the mask images of a folder, brought to one size by the nearest pixel; inside is above 0."""
    sized = readers.resized(gray_rasters(spark, folder), ["name"], height, width)
    return readers.raster_pixels(sized, ["name"]).select("name", "x", "y", (F.col("d") > 0).alias("inside"))


def depth_outputs(rasters: DataFrame, model: str, folder: str) -> DataFrame:
    """name and content of the three files of every depth raster: its values (.npy), a preview (.png) and its document (.json).

    rasters: image, height, width, values, image_height and image_width; a raster is first brought to its image's size, bicubically.
    """
    stem = F.regexp_replace("image", r"\.[^.]*$", "")
    sized = readers.resizer(("height", "width", "image_height", "image_width"), True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [values.astype(np.float32).reshape(h, w) for h, w, values in sized(batch)]
            out = [pa.array([npy_file(a) for a in arrays], pa.binary()), pa.array([png_file(_shaded(a), 1) for a in arrays], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("image"), *out], ["image", "npy", "png"])

    # a file's bytes come out of the worker that resizes it, as workers that wait for each other in a task take memory each
    inner = rasters.select("image", "height", "width", "values", F.col("image_height").cast("int"), F.col("image_width").cast("int"))
    binary = inner.mapInArrow(encode, "image string, npy binary, png binary")
    each = F.explode(F.array(*[F.struct(F.concat(stem, F.lit(suffix)).alias("name"), F.col(c).alias("content")) for c, suffix in (("npy", "_depth.npy"), ("png", "_depth.png"))]))
    whole = readers.resized_to(rasters, ["image"], "image_height", "image_width")
    documents = json_files(depth_documents(whole, model, folder), F.concat(stem, F.lit("_depth.json")))
    return binary.select(each.alias("f")).select("f.*").unionByName(documents)


def _shaded(raster: np.ndarray) -> np.ndarray:
    """Gray values of a raster from its least to its greatest finite value, truncated; NaN is 0, infinities are the ends."""
    d = raster.astype(float)
    good = d[np.isfinite(d)]
    if not len(good) or not good.max() > good.min():
        return np.zeros(d.shape, np.uint8)
    low, high = good.min(), good.max()
    return np.where(np.isnan(d), 0, np.floor((np.clip(np.where(np.isnan(d), low, d), low, high) - low) / (high - low) * 255)).astype(np.uint8)


def write_files_as_one(rows: DataFrame, folder: str, overwrite: bool = False) -> int:
    """As write_files(), but the folder appears when the last file is there, or not at all; one that stands is replaced by it."""
    spark, folder = rows.sparkSession, folder.rstrip("/")
    check_outputs(spark, [folder], overwrite)
    aside = f"{folder}.writing-{uuid.uuid4().hex}"
    try:
        n = write_files(rows, aside)
        delete(spark, folder)
        moved(spark, aside, folder)
    except BaseException:
        delete(spark, aside)
        raise
    return n


def move_files(plan: DataFrame, folder: str, manifest: str, overwrite: bool = False) -> int:
    """Rename files of a folder (name, destination), all to names of their own first, so that names may be exchanged; the number of files.

    The plan is written to the manifest before anything moves, as a plan made by listing the folder changes on the way.
    Sources that aren't there, and destinations planned twice or that exist and aren't renamed themselves, stop it before
    any move. A move made by an earlier try of a task is left as it is.
    """
    check_outputs(plan.sparkSession, [manifest], overwrite)
    write_json_lines(plan.select("name", "destination"), manifest, overwrite)
    plan = plan.sparkSession.read.schema("name string, destination string").json(manifest)
    existing = plan.sparkSession.read.format("binaryFile").load(folder).select(readers.file_name("path").alias("name"))
    missing = [r["name"] for r in plan.join(existing, "name", "left_anti").limit(5).collect()]
    if missing:
        raise FileNotFoundError(f"no such files, such as {', '.join(missing)}")
    conflicts = [r["destination"] for r in rename_conflicts(plan, existing).limit(5).collect()]
    if conflicts:
        raise FileExistsError(f"conflicting destinations, such as {', '.join(conflicts)}")

    def move(a: str, b: str) -> None:
        system, root = opened(folder.rstrip("/"))
        there = system.get_file_info([f"{root}/{a}", f"{root}/{b}"])
        if there[0].is_file:
            system.move(f"{root}/{a}", f"{root}/{b}")
        elif not there[1].is_file:
            raise FileNotFoundError(f"{root}/{a}")

    held = F.concat(F.lit("renaming-"), F.sha2("destination", 256), F.lit(".part")).alias("held")
    n = _each(plan.select("name", held), move)
    _each(plan.select(held, "destination"), move)
    return n
