"""Writers that refuse to overwrite unless told to, checked for all outputs before any work."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import json_safe


def _placed(spark: SparkSession, path: str):
    """A path and its file system, in Hadoop's terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _placed(spark, path)
    return system.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, system = _placed(spark, path)
    system.delete(p, True)


def moved(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder to a place where nothing is."""
    (a, system), (b, _) = _placed(spark, source), _placed(spark, target)
    system.mkdirs(b.getParent())
    if system.exists(b) or not system.rename(a, b):
        raise FileExistsError(f"can't move {source} to {target}")


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none where there is no folder."""
    p, system = _placed(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(p)) if system.exists(p) else []


def check_outputs(spark: SparkSession, paths: list[str], overwrite: bool = False) -> None:
    """Stop before any work if an output is there already."""
    there = [] if overwrite else [p for p in paths if exists(spark, p)]
    if there:
        raise FileExistsError(f"Output already exists: {', '.join(there)}")


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def holds_floats(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_floats(f.dataType) for f in kind.fields)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    return holds_floats(inner) if inner is not None else isinstance(kind, (T.DoubleType, T.FloatType))


def finite_value(value: Column, kind: T.DataType) -> Column:
    """The value with every NaN and infinity in it as null, however deep in structs, lists and maps; keys of maps stay."""
    if not holds_floats(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: finite_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: finite_value(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[finite_value(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return json_safe(value)


def finite_columns(rows: DataFrame) -> DataFrame:
    """Rows whose NaN and infinities, at any depth, are null, which JSON can say."""
    return rows.select(*[finite_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields])


def write_json_lines(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    finite_columns(rows).write.mode(_mode(overwrite)).option("ignoreNullFields", False).json(path)


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One row per document, in a file of its own where the rows are partitioned so."""
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"})
    finite_columns(rows).select(text.alias("value")).write.mode(_mode(overwrite)).text(path)


def write_csv(rows: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """Fixed columns under a header; lists joined by semicolons."""
    kinds = dict(rows.dtypes)
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ";").alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]
    rows.select(*flat).write.mode(_mode(overwrite)).option("header", True).option("escape", '"').csv(path)


def write_stage(rows: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """A stage's documents, a folder for each key."""
    rows.write.mode(_mode(overwrite)).partitionBy(key).json(path)


def npy_file(raster: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.save(file, raster)
    return file.getvalue()


def npy_bytes(rasters: DataFrame, keys: list[str]) -> DataFrame:
    """keys and content: each raster (height, width, values) as the bytes of a .npy file."""
    schema = ", ".join(f"{k} {dict(rasters.dtypes)[k]}" for k in keys) + ", content binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [npy_file(np.array(values.as_py(), np.float32).reshape(h, w)) for h, w, values in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("values"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.binary())], [*keys, "content"])

    return rasters.select(*keys, "height", "width", "values").mapInArrow(encode, schema)
