"""Shared pieces: tables in the cluster's shared folder, running totals, words."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from functools import lru_cache

import numpy as np
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words for the operators that split on ASCII white space only.
SPACE_WORDS = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables made by saved() that still stand, with their thread and the Hadoop settings that reach them.
_standing: dict[str, tuple[int, object]] = {}


@lru_cache(maxsize=None)
def _own_folder(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="scenequery-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests); an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    Tables that nobody discards are deleted when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scenequery-{label}-{uuid.uuid4().hex}"
    _standing[path] = threading.get_ident(), spark._jsc.hadoopConfiguration()
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._saved_path = path
    return again


def _delete(path: str) -> None:
    _, settings = _standing.pop(path, (0, None))
    if settings is not None:
        place = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(settings).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by saved() that nothing reads any more."""
    for table in tables:
        _delete(table._saved_path)


def standing() -> set[str]:
    """The tables of saved() that stand now, to be kept by discard_others()."""
    return set(_standing)


def discard_others(keep: set[str], *tables: DataFrame) -> None:
    """Delete all tables that this thread made by saved() but those in keep and those given."""
    own = {path for path, (thread, _) in _standing.items() if thread == threading.get_ident()}
    for path in own - keep - {t._saved_path for t in tables}:
        _delete(path)


@atexit.register
def _tidy() -> None:
    for path in list(_standing):
        with contextlib.suppress(Exception):  # the cluster may be gone by now
            _delete(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_hashes(df: DataFrame) -> list[Column]:
    """Two hashes of all columns of a row; columns that hold maps, which have no hash, count by their JSON."""
    values = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return [F.xxhash64(F.lit(k), *values) for k in (0, 1)]


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str, label: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are range-partitioned by group and order, so a hot group is spread over many
    partitions; only one subtotal per partition and group is summed up centrally. Rows
    that agree in all of ``order`` follow each other in no fixed order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()), label)
    within = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("_pid", *group)
        .agg(F.sum(value).alias("_sum"))
        .select("_pid", *group, F.coalesce(F.sum("_sum").over(pieces), F.lit(0)).alias("_start"))
    )
    rows = dealt.withColumn(out, F.coalesce(F.sum(value).over(within), F.lit(0)))
    right = starts.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(["_pid", *group])], "_start")
    same = [rows[c].eqNullSafe(right[f"_r{i}"]) for i, c in enumerate(["_pid", *group])]
    joined = rows.join(right, same, "inner")
    return joined.select(*df.columns, (F.col(out) + F.col("_start")).cast("long").alias(out))


class WordHashes(dict):
    """64-bit hashes of words (bytes), each computed once per batch."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every run of n words; the whole sequence is one run if it is shorter."""
    if not len(words):
        return words
    n_here = min(n, len(words))
    total = np.zeros(len(words) - n_here + 1, np.uint64)
    for k in range(n_here):
        total = mixed(total + words[k : len(words) - n_here + 1 + k] * _ODD[k % len(_ODD)] + np.uint64(n_here))
    return total
