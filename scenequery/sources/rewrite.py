"""Rewriting a stored table in place: only partitions that change, by way of a staged copy."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import delete, exists, moved


def rewrite_changed(spark: SparkSession, path: str, part: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Apply ``change`` (rows with a further column ``changed``) to the Parquet table at path; the number of changed rows.

    The table is partitioned by ``part``. Partitions without a changed row are neither written nor touched. The others are first
    written beside the table; only when that copy is complete do they take their places, each by renames. A run that died before leaves
    the table as it was, and one that died while partitions took their places is completed by the next run, which begins with that.
    """
    finish(spark, path, part)
    rows = change(spark.read.parquet(path))
    counts = rows.groupBy(part).agg(F.count_if("changed").alias("n")).where("n > 0").collect()  # one row for each changed partition
    if not counts:
        return 0
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    wanted = [r[part] for r in counts]
    inside = F.col(part).isin([w for w in wanted if w is not None])
    rows.where(inside | F.col(part).isNull() if None in wanted else inside).drop("changed").repartition(part).write.partitionBy(part).parquet(staged)
    moved(spark, staged, f"{path}.ready")
    finish(spark, path, part)
    return sum(r["n"] for r in counts)


def finish(spark: SparkSession, path: str, part: str) -> None:
    """Put the partitions of a complete staged copy in their places."""
    ready = f"{path}.ready"
    if not exists(spark, ready):
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(ready)
    for status in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place):
        name = status.getPath().getName()
        if name.startswith(f"{part}="):
            delete(spark, f"{path}/{name}")
            moved(spark, f"{ready}/{name}", f"{path}/{name}")
    delete(spark, ready)
