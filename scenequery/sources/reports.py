"""Outputs of several files as one: all of them appear, or none."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, review, select
from .readers import image_kind
from .sinks import check_outputs, delete, exists, listed, moved, write_csv, write_json, write_json_lines

Writer = Callable[[DataFrame, str, bool], None]
#: The folder, in that of the outputs, where complete outputs wait to be moved to their places.
READY = "_ready"


def write_all(spark: SparkSession, folder: str, outputs: dict[str, tuple[DataFrame, Writer]], overwrite: bool = False) -> list[str]:
    """Write every output under its name in the folder; the paths.

    Outputs are written in a folder aside, which one rename declares ready when the last is there; a writer that fails leaves nothing,
    and a job that dies before that leaves none of the outputs. They then move to their places; a job that dies meanwhile is completed
    by complete(), which the next write_all() to the folder begins with.
    """
    folder = folder.rstrip("/")
    complete(spark, folder)
    paths = {name: f"{folder}/{name}" for name in outputs}
    check_outputs(spark, list(paths.values()), overwrite)
    aside = f"{folder}/_writing-{uuid.uuid4().hex}"
    try:
        for name, (rows, write) in outputs.items():
            write(rows, f"{aside}/{name}", False)
        moved(spark, aside, f"{folder}/{READY}")
    except BaseException:
        delete(spark, aside)
        raise
    complete(spark, folder)
    return list(paths.values())


def complete(spark: SparkSession, folder: str) -> None:
    """Move outputs that are ready to their places, over what stands there."""
    ready = f"{folder.rstrip('/')}/{READY}"
    for name in listed(spark, ready):
        delete(spark, f"{folder}/{name}")
        moved(spark, f"{ready}/{name}", f"{folder}/{name}")
    if exists(spark, ready):
        delete(spark, ready)


def _csv(*columns: str) -> Writer:
    return lambda rows, path, overwrite: write_csv(rows, path, list(columns), overwrite)


def write_splits(answers: DataFrame, folder: str, overwrite: bool = False) -> list[str]:
    """A split for every question, their counts, and the review sheet."""
    kept = answers.persist()
    lists = review.split_lists(kept)
    sheet = review.review_rows(kept)
    paths = write_all(answers.sparkSession, folder, {
        "splits": (lists, write_json_lines), "counts": (lists.groupBy("automatic_split").agg(F.count(F.lit(1)).alias("n")), write_json), "review.csv": (sheet, _csv(*sheet.columns)),
    }, overwrite)
    kept.unpersist()
    return paths


def write_clean_subset(questions: DataFrame, reviewed: DataFrame, folder: str, overwrite: bool = False) -> list[str]:
    """The clean questions, their ids, and counts of the review and of questions before and after."""
    ids = reviewed.where(review.is_clean()).select("question_id").persist()
    counts = review.clean_counts(reviewed).crossJoin(review.kept_counts(questions, ids))  # single rows
    paths = write_all(questions.sparkSession, folder, {"questions": (questions.join(ids, "question_id", "left_semi"), write_json_lines), "question_ids": (ids, write_json_lines), "counts": (counts, write_json)}, overwrite)
    ids.unpersist()
    return paths


def write_failures(answers: DataFrame, folder: str, overwrite: bool = False) -> list[str]:
    """Failures by image as CSV, by label, and in all."""
    kept = answers.persist()
    labels = metrics.histogram(kept.where(F.col("error_reason") == "missing_target_objects").select(F.explode("missing").alias("label")), F.col("label"))
    images = metrics.failures_by_image(kept)
    paths = write_all(answers.sparkSession, folder, {"by_image.csv": (images, _csv("image", "missing_record_count", "missing_labels", "question_ids")), "by_label": (labels, write_json_lines), "totals": (metrics.failure_totals(kept), write_json)}, overwrite)
    kept.unpersist()
    return paths


def write_selection(selection: DataFrame, prefix: str, folder: str, overwrite: bool = False) -> list[str]:
    """The selected rows in the evaluation's shape, the reasons of the others, the audit and the fingerprint."""
    kept = selection.persist()
    chosen = select.converted(kept.where("selected"), prefix)
    left = kept.where("not selected").select(F.col("id").alias("source_id"), "reasons", "task")
    paths = write_all(selection.sparkSession, folder, {"questions": (chosen, write_json_lines), "excluded": (left, write_json_lines), "audit": (select.selection_audit(kept), write_json_lines), "fingerprint": (select.fingerprint(kept), write_json)}, overwrite)
    kept.unpersist()
    return paths


def image_exports(rows: DataFrame) -> DataFrame:
    """name and content of every image of a row, named by question and place; another kind of image than PNG, JPEG or BMP bytes stops the job.

    rows: question_id, images (array of bytes).
    """
    each = rows.select("question_id", F.posexplode("images").alias("i", "content"))
    kind = F.coalesce(image_kind("content"), F.raise_error(F.concat(F.lit("unsupported image of "), F.col("question_id").cast("string"))).cast("string"))
    return each.select(F.concat(F.format_string("%s_view_%02d", F.col("question_id").cast("string"), "i"), F.lit("."), kind).alias("name"), "content")


def stamped(rows: DataFrame, name: str = "created_at") -> DataFrame:
    """Rows with the time of the query in UTC, to the second, as ISO text."""
    now = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))
    return rows.withColumn(name, F.concat(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
