"""Audits of geometry, prompts and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import clean_text
from .answers import required_colors
from .geometry import distance
from .prompts import DISTANCE_TASK, RELATION_TASK

FRONT_LOADED = (DISTANCE_TASK, RELATION_TASK)


def available_colors(points: DataFrame) -> DataFrame:
    return points.groupBy("question_id").agg(F.collect_set("color").alias("available"), F.map_from_entries(F.collect_list(F.struct("color", "camera_xyz"))).alias("xyz"))


#: Columns of a benchmark row that refer to points, objects or regions without their answer.
REFERENCES = ("points", "point", "point_annotations", "objects", "object_annotations", "regions")


def has_reference(rows: DataFrame) -> Column:
    """Whether any of REFERENCES that the rows have is neither null nor an empty list or map."""
    kinds = dict(rows.dtypes)
    there = [F.col(c).isNotNull() & (F.size(c) > 0 if kinds[c].startswith(("array", "map")) else F.lit(True)) for c in REFERENCES if c in kinds]
    return F.exists(F.array(*there), lambda x: x) if there else F.lit(False)


def task_status(questions: DataFrame, points: DataFrame) -> DataFrame:
    """status and reason of every question: whether its markers, or any, or another reference are there."""
    joined = questions.join(available_colors(points), "question_id", "left")
    available = F.coalesce("available", F.array().cast("array<string>"))
    required = required_colors("question")
    lacks = F.size(F.array_except(required, available)) > 0
    bare = F.col("task").rlike(r"_o[co]\s*$") & (F.size(available) == 0) & ~has_reference(questions)
    reason = F.when(lacks, "required_marker_missing").when(bare, "no_point_or_object_reference")
    return joined.select(*questions.columns, required.alias("required"), F.array_sort(available).alias("available"), F.coalesce("xyz", F.create_map().cast("map<string,array<double>>")).alias("xyz"), F.when(reason.isNull(), "available").otherwise("geometry_unavailable").alias("status"), reason.alias("reason"))


def geometry_records(status: DataFrame, views: DataFrame, points: DataFrame, pairs: DataFrame) -> DataFrame:
    """One record a question: its status, its views in order with their depth, markers and relations, and how many views have depth.

    status: task_status(); views: question_id, view, depth_valid and more; points and pairs: by question_id and view.
    """
    keys = ["question_id", "view"]
    marks = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "color", "px", "py", "depth", "camera_xyz"))).alias("markers"))
    related = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pair", "euclidean_distance", "depth_difference"))).alias("marker_relations"))
    each = views.join(marks, keys, "left").join(related, keys, "left")
    one = F.struct("view", *[c for c in views.columns if c not in keys], "markers", "marker_relations")
    whole = each.groupBy("question_id").agg(F.array_sort(F.collect_list(one)).alias("views"), F.count(F.lit(1)).alias("view_count"), F.count_if("depth_valid").alias("available_view_count"))
    kept = status.select("question_id", "task", F.col("status").alias("task_geometry_status"), "required", F.col("reason").alias("unavailable_reason"))
    return kept.join(whole, "question_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("view_count", "available_view_count")})


def label_conflict() -> Column:
    """Whether the gold option names another colour than the distances say."""
    red, green, blue = (F.try_element_at("xyz", F.lit(c)) for c in ("red", "green", "blue"))
    g, b = distance(red, green), distance(red, blue)
    farther = F.contains(F.lower("question"), F.lit("farther"))
    expected = F.when(farther, F.when(g >= b, "green").otherwise("blue")).otherwise(F.when(g <= b, "green").otherwise("blue"))
    line = F.lower(F.coalesce(F.get(F.filter(F.split("question", "\n"), lambda x: x.rlike(r"^[A-D]\.") & (F.substring(x, 1, 1) == F.upper("answer"))), F.lit(0)), F.lit("")))
    gold = F.when(F.contains(line, F.lit("(green point)")), "green").when(F.contains(line, F.lit("(blue point)")), "blue")
    conflict = F.when(g.isNull() | b.isNull(), True).otherwise(~gold.eqNullSafe(expected))
    return F.when((F.col("status") == "available") & (F.col("task") == DISTANCE_TASK), conflict).otherwise(False)


def geometry_audit(status: DataFrame) -> DataFrame:
    missing = F.array_sort(F.array_except("required", "available"))
    rows = status.select("question_id", "task", "status", "reason", missing.alias("missing"), label_conflict().alias("label_conflict"))
    return rows.withColumn("ready", (F.col("status") == "available") & (F.size("missing") == 0) & ~F.col("label_conflict"))


def audit_of_questions(questions: DataFrame, audit: DataFrame) -> DataFrame:
    """The audit of every question; one whose geometry there is none of has the status missing_geometry and isn't ready.

    audit: geometry_audit() of the questions that have geometry.
    """
    found = audit.select(F.col("question_id").alias("_id"), "status", "reason", "missing", "label_conflict", "ready")
    joined = questions.select("question_id", "task").join(found, F.col("question_id") == F.col("_id"), "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return joined.select("question_id", F.when(F.col("status").isNotNull(), F.col("task")).alias("task"), F.coalesce("status", F.lit("missing_geometry")).alias("status"), "reason", F.coalesce("missing", F.array().cast("array<string>")).alias("missing"), flag("label_conflict"), flag("ready"))


def audit_counts(rows: DataFrame) -> DataFrame:
    """kind, value and n of audit_of_questions(): questions, those available, unavailable and in conflict, also where there are none, then statuses and missing markers."""
    totals = rows.agg(F.count(F.lit(1)).alias("questions"), F.count_if("ready").alias("available"), F.count_if(~F.col("ready")).alias("unavailable"), F.count_if("label_conflict").alias("label_conflict"))
    held = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.lit("").alias("value"), F.col(c).alias("n")) for c in totals.columns])).alias("t")).select("t.*")
    each = F.concat(F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("value"))), F.transform("missing", lambda c: F.struct(F.lit("missing_marker").alias("kind"), c.alias("value"))))
    return held.unionByName(rows.select(F.explode(each).alias("e")).groupBy("e.kind", "e.value").agg(F.count(F.lit(1)).alias("n")))


def removal_audit(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """question_id, removed (whether its geometry isn't ready), and how many questions there were and how many went.

    rows: audit_of_questions(). Ids of a subset that repeat count each time.
    """
    gone = rows.where("not ready").select(F.col("question_id").alias("_id")).distinct()
    marked = questions.select("question_id").join(gone, F.col("question_id") == F.col("_id"), "left").select("question_id", F.col("_id").isNotNull().alias("removed"))
    counts = marked.agg(F.count(F.lit(1)).alias("source_question_count"), F.count_if("removed").alias("removed_question_count"))
    return marked.crossJoin(counts)  # one row


def ready_subset(questions: DataFrame, audit: DataFrame) -> DataFrame:
    return questions.join(audit.where("not ready").select("question_id"), "question_id", "left_anti")


def prompt_audit(prompts: DataFrame, track: str = "image_and_geometry") -> DataFrame:
    """How every prompt begins, and whether its task needs a decision aid there."""
    p = F.try_element_at("prompts", F.lit(track))
    return prompts.select(
        "question_id", clean_text("task").alias("task"), F.coalesce(F.startswith(p, F.lit("\n")), F.lit(False)).alias("starts_with_newline"),
        F.coalesce(F.startswith(p, F.lit("Decision aid:")), F.lit(False)).alias("starts_with_decision_aid"), clean_text("task").isin(*FRONT_LOADED).alias("needs_decision_aid"), F.length(p).alias("prompt_length"),
    )


def readiness(subset: DataFrame, prompts: DataFrame) -> DataFrame:
    """One row: counts, ids that one side lacks, and whether all is ready."""
    a, b = subset.select("question_id"), prompts.select("question_id")
    sides = a.distinct().withColumn("s", F.lit(1)).join(b.distinct().withColumn("p", F.lit(1)), "question_id", "full")
    gaps = sides.agg(F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"))
    audit = prompt_audit(prompts).agg(F.count(F.lit(1)).alias("prompt_count"), F.count_if("starts_with_newline").alias("leading_newline"), F.count_if(F.col("needs_decision_aid") & ~F.col("starts_with_decision_aid")).alias("missing_decision_aid"))
    whole = a.agg(F.count(F.lit(1)).alias("subset_count")).crossJoin(gaps).crossJoin(audit)  # single rows
    ready = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("subset_count") == F.col("prompt_count")) & (F.col("leading_newline") == 0) & (F.col("missing_decision_aid") == 0)
    return whole.withColumn("ready", ready)
