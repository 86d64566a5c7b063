"""Splits, manual review and the clean subset; validation and naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import clean_text, rounded

#: Fixed values of the review sheet.
CANDIDATE, FAILURE = "geometry_available_candidates", "pipeline_failure"
YES = ("yes", "y", "true", "1", "ok", "pass", "passed")
REJECT = ("reject", "rejected", "exclude", "excluded", "bad", "no")
CLEAN = ("", "clean", "clean_subset")
#: Fixed values of question and template documents.
QUESTION_FIELDS = ("answer", "evaluation", "image", "question", "question_id", "target_objects", "type")
QUESTION_TYPES = ("closer_farther", "front_back", "left_right", "occlusion", "physical_size", "support_relation")
TEMPLATE_FIELDS = ("answer", "evaluation", "question", "target_objects", "template_id", "type")


def automatic_split(error_reason: str = "error_reason") -> Column:
    return F.when(F.coalesce(F.col(error_reason) == "missing_target_objects", F.lit(False)), FAILURE).otherwise(CANDIDATE)


def json_list(values: str) -> Column:
    return F.to_json(F.coalesce(F.col(values), F.array().cast("array<string>")))


def review_rows(answers: DataFrame, status: str = "needs manual review") -> DataFrame:
    """The review sheet: every value as text, lists as JSON, five blank fields to fill in."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    split = automatic_split()
    blank = [F.lit("").alias(c) for c in ("mask_ok", "depth_ok", "question_valid", "final_split", "review_notes")]
    return answers.select(
        text("question_id").alias("question_id"), text("image").alias("image"), text("type").alias("type"), json_list("targets").alias("target_objects"), split.alias("automatic_split"),
        F.when(split == CANDIDATE, status).otherwise("pipeline_failure requires upstream review").alias("review_status"),
        text("prediction").alias("prediction"), F.coalesce(F.col("correct"), F.lit(False)).cast("string").alias("correct"), text("error_reason").alias("error_reason"), json_list("missing").alias("missing_target_objects"), *blank,
    )


def is_yes(flag: str) -> Column:
    return clean_text(flag).isin(*YES)


def is_clean() -> Column:
    final = clean_text("final_split")
    return (F.col("automatic_split") == CANDIDATE) & ~final.isin(*REJECT) & final.isin(*CLEAN) & is_yes("mask_ok") & is_yes("depth_ok") & is_yes("question_valid")


def clean_counts(review: DataFrame) -> DataFrame:
    clean = F.count_if(F.coalesce(is_clean(), F.lit(False)) & (F.trim(F.col("question_id").cast("string")) != ""))
    return review.agg(F.count(F.lit(1)).alias("reviewed"), clean.alias("clean"), (F.count(F.lit(1)) - clean).alias("rejected"))


def question_errors(questions: DataFrame) -> DataFrame:
    """(pos, code, detail): missing fields, repeated ids and unknown types, ids counted from their second place on.

    questions: pos and QUESTION_FIELDS, null where missing.
    """
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in QUESTION_FIELDS]), lambda c: c.isNotNull())
    # rows without an id are dealt by place, so that they are no hot key
    seen = F.row_number().over(Window.partitionBy("question_id", F.when(F.col("question_id").isNull(), F.col("pos"))).orderBy("pos"))
    numbered = questions.withColumn("_n", F.when(F.col("question_id").isNotNull(), seen))
    rules = F.array(
        F.struct(F.lit("duplicate_question_id").alias("code"), F.when(F.col("_n") > 1, F.col("question_id").cast("string")).alias("detail")),
        F.struct(F.lit("unknown_type").alias("code"), F.when(~F.col("type").isin(*QUESTION_TYPES), F.col("type")).alias("detail")),
    )
    every = F.concat(F.transform(missing, lambda c: F.struct(F.lit("missing_field").alias("code"), c.alias("detail"))), F.filter(rules, lambda r: r["detail"].isNotNull()))
    return numbered.select("pos", F.explode(every).alias("e")).select("pos", "e.code", "e.detail")


def document_errors(documents: DataFrame) -> DataFrame:
    """(file_name, pos, place, error) of question documents given as text, whatever their types, in the documents' order.

    documents: file_name and value. pos is the question's index, -1 for the document; place orders a question's errors. A null field
    is there; only text ids can repeat; a type or an id that is no text is told as JSON.
    """
    whole = documents.select("file_name", F.try_parse_json("value").alias("v"))
    listed = whole.withColumn("_q", F.try_variant_get("v", "$.questions", "array<variant>"))
    bad = F.when(F.col("v").isNull(), "document is not JSON").when(F.col("_q").isNull(), "top-level field 'questions' must be a list")
    top = listed.select("file_name", F.lit(-1).alias("pos"), F.lit(0).alias("place"), bad.alias("error")).where("error is not null")
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    field = lambda name, to: F.try_variant_get("q", f"$.{name}", to)
    each = listed.select("file_name", F.posexplode("_q").alias("pos", "q")).withColumn("is_object", F.startswith(kind(F.col("q")), F.lit("OBJECT")))
    each = each.withColumn("id", F.when(kind(field("question_id", "variant")) == "STRING", field("question_id", "string")))
    # questions without a text id are dealt by place, so that they are no hot key
    seen = F.row_number().over(Window.partitionBy("file_name", "id", F.when(F.col("id").isNull(), F.col("pos"))).orderBy("pos"))
    each = each.withColumn("nth", F.when(F.col("id").isNotNull(), seen))
    told = F.concat(F.lit("questions["), F.col("pos").cast("string"), F.lit("]"))
    given = lambda name: field(name, "variant").isNotNull() & (kind(field(name, "variant")) != "VOID")
    of_kind = lambda name, start: F.startswith(kind(field(name, "variant")), F.lit(start))
    texts = F.coalesce(F.forall(field("target_objects", "array<variant>"), lambda x: kind(x) == "STRING"), F.lit(False))
    said = F.when(of_kind("type", "STRING"), field("type", "string")).otherwise(F.to_json(field("type", "variant")))
    rules = [F.when(field(name, "variant").isNull(), F.concat(told, F.lit(f" missing required field: {name}"))) for name in QUESTION_FIELDS] + [
        F.when(F.col("nth") > 1, F.concat(told, F.lit(" duplicate question_id: "), F.col("id"))),
        F.when(given("type") & ~F.coalesce(of_kind("type", "STRING") & field("type", "string").isin(*QUESTION_TYPES), F.lit(False)), F.concat(told, F.lit(" unknown type: "), said, F.lit(f". Allowed: {', '.join(QUESTION_TYPES)}"))),
        F.when(given("target_objects") & ~(of_kind("target_objects", "ARRAY") & texts), F.concat(told, F.lit(" target_objects must be a list of strings"))),
        F.when(given("evaluation") & ~of_kind("evaluation", "OBJECT"), F.concat(told, F.lit(" evaluation must be an object"))),
    ]
    errors = F.when(F.col("is_object"), F.array(*rules)).otherwise(F.array(F.concat(told, F.lit(" must be an object"))))
    below = each.select("file_name", "pos", F.posexplode(errors).alias("place", "error")).where("error is not null")
    return top.unionByName(below)


def template_errors(templates: DataFrame) -> DataFrame:
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in TEMPLATE_FIELDS]), lambda c: c.isNotNull())
    return templates.select("pos", F.explode(missing).alias("detail")).select("pos", F.lit("missing_field").alias("code"), "detail")


def template_document_errors(documents: DataFrame) -> DataFrame:
    """(file_name, error) for documents of scene_group and templates that lack a group's name, or templates."""
    tests = [(F.col("scene_group").isNull(), "top-level field 'scene_group' must be a string"), (F.coalesce(F.size("templates"), F.lit(-1)) <= 0, "top-level field 'templates' must be a non-empty list")]
    errors = F.filter(F.array(*[F.when(t, F.lit(e)) for t, e in tests]), lambda e: e.isNotNull())
    return documents.select("file_name", F.explode(errors).alias("error"))


def template_text_errors(documents: DataFrame) -> DataFrame:
    """(file_name, pos, place, error) of template documents given as text, whatever their types, in the documents' order; pos is -1 for the document.

    documents: file_name and value. A null field is there. A document without templates has no further errors.
    """
    whole = documents.select("file_name", F.try_parse_json("value").alias("v"))
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    named = F.coalesce(kind(F.try_variant_get("v", "$.scene_group", "variant")) == "STRING", F.lit(False))
    listed = whole.withColumn("_t", F.try_variant_get("v", "$.templates", "array<variant>"))
    bad = F.filter(F.array(F.when(~named, "top-level field 'scene_group' must be a string"), F.when(F.coalesce(F.size("_t"), F.lit(0)) <= 0, "top-level field 'templates' must be a non-empty list")), lambda e: e.isNotNull())
    top = listed.select("file_name", F.lit(-1).alias("pos"), F.posexplode(F.when(F.col("v").isNull(), F.array(F.lit("document is not JSON"))).otherwise(bad)).alias("place", "error"))
    each = listed.select("file_name", F.posexplode("_t").alias("pos", "t"))
    told = F.concat(F.lit("templates["), F.col("pos").cast("string"), F.lit("]"))
    missing = F.array(*[F.when(F.try_variant_get("t", f"$.{c}", "variant").isNull(), F.concat(told, F.lit(f" missing required field: {c}"))) for c in TEMPLATE_FIELDS])
    errors = F.when(F.startswith(kind(F.col("t")), F.lit("OBJECT")), missing).otherwise(F.array(F.concat(told, F.lit(" must be an object"))))
    return top.unionByName(each.select("file_name", "pos", F.posexplode(errors).alias("place", "error")).where("error is not null"))


def kept_counts(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: questions before and after those not in ids have gone."""
    marked = questions.select("question_id").join(ids.select("question_id").distinct().withColumn("_in", F.lit(True)), "question_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("before"), F.count_if(F.col("_in")).alias("after"))


def split_lists(answers: DataFrame) -> DataFrame:
    """question_id and its automatic split, a row each, in whatever number; the lists of a split file are these rows."""
    return answers.select(F.col("question_id").cast("string").alias("question_id"), automatic_split().alias("automatic_split"))


def with_source(questions: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Questions with their source row as one column ``source``; of rows that share a key the last counts, and a question without one stops the job."""
    last = rows.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("source"), F.lit(True).alias("_there"))
    joined = questions.join(last.withColumnRenamed(key, "_key"), questions["source_id"] == F.col("_key"), "left").drop("_key")
    found = F.when(F.col("_there"), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("no source row for "), F.coalesce(F.col("question_id").cast("string"), F.lit("None")))).cast(joined.schema["source"].dataType))
    return joined.withColumn("source", found).drop("_there")


def has_recommended_name(name: str, prefix: str) -> Column:
    return F.col(name).rlike(rf"(?i)^{prefix}_\d{{4}}(?:_view_\d{{2,}})?\.(jpg|jpeg|png|bmp)$")


def camera_variation(name: str, group: str) -> Column:
    """view_N of a name that is group_view_N, else the name without its suffix."""
    own = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    view = F.regexp_extract(own, r"_(view_\d+)$", 1)
    return F.when((view != "") & (own == F.concat(F.col(group), F.lit("_"), view)), view).otherwise(own)


def expand_templates(images: DataFrame, templates: DataFrame) -> DataFrame:
    """Every template for every image; templates are a written list, so they are sent to the images."""
    stem = F.regexp_replace("image", r"\.[^.]*$", "")
    both = images.crossJoin(templates)
    return both.withColumn("question_id", F.concat_ws("_", stem, F.col("template_id"))).withColumn("camera_variation", camera_variation("image", "scene_group"))


def rename_plan(files: DataFrame, group: str) -> DataFrame:
    """New names by place within the group, in the order of the lower-cased names."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(F.lower("name"), "name")) - 1
    number = F.lpad(at.cast("string"), F.greatest(F.lit(2), F.length(at.cast("string"))), F.lit("0"))
    return files.withColumn("destination", F.concat(F.col(group), F.lit("_view_"), number, F.regexp_extract("name", r"(\.[^.]*)$", 1)))


def rename_conflicts(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Destinations planned twice, and those that exist without being renamed themselves."""
    twice = plan.groupBy("destination").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("destination", F.lit("duplicate destination").alias("conflict"))
    taken = plan.select("destination").distinct().join(existing.select(F.col("name").alias("destination")).distinct(), "destination").join(plan.select(F.col("name").alias("destination")), "destination", "left_anti")
    return twice.unionByName(taken.select("destination", F.lit("destination already exists").alias("conflict")))


def zipped_boxes(images: DataFrame) -> DataFrame:
    """A row per box from a detector's parallel lists: image, pos, conf, cls and box."""
    return images.select("image", F.posexplode(F.arrays_zip("conf", "cls", "boxes")).alias("pos", "z")).select("image", "pos", "z.conf", "z.cls", F.col("z.boxes").alias("box"))


def kept_detections(boxes: DataFrame, names: tuple[str, ...], least: float) -> DataFrame:
    """Detections from a confidence on, classes by name or else by number, numbered in their order."""
    label = F.coalesce(F.get(F.array(*map(F.lit, names)), F.col("cls").cast("int")), F.col("cls").cast("string"))
    kept = boxes.where(F.col("conf") >= least)
    n = F.row_number().over(Window.partitionBy("image").orderBy("pos"))
    return kept.select("image", "pos", F.format_string("obj_%03d", n).alias("object_id"), label.alias("label"), rounded("conf").alias("confidence"))


def normalized_labels(detections: DataFrame, for_image: DataFrame, general: DataFrame, version: Column | None = None) -> DataFrame:
    """Labels by their alias: an image's own alias goes before a general one; the rule applied is kept.

    for_image: image, from, to; general: from, to. With a version of the aliases, null where they have none, every row is stamped with it.
    """
    own = for_image.select("image", F.col("from").alias("label"), F.col("to").alias("_own"))
    all_ = general.select(F.col("from").alias("label"), F.col("to").alias("_all"))
    joined = detections.join(own, ["image", "label"], "left").join(all_, "label", "left")
    to = F.coalesce("_own", "_all")
    rule = F.when(F.col("_own").isNotNull(), "image_label_aliases").otherwise("global_label_aliases")
    changed = to.isNotNull() & (to != F.col("label"))
    return joined.select(*[c for c in detections.columns if c != "label"], F.when(changed, to).otherwise(F.col("label")).alias("label"), F.when(changed, F.col("label")).alias("raw_label"), F.when(changed, rule).alias("rule"), *([] if version is None else [F.coalesce(version, F.lit("unknown")).alias("normalization_config")]))
