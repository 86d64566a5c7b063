"""Accuracy, coverage and failure summaries as grouped aggregates."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import clean_text, key_text, ratio, rounded


def answered(loose: bool = True) -> Column:
    """Whether there is a prediction; loosely, case and spaces don't count."""
    p = clean_text("prediction") if loose else F.coalesce("prediction", F.lit("None"))
    return p != "unknown"


def right() -> Column:
    return F.coalesce("correct", F.lit(False))


def counts(loose: bool = True) -> list[Column]:
    total, n, good = F.count(F.lit(1)), F.count_if(answered(loose)), F.count_if(right())
    return [
        total.alias("total"),
        n.alias("answered"),
        (total - n).alias("unknown"),
        good.alias("correct_count"),
        ratio(good, n).alias("answered_accuracy"),
        ratio(good, total).alias("accuracy"),
        ratio(n, total).alias("coverage"),
    ]


def summary(results: DataFrame, by: list[str], loose: bool = True) -> DataFrame:
    """Counts and ratios of every group; a null key is the group None."""
    keyed = results.withColumns({c: key_text(c) for c in by})
    return keyed.groupBy(*by).agg(*counts(loose))


def rule_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """As summary, answers taken literally, with the share of unknown answers and end-to-end accuracy."""
    whole = summary(results, by, loose=False)
    return whole.withColumn("unknown_rate", ratio(F.col("unknown"), F.col("total"))).withColumn("end_to_end_accuracy", F.col("accuracy"))


def public_summary(results: DataFrame) -> DataFrame:
    """Per track: in all, and by task, format and image type, with parse failures, in one pass."""
    keys = ["task", "format_type", "img_type"]
    keyed = results.withColumns({c: key_text(c) for c in keys})
    columns = {c: F.col(c) for c in ["track", *keys]}
    sets = [[columns["track"], columns[k]] for k in keys] + [[columns["track"]]]
    failed = F.count_if(F.col("parse_status") == "failed")
    grouped = keyed.groupingSets(sets, *columns.values())
    rows = grouped.agg(F.grouping_id().cast("int").alias("_g"), *counts(), failed.alias("parse_failures"))
    name = F.when(F.col("_g") == 3, "task").when(F.col("_g") == 5, "format_type").when(F.col("_g") == 6, "img_type").otherwise("total")
    value = F.when(F.col("_g") == 3, F.col("task")).when(F.col("_g") == 5, F.col("format_type")).when(F.col("_g") == 6, F.col("img_type")).otherwise("")
    return rows.withColumn("field", name).withColumn("value", value).drop("_g", *keys)


def histogram(rows: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """How often each value occurs; null and empty don't count."""
    keyed = rows.select(*(by or []), value.alias("value")).where("value is not null and value <> ''")
    return keyed.groupBy(*(by or []), "value").agg(F.count(F.lit(1)).alias("n"))


def ranked_histogram(rows: DataFrame, value: Column) -> DataFrame:
    """histogram() with place, from 1: the most frequent first, equal ones by value. Only a row for each distinct value comes together for that."""
    return histogram(rows, value).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def models(results: DataFrame, by: list[str]) -> DataFrame:
    """The models that answered, sorted, and as one text."""
    names = F.array_sort(F.collect_set("model"))
    found = results.groupBy(*by).agg(names.alias("models"))
    return found.withColumn("model", F.coalesce(F.nullif(F.array_join("models", ", "), F.lit("")), F.lit("unknown")))


def aligned(results: DataFrame, tracks: tuple[str, ...], terms: tuple[str, ...] = ("metric", "unit", "tolerance")) -> DataFrame:
    """One row a question with each track's prediction and correct, whether every track has it once, and whether on the same terms."""
    own = [F.max(F.when(F.col("track") == t, F.struct(F.col("prediction"), right().alias("correct")))).alias(t) for t in tracks]
    n, kinds = F.count(F.lit(1)), F.count_distinct(F.struct(*terms))
    rows = results.groupBy("question_id").agg(*own, (n == len(tracks)).alias("_once"), (kinds == 1).alias("same_terms"), F.any_value("type").alias("type"))
    flat = [F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in tracks for c in ("prediction", "correct")]
    complete = F.col("_once") & F.forall(F.array(*[F.col(t).isNotNull() for t in tracks]), lambda there: there)
    return rows.select("question_id", "type", complete.alias("complete"), "same_terms", *flat)


def pair_outcomes(rows: DataFrame, tracks: tuple[str, ...]) -> DataFrame:
    """For every two tracks: how often both, one or none is right, their accuracies and the difference."""
    pairs = [F.struct(F.lit(a).alias("left_track"), F.lit(b).alias("right_track"), F.col(f"{a}_correct").alias("l"), F.col(f"{b}_correct").alias("r")) for a, b in combinations(tracks, 2)]
    each = rows.where("complete").select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    left, good, n = F.count_if("l"), F.count_if("r"), F.count(F.lit(1))
    return each.groupBy("left_track", "right_track").agg(
        n.alias("total"), ratio(left, n).alias("left_accuracy"), ratio(good, n).alias("right_accuracy"),
        rounded(ratio(good, n) - ratio(left, n)).alias("delta_accuracy"),
        F.count_if(F.col("l") & F.col("r")).alias("both_correct"), F.count_if(F.col("l") & ~F.col("r")).alias("left_only"),
        F.count_if(~F.col("l") & F.col("r")).alias("right_only"), F.count_if(~F.col("l") & ~F.col("r")).alias("both_wrong"),
    )


def disagreements(rows: DataFrame, tracks: tuple[str, ...]) -> DataFrame:
    """Questions on which the tracks differ in their prediction or its correctness."""
    differ = [F.size(F.array_distinct(F.array(*[F.col(f"{t}_{c}") for t in tracks]))) > 1 for c in ("prediction", "correct")]
    return rows.where("complete").where(differ[0] | differ[1])


def key_mismatch(results: DataFrame, tracks: tuple[str, ...]) -> DataFrame:
    """Questions that some track lacks, with the tracks that lack them."""
    held = results.groupBy("question_id").agg(F.collect_set("track").alias("held"))
    missing = F.array_except(F.array(*map(F.lit, tracks)), "held")
    return held.select("question_id", missing.alias("missing")).where(F.size("missing") > 0)


def duplicate_ids(results: DataFrame) -> DataFrame:
    """Ids that a track repeats, and blank ones."""
    found = results.groupBy("track", "question_id").agg(F.count(F.lit(1)).alias("n"))
    return found.where((F.col("n") > 1) | F.col("question_id").isNull() | (F.trim(F.col("question_id").cast("string")) == ""))


def failures_by_image(answers: DataFrame) -> DataFrame:
    """Images with missing targets: how many records, the labels with counts, and the question ids in order."""
    failed = answers.where(F.col("error_reason") == "missing_target_objects")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("question_id")), lambda x: x.cast("string")), ";")
    images = failed.groupBy("image").agg(F.count(F.lit(1)).alias("missing_record_count"), ids.alias("question_ids"))
    labels = failed.select("image", F.explode("missing").alias("label")).groupBy("image", "label").agg(F.count(F.lit(1)).alias("n"))
    packed = labels.groupBy("image").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(x["label"], F.lit(":"), (-x["m"]).cast("string"))), ";")
    return images.join(packed.select("image", text.alias("missing_labels")), "image", "left")


def failure_totals(answers: DataFrame) -> DataFrame:
    missing, total = F.count_if(F.col("error_reason") == "missing_target_objects"), F.count(F.lit(1))
    return answers.agg(total.alias("total_records"), missing.alias("missing_target_records"), ratio(missing, total).alias("missing_target_rate"))
