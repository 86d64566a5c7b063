"""The rule baseline: evidence lookups and answers, as joins and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import col, nullif_zero

SUPPORTED_TYPES = ("closer_farther", "physical_size", "support_relation")


def missing_targets(questions: DataFrame, objects: DataFrame) -> DataFrame:
    """Targets that the question's image doesn't show, in their order, repeats included."""
    shown = objects.groupBy("image").agg(F.collect_set("label").alias("_shown"))  # the labels of one image
    joined = questions.join(shown, "image", "left")
    return joined.withColumn("missing", F.filter("targets", lambda t: ~F.coalesce(F.array_contains("_shown", t), F.lit(False)))).drop("_shown")


def last_by_label(geometry: DataFrame) -> DataFrame:
    """Of the objects of an image with one label, the last."""
    last = Window.partitionBy("image", "label").orderBy(F.desc("ord"))
    return geometry.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def closeness_of() -> Column:
    return F.coalesce("closeness_score", "relative_depth_p90", "relative_depth_median")


def best_by_label(geometry: DataFrame) -> DataFrame:
    """Of the objects of an image with one label, the closest; the first of equals, and a score of zero last."""
    scored = geometry.withColumn("closeness", closeness_of()).where("closeness is not null")
    best = Window.partitionBy("image", "label").orderBy(F.desc_nulls_last(nullif_zero(F.col("closeness"))), "ord")
    return scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def inverted(relation: Column | str) -> Column:
    r = col(relation)
    return F.when(r == "closer_than", "farther_than").when(r == "farther_than", "closer_than").otherwise(r)


def first_relation(pairs: DataFrame) -> DataFrame:
    """Of the relations between two labels of an image, in whichever order, the first."""
    low, high = F.least("label_a", "label_b"), F.greatest("label_a", "label_b")
    first = Window.partitionBy("image", "_low", "_high").orderBy("ord_a", "ord_b")
    numbered = pairs.withColumn("_low", low).withColumn("_high", high).withColumn("_n", F.row_number().over(first))
    return numbered.where("_n = 1").select("image", "_low", "_high", F.col("label_a").alias("_label_a"), "depth_relation")


def labels_seen(geometry: DataFrame) -> DataFrame:
    """image and seen: its labels in the order of their first object, each with the evidence of its last."""
    fields = ("closeness_score", "relative_depth_median", "mask_area_fraction", "vertical_position", "depth_order_hint")
    one = geometry.groupBy("image", "label").agg(F.min("ord").alias("first"), F.max_by(F.struct(*fields), "ord").alias("o"))
    return one.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("first", "label", "o"))).alias("seen"))  # the labels of one image


def relations_seen(pairs: DataFrame) -> DataFrame:
    """image and related: the first relation of every two of its labels, in whichever order."""
    return first_relation(pairs).groupBy("image").agg(F.collect_list(F.struct("_low", "_high", "_label_a", "depth_relation")).alias("related"))  # pairs of one image's labels


def _first_greatest(labels: Column, score) -> Column:
    """The label of the greatest score, the first of equals; unknown without scores."""
    entries = F.filter(F.transform(labels, lambda n, i: F.struct((-score(n)).alias("s"), i.alias("i"), n.alias("n"))), lambda e: e["s"].isNotNull())
    return F.coalesce(F.array_min(entries)["n"], F.lit("unknown"))


def rule_answers(questions: DataFrame, geometry: DataFrame, pairs: DataFrame, higher_is_closer: bool = True) -> DataFrame:
    """prediction, source, confidence, correct and error_reason of every question.

    questions: question_id, image, type, targets, answer (and acceptable_answers, if any).
    Depth questions follow the relation of the first two labels, else their closeness scores, else
    their median depths; size questions the largest mask of all targets; support questions a score of
    size, height and nearness over all targets, or over all labels of the image without targets.
    Questions meet one row of their image with all its evidence, so they are shuffled once, without it.
    """
    told = labels_seen(geometry).join(relations_seen(pairs), "image", "full").select("image", F.col("seen").alias("_seen"), F.col("related").alias("_related"))
    asked = questions.join(told, "image", "left")
    nothing = F.array().cast("array<string>")
    shown = F.coalesce(F.transform("_seen", lambda s: s["label"]), nothing)
    targets = F.coalesce("targets", nothing)
    asked = asked.withColumn("missing", F.filter(targets, lambda t: ~F.coalesce(F.array_contains(shown, t), F.lit(False))))
    asked = asked.withColumn("_a", F.get("targets", F.lit(0))).withColumn("_b", F.get("targets", F.lit(1)))
    a, b = F.col("_a"), F.col("_b")
    low, high = F.least(a, b), F.greatest(a, b)
    asked = asked.withColumn("_r", F.get(F.filter("_related", lambda r: (r["_low"] == low) & (r["_high"] == high)), F.lit(0)))
    of = lambda label: F.get(F.filter("_seen", lambda s: s["label"] == label), F.lit(0))["o"]
    relation = F.when(F.col("_r._label_a") == a, F.col("_r.depth_relation")).otherwise(inverted("_r.depth_relation"))

    def closer(field: str, up: bool = True) -> Column:
        x, y = of(a)[field], of(b)[field]
        return F.when(x.isNull() | y.isNull(), F.lit(None).cast("string")).when(F.abs(x - y) <= 1e-6, "unknown").when((x > y) if up else (x < y), a).otherwise(b)

    def answer(label: Column, source: str, confidence: float) -> Column:
        return F.struct(label.alias("label"), F.lit(source).alias("source"), F.when(label == "unknown", 0.0).otherwise(confidence).alias("confidence"))

    def support(label: Column) -> Column:
        o = of(label)
        score = F.least(F.coalesce(o["mask_area_fraction"], F.lit(0.0)) * 4.0, F.lit(1.0))
        return score + F.when(o["vertical_position"].isin("middle", "bottom"), 0.5).otherwise(0.0) + F.when(o["depth_order_hint"].isin("middle", "near"), 0.25).otherwise(0.0)

    by_relation = F.when(relation == "closer_than", a).when(relation == "farther_than", b)
    by_score, by_depth = closer("closeness_score"), F.coalesce(closer("relative_depth_median", higher_is_closer), F.lit("unknown"))
    depth = F.when(by_relation.isNotNull(), answer(by_relation, "pairwise_closeness_relation", 0.9)).when(by_score.isNotNull(), answer(by_score, "closeness_score", 0.7)).otherwise(answer(by_depth, "relative_depth_median", 0.7))
    area = answer(_first_greatest(targets, lambda t: of(t)["mask_area_fraction"]), "mask_area_fraction", 0.7)
    held = answer(_first_greatest(F.when(F.size(targets) > 0, targets).otherwise(shown), support), "support_heuristic", 0.45)
    two = F.size(targets) >= 2
    unknown = lambda source: answer(F.lit("unknown"), source, 0.0)
    found = (
        F.when(F.size("missing") > 0, unknown("none"))
        .when(~F.coalesce(F.col("type").isin(*SUPPORTED_TYPES), F.lit(False)), unknown("unsupported_question_type"))
        .when((F.col("type") == "closer_farther") & two, depth)
        .when((F.col("type") == "physical_size") & two, area)
        .when(F.col("type") == "support_relation", held)
        .otherwise(unknown("insufficient_target_objects"))
    )
    out = asked.withColumn("_f", found).withColumn("prediction", F.col("_f.label"))
    accepted = accepted_answers(F.col("acceptable_answers") if "acceptable_answers" in questions.columns else None, F.col("answer"))
    correct = (F.size("missing") == 0) & F.array_contains(accepted, F.lower(F.trim("prediction")))
    reason = F.when(F.size("missing") > 0, "missing_target_objects").when(F.col("prediction") == "unknown", F.col("_f.source"))
    return out.select(*questions.columns, "missing", "prediction", F.col("_f.source").alias("source"), F.col("_f.confidence").alias("confidence"), F.coalesce(correct, F.lit(False)).alias("correct"), reason.alias("error_reason"))


def accepted_answers(listed: Column | None, answer: Column) -> Column:
    """Lower-cased trimmed answers that count: the listed ones, or else the gold answer."""
    gold = F.filter(F.array(answer), lambda v: v.isNotNull())
    values = gold if listed is None else F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(gold)
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.lower(F.trim(v)))
