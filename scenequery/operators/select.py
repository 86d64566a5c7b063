"""Deterministic selection of benchmark rows, with reasons for what is left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.common import clean_text, ordered_list, strings
from .answers import METRICS, answer_type, metric_of, question_id, source_id


@dataclass(frozen=True)
class Selection:
    """What a selection admits. The defaults are fixed values of the benchmark's preparation."""

    img_types: tuple[str, ...] = ("single_view",)
    format_priority: tuple[str, ...] = ("select", "fill")
    task_keywords: tuple[str, ...] = ("depth", "distance", "spatial", "relation")
    excluded_modalities: tuple[str, ...] = ("video", "multi_view")
    metrics: tuple[str, ...] = METRICS
    per_task_limit: int | None = 20


PHASE_LIMITS = {"a": 30, "b": 150, "c": None}


def exclusion_reasons(config: Selection, missing: Column | None = None) -> Column:
    """Every reason against a row (id, img_type, format_type, task, question, answer, has_image), in a fixed order.

    missing: whether the question is blank, where that is known without the question.
    """
    img, task = clean_text("img_type"), clean_text("task")
    metric = metric_of("answer", "format_type")
    known = metric.isin(*METRICS)
    tests = [
        (~img.isin(*config.img_types), "img_type_not_allowed"),
        (img.isin(*config.excluded_modalities), "excluded_modality"),
        (~F.exists(strings(*config.task_keywords), lambda k: F.contains(task, k)) if config.task_keywords else F.lit(False), "task_keyword_not_matched"),
        (~known, "unsupported_metric"),
        (~(known & metric.isin(*config.metrics)), "metric_not_supported_by_selection"),
        (clean_text("question") == "" if missing is None else missing, "question_missing"),
        (~F.coalesce(F.col("has_image"), F.lit(False)), "image_missing"),
    ]
    return F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in tests]), lambda r: r.isNotNull())


def sort_key(config: Selection) -> Column:
    """Formats by priority, then numeric ids by number, then the others as text."""
    place = F.array_position(strings(*config.format_priority), clean_text("format_type"))
    number = source_id("id").try_cast("long")
    return F.struct(F.when(place > 0, place - 1).otherwise(len(config.format_priority)).alias("f"), number.isNull().cast("int").alias("t"), F.coalesce(number, F.lit(0)).alias("n"), source_id("id").alias("id"))


def _passed(entries: DataFrame, at: str, cap: int | None) -> DataFrame:
    """Entries (``at``, task _t, number of rows _m) with the number of rows _g that their task's limit lets pass; those of none are left out."""
    if cap is None:
        return entries.withColumn("_g", F.col("_m"))
    own = Window.partitionBy("_t").orderBy(at)
    entries = entries.withColumn("_n", F.row_number().over(own)).where(F.col("_n") <= cap)
    return entries.withColumn("_g", F.least("_m", cap - _before("_m", own))).where("_g > 0")


def _before(count: str, window: WindowSpec) -> Column:
    return F.coalesce(F.sum(count).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def select_rows(rows: DataFrame, phase: str, config: Selection = Selection(), tie: Column | None = None, missing: str | None = None) -> DataFrame:
    """Every row with its reasons; selected rows have none.

    A task takes its first rows up to a limit, if there is one, the phase the first of those up to another. Rows with one key (repeated
    or missing ids) count each for itself and go by ``tie``, then by a hash of their columns; rows alike in that too are one entry with
    a number of copies. Keys are narrow and cut per task before they meet, the phase's first keys are a short list, and every row is then
    judged by where its key stands. Only where one of these keys has several rows are tie and hash made, of the rows with these ids.

    missing: the column that tells whether a row's question is blank, if there is one; questions are then read for ties only.
    """
    limit = PHASE_LIMITS[phase]
    judged = rows.withColumn("reasons", exclusion_reasons(config, None if missing is None else F.col(missing))).withColumn("key", sort_key(config))
    able = F.size("reasons") == 0
    own = [f for f in rows.schema.fields if f.name != missing]
    if limit is None:
        return judged.select(*[F.col(f"`{f.name}`") for f in own], "reasons", "key", able.alias("selected"))
    cap = config.per_task_limit
    task = F.when(clean_text("task") == "", "unknown").otherwise(clean_text("task"))
    counted = judged.where(able).groupBy("key", task.alias("_t")).agg(F.count(F.lit(1)).alias("_m"))
    counted = counted.withColumn("_all", F.sum("_m").over(Window.partitionBy("key")))  # of all tasks
    first = _passed(counted, "key", cap).groupBy("key").agg(F.max("_all").alias("_all")).orderBy("key").limit(limit).collect()
    if all(r["_all"] == 1 for r in first):
        taken = rows.sparkSession.createDataFrame([(r["key"], 1, 1) for r in first], _entry(judged.schema["key"]))
        return _shown(judged, own, able, taken, "key", limit)
    # every row that is taken has one of these ids; others with them are held off by the limits as before, as what comes before them is here
    near = source_id("id").isin(sorted({r["key"]["id"] for r in first}))
    alike = F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in own])
    close = judged.where(near).withColumn("_at", F.struct("key", (F.lit(0) if tie is None else tie).alias("tie"), alike.alias("hash")))
    entries = _passed(close.where(able).groupBy("_at", task.alias("_t")).agg(F.count(F.lit(1)).alias("_m")), "_at", cap)
    entries = entries.orderBy("_at").limit(limit).withColumn("_g", F.least("_g", limit - _before("_g", Window.orderBy("_at")))).where("_g > 0")
    short = entries.select("_at", "_m", "_g").collect()  # no more than the limit
    taken = rows.sparkSession.createDataFrame(short, _entry(close.schema["_at"]))
    far = _shown(judged.where(~near), own, able, taken.select(F.col("_at.key").alias("key"), "_m", "_g"), "key", limit, there=False)
    return far.unionByName(_shown(close, own, able, taken, "_at", limit, cuts=any(r["_g"] < r["_m"] for r in short)))


def _entry(at: StructField) -> StructType:
    return StructType([at, StructField("_m", LongType()), StructField("_g", LongType())])


def _shown(judged: DataFrame, own: list[StructField], able: Column, taken: DataFrame, at: str, limit: int, there: bool = True, cuts: bool = False) -> DataFrame:
    """Judged rows with ``selected`` and the reason of the limit that holds them off, by the short list of entries taken.

    there: whether rows can be among these. cuts: whether a limit takes some of an entry's rows only.
    """
    last = taken.agg(F.max(at).alias("_last"), F.coalesce(F.sum("_g"), F.lit(0)).alias("_taken"))  # one row
    joined = judged.join(F.broadcast(taken), at, "left") if there else judged.withColumns({"_m": F.lit(None).cast("long"), "_g": F.lit(None).cast("long")})
    joined = joined.crossJoin(F.broadcast(last))
    late = (F.col("_taken") >= limit) & (F.col(at) >= F.col("_last"))
    reason = F.when(able & ~F.col("_in"), F.when(late, F.array(F.lit("phase_limit"))).otherwise(F.array(F.lit("per_task_limit")))).otherwise(F.col("reasons"))
    names = [f"`{f.name}`" for f in own]
    shown = [*map(F.col, names), reason.alias("reasons"), "key", F.col("_in").alias("selected")]
    whole = joined.where("_g is null or _g = _m").withColumn("_in", able & F.col("_g").isNotNull())
    if not cuts:
        return whole.select(*shown)
    # of an entry that a limit cuts, one row stands for its copies
    cut = joined.where("_g < _m").groupBy(at, "_g", "_m", "_last", "_taken").agg(*[F.first(c).alias(c.strip("`")) for c in (*names, "reasons", "key")])
    copies = cut.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_m - 1) div 10000"))))
    copies = copies.withColumn("_i", F.explode(F.expr("sequence(_block * 10000 + 1, least(_m, (_block + 1) * 10000))"))).withColumn("_in", F.col("_i") <= F.col("_g"))
    return whole.select(*shown).unionByName(copies.select(*shown))


def selection_audit(selection: DataFrame) -> DataFrame:
    """How often each reason and each selected task occurs."""
    reasons = selection.where(~F.col("selected")).select(F.lit("excluded_by_reason").alias("kind"), F.explode("reasons").alias("value"))
    tasks = selection.where("selected").select(F.lit("selected_task").alias("kind"), clean_text("task").alias("value"))
    return reasons.unionByName(tasks).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def fingerprint(selection: DataFrame) -> DataFrame:
    """SHA-256 of the selected ids in order; for the limited phases, whose selection is a short list."""
    ids = ordered_list("key", source_id("id"))
    return selection.where("selected").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(ids, "\n"), 256).alias("fingerprint"))


def converted(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows in the evaluation's own shape."""
    own = question_id("id", prefix)
    metric = metric_of("answer", "format_type")
    trimmed = [F.trim(c).alias(c) for c in ("question", "task", "format_type", "img_type")]
    images = F.when(F.col("has_image"), F.array(F.concat(own, F.lit("_view_00.jpg")))).otherwise(F.array().cast("array<string>"))
    return rows.where(metric.isin(*METRICS)).select(own.alias("question_id"), source_id("id").alias("source_id"), images.alias("images"), *trimmed, "answer", answer_type("answer", "format_type").alias("answer_type"), metric.alias("metric"), F.concat(F.lit("geometry_oracle/"), own, F.lit(".json")).alias("geometry_path"))


def histograms(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Counts of every value of several fields, in one pass; null counts as unknown."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.trim(F.col(f).cast("string")), F.lit("unknown")).alias("value")) for f in fields])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def missing_counts(rows: DataFrame, fields: list[str]) -> DataFrame:
    """How many rows lack each field: null, or blank text."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")).alias("gone")) for f in fields])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.field").agg(F.count_if("p.gone").alias("missing"))


def question_length(rows: DataFrame) -> DataFrame:
    n = F.length(F.trim(F.coalesce("question", F.lit(""))))
    return rows.agg(F.coalesce(F.min(n), F.lit(0)).alias("shortest"), F.coalesce(F.max(n), F.lit(0)).alias("longest"), F.coalesce(F.round(F.avg(n), 3), F.lit(0.0)).alias("mean"))


def preview(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The first rows, texts cut for reading."""
    short = [F.substring(F.col(c), 1, 120).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    return rows.orderBy(order).limit(n).select(*short)


def selected_rows(wide: DataFrame, selection: DataFrame, key: str) -> DataFrame:
    """The selected rows with all their columns and the selection's order as ``_place``; the wide table is read for these only.

    selection: select_rows() over the narrow columns, with the same key column.
    """
    order = F.struct(F.col("key")).alias("_place")
    return wide.join(selection.where("selected").select(key, order), key)


def inspection(rows: DataFrame, texts: list[str], views: str, answer: str) -> DataFrame:
    """field, value and n of all histograms at once: the texts trimmed, the number of views, and the type of the answer."""
    kind = F.when(F.col(answer).isNull(), "NoneType").otherwise({"string": "str", "double": "float", "bigint": "int", "int": "int", "boolean": "bool"}.get(dict(rows.dtypes)[answer], "list"))
    count = F.coalesce(F.size(views), F.lit(0))
    pairs = [(f, F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))) for f in texts] + [("view_count", F.when(count < 0, 0).otherwise(count).cast("string")), ("answer_type", kind)]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in pairs])).alias("p")
    return rows.select(each).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For each row and column: type, whether it is missing, nested lengths (of the first element, where elements differ), length and a preview of 120 letters."""

    def one(name: str) -> Column:
        c, kind = F.col(name), dict(rows.dtypes)[name]
        shape, inner, at = [], kind, c
        while inner.startswith("array<"):
            shape.append(F.size(at))
            at, inner = F.get(at, F.lit(0)), inner[6:-1]
        sizes = F.filter(F.array(*shape), lambda n: n >= 0) if shape else F.lit(None).cast("array<int>")
        length = F.size(c) if shape else F.length(c) if kind == "string" else F.lit(1)
        missing = c.isNull() | (F.trim(c) == "" if kind == "string" else F.size(c) == 0 if shape else F.lit(False))
        preview = F.substring(c, 1, 120) if kind == "string" else F.lit(None).cast("string")
        return F.struct(F.lit(name).alias("field"), F.lit(kind).alias("type"), missing.alias("missing"), F.when(~missing, sizes).alias("shape"), F.when(~missing, length).cast("long").alias("length"), F.when(~missing, preview).alias("preview"))

    rest = [c for c in rows.columns if c not in columns]
    return rows.select(*rest, F.explode(F.array(*map(one, columns))).alias("d")).select(*rest, "d.*")


def inference_order(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows by question id as text, the first ``limit`` of them as a top-k."""
    ordered = rows.orderBy(F.col("question_id").cast("string"))
    return ordered if limit is None else ordered.limit(limit)
