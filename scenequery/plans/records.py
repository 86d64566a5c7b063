"""Queries over audits, prompt records, lines of files, row sources and the order of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import audit as u
from ..operators import geometry as g
from ..operators import metrics as m
from ..operators import prompts as t
from ..sources import files, readers, reports, rows
from . import Catalogue
from .io import scratch
from .public import _AUDIT, _PROMPTS, _bench_prompts, _status

catalogue = Catalogue()
query = catalogue.query

_AUDITED = f"""{_AUDIT}, ar AS (SELECT question_id, question_id % 10 <> 9 AS there, CASE WHEN there THEN status ELSE 'missing_geometry' END AS status, CASE WHEN there THEN missing ELSE [] END AS missing, there AND label_conflict AS label_conflict, there AND ready AS ready FROM audit)"""


def _audited(spark, d):
    """The audit of the benchmark's questions of which every tenth has no geometry."""
    questions = b.marker_questions(spark, d)
    return u.audit_of_questions(questions, u.geometry_audit(_status(spark, d).where(F.col("question_id") % 10 != 9)))


@query(f"""{_AUDITED} SELECT 'questions' AS kind, '' AS value, count(*) AS n FROM ar UNION ALL SELECT 'available', '', count(*) FILTER (ready) FROM ar UNION ALL SELECT 'unavailable', '', count(*) FILTER (NOT ready) FROM ar
  UNION ALL SELECT 'label_conflict', '', count(*) FILTER (label_conflict) FROM ar UNION ALL SELECT 'status', status, count(*) FROM ar GROUP BY status UNION ALL SELECT 'missing_marker', c, count(*) FROM (SELECT unnest(missing) AS c FROM ar) GROUP BY c""")
def geometry_audit_counts(spark, d):
    return u.audit_counts(_audited(spark, d))


@query(f"{_AUDITED} SELECT question_id, NOT ready AS removed, (SELECT count(*) FROM ar) AS source_question_count, (SELECT count(*) FROM ar WHERE NOT ready) AS removed_question_count FROM ar")
def subset_removals(spark, d):
    return u.removal_audit(b.marker_questions(spark, d), _audited(spark, d))


@query(f"""{_PROMPTS} SELECT q.question_id, 'bench' AS dataset, [q.question_id || '.jpg'] AS images, q.task, q.answer, ['image_and_geometry', 'pure_vlm'] AS needs_image, sha256(concat_ws('|', pure_vlm, geometry_only, image_and_geometry)) AS prompts FROM b_mq q JOIN pr USING (question_id)""")
def prompt_records_public(spark, d):
    """The benchmark's prompt records: what they tell of their question, which tracks need an image, and a digest of the prompts."""
    k = F.col("question_id")
    questions = b.marker_questions(spark, d).select("*", F.lit("bench").alias("dataset"), F.array(F.concat(k.cast("string"), F.lit(".jpg"))).alias("images"))
    records = t.prompt_records(questions, _bench_prompts(spark, d).select("question_id", "prompts"))
    needs = F.array_sort(F.map_keys(F.map_filter("requires_image", lambda _, v: v)))
    return records.select("question_id", "dataset", "images", "task", "answer", needs.alias("needs_image"), F.sha2(F.concat_ws("|", *[F.col("prompts")[x] for x in t.TRACKS]), 256).alias("prompts"))


_LINES = "CASE WHEN o_orderkey % 97 = 0 THEN '{\"id\": ' WHEN o_orderkey % 89 = 0 THEN '[' || o_orderkey || ']' WHEN o_orderkey % 83 = 0 THEN '  ' ELSE '{\"id\": ' || o_orderkey || '}' END"


@query(f"""SELECT 'part-' || part || '.jsonl' AS file_name, line, CASE WHEN o_orderkey % 97 = 0 THEN 'invalid JSON' ELSE 'record must be an object' END AS error
  FROM (SELECT o_orderkey, o_orderkey // 100 AS part, row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) AS line FROM orders) WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0""")
def jsonl_line_errors(spark, d):
    """Lines of JSON-lines files that are malformed or no objects, by file and number."""
    path, k = f"{scratch(spark)}/lines", F.col("o_orderkey")
    line = F.when(k % 97 == 0, '{"id": ').when(k % 89 == 0, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).when(k % 83 == 0, "  ").otherwise(F.concat(F.lit('{"id": '), k.cast("string"), F.lit("}")))
    each = b.table(spark, d, "orders").select(F.expr("o_orderkey div 100").alias("part"), F.struct(k.alias("k"), line.alias("line")).alias("s"))
    held = each.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n").alias("text"))  # a hundred lines
    files.write_files(held.select(F.concat(F.lit("part-"), F.col("part").cast("string"), F.lit(".jsonl")).alias("name"), F.encode("text", "UTF-8").alias("content")), path)
    return readers.json_line_errors(spark, path, strict=True).select(readers.file_name("path").alias("file_name"), F.col("line").cast("long").alias("line"), "error")


@query("SELECT p_name || '_' || p_partkey || '.JPG' AS name FROM part ORDER BY lower(name), name LIMIT 25")
def first_image_files(spark, d):
    """The first files in the order of their names."""
    return readers.first_files(b.table(spark, d, "part").select(F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".JPG")).alias("name")), 25)


@query("SELECT p_type AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, p_type) AS INTEGER) AS place FROM part WHERE p_type <> '' GROUP BY p_type")
def ranked_types(spark, d):
    """Types by how often they occur, with their place in the report."""
    return m.ranked_histogram(b.table(spark, d, "part"), F.col("p_type"))


_ROWS_SQL = {0: (3, 3), 1: (4, 4), 2: (1, 16), 3: (2, 3), 4: (4, 4), 5: (3, 3)}


@query(f"""WITH mx AS (SELECT vec_id, vec_id % 6 AS kind, CASE vec_id % 6 {' '.join(f'WHEN {k} THEN {h}' for k, (h, _) in _ROWS_SQL.items())} END AS h, CASE vec_id % 6 {' '.join(f'WHEN {k} THEN {w}' for k, (_, w) in _ROWS_SQL.items())} END AS w, embedding FROM embeddings),
st AS (SELECT vec_id, kind, CASE WHEN kind = 5 THEN NULL WHEN kind = 2 THEN [4, 4] ELSE [CAST(h AS INTEGER), CAST(w AS INTEGER)] END AS shape, kind IN (0, 1, 2) AND (kind <> 1 OR vec_id % 4 <> 3) AS valid, list_transform(embedding[1:CAST(h * w AS INTEGER)], lambda v: CAST(v AS DOUBLE)) AS flat FROM mx)
SELECT vec_id, valid AND kind <> 4 AS valid, shape, CASE WHEN valid AND kind <> 4 THEN flat END AS values FROM st""")
def matrix_status_nested(spark, d):
    """Matrices as lists of rows: square ones, a flat one, others, some with a NaN and some ragged."""
    k = F.col("vec_id")
    cut = lambda h, w: F.array(*[F.transform(F.slice("embedding", i * w + 1, w), lambda v: v.cast("double")) for i in range(h)])
    spoilt = lambda v: F.transform(v, lambda row, i: F.when(i == 1, F.transform(row, lambda x: x * float("nan"))).otherwise(row))
    ragged = F.concat(cut(2, 3), F.array(F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double"))))
    kind = k % 6
    values = F.when(kind == 0, cut(3, 3)).when((kind == 1) & (k % 4 == 3), spoilt(cut(4, 4))).when(kind == 1, cut(4, 4)).when(kind == 2, cut(1, 16)).when(kind == 3, cut(2, 3)).when(kind == 4, spoilt(cut(4, 4))).otherwise(ragged)
    return b.table(spark, d, "embeddings").select("vec_id", values.alias("v")).select("vec_id", g.nested_matrix_status("v").alias("s")).select("vec_id", "s.valid", "s.shape", "s.values")


@query("""SELECT 'v' || vec_id AS stem, 3::BIGINT AS n_files, list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS total, CAST(list_min(embedding) AS DOUBLE) AS depth_min, [8, 8] AS depth_shape FROM embeddings""")
def depth_output_files(spark, d):
    """The three files of every depth raster, written as one, and what they say."""
    path = f"{scratch(spark)}/depth"
    rasters = b.table(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(".jpg")).alias("image"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").alias("values"), F.lit(8).alias("image_height"), F.lit(8).alias("image_width"))
    files.write_files_as_one(files.depth_outputs(rasters, "model", "depth"), path)
    stem = lambda c: F.regexp_extract(c, r"^(v\d+)_depth\.", 1).alias("stem")
    listed = spark.read.format("binaryFile").load(path).select(stem(readers.file_name("path"))).groupBy("stem").agg(F.count(F.lit(1)).alias("n_files"))
    values = readers.npy_rasters(spark, path).select(stem("name"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))
    told = readers.documents(spark, path, "depth_min double, depth_shape array<int>").select(stem("file_name"), "depth_min", "depth_shape")
    return listed.join(values, "stem").join(told, "stem")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id >= 100 AND lang = 'en'")
def row_source_columns(spark, d):
    """Rows of a source into which the columns and the filter are pushed."""
    found = rows.row_source(spark, f"{d}/documents.parquet", ["doc_id", "depth", "n_chars", "pose", "lang"])
    return found.where("doc_id >= 100 and lang = 'en'").select("doc_id", "n_chars")


@query("SELECT least(150, count(*)) AS n, least(150, count(DISTINCT doc_id)) AS ids FROM documents")
def row_source_limit(spark, d):
    """How many rows a source gives under a limit."""
    return rows.row_source(spark, f"{d}/documents.parquet", ["doc_id"], 150).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"))


@query("SELECT n_nationkey, 'higher_relative_depth_is_closer' AS assumption, true AS is_utc_to_the_second FROM nation")
def stamped_documents(spark, d):
    """Documents with the assumption that their depths rest on, and the time of the query in UTC."""
    held = reports.stamped(b.table(spark, d, "nation").select("n_nationkey", g.depth_order_assumption(True).alias("assumption")))
    recent = F.abs(F.unix_timestamp(F.to_timestamp("created_at")) - F.unix_timestamp(F.current_timestamp())) < 60
    return held.select("n_nationkey", "assumption", (F.col("created_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$") & recent).alias("is_utc_to_the_second"))
