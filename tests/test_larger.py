"""Queries on tables whose numbers are larger, or whose values are odder, than those of the small tables."""

import duckdb
import pytest

from scenequery import catalogue
from scenequery.functions.common import rounded


def written(folder, **tables):
    for name, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
    return str(folder)


def as_texts(rows, names):
    return sorted(str([r[c] for c in names]) for r in rows)


def exactly(spark, name, folder, *tables):
    """The query's rows equal its SQL's, the signs of zeros too."""
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        found = db.execute(catalogue.ORACLE_SQL[name])
        names = [c[0] for c in found.description]
        expected = as_texts([dict(zip(names, r)) for r in found.fetchall()], names)
    assert as_texts(catalogue.QUERIES[name](spark, folder).collect(), names) == expected


@pytest.mark.parametrize("name", ["image_name_flags", "rename_plan"])
def test_page_numbers_of_five_digits(spark, tmp_path, name):
    folder = written(tmp_path, pages="SELECT 9990 + i AS page_id, 'u' AS url, 'h' AS html FROM range(60) t(i)")
    exactly(spark, name, folder, "pages")


def test_sides_that_no_jpeg_can_hold(spark, tmp_path):
    folder = written(tmp_path, supplier="SELECT 32760 + i AS s_suppkey FROM range(20) t(i)")
    exactly(spark, "image_header_sizes", folder, "supplier")


def test_answers_of_negative_zero(spark, tmp_path):
    folder = written(tmp_path, conversations="SELECT i AS conv_id, j AS turn FROM range(300) t(i), range(8) u(j)")
    exactly(spark, "normalize_numeric_answer", folder, "conversations")


def test_rounding_keeps_the_sign_of_zero(spark):
    got = spark.createDataFrame([(-4e-7,), (-0.0,), (0.0,), (4e-7,)], "x double").select(rounded("x").alias("r")).collect()
    assert [str(r["r"]) for r in got] == ["-0.0", "-0.0", "0.0", "0.0"]


@pytest.mark.parametrize("name", ["camera_xyz", "repair_markers", "prompt_audit", "prompt_records_public", "prompt_rows_public"])
def test_coordinates_that_round_to_negative_zero(spark, tmp_path, name):
    values = "CASE WHEN j = 2 THEN -8.67e-7 ELSE sin(i * 64 + j) / 10 END"
    folder = written(tmp_path, embeddings=f"SELECT 6730 + i AS vec_id, list(CAST({values} AS FLOAT) ORDER BY j) AS embedding FROM range(10) t(i), range(64) u(j) GROUP BY i")
    exactly(spark, name, folder, "embeddings")


@pytest.mark.parametrize("name", ["prompt_audit", "prompt_records_public", "prompt_rows_public"])
def test_pixels_that_round_to_negative_zero(spark, tmp_path, name):
    values = "CASE WHEN j = 0 THEN -4e-6 WHEN j = 1 AND i < 5 THEN '-0.0'::DOUBLE WHEN j = 4 AND i % 2 = 0 THEN -1e-6 WHEN j = 6 THEN 4e-6 ELSE sin(i * 64 + j) / 10 END"
    folder = written(tmp_path, embeddings=f"SELECT 6730 + i AS vec_id, list(CAST({values} AS FLOAT) ORDER BY j) AS embedding FROM range(10) t(i), range(64) u(j) GROUP BY i")
    exactly(spark, name, folder, "embeddings")


@pytest.mark.parametrize("name", ["camera_xyz", "geometry_records", "marker_relations", "marker_relations_by_view", "prompt_audit", "prompt_records_public", "prompt_rows_public", "red_blue_relation", "repair_markers"])
def test_depths_that_end_in_half_a_millionth(spark, tmp_path, name):
    # a depth of 10/256 is 0.0390625, and so end differences of such depths
    values = "CASE WHEN j = 2 THEN (2 * i + 1) / 256 WHEN j = 5 THEN (2 * i + 3) / 256 WHEN j = 8 THEN i / 128 ELSE sin(i * 64 + j) / 10 END"
    folder = written(tmp_path, embeddings=f"SELECT 6730 + i AS vec_id, list(CAST({values} AS FLOAT) ORDER BY j) AS embedding FROM range(10) t(i), range(64) u(j) GROUP BY i")
    exactly(spark, name, folder, "embeddings")


def test_rounding_away_is_sql_s(spark):
    import random

    from scenequery.functions.common import rounded_away

    r = random.Random(5)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), 1e300, 1e308, 4.9e9 + 0.1, 4503599627370497.5 / 1e6, 0.5e-6, -0.5e-6, 0.49999999999999994e-6]
    values += [s * (2 * r.randrange(10**9) + 1) / 2e6 for s in (1, -1) for _ in range(2000)] + [s * k / 2**9 for s in (1, -1) for k in range(2000)] + [r.gauss(0, 10.0 ** r.randrange(-9, 12)) for _ in range(4000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", rounded_away("v").alias("r")).collect()
    with duckdb.connect() as db:
        expected = db.execute("SELECT list_transform($1::DOUBLE[], lambda v: round(v, 6))", [values]).fetchone()[0]
    assert [(v, got) for v, got, want in zip(values, (x["r"] for x in rows), expected) if repr(got) != repr(want)] == []


def test_rounding_up_keeps_the_sign_of_zero(spark):
    from scenequery.functions.common import rounded_up

    values = [-4e-4, -0.0, 0.0, 4e-4, -5e-4, 1.5625, -1.5625, float("nan"), float("-inf"), None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(rounded_up("x", 3).alias("r")).collect()
    assert [str(r["r"]) for r in got] == ["-0.0", "-0.0", "0.0", "0.0", "-0.001", "1.563", "-1.563", "nan", "-inf", "None"]


def test_letters_only_of_odd_texts_without_replacing_bit_by_bit(spark):
    from pyspark.sql import functions as F

    from scenequery import bindings

    texts = [None, "", "  ", "a1b\nc\td", "12 ,;", "Ünïcode é 𝒜b", "日本語", "x" * 100000 + "1"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = table.select(bindings.letters_only("text").alias("a"), F.regexp_replace("text", "[^a-zA-Z ]", "").alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    assert "regexp_replace" not in bindings.sources(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def exchanges_of(frame, column):
    """How many shuffles of a query's plan carry a column, where no side is small enough to be broadcast."""

    def walk(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        output = [node.output().apply(i).name() for i in range(node.output().size())]
        return (node.nodeName() == "Exchange" and column in output) + sum(map(walk, children))

    return walk(frame._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["rule_answers", "review_rows", "prompt_texts_local", "prompt_rows_local"])
def test_questions_are_shuffled_once(spark, name):
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert exchanges_of(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"), "targets") == 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_prompts_written_with_another_codec(spark, tmp_path):
    from scenequery.__main__ import main

    data, sizes = "/root/testdata/sf0.001", {}
    for codec in ([], ["--compression", "zstd"]):
        out = tmp_path / "-".join(["out", *codec])
        assert main(["prompt_texts_local", data, str(out), *codec]) == 0
        codecs = {c for (c,) in duckdb.sql(f"SELECT DISTINCT compression FROM parquet_metadata('{out}/*.parquet')").fetchall()}
        assert codecs == {"ZSTD" if codec else "SNAPPY"}
        sizes[len(codec)] = sum(f.stat().st_size for f in out.glob("*.parquet"))
    assert sizes[2] * 3 < sizes[0]
    kept = [f"SELECT * FROM '{tmp_path}/{out}/*.parquet'" for out in ("out", "out---compression-zstd")]
    assert duckdb.sql(f"({kept[0]}) EXCEPT ALL ({kept[1]})").fetchall() == []
    assert [duckdb.sql(f"SELECT count(*) FROM ({k})").fetchall() for k in kept] == [duckdb.sql(f"SELECT count(*) FROM '{data}/orders.parquet'").fetchall()] * 2


def test_lines_of_prompts_are_those_of_their_texts(spark):
    from scenequery.operators import prompts

    asked = [(1, "i", "closer_farther", ["a", "b"], [], "q"), (2, "i", "closer_farther", ["a", "c"], ["c"], "two\nlines\n"), (3, "j", "left_right", [], [], None), (4, "gone", "left_right", ["a"], ["a"], "q"), (5, None, "closer_farther", ["a", None], None, ""), (6, "i", None, ["a", "b"], [], "\n")]
    questions = spark.createDataFrame(asked, "question_id int, image string, type string, targets array<string>, missing array<string>, question string")
    told = spark.createDataFrame([("i", ["Image: i", "x"], ["Objects:", "- a\nb", None]), ("j", ["Image: j"], ["Objects:"])], "image string, head array<string>, body array<string>")
    best = spark.createDataFrame([("i", "a", 1, 0.5), ("i", "b", 2, 0.25), ("k", "a", 3, None)], "image string, label string, object_id int, closeness double")
    tracks = ("pure_vlm", "geometry_only", "image_and_geometry")
    texts = {r["question_id"]: [None if r[c] is None else r[c].count("\n") + 1 for c in tracks] for r in prompts.local_prompts(questions, told, best).collect()}
    assert {r["question_id"]: [r[c] for c in tracks] for r in prompts.local_prompt_lines(questions, told, best).collect()} == texts
    assert len(texts) == 6 and texts[1][1] == 3 + 3 + 2 + 1 + 5 + 2 and texts[4][1] is None


def counted_questions(spark, ids):
    """Rows of a benchmark whose questions are counted as they are made, with what tells blank ones without them."""
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def question(number):
        made.add(1)
        return "" if number % 7 == 0 else f"question {number}"

    rows = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], "id string, n int").repartition(3)
    fixed = [F.lit(v).alias(c) for c, v in {"img_type": "single_view", "format_type": "select", "answer": "A", "has_image": True}.items()]
    task = F.concat(F.lit("depth_"), (F.col("n") % 5).cast("string")).alias("task")
    return made, rows.select("id", *fixed, task, F.udf(question, "string")("n").alias("question"), (F.col("n") % 7 == 0).alias("blank"))


def test_selection_of_single_ids_makes_no_question(spark):
    from scenequery.operators import select

    made, rows = counted_questions(spark, map(str, range(1000)))
    got = as_texts(select.select_rows(rows, "a", missing="blank").select("id", "selected", "reasons").collect(), ["id", "selected", "reasons"])
    assert made.value == 0
    assert got == as_texts(select.select_rows(rows.drop("blank"), "a").collect(), ["id", "selected", "reasons"]) and sum("True" in r for r in got) == 30


@pytest.mark.parametrize("name", ["selection_phase_a", "selection_phase_a_whole", "selection_phase_b", "source_fingerprint"])
def test_selections_of_the_benchmark_make_no_question(spark, name):
    assert "regexp_extract_all" not in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_blank_questions_are_known_by_their_texts(spark):
    from pyspark.sql import functions as F

    from scenequery import bindings
    from scenequery.functions.common import clean_text

    texts = [None, "", "  ", " 1\n\t", "日本語 é", "1" * 150 + "z", " " * 100 + "\n", "x", "\U0001d49c" * 120 + "b"]
    table = spark.createDataFrame([(i, t) for i in (49, 50, 51) for t in texts], "doc_id long, text string")
    question = F.when(F.col("doc_id") % 50 == 0, "").otherwise(bindings.letters_only("text"))
    rows = table.select(bindings.no_question(), (clean_text(question) == "").alias("blank")).collect()
    assert [r["no_question"] for r in rows] == [r["blank"] for r in rows] and {r["blank"] for r in rows} == {True, False}


def test_selection_of_repeated_ids_makes_their_questions_only(spark):
    from pyspark.sql import functions as F

    from scenequery.operators import select

    names, tie = ["id", "selected", "reasons"], F.struct("answer", "question")
    made, rows = counted_questions(spark, [str(n // 3) if n < 30 else str(n) for n in range(1000)])
    got = as_texts(select.select_rows(rows, "a", tie=tie, missing="blank").select(*names).collect(), names)
    assert 0 < made.value < 500  # of 30 ids, in each of the passes over them
    assert got == as_texts(select.select_rows(rows.drop("blank"), "a", tie=tie).select(*names).collect(), names) and sum("True" in r for r in got) == 30
