"""Every stage of the pipeline on its own input, against brute force."""

from collections import Counter

import corpus_pipeline
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_operators import AWKWARD, brute_counts, brute_lines, brute_near, docs

from scenequery.llm.common import saved
from scenequery.llm.packing import load_encoder, tokenizer_path


@pytest.fixture(scope="module")
def stages(spark):
    tables = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(saved(stage(spark, tables[-1], DATA), "test"))
    return tables


def texts(table):
    return sorted((r["doc_id"], r["text"]) for r in table.collect())


def test_columns(stages):
    assert all(t.columns == stages[0].columns for t in stages[:5]) and "sequence_id" in stages[5].columns


def test_quality_rules_keep_whole_rows(spark, stages):
    before, after = dict(texts(stages[0])), dict(texts(stages[1]))
    assert after.items() <= before.items()
    failed = {i for i, t in before.items() for n, *_, r in [brute_counts(t)] if n < 50 or 100 * r > 50 * n}
    assert not failed & after.keys()
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()} - failed
    assert len(good & after.keys()) >= 0.95 * len(good & before.keys())


def test_line_dedup(stages):
    before = texts(stages[1])
    gone = brute_lines(before, 50)
    expected = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in before}
    hit = {i for i, _ in gone}
    assert dict(texts(stages[2])) == {i: t for i, t in expected.items() if i not in hit or t.split()}


def test_near_dedup(stages):
    before = texts(stages[2])
    kept = {i for i, (_, c) in brute_near(before, 5, 80).items() if i == c}
    assert texts(stages[3]) == [(i, t) for i, t in before if i in kept]


def test_mixing(stages):
    size = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    n_before, n_after = (t.agg(F.sum(size)).first()[0] for t in (stages[3], stages[4]))
    assert abs(n_after - 1.5 * n_before) <= 20
    before = dict(texts(stages[3]))
    for i, n in Counter(r["doc_id"] for r in stages[4].select("doc_id").collect()).items():
        assert n <= 2 and i in before
    for r in stages[4].collect():
        assert not Counter(r["text"].split()) - Counter(before[r["doc_id"]].split()) and r["n_chars"] == len(r["text"])


def test_packing(stages):
    encode = load_encoder(tokenizer_path())
    assert stages[5].agg(F.sum("length")).first()[0] == sum(len(encode(t)) + 1 for _, t in texts(stages[4]))
    assert stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, DATA).count() == stages[5].count()


@pytest.mark.parametrize("k", range(5))
def test_awkward_rows(spark, k):
    rows = docs(spark, [*AWKWARD, (30, None)])
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, rows, DATA)
    assert out.count() >= 0 and stage(spark, rows.limit(0), DATA).count() == 0
    if k < 4:
        assert set(rows.columns) <= set(out.columns)


def test_texts_of_one_id_and_foreign_columns_pass(spark):
    a, b = (" ".join(f"{x}{j}" for j in range(60)) for x in "ab")
    rows = spark.createDataFrame([(1, a, "s", 5), (1, b, "s", 6), (2, a, "t", 7)], "doc_id long, text string, source string, lines_removed int")
    for name in ("line dedup", "near dedup", "mixing"):
        out = dict(corpus_pipeline.STAGES)[name](spark, rows, DATA)
        assert out.columns == rows.columns and set(r["lines_removed"] for r in out.collect()) <= {5, 6, 7}
    kept = dict(corpus_pipeline.STAGES)["near dedup"](spark, rows, DATA)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b)])
