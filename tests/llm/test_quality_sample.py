"""The forest's sample on tables whose rows share one id or have none."""

import pytest

from scenequery.llm import quality


@pytest.mark.parametrize("doc_id", [None, 3])
def test_sample_is_thinned_by_row(spark, monkeypatch, doc_id):
    monkeypatch.setattr(quality, "TREES", 4)
    monkeypatch.setattr(quality, "SAMPLE", 16)
    seen, grow = [], quality.grow_forest
    monkeypatch.setattr(quality, "grow_forest", lambda rows, **k: seen.append(len(rows)) or grow(rows, **k))
    texts = [" ".join(f"word{i}x{j % (40 + i)}" for j in range(60 + i)) for i in range(400)]
    docs = spark.createDataFrame([(doc_id, t) for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fitted(quality.rule_statistics(docs), labels)[1] is not None
    assert 32 <= seen[0] <= 64
    assert quality.kept_documents(docs, labels).count() > 0


def test_kept_documents_without_a_forest(spark, monkeypatch):
    monkeypatch.setattr(quality, "fitted", lambda *a, **k: (None, None, quality.DEFAULT_THRESHOLD))
    docs = spark.createDataFrame([(1, " ".join(f"w{j}" for j in range(60))), (2, "short")], "doc_id long, text string")
    assert [r["doc_id"] for r in quality.kept_documents(docs, docs).collect()] == [1]
