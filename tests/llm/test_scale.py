"""Long dialogues, shuffled corpora, and searches whose queries are dealt out."""

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from scenequery.llm import chat, lm_scoring, near_dedup, neighbours


def test_a_long_dialogue_is_one_row_a_speaker(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", "word " * 2500) for k in range(80)] + [(1, -1, "system", "be brief"), (1, 81, "system", "be brief again")]
    got = chat.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["speaker"], r["part"], r["n_turns"], r["n_repeated"]) for r in got) == [("assistant", 0, 82, 0), ("user", 0, 82, 0)]
    assert all(len(r["text"]) > 1_000_000 and len(r["mask"]) == 40 for r in got)


def test_scores_of_a_shuffled_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    plain, dealt = (sorted((r["doc_id"], round(r["score"], 6), r["n_known"]) for r in lm_scoring.scored(x, chunk_chars=20_000).collect()) for x in (docs, docs.repartition(5, "text")))
    assert plain == dealt


def test_nearest_in_shares_and_in_exact_order(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect()}
    for block_queries in (neighbours.BLOCK_QUERIES, 3):
        got = {}
        for r in neighbours.nearest(table, block_queries=block_queries).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert sorted(got) == [i for i in sorted(vectors) if i % 50 == 0]
        same = 0
        for q, found in got.items():
            cosine = {i: float(v @ vectors[q] / np.sqrt((v @ v) * (vectors[q] @ vectors[q]))) for i, v in vectors.items() if i != q}
            found.sort()
            assert [k for k, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(cosine[i] - s) < 1e-12 for _, i, s in found)
            assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
            same += [i for _, i, _ in found] == sorted(cosine, key=lambda i: (-cosine[i], i))[:5]
        assert same >= 0.9 * len(got)


def test_nearest_without_queries(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert neighbours.nearest(table).count() == 0


def short_texts(n):
    """Texts of eleven words that begin with one phrase, every tenth with a copy that differs in its last word."""
    out = []
    for i in range(n):
        own = f"all of these begin alike {i}a {i}b {i}c {i}d {i}e".split() + [f"{i}f"]
        out.append((i, " ".join(own)))
        if i % 10 == 0:
            out.append((n + i, " ".join([*own, "more"])))
    return out


def test_short_sets_of_one_bucket_are_split_by_their_rarest_shingles(spark, monkeypatch):
    """Rows compared grow in proportion to the bucket, and no link is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "SPLIT_BLOCKS", 4)
    refined, split, compared = near_dedup._refined, [], {}
    monkeypatch.setattr(near_dedup, "_refined", lambda *a: split.append(refined(*a)) or split[-1])
    for n in (1250, 5000):
        split.clear()
        table = spark.createDataFrame(short_texts(n), "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table, 4).collect()}
        assert got == {i: i if i < n else i - n for i in got} and len(got) == n + n // 10
        sizes = split[0].where("second = 32").groupBy("bucket").count().select(F.sum(F.col("count") * F.col("count"))).first()[0]
        compared[n] = sizes or 0
    assert compared[5000] < 6 * max(compared[1250], 1) and compared[5000] < 20 * 5000, compared


def test_blocks_of_large_sets_hold_fewer_rows(spark, monkeypatch):
    """Sets of many shingles are dealt to more blocks, and no link is lost."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 4000)
    shared = [f"shared{i}" for i in range(900)]
    texts = [(i, " ".join(shared + [f"own{i}x{k}" for k in range(400)])) for i in range(12)]
    texts += [(100 + i, t + " more words") for i, t in texts[::3]]
    most, compare = [], near_dedup._links_of_large
    monkeypatch.setattr(near_dedup, "_links_of_large", lambda rows, *a: most.append(rows.agg(F.max(F.ceil(F.col("weight") / near_dedup.BLOCK_SHINGLES)), F.max("members")).first()) or compare(rows, *a))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()}
    assert got == {i: i % 100 for i in got} and most[0][0] > 1
