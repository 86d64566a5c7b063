"""Every operator against a brute-force version or its SQL, on small tables with awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scenequery.llm import chat, language, licences, line_dedup, lm_scoring, mixing, near_dedup, neighbours, packing, quality, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, _key string, chunk int, row_key int, _id int, part int, place int, size int"
LONG = " ".join(f"w{i % 977}" for i in range(20000))
PROSE = "\n".join(" ".join(f"line{i}word{j}" for j in range(12)) for i in range(8))


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(k, "s"), 0, 1, "k", 2, 3, 4, 5, 6, 7) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (None, PROSE), (5, " \n\t "), (6, LONG), (7, "one two"), (8, "One TWO"), (9, PROSE + "\nand a further line"), (10, "x")]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, same, name):
    same(registry.QUERIES[name](spark, DATA), registry.ORACLE_SQL[name])


# op1


def places(text, phrase):
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    p = phrase.split()
    return words, [i for i in range(len(words)) if words[i : i + len(p)] == p]


def test_licence_places(spark):
    texts = ["All rights reserved. ALL RIGHTS RESERVED", "cc by cc-by/CC BY", "the General-Public License general public", None, "", "all rights", "ÀLL rights reserved", LONG + " cc by", "Released under the MIT License."]
    got = {r["doc_id"]: r for r in licences.scan(docs(spark, enumerate(texts))).collect()}
    for i, text in enumerate(texts):
        base = sorted(p for phrase in ("cc by", "general public license", "all rights reserved") for p in places(text, phrase)[1])
        assert sorted(f["start"] for f in got[i]["found"] if f["base"]) == base
        assert got[i]["n_words"] == len(places(text, "x")[0])
    assert [f["label"] for f in got[8]["found"]] == ["mit"] and got[8]["found"][0]["score"] == 1.0


def test_licence_templates_and_near_misses(spark):
    yes = {
        "gpl-2.0": "You can modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "gpl-3.0": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or later",
        "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
        "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "bsd-2-clause": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
    }
    no = ["a boost to software, license pending", "either version 2 or the other licence of the film", "Redistribution in source form", "we promote products derived from software", "visit www.apache.org for helicopters", "the gnu public"]
    got = {r["doc_id"]: {f["label"] for f in r["found"]} - {"gpl"} for r in licences.scan(docs(spark, enumerate([*yes.values(), *no]))).collect()}
    assert [got[i] for i in range(len(yes))] == [{k} for k in yes] and not any(got[len(yes) + i] for i in range(len(no)))


def test_licence_awkward_rows(spark, awkward):
    assert licences.scan(awkward).count() == len(AWKWARD) and licences.scan(awkward.limit(0)).count() == 0


# op2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=8))
def test_targets(sizes):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    out = mixing.targets_for(sizes, weights, 1.5 * sum(sizes), 2)
    assert math.isclose(sum(out), 1.5 * sum(sizes)) and all(t <= 2 * n + 1e-9 for t, n in zip(out, sizes))
    free = [t / w for t, w, n in zip(out, weights, sizes) if n and t < 2 * n - 1e-9]
    assert not free or max(free) - min(free) < 1e-6 * max(free) and all(t / w <= max(free) * (1 + 1e-9) for t, w in zip(out, weights))


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 1000])
def test_permutations(n):
    out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
    assert sorted(out) == list(range(n)) and all(mixing.unpermuted(int(y), n, 99) == j for j, y in enumerate(out))


def test_shard_counts_add_up():
    slots = np.array([10, 0, 500, 3])
    out = mixing.shard_counts(slots, 7, 1)
    assert (out.sum(axis=0) == slots).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 1
    assert (mixing.shard_counts(slots, 7, 1) == out).all()


def test_mix_meets_its_targets(table):
    documents, takes = mixing.mix(table, shards=5)
    by = {r["source"]: r for r in takes.groupBy("source").agg(F.sum("words").alias("n"), F.countDistinct("shard").alias("s")).collect()}
    for r in documents.groupBy("source").agg(F.first("target").alias("t")).collect():
        assert abs((by[r["source"]]["n"] if r["source"] in by else 0) - r["t"]) < 1
    assert takes.groupBy("source", "place", "epoch").agg(F.sum("words").alias("n")).join(documents.where("size > 0"), ["source", "place"]).where("n > size").count() == 0


def test_mix_of_awkward_rows(spark, awkward):
    documents, takes = mixing.mix(awkward.withColumn("source", F.when(F.col("doc_id") != 1, F.col("source"))))
    assert documents.count() == len(AWKWARD)
    assert documents.where("source is null").select("size").agg(F.sum("size")).first()[0] > 0
    assert mixing.mix(awkward.limit(0))[0].count() == 0 and mixing.mix(awkward.limit(0))[1].count() == 0


def brute_mix(rows, shards, block, seed=7):
    """(source, place, epoch) -> words taken, slot by slot, from the operator's order of documents and its draws."""
    names = sorted({r["source"] for r in rows}, key=lambda x: (x is None, x or ""))
    order = {n: sorted((r for r in rows if r["source"] == n and r["size"]), key=lambda r: r["place"]) for n in names}
    sizes = [sum(r["size"] for r in order[n]) for n in names]
    wanted = mixing.targets_for(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    taken = Counter()
    for i, n in enumerate(names):
        words = [(r["place"], k) for r in order[n] for k in range(r["size"])]
        blocks = [words[a : a + block] for a in range(0, len(words), block)]
        left, epoch = min(round(wanted[i]), 2 * sizes[i]), 0
        while left:
            key = mixing._perm_key(np.array([i]), np.array([epoch]), seed)
            for y in mixing.permuted(np.arange(len(blocks)), np.full(len(blocks), len(blocks)), np.repeat(key, len(blocks))):
                own = blocks[y][:left]
                left -= len(own)
                taken.update((n, place, epoch) for place, _ in own)
            epoch += 1
    return dict(taken)


def test_mix_is_brute_force_and_repeats(spark, table):
    rows = table.limit(40).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(3)).cast("string").alias("s"), "lang", "n_chars")
    twice = rows.select("doc_id", "text", F.when(F.col("s") != "2", F.col("s")).alias("source"), "lang", "n_chars").unionByName(rows.limit(15).select("doc_id", "text", F.lit("again").alias("source"), "lang", "n_chars"))
    documents, takes = mixing.mix(twice, block_words=16, shards=7)
    got = {(r["source"], r["place"], r["epoch"]): r["n"] for r in takes.groupBy("source", "place", "epoch").agg(F.sum("words").alias("n")).collect()}
    assert got == brute_mix(documents.collect(), 7, 16)
    again = mixing.mix(twice.repartition(5), block_words=16, shards=7)[1]
    assert sorted(map(tuple, takes.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_sources_of_one_text_keep_their_words(spark):
    rows = [(1, "w " * 400, s, k) for s, k in (("s1", 1), ("s1", 2), ("s2", 3), (None, 4))]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    documents, _ = mixing.mix(table)
    wanted = {r["source"]: r["target"] for r in documents.collect()}
    size = F.regexp_count("text", F.lit(r"\S+"))
    got = {r["source"]: r["n"] for r in mixing.mixed_documents(table).groupBy("source").agg(F.sum(size).alias("n")).collect()}
    assert all(abs(got[s] - t) < 1 for s, t in wanted.items())


def test_mixed_documents_keep_their_words(awkward):
    out = mixing.mixed_documents(awkward)
    texts = {t for _, t in AWKWARD if t}
    for r in out.collect():
        assert any(r["text"] in t for t in texts) or all(w in " ".join(texts).split() for w in r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert set(out.columns) == set(awkward.columns)


# op3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 700), min_size=1, max_size=60))
def test_windows_hold_their_capacity(sizes):
    sizes = np.array(sizes)
    into = packing.windows_for(sizes, 700)
    load = np.bincount(into, sizes)
    assert load.max() <= 700 and len(load) >= sizes.sum() / 700


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(0).integers(1, 600, 256)
    load = np.bincount(packing.differencing(sizes, 40), sizes)
    assert len(load) == 40 and load.max() - load.min() <= 0.05 * load.mean()


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 10000))
def test_cuts_cover(n):
    cuts = packing.cut_points(n, 2048, 682)
    assert sum(x for _, x in cuts) == n and all(a + x == b for (a, x), (b, _) in zip(cuts, cuts[1:])) and all(x == 2048 or x <= 682 for _, x in cuts)


def test_ids_are_the_tokenizers(table):
    from tokenizers import Tokenizer

    reference, encode = Tokenizer.from_file(packing.tokenizer_path()), packing.load_encoder(packing.tokenizer_path())
    rng = random.Random(1)
    pieces = ["a", "  ", "\n", "é", "ß", "<|endoftext|>", "<|endof", "漢", "​", "́", "😀", "12", "'s", "\x00", " ", "²", "\x85", " "]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(500)]
    for text in [*made, *(r["text"] for r in table.select("text").limit(50).collect())]:
        assert reference.encode(text, add_special_tokens=False).ids == encode(text).tolist()


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "a", " \n", "\u3000"])
def test_ids_of_long_runs(unit):
    text = "x" + unit * 2_000_000 + "y"
    assert packing.load_encoder(packing.tokenizer_path())(text).tolist() == packing.own_library(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_pieces_are_slices_of_the_tokenizers_ids(spark, table):
    texts = [*AWKWARD, (40, " " * 700_000), *[(r["doc_id"] + 100, r["text"]) for r in table.limit(40).collect()]]
    library, expected = packing.own_library(packing.tokenizer_path()), Counter()
    for i, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for start, length in packing.cut_points(len(ids), 2048, 682):
            expected[i, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids)] += 1
    rows = packing.pack(docs(spark, texts)).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_packed_pieces(spark, awkward):
    rows = packing.pack(awkward, keep_ids=True).toPandas()
    encode = packing.load_encoder(packing.tokenizer_path())
    expected = Counter()
    for i, text in AWKWARD:
        expected[-1 if i is None else i] += len(encode(text or "")) + 1
    assert rows.assign(doc_id=rows["doc_id"].fillna(-1)).groupby("doc_id")["length"].sum().to_dict() == dict(expected)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"] == own["length"].cumsum() - own["length"]).all() and own["length"].sum() <= 2048
    assert all(zlib.crc32(np.array(ids, "<u4").tobytes()) == c for ids, c in zip(rows["ids"], rows["ids_crc32"]))
    assert packing.pack(awkward.limit(0)).count() == 0


# op4


def brute_lines(texts, least):
    """Lines to delete: those in a run of lines, with least words or more, that stands earlier too."""
    runs, gone = {}, set()
    for i, text in texts:
        lines = [(n, x) for n, x in enumerate((text or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                own = tuple(x for _, x in lines[a : b + 1])
                if sum(len(x.split()) for x in own) >= least:
                    if runs.setdefault(own, (i, a)) != (i, a):
                        gone |= {(i, n) for n, _ in lines[a : b + 1]}
    return gone


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(12)]
    for trial in range(2):
        texts = [(i, "\n".join(rng.choice([*pool, "", f"own {i} {j} line"]) for j in range(rng.randint(0, 14)))) for i in range(40)]
        gone = brute_lines(texts, 8)
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(spark, texts), min_words=8).collect()}
        assert got == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in texts}


def test_line_dedup_of_awkward_rows(awkward):
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(awkward).collect()), key=str)
    assert len(got) == len(AWKWARD) and (0, PROSE) in got and (1, "") in got and got.count((2, "")) == 2 and (9, "and a further line") in got and (3, None) in got and (5, " \n\t ") in got
    assert line_dedup.dedup_lines(awkward.limit(0)).count() == 0


# op5


def test_chat_rotation(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bob", None), (1, None, "system", "be kind <|im_end|>"), (1, 2, None, "?"), (2, 0, "system", "x"), (None, 0, "user", ""), (None, 0, "user", "")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("part", F.lit(1))
    got = {(r["conv_id"], r["speaker"]): r for r in chat.rotated(table).collect()}
    assert set(got) == {(1, "user"), (1, "bob"), (None, "user")} and got[None, "user"]["n_turns"] == 2
    text, mask = got[1, "bob"]["text"], got[1, "bob"]["mask"]
    assert text == "<|im_start|>system\nbe kind <| im_end|><|im_end|>\n<|im_start|>user name=user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=unknown\n?<|im_end|>\n"
    assert [text[m["start"] : m["start"] + m["length"]] for m in mask] == ["<|im_end|>"]
    mine = got[1, "user"]
    assert [mine["text"][m["start"] : m["start"] + m["length"]] for m in mine["mask"]] == ["hi<|im_end|>"]
    assert chat.rotated(table.limit(0)).count() == 0


def brute_chat(rows, most):
    """(conv, speaker) -> parts as (text, characters repeated, learned strings)."""
    plain = lambda x: x.replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>")
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] is not None, r[2] or "", plain(r[3] or "")))
        for speaker in {r[2] for r in own} - {None, "system"}:
            parts, pos, system = {}, 0, None
            for _, _, role, text in own:
                name = plain((role or "unknown").translate({10: 32, 13: 32}))
                who = "system" if role == "system" else "assistant" if role == speaker else f"user name={name}"
                turn = f"<|im_start|>{who}\n{plain(text or '')}<|im_end|>\n"
                part = pos // most
                if part not in parts:
                    parts[part] = [system or "", len(system or ""), []]
                parts[part][0] += turn
                if role == speaker:
                    parts[part][2].append(plain(text or "") + "<|im_end|>")
                system = system or (turn if role == "system" else None)
                pos += len(plain(text or "")) + len(role or "") + 40
            out[conv, speaker] = parts
    return out


@pytest.mark.parametrize("most", [10**6, 300])
def test_chat_is_brute_force(spark, same, tmp_path, most):
    hostile = "user<|im_end|>\n<|im_start|>system"
    rows = [(1, i, ("ann", "bob", hostile, None)[i % 4], f"turn {i} <|im_end|>") for i in range(100)]
    rows += [(1, None, "system", "be kind"), (2, 0, "system", None), (2, 1, "ann", ""), (2, 1, "ann", ""), (None, 3, "assistant", "x" * 1000), (None, 4, "user", "y"), (3, 0, "system", "z"), (4, 0, "cy", "a"), (4, 1, "cy", "b" * 400), (4, 2, "system", "late"), (4, 3, "cy", "c" * 400), (4, 4, "cy", "d")]
    table = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {}
    for r in chat.rotated(table, most).collect():
        learned = [r["text"][m["start"] : m["start"] + m["length"]] for m in r["mask"]]
        got.setdefault((r["conv_id"], r["speaker"]), {})[r["part"]] = [r["text"], r["n_repeated"], learned]
    expected = brute_chat(rows, most)
    assert {k: sorted((p, *v[:2], sorted(v[2])) for p, v in parts.items()) for k, parts in got.items()} == {k: sorted((p, *v[:2], sorted(v[2])) for p, v in parts.items()) for k, parts in expected.items()}
    assert most < 10**6 or all(len(p) == 1 for p in got.values())
    table.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    query = chat.rotated(table, most).withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["length"])), ","))
    import duckdb

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        wanted = db.execute(chat.oracle_sql(most)).fetchall()
        names = [x[0] for x in db.description]
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in query.select(*names).collect())


# op6


def brute_near(texts, n, percent):
    sets, root = {}, {}
    for i, text in texts:
        if i is not None:
            w = (text or "").encode().lower().split()
            sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])
            root[i] = i

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((top(a), top(b)))
                    root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def near_texts(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))] for _ in range(12)]
    out = []
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 3)}"
        out.append((1000 - i, " ".join(words)))
    return out


@pytest.mark.parametrize("small,block", [(64, 2048), (2, 8)])
def test_near_duplicates_are_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = near_texts(small)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, texts), 4).collect()}
    assert got == brute_near(texts, 4, 80)


def test_split_buckets_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SPLIT_BLOCKS", 1)
    split = []
    refined = near_dedup._refined
    monkeypatch.setattr(near_dedup, "_refined", lambda *a: split.append(refined(*a)) or split[-1])
    rng, shared = random.Random(8), [f"shared{i}" for i in range(40)]
    texts = []
    for i in range(90):  # unlike documents around one passage, a third of them with an altered copy; and short ones
        own = shared + [f"{rng.choice('abcd')}{rng.randint(0, 9999)}" for _ in range(60)]
        texts.append((i, " ".join(own)))
        if i % 3 == 0:
            own[rng.randrange(40, 100)] = "altered"
            texts.append((1000 - i, " ".join(own)))
        texts.append((2000 + i, " ".join(shared[: rng.randint(4, 12)])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, texts), 4).collect()}
    assert got == brute_near(texts, 4, 80)
    seconds = {r["second"] for r in split[0].select("second").distinct().collect()}
    assert 32 in seconds and len(seconds) > 5, sorted(seconds)


def test_near_duplicates_of_awkward_rows(awkward):
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in rows}
    assert got[2] == (1, False) and got[3] == (3, True) and got[4] == (4, True) and got[5] == (5, True) and got[8] == (7, False) and got[9] == (1, False) and got[None] == (None, True)
    assert near_dedup.near_duplicates(awkward.limit(0)).count() == 0


def test_texts_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{j}" for j in range(30)) for x in "abc")
    table = docs(spark, [(1, a), (2, a), (2, b), (3, b), (4, c), (5, ""), (2, ""), (6, c), (6, a)])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table, 4).collect())
    assert got == [(1, 27, 1, True), (2, 0, 2, True), (2, 27, 1, False), (2, 27, 1, False), (3, 27, 1, False), (4, 27, 1, False), (5, 0, 5, True), (6, 27, 1, False), (6, 27, 1, False)]
    kept = sorted((r["doc_id"], r["text"]) for r in near_dedup.deduplicated(table.unionByName(docs(spark, [(None, a), (None, a)]))).where("doc_id is not null").collect())
    assert kept == sorted([(1, a), (2, b), (4, c), (5, ""), (2, "")])


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.9):
        a = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        b = np.r_[a[: int(4000 * share)], rng.integers(0, 2**63, 4000 - int(4000 * share)).astype(np.uint64)]
        ra, rb = near_dedup.registers(np.unique(a)), near_dedup.registers(np.unique(b))
        truth = share / (2 - share)
        assert abs((ra == rb).mean() - truth) < 0.15 and near_dedup.can_link(ra, rb, 80) == (truth > 0.7)


# op7


def brute_lm(texts, order, priors, least):
    """Counts as dictionaries, and a walk along explicit failure arcs from the longest context."""
    counts, read = Counter(), []
    for i, t in texts:
        own = ["<s>", *(t or "").encode().lower().split(), None]
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
        read.append((i, held, own))
        if not held:
            counts["<s>",] += 1
            counts.update(tuple(own[j - k : j]) for k in range(1, order + 1) for j in range(k, len(own) + 1) if own[j - k : j] != ["<s>"])
    after = {}
    for gram, c in counts.items():
        if len(gram) > 1:
            after.setdefault(gram[:-1], {})[gram[-1]] = c
    single = {g[0]: c for g, c in counts.items() if len(g) == 1 and g[0] != "<s>"}
    n, v = sum(single.values()), len(single)

    def arcs(h):
        return {w: c for w, c in after.get(h, {}).items() if c >= (least if len(h) > 1 else 1)}

    def failing(h):
        prior, total = priors[min(len(h) - 1, len(priors) - 1)], counts[h]
        return (prior + sum(after.get(h, {}).values()) - sum(arcs(h).values())) / (total + prior)

    def chance(h, w):
        if not h:
            return (single.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
        own = arcs(h).get(w, 0)
        return own / (counts[h] + priors[min(len(h) - 1, len(priors) - 1)]) + failing(h) * chance(h[1:], w)

    out = []
    for i, held, own in read:
        base = score = 0.0
        for j in range(1, len(own)):
            w, h = own[j], tuple(own[max(0, j - order + 1) : j])
            base += math.log10(chance((), w))
            while h and w not in arcs(h):
                score += math.log10(failing(h))
                h = h[1:]
            score += math.log10(chance(h, w))
        out.append((i or 0, held, len(own) - 1, sum(single.get(w, 0) > 0 for w in own[1:]), n, base, score))
    for h in list(after)[:20]:  # with one unseen token, every context's probabilities add up to 1
        assert math.isclose(sum(chance(h, w) for w in [*single, "a token that no text holds"]), 1)
    return sorted(out)


@pytest.mark.parametrize("order,least,sizes", [(2, 2, {}), (3, 2, {}), (3, 1, {"chunk_chars": 3000, "part_keys": 400}), (3, 3, {"chunk_chars": 3000, "part_keys": 2000, "fan": 3}), (4, 2, {"chunk_chars": 20_000})])
def test_scores_are_brute_force(spark, table, order, least, sizes):
    texts = [*AWKWARD, *[(r["doc_id"] + 100, r["text"]) for r in table.limit(60).collect()], *[(77, "the same row " * 3)] * 30]
    got = lm_scoring.scored(docs(spark, texts), order=order, least=least, **sizes).collect()
    rows = sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    for a, b in zip(rows, brute_lm(texts, order, lm_scoring.PRIORS, least), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_scores_of_an_empty_table_and_repeated_rows(spark):
    assert lm_scoring.scored(docs(spark, [])).count() == 0
    same = docs(spark, [(1, "a b")] * 500).repartition(3)
    assert lm_scoring.chunked(same, 40).agg(F.max(F.size("ids"))).first()[0] <= 10
    assert {r["train_tokens"] for r in lm_scoring.scored(same, chunk_chars=40).collect()} == {1500}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abAB\u00e9\u00c9 \t\n\x0b\x1f\x00\u00a0", max_size=12), min_size=1, max_size=6))
def test_tokens_are_words_and_ends(texts):
    raw = [t.encode() for t in texts]
    tokens, ends = lm_scoring.tokens_of(raw)
    expected = [w for t in raw for w in [*t.lower().split(), None]]
    assert len(tokens) == len(expected) and ends.tolist() == np.cumsum([len(t.split()) + 1 for t in raw]).tolist()
    assert len({(int(x), w) for x, w in zip(tokens, expected)}) == len(set(tokens.tolist())) == len(set(expected))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(2**64 - 40, 2**64 - 1), st.integers(0, 2**64 - 1)), max_size=60))
def test_distinct_keys(values):
    keys = np.array(values, np.uint64)
    own, where, number = lm_scoring.distinct(keys)
    assert own.tolist() == sorted(set(values)) and (keys[where] == own).all() and (own[number] == keys).all()


def test_long_stretches_of_words_have_the_same_hashes(monkeypatch):
    text = " ".join(f"word{i % 50}" for i in range(5000)).encode() + b" " + b"x" * 900
    whole = lm_scoring.tokens_of([text])[0]
    monkeypatch.setattr(lm_scoring, "_STRETCH", 64)
    assert (lm_scoring.tokens_of([text])[0] == whole).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(2**60, 2**61 - 1), unique=True, max_size=40))
def test_squeezed_keys_come_back(values):
    keys = np.array(sorted(values), np.uint64)
    assert (lm_scoring.widened(lm_scoring.squeezed(keys), len(keys)) == keys).all()


def test_the_model_beats_the_base_on_held_out_texts(table):
    held = lm_scoring.scored(table).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


# op8


def brute_counts(text):
    words = (text or "").encode().split()
    tri = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i, t in enumerate(zip(words, words[1:], words[2:])) if tri[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_rule_counts(spark, table):
    texts = [*AWKWARD, (20, "a b c a b c a b c"), (21, "é#é | x\n\né#é | x y"), *[(r["doc_id"] + 100, r["text"]) for r in table.collect()]]
    got = sorted((r["doc_id"] or 0, *(r[c] for c in quality.COUNTS)) for r in quality.rule_statistics(docs(spark, texts)).collect())
    assert got == sorted((i or 0, *brute_counts(t)) for i, t in texts)


def test_forest_and_threshold_are_brute_force(spark):
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 200, (300, 9))
    forest = quality.grow_forest(quality.features(counts), trees=16, sample=64)
    harmonic = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    assert math.isclose(forest["norm"], harmonic(64))
    for row, got in zip(quality.features(counts), quality.anomaly(forest, quality.features(counts))):
        total = 0.0
        for which, split, path in zip(forest["which"], forest["split"], forest["path"]):
            node = 0
            while which[node] >= 0:
                node = 2 * node + (2 if row[which[node]] > split[node] else 1)
            depth = (node + 1).bit_length() - 1
            assert depth == quality.DEPTH or path[node] - depth in (0.0, harmonic(2)) or path[node] > depth
            total += path[node]
        assert math.isclose(got, 2 ** (-total / 16 / harmonic(64)), rel_tol=1e-9)
    marks = [(i, int(rng.random() < 0.6), round(float(rng.random()), 2)) for i in range(200)]
    scored = spark.createDataFrame([(i, False, a) for i, _, a in marks] + [(999, True, 0.0)], "doc_id long, base_failed boolean, anomaly double")
    labels = spark.createDataFrame([(i, q) for i, q, _ in marks] + [(999, 1)], "doc_id long, quality int")
    for loss in (0.0, 0.05, 0.5):
        good = [a for _, q, a in marks if q]
        allowed = [t for t in {a for *_, a in marks} if sum(a >= t for a in good) <= loss * len(good)]
        assert quality.threshold_for(scored, labels, loss) == min(allowed, default=2.0)


def test_good_documents_are_kept_and_junk_goes(spark):
    whole = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    labels = spark.read.parquet(DATA.replace("0.001", "0.01") + "/labels.parquet")
    rows = quality.judged(whole, labels).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()
    share = {r["quality"]: r["k"] for r in rows}
    assert share[1] >= 0.98 and share[0] <= 0.5


def test_quality_of_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (6, 0, 0), (6, 7, None)], "doc_id long, quality int, toxic int")
    rows = quality.judged(awkward, labels).collect()
    assert len(rows) == len(AWKWARD) and all(not r["kept"] for r in rows if r["n_words"] < 50)
    for few in (labels, labels.limit(0)):
        assert quality.judged(awkward.limit(0), few).count() == 0 and quality.kept_documents(awkward.limit(0), few).count() == 0
    kept = quality.kept_documents(awkward, labels.limit(0))
    assert kept.columns == awkward.columns and kept.count() <= len(AWKWARD)


# op9


def test_languages_of_unseen_pages(spark, table):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    found = language.identify(pages, table).join(pages, "page_id")
    truth = F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1)
    assert found.where(truth != F.col("lang")).count() == 0


def test_posteriors_are_brute_force(spark, table):
    """The same evidence, multiplied page by page from plain dictionaries."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(80).collect() + [(9001, None, "<html lang=de>"), (9002, "http://a.b.example.fr/x", None)]
    pages = [tuple(p)[:3] for p in pages]
    names, logs = language.fit(table)
    n, half, weight = len(names), language.ADDED, language.PARENT_WEIGHT
    read = []
    for page_id, url, html in pages:
        import re

        host = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", url or "")
        host = host.group(1).lower() if host else None
        said = re.search(language._DECLARED, html or "")
        said = said.group(1).lower() if said else None
        own = language.trigram_counts(language.page_text(html))
        text = (logs @ own) * (min(own.sum(), language.MOST_TRIGRAMS) / own.sum() if own.sum() else 0)
        domain = re.search(r"([^.]+\.[^.]+)$", host or "")
        read.append({"id": page_id, "said": said if said in names else said and "other", "suffix": host and host.split(".")[-1], "host": host, "domain": (domain.group(1) if domain else "") if host else None, "text": text, "first": int(np.argmax(text)) if text.any() else None})
    overall = np.array([sum(r["first"] == i for r in read) for i in range(n)])

    def counted(field, value):
        return np.array([sum(r["first"] == i and r[field] == value for r in read) for i in range(n)])

    expected = {}
    for r in read:
        prior = (overall + half) / (overall.sum() + half * n)
        for field in ("domain", "host"):
            own = counted(field, r[field]) if r[field] is not None else np.zeros(n)
            prior = (own + weight * prior) / (own.sum() + weight)
        total = r["text"] + np.log(prior)
        for field in ("said", "suffix"):
            if r[field] is not None:
                total = total + np.log((counted(field, r[field]) + half) / (overall + 1))
        chance = np.exp(total - total.max())
        expected[r["id"]] = (names[int(np.argmax(total))], chance.max() / chance.sum())
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for r in language.identify(frame, table).collect():
        assert r["lang"] == expected[r["page_id"]][0] and r["score"] == pytest.approx(expected[r["page_id"]][1], abs=2e-6)


def test_language_of_awkward_pages(spark, table):
    rows = [(1, None, None), (2, "", ""), (3, "nonsense", "<html lang='DE-at'>"), (3, "nonsense", "<html lang='DE-at'>"), (4, "http://u:p@h.example.fr:80/x", "<p>" + "les eaux " * 3), (5, "http://h.example.fr", "<html lang=klingon><script>var x='the of and'</script>")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("first", F.lit("x"))
    got = language.identify(pages, table).collect()
    assert len(got) == len(rows) and all(r["lang"] in ("de", "en", "es", "fr") for r in got)
    assert language.identify(pages.limit(0), table).count() == 0 and language.identify(pages, table.limit(0)).count() == 0


# op10


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def brute_nearest(vectors, k=5):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    out = {}
    for q in ids:
        if q % 50 == 0:
            v = np.array(vectors[q])
            score = x @ v / np.sqrt((x * x).sum(1) * (v * v).sum())
            out[q] = [i for _, i in sorted((-round(s, 12), i) for s, i in zip(score, ids) if i != q)[:k]]
    return out


def test_nearest_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet")
    truth = brute_nearest({r["vec_id"]: [float(v) for v in r["embedding"]] for r in rows.collect()})
    found = {}
    for r in neighbours.nearest(rows).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert sum(len(set(found[q]) & set(t)) for q, t in truth.items()) >= 0.9 * 5 * len(truth)


def test_nearest_of_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0]), (1, [2.0, 0.0]), (50, [0.0, 1.0]), (9, [-0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id int, embedding array<double>").withColumn("rank", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(table).orderBy("query_id", "rank").collect()]
    h = round(0.5**0.5, 6)
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, h), (0, 3, 9, 0.0), (0, 4, 50, 0.0), (50, 1, 9, 1.0), (50, 2, 2, h), (50, 3, 0, 0.0), (50, 4, 1, 0.0)]
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_nearest_of_every_length_and_size(spark):
    rows = [(50, [1.0, 0.0, 0.0]), (51, [1.0, 1.0, 0.0]), (100, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 1e-201]), (3, [-1e-320, 0.0]), (4, [0.0, 7.0]), (4, [3.0, 0.0]), (100, [0.0, 2.0]), (150, [5.0])]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).orderBy("query_id", "rank").collect()]
    h = round(0.5**0.5, 6)
    assert got == [(50, 1, 51, h), (100, 1, 4, 1.0), (100, 2, 2, round(1 / 1.01**0.5, 6)), (100, 3, 1, h), (100, 4, 3, 0.0)]


def test_scaling_changes_no_digit():
    v = np.random.default_rng(1).standard_normal((200, 64))
    s = neighbours.scaled(v)
    plain = np.einsum("ij,j->i", v, v[0]) / (np.sqrt(np.einsum("ij,ij->i", v, v)) * np.sqrt(np.einsum("i,i->", v[0], v[0])))
    assert (neighbours.cosines(s[0], s, neighbours.sizes_of(s)) == plain).all()


def test_clustered_vectors_get_narrow_windows(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((400, 32))
    rows = [(i, (centres[i % 400] + 0.05 * rng.standard_normal(32)).tolist()) for i in range(8000)]
    truth = brute_nearest(dict(rows))
    shares, fit = [], neighbours.window_share
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(neighbours, "window_share", lambda *a, **k: shares.append(fit(*a, **k)) or shares[-1])
        found = {}
        for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert shares[0] < 0.01 and sum(len(set(found[q]) & set(t)) for q, t in truth.items()) >= 0.9 * 5 * len(truth)


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 1.0]) for i in range(10)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 3, 4, 5]


def test_nearest_of_queries_unlike_the_other_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((150, 64))
    rows = [(i, (rng.standard_normal(64) if i % 50 == 0 else centres[i % 150] + rng.standard_normal(64) * 0.02).tolist()) for i in range(12000)]
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id int, embedding array<double>")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == brute_nearest(dict(rows))
