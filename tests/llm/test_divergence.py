"""Source divergence against every term of every pair written out in Python's whole numbers."""

import re
from collections import Counter, defaultdict

from scenequery.llm import divergence
from scenequery.llm.divergence import divergence as audited

COLUMNS = "doc_id long, text string, lang string, source string, term string, n long, rank int, value long, p long, item string"


def brute(rows, least=3, most=200):
    docs = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, seen, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        words = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(lower)))
        counts[lang, source] += words
        seen[lang].update(words.keys())
        langs[lang].add(source)
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def shares(own):
            total = sum(own[t] for t in kept)
            return {t: 1 + 1000000000 * (own[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found, end in (("pair", pairs, None), ("term", terms, most)):
                out |= {(lang, s, part, x[2], -x[0], i + 1) for i, x in enumerate(sorted(found)[:end])}
    return out


def rows_of(spark, rows):
    full = [(*r, "t", 1, 2, 3, 4, "i") for r in rows]
    return spark.createDataFrame(full, COLUMNS)


def test_awkward_rows(spark):
    long = "alpha " * 50_000 + "Beta\x00gamma"
    texts = ["Alpha beta gamma", "alpha BETA", "ÄÖ äö ÄÖ alpha", None, "", "123 --- 4", "alpha beta beta", "beta-gamma_delta", long, "ÄÖ", "Ｚ z 𝔘 𝔘", "𝔘 Ｚ", "Ｚ 𝔘 z"]
    rows = [(i, t, lang, source) for i, (t, lang, source) in enumerate(zip(texts * 3, ["en", "en", "de", None, "en", "fr"] * 7, ["a", "b", "é", "a", None, "c", "ｚ", "𝔘"] * 5))]
    rows += rows[:7] + [(None, "alpha beta", "en", "a"), (99, "only here", "xx", "one"), (100, "", "yy", "one"), (101, "!", "yy", "two")]
    got = [tuple(r) for r in audited(rows_of(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert {("yy", "one", "pair", "two", 0, 1), ("yy", "two", "pair", "one", 0, 1)} <= set(got)


def test_ranks_end_at_most(spark):
    rows = [(i, " ".join("".join(chr(97 + int(c)) for c in str(k)) for k in range(i % 5, 400, 1 + i % 3)), "en", f"s{i % 4}") for i in range(40)]
    got = {tuple(r) for r in audited(rows_of(spark, rows)).collect()}
    assert got == brute(rows)
    assert max(r[5] for r in got if r[2] == "term") <= 200


def test_empty(spark):
    assert audited(rows_of(spark, [(1, "a b", "en", "s")]).limit(0)).count() == 0


def test_counts_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 1)
    rows = [(i, f"alpha w{'abcdefgh'[i % 8]} beta", "en", f"s{i % 3}") for i in range(60)]
    assert {tuple(r) for r in audited(rows_of(spark, rows)).collect()} == brute(rows)
