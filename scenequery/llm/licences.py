"""Licence scans with a positional index of rare licence words.

The templates' words get a document frequency counted over all documents. The index holds
each template's rarest words with their places in it. In a file, every occurrence of an
indexed word looks up its postings; word place minus template place gives the start at
which the template would stand, occurrences that agree on a start are intersected there,
and a template is found where its mandatory key phrase stands word for word and the
indexed words found at the start carry enough of the index's weight.

All work on a text stays in its row, so no key, source or file is gathered anywhere; only
the document frequencies of the templates' few words are aggregated.

Defined results: a null or empty text has no words, places or labels and scores 0;
repeated rows are scanned alike; an empty table gives no rows; extra columns are ignored;
overlapping places all count; very long texts are scanned whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A licence passage; key is the place and length of the phrase that must stand word for word."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int]
    base: bool = False


def template(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
    words, phrase = tuple(text.split()), tuple((key or text).split())
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(label, words, (at, len(phrase)), base)


TEMPLATES = (
    template("cc-by", "cc by", base=True),
    template("gpl", "general public license", base=True),
    template("reserved", "all rights reserved", base=True),
    template("mit", "released under the mit license", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "www apache org licenses license 2 0"),
    template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc0", "released under cc0 1 0 universal", "cc0 1 0"),
    template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "either version 2 of the license"),
    template("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "either version 3 of the license"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("agpl", "gnu affero general public license", "affero general public license"),
    template("mpl-2.0", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    template("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided", "with the distribution this software is provided"),
    template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Words of a template that the index holds, the rarest first, and the share of their weight that must be found.
RARE, LEAST_SHARE = 4, 0.5
_ROOM = 2**32  # a start is below this, so template number and start fit one long


def words_of(text: Column | str) -> Column:
    """The words of a text, A-Z lower-cased."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def word_weights(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency, over all documents, of the templates' words."""
    known = sorted({w for t in templates for w in t.words})
    used = docs.select(F.array_distinct(F.filter(words_of("text"), lambda w: w.isin(known))).alias("own"))
    counts = used.select(F.explode(F.concat("own", F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}  # a row per template word at most; "" counts the documents
    n = found.get("", 0)
    return {w: round(math.log((n + 1) / (found.get(w, 0) + 1)) + 1, 6) for w in known}


def rare_words(t: Template, weights: dict[str, float], rare: int = RARE) -> list[tuple[int, str]]:
    """(place, word) of a template's rarest words, ties to the earlier place; the key phrase's rarest is always among them."""
    order = sorted(range(len(t.words)), key=lambda i: (-weights[t.words[i]], i))
    key = next(i for i in order if t.key[0] <= i < t.key[0] + t.key[1])
    return [(i, t.words[i]) for i in sorted({key, *[i for i in order if i != key][: rare - 1]})]


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE, least: float = LEAST_SHARE) -> DataFrame:
    """doc_id, n_words and found: label, base, start, words and score of every place found."""
    weights = word_weights(docs, templates)
    index = [rare_words(t, weights, rare) for t in templates]
    postings: dict[str, list[int]] = {}
    for no, entries in enumerate(index):
        for place, word in entries:
            postings.setdefault(word, []).append(no * _ROOM - place)
    # the longest template's words go before the text, so that no start is negative
    ahead = max(len(t.words) for t in templates)
    table = F.create_map(*[x for w, p in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.lit(v).cast("long") for v in p]))])
    lookups = sorted(postings)
    texts = docs.select("doc_id", words_of("text").alias("words"))
    texts = texts.withColumn("places", F.filter(F.transform("words", lambda w, i: F.when(w.isin(lookups), i)), lambda i: i.isNotNull()))
    starts = F.array_distinct(F.flatten(F.transform("places", lambda i: F.transform(F.element_at(table, F.get("words", i)), lambda p: p + i + ahead))))
    texts = texts.withColumn("starts", starts)

    def weigh(code: Column) -> Column:
        start = (code % _ROOM - ahead).cast("int")
        out = F.lit(None).cast("double")
        for no in reversed(range(len(templates))):
            t, entries = templates[no], index[no]
            total = sum(weights[w] for _, w in entries)
            share = sum((F.when(F.get("words", start + place) == word, weights[word]).otherwise(0.0) for place, word in entries), F.lit(0.0)) / total
            key = F.lit(True)
            for k in range(t.key[0], t.key[0] + t.key[1]):
                key = key & F.coalesce(F.get("words", start + k) == t.words[k], F.lit(False))
            out = F.when(F.shiftright(code, 32) == no, F.when(key, F.round(share, 6))).otherwise(out)
        return out

    names, bases = _strings(t.label for t in templates), F.array(*[F.lit(t.base) for t in templates])
    keys = F.array(*[F.lit(t.key[0]) for t in templates])
    lengths = F.array(*[F.lit(t.key[1]) for t in templates])
    no = lambda code: F.shiftright(code, 32).cast("int")
    found = F.transform(
        "starts",
        lambda code: F.struct(
            F.get(names, no(code)).alias("label"),
            F.get(bases, no(code)).alias("base"),
            (code % _ROOM - ahead + F.get(keys, no(code))).alias("start"),
            F.get(lengths, no(code)).alias("words"),
            weigh(code).alias("score"),
        ),
    )
    return texts.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(found, lambda f: f["score"] >= least).alias("found"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    places = F.transform(F.filter("found", lambda f: f["base"]), lambda f: f["start"])
    joined = lambda keep: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("found", keep), lambda f: f["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(lambda f: f["base"]).alias("base_labels"),
        joined(lambda f: F.lit(True)).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE, least: float = LEAST_SHARE) -> str:
    """The scan in DuckDB SQL, from the same templates."""
    rows = ", ".join(f"({n}, '{t.label}', {t.base}, {i}, '{w}', {t.key[0] <= i < t.key[0] + t.key[1]})" for n, t in enumerate(templates) for i, w in enumerate(t.words))
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
tpl(t, label, base, place, word, key) AS (VALUES {rows}),
tok AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM texts),
lic AS (SELECT * FROM tok WHERE word IN (SELECT word FROM tpl)),
df AS (SELECT word, count(DISTINCT r) AS n FROM lic GROUP BY word),
weights AS (SELECT w.word, round(ln(((SELECT count(*) FROM texts) + 1) / (coalesce(df.n, 0) + 1)) + 1, 6) AS weight
  FROM (SELECT DISTINCT word FROM tpl) w LEFT JOIN df ON w.word = df.word),
ranked AS (SELECT tpl.*, weight, row_number() OVER (PARTITION BY t ORDER BY weight DESC, place) AS k FROM tpl JOIN weights USING (word)),
keyed AS (SELECT *, (k = min(CASE WHEN key THEN k END) OVER (PARTITION BY t)) AS top FROM ranked),
idx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY top DESC, k) AS q FROM keyed) WHERE q <= {rare}),
total AS (SELECT t, sum(weight) AS w FROM idx GROUP BY t),
starts AS (SELECT DISTINCT lic.r, idx.t, lic.i - idx.place AS s FROM lic JOIN idx USING (word)),
share AS (SELECT s.r, s.t, s.s, sum(idx.weight) AS w FROM starts s JOIN idx ON idx.t = s.t JOIN lic ON lic.r = s.r AND lic.i = s.s + idx.place AND lic.word = idx.word GROUP BY ALL),
keys AS (SELECT t, count(*) AS n, min(place) AS k0, any_value(label) AS label, any_value(base) AS base FROM tpl WHERE key GROUP BY t),
whole AS (SELECT s.r, s.t, s.s FROM starts s JOIN tpl ON tpl.t = s.t AND tpl.key JOIN lic ON lic.r = s.r AND lic.i = s.s + tpl.place AND lic.word = tpl.word JOIN keys ON keys.t = s.t GROUP BY s.r, s.t, s.s, keys.n HAVING count(*) = keys.n),
found AS (SELECT h.r, k.label, k.base, h.s + k.k0 AS start, round(s.w / total.w, 6) AS score FROM whole h JOIN share s ON s.r = h.r AND s.t = h.t AND s.s = h.s JOIN total ON total.t = h.t JOIN keys k ON k.t = h.t WHERE round(s.w / total.w, 6) >= {least})
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base,
  CAST(min(start) FILTER (base) AS BIGINT) AS first_word, CAST(max(start) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(score), 0.0) AS score
FROM texts LEFT JOIN found ON found.r = texts.r GROUP BY texts.r, doc_id, ws"""
