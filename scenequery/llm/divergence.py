"""How far each source of a language departs from the others and from the language as a whole.

The value of a pair of groups is a sum over all kept terms of a function of two smoothed
shares, and a share depends only on how often the group has the term. So the sum is taken by
inclusion and exclusion over the terms that the groups have: a constant covers every term as
if both lacked it; each group's histogram of counts prices the terms that it has as if the
other lacked them; and a join of the two groups' postings, which holds only terms that both
have, corrects those. No term that a group lacks is ever written out.

Terms are counted a batch at a time in the tasks, so only a batch's distinct terms are
shuffled, however many rows a language or a source has. All arithmetic is on whole numbers.

Defined results: null text, language and source count as empty text; every row is a document,
repeated rows too, whatever its doc_id; a group without terms, or in a language without kept
terms, stands in the pairs (value 0 where no term is kept) and has no terms; a language with one
source has no pairs; ties go to the smaller item by its UTF-8 bytes; an empty table gives no
rows; extra columns are ignored; a very long text is counted as a whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, saved

#: Documents of its language that a term must be in, the whole that shares are parts of, and the terms reported of a group.
LEAST_DOCUMENTS, WHOLE, MOST_TERMS = 3, 1_000_000_000, 200
#: Distinct terms that a task holds before it hands its counts on.
HELD_TERMS = 200_000

#: Letters stay, capitals become small, every other ASCII character becomes a blank; bytes of other characters stay.
_LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents with the term)."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def handed() -> pa.RecordBatch:
            names, terms, n, d = [], [], [], []
            for group, (places, rows) in held.items():
                names += [group] * len(places)
                terms += places.keys()
                n += places.values()
                d += map(rows.__getitem__, places)
            held.clear()
            text = pc.cast(pa.array(terms, pa.binary()), options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))
            langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            return pa.RecordBatch.from_arrays([langs, sources, text, pa.array(n, pa.int64()), pa.array(d, pa.int64())], ["lang", "source", "term", "n", "d"])

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, batch.column("text").cast(pa.binary())):
                places, rows = held[lang, source]
                own = Counter(terms_of(text.as_py()))
                places.update(own)
                rows.update(own.keys())
            if sum(len(places) for places, _ in held.values()) > HELD_TERMS:
                yield handed()
        if held:
            yield handed()

    parts = texts.mapInArrow(count, "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(WHOLE * (count + 1) / (total + kept)), exactly."""
    return F.expr(f"1 + (CAST({WHOLE} AS DECIMAL(20, 0)) * ({count} + 1)) div ({total} + {kept})")


def departure(p: str, q: str) -> str:
    """floor((p - q)^2 / q) as an SQL expression; shares are at most WHOLE + 1, so squares fit."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def kept_postings(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n and all_n (the language's occurrences) of the terms kept."""
    counts = saved(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
    return saved(counts.join(kept.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "all_n"), "postings")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank of every pair of groups and of each group's leading terms."""
    postings = kept_postings(docs, least)
    vocabulary = postings.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_total"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "v", "all_total"])
    groups = saved(groups.withColumn("p0", F.when(F.col("v") > 0, share("0L", "total", "v"))), "groups")
    priced = postings.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    priced = saved(priced.select("lang", "source", "term", "p", "p0", share("all_n", "all_total", "v").alias("q")), "priced")

    def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        rows = rows.withColumn("rank", F.row_number().over(order))
        rows = rows.where(F.col("rank") <= most) if most else rows
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    leading = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(departure("p", "q")).alias("value"))
    return ranked(pair_values(groups, priced), "pair").unionByName(ranked(leading, "term", most_terms))


def pair_values(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language) and value."""
    own = groups.select("lang", "source", "v", "p0")
    other = own.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = own.join(other, "lang").where("source <> item")
    f00 = departure("p0", "q0")
    everywhere = pairs.select("lang", "source", "item", F.expr(f"CASE WHEN v > 0 THEN CAST(v AS DECIMAL(20, 0)) * ({f00}) ELSE 0 END").alias("value"))
    counted = priced.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))

    def one_sided(mine: DataFrame, value: str, item: str, source: str) -> DataFrame:
        rows = mine.where("source <> item").select("lang", F.col(source).alias("source"), F.col(item).alias("item"), F.expr(value).alias("value"))
        return rows.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))

    met = counted.join(other, "lang")  # p and p0 are the counted group's, q0 the other's
    first = one_sided(met, f"m * ({departure('p', 'q0')} - {f00})", "item", "source")
    second = one_sided(met, f"m * ({departure('q0', 'p')} - {departure('q0', 'p0')})", "source", "item")
    left = priced.select("lang", "term", "source", "p", "p0")
    right = priced.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = left.join(right, ["lang", "term"]).where("source < item")

    def correction(p: str, p0: str, q: str, q0: str) -> Column:
        return F.sum(F.expr(f"{departure(p, q)} - {departure(p, q0)} - {departure(p0, q)} + {departure(p0, q0)}"))

    both = both.groupBy("lang", "source", "item").agg(correction("p", "p0", "q", "q0").alias("there"), correction("q", "q0", "p", "p0").alias("back"))
    sides = F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    both = both.select("lang", F.inline(sides))
    parts = everywhere.unionByName(first).unionByName(second).unionByName(both.withColumn("value", F.col("value").cast("decimal(38,0)")))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


def oracle_sql(least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> str:
    """Every term of every pair written out, in DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    p = lambda c, n: f"1 + ({WHOLE}::HUGEINT * ({c} + 1)) // ({n} + v)"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
tok AS (SELECT r, lang, source, unnest(ws) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= {least}),
cnt AS (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
voc AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grp AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM texts) LEFT JOIN cnt USING (lang, source) GROUP BY lang, source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "g.total")} AS p, {p("k.n", "voc.total")} AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN voc ON voc.lang = g.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(met.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN met ON met.lang = a.lang AND met.source = a.source AND met.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= {most_terms}"""
