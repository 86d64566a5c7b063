"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the page's text, under a character-trigram model of
each language; the language that its markup declares; its address's suffix; and a prior
for its host. Likelihoods of declarations and suffixes and the priors are counted over all
pages, by the language that the text alone suggests. A host's prior is drawn towards its
domain's, and that towards all pages', the more strongly the fewer pages it has.

Trigrams of one text overlap and repeat, so that a product over all of a long text would drown
all other evidence. The whole text is read, and its mean log likelihood a trigram counts as often
as it has trigrams, up to ``MOST_TRIGRAMS``: a text of 60 trigrams (about ten words) or of 60,000
weighs as 60.

The trigram model is fitted on labelled documents, at most ``per_language`` of each
language, those with small hashes.

Defined results: null or empty pages have no text evidence, null addresses no suffix or
host, and missing declarations none; ties go to the first language in code-point order;
repeated rows each count and get the same answer; without labelled documents or pages
there are no rows; extra columns are ignored; very long pages are read whole. The driver holds
one row a language of the labelled documents; languages are meant to be few.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, saved

CELLS = 1 << 14
PER_LANGUAGE = 500
#: A text counts as so many independent trigrams at most; pages that a parent's prior counts for; added counts.
MOST_TRIGRAMS, PARENT_WEIGHT, ADDED = 60.0, 20.0, 0.5
_NOT_TEXT = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]+)"


def page_text(page: str | None) -> str:
    return html_lib.unescape(_NOT_TEXT.sub(" ", page or ""))


def trigram_counts(text: str) -> np.ndarray:
    """Hashed counts of the character trigrams of a lower-cased text with runs of non-letters as one space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = ((codes >= 97) & (codes <= 122)) | (codes >= 0xC0)
    codes = np.where(letter, codes, 32)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    if len(codes) < 3:
        return np.zeros(CELLS, np.int64)
    cell = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)
    return np.bincount(cell.astype(np.int64), minlength=CELLS)


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """The languages and log probabilities [language, trigram cell]."""
    labelled = documents.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # of each language, hashes up to a bound that about so many stay under, so that few texts are shuffled at any size
    sizes = {r["lang"]: r["count"] for r in documents.where("lang is not null and text is not null").groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((0, CELLS))
    bounds = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, 2.0**63 * (2 * min(1.0, 0.9 * per_language / n) - 1))])
    thinned = labelled.where(F.col("h") <= F.element_at(bounds, F.col("lang")))
    chosen = Window.partitionBy("lang").orderBy("h")
    sample = thinned.withColumn("n", F.row_number().over(chosen)).where(F.col("n") <= per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                totals[lang] = totals.get(lang, 0) + trigram_counts(text)
        for lang, own in totals.items():
            cells = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells)), pa.array(cells), pa.array(own[cells])], ["lang", "cell", "n"])

    counts = sample.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.full((len(languages), CELLS), ADDED)
    table[[languages.index(x) for x in counts["lang"]], counts["cell"].to_numpy(dtype=np.int64)] += counts["n"].to_numpy()
    return languages, np.log(table / table.sum(axis=1, keepdims=True)) if len(languages) else table


def _share(counts: str, i: Column, n: int) -> Column:
    """Smoothed likelihood log P(value | language i) from counts of the value and of all, by language."""
    return F.log((F.get(F.coalesce(counts, F.array_repeat(F.lit(0).cast("long"), n)), i) + ADDED) / (F.get("all_counts", i) + 1.0))


def identify(pages: DataFrame, documents: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """page_id, lang, score (its posterior probability), text_lang and declared."""
    languages, table = fit(documents, per_language)
    n = len(languages)
    if not n:
        return pages.select("page_id", F.lit("").alias("lang"), F.lit(0.0).alias("score"), F.lit("").alias("text_lang"), F.lit("").alias("declared")).limit(0)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column("html"):
                own = trigram_counts(page_text(page.as_py()))
                total = own.sum()
                rows.append((table @ own) * (min(total, MOST_TRIGRAMS) / total if total else 0.0))
            found = [None if not row.any() else int(np.argmax(row)) for row in rows]
            names = [c for c in batch.schema.names if c != "html"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, pa.list_(pa.float64())), pa.array(found, pa.int32())], [*names, "text_logs", "first"])

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", _DECLARED, 1))
    known = F.when(declared.isin(languages), declared).when(declared != "", "other")
    parsed = pages.select("page_id", F.when(host != "", host).alias("host"), known.alias("declared"), "html")
    parsed = parsed.withColumn("suffix", F.element_at(F.split("host", r"\."), -1)).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    schema = T.StructType([*parsed.drop("html").schema.fields, T.StructField("text_logs", T.ArrayType(T.DoubleType())), T.StructField("first", T.IntegerType())])
    seen = saved(parsed.mapInArrow(read, schema), "pages")

    def counts(by: list[str], name: str) -> DataFrame:
        sums = [F.sum(F.when(F.col("first") == i, 1).otherwise(0)).cast("long") for i in range(n)]
        return seen.where(" and ".join(f"{c} is not null" for c in by) or "true").groupBy(*by).agg(F.array(*sums).alias(name))

    overall = counts([], "all_counts").first()["all_counts"] if n else []
    overall = [int(x or 0) for x in overall]
    fused = seen.withColumn("all_counts", F.array(*[F.lit(x).cast("long") for x in overall]))
    for by, name in (("declared", "declared_counts"), ("suffix", "suffix_counts"), ("domain", "domain_counts"), ("host", "host_counts")):
        own = counts([by], name).withColumnRenamed(by, f"_{by}")
        fused = fused.join(own, fused[by] == own[f"_{by}"], "left").drop(f"_{by}")
    total = sum(overall)
    prior = F.array(*[F.lit((x + ADDED) / (total + ADDED * n)) for x in overall])
    zeros = F.array_repeat(F.lit(0).cast("long"), n)

    def drawn(counts_of: str, parent: str) -> Column:
        own = F.coalesce(counts_of, zeros)
        pages_there = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(own, parent, lambda x, p: (x + PARENT_WEIGHT * p) / (pages_there + PARENT_WEIGHT))

    fused = fused.withColumn("prior", prior).withColumn("domain_prior", drawn("domain_counts", "prior")).withColumn("host_prior", drawn("host_counts", "domain_prior"))
    evidence = lambda name, i, there: F.when(there.isNotNull(), _share(name, i, n)).otherwise(0.0)
    logs = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.get("text_logs", i) + F.log(F.get("host_prior", i)) + evidence("declared_counts", i, F.col("declared")) + evidence("suffix_counts", i, F.col("suffix")),
    )
    fused = fused.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    at = F.array_position("logs", F.col("top")).cast("int")
    score = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*map(F.lit, languages))
    return fused.select("page_id", F.get(names, at - 1).alias("lang"), F.round(score, 6).alias("score"), F.get(names, F.col("first")).alias("text_lang"), "declared")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))
