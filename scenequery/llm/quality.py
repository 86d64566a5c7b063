"""Quality rules: an isolation forest over rule statistics, thresholds set on labelled rows.

Every document's rule statistics are counted over its whole text. Trees that split a
small random sample at random isolate unusual documents early, so a short mean path
means an anomaly. The score at which a document is rejected comes from the labelled
rows: the lowest one that loses at most a stated share of the good rows.

Defined results: a null or empty text has no words and fails the base rule; repeated rows
are judged alike; an empty table gives no rows; without labelled rows the threshold is a
documented constant; extra columns are ignored; null or unknown labels are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, read_table, saved, shingle_hashes

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the forest sees, besides COUNTS.
MORE = ("n_lines", "n_marks", "n_upper", "n_digits")
SPACES, SYMBOLS, PLAIN_MARKS = " \t\n\x0b\x0c\r", "#*$%&|<>", ".,;:'-"
TREES, SAMPLE, DEPTH = 128, 256, 8
#: Rates of a text are drawn towards these with the weight of so many words, so that few words make no anomaly.
PRIOR_WORDS, PRIORS = 40.0, np.array([5.0, 0.0, 0.0, 0.0, 0.0, 0.08, 0.0])
GOOD_LOSS, DEFAULT_THRESHOLD = 0.01, 0.6

_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE)])


def text_counts(text: str, hashes: WordHashes) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    spaces = sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n >= 4:
        windows = shingle_hashes(hashes.of(words), 3)
        _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = times[at] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    symbols = sum(map(text.count, SYMBOLS))
    marks = symbols + sum(map(text.count, "!?=_~^+/\\@{}[]()\""))
    octets = np.frombuffer(raw, np.uint8)
    upper = int((octets - 65 < 26).sum() + ((octets[:-1] == 0xC3) & (octets[1:] - 0x80 < 0x1F)).sum())  # A-Z and the Latin-1 capitals
    digits = sum(map(text.count, "0123456789"))
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated, len(lines), marks, upper, digits


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each document's whole text."""
    docs = docs.select("doc_id", "text")
    return _with_counts(docs, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *_SCHEMA.fields]), lambda batch: batch.column("text"))


def _with_counts(rows: DataFrame, schema: T.StructType, texts) -> DataFrame:
    """The first column of rows and the counts of texts(batch)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = WordHashes()
            found = np.array([text_counts(x.as_py() or "", hashes) for x in texts(batch)], np.int64).reshape(-1, len(_SCHEMA))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.T)], schema.names)

    return rows.mapInArrow(count, schema)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from columns COUNTS and MORE."""
    n, chars, symbols, dup, rep, lines, marks, upper, digits = counts.T.astype(float)
    raw = np.stack([chars, symbols, rep, dup * np.divide(n, lines, out=np.zeros_like(n), where=lines > 0), marks, upper, digits], axis=1)
    return (raw + PRIOR_WORDS * PRIORS) / (n + PRIOR_WORDS)[:, None]


def _expected_path(n: np.ndarray) -> np.ndarray:
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow_forest(rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, depth: int = DEPTH, seed: int = 11) -> dict[str, np.ndarray]:
    """Trees in heap order: which feature splits a node (-1: a leaf), where, and a leaf's path length."""
    rng = np.random.default_rng(seed)
    size = 2 ** (depth + 1) - 1
    which, split, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo = [(0, 0, rows[rng.choice(len(rows), min(sample, len(rows)), replace=False)])]
        while todo:
            node, level, own = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            free = np.flatnonzero(high > low)
            if level == depth or len(own) < 2 or not len(free):
                path[t, node] = level + _expected_path(len(own))
                continue
            f = rng.choice(free)
            at = rng.uniform(low[f], high[f])
            which[t, node], split[t, node] = f, at
            todo += [(2 * node + 1, level + 1, own[own[:, f] <= at]), (2 * node + 2, level + 1, own[own[:, f] > at])]
    return {"which": which, "split": split, "path": path, "norm": float(_expected_path(min(sample, len(rows)))) or 1.0, "depth": depth}


def anomaly(forest: dict, rows: np.ndarray) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for anomalies."""
    total, all_rows = np.zeros(len(rows)), np.arange(len(rows))
    for which, split, path in zip(forest["which"], forest["split"], forest["path"]):
        node = np.zeros(len(rows), np.int64)
        for _ in range(forest["depth"]):
            f = which[node]
            node = np.where(f < 0, node, 2 * node + 1 + (rows[all_rows, np.maximum(f, 0)] > split[node]))
        total += path[node]
    return 2.0 ** (-total / len(forest["which"]) / forest["norm"])


def fitted(counts: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS, seed: int = 11) -> tuple[DataFrame, dict | None, float]:
    """Scored rows of a table of rule_statistics() (doc_id, COUNTS, base_failed, anomaly), the forest and the threshold.

    The trees see a sample of TREES * SAMPLE rows at most, those with small hashes of
    their ids, counts and places in the table, so that rows of one id, or none, are
    thinned like others; thresholds are counted over all labelled rows.
    """
    columns = [*COUNTS, *MORE]
    counts = counts.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # rows below a bound that about so many hashes stay under, so that no task sends more than its part
    most, n = TREES * SAMPLE, counts.count()
    share = F.lit(2.0**63 * (2 * min(1.0, 0.9 * most / max(n, 1)) - 1))
    sample = counts.where(F.xxhash64("doc_id", *columns, F.monotonically_increasing_id(), F.lit(seed)) <= share).select(*columns).limit(most).toPandas().to_numpy(np.int64)
    sample = sample[np.lexsort(sample.T)]
    if not len(sample):
        return counts.select("doc_id", *COUNTS, "base_failed", F.lit(0.0).alias("anomaly")), None, DEFAULT_THRESHOLD
    forest = grow_forest(features(sample), seed=seed)
    schema = T.StructType([*counts.select("doc_id", *COUNTS, "base_failed").schema.fields, T.StructField("anomaly", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in columns], axis=1)
            own = [batch.column(c) for c in schema.names[:-1]] + [pa.array(scores(forest, rows))]
            yield pa.RecordBatch.from_arrays(own, schema.names)

    scored = counts.select(*schema.names[:-1], *MORE).mapInArrow(score, schema)
    return scored, forest, threshold_for(scored, labels, good_loss)


def scores(forest: dict, counts: np.ndarray) -> np.ndarray:
    return np.round(anomaly(forest, features(counts)), 4)


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly and kept for every row of docs."""
    scored, _, threshold = fitted(saved(rule_statistics(docs), "rules"), labels, **options)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that judged() keeps. Rows are written with their counts, so that texts are counted once and nothing is joined."""
    rows = docs.select(F.struct("*").alias("row"))
    schema = T.StructType([*rows.schema.fields, *_SCHEMA.fields])
    counted = saved(_with_counts(rows, schema, lambda batch: batch.column("row").field("text")), "counted")
    _, forest, threshold = fitted(counted.select("row.doc_id", *_SCHEMA.names), labels, **options)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.stack([batch.column(c).to_numpy() for c in _SCHEMA.names], axis=1)
                failed = (found[:, 0] < 50) | (100 * found[:, 4] > 50 * found[:, 0])
                low = (scores(forest, found) if forest else np.zeros(len(found))) < threshold
                yield batch.select(["row"]).filter(pa.array(~failed & low))

    return counted.mapInArrow(pick, rows.schema).select("row.*")


def threshold_for(scored: DataFrame, labels: DataFrame, good_loss: float) -> float:
    """The lowest score that at most a share good_loss of the good labelled rows reach, among rows that pass the base rule."""
    marked = labels.where("quality in (0, 1)").select("doc_id", "quality").distinct()
    table = scored.where("not base_failed").join(marked, "doc_id").groupBy("anomaly").agg(F.sum(F.col("quality").cast("long")).alias("good"), F.sum(1 - F.col("quality")).cast("long").alias("bad"))
    rows = sorted(table.collect(), reverse=True)  # scores have four digits: 10,000 rows at most
    good = sum(r["good"] for r in rows)
    if not good or not any(r["bad"] for r in rows):
        return DEFAULT_THRESHOLD
    best, lost = 2.0, 0
    for r in rows:
        lost += r["good"]
        if lost > good_loss * good:
            break
        best = r["anomaly"]
    return best


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
