"""Line dedup with a suffix array over line-ID sequences, built by prefix doubling.

Every line that holds a word and occurs twice or more gets an ID; a document is its
sequence of IDs, broken where a line occurs once. The suffixes are ranked by their first
line, then by 2, 4, 8 ... lines: each round sorts the distinct pairs (rank of a suffix,
rank of the suffix that many lines further on) and keeps the pairs that occur twice. A run
of any length has the pair of ranks of its first and last 2^j lines, which stands for its
interval of the suffix array: the suffixes whose common prefix holds the run. Runs just
long enough to hold ``min_words`` words, counted from their first line on or from their
last line back, are looked up; where an interval holds an earlier place, the run is a later
copy. Such runs overlap along a longer repeated run, so their union is exactly the part of
each maximal repeated run that later copies hold, and these lines are deleted. As every
line holds a word, ranks over more lines than ``min_words`` are never needed and the number
of rounds doesn't grow with the data.

Places are ordered by doc_id (null first), then by line. Rows are keyed by doc_id and text.

Defined results: null text stays null and empty text empty, and lines without words stay;
rows that repeat both doc_id and text are one place and all get the same result; an empty
table gives no rows; other columns pass through, and the count's name is a parameter; very
long texts are handled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_WORDS, discard, read_table, saved

MIN_WORDS = 50
#: Ranks that are looked through together, about; a document's stay together.
CHUNK_ROWS = 200_000


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, _key, seq (among the lines that hold a word), line, words and the line's 128-bit hash."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("body")))
    lines = docs.select("doc_id", "text", F.xxhash64("text").alias("_key")).select("doc_id", "_key", F.posexplode(F.filter(numbered, lambda x: x["body"].rlike(r"[^\x20\x09-\x0D]"))).alias("seq", "own"))
    body = F.col("own.body")
    return lines.select("doc_id", "_key", "seq", "own.line", F.regexp_count(body, F.lit(SPACE_WORDS)).alias("words"), F.xxhash64(body).alias("id1"), F.xxhash64(F.lit(1), body).alias("id2"))


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that occur twice or more, each with a number that follows their order."""
    twice = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return twice.orderBy(*keys).select(*[F.col(k).alias(f"_{k}") for k in keys], F.monotonically_increasing_id().alias("rank"))


def suffix_ranks(lines: DataFrame, most_lines: int) -> list[DataFrame]:
    """For 1, 2, 4, ... lines, up to most_lines: the rank of each suffix whose first so many lines occur twice or more."""
    first = _ranked(lines, ["id1", "id2"])
    own = lines.join(first, (F.col("id1") == F.col("_id1")) & (F.col("id2") == F.col("_id2")))
    levels = [saved(own.select("doc_id", "_key", "seq", "line", "words", "rank").distinct(), "lines-1")]
    reach = 1
    while 2 * reach <= most_lines:
        later = Window.partitionBy("doc_id", "_key").orderBy("seq").rangeBetween(reach, reach)
        pairs = levels[-1].select("doc_id", "_key", "seq", F.col("rank").alias("r"), F.max("rank").over(later).alias("s")).where("s is not null")
        ranks = _ranked(pairs, ["r", "s"])
        level = saved(pairs.join(ranks, (F.col("r") == F.col("_r")) & (F.col("s") == F.col("_s"))).select("doc_id", "_key", "seq", "rank"), f"lines-{2 * reach}")
        if level.isEmpty():
            discard(level)
            break
        levels.append(level)
        reach *= 2
    return levels


def runs_of(first: np.ndarray, words: np.ndarray, ranks: list[np.ndarray], min_words: int) -> tuple[np.ndarray, ...]:
    """Shortest long-enough runs of consecutive lines: place of the first line, number of lines, rank of the first 2^j and of the last 2^j lines.

    first: whether a line doesn't follow the one before it here; ranks: by j, -1 for none.
    """
    n = len(words)
    total = np.r_[0, np.cumsum(words)]
    segment = np.cumsum(first)
    low, high = np.searchsorted(segment, segment), np.searchsorted(segment, segment, side="right")
    at = np.arange(n)
    ends = np.searchsorted(total, total[:-1] + min_words)  # the run from line i on is i .. ends - 1
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    forward, back = ends <= high, starts >= low
    spans = np.unique(np.r_[np.stack([at[forward], ends[forward]], 1), np.stack([starts[back], at[back] + 1], 1)], axis=0)
    a, size = spans[:, 0], spans[:, 1] - spans[:, 0]
    head, tail = np.full(len(a), -1), np.full(len(a), -1)
    for j, own in enumerate(ranks):
        here = np.flatnonzero((size >> j) == 1)
        head[here], tail[here] = own[a[here]], own[a[here] + size[here] - (1 << j)]
    twice = (head >= 0) & (tail >= 0)
    return a[twice], size[twice], head[twice], tail[twice]


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, _key and gone: the numbers of the lines to delete, for the documents that have any."""
    levels = suffix_ranks(line_table(docs), min_words)
    rows = levels[0].select("doc_id", "_key", "seq", "line", "words", F.lit(0).alias("level"), "rank")
    for j, level in enumerate(levels[1:], 1):
        rows = rows.unionByName(level.select("doc_id", "_key", "seq", F.lit(0).alias("line"), F.lit(0).cast("int").alias("words"), F.lit(j).alias("level"), "rank"))
    chunks = max(1, sum(level.count() for level in levels) // CHUNK_ROWS)
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([id_field, *[T.StructField(c, T.LongType()) for c in ("_key", "at", "n", "head", "tail")], T.StructField("lines", T.ArrayType(T.IntegerType()))])

    def runs(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        key, seq, line, words, level, rank = (table[c].to_numpy() for c in ("_key", "seq", "line", "words", "level", "rank"))
        order = np.lexsort((level, seq, key, ids))  # each line's first rank, then its further ones
        base = order[level[order] == 0]
        place = np.cumsum(level[order] == 0) - 1
        ranks = []
        for j in range(int(level.max(initial=0)) + 1):
            own = np.full(len(base), -1, np.int64)
            own[place[level[order] == j]] = rank[order[level[order] == j]]
            ranks.append(own)
        step = (np.diff(ids[base]) != 0) | (np.diff(key[base]) != 0) | (np.diff(seq[base]) != 1)
        a, size, head, tail = runs_of(np.r_[True, step][: len(base)], words[base], ranks, min_words)
        offsets = np.r_[0, np.cumsum(size)]
        within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
        lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(line[base][np.repeat(a, size) + within], pa.int32()))
        columns = [table["doc_id"].take(pa.array(base[a])), *(pa.array(x.astype(np.int64)) for x in (key[base[a]], seq[base[a]], size, head, tail)), lines]
        return pa.table(dict(zip(schema.names, columns)))

    dealt = rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "_key"), F.lit(chunks)))
    windows = saved(dealt.groupBy("_chunk").applyInArrow(runs, schema), "runs")
    place = F.struct("doc_id", "_key", "at")
    first = windows.groupBy("n", "head", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # written, so that a run with very many copies can be split among tasks in the join
    first = saved(first.select(F.col("n").alias("_m"), F.col("head").alias("_head"), F.col("tail").alias("_tail"), "first"), "firsts")
    later = windows.join(first, (F.col("n") == F.col("_m")) & (F.col("head") == F.col("_head")) & (F.col("tail") == F.col("_tail"))).where(~place.eqNullSafe(F.col("first")))
    return later.select("doc_id", "_key", F.explode("lines").alias("line")).distinct().groupBy("doc_id", "_key").agg(F.collect_list("line").alias("gone"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, count_name: str = "lines_removed") -> DataFrame:
    """docs with the later copies of repeated line runs deleted from text, and the number of lines deleted."""
    gone = repeated_lines(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), "gone")
    # a row travels as one column, so that its own columns' names clash with nothing
    keyed = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("_doc"), F.xxhash64("row.text").alias("_key"))
    joined = keyed.join(gone, keyed["_doc"].eqNullSafe(gone["_id"]) & (keyed["_key"] == gone["_of"]), "left")
    lines = F.split("row.text", "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    row = F.col("row").withField("text", text).withField(count_name, F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    return joined.select(row.alias("row")).select("row.*")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "lines_removed", "text")


def oracle_sql(min_words: int = MIN_WORDS) -> str:
    """The same deletions by looking up every shortest long-enough run of lines."""
    return f"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
ln AS (SELECT *, len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+')) AS words FROM raw),
seqd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS seq, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM ln WHERE words > 0),
spans AS (
  SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM seqd a JOIN seqd b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + {min_words} AND b.upto - a.upto + a.words >= {min_words} GROUP BY a.doc_id, a.seq
  UNION
  SELECT b.doc_id, max(a.seq), b.seq FROM seqd a JOIN seqd b ON a.doc_id = b.doc_id AND a.seq BETWEEN b.seq - {min_words} AND b.seq AND b.upto - a.upto + a.words >= {min_words} GROUP BY b.doc_id, b.seq),
runs AS (SELECT s.doc_id, s.s, s.e, string_agg(md5(q.body), '' ORDER BY q.seq) AS content FROM spans s JOIN seqd q ON q.doc_id = s.doc_id AND q.seq BETWEEN s.s AND s.e GROUP BY ALL),
firsts AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS k FROM runs),
gone AS (SELECT DISTINCT q.doc_id, q.line FROM firsts f JOIN seqd q ON q.doc_id = f.doc_id AND q.seq BETWEEN f.s AND f.e WHERE f.k > 1)
SELECT d.doc_id, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS lines_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(r.body, chr(10) ORDER BY r.line) FROM ln r ANTI JOIN gone g ON g.doc_id = r.doc_id AND g.line = r.line WHERE r.doc_id = d.doc_id), '') END AS text
FROM documents d"""
