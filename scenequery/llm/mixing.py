"""Mixing sources to target weights by multinomial draws over fixed-length token blocks.

The words of a source's documents, one after another in a pseudorandom order, are cut
into blocks of fixed length. Each output shard draws how many of its slots each source
fills from a multinomial over what the sources still owe, so the counts vary by shard and
still add up to the targets. The j-th slot of a source takes the block at place j of a
pseudorandom permutation of the source's block numbers (a new permutation when all blocks
are used up), and slots and blocks are joined by source and block number.

Defined results: a null text has no words and is never taken; a null source is a source of
its own, last in the order; repeated rows are mixed as separate documents, and so are rows
that share an id or a text; an empty table gives an empty mix; extra columns pass through; a
very long text spans many blocks. A source's rows are put in order by a hash of their id, then
by all their columns, so that only rows alike in every column may change places.

The driver holds one row a source, and a plan of one row a source and shard; the number of
shards follows the size of the mix. Sources are meant to be few, like a crawl or a collection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORDS, discard, mixed, read_table, row_hashes, running_total, saved

BLOCK_WORDS = 64
#: Output shards of a small mix, and words of the mix in a shard of a large one, about.
LEAST_SHARDS, SHARD_WORDS = 64, 1 << 28
#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix holds, and how often one source may be repeated.
TOTAL_SHARE, MOST_REPEATS = 1.5, 2
#: Slots that one row of the plan makes at most.
_STEP = 65_536


def targets_for(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Words for each source: by weight, at most ``most`` times its size, the excess reshared."""
    out, free, left = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n}, float(total)
    while free:
        weight = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        for i in above or free:
            out[i] = float(most * sizes[i]) if above else left * weights[i] / weight
        if not above:
            break
        left -= sum(out[i] for i in above)
        free -= above
    return out


def permuted(j: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place j of a pseudorandom permutation of range(n): a Feistel network, walked until it falls below n."""
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = j.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for step in range(4):
            left, right = right, left ^ (mixed(right + k + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64)) & m)
        x[todo] = left << h | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def _perm_key(source_no: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    return mixed(source_no.astype(np.uint64) * np.uint64(1_000_003) + epoch.astype(np.uint64) + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64))


def shard_counts(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: multinomial draws over what each source still owes; columns add up to slots."""
    rng, owed, out = np.random.default_rng(seed), slots.astype(np.int64).copy(), np.zeros((shards, len(slots)), np.int64)
    for shard in range(shards):
        n = owed.sum() // (shards - shard)
        while (short := n - out[shard].sum()) > 0:
            drawn = np.minimum(rng.multinomial(short, owed / owed.sum()), owed)
            out[shard] += drawn
            owed -= drawn
    return out


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int | None = None, weights: tuple = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST_REPEATS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, takes).

    documents: doc_id, key1 and key2 (hashes of the whole row), source, size, source_size,
    target and place, the number of its source's words before it, so that source and place
    name a document that has words. takes: one row per slot and document in its block: shard,
    slot, epoch, source, place, key1, key2, from_word, words. Without ``shards``, there are
    LEAST_SHARDS, or one for every SHARD_WORDS words.
    """
    spark = docs.sparkSession
    key1, key2 = row_hashes(docs)
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(SPACE_WORDS)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", F.lit(seed)).alias("_mixed"),
        key1.alias("key1"),
        key2.alias("key2"),
    )
    sized = saved(sized, "mix-sizes")
    placed = saved(running_total(sized, ["source"], ["_mixed", "doc_id", "size", "key1", "key2"], "size", "place", "mix-sized"), "mix-placed")
    discard(sized)
    # one row per source: counts only
    totals = sorted(((r["source"], r["n"]) for r in placed.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in totals]
    wanted = targets_for(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    blocks = np.array([-(-n // block_words) for n in sizes], np.int64)
    shards = shards or max(LEAST_SHARDS, -(-int(sum(wanted)) // SHARD_WORDS))
    slots, cuts = _slots(sizes, wanted, blocks, block_words, most, seed)
    counts = shard_counts(slots, shards, seed) if len(sizes) else np.zeros((shards, 0), np.int64)
    first = np.cumsum(counts, axis=0) - counts
    plan = [(s, i, totals[i][0], int(sizes[i]), int(blocks[i]), int(slots[i]), int(cuts[i]), int(first[s, i]), int(counts[s, i])) for s in range(shards) for i in range(len(sizes)) if counts[s, i]]
    plan_df = spark.createDataFrame(plan, "shard int, source_no int, source string, size long, blocks long, slots long, cut long, first long, n long")
    per_source = spark.createDataFrame([(t, int(n), float(w)) for (t, n), w in zip(totals, wanted)], "_source string, source_size long, target double")
    documents = placed.join(per_source, placed["source"].eqNullSafe(per_source["_source"])).drop("_source", "_mixed")
    chunks = plan_df.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_STEP).cast("long"))))
    chunks = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "source_no", "at")
    drawn = chunks.select("*", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + _STEP, F.col("n")) - 1)).alias("k"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            j = (p["first"] + p["k"]).to_numpy()
            n = p["blocks"].to_numpy()
            epoch = j // n
            block = permuted(j % n, n, _perm_key(p["source_no"].to_numpy(), epoch, seed))
            words = np.minimum(block_words, p["size"].to_numpy() - block * block_words)
            words = words - np.where(j == p["slots"].to_numpy() - 1, p["cut"].to_numpy(), 0)
            yield pd.DataFrame({"shard": p["shard"], "slot": j, "epoch": epoch, "_source": p["source"], "_block": block, "_words": words})

    taken = drawn.mapInPandas(draw, "shard int, slot long, epoch long, _source string, _block long, _words long")
    parts = (
        placed.where("size > 0")
        .select("source", "place", "size", "key1", "key2", F.explode(F.sequence(F.expr(f"place div {block_words}"), F.expr(f"(place + size - 1) div {block_words}"))).alias("block"))
    )
    begin = F.greatest("place", F.col("_block") * block_words)
    end = F.least(F.col("place") + F.col("size"), F.col("_block") * block_words + F.col("_words"))
    takes = (
        parts.join(taken.hint("merge"), parts["source"].eqNullSafe(taken["_source"]) & (parts["block"] == taken["_block"]))
        .select("shard", "slot", "epoch", parts["source"], "place", "key1", "key2", (begin - F.col("place")).alias("from_word"), (end - begin).alias("words"))
        .where("words > 0")
    )
    return documents, takes


def unpermuted(y: int, n: int, key: int) -> int:
    """The place j at which permuted() gives y."""
    half = int(np.ceil(np.log2(max(n, 2)) / 2))
    mask = (1 << half) - 1
    while True:
        left, right = y >> half, y & mask
        for step in (3, 2, 1, 0):
            at = np.array([(left + key + step * 0x9E3779B97F4A7C15) & (2**64 - 1)], np.uint64)
            left, right = right ^ (int(mixed(at)[0]) & mask), left
        y = left << half | right
        if y < n:
            return y


def _slots(sizes: list[int], wanted: list[float], blocks: np.ndarray, block_words: int, most: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many slots each source gets, and the words that its last slot leaves out to meet the target."""
    slots, cuts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, (size, target) in enumerate(zip(sizes, wanted)):
        if not size:
            continue
        n = int(blocks[i])
        epochs, left = divmod(min(round(target), int(most * size)), size)
        key = int(_perm_key(np.array([i]), np.array([epochs]), seed)[0])
        missing = n * block_words - size  # words that the source's last block is short of
        short_at = unpermuted(n - 1, n, key)
        m = -(-left // block_words)
        if m and m * block_words - missing * (short_at < m) < left:
            m += 1
        slots[i] = epochs * n + m
        cuts[i] = m * block_words - missing * (short_at < m) - left if m else 0
    return slots, cuts


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of docs, one for each document and epoch, with the words taken as text.

    A document taken whole keeps its text; of another, the runs of words taken are joined
    with the white space before each word. n_chars is counted anew where docs has it.
    """
    documents, takes = mix(docs, **options)
    runs = takes.groupBy("key1", "key2", "source", "place", "epoch").agg(F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("_runs"), F.sum("words").alias("_taken"))
    runs = runs.drop("source", "place", "epoch")
    # a row travels as one column, so that its own columns' names clash with nothing; rows alike in every column share their text
    key1, key2 = row_hashes(docs)
    rows = docs.select(F.struct("*").alias("row"), key1.alias("_key1"), key2.alias("_key2")).dropDuplicates(["_key1", "_key2"])
    spaced = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    joined = rows.join(runs, (F.col("_key1") == F.col("key1")) & (F.col("_key2") == F.col("key2"))).withColumn("_words", spaced)
    taken = F.flatten(F.transform("_runs", lambda r: F.slice("_words", r["from_word"].cast("int") + 1, r["words"].cast("int"))))
    text = F.when(F.size("_words") == F.col("_taken"), F.col("row.text")).otherwise(F.array_join(taken, ""))
    out = joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, takes = mix(read_table(spark, sf_dir, "documents"))
    taken = takes.groupBy("source", "place").agg(F.sum("words").alias("taken"))
    at = taken.select(F.col("source").alias("_source"), F.col("place").alias("_place"), "taken")
    same = documents["source"].eqNullSafe(at["_source"]) & (documents["place"] == at["_place"]) & (documents["size"] > 0)
    return documents.join(at, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
