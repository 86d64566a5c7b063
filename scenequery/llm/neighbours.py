"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are scaled to length 1 and projected by several random rotations to a few
dimensions; each projection is shifted by a random offset, cut into a grid, and ordered
along the Hilbert curve through its cells. Every ordering is range-partitioned, so each row
gets its exact rank there. A query's window in an ordering is the rows whose ranks are
near its own. The windows of all orderings merge, and the rows in them are ranked again by
their exact cosine on the original vectors.

How wide windows are is fitted: for a bounded sample of vectors, the nearest are found by
comparing them with all rows, and windows are made so wide that a stated share of these
neighbours stands in one of the orderings' windows. Vectors that lie in clusters get narrow
windows; vectors that spread evenly in many dimensions have no near neighbours that a narrow
window would hold. Where the fitted windows would together be wider than all rows, they are
as narrow as may be.

An exact check follows, as a sample tells nothing of a query unlike it. Runs of rows along the
first curve, leaves, know their middle direction and their widest angle to it, and so the
largest cosine that a query can have with a row of theirs. A query meets the leaves whose bound
reaches the last of the cosines that its windows gave, so that no nearer row is left out
whatever the vectors are. Leaves of clustered vectors are narrow, and most are passed over; of
evenly spread vectors nearly all are met, in groups bounded by rows and by queries.

Equal vectors are stored and searched for once, with the smallest of their ids that any query
can need, so a vector repeated many times takes one place in a window.

Defined results: null, empty or zero vectors, vectors with null or non-finite components and
rows with a null vec_id take no part, neither as query nor as candidate; vectors of different
lengths have no cosine, so each length is searched by itself; rows that repeat vec_id and
vector count once; a vec_id with several vectors has one list, by its nearest vector to each
other id; an empty table gives no rows; extra columns are ignored. A query with fewer
candidates than wanted gets all of them that windows hold. Vectors are scaled by a power of
two before cosines, which changes no digit, so that no square leaves the range of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read_table, running_total, saved

NEAREST, QUERY_STEP = 5, 50
ORDERINGS, DIMENSIONS, BITS = 16, 6, 8
#: Vectors that the width of windows is fitted on, the share of their neighbours that windows must hold, and the least rows to either side.
FIT_VECTORS, HELD_SHARE, LEAST_SIDE = 64, 0.96, 64
#: Rows of an ordering that one task compares with the queries near them, and about how many of these.
BLOCK, BLOCK_QUERIES = 4096, 1 << 16
#: Components of the rows of one task of the exact check, and of the queries that meet them; rows of a leaf.
CHECK_ROWS, CHECK_QUERIES, LEAF = 1 << 21, 1 << 22, 64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates below 2**bits."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:  # undo the turns of the curve from the coarsest cell to the finest
        low = level - 1
        for d in range(dims):
            upper = (x[:, d] & level) != 0
            swap = np.where(upper, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            x[:, d] ^= swap
        level >>= 1
    for d in range(1, dims):  # Gray code
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[:, -1] & level) != 0, level - 1, 0)
        level >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[:, d] >> bit & 1)
    return key


@lru_cache(maxsize=4)
def projections(length: int, orderings: int, dims: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """An orthonormal projection and a shift for each ordering."""
    rng = np.random.default_rng(seed)
    dims = min(dims, length)
    return [(np.linalg.qr(rng.standard_normal((length, length)))[0][:, :dims], rng.uniform(-0.5, 0.5, dims)) for _ in range(orderings)]


def curve_places(unit: np.ndarray, projection: np.ndarray, shift: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of unit vectors; a projected coordinate spreads by about 1 / sqrt(length)."""
    scaled = unit @ projection * np.sqrt(unit.shape[1]) + shift
    cells = np.clip((scaled / 8 + 0.5) * (1 << bits), 0, (1 << bits) - 1)
    return hilbert_keys(cells, bits)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) and n (their number), a row for each row that takes part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    return good.select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), F.size("v").alias("n"))  # -0.0 and 0.0 are one vector


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows brought near 1 by powers of two; neither cosines nor their rounding change."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def cosines(q: np.ndarray, v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in one order whatever rows stand together."""
    return np.einsum("ij,j->i", v, q) / (size * np.sqrt(np.einsum("i,i->", q, q)))


def sizes_of(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def best_of(q: np.ndarray, v: np.ndarray, size: np.ndarray, rough: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the rows that may be among the ``most`` nearest; rough: their cosines but for rounding."""
    if len(rough) > most:
        edge = np.partition(rough, len(rough) - most)[len(rough) - most] - 1e-9
        places = np.flatnonzero(rough >= edge)
    else:
        places = np.arange(len(rough))
    return places, cosines(q, v[places], size[places])


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, scaled vectors) for each length of vector."""
    lengths = np.array([len(x) for x in column])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, scaled(flat.reshape(len(at), n))


def window_share(named: DataFrame, ranked: DataFrame, counts: DataFrame, k: int, orderings: int, seed: int, sample: int = FIT_VECTORS, held: float = HELD_SHARE) -> float:
    """How far to either side, as a share of the vectors of a length, windows must reach to hold so many of the sample's neighbours."""
    picked = named.orderBy(F.xxhash64("top", F.lit(seed)), "top").limit(sample).select("top", "v").collect()  # bounded by the parameter
    queries = [(r["top"], scaled(np.array([r["v"]]))[0]) for r in picked]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tops = [], batch.column("top").to_numpy()
            for at, v in _by_length(batch.column("v")) if batch.num_rows else ():
                size = sizes_of(v)
                for top, q in queries:
                    if len(q) == v.shape[1]:
                        found = cosines(q, v, size)
                        found[tops[at] == top] = -2.0
                        rows += [(top, int(tops[at[i]]), float(found[i])) for i in np.argsort(-found)[:k] if found[i] >= -1.5]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["q", "near", "s"])

    found = named.select("top", "v").mapInArrow(search, "q long, near long, s double").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "near"))), 1, k).alias("b"))
    pairs = [(r["q"], b["near"]) for r in found.collect() for b in r["b"]]
    if not pairs:
        return 0.0
    wanted = sorted({x for p in pairs for x in p})
    rows = ranked.where(F.col("top").isin(wanted)).join(counts, "n").select("top", "ordering", (F.col("at") / F.col("rows")).alias("share")).collect()
    share = {(r["top"], r["ordering"]): r["share"] for r in rows}
    nearest = [min(abs(share[a, o] - share[b, o]) for o in range(orderings)) for a, b in pairs]
    return float(np.quantile(nearest, held, method="higher"))


def nearest(vectors: DataFrame, k: int = NEAREST, query_step: int = QUERY_STEP, orderings: int = ORDERINGS, held_share: float = HELD_SHARE, seed: int = 5, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every query, its own vec_id apart."""
    rows = saved(usable(vectors), "vectors")
    # a query leaves out one id, its own, so that k + 1 ids of each vector are enough
    named = _smallest_ids(rows.withColumn("key", F.xxhash64("v")), k + 1)
    named = saved(named.select("v", "ids", F.size("v").alias("n"), F.array_min("ids").alias("id")).withColumn("top", F.xxhash64("v", "id")), "distinct")
    if named.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    counts = named.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    # ids that repeat over vectors may take several places in front
    several = rows.select("vec_id", F.xxhash64("v").alias("key")).groupBy("vec_id").agg(F.count_distinct("key").alias("m")).agg(F.max("m")).first()[0]
    most = (k + 1) * several

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in _by_length(batch.column("v")) if batch.num_rows else ():
                unit, own = v / sizes_of(v)[:, None], batch.column("top").take(pa.array(at))
                for o, (projection, shift) in enumerate(projections(v.shape[1], orderings, DIMENSIONS, seed)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), v.shape[1], np.int32)), pa.array(np.full(len(v), o, np.int32)), pa.array(curve_places(unit, projection, shift, BITS)), own], ["n", "ordering", "place", "top"])

    placed = named.select("v", "top").mapInArrow(place, "n int, ordering int, place long, top long")
    places = saved(placed.withColumn("one", F.lit(1).cast("long")), "places")
    ranked = saved(running_total(places, ["n", "ordering"], ["place", "top"], "one", "at", "curve").select("n", "ordering", "top", "at"), "ranked")
    discard(places)
    share = window_share(named, ranked, counts, k, orderings, seed, held=held_share)
    if 2 * orderings * share >= 1:
        share = 0.0  # the exact check compares fewer rows
    side = F.greatest(F.ceil(F.col("rows") * share), F.lit(LEAST_SIDE))
    queries = rows.where(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    queries = saved(queries.join(named.select("v", "top"), "v").select("query_id", "top", "v"), "queries")
    if queries.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = queries.select("top", F.col("v").alias("q")).dropDuplicates(["top"]).join(ranked, "top").join(counts, "n")
    low, high = F.greatest(F.col("at") - side, F.lit(0)), F.least(F.col("at") + side, F.col("rows") - 1)
    near = near.select("top", "q", F.col("n").alias("own_n"), F.col("ordering").alias("own_ordering"), low.alias("low"), high.alias("high"))
    near = near.withColumn("own_block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))))
    shares = -(-queries.count() // block_queries)  # of the queries, each of which meets a copy of a block
    near = near.withColumn("own_share", F.pmod(F.xxhash64("top"), F.lit(shares)))
    blocks = ranked.withColumn("block", F.floor(F.col("at") / BLOCK)).join(named.select("top", "v", "ids"), "top")
    blocks = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))) if shares > 1 else blocks.withColumn("share", F.lit(0))

    def compare(near: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(near) and len(own):
            own = own.sort_values("at")
            at, ids, v = own["at"].to_numpy(), own["ids"].to_list(), scaled(np.stack(own["v"]))
            size = sizes_of(v)
            for start in range(0, len(near), 256):
                some = near.iloc[start : start + 256]
                q = scaled(np.stack(some["q"]))
                rough = q @ v.T / size / sizes_of(q)[:, None]
                begin, end = np.searchsorted(at, some["low"].to_numpy()), np.searchsorted(at, some["high"].to_numpy(), side="right")
                for i, (top, a, b) in enumerate(zip(some["top"], begin, end)):
                    places, scores = best_of(q[i], v[a:b], size[a:b], rough[i, a:b], most)
                    out += [(top, x, s) for j, s in zip(places, scores) for x in ids[a + j]]
        found = pd.DataFrame(out, columns=["top", "vec_id", "score"]).astype({"top": "int64", "vec_id": "int64", "score": "float64"})
        found = found.sort_values(["top", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["top", "vec_id"])
        return found.groupby("top").head(k + 1)

    found = near.groupBy("own_n", "own_ordering", "own_block", "own_share").cogroup(blocks.groupBy("n", "ordering", "block", "share")).applyInPandas(compare, "top long, vec_id long, score double")

    def first(n: int):
        return F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, n)

    def listed(found: DataFrame) -> DataFrame:
        # orderings times windows times k rows a vector at most; an id counts by its nearest vector
        return found.groupBy("top", "vec_id").agg(F.max("score").alias("score")).groupBy("top").agg(first(k + 1).alias("best"))

    lists = saved(listed(found), "lists")
    checked = _checked(queries.select("top", F.col("v").alias("q")).dropDuplicates(["top"]).join(lists, "top"), ranked.where("ordering = 0"), named, k, several)
    both = checked.unionByName(lists.select("top", F.explode("best").alias("b")).select("top", "b.vec_id", (-F.col("b.s")).alias("score")))
    lists = listed(both)
    each = queries.select("query_id", "top").join(lists, "top").select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", (-F.col("b.s")).alias("score"))
    each = each.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ordered = each.groupBy("query_id").agg(first(k).alias("best")).select("query_id", F.posexplode("best").alias("i", "b"))
    return ordered.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))


def leaves_met(q: np.ndarray, least: np.ndarray, v: np.ndarray, size: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Whether a row of a leaf of v may have a cosine of least or more with a query: [queries, leaves]."""
    starts = np.arange(0, len(v), leaf)
    unit = v / size[:, None]
    middle = np.add.reduceat(unit, starts, axis=0)
    length = sizes_of(middle)
    middle = np.where((length > 1e-9)[:, None], middle / np.maximum(length, 1e-9)[:, None], unit[starts])
    own = np.einsum("ij,ij->i", unit, np.repeat(middle, np.diff(np.append(starts, len(v))), axis=0))
    widest = np.arccos(np.clip(np.minimum.reduceat(own, starts), -1.0, 1.0))
    apart = np.arccos(np.clip(q @ middle.T / sizes_of(q)[:, None], -1.0, 1.0))
    reach = np.arccos(np.clip(least - 1e-9, -1.0, 1.0))
    return apart <= widest[None, :] + reach[:, None] + 1e-6  # angles of equal directions are off by 1e-8 or so


def _checked(lists: DataFrame, curve: DataFrame, named: DataFrame, k: int, several: int) -> DataFrame:
    """top, vec_id and score of every row that may stand in a list (top, q, best) by the order of cosines: no row as near is left out, but for those after the k + 1 nearest ids of a task."""
    least = F.when(F.size("best") > k, -F.element_at("best", -1)["s"]).otherwise(F.lit(-2.0))
    near = lists.select("top", "q", least.alias("least"), F.size("q").alias("own_n"))
    totals = near.agg(F.count(F.lit(1)), F.max("own_n")).first()
    shares = max(1, -(-totals[0] * (totals[1] or 1) // CHECK_QUERIES))
    block = F.floor(F.col("at") / F.greatest(F.lit(LEAF), F.floor(F.lit(CHECK_ROWS) / F.col("n"))))
    rows = curve.withColumn("block", block).join(named.select("top", "v", "ids"), "top")
    last = curve.groupBy(F.col("n").alias("own_n")).agg(F.max(block).alias("last"))
    near = near.join(last, "own_n").withColumn("own_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).withColumn("own_share", F.pmod(F.xxhash64("top"), F.lit(shares)))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))) if shares > 1 else rows.withColumn("share", F.lit(0))
    most = (k + 1) * several

    def check(near: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(near) and len(own):
            own = own.sort_values("at")
            ids, v = own["ids"].to_list(), scaled(np.stack(own["v"]))
            size, leaf_of = sizes_of(v), np.arange(len(v)) // LEAF
            q, least, tops = scaled(np.stack(near["q"])), near["least"].to_numpy(), near["top"].to_numpy()
            for start in range(0, len(near), 1024):
                part = slice(start, start + 1024)
                met = leaves_met(q[part], least[part], v, size)
                order = np.argsort(met.argmax(axis=1), kind="stable")  # queries of the same leaves together
                for some in np.array_split(order, -(-len(order) // 64)):
                    places = np.flatnonzero(met[some].any(axis=0)[leaf_of])
                    chosen = start + some
                    rough = q[chosen] @ v[places].T / size[places] / sizes_of(q[chosen])[:, None]
                    for i, line in zip(chosen, rough):
                        held = np.flatnonzero(line >= least[i] - 1e-9)
                        if len(held):
                            at = places[held]
                            kept, scores = best_of(q[i], v[at], size[at], line[held], most)
                            each = sorted({(-s, x) for j, s in zip(at[kept], scores) for x in ids[j]})
                            out += [(tops[i], x, -s) for s, x in each[:most]]
        return pd.DataFrame(out, columns=["top", "vec_id", "score"]).astype({"top": "int64", "vec_id": "int64", "score": "float64"})

    return near.groupBy("own_n", "own_block", "own_share").cogroup(rows.groupBy("n", "block", "share")).applyInPandas(check, "top long, vec_id long, score double")


def _smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """v and ids, the ``most`` smallest vec_ids of each distinct vector.

    Ids are first thinned out in many small parts of a vector's rows, so that a vector
    that holds much of the table is nowhere gathered.
    """
    ids = rows.select("key", "v", "vec_id").distinct()
    smallest = F.slice(F.array_sort(F.collect_list("vec_id")), 1, most)
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1024))
    thinned = ids.groupBy("key", "v", part.alias("part")).agg(smallest.alias("ids"))
    again = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most)
    return thinned.groupBy("v").agg(again.alias("ids"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
