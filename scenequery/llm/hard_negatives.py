"""Hard negatives by a block matrix multiplication over two dimensions.

Rows are ordered by label and id and cut into blocks; each block's matrix is cut again along
the dimensions of the vectors. Every block of anchors meets every block of rows one chunk of
dimensions at a time, like processes of a grid that pass their panels on; each meeting gives a
partial tile of whole-number scores, and the partial tiles of a pair of blocks are shuffled
together and added up. A tile then is reduced to its best rows, and the tiles' best to the
anchor's.

Two multiplications: one for the positives, over pairs of blocks that share a label only, and
one for the negatives, over all other pairs; a positive's score bounds the window that its
negatives lie in. A task holds one tile, whatever the number of rows or the share of a label.

Scores are 64-bit whole numbers. A tile is multiplied in doubles where all of its sums are
below 2**53, which is exact, and in whole numbers elsewhere; on its way it takes the narrowest
type that holds it.

Defined results: rows with a null vec_id, label or vector or with a null or non-finite
component take no part; a row that repeats vec_id, label and vector counts once; rows that
share a vec_id and differ stand each for itself, but never meet each other, so an anchor id
may come several times; vectors of different lengths are compared as if zeros filled the
shorter one; a vector whose scores could leave 62 bits is an error; anchors without positives,
and positives without negatives in their window, give no rows; ties go to the smaller id; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, running_total, saved

#: The factor before rounding down; every how many ids are anchors; positives of an anchor, negatives of a positive.
SCALE, ANCHOR_STEP, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score lies between these hundredths of the positive's.
LEAST_SHARE, MOST_SHARE = 50, 95
#: Ids that are divisible by this have their label moved on by one, modulo LABELS.
MOVED_STEP, LABELS = 7, 10
#: Anchors and rows of a block; least dimensions of a chunk, and the most chunks.
ANCHOR_BLOCK, ROW_BLOCK, DIMENSIONS, CHUNKS = 256, 4096, 32, 4

_BLOCK = "block long, chunk int, low long, high long, ids binary, labels binary, width int, kind string, data binary"
_TILE = "i long, j long, own_ids binary, own_labels binary, ids binary, labels binary, found array<array<long>>, kind string, data binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (moved on where that is asked for) and v, whole numbers, of the rows that take part."""
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % MOVED_STEP == 0, (label + 1) % LABELS).otherwise(label)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    largest = F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    small = F.size("v") * largest * largest < 2.0**62
    return rows.select("vec_id", "label", F.when(small, F.col("v")).otherwise(F.raise_error(F.format_string("scores of vector %d can leave 64 bits", "vec_id"))).alias("v")).distinct()


def narrowed(a: np.ndarray) -> tuple[str, bytes]:
    low, high = int(a.min(initial=0)), int(a.max(initial=0))
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, a.astype(kind).tobytes()


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, in whole numbers."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    fields = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], types[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def blocks(rows: DataFrame, size: int, width: int, label: str) -> DataFrame:
    """The rows in blocks of ``size`` by label and id: a row for each block and chunk of ``width`` dimensions."""

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending")])
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        vectors = table["v"].combine_chunks()
        lengths = vectors.value_lengths().to_numpy()
        matrix = np.zeros((len(ids), max(1, -(-int(lengths.max()) // width)) * width), np.int64)
        matrix[np.arange(matrix.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
        out = []
        for c in range(matrix.shape[1] // width):
            names = (ids.tobytes(), labels.tobytes()) if c == 0 else (None, None)
            out.append((table["block"][0].as_py(), c, int(labels[0]), int(labels[-1]), *names, width, *narrowed(matrix[:, c * width : (c + 1) * width])))
        return _table(_BLOCK, out)

    placed = running_total(rows.withColumn("one", F.lit(1)), [], ["label", "vec_id"], "one", "at", label)
    return saved(placed.withColumn("block", F.floor(F.col("at") / size)).groupBy("block").applyInArrow(cut, _BLOCK), f"{label}-blocks")


def tiles(own: DataFrame, other: DataFrame, one_label: bool) -> DataFrame:
    """Partial tiles of each pair (i, j) of blocks that meet at a chunk; ``own`` has a column found.

    one_label: whether pairs of blocks that hold one and the same label are multiplied.
    """

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and b.num_rows:
            (x,), (y,) = a.to_pylist(), b.to_pylist()
            if one_label or len({x["low"], x["high"], y["low"], y["high"]}) > 1:
                left, right = (np.frombuffer(z["data"], z["kind"]).reshape(-1, z["width"]).astype(np.int64) for z in (x, y))
                out.append((x["i"], x["j"], x["ids"], x["labels"], y["ids"], y["labels"], x["found"], *narrowed(multiplied(left, right))))
        return _table(_TILE, out)

    return own.groupBy("i", "j", "chunk").cogroup(other.groupBy("i", "j", "chunk")).applyInArrow(multiply, _TILE)


def summed(table: pa.Table) -> tuple[np.ndarray, dict]:
    """The scores of a pair of blocks, and the row that has its ids."""
    parts = table.to_pylist()
    first = next(p for p in parts if p["ids"] is not None)
    n = len(first["own_ids"]) // 8
    total = np.zeros((n, len(first["ids"]) // 8), np.int64)
    for p in parts:
        total += np.frombuffer(p["data"], p["kind"]).reshape(total.shape)
    return total, first


def best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """Of the places, those of the ``most`` best scores, ties to smaller ids."""
    if len(places) > most:
        own = scores[places]
        places = places[own >= np.partition(own, len(own) - most)[len(own) - most]]
    return places[np.lexsort((ids[places], -scores[places]))][:most]


def hard_negatives(vectors: DataFrame, anchor_block: int = ANCHOR_BLOCK, row_block: int = ROW_BLOCK, dimensions: int = DIMENSIONS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    rows = saved(usable(vectors), "usable")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    anchors = rows.where(F.col("vec_id") % ANCHOR_STEP == 0)
    if longest is None or anchors.isEmpty():
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(dimensions, -(-longest // CHUNKS))
    own, other = blocks(anchors, anchor_block, width, "anchors"), blocks(rows, row_block, width, "rows")
    positives = saved(_positives(own, other), "positives")
    numbers = F.array(*[F.col(c).cast("long") for c in ("k", "slot", "positive_id", "positive_score")])
    packed = positives.groupBy("i").agg(F.collect_list(numbers).alias("found"))  # a block's anchors at most
    n_own, n_other = (x.agg(F.max("block")).first()[0] + 1 for x in (own, other))
    left = own.withColumnRenamed("block", "i").join(packed, "i").withColumn("found", F.when(F.col("chunk") == 0, F.col("found")))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))
    right = other.withColumnRenamed("block", "j").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_own - 1).cast("long"))))
    schema = "i long, k int, slot int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def select(table: pa.Table) -> pa.Table:
        scores, at = summed(table)
        own_ids, own_labels, ids, labels = (_longs(at[c]) for c in ("own_ids", "own_labels", "ids", "labels"))
        out = []
        for k, slot, positive_id, positive in at["found"]:
            low, high = -(-positive * LEAST_SHARE // 100), positive * MOST_SHARE // 100
            inside = (scores[k] >= low) & (scores[k] <= high) & (labels != own_labels[k]) & (ids != own_ids[k])
            for p in best(scores[k], ids, np.flatnonzero(inside), NEGATIVES).tolist():
                out.append((at["i"], k, slot, int(own_ids[k]), positive_id, positive, int(ids[p]), int(scores[k, p])))
        return _table(schema, out)

    candidates = tiles(left, right, one_label=False).groupBy("i", "j").applyInArrow(select, schema)
    order = Window.partitionBy("i", "k", "slot").orderBy(F.desc("negative_score"), "negative_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _positives(own: DataFrame, other: DataFrame) -> DataFrame:
    """i, k (the anchor's place in its block), slot (from 1), positive_id and positive_score."""

    def labels(df: DataFrame, name: str) -> DataFrame:
        return df.where("chunk = 0").mapInArrow(_label_rows, "block long, label long").withColumnRenamed("block", name)

    meet = saved(labels(own, "i").join(labels(other, "j"), "label").select("i", "j").distinct(), "meet")
    left = own.withColumnRenamed("block", "i").join(meet, "i").withColumn("found", F.lit(None).cast("array<array<long>>"))
    right = other.withColumnRenamed("block", "j").join(meet, "j")
    schema = "i long, k int, positive_id long, positive_score long"

    def select(table: pa.Table) -> pa.Table:
        scores, at = summed(table)
        own_ids, own_labels, ids, labels = (_longs(at[c]) for c in ("own_ids", "own_labels", "ids", "labels"))
        out = []
        for k in range(len(own_ids)):
            same = np.flatnonzero((labels == own_labels[k]) & (ids != own_ids[k]))
            out += [(at["i"], k, int(ids[p]), int(scores[k, p])) for p in best(scores[k], ids, same, POSITIVES).tolist()]
        return _table(schema, out)

    found = tiles(left, right, one_label=True).groupBy("i", "j").applyInArrow(select, schema)
    order = Window.partitionBy("i", "k").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= POSITIVES)


def _label_rows(batches):
    for batch in batches:
        rows = [(b, x) for b, labels in zip(batch.column("block").to_pylist(), batch.column("labels").to_pylist()) for x in np.unique(_longs(labels)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["block", "label"])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read_table(spark, sf_dir, "embeddings"))


def oracle_sql() -> str:
    """Every anchor against every row, in DuckDB SQL; products and sums of these whole numbers are exact in doubles below 2**53."""
    return f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % {MOVED_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
score AS (SELECT row_number() OVER () AS r, a.vec_id AS anchor_id, a.label AS own, a.q, b.vec_id, b.label, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT * FROM (SELECT anchor_id, own, q, vec_id AS positive_id, s, row_number() OVER (PARTITION BY anchor_id, own, q ORDER BY s DESC, vec_id) AS k FROM score WHERE label = own) WHERE k <= {POSITIVES}),
neg AS (SELECT p.anchor_id, p.positive_id, p.s AS positive_score, n.vec_id AS negative_id, n.s AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.own, p.q, p.k ORDER BY n.s DESC, n.vec_id) AS rank
  FROM pos p JOIN score n ON n.anchor_id = p.anchor_id AND n.own = p.own AND n.q = p.q AND n.label <> p.own AND {LEAST_SHARE} * p.s <= 100 * n.s AND 100 * n.s <= {MOST_SHARE} * p.s)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}"""
