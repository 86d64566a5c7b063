"""MinHash near-dedup with HyperMinHash registers.

A document's set holds the hashes of its distinct word shingles. Of each of 128 buckets of
the hash space, a 16-bit register keeps the smallest hash as its count of leading zeros and
ten mantissa bits. Documents with equal sets form a class and one of them stands for it.
Bands of four registers put the representatives into buckets. In each bucket, every member
is first held against one centre, another one in every band; pairs whose collision-corrected
Jaccard estimate can reach the threshold are verified on their full sets. Buckets that this
leaves in several components are then searched for links between components, in blocks. One of
more blocks than there are bands is first split by each further band, as a pair that shares one
band shares others: its members are compared with those alike in two bands, not with all.
Components of the verified links give the result.

A pair at the threshold shares no band with probability (1 - 0.8^4)^32 < 6e-8, only one
(which a split bucket would miss) with about 1e-6, and is put aside by the
estimate with about 3e-7. Sets of few shingles fill few bands; in a split bucket they are
compared as well where they share one of their rarest shingles, of which a set of n has
n - ceil(0.8 n) + 1 to show: two sets alike enough share one of these, so none is missed, and
a shingle that all sets of the bucket begin with is nobody's rarest.

Defined results: a null or empty text, or one without words, has an empty set and is linked
with nothing; a text with fewer words than a shingle is one shingle; rows that share a
doc_id are one document, so all their texts that have words are linked with each other; a null
doc_id is linked with nothing, has no component and is kept; an empty table gives no rows;
extra columns are ignored; very long texts count whole. deduplicated() goes by texts alone: of
each group of linked texts one row stays, that with the smallest doc_id, so that no text goes
for another one under its id; of rows alike in id and text it keeps one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHashes, mixed, read_table, row_hashes, saved, shingle_hashes
from .components import components

SHINGLE_WORDS, PERCENT = 5, 80
REGISTER_BITS, MANTISSA_BITS, BAND_ROWS = 7, 10, 4
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 5.0
#: Buckets with more members are verified where they are compared, in blocks of so many; rows of small buckets that are compared together.
SMALL, BLOCK, CHUNK_ROWS = 64, 2048, 20_000
#: Shingles that the sets of a block have about, whatever their number; a set of more is a block of its own.
BLOCK_SHINGLES = 1 << 22
#: Buckets of more blocks are split, as blocks would copy their rows more often than further bands do; sets of at most so many shingles stay together there.
SPLIT_BLOCKS, FEW = (1 << REGISTER_BITS) // BAND_ROWS, 24


def shingle_set(text: str | None, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased."""
    return np.unique(shingle_hashes(hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split()), n))


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading-zero count and mantissa of each bucket's smallest hash; 0 for an empty bucket."""
    out = np.zeros(1 << REGISTER_BITS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, np.diff(bucket) > 0])
        rest = (shingles[first] << np.uint64(REGISTER_BITS)) | np.uint64(64)
        # a double's exponent is the place of the leading one, its top bits are the mantissa
        bits = rest.astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA_BITS)
        out[bucket[first]] = np.minimum(bits - np.uint64(1023 << MANTISSA_BITS), np.uint64(65535)).astype(np.uint16)
    return out


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, s1 and s2 (a 128-bit hash of the set) and registers."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = WordHashes(), []
            for text in batch.column("text"):
                own = shingle_set(text.as_py(), hashes, shingle_words)
                sums = [mixed(own ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                rows.append((len(own), *map(int, sums), registers(own).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            own = [batch.column("doc_id"), batch.column("text_key")]
            yield pa.RecordBatch.from_arrays(own + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "text_key", "n_shingles", "s1", "s2", "registers"])

    return _keyed(docs).mapInArrow(sign, "doc_id long, text_key long, n_shingles long, s1 long, s2 long, registers binary")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))


def shingle_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """id and shingles from id and text."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = WordHashes()
            own = [shingle_set(x.as_py(), hashes, shingle_words).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.list_(pa.int64()))], ["id", "shingles"])

    return texts.select("id", "text").mapInArrow(expand, "id long, shingles array<long>")


def band_rows(signed: DataFrame) -> DataFrame:
    """(bucket, doc_id, n_shingles) for every band with a filled register."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            row, band = np.nonzero(own)
            bucket = mixed(own[row, band] + mixed(band.astype(np.uint64) + np.uint64(1)))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), batch.column("doc_id").take(take), batch.column("n_shingles").take(take)], ["bucket", "doc_id", "n_shingles"])

    return signed.select("doc_id", "n_shingles", "registers").mapInArrow(bands, "bucket long, doc_id long, n_shingles long")


def can_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the corrected Jaccard estimate of registers a and b (last axis) may reach the threshold."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    equal = ((a == b) & (a > 0)).sum(axis=-1)
    used = np.maximum(used, 1)
    chance = (used - equal) / 2.0 ** (MANTISSA_BITS + 1)  # registers that agree though their hashes differ
    need = percent / 100
    return (equal - chance) / used >= need - SLACK * np.sqrt(need * (1 - need) / used) - 1 / used


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _estimated(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    left = signed.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra"))
    right = signed.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("ra", "rb"))
                yield batch.select(["a", "b"]).filter(pa.array(can_link(ra, rb, percent)))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb").mapInArrow(estimate, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as edges (u, v)."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    held = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("n"), (F.size("sa") + F.size("sb")).alias("total"))
    return held.where(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def links(docs: DataFrame, signed: DataFrame, classes: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Verified links (u, v) between classes that connect all that belong together.

    signed: a class's number as doc_id, n_shingles and registers; classes: node (that number) and rep, the doc_id and
    text_key of a row that stands for it.
    """
    found = saved(band_rows(signed), "bands")
    centre = found.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "doc_id").alias("h"), "doc_id", "n_shingles")).alias("c"), F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight"))
    shared = centre.where("members > 1").select(F.col("bucket").alias("_bucket"), F.col("c.doc_id").alias("centre"), F.col("c.n_shingles").alias("n_centre"), "members", "weight")
    shared = saved(shared, "centres")  # so that a bucket of very many can be split among tasks in the join
    members = saved(found.join(shared, F.col("bucket") == F.col("_bucket")).drop("_bucket"), "buckets")
    pairs = members.where((F.col("doc_id") != F.col("centre")) & _sizes_fit("n_shingles", "n_centre", percent)).select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    busy = members.select(F.col("doc_id").alias("_busy")).distinct()
    standing = classes.join(busy, F.col("node") == F.col("_busy")).select(F.col("rep.doc_id").alias("_doc"), F.col("rep.text_key").alias("_text"), F.col("node").alias("id"))
    wanted = _keyed(docs).join(standing, (F.col("doc_id") == F.col("_doc")) & (F.col("text_key") == F.col("_text")))
    sets = saved(shingle_sets(wanted, shingle_words).groupBy("id").agg(F.first("shingles").alias("shingles")), "sets")
    linked = saved(_verified(_estimated(pairs, signed, percent), sets, percent), "links")
    first = components(linked)
    placed = members.join(first, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "n_shingles", "members", "weight", F.coalesce("component", "doc_id").alias("part"))
    # the centre has been held against every other member: of two, nothing is left
    placed = saved(placed.where("members > 2"), "placed")
    split = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select(F.col("bucket").alias("_bucket"))
    split = saved(split, "split")
    open_rows = placed.join(split, F.col("bucket") == F.col("_bucket")).drop("_bucket")
    left = signed.select(F.col("doc_id").alias("_id"), "registers")
    open_rows = saved(open_rows.join(left, F.col("doc_id") == F.col("_id")).drop("_id"), "open")
    # sets of few shingles that one shingle brings together in numbers meet by their rarest ones only
    many_few = (F.col("members") > SMALL) & (F.col("members") <= SPLIT_BLOCKS * BLOCK)
    whole = open_rows.where((F.col("members") <= SPLIT_BLOCKS * BLOCK) & ~(many_few & (F.col("n_shingles") <= FEW))).withColumns({"first": F.lit(-1), "second": F.lit(-1)})
    rows = whole.unionByName(_few(open_rows.where(many_few & (F.col("n_shingles") <= FEW * 100 // percent)), left, sets, percent)).unionByName(_refined(open_rows.where(F.col("members") > SPLIT_BLOCKS * BLOCK), left, sets, percent))
    few = _verified(_pairs_of_small(rows.where(F.col("members") <= SMALL), percent), sets, percent)
    many = _links_of_large(rows.where(F.col("members") > SMALL), sets, percent)
    return linked.unionByName(few).unionByName(many)


def _own_band(bucket: int, bands: np.ndarray) -> int:
    """The band of a row's registers that put it into the bucket."""
    numbers = np.arange(len(bands), dtype=np.uint64)
    return int(np.flatnonzero(mixed(bands + mixed(numbers + np.uint64(1))).view(np.int64) == bucket)[0])


def _by_rarest(few: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of sets of few shingles, a row for each of a set's rarest shingles in its bucket, which takes the bucket's place."""
    each = few.join(sets, F.col("doc_id") == F.col("id")).select(*few.columns, F.explode("shingles").alias("s"))
    held = each.groupBy("bucket", "s").agg(F.count(F.lit(1)).alias("n")).select(F.col("bucket").alias("_bucket"), F.col("s").alias("_s"), "n")
    known = each.join(held, (F.col("bucket") == F.col("_bucket")) & (F.col("s") == F.col("_s")))
    order = F.array_sort(F.collect_list(F.struct("n", "s")))  # few shingles
    shown = F.expr(f"cast(n_shingles - (n_shingles * {percent} + 99) div 100 + 1 as int)")
    ranked = known.groupBy(*few.columns).agg(order.alias("o")).withColumn("s", F.explode(F.slice("o", 1, shown)["s"]))
    return ranked.select(F.xxhash64("bucket", "s").alias("bucket"), *few.columns[1:])


def _few(rows: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of sets of few shingles in open buckets that aren't split by bands, by their rarest shingles; first: the bucket's band, second: -2."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bands = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                first = pa.array([_own_band(b, x) for b, x in zip(batch.column("bucket").to_pylist(), bands)], pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), first, pa.array(np.full(batch.num_rows, -2, np.int32))], [*names, "first", "second"])

    names = ("bucket", "doc_id", "part", "n_shingles")
    placed = rows.select(*names, "registers").mapInArrow(own, "bucket long, doc_id long, part long, n_shingles long, first int, second int")
    return _still_open(saved(_by_rarest(placed, sets, percent), "few"), signed)


def _still_open(parts: DataFrame, signed: DataFrame) -> DataFrame:
    """Of parts of buckets those whose rows lie in several components, with their members, weight and registers."""
    split_again = parts.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("weight"))
    split_again = saved(split_again.where("low < high").select(F.col("bucket").alias("_bucket"), "members", "weight"), "split")
    kept = parts.join(split_again, F.col("bucket") == F.col("_bucket")).drop("_bucket")
    return saved(kept.join(signed, F.col("doc_id") == F.col("_id")).drop("_id"), "refined")


def _refined(rows: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of open buckets, split by each later band; first and second: the bucket's band and the later one.

    The parts whose second is the number of bands hold the sets of few shingles, by their rarest ones. Sets of up to
    FEW shingles count as few, and larger ones that such a set may be alike to. signed: _id and registers.
    """
    most = FEW * 100 // percent

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bands = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            bucket, few = batch.column("bucket").to_numpy(), batch.column("n_shingles").to_numpy() <= most
            first = np.array([_own_band(b, own) for b, own in zip(bucket, bands)], np.int32)
            key = np.c_[bands, few.astype(np.uint64)]
            own = np.arange(key.shape[1]) > first[:, None]
            own[batch.column("n_shingles").to_numpy() <= FEW, :-1] = False  # these meet all that they are alike to in the last parts
            row, second = np.nonzero((key > 0) & own)
            part = mixed(mixed(bucket.view(np.uint64)[row] + mixed(second.astype(np.uint64) + np.uint64(1))) + key[row, second])
            take = pa.array(row)
            held = [batch.column(c).take(take) for c in ("doc_id", "part", "n_shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), *held, pa.array(first[row]), pa.array(second.astype(np.int32))], ["bucket", "doc_id", "part", "n_shingles", "first", "second"])

    narrow = rows.select("bucket", "doc_id", "part", "n_shingles", "registers")
    bands = (1 << REGISTER_BITS) // BAND_ROWS
    dealt = saved(narrow.mapInArrow(split, "bucket long, doc_id long, part long, n_shingles long, first int, second int"), "dealt")
    parts = saved(dealt.where(F.col("second") < bands).unionByName(_by_rarest(dealt.where(F.col("second") == bands), sets, percent)), "parts")
    return _still_open(parts, signed)


def _candidates(bucket: int, split: tuple[int, int], regs: np.ndarray, ids: np.ndarray, parts: np.ndarray, sizes: np.ndarray, percent: int, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each place in first, the places in second with which it may link: in another part, of a fitting size
    and estimate, and in no earlier bucket together (there the pair has been looked at). split: the two bands of a
    bucket's part, its band and -2 for sets of few shingles, or -1 twice."""
    bands = regs.view(np.uint64)
    if split[1] in (-2, bands.shape[1]):  # sets of few shingles: only buckets of earlier bands have looked at their pairs
        earlier = np.arange(split[0])
    else:
        earlier = np.delete(np.arange(split[1]), split[0]) if split[1] >= 0 else np.arange(_own_band(bucket, bands[0]))
    for k in first:
        may = (parts[second] != parts[k]) & (ids[second] > ids[k]) & (100 * np.minimum(sizes[k], sizes[second]) >= percent * np.maximum(sizes[k], sizes[second]))
        at = second[may]
        if len(at) and len(earlier):
            at = at[~((bands[np.ix_(at, earlier)] == bands[k, earlier]) & (bands[k, earlier] > 0)).any(axis=1)]
        if len(at):
            at = at[can_link(regs[k][None, :], regs[at], percent)]
        if len(at):
            yield int(k), at


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    regs = np.frombuffer(b"".join(table["registers"].to_pylist()), np.uint16).reshape(table.num_rows, -1)
    return regs, *(table[c].to_numpy() for c in ("doc_id", "part", "n_shingles"))


def _pairs_of_small(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, of buckets with few members; many buckets in one call."""
    chunks = max(1, rows.count() // CHUNK_ROWS)

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        bucket, (regs, ids, parts, sizes) = table["bucket"].to_numpy(), _arrays(table)
        split = list(zip(table["first"].to_pylist(), table["second"].to_pylist()))
        edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        a, b = [], []
        for low, high in zip(edges[:-1], edges[1:]):
            cut = slice(low, high)
            every = np.arange(high - low)
            for k, at in _candidates(bucket[low], split[low], regs[cut], ids[cut], parts[cut], sizes[cut], percent, every, every):
                a.append(np.full(len(at), ids[low + k]))
                b.append(ids[low + at])
        return pa.table({"a": np.concatenate(a) if a else np.empty(0, np.int64), "b": np.concatenate(b) if b else np.empty(0, np.int64)})

    dealt = rows.select("bucket", "first", "second", "doc_id", "part", "n_shingles", "registers", F.pmod(F.xxhash64("bucket"), F.lit(chunks)).alias("chunk"))
    return dealt.groupBy("chunk").applyInArrow(compare, "a long, b long").distinct()


def _links_of_large(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (u, v) of buckets with many members, as many as connect what belongs together.

    A bucket is cut into blocks of about so many rows, or fewer where their sets are large, and each
    pair of blocks is a task's work; its pairs are verified there, so only links leave it, not pairs.
    """
    dealt = rows.withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK), F.least("members", F.ceil(F.col("weight") / BLOCK_SHINGLES))).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = dealt.select("bucket", "first", "second", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "n_shingles", "part", "registers")
    keyed = keyed.join(sets, F.col("doc_id") == F.col("id")).drop("id")

    def compare(table: pa.Table) -> pa.Table:
        regs, ids, parts, sizes = _arrays(table)
        own, i, j = table["own"].to_numpy(), table["i"][0].as_py(), table["j"][0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        shingles: dict[int, frozenset] = {}
        held = table["shingles"]
        root = {int(p): int(p) for p in parts}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        def own_set(k: int) -> frozenset:
            if k not in shingles:
                shingles[k] = frozenset(held[k].values.to_numpy().tolist())
            return shingles[k]

        found = []
        for first, second in ((left, right), (right, left)) if i != j else ((left, left),):
            for k, at in _candidates(table["bucket"][0].as_py(), (table["first"][0].as_py(), table["second"][0].as_py()), regs, ids, parts, sizes, percent, first, second):
                for m in at.tolist():
                    x, y = top(int(parts[k])), top(int(parts[m]))
                    if x != y:
                        shared = len(own_set(k) & own_set(m))
                        if 100 * shared >= percent * (int(sizes[k]) + int(sizes[m]) - shared):
                            root[y] = x
                            found.append((int(ids[k]), int(ids[m])))
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return keyed.groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long")


def grouped(docs: DataFrame, shingle_words: int, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """(signed, classes): signatures() of every row, and of every set s1, s2 and best, the smallest doc_id, node and
    text_key of its component, and rep, the same of the class itself. by_id: whether the texts of one doc_id are linked."""
    signed = saved(signatures(docs, shingle_words), "signed")
    filled = signed.where("n_shingles > 0 and doc_id is not null").withColumn("node", F.xxhash64("s1", "s2"))
    classes = saved(filled.groupBy("s1", "s2", "node").agg(F.min(F.struct("doc_id", "node", "text_key")).alias("rep")), "classes")
    own = classes.select(F.col("node").alias("_node"), "rep")
    reps = filled.join(own, (F.col("node") == F.col("_node")) & (F.col("doc_id") == F.col("rep.doc_id")) & (F.col("text_key") == F.col("rep.text_key")))
    reps = saved(reps.select(F.col("node").alias("doc_id"), "n_shingles", "registers").dropDuplicates(["doc_id"]), "reps")
    found = links(docs, reps, classes, shingle_words, percent)
    if by_id:
        texts = filled.select("doc_id", "node").distinct()
        several = texts.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("_last")).where("u < _last")
        several = saved(several.select(F.col("doc_id").alias("_doc"), "u"), "several")
        found = found.unionByName(texts.join(several, F.col("doc_id") == F.col("_doc")).select("u", F.col("node").alias("v")))
    whole = saved(components(found), "components")
    placed = whole.unionByName(whole.select(F.col("component").alias("node"), "component").distinct())
    best = placed.join(own, F.col("node") == F.col("_node")).groupBy("component").agg(F.min("rep").alias("best"))
    best = saved(best.select(F.col("component").alias("_component"), "best"), "best")
    joined = classes.join(placed.withColumnRenamed("node", "_placed"), F.col("node") == F.col("_placed"), "left").join(best, F.col("component") == F.col("_component"), "left")
    return signed, joined.select("s1", "s2", F.coalesce("best", "rep").alias("best"), "rep")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and kept."""
    signed, classes = grouped(docs, shingle_words, percent, by_id=True)
    named = classes.select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), F.col("best.doc_id").alias("_component"))
    rows = signed.select("doc_id", "n_shingles", "s1", "s2")
    joined = rows.join(named, (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id")
    return joined.select("doc_id", "n_shingles", component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose text stands for its group of near-duplicates, and those without an id or words."""
    signed, classes = grouped(docs, shingle_words, percent, by_id=False)
    chosen = classes.where(F.col("rep") == F.col("best")).select(F.col("rep.doc_id").alias("_doc"), F.col("rep.text_key").alias("_text"))
    empty = signed.where("n_shingles = 0 and doc_id is not null").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"))
    # a row travels as one column, so that its own columns' names clash with nothing
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_key"), row_hashes(docs)[0].alias("_order"))
    named = keyed.join(chosen.unionByName(empty), (F.col("_id") == F.col("_doc")) & (F.col("_key") == F.col("_text")), "left_semi")
    first = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_order"))
    one = named.withColumn("_n", first).where("_n = 1").select("row")
    return one.unionByName(keyed.where("_id is null").select("row")).select("row.*")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle_words=4)
