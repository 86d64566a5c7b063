"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document is cut into full windows and a remainder; the remainder is cut evenly into
pieces of a third of a window at most. Groups of a few hundred pieces are then split into
k near-equal windows: the two partial partitions with the largest imbalance are merged
largest sum against smallest sum, until one partition is left. k starts at the least
possible count and rises whenever a window exceeds the capacity.

Defined results: a null or empty text is one piece, the closing id alone; repeated rows
are packed as often as they occur; an empty table gives no rows; extra columns are
ignored; a very long text gives many full windows, and a run of white space that is too long
for the fast tokenizer's pattern is tokenized by the file's own library.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, saved

WINDOW = 2048
END_ID = 1
#: Pieces that one Karmarkar-Karp problem holds on average.
GROUP_PIECES = 256


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load_encoder(path: str):
    """A function text -> ids.

    The vocabulary and merges are read from the tokenizer file and run by tiktoken, which
    gives the same ids several times faster; special tokens are matched in the text as the
    file's own library does by default.
    """
    import json
    import os

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
    back = {c: b for b, c in chars.items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # the pattern's engine gives up on a run of some 500,000 white spaces
            return np.array(own_library(path).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


@lru_cache(maxsize=1)
def own_library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut_points(n: int, window: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full windows, then an evenly cut rest."""
    full = n // window * window
    rest = n - full
    parts = -(-rest // most)
    edges = [full + rest * i // parts for i in range(parts + 1)] if parts else []
    return [(i, window) for i in range(0, full, window)] + [(a, b - a) for a, b in zip(edges, edges[1:])]


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, on demand, ids."""
    docs = docs.select("doc_id", "text")
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(tokenizer)
        for batch in batches:
            rows, which, ids = [], [], []
            for i, text in enumerate(batch.column("text")):
                own = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
                for start, length in cut_points(len(own), window, window // 3):
                    piece = own[start : start + length]
                    rows.append((start, length, zlib.crc32(piece.tobytes()), len(own)))
                    which.append(i)
                    if keep_ids:
                        ids.append(piece.astype("i4"))
            columns = [batch.column("doc_id").take(pa.array(which, pa.int64()))]
            columns += [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            columns += [pa.array(ids, pa.list_(pa.int32()))] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(cut, schema)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: the window, 0 to k-1, of each size."""
    nodes: list[tuple] = []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        nodes.append((i,))
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(sums[0]), len(nodes) - 1, sums))
    out = np.zeros(len(sizes), np.int64)
    todo = [(heap[0][1], np.arange(k))] if heap else []
    while todo:
        node, slots = todo.pop()
        if len(nodes[node]) == 1:
            out[nodes[node][0]] = slots[0]
            continue
        a, b, order = nodes[node]
        own = np.empty(k, np.int64)
        own[order] = slots
        todo += [(a, own), (b, own[::-1])]
    return out


def windows_for(sizes: np.ndarray, window: int) -> np.ndarray:
    """Near-equal windows, as few as the method manages with none above the capacity."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        out = differencing(sizes, k)
        if np.bincount(out, sizes, minlength=k).max(initial=0) <= window:
            return out
        k += 1


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, group_pieces: int = GROUP_PIECES, keep_ids: bool = False) -> DataFrame:
    """Pack all documents; one row per piece with its sequence_id and offset there.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, (ids), sequence_id, offset.
    """
    pieces = token_pieces(docs, tokenizer or tokenizer_path(), window, keep_ids)
    pieces = saved(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n = pieces.where(F.col("length") < window).count()
    groups = max(1, -(-n // group_pieces))
    # a full window is a sequence by itself; the others are dealt evenly, copies too, by row number
    full = pieces.where(F.col("length") == window).withColumns({"sequence_id": (F.col("_row") * 2 + 1), "offset": F.lit(0).cast("long")}).drop("_row")
    rest = pieces.where(F.col("length") < window).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    schema = T.StructType([f for f in rest.schema.fields if f.name not in ("_row", "_group")] + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")])

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")
        sizes = table["length"].to_numpy()
        into = windows_for(sizes, window)
        order = np.argsort(into, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, np.diff(into[order]) > 0]
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        table = table.take(order)
        sequence = (table["_group"].to_numpy() << 24 | into[order]) * 2
        columns = [table[c].cast(f.type) if c in table.column_names else pa.array(x) for c, f, x in zip(schema.names, _arrow(schema), [None] * (len(schema) - 2) + [sequence, offset])]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c]) for c in columns], schema.names)

    return full.select(schema.names).unionByName(rest.groupBy("_group").applyInArrow(solve, schema))


def _arrow(schema: T.StructType) -> list:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
