"""Language-model scoring with a weighted backoff automaton.

The smoothed n-grams of the training texts become an automaton. A state is a context of up to
``order`` - 1 tokens: the root is the empty one, and one more stands for the start of a text.
State h has an arc over token w, if h w occurs, of probability

    P(w | h) = (c(h w) + (m + s(h)) * P(w | h')) / (c(h) + m),

where h' is h without its first token and m a prior's weight, and a failure arc to h' of
weight (m + s(h)) / (c(h) + m). An n-gram of three tokens and more is an arc only if it occurs
``LEAST`` times; s(h) is what such a context's rarer n-grams would have held, so that every
state's probabilities add up to 1. The root has an arc over every token, of probability
(c(w) + 0.1) / (N + 0.1 * (V + 1)). An arc leads to the longest context that it ends on and
that has arcs. A text is read once from left to right: from the state carried so far, failure
arcs are followed until a state has an arc over the next token, and the weights are added. Before
each token a text can only be in the states of the contexts that end there, so that the failure
arcs of these few are followed for all tokens of a chunk at once.

Texts are packed into chunks of bounded size as they are read. A chunk asks for the counts of
its distinct n-grams, each once, with its own training counts; the keys are dealt by ranges of
their hashes, added up over all chunks and sent back, so that a chunk builds the part of the
automaton that its own texts can reach, however large the model is. The highest order is asked
for first; what it leaves out is then added up by context along with the next. Keys of two
tokens and more have 18 bits more than the corpus has characters (48 at least), so that about
one in a million shares its count with another. The number of ranges grows with the corpus;
where more than ``fan`` chunks ask, they are added up in a tree of so many branches.

Defined results: a null or empty text is its end token alone; a null doc_id counts as the
text "", which is held out; repeated rows are trained on and scored as often as they occur;
an empty table gives no rows; extra columns are ignored; very long texts are read whole, each
in one chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, read_table, saved

#: Tokens of the longest n-grams; the weight of the lower order for two tokens, and for more; added to the counts of single tokens.
ORDER, PRIORS, ADDED = 3, (16.0, 1.0), 0.1
#: Occurrences that an n-gram of three tokens and more needs.
LEAST = 2
#: Characters of text in a chunk, keys asked for in a range, and chunks added up at once, about.
CHUNK_CHARS, PART_KEYS, FAN = 4_000_000, 3_000_000, 1_000_000
END, START = np.uint64(0x0E11D0F7E87F0001), np.uint64(0x57A27000000F0001)

ASKED = "part long, node long, n long, hashes binary, counts binary, rare binary"
ANSWERED = "part long, node long, n long, totals binary, rare binary, tokens long, types long"


def is_training(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 != 0


# n-grams of a chunk


@dataclass
class Grams:
    """Sorted distinct n-grams of one length, with training counts; number of each one's context and of the n-gram
    without its first token among those one shorter (-1: the start), and of its last token among single tokens."""

    keys: np.ndarray
    counts: np.ndarray
    context: np.ndarray
    shorter: np.ndarray
    last: np.ndarray
    #: Number of the n-gram that ends at each token of the chunk, -1 for none.
    at: np.ndarray


#: A word's hash is the sum of its bytes' numbers times powers of an odd number, A-Z counting as a-z.
_POWER = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.isin(np.arange(256), (32, 9, 10, 11, 12, 13))
#: Bytes that are hashed at once, about.
_STRETCH = 1 << 18


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, and those of the inverse, modulo 2**64."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64) for x in (_POWER, pow(_POWER, -1, 2**64)))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every word of some bytes."""
    blank = np.r_[True, _SPACE[data], True]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, stops = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + _STRETCH, side="right")))
        low, n = starts[i], int(stops[j - 1] - starts[i])
        powers, inverse = _powers(max(_STRETCH, 1 << n.bit_length()) + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[low : low + n]] * powers[:n], out=sums[1:])
        out[i:j] = (sums[stops[i:j] - low] - sums[starts[i:j] - low]) * inverse[starts[i:j] - low]
        i = j
    return starts, mixed(out)


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, every text's end included, and the place after each text's end."""
    after = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    starts, words = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    own = np.searchsorted(after, starts, side="right")  # the text of each word
    ends = np.searchsorted(starts, after) + np.arange(1, len(texts) + 1)
    tokens = np.full(len(words) + len(texts), END)
    tokens[np.arange(len(words)) + own] = words
    return tokens, ends


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, a place of each, and the number of each place's key."""
    # sorting whole numbers is ten times as fast as sorting places by them, so the place takes the low bits
    n, up = np.uint64(len(keys).bit_length()), np.uint64(64 - int(keys.max(initial=1)).bit_length())
    order = (np.sort(keys << up >> n << n | np.arange(len(keys), dtype=np.uint64)) & ((np.uint64(1) << n) - np.uint64(1))).astype(np.int64)
    along = keys[order]
    if (along[1:] < along[:-1]).any():  # keys that differ in the low bits only
        order = np.argsort(keys)
        along = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = along[1:] != along[:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return along[new], order[new], number


def grams_of(tokens: np.ndarray, ends: np.ndarray, training: np.ndarray, order: int, bits: int) -> list[Grams]:
    """The chunk's n-grams of 1, 2, ... order tokens."""
    first = np.r_[0, ends[:-1]]
    sizes = ends - first
    weight, place = np.repeat(training, sizes).astype(float), np.arange(len(tokens)) - np.repeat(first, sizes)
    single = run = mixed(tokens)
    out: list[Grams] = []
    for k in range(1, order + 1):
        there = np.flatnonzero(place >= k - 2)
        if k > 1:
            before = np.r_[START, run[:-1]]
            if k == 2:
                before[first] = START
            run = mixed(before * np.uint64(0x9E3779B97F4A7C15) + single)
        keys, where, number = distinct(run[there] >> np.uint64(64 - bits if k > 1 else 0))
        at = np.full(len(tokens), -1, np.int64)
        at[there] = number
        where = there[where]
        context = shorter = last = np.arange(len(keys))
        if k > 1:
            context = np.where(place[where] > 0, out[-1].at[where - 1], -1)
            shorter, last = out[-1].at[where], out[0].at[where]
        out.append(Grams(keys, np.bincount(number, weight[there], len(keys)).astype(np.int64), context, shorter, last, at))
    return out


# keys and counts on their way


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, one byte of all after the other, compressed."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def widened(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        width = data[0]
        out[:, :width] = np.frombuffer(pa.decompress(data[1:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _low(part: int, parts: int, bits: int) -> int:
    """The first key of a range; ranges of single tokens come first, then those of each further length."""
    return part % parts * 2 ** (bits if part >= parts else 64) // parts


def _steps(keys: np.ndarray, low: int) -> bytes:
    return squeezed(np.diff(keys, prepend=np.uint64(low)))


def asks(k: int, grams: Grams, rare: np.ndarray, node: int, parts: int, bits: int) -> list[tuple]:
    """A row for each range of keys: what the chunk asks for and has itself."""
    lows = [_low((k - 1) * parts + i, parts, bits) for i in range(parts)]
    edges = np.r_[np.searchsorted(grams.keys, np.array(lows, np.uint64)), len(grams.keys)]
    return [
        ((k - 1) * parts + i, node, int(b - a), _steps(grams.keys[a:b], lows[i]), squeezed(grams.counts[a:b]), squeezed(rare[a:b]))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))
        if b > a
    ]


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def totals(asked: DataFrame, lengths: tuple[int, ...], nodes: int, parts: int, bits: int, fan: int) -> DataFrame:
    """ANSWERED: the corpus's counts of the n-grams of these lengths that are asked for, in the asking row's order, with
    the sum and number of the range's tokens."""

    def merged(table: pa.Table) -> tuple[list[np.ndarray], list[int], np.ndarray, np.ndarray, np.ndarray]:
        sizes, low = table["n"].to_pylist(), _low(table["part"][0].as_py(), parts, bits)
        hashes = [np.cumsum(widened(x, n), dtype=np.uint64) + np.uint64(low) for x, n in zip(table["hashes"].to_pylist(), sizes)]
        keys, _, at = distinct(np.concatenate(hashes))
        sums = [np.bincount(at, np.concatenate([widened(x, n) for x, n in zip(table[c].to_pylist(), sizes)]), len(keys)).astype(np.int64) for c in ("counts", "rare")]
        return hashes, sizes, at, keys, np.stack(sums)

    def add_up(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() // parts + 1 not in lengths:
            return _table([], ANSWERED)
        _, sizes, at, _, sums = merged(table)
        found = np.split(sums[:, at], np.cumsum(sizes)[:-1], axis=1)
        numbers = (int(sums[0].sum()), int((sums[0] > 0).sum()))
        return _table([(part, node, n, *map(squeezed, x), *numbers) for part, node, n, x in zip(table["part"].to_pylist(), table["node"].to_pylist(), sizes, found)], ANSWERED)

    def lift(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        _, _, _, keys, sums = merged(table)
        return _table([(part, table["up"][0].as_py(), len(keys), _steps(keys, _low(part, parts, bits)), *map(squeezed, sums))], ASKED)

    def hand_down(table: pa.Table, above: pa.Table) -> pa.Table:
        rows = above.to_pylist()  # one, or none of a length that nobody wants
        if not rows:
            return _table([], ANSWERED)
        [row] = rows
        hashes, sizes, _, keys, _ = merged(table)
        sums = [widened(row[c], len(keys)) for c in ("totals", "rare")]
        own = [np.searchsorted(keys, h) for h in hashes]
        return _table([(row["part"], node, n, *(squeezed(s[i]) for s in sums), row["tokens"], row["types"]) for node, n, i in zip(table["node"].to_pylist(), sizes, own)], ANSWERED)

    if nodes <= fan:
        return asked.groupBy("part").applyInArrow(add_up, ANSWERED)
    groups = -(-nodes // fan)
    dealt = saved(asked, "lm-asked").withColumn("up", F.pmod(F.xxhash64("node"), F.lit(groups)))
    above = totals(dealt.groupBy("part", "up").applyInArrow(lift, ASKED), lengths, groups, parts, bits, fan)
    return dealt.groupBy("part", "up").cogroup(above.groupBy("part", "node")).applyInArrow(hand_down, ANSWERED)


# the automaton


@dataclass
class Automaton:
    """A chunk's part of the model. A state is a context, numbered among the chunk's n-grams of its length; that of length
    0 is the root. The lists go by length: the arc onto an n-gram leaves the state of its context, over its last token."""

    #: Of each n-gram of 1, 2, ... tokens: whether it is an arc, its weight, and the length of the state that it leads to.
    is_arc: list[np.ndarray]
    weight: list[np.ndarray]
    leads_to: list[np.ndarray]
    #: Of each context of 1, 2, ... tokens: the failure arc's weight, and the length of the state that it leads to.
    failure_weight: list[np.ndarray]
    fails_to: list[np.ndarray]
    #: The failure arc, to the root, of the state at a text's start.
    start_weight: float

    def moves(self, grams: list[Grams], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[length of state, token]: weight and length of the state reached, along failure arcs until a state has an arc over the token."""
        first, every = np.r_[0, ends[:-1]], np.arange(ends[-1])
        weight, reached = np.zeros((len(grams), ends[-1])), np.zeros((len(grams), ends[-1]), np.uint8)
        weight[0], reached[0] = self.weight[0][grams[0].at], self.leads_to[0][grams[0].at]
        for k in range(1, len(grams)):
            gram, state = grams[k].at, np.r_[-1, grams[k - 1].at[:-1]]
            if k == 1:
                state[first] = -1
            back = np.where(state >= 0, self.fails_to[k - 1][state], 0)
            failure = np.where(state >= 0, self.failure_weight[k - 1][state], self.start_weight)
            arc = (gram >= 0) & self.is_arc[k][gram]
            weight[k] = np.where(arc, self.weight[k][gram], failure + weight[back, every])
            reached[k] = np.where(arc, self.leads_to[k][gram], reached[back, every])
        return weight, reached

    def scores(self, grams: list[Grams], ends: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text, read once from left to right, carrying the state."""
        weight, reached = self.moves(grams, ends)
        path = walked(np.ascontiguousarray(reached.T).tobytes(), len(grams), ends.tolist())
        return np.add.reduceat(weight[np.frombuffer(path, np.uint8), np.arange(ends[-1])], np.r_[0, ends[:-1]])


def walked(reached: bytes, order: int, ends: list[int]) -> bytearray:
    """The state from which each token is read, as its length; a text begins at its start's, of length 1."""
    path, begin = bytearray(), 0
    put = path.append
    for end in ends:
        state = 1
        for at in range(begin * order, end * order, order):
            put(state)
            state = reached[at + state]
        begin = end
    return path


def automaton(grams: list[Grams], counts: list[np.ndarray], rare: list[np.ndarray], n_texts: int, n_train: int, n_types: int, priors: tuple = PRIORS, least: int = LEAST) -> Automaton:
    """The states, arcs and failure arcs that a chunk's texts can reach, from the corpus's counts of the chunk's n-grams.

    rare: by n-gram, what its continuations below ``least`` occurrences hold together.
    """
    order = len(grams)
    p = (counts[0] + ADDED) / (n_train + ADDED * (n_types + 1))
    # the state that a history ending on an n-gram is in: the n-gram's own, if it has arcs, else that of the n-gram without its first token
    reached = (counts[0] > 0).astype(np.uint8)
    out = Automaton([np.ones(len(p), bool)], [np.log10(p)], [reached], [], [], float(np.log10(priors[0] / (n_texts + priors[0]))))
    for k in range(2, order + 1):
        g, below, beyond = grams[k - 1], counts[k - 2], rare[k - 2]
        prior = priors[min(k - 2, len(priors) - 1)]
        out.failure_weight.append(np.log10((prior + beyond) / (below + prior)))
        out.fails_to.append(out.leads_to[k - 3][grams[k - 2].shorter] if k > 2 else np.zeros(len(below), np.uint8))
        known = g.context >= 0
        total, left = np.where(known, below[g.context], n_texts), prior + np.where(known, beyond[g.context], 0)
        is_arc = counts[k - 1] >= (least if k > 2 else 1)
        p = np.where(is_arc, (counts[k - 1] + left * p[g.shorter]) / (total + prior), 1.0)
        reached = reached[g.shorter]
        if k < order:
            reached = np.where(counts[k - 1] > rare[k - 1], k, reached).astype(np.uint8)
        out.is_arc.append(is_arc)
        out.weight.append(np.log10(p))
        out.leads_to.append(reached)
    return out


# the job


def chunked(docs: DataFrame, chunk_chars: int) -> DataFrame:
    """node (the chunk's number), ids, sizes and texts: rows packed as they are read, so that like rows need not meet."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("texts", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def row(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([number]), pa.array([ids], pa.list_(kind)), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([pa.compress(b"".join(texts), codec="zstd", asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids.append(doc_id)
                texts.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                held += len(texts[-1]) + 1
                if held >= chunk_chars:
                    yield row(kind)
                    ids, texts, held, number = [], [], 0, number + 1
        if ids:
            yield row(kind)

    return docs.mapInArrow(pack, schema)


def _unpacked(table: pa.Table) -> tuple[int, list, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's number, ids, tokens, places after each text's end, and which texts are for training."""
    [chunk] = table.select(["node", "ids", "sizes", "texts"]).to_pylist()
    ends = np.cumsum(chunk["sizes"])
    raw = pa.decompress(chunk["texts"], int(ends[-1]), codec="zstd", asbytes=True) if ends[-1] else b""
    tokens, token_ends = tokens_of([raw[b - n : b] for n, b in zip(chunk["sizes"], ends.tolist())])
    return chunk["node"], chunk["ids"], tokens, token_ends, np.array([is_training(x) for x in chunk["ids"]], bool)


def scored(docs: DataFrame, order: int = ORDER, priors: tuple = PRIORS, least: int = LEAST, chunk_chars: int = CHUNK_CHARS, part_keys: int = PART_KEYS, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 0
    parts = max(1, -(-chars // (5 * part_keys)))
    bits = min(64, max(48, 18 + int(chars).bit_length()))
    nodes = max(1, -(-chars // chunk_chars))
    # every round, and every task that runs again, has to see the same chunks, whatever order a partition's rows come in
    chunks = chunked(docs.sortWithinPartitions("doc_id", F.xxhash64("text")), chunk_chars)

    def found(answers: pa.Table, k: int, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """The corpus's counts of the chunk's n-grams of k tokens, and what their rare continuations hold."""
        rows = sorted((r for r in answers.to_pylist() if r["part"] // parts == k - 1), key=lambda r: r["part"])
        sums = [np.concatenate([np.empty(0, np.uint64), *(widened(r[c], r["n"]) for r in rows)]).astype(np.int64) for c in ("totals", "rare")]
        if len(sums[0]) != len(grams.keys):
            raise RuntimeError("a chunk's answers don't fit its keys")
        return sums[0], sums[1]

    def ask(table: pa.Table) -> pa.Table:
        node, _, tokens, ends, training = _unpacked(table)
        grams = grams_of(tokens, ends, training, order, bits)
        return _table([r for k in (1, order) for r in asks(k, grams[k - 1], np.zeros(len(grams[k - 1].keys), np.int64), node, parts, bits)], ASKED)

    def ask_next(k: int):
        def run(table: pa.Table, answers: pa.Table) -> pa.Table:
            node, _, tokens, ends, training = _unpacked(table)
            grams = grams_of(tokens, ends, training, k + 1, bits)
            longer = grams[k]
            total, _ = found(answers, k + 1, longer)
            # what is too rare for an arc, and is counted in this chunk
            own = np.where((total < least), longer.counts, 0)
            rare = np.bincount(longer.context[longer.context >= 0], own[longer.context >= 0], len(grams[k - 1].keys)).astype(np.int64)
            return _table(asks(k, grams[k - 1], rare, node, parts, bits), ASKED)

        return run

    asked, sizes = chunks.groupBy("node").applyInArrow(ask, ASKED), (nodes, parts, bits, fan)
    words = totals(asked, (1,), *sizes).groupBy("part").agg(F.first("tokens").alias("tokens"), F.first("types").alias("types"))
    corpus = words.agg(F.sum("tokens").alias("n_train"), F.sum("types").alias("n_types"))  # one row
    every = totals(asked, (1, order), *sizes)
    for k in range(order - 1, 1, -1):
        known = totals(asked, (k + 1,), *sizes).select("part", "node", "n", "totals", "rare")
        asked = chunks.groupBy("node").cogroup(known.groupBy("node")).applyInArrow(ask_next(k), ASKED)
        every = every.unionByName(totals(asked, (k,), *sizes))
    every = every.drop("tokens", "types").crossJoin(F.broadcast(corpus))
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    schema = T.StructType([id_field, T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, ids, tokens, ends, training = _unpacked(table)
        n_train, n_types = answers["n_train"][0].as_py(), answers["n_types"][0].as_py()
        grams = grams_of(tokens, ends, training, order, bits)
        counts, rare = zip(*(found(answers, k, g) for k, g in enumerate(grams, 1)))
        word, first = grams[0].at, np.r_[0, ends[:-1]]
        base = np.log10((counts[0][word] + ADDED) / (n_train + ADDED * (n_types + 1)))
        n_known, base = (np.add.reduceat(x, first) for x in ((counts[0][word] > 0).astype(np.int64), base))
        model = automaton(grams, list(counts), list(rare), int(counts[0][word[ends[0] - 1]]), n_train, n_types, priors, least)
        columns = [pa.array(ids, table.schema.field("ids").type.value_type), pa.array(~training), pa.array(ends - first), pa.array(n_known), pa.array(np.full(len(ids), n_train)), pa.array(base), pa.array(model.scores(grams, ends))]
        return pa.table(dict(zip(schema.names, columns)))

    return chunks.groupBy("node").cogroup(every.groupBy("node")).applyInArrow(score, schema)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents"))
