"""Offset-preserving SentencePiece encoding, and decoding.

A text is first normalised as the model file says: from left to right, the longest rule of the
compiled character map (a double-array trie and its replacements) that begins at a place
replaces what it matched; then blanks are escaped and the leading one added. Every byte that
comes out carries the place in the source that it came from. The normalised text is cut where
no piece of the vocabulary can reach across, each distinct stretch is merged into pieces once,
and the pieces' lengths are laid along the text; so each piece is projected to the bytes of
the source that it stands for.

Merging itself is the library's, on a copy of the model whose own normaliser is switched off;
decoding is the library's ``decode(ids)``.

Models: byte-pair merging with byte fallback, blanks at the front of words, no symbols of the
user's; others are an error, as their pieces could be cut otherwise.

Spans: the bytes [start, end) of the source's UTF-8 for each id. The leading blank that the
model adds stands for no byte; of the byte pieces of one character, the last has its span and
those before it are empty at its start.

Defined results: a null or empty text has no ids and decodes to the empty text; bytes that are
no UTF-8 are read as U+FFFD, one for each; repeated rows are encoded as often as they occur;
an empty table gives no rows; a very long text is encoded as a whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table

#: What a blank becomes where blanks are escaped.
BLANK = "▁"
#: Characters of text that are encoded at a time, and distinct stretches and their characters that a task remembers.
TOGETHER, REMEMBERED, LONGEST = 1 << 21, 400_000, 64

_REPLACED = "�".encode()
_STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes) -> Iterator[tuple[int, object, bytes]]:
    """(number, value, the field's own bytes) of each field of a serialized message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        start = at
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value, data[start:at]


class CharacterMap:
    """The compiled rules of a normaliser: the longest that begins at a place, and what replaces it."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
        self.texts = blob[4 + size :]
        self.begins = np.array([bool(size) and self._step(self._first(0), c) is not None for c in range(256)])
        self.empty = not self.begins.any()

    def _first(self, node: int) -> int:
        """Where the children of the node at this place are counted from."""
        unit = self.units[node]
        return node ^ (unit >> 10 << (8 if unit & 0x200 else 0))

    def _step(self, base: int, c: int) -> int | None:
        node = base ^ c
        return node if node < len(self.units) and self.units[node] & 0x800000FF == c else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest rule at this place."""
        base, found = self._first(0), None
        for end in range(at, len(data)):
            node = self._step(base, data[end])
            if node is None:
                break
            base = self._first(node)
            if self.units[node] & 0x100:
                found = end + 1 - at, self.units[base] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]


class Normaliser:
    """Applies a model's normalisation and remembers where each byte came from."""

    def __init__(self, spec: bytes) -> None:
        own = {k: v for k, v, _ in fields(spec)}
        self.rules = CharacterMap(own.get(2, b""))
        self.lead, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))

    def _edits(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, length, replacement) of what changes, from left to right."""
        wrong = set()
        at = 0
        while True:
            try:
                data[at:].decode()
                break
            except UnicodeDecodeError as e:
                wrong.add(at + e.start)
                at += e.start + 1
        if self.rules.empty and not wrong:
            return
        every = np.frombuffer(data, np.uint8)
        starts = ((every & 0xC0) != 0x80) & self.rules.begins[every]
        starts[list(wrong)] = True
        done = 0
        for at in np.flatnonzero(starts).tolist():
            if at >= done:
                found = (1, _REPLACED) if at in wrong else self.rules.longest(data, at)
                if found:
                    yield at, *found
                    done = at + found[0]

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end a place in the source."""
        if not data:
            return b"", np.zeros(1, np.int32)
        every = np.frombuffer(data, np.uint8)
        character = np.maximum.accumulate(np.where((every & 0xC0) != 0x80, np.arange(len(data), dtype=np.int32), 0))
        texts, places, at, deleted = [], [], 0, len(data)
        for start, length, text in self._edits(data):
            deleted = deleted if text else min(deleted, start)
            texts += [data[at:start], text]
            places += [character[at:start], np.full(len(text), start, np.int32)]
            at = start + length
        texts.append(data[at:])
        places.append(character[at:])
        out, place = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(places)
        first, end = 0, len(data)
        if self.squeeze:
            out, place, first, end = self._squeezed(out, place, len(data))
            if not len(out):
                return b"", np.zeros(1, np.int32)
            first = min(first, deleted)
        counts = np.where(out == 0x20, 3, 1) if self.escape else np.ones(len(out), int)
        place = np.repeat(place, counts)
        text = out.tobytes().replace(b" ", BLANK.encode()) if self.escape else out.tobytes()
        if self.lead:
            lead = BLANK.encode() if self.escape else b" "
            text, place = lead + text, np.r_[np.full(len(lead), first, np.int32), place]
        return text, np.r_[place, np.int32(end)].astype(np.int32)

    @staticmethod
    def _squeezed(out: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Without blanks at the ends and after other blanks; where the text begins and ends in the source."""
        blank = out == 0x20
        filled = np.flatnonzero(~blank)
        if not len(filled):
            return out[:0], place[:0], length, length
        unit = np.r_[True, place[1:] != place[:-1]]  # bytes that one rule gave share a place
        begin = np.maximum.accumulate(np.where(unit, np.arange(len(out)), 0))
        solid = np.maximum.accumulate(np.where(blank, -1, np.arange(len(out))))
        leading = blank & (solid < begin)  # no other byte of its unit before it
        before = np.where(begin > 0, blank[begin - 1], True)
        keep = ~(leading & before)
        keep[filled[-1] + 1 :] = False
        end = int(place[filled[-1] + 1]) if filled[-1] + 1 < len(out) else length
        return out[keep], place[keep], int(place[filled[0]]), end


class Encoder:
    """ids, spans and decoded texts of a model file; texts are taken and spans given in UTF-8 bytes."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        parts = list(fields(data))
        trainer = {k: v for _, spec, _ in (p for p in parts if p[0] == 2) for k, v, _ in fields(spec)}
        pieces = [{k: v for k, v, _ in fields(p)} for n, p, _ in parts if n == 1]
        kinds = [p.get(3, 1) for p in pieces]
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or 4 in kinds or kinds.count(6) != 256:
            raise ValueError(f"{path}: not a model of byte pairs with byte fallback and blanks in front")
        self.normalise = Normaliser(b"".join(p for n, p, _ in parts if n == 3))
        #: Whether blanks can only begin a piece, so that texts can be cut in front of them.
        self.cut = not any(re.search(f"[^{BLANK}]{BLANK}", p[1].decode(errors="replace")) for p, kind in zip(pieces, kinds) if kind == 1)
        self.lengths = np.array([len(p[1]) for p in pieces], np.int32)
        self.bytes = {i: int(p[1][3:5], 16) for i, (p, kind) in enumerate(zip(pieces, kinds)) if kind == 6}
        plain = b"".join(own for n, _, own in parts if n != 3) + bytes([3 << 3 | 2, 6, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=plain)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes, self.first = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, stretches: list[str]) -> None:
        """Merge stretches that aren't known yet."""
        found = self.merges.encode(stretches, num_threads=1)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for own in found for i in own), np.int32, int(counts.sum()))
        sizes = self.lengths[ids]
        left = 0
        for k in np.flatnonzero(np.isin(ids, list(self.bytes))).tolist():
            if not left:
                lead = self.bytes[int(ids[k])]
                whole = left = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            left -= 1
            sizes[k] = 0 if left else whole
        for s in stretches:
            self.known[s] = len(self.known)
        self.ids, self.sizes = np.r_[self.ids, ids], np.r_[self.sizes, sizes]
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(counts)]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text."""
        normal = list(map(self.normalise, texts))
        stretches = [_STRETCH.findall(text.decode()) if self.cut else [text.decode()] * bool(text) for text, _ in normal]
        if len(self.known) > REMEMBERED:
            self._forget()
        new = {s for own in stretches for s in own if s not in self.known}
        self._learn(list(new))
        out = []
        for own, (_, place) in zip(stretches, normal):
            at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            counts = self.first[at + 1] - self.first[at]
            where = np.arange(int(counts.sum())) + np.repeat(self.first[at] - np.cumsum(counts) + counts, counts)
            end = np.cumsum(self.sizes[where])
            out.append((self.ids[where], place[end - self.sizes[where]], place[end]))
        if any(len(s) > LONGEST for s in new):  # long stretches hardly come again
            self._forget()
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, model: str | None = None, text: str = "text", with_decoded: bool = False) -> DataFrame:
    """doc_id, ids, starts and ends of each row, and decoded on demand."""
    path = model or model_path()
    docs = docs.select("doc_id", F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    numbers = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *numbers] + [T.StructField("decoded", T.StringType())] * with_decoded)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            before = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // TOGETHER
            edges = np.r_[0, np.flatnonzero(np.diff(before)) + 1, batch.num_rows][: batch.num_rows + 1]
            for a, b in zip(edges, edges[1:]):
                found = own.encode(batch.column("text").slice(a, b - a).to_pylist())
                offsets = np.r_[0, np.cumsum([len(ids) for ids, _, _ in found])].astype(np.int32)
                columns = [batch.column("doc_id").slice(a, b - a)]
                columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0), pa.int32())) for k in range(3)]
                columns += [pa.array([own.library.decode(ids.tolist()) for ids, _, _ in found], pa.string())] if with_decoded else []
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(encode, schema)


def decoded(rows: DataFrame, ids: str = "ids", model: str | None = None, name: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for; null ids give null."""
    path = model or model_path()
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path).library
        for batch in batches:
            texts = [None if x is None else own.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(decode, schema)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(read_table(spark, sf_dir, "documents"), with_decoded=True)
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
