"""SentencePiece encoding and spans against the library, with the model's own character map and with a real one."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from scenequery.llm import sentencepieces
from scenequery.llm.sentencepieces import CharacterMap, Encoder, Normaliser, decoded, encoded, fields, model_path

AWKWARD = ["", " ", "   ", "a", " a  b ", "▁", "a▁▁b ▁", "\x00\x01", "<s></s><unk><0x41>", "日本語 🧿🧿 é́ \U0001f469‍\U0001f4bb", "\t tab\n\n new \r\n", "ｶﾞ  Ａ①  x ", "​ ​ a ​", "x" * 5000, "ab " * 3000, " " * 3000, "Ünïcode ñandú ﬁ ﬂ ℌ ㍿ … ½", "�", "　a b­"]


@pytest.fixture(scope="module")
def folded_model(tmp_path_factory):
    """The model with the library's compatibility folding as its character map."""
    with open(model_path(), "rb") as f:
        parts = list(fields(f.read()))
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec()
    size = len(spec).to_bytes(4, "little")
    length = bytes([size[0] & 127 | 128, size[0] >> 7 | (size[1] & 63) << 1 | 128, size[1] >> 6 | (size[2] & 31) << 2])
    path = tmp_path_factory.mktemp("model") / "folded.model"
    path.write_bytes(b"".join(own for n, _, own in parts if n != 3) + bytes([3 << 3 | 2]) + length + spec)
    return str(path)


def expected(library, text):
    """ids and byte spans of a text by the library."""
    pieces = library.encode(text, return_type="proto").pieces
    return [p.id for p in pieces], [p.begin for p in pieces], [p.end for p in pieces]


def check(own, texts):
    for text, (ids, starts, ends) in zip(texts, own.encode([t.encode() for t in texts])):
        assert (ids.tolist(), starts.tolist(), ends.tolist()) == expected(own.library, text), text[:80]


@pytest.mark.parametrize("folded", [False, True])
def test_awkward_texts(folded, folded_model):
    own = Encoder(folded_model if folded else model_path())
    assert own.cut and own.normalise.rules.empty != folded
    check(own, AWKWARD)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ▁aA①ｶﾞé́​ "), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=4))
def test_random_texts(folded_model, texts):
    check(sentencepieces.encoder(model_path()), texts)
    check(_folded(folded_model), texts)


def _folded(path, known={}):  # noqa: B006
    return known.setdefault(path, Encoder(path))


def test_forgetting(monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 3)
    own = Encoder(model_path())
    for text in AWKWARD * 2:
        check(own, [text, "some further words " + text])


def test_normaliser_as_the_library():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    own = Normaliser(library.serialized_normalizer_spec())
    for text in AWKWARD:
        normal, offsets = library.normalize(text, with_offsets=True)
        got, places = own(text.encode())
        before = np.cumsum([0, *[len(c.encode()) for c in text]])
        at = np.cumsum([0, *[len(c.encode()) for c in normal]])
        assert got.decode() == normal and [int(before[o]) for o in offsets] == places[at].tolist(), text[:80]


def test_longest_rule():
    rules = CharacterMap(next(v for k, v, _ in fields(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_normalizer_spec()) if k == 2))
    text = "ｶﾞｶ".encode()
    assert rules.longest(text, 0) == (6, "ガ".encode()) and rules.longest(text, 6) == (3, "カ".encode()) and rules.longest(b"zz", 0) is None
    assert CharacterMap(b"").empty


def test_broken_bytes():
    own = Encoder(model_path())
    for data in (b"\xff", b"a\xe2\x80 b", b"\xed\xa0\x80", b"\xf0\x9f\xa7\xbf\xf0\x9f", b"\xc0\x80x\x80"):
        ids, starts, ends = own.encode([data])[0]
        assert ids.tolist() == own.library.encode(data)
        assert starts[0] == 0 and ends[-1] == len(data) and (starts[1:] >= starts[:-1]).all()


def test_other_models_are_an_error(tmp_path):
    with open(model_path(), "rb") as f:
        data = f.read()
    (tmp_path / "m").write_bytes(data + bytes([2 << 3 | 2, 2, 3 << 3, 1]))  # says that it is a unigram model
    with pytest.raises(ValueError, match="byte pairs"):
        Encoder(str(tmp_path / "m"))


def test_rows(spark):
    """Awkward rows: nulls, repeats, long texts, clashing columns, broken bytes, no rows."""
    long = "word " * 200_000 + "日本" * 20_000
    rows = [(1, None), (2, ""), (3, long), (4, "a b"), (4, "a b"), (None, "c"), *enumerate(AWKWARD)]
    table = spark.createDataFrame([(i, t, [1], 2, 3, "x") for i, t in rows], "doc_id long, text string, ids array<int>, starts int, ends int, decoded string")
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    got = encoded(table, with_decoded=True)
    assert got.columns == ["doc_id", "ids", "starts", "ends", "decoded"]
    key = lambda r: (str(r[0]), r[1], r[2], r[3], r[4])
    full = [(i, *expected(library, t or ""), library.decode(library.encode(t or ""))) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(full, key=key)
    assert encoded(table.limit(0)).count() == 0
    again = decoded(encoded(table), name="again").collect()
    assert sorted((str(r[0]), r["again"]) for r in again) == sorted((str(f[0]), f[4]) for f in full)
    assert [r[0] for r in decoded(spark.createDataFrame([(None,)], "ids array<int>"), name="t").select("t").collect()] == [None]


def test_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    ids = [(i, library.encode(t or "")) for i, t in texts]
    want = {(i, len(own), sha(",".join(map(str, own))), sha(library.decode(own))) for i, own in ids}
    assert {tuple(r) for r in sentencepieces.op11_sentencepiece(spark, DATA).collect()} == want and len(want) == len(texts)
