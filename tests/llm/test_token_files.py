import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [
    "", " ", "a", " a b", "a  b", "a \n b\nc ", "\n\n x", "it's  we'll 12 ab!! <|endoftext|> 😀 é x  y", "word " * 3000, "x" * 20000,
    "\x1c a \x1d\x1e b\x85c", "tab\tx\t y", "a　 b", "  lead and trail  ", "don't stop 3.14 ... !?",
]


def test_piece_encoder_equals_the_library(library):
    enc = T.PieceEncoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(TEXTS)] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert enc.by_piece


def test_special_tokens_are_the_librarys_unless_they_are_text(library):
    text = "a <|endoftext|> b"
    assert np.frombuffer(T.PieceEncoder(PATH).encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids == [64, 220, 50256, 275]
    as_text = Tokenizer.from_file(PATH)
    as_text.encode_special_tokens = True
    got = np.frombuffer(T.PieceEncoder(PATH, special=False).encode([text])[0], "<u4").tolist()
    assert got == as_text.encode(text, add_special_tokens=False).ids and 50256 not in got


ENC = T.PieceEncoder(PATH)
LIB = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab' 's1.,,!|\n\té😀  \x1c ", "<|endoftext|>"]), max_size=30).map("".join), min_size=1, max_size=4))
def test_piece_encoder_of_any_texts(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ENC.encode(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aé×÷ǁ東\u00a0\u0085\u2003\u3000\u1680\u200b\x1c .,;|'s1\n\t", "<|endoftext|>", None]), max_size=12).map(lambda x: None if None in x[:1] else "".join(c or "" for c in x)), min_size=1, max_size=5))
def test_piece_encoder_of_columns_with_other_white_space(texts):
    column = pa.array(["before ", *texts, None, " after"])[1:-1]
    assert [np.frombuffer(x, "<u4").tolist() for x in ENC.encode_column(column)] == [LIB.encode(t or "", add_special_tokens=False).ids for t in [*texts, None]]


def test_words_that_meet_other_punctuation_or_a_line_end_are_encoded_once(monkeypatch):
    enc, words = T.PieceEncoder(PATH), ["thonre", "oftionn", "énatha"]
    enc.encode(["".join(f"{lead}{w}" for lead in " \n" for w in words)])
    seen = []
    monkeypatch.setattr(T.PieceEncoder, "learn", lambda self, new, learn=T.PieceEncoder.learn: (seen.extend(new), learn(self, new)))
    text = "".join(f"{lead}{w}{mark}" for lead in " \n" for w in words for mark in (".", ",", "!?", "|", ";", ":"))
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids
    assert len(seen) <= 9 and not any(w.encode() in x for x in seen for w in words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=200), st.sampled_from([1, 7, 64, 1024]), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_packing_round_trip(ids, block, share):
    v = np.array(ids, np.uint32)
    data, starts = T.pack(v, block, share)
    assert np.array_equal(T.unpack(data, starts, len(v), block), v)


def test_file_gives_any_range():
    rng = np.random.default_rng(0)
    ids = np.where(rng.random(5000) < 0.02, rng.integers(0, 2**32, 5000), rng.integers(100, 900, 5000)).astype(np.uint32)
    lengths = np.array([1, 4000, 999])
    f = T.TokenFile(T.file_bytes(ids, np.array([3, -1, 8]), lengths))
    assert f.doc_ids.tolist() == [3, -1, 8] and f.lengths.tolist() == lengths.tolist()
    for a, b in ((0, 5000), (0, 1), (1023, 1025), (4999, 5000), (2048, 2048), (17, 4001)):
        assert np.array_equal(f.ids(a, b), ids[a:b])
    assert len(T.file_bytes(ids, np.array([1]), np.array([5000]))) < 4 * 5000
    with pytest.raises(ValueError):
        T.TokenFile(T.file_bytes(ids, np.array([1]), np.array([5000]))[:-4] + b"xxxx")


def test_store_and_read_back(spark, library, monkeypatch):
    rows = [(k * 3 % 41, t) for k, t in enumerate(TEXTS)] + [(500, None), (-4, "first of all"), (None, "no id"), (3, "a twin")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int")
    want, start = [], 0
    for a, b in sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], (r[1] or "").encode())):
        ids = np.array([*library.encode(b or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((a, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in T.stored(df, PATH).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert T.stored(df.limit(0), PATH).count() == 0
