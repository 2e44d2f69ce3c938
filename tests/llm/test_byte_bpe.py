import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ENC = B.rank_encoding(PATH, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab' 's1.\n\té😀\x1c　-")), max_size=80), st.integers(1, 9))
def test_parts_have_the_ids_of_the_whole(text, size):
    cut = list(B.parts(text, size))
    assert "".join(cut) == text
    assert [i for x in cut for i in ENC.encode_ordinary(x)] == ENC.encode_ordinary(text)


def test_other_patterns_are_not_cut():
    assert B.SPLIT_PATTERN == PATTERN
    breaks = r" ?[^\s\p{L}\p{N}]+[\r\n]*|\p{L}+|\s+"  # a match goes from signs on to line breaks
    encoding = B.rank_encoding(PATH, breaks)
    text = "wort!!\n\n" * 40_000
    assert B.encode_text(encoding, text).tolist() == encoding.encode_ordinary(text)
    signs = "a!\x1c\x1d b\x85c" * 30_000  # U+001C and its like are no white space for the library
    assert B.encode_text(ENC, signs).tolist() == ENC.encode_ordinary(signs)


def test_round_trip(spark):
    texts = ["", None, "a  b\n\nc", "<|endoftext|> x", "word été 😀 " * 30000, "x" * 200000, "same", "same"]
    df = spark.createDataFrame([(k, t, b"z") for k, t in enumerate(texts)] + [(None, "q", b"")], "doc_id long, text string, ids binary")
    got = {r.doc_id: r for r in B.round_trip(df, PATH, PATTERN).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        ids = ENC.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert B.round_trip(df.limit(0), PATH, PATTERN).count() == 0
