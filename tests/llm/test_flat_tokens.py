import os

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import flat_tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_lengths_match_a_plain_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = {}
    for width in (2, 4):
        for k, n in enumerate((0, 1, 3000, 5000, 900)):
            ids = np.where(rng.random(n) < (0.3 if k == 3 else 0.004), 7, rng.integers(8, 60000, n))
            if k == 4:
                ids[ids == 7] = 9
            if k == 2 and n:
                ids[-1] = 7
            os.makedirs(tmp_path / str(width), exist_ok=True)
            p = tmp_path / str(width) / f"f{k}"
            ids.astype(f"<u{width}").tofile(p)
            docs, now = [], 0
            for x in ids:
                if x == 7:
                    docs.append((now, True))
                    now = 0
                else:
                    now += 1
            want[width, f"f{k}"] = docs + ([(now, False)] if now else [])
        files = T.list_files(spark, f"file://{tmp_path}/{width}")
        for block in (width * 64, 1 << 20):
            got = {}
            for r in T.document_lengths(files, 7, width, block).orderBy("ordinal").collect():
                got.setdefault((width, r.path.split("/")[-1]), []).append((r.n_tokens, r.ended))
            assert got == {k: v for k, v in want.items() if k[0] == width and v}


def test_counts_of_documents(spark, tmp_path):
    lib = Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    texts = ["", None, "a b c", "word " * 4000, "<|endoftext|> is text", "a b c", "é\n\n x  y"]
    df = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)] + [(2, "a b c", 5), (None, "x", 5)], "doc_id long, text string, n_tokens int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in T.token_counts(df, PATH).collect())
    assert got == sorted([(k, len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t in enumerate(texts)] + [(2, 3), (-1, 1)])
    assert T.token_counts(df.limit(0), PATH).count() == 0
    with pytest.raises(Exception, match="whole number"):
        (tmp_path / "odd").write_bytes(b"abc")
        T.document_lengths(T.list_files(spark, f"file://{tmp_path}/odd"), 7, 2).collect()
