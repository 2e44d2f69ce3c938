import random

import numpy as np
import public_tokenizers

import corpus_pipeline
from tidemark.llm import byte_bpe, pii, quality
from tests.llm.test_decontamination import brute_force
from tests.llm.test_quality import corpus
from tests.llm.test_simhash import components, plain


def write(spark, path, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    base = corpus(300)
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k, t, l, s, len(t)) for k, t, l, s, _ in base]
    for k in range(60):
        words = rows[k][1].split()
        if k % 3 == 0:
            words[rng.randrange(len(words))] = "swap"
        if k % 3 == 1:
            words += item.split()
        if k % 3 == 2:
            words.insert(0, "mail me: some.body@example.org or 4111 1111 1111 1111 now")
        rows.append((1000 + k, " ".join(words), "en", "src0", 9))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    labels = [(r[0], r[4], 0) for r in base if r[0] % 3]
    path = write(spark, str(tmp_path), rows, labels, [(1, item)])
    docs, marks = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    good = {r.doc_id for r in quality.report(docs, marks, hold_out=False).filter("kept").collect()}
    left = sorted(r for r in rows if r[0] in good)
    names = components([plain(r[1] or "") for r in left], [r[0] for r in left], 4)
    left = [r for r, name in zip(left, names, strict=True) if r[0] == name]
    left = [r for r in left if not brute_force(r[1], [(1, item)])[1]]
    enc = byte_bpe.rank_encoding(public_tokenizers.path(corpus_pipeline.RANKS), public_tokenizers.PATTERN)
    want = {r[0]: enc.encode_ordinary(pii.masked(r[1] or "")) for r in left}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in corpus_pipeline.run(spark, path).collect()}
    assert got == want and len(good) > 200 and len(want) < len(good)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    path = write(spark, str(tmp_path), [], [], [])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.count() == 0
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
    some = spark.createDataFrame([(1, "a@b.cd", "en", "s", 6, "x")], "doc_id long, text string, lang string, source string, n_chars long, hits string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        some = stage(spark, some, path)
    assert [tuple(r) for r in some.collect()] == [(1, "[EMAIL]", "en", "s", 7, "x")]
