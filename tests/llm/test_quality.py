import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality as Q


def corpus(n=500):
    rng = random.Random(8)
    vocab = ["river", "stone", "green", "walks", "Under", "light", "paper,", "seven.", "about", "music", "of", "a"]
    rows = []
    for k in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 300))]
        good = int(rng.random() > 0.25)
        if not good:
            at = rng.randrange(len(words))
            junk = words[at : at + 40] or ["x"]
            kind = rng.randrange(3)
            words[at : at + 40] = [w.upper() + "!!" for w in junk] if kind == 0 else [w + " |" for w in junk] if kind == 1 else [junk[0]] * 40
        rows.append((k, " ".join(words), rng.choice(["en", "de", None]), f"src{k % 3}", good))
    return rows


def test_held_out_accuracy_and_filter(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, l, s, len(t), 0.5) for k, t, l, s, _ in rows] + [(900, None, None, None, None, None), (901, "", "en", "src1", 0, 1.0), (3, rows[3][1], "en", "src0", 5, 1.0), (902, "river stone green " * 20000, "en", "src0", None, 0.0), (None, "walks under light", "en", "src0", 3, 0.0)], "doc_id long, text string, lang string, source string, n_chars long, score double")
    fit = [r for r in rows if r[0] % 5]
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in fit] + [(None, 1, 0), (1, None, 0), (88888, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.report(docs, labels, hold_out=False).collect()}
    assert len(got) == len(rows) + 4
    assert np.mean([got[r[0]].kept == bool(r[4]) for r in rows if r[0] % 5 == 0]) > 0.9
    assert all(0 <= r.score <= 1 and 0 <= r.text_view <= 1 and 0 <= r.meta_view <= 1 for r in got.values())
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.kept) for r in Q.report(docs, labels).collect()} == {(0.5, True)}
    assert Q.report(docs.limit(0), labels).count() == 0 and Q.keep_good(docs, labels).count() == 2


def test_features_are_finite_for_any_text():
    for text in ("", " ", "\n\n", "a", "a b", "x" * 10000, "é é é", " a b", "A!! B!!", "a b " * 5000):
        f = Q.text_features(text)
        assert f.shape == (Q.TEXT_FEATURES,) and np.isfinite(f).all()


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    n = 2000
    y = (rng.random(n) < 0.6).astype(float)
    text = rng.normal(size=(n, Q.TEXT_FEATURES))
    text[:, 3] += 3 * y
    meta = np.c_[np.where(rng.random(n) < 0.9, y, 1 - y), rng.integers(0, 3, n), rng.integers(0, 3, n)].astype(int)
    seen = np.where(rng.random(n) < 0.1, y, np.nan)
    model = Q.co_train(text, meta, seen, rng.random(n) < 0.3)
    assert ((model.chance(text, meta) >= 0.5) == y).mean() > 0.9  # what the metadata alone can give


def test_every_unlabelled_document_is_in_the_pool(spark, monkeypatch):
    monkeypatch.setattr(Q, "STEPS", 2)
    rows = corpus(300)
    n = 10_700
    docs = spark.createDataFrame([(k, t, l, s, len(t)) for k, t, l, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    many = spark.range(1000, 1000 + n).selectExpr("id as doc_id", "'stone river a' as text", "'rare' as lang", "'src9' as source", "13L as n_chars")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:200]], "doc_id long, quality int")
    seen = []
    real = Q.Pool.histograms

    def watched(self, views, lessons):
        out = real(self, views, lessons)
        seen.append(out.reshape(2, -1).sum(axis=1))
        return out

    monkeypatch.setattr(Q.Pool, "histograms", watched)
    model = Q.train(docs.unionAll(many), labels)
    assert len(seen) == Q.ROUNDS and (seen[0] == n + 100).all()
    assert np.isfinite(model.weights).all()
    # most of all documents have three words: the edges of the number of words are the whole table's
    assert (model.text.edges[14] <= np.log1p(3)).any()


def test_spark_and_memory_train_the_same_model(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(k, t, l, s, len(t)) for k, t, l, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows[:150]], "doc_id long, quality int")
    model = Q.train(docs, labels)
    test = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0).select("doc_id").collect()}
    fitted = [r for r in rows[:150] if r[0] not in test]
    words = Q.Words()
    for _, text, _, _, good in fitted:
        for cell in {int(c) for part in Q.word_cells(text.split()) for c in part}:
            words.counts[good, cell] += 1
        words.docs[good] += 1
    assert (words.counts == model.words.counts).all() and (words.docs == model.words.docs).all()
    text = np.array([Q.text_features(r[1], words, r[4] if r[0] < 150 and r[0] not in test else None) for r in rows])
    meta = np.array([Q.meta_features(r[2], r[3], len(r[1])) for r in rows])
    y = np.array([float(r[4]) if r[0] < 150 else np.nan for r in rows])
    order = np.lexsort((*text.T, *meta.T, y))
    want = Q.co_train(text[order], meta[order], y[order], np.array([rows[k][0] in test for k in order]), edges=model.text.edges)
    assert np.allclose(want.chance(text, meta), model.chance(text, meta), atol=1e-6)


def test_pseudo_labels_are_the_surest_scores():
    rng = np.random.default_rng(2)
    for take in (1, 7, 60, 5000):
        z = np.repeat(rng.normal(size=200) * 4, rng.integers(1, 4, 200))
        limit = Q._limit(np.bincount(Q._cell(z), minlength=Q.SCORE_CELLS).astype(float), take, 2.0)
        chosen = sorted(z[z >= limit])
        best = sorted(z, reverse=True)
        want = [x for x in best if x >= 2.0 and x >= best[min(take, len(best)) - 1] - 0.02]  # a cell is 0.01 wide; ties go together
        assert min(take, sum(z >= 2.0)) <= len(chosen) <= len(want) and (not chosen or chosen[0] >= 2.0)


def test_a_documents_own_words_are_left_out():
    words = Q.Words()
    single, pairs = Q.word_cells(["secret", "word"])
    words.counts[0, np.concatenate([single, pairs])] += 1
    words.docs[:] = (1, 1)
    assert (words.of(single, 0) == 0).all() and (words.of(single) < 0).all()
    assert Q.text_features("secret word", words)[-2] < 0 == Q.text_features("secret word", words, 0)[-2]


def test_held_out_labels_are_not_used(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(k, t, l, s, len(t)) for k, t, l, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows], "doc_id long, quality int")
    found = Q.report(docs, labels)
    got = {r.doc_id: r.score for r in found.collect()}
    turned = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in Q.report(docs, turned).collect()} == got
    right = {r.quality: (r.n, r.right) for r in Q.recalls(found, labels).collect()}
    assert sum(n for n, _ in right.values()) == sum(zlib.crc32(str(k).encode()) % 5 == 0 for k, *_ in rows)
    assert all(k >= 0.8 * n for n, k in right.values())


def test_the_corpus_may_have_any_names(spark):
    """A corpus that an earlier run left with names of the operator's own keeps its rows and columns."""
    rows = [(k, f"plain words of text {k} and more of them" if k % 2 else "!!! $$$ ???", k, [k], "s", 0.5, None) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __t long, __m array<long>, __text string, __score double, __fitted boolean")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = Q.keep_good(df, labels)
    assert got.columns == df.columns
    kept = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert kept and all(kept[k] == (rows[k][0], rows[k][1], k, [k], "s", 0.5, None) for k in kept) and all(k % 2 for k in kept)
