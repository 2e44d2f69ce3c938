import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import toxicity as T


def all_segments(s):
    """Maximal-scoring segments by definition: take the best one, then those on either side."""
    best = (0, None)
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            total = sum(s[i:j])
            if total > best[0] or (best[1] and total == best[0] and (j - i) < best[1][1] - best[1][0]):
                best = (total, (i, j))
    if not best[1]:
        return []
    i, j = best[1]
    return [(x, a, b) for x, a, b in all_segments(s[:i])] + [(best[0], i, j)] + [(x, a + j, b + j) for x, a, b in all_segments(s[j:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=14))
def test_segments_cover_what_the_definition_finds(s):
    got = T.segments(np.array(s, float))
    assert all(a < b and sum(s[a:b]) == x and x > 0 for x, a, b in got)
    assert all(got[k][2] <= got[k + 1][1] for k in range(len(got) - 1))
    assert sorted(x for x, _, _ in got) == sorted(x for x, _, _ in all_segments(s)) or sum(v == 0 for v in s) or len(set(np.cumsum([0, *s]).tolist())) <= len(s)
    assert max((x for x, _, _ in got), default=0) == max((x for x, _, _ in all_segments(s)), default=0)


def test_segments_without_ties_are_those_of_the_definition():
    """Scores of which no two sums are equal leave one answer: the same segments, with the same places."""
    rng = random.Random(11)
    for n in (0, 1, 2, 5, 12, 30, 45):
        for _ in range(15):
            s = [rng.gauss(-0.2, 1) for _ in range(n)]
            want, got = all_segments(s), T.segments(np.array(s, float))
            assert [x[1:] for x in got] == [x[1:] for x in want] and np.allclose([x[0] for x in got], [x[0] for x in want])


def plain_log_odds(table, docs, cells, without=None):
    """A word's log-odds level by level: a level's rate of toxic documents is pulled to that of the level before it."""
    totals = [max(1, docs[c] - (1 if without == c else 0)) for c in (0, 1)]
    rate = 0.5
    for cell in cells:
        share = [max(0, table[c][cell] - (1 if without == c else 0)) / totals[c] * min(totals) for c in (0, 1)]
        rate = (share[1] + T.PRIOR * rate) / (share[0] + share[1] + T.PRIOR)
    return np.log(rate / (1 - rate))


def test_log_odds_by_a_plain_version():
    rng = np.random.default_rng(4)
    docs = np.array([90, 12])
    table = np.stack([rng.integers(0, 91, 50), rng.integers(0, 13, 50)])
    model = T.Model(table, docs)
    cells = rng.integers(0, 50, (40, 3))
    for without in (None, 0, 1):
        assert np.allclose(model.log_odds(cells, without), [plain_log_odds(table, docs, row, without) for row in cells])
    unseen = T.Model(np.zeros((2, 50), int), docs)
    assert np.allclose(unseen.log_odds(cells), 0)


def test_a_text_is_scored_as_a_plain_version_scores_it():
    """Word scores, segments, surprise and the logistic function, each written out."""
    rng = np.random.default_rng(8)
    size = max(max(T._cells(w)) for w in ("river", "stone", "grobax", "light")) + 1
    model = T.Model(rng.integers(0, 20, (2, size)), np.array([60, 20]), lam=0.9, k=0.2, weights=(-3.0, 0.4, 0.7))
    for text in ("", "river", "river stone grobax light grobax grobax river", "light " * 30 + "grobax stone"):
        words = T.words_of(text)
        scores = [plain_log_odds(model.table, model.docs, T._cells(w)) - T.DRIFT for w in words]
        surprises = [-np.log(1 - np.exp(-model.k * max(len(words), 1) * np.exp(-model.lam * x))) for x, _, _ in all_segments(scores)]
        best = min(max(surprises, default=0.0), 60.0)
        many = np.log(1 + sum(x >= -np.log(T.SIGNIFICANT) for x in surprises))
        want = 1 / (1 + np.exp(-(model.weights[0] + model.weights[1] * best + model.weights[2] * many)))
        assert abs(T.Scorer(model).judge(text)[0] - want) < 1e-9


def test_logistic_weights_leave_no_slope():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + rng.normal(size=300) > 0.3).astype(float)
    w = T.logistic(x, y)
    slope = [sum((1 / (1 + np.exp(-(w[0] + w[1] * a + w[2] * b))) - t) * z[k] for a, b, t in zip(*x.T, y, strict=True) for z in [(1, a, b)]) / 300 + 1e-3 * w[k] for k in range(3)]
    assert np.allclose(slope, 0, atol=1e-7)


def corpus(n=600):
    rng = random.Random(4)
    calm = ["river", "stone", "green", "walks", "under", "light", "paper", "seven", "about", "music"]
    bad = ["grobax", "grobil", "vexmor"]
    rows = []
    for k in range(n):
        words = [rng.choice(calm) for _ in range(rng.randint(3, 200))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            at = rng.randrange(len(words) + 1)
            words[at:at] = [rng.choice(bad), rng.choice(calm), rng.choice(bad)]
        rows.append((k, " ".join(words), toxic))
    return rows


def test_held_out_documents(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 7.5, 1) for k, t, _ in rows] + [(9000, None, 0.0, 0), (9001, "", 0.0, 0), (9002, "river " * 60000 + "grobax vexmor grobil", 0.0, 0), (3, rows[3][1], 1.0, 1), (None, "river", 0.0, 0), (9003, "river grobzz stone grobyy", 0.0, 0)], "doc_id long, text string, score double, toxic int")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(None, 1, 1), (5, 1, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.report(docs, labels).collect()}
    assert len(got) == len(rows) + 5
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items() if k is not None) and not got[None].held_out
    held = [(got[k].predicted, y) for k, _, y in rows if got[k].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert got[9000].predicted == 0 and got[9000].score == got[9001].score and got[9002].predicted == 1 and got[9003].score > 0.2
    assert all(0 <= r.score <= 1 for r in got.values())
    swapped = labels.replace({0: 1, 1: 0}, subset=["toxic"]).filter(T.held_out(labels["doc_id"]))
    again = {r.doc_id: r.score for r in T.report(docs, labels.filter(~T.held_out(labels["doc_id"])).unionByName(swapped)).collect()}
    assert again == {k: r.score for k, r in got.items()}


def test_passages_and_empty_tables(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.train(docs, docs.select("doc_id", "toxic"))
    one = T.score(spark.createDataFrame([(1, "river stone " * 30 + "grobax grobil vexmor " + "green light " * 30)], "doc_id long, text string"), model).first()
    assert len(one.passages) == 1 and (one.passages[0]["first"], one.passages[0]["stop"]) == (60, 63)
    assert T.score(docs.limit(0), model).count() == 0
    none = T.train(docs.limit(0), docs.select("doc_id", "toxic").limit(0))
    assert {r.score for r in T.score(docs.limit(5), none).collect()} == {0.5}
