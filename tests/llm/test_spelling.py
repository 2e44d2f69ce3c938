import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    """Every word compared with every other, from the definition."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 5 * n else None
        out[w] = [form, w, n, len(others), words[form] if form else None]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(x) for w, x in out.items()}


def got(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, word string, n int, form string, cell string")


def test_variants_of_made_texts(spark):
    rnd = random.Random(3)
    stems = ["station", "garden", "winter", "naïveté", "übergang", "schön×ste", "letter", "better", "setter"]
    words = []
    for stem in stems:
        words += [stem] * rnd.randint(5, 120)
        for _ in range(6):
            k, c = rnd.randrange(len(stem)), rnd.choice("aeéßz")
            words += [rnd.choice([stem[:k] + stem[k + 1 :], stem[:k] + c + stem[k:], stem[:k] + c + stem[k + 1 :]])] * rnd.randint(1, 22)
    rnd.shuffle(words)
    texts = [" ".join(w.upper() if rnd.random() < 0.2 and w.isascii() else w for w in words[k::40]) for k in range(40)]
    rows = [(k, t, "a", 1, "b", "c") for k, t in enumerate(texts)] + [(3, texts[3], None, None, None, None), (None, texts[5], "x", 1, None, None), (41, None, "x", 1, None, None), (42, "", "x", 1, None, None)]
    want = brute([r[:2] for r in rows])
    assert got(spelling.variants(frame(spark, rows).repartition(3))) == want
    assert any(f for f, *_ in want.values())


def test_chains_and_ties(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 700, "zzzzzz": 5, "zzzzzy": 30, "zzzzzx": 30, "qqqqqq": 5, "qqqqqqq": 24}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    rows = [(0, text, "", 0, "", "")]
    found = got(spelling.variants(frame(spark, rows)))
    assert found == brute([r[:2] for r in rows])
    assert found["aaaaaa"][:2] == ("aaaaab", "aaabbb") and found["zzzzzz"][0] == "zzzzzx" and found["qqqqqq"][0] is None


def test_lost_letters(spark):
    rows = [(k, "moonlight moonlights moonligh") for k in range(20_000)]
    want = brute(rows)
    assert any(len(w) == 8 and w != "moonligh" for w in want)
    assert got(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_no_words(spark):
    for rows in ([], [(1, None, "", 0, "", "")], [(1, "short are all", "", 0, "", "")]):
        assert spelling.variants(frame(spark, rows)).collect() == []


def test_very_long_words_and_texts(spark):
    a = "ab" * 3000
    rows = [(0, " ".join([a, a + "c"] * 5 + [a[:-1] + "z"] * 60 + ["x y"] * 50_000), "", 0, "", "")]
    assert got(spelling.variants(frame(spark, rows))) == brute([r[:2] for r in rows])


def test_small_blocks_find_the_same(spark, monkeypatch):
    rnd = random.Random(1)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.choice((6, 7, 8)))) for _ in range(900)}
    vocabulary = spark.createDataFrame([(w, rnd.randint(5, 90)) for w in sorted(words)], "word string, n long")
    n = {r["word"]: r["n"] for r in vocabulary.collect()}
    want = {}
    for w in words:
        others = [v for v in words if near(v, w)]
        if others:
            best = min(others, key=lambda v: (-n[v], v))
            want[w] = (len(others), best, n[best])
    for size in (4096, 7):
        monkeypatch.setattr(spelling, "BLOCK_WORDS", size)
        assert {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_words(vocabulary).collect()} == want


def test_squared_distances_bound_edits():
    words = ["".join(w) for w in itertools.product("abé", repeat=4)]
    longer = ["".join(w) for w in itertools.product("ab", repeat=5)]
    u, v = (np.array([list(w.encode("latin-1")) for w in x], np.uint8) for x in (words, longer))
    for a, b, wa, wb, own in ((u, u, words, words, True), (u, v, words, longer, False)):
        i, j = spelling.close_pairs(a, b, own)
        want = {(p, q) for p, x in enumerate(wa) for q, y in enumerate(wb) if near(x, y) and (not own or p < q)}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(spelling.variants(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", F.col("text")).collect()])
