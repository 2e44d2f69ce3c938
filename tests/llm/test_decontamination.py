import random
import re
import tracemalloc

import pytest

from tidemark.llm import decontamination as D
from tidemark.llm.sql import SQL


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_force(text, items, length=10):
    """n_words, n_hit and sorted items of one text, window by window; items without an id hit, but aren't listed."""
    words = plain_words(text)
    hit, found = [False] * len(words), set()
    for item, item_text in items:
        own = plain_words(item_text)
        size = min(length, len(own))
        for k in range(len(own) - size + 1) if own else ():
            for at in range(len(words) - size + 1):
                if words[at] == own[k] and words[at : at + size] == own[k : k + size]:
                    hit[at : at + size] = [True] * size
                    found |= set() if item is None else {str(item)}
    return len(words), sum(hit), sorted(found)


def fixture():
    rng = random.Random(2)
    vocab = ["the", "of", "Ab9", "été", "x", "y", "z1"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([25, 12, 10, 9, 4, 2, 1, 0, 30])]
    items[6] = (6, "unique!")
    items += [(20, None), (None, "lost item with no id at all but with more than ten words inside"), (3, items[3][1])]
    docs = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40))) for _ in range(40)]
    docs += [f"start, {t.upper() if t else ''} -- end" for _, t in items]
    docs += [None, "", "UNIQUE", "-unique-x", items[0][1][:60], "pad " * 30000 + items[0][1] + " pad" * 10, items[8][1] + " " + items[8][1], items[10][1]]
    return [(k, t) for k, t in enumerate(docs)], items


@pytest.mark.parametrize("piece", [D.PIECE_WORDS, 3])
def test_matches_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(D, "PIECE_WORDS", piece)
    docs, items = fixture()
    df = spark.createDataFrame([(a, b, [1], "n") for a, b in docs], "doc_id long, text string, hits array<int>, n_words string")
    bench = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    want = {a: brute_force(b, items) for a, b in docs}
    for limit in (1 << 20, 40):
        got = {r.doc_id: r for r in D.contamination(df, bench, limit=limit).collect()}
        assert {k: (r.n_words, sum(b - a for a, b in r.hits), r["items"]) for k, r in got.items()} == want
    out = {r.doc_id: r for r in D.report(df, bench).collect()}
    assert {k: r.n_hit for k, r in out.items()} == {k: v[1] for k, v in want.items()}
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[1]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.report(none, items).count() == 0
    some = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in D.report(some, items).collect()] == [(3, 0, False)] * 2


def test_windows_overlap_and_repeat():
    text = "a b " * 30
    assert brute_force(text, [(1, "a b " * 6)]) == (60, 60, ["1"])
    m = [D.WuManber(w, n) for n, w in D.windows_of([("1", "a b " * 6)]).items()]
    assert D.scan(D.words_of(text), m) == ([[0, 60]], {"1"})


def test_items_without_an_id_hit(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    df = spark.createDataFrame([(1, f"start {passage} end"), (2, "start one two three end"), (3, "short thing")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (None, "Short"), (7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in D.report(df, bench).collect()}
    assert got == {1: (13, 11, 1, True), 2: (5, 0, 0, False), 3: (2, 1, 0, True)}
    assert [r.doc_id for r in D.clean(df, bench).collect()] == [2]
    con = pytest.importorskip("duckdb").connect()
    for name, frame in (("documents", df), ("benchmark", bench)):
        con.register(name, frame.toArrow())
    assert {r[0]: (r[1], r[2], r[3], r[5]) for r in con.execute(SQL["op3_decontamination"]).fetchall()} == got


def test_a_full_lot_is_bounded_in_memory():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(60_000)}" for _ in range(50_000))
    tracemalloc.start()
    matchers = [D.WuManber(w, n) for n, w in D.windows_of([("1", text)]).items()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(matchers) == 1 and peak < 800 * 50_000  # bytes a window


def test_repeated_items_are_one_piece(spark):
    text = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(7, text)] * 3000 + [(None, text)] * 3000 + [(k, text) for k in range(100, 150)], "item_id long, text string")
    lots = D._lots(bench, 10, 1000)
    sizes = [len(lot()) for lot in lots]
    assert sum(sizes) == 52 and max(sizes) < 52
    docs = spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string")
    for limit in (1 << 20, 300):
        got = {r.doc_id: r for r in D.contamination(docs, bench, limit=limit).collect()}
        assert got[1]["items"] == sorted([str(k) for k in [7, *range(100, 150)]]) and got[2]["items"] == []
    many = D.windows_of([(k, text) for k in range(20_000)])
    assert all(len(ids) == 20_000 for ids in many[10].values())


def test_the_corpus_may_have_any_names(spark):
    names = ["doc_id", "text", "__text", "__hits", "__items", "__n", "row", "hits", "items", "n_words", "a.b"]
    rows = [(1, "one two three", "x", "h", "i", 3, "r", 1, 2, 3, "d"), (2, "four five", None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string, __hits string, __items string, __n long, row string, hits int, items int, n_words int, `a.b` string")
    bench = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    for limit in (1 << 20, 1):
        got = D.clean(df, bench, limit=limit)
        assert got.columns == names and [tuple(r) for r in got.collect()] == rows[1:]
