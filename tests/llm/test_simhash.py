import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash


def plain(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, ids, most):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[top(i)] = top(j)
    low = {}
    for i in range(len(fps)):
        low[top(i)] = min(low.get(top(i), ids[i]), ids[i])
    return [low[top(i)] for i in range(len(fps))]


def texts():
    rng = random.Random(3)
    vocab = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "theta", "iota"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    near = []
    for t in base[:30]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append("  ".join(w))
    return [*base, *near, *base[:10], "", " \t\n", None, "one", "x y z", "long word " * 5000, "long word " * 4999 + "end"]


def test_fingerprint_and_components_match_brute_force(spark):
    rows = list(enumerate(texts()))
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i * 7, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [plain(t or "") for _, t in rows]
    assert [got[i * 7][0] % (1 << 64) for i, _ in rows] == fps
    assert [got[i * 7][1] for i, _ in rows] == components(fps, [i * 7 for i, _ in rows], 4)


def test_links_of_crowded_cells_and_every_group_count(spark, monkeypatch):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for s in seeds for _ in range(12)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = components(fps, fps, 4)
    for groups, rows in ((5, 2048), (6, 2048), (5, 3)):
        monkeypatch.setattr(simhash, "groups_for", lambda n, most=4, g=groups: g)
        monkeypatch.setattr(simhash, "BLOCK_ROWS", rows)
        forest = {r.node % (1 << 64): r.component % (1 << 64) for r in simhash.connected_components(simhash.fingerprint_links(df)).collect()}
        named = [forest.get(f, f) for f in fps]
        assert [[a == b for b in named] for a in named] == [[a == b for b in want] for a in want]


def test_groups_grow_with_the_input():
    assert [simhash.groups_for(n) for n in (0, 1000, 10**6, 10**8)] == [5, 5, 6, 8]
    assert simhash.groups_for(10**9) == 9 and simhash.groups_for(10**11) > 9  # no end to the growth


def test_empty_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame([(5, "same text here now"), (5, "same text here now"), (9, "same text here now"), (None, "same text here now"), (7, "other")], "doc_id long, text string")
    found = simhash.near_duplicates(docs)
    assert sorted((r.doc_id or -1, r.component_id) for r in found.collect()) == [(-1, 5), (5, 5), (5, 5), (7, 7), (9, 5)]
    kept = simhash.keep_first(docs, found)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 5, 7]


def test_long_chain_is_one_component(spark):
    links = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = simhash.connected_components(links).collect()
    assert len(got) == 399 and {r.component for r in got} == {0}


def test_manhattan_distance_is_a_bound_that_prunes():
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:100]]
    counts = [[(f >> s & 1) + (f >> s + 1 & 1) for s in range(0, 64, 2)] for f in fps]
    codes = simhash.embedded(np.array(fps, np.uint64)).tolist()
    pruned = 0
    for i in range(0, len(fps), 3):
        for j in range(len(fps)):
            manhattan, hamming = sum(abs(a - b) for a, b in zip(counts[i], counts[j], strict=True)), (fps[i] ^ fps[j]).bit_count()
            assert (codes[i] ^ codes[j]).bit_count() == manhattan <= hamming
            pruned += abs(fps[i].bit_count() - fps[j].bit_count()) <= 4 < manhattan
    assert pruned > 10_000  # pairs in the range of set bits that never come to the exact comparison


def test_convergence_of_large_hashes(spark):
    n = 300_000  # a sum of their 63-bit hashes would overflow a long many times over
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 10).alias("b"))
    got = simhash.connected_components(links)
    assert got.count() == n - n // 10 and got.filter("component != node - node % 10").count() == 0


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(5, "b text of some words", 1), (5, "a text of other words", 2), (8, None, 3), (8, "b text of some words", 4)], "doc_id long, text string, __id int")
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(5, "a text of other words", 2), (8, None, 3)]
