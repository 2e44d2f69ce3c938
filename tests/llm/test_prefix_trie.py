import hashlib
import os
import random
import zlib

import pytest

from tidemark.llm import prefix_trie

SF = "/root/testdata/sf0.001"
KINDS = "conv_id long, turn long, role string, text string, depth string, node string, c string"


def brute(rows):
    """The trie from its definition: all prefixes of all rebuilt conversations, by their whole contents."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for prefix, who in members.items():
        under = [p for p in members if p[: len(prefix)] == prefix]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        children = sum(len(p) == len(prefix) + 1 for p in under)
        ends = ",".join(str(c) for c in sorted(who) if len(built[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(who), len(prefix), parent, len(who), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted((tuple(r) for r in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], KINDS)


def talk(rnd, convs, turns, words):
    return [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(words)) for c in range(convs) for t in range(rnd.randint(1, turns))]


@pytest.mark.parametrize("block", [1, 3, 4, 16])
def test_made_conversations(spark, block):
    rnd = random.Random(5)
    rows = talk(rnd, 60, 14, ["a", "é", "b b"])
    rows += [(1000 + k, t, "user", "same") for k in range(40) for t in range(6)]  # copies
    rows = [r for r in rows if r[0] not in (15, 20)]  # bases that are absent
    assert got(prefix_trie.prefix_trie(frame(spark, rows).repartition(5), block=block)) == brute(rows)


def test_nulls_ties_and_repeats(spark):
    rnd = random.Random(2)
    rows = talk(rnd, 12, 5, ["a", ""])
    rows += [(3, None, None, None), (3, None, "user", "z"), (3, 2, None, "a"), (3, 2, None, "a"), (None, 1, "user", "lost"), (7, None, "", "x")]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)


def test_one_long_conversation_and_its_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 64)
    rows = [(5, t, "user", f"t{t % 7}") for t in range(700)] + [(c, t, "user", f"t{t % 7}" if t < 600 or c == 6 else "other") for c in (6, 8) for t in range(700)]
    rows += talk(random.Random(1), 4, 4, ["a"])
    assert got(prefix_trie.prefix_trie(frame(spark, rows).repartition(4))) == brute(rows)


def test_turnless_conversations_and_no_conversations(spark):
    # without their family's first conversation, short ones lose all their turns
    rows = [(c, 0, "user", "hello") for c in range(1, 5)]
    found = got(prefix_trie.prefix_trie(frame(spark, rows)))
    assert found == brute(rows) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in found)
    assert got(prefix_trie.prefix_trie(frame(spark, []))) == []


def test_very_long_text(spark):
    rows = [(c, t, "user", "ö" * 300_000 + str(t)) for c in (0, 1, 10) for t in range(3)]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert got(prefix_trie.prefix_trie(df)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
