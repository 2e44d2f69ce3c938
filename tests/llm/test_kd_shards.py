import os
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import kd_shards

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, lo int, size string"


def check(docs, found, n):
    """Every row once, with its own figures; shards within half a document a level of their share; slots without gaps."""
    rows = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.select("doc_id", "text").collect()]
    got = found.collect()
    assert Counter(rows) == Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n for r in got)
    bytes_, counts = Counter(), Counter()
    for r in got:
        bytes_[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    assert Counter((r["shard"], r["slot"]) for r in got) == Counter((s, k) for s in counts for k in range(counts[s]))
    share, most = sum(bytes_.values()) / n, max((r[1] for r in rows), default=0)
    assert all(abs(bytes_[s] - share) <= most for s in range(n))
    return got


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", None, 7, "9") for r in rows], KINDS)


def made(k):
    return (k, f"text {k} " + "wörter " * (k % 40), ["de", "en", None][k % 3], "hot" if k % 3 else f"s{k % 11}", None if k % 50 == 0 else k * k % 997)


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_shares_of_bytes(spark, n):
    docs = frame(spark, [made(k) for k in range(3000)]).repartition(6)
    check(docs, kd_shards.shards(docs, n), n)


def test_cells_are_boxes(spark):
    """With one dimension, shards are ranges of it; equal places are split only at a cut."""
    docs = frame(spark, [(k, "x" * (k * 7 % 90), "en", "s", k // 3) for k in range(2000)])
    got = check(docs, kd_shards.shards(docs, 8, ("n_chars",)), 8)
    ranges = {}
    for r in got:
        v = r["doc_id"] // 3
        low, high = ranges.get(r["shard"], (v, v))
        ranges[r["shard"]] = (min(low, v), max(high, v))
    assert all(ranges[s][1] <= ranges[s + 1][0] for s in range(7))


def test_the_widest_dimension_is_cut_first(spark):
    # lengths fill their range evenly; languages are two, so they span all of theirs: the first dimension breaks the tie
    rows = [(k, "abc", ["de", "en"][k % 2], "s", k) for k in range(800)]
    docs = frame(spark, rows)
    by_lang = {r["doc_id"] % 2: set() for r in docs.collect()}
    for r in kd_shards.shards(docs, 4, ("lang", "n_chars")).collect():
        by_lang[r["doc_id"] % 2].add(r["shard"] // 2)
    assert sorted(map(sorted, by_lang.values())) == [[0], [1]]
    low = {r["shard"] // 2: r["doc_id"] for r in kd_shards.shards(docs, 4, ("n_chars", "lang")).orderBy(F.desc("doc_id")).collect()}
    assert low == {0: 0, 1: 400}


def test_copies_stay_together_within_a_place(spark):
    docs = frame(spark, [(k, f"text {k % 20}", "en", "s", 5) for k in range(2000)])
    got = check(docs, kd_shards.shards(docs, 8), 8)
    where = {}
    for r in got:
        where.setdefault(r["doc_id"] % 20, set()).add(r["shard"])
    assert sum(len(x) > 1 for x in where.values()) <= 7  # at most one group for each cut


def test_hot_copies_nulls_and_few_rows(spark):
    rows = [(7, "same", "en", "hot", 4)] * 900 + [(None, None, None, None, None)] * 60 + [made(k) for k in range(200)]
    docs = frame(spark, rows).repartition(4)
    check(docs, kd_shards.shards(docs, 8), 8)
    for n in (0, 1, 3):
        docs = frame(spark, [made(k) for k in range(n)])
        assert Counter(r["slot"] for r in kd_shards.shards(docs, 8).collect()).total() == n


def test_a_very_long_text(spark):
    docs = frame(spark, [(0, "y" * 2_000_000, "en", "s", 2_000_000)] + [made(k) for k in range(1, 500)])
    got = kd_shards.shards(docs, 8).collect()
    assert len(got) == 500 and {r["size"] for r in got if r["doc_id"] == 0} == {2_000_001}


def test_target_bytes(spark):
    docs = frame(spark, [made(k) for k in range(1000)])
    total = sum(len(made(k)[1].encode()) + 1 for k in range(1000))
    check(docs, kd_shards.shards_of_bytes(docs, total // 3), 4)
    assert kd_shards.shards_of_bytes(frame(spark, []), 10).count() == 0


def test_native_and_ranged(spark):
    docs = frame(spark, [made(k) for k in range(50)])
    plan = kd_shards.shards(docs, 8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(docs, kd_shards.shards(docs), 8)
