import random
import re

import numpy as np

from tidemark.llm import url_filter as U


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, _ in U.RULES:
        d, _, p = rule.partition("/")
        if (host == d or host.endswith("." + d)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def pages():
    rng = random.Random(1)
    rows = [None, "", "no scheme", "://", "http://", "http://COM/en/", "http://a.Example.COM/en/71?x=/#y", "http://xcom/en/1", "http://x.com?/en/", "http://x.com#/en/", "http://x.com/EN/", "ftp://x.net/de/\n8",
            "http://example.net/de/88", "http://badexample.net/de/8", "http://a://x.com/en/", "http://É.com/en/é", "http://x.org/es/" + "y" * 20000]
    for _ in range(1500):
        rows.append(f"http://{rng.choice(['a', 'b.c'])}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(99999)}{rng.choice(['', '/', '.html', '?a=1', '#t'])}")
    return rows


def test_rules_hosts_and_paths(spark):
    rows = pages()
    df = spark.createDataFrame([(k, u, "<p>", "h") for k, u in enumerate(rows)] + [(3, rows[3], "", "h")], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in U.judged(df).collect()}
    verdicts = dict(U.RULES)
    for k, u in enumerate(rows):
        assert (got[k].host, got[k].path, got[k].rule) == plain(u), u
        assert got[k].verdict == (verdicts[got[k].rule] if got[k].rule else "allow" if got[k].chance >= 0.5 else "block")
    ruled = [r for r in got.values() if r.rule]
    assert np.mean([(r.chance >= 0.5) == (verdicts[r.rule] == "allow") for r in ruled]) > 0.85
    assert len(U.judged(df).collect()) == len(rows) + 1 and U.judged(df.limit(0)).count() == 0


def plain_ratios(rows):
    """rows: (url, allowed or None, half, n). Ruled URLs by the other half's counts, the others by all."""
    def counted(rows):
        counts = {}
        for url, _, _, n in rows:
            b = bytes(U.ORDER) + url.encode()
            for i in range(U.ORDER, len(b)):
                for k in range(U.ORDER + 1):
                    for key in (b[i - k : i], (b[i - k : i], b[i])):
                        counts[key] = counts.get(key, 0) + n
        return counts

    def chance(counts, b, i):
        p = 1 / 256
        for k in range(U.ORDER + 1):
            p = (counts.get((b[i - k : i], b[i]), 0) + U.PRIOR * p) / (counts.get(b[i - k : i], 0) + U.PRIOR)
        return p

    out = {}
    for url, allowed, half, _ in rows:
        mine = [counted([r for r in rows if r[1] is c and (allowed is None or r[2] != half)]) for c in (True, False)]
        b = bytes(U.ORDER) + url.encode()
        logs = [np.log(chance(mine[0], b, i)) - np.log(chance(mine[1], b, i)) for i in range(U.ORDER, len(b))]
        out[url] = sum(logs) / max(1, len(logs))
    return out


def test_ratios_equal_plain_ones(spark):
    rows = [("abcab", True, 0, 1), ("abcabc/x", True, 1, 3), ("", None, 0, 2), ("http://é", False, 0, 1), ("http://e/b", False, 1, 5), ("abcab" * 50, None, 1, 1), ("zzz", None, 0, 1), ("x\x00y", True, 0, 2)]
    df = spark.createDataFrame(rows, "url string, allowed boolean, half int, n long")
    got = {r.url: r.ratio for r in U.url_ratios(df).collect()}
    want = plain_ratios(rows)
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-8 for u in want)


def test_rules_of_one_class_or_none(spark):
    df = spark.createDataFrame([(1, "http://x.com/en/1"), (2, "http://y.org/q"), (3, None), (1, "http://x.com/en/1")], "page_id long, url string")
    got = U.judged(df).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(1, "block"), (1, "block"), (2, "block"), (3, "allow")] and all(0 <= r.chance <= 1 for r in got)
    assert {r.chance for r in U.judged(df, rules=()).collect()} == {0.5}
