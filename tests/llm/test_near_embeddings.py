import tracemalloc

import numpy as np

from tidemark.llm import near_embeddings as N


def brute(rows, t=0.95):
    n = len(rows)
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [set() for _ in range(n)]
    for a in ok:
        for b in ok:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                    links[a].add(b)
    seen, name = set(), {}
    for s in range(n):
        if s in seen:
            continue
        todo, comp = [s], {s}
        while todo:
            for y in links[todo.pop()] - comp:
                comp.add(y)
                todo.append(y)
        seen |= comp
        for x in comp:
            name[x] = min(rows[y][0] for y in comp)
    return sorted((rows[i][0], len(links[i]), name[i], rows[i][0] == name[i]) for i in range(n))


def rows_of(seed, dim):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    x = [(base[k % 12] * rng.uniform(0.1, 9) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.25])).tolist() for k in range(150)]
    x += [(base[0] + s * base[1]).tolist() for s in np.linspace(0, 3, 20)]
    return x


def test_brute_force(spark, monkeypatch):
    for dim, block in ((40, 4096), (3, 4096), (20, 16)):
        monkeypatch.setattr(N, "BLOCK_ROWS", block)
        x = rows_of(dim, dim)
        x += [None, [], [0.0] * dim, [float("nan")] * dim, [1.0] * (dim - 1) + [None], [float("inf")] + [1.0] * (dim - 1), [1.0, 1.0], [2.0, 2.01], x[3], x[3]]
        rows = [((k * 37) % 1009, v) for k, v in enumerate(x)]
        rows.append(rows[5])
        df = spark.createDataFrame([(a, v, 0, "z") for a, v in rows], "vec_id long, embedding array<float>, label int, rep string")
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in N.near_embeddings(df).collect())
        assert got == brute(rows)


def test_empty_and_without_ids(spark):
    assert N.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.near_embeddings(df).collect()}
    assert got == {None: (0, None, False), 4: (0, 4, True)}


def test_links_of_a_large_group_are_not_kept():
    rng = np.random.default_rng(3)
    n = 6000
    x = np.r_[rng.normal(size=8) * 9 + rng.normal(size=(n, 8)) * 0.01, -np.ones((1, 8))]
    copies = rng.integers(1, 4, len(x))
    for second in (None, np.arange(len(x)) % 2 == 1):
        tracemalloc.start()
        counts, root = N.folded(x, second, copies, None, 0.95)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 4 * n * n  # the indices of all pairs are 8 * n * n bytes, or half of that between two blocks
        mine, others = (copies[:n], copies[:n].sum()) if second is None else (0, np.where(second[:n], copies[:n][~second[:n]].sum(), copies[:n][second[:n]].sum()))
        assert (counts[:n] == others - mine).all() and counts[n] == 0
        assert (root[:n] == 0).all() and root[n] == n
