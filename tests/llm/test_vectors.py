from collections import defaultdict

import numpy as np
import pytest

from tidepanel.llm import graph, itq

NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [0.0] * 16, 1), (902, [NAN] + [1.0] * 15, 1), (903, [INF] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]


def clustered(seed=0, n=400, d=16):
    r = np.random.default_rng(seed)
    rows, at = [], 0
    while at < n:
        base = r.standard_normal(d)
        for _ in range(int(r.integers(1, 6))):
            v = base + r.standard_normal(d) * r.choice([0.0, 0.05, 0.2, 0.35])
            rows.append((at, [float(x) for x in np.float32(v * r.choice([1.0, 3.0]))], int(at % 3) if at % 17 else None))
            at += 1
    hot = rows[5][1]
    return rows + [(at + i, hot, 1) for i in range(150)]


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_quantised_links_match_brute_force(spark):
    rows = clustered() + ODD + [(None, clustered()[5][1], 1), (5, clustered()[5][1], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(4)
    got = itq.near_duplicates(df).collect()
    links = defaultdict(set)
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            w, b = rows[j][1:]
            if a is not None and a == b and usable(v) and usable(w) and len(v) == len(w):
                x, y = np.float64(np.float32(v)), np.float64(np.float32(w))
                if v == w or x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= itq.COSINE:
                    links[i].add(j)
                    links[j].add(i)
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([root[i], *(root[j] for j in links[i])]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    want = sorted((-1 if r[0] is None else r[0], len(links[i]), least.get(root[i])) for i, r in enumerate(rows))
    have = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id) for r in got)
    assert len(have) == len(want)
    assert sum(h == w for h, w in zip(have, want)) >= 0.99 * len(want)
    assert all(h[1] <= w[1] for h, w in zip(have, want))
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert itq.near_duplicates(df.limit(0)).count() == 0


def near_pairs(x, r, cosine=0.93):
    """Unit vectors at the cosine from those of ``x``."""
    noise = r.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * noise


@pytest.mark.parametrize(("shared", "n"), [(0.0, 3000), (0.0, 1 << 20), (0.5, 3000), (0.7, 3000), (0.95, 3000)])
def test_recall_of_links_at_the_threshold(shared, n):
    """``shared`` is the length of a mean that all vectors have in common, ``n`` the vectors that the layout is made for."""
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(1 - shared**2) * x
    x[:, 0] += shared
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = near_pairs(x, r)
    width, tables, near = itq.layout(n, itq.Rotation(x, 1, 0).flip)
    turn = itq.Rotation(x, max(64, width * tables))
    a, b = turn.codes(x), turn.codes(y)
    met = (itq.table_parts(a, width, tables) == itq.table_parts(b, width, tables)).any(axis=1)
    close = np.bitwise_count(itq.first_bits(a) ^ itq.first_bits(b)) <= near
    assert (met & close).mean() > 0.95 and (shared > 0.9 or 0.4 < a.mean() < 0.6) and tables < 100


def test_buckets_do_not_grow_with_the_vectors():
    r = np.random.default_rng(12)
    shares = []
    for n in (1 << 10, 1 << 14):
        x = r.standard_normal((n, 64))
        width, tables, _ = itq.layout(n, 0.12)
        parts = itq.table_parts(itq.Rotation(x[:4096], width * tables).codes(x), width, tables)
        shares.append(np.mean([np.bincount(np.unique(parts[:, t], return_inverse=True)[1]).max() for t in range(tables)]))
    assert shares[1] < 2.5 * shares[0] and itq.layout(1 << 14, 0.12)[0] == 14


def test_graph_recall_on_unclustered_vectors():
    r = np.random.default_rng(5)
    x = r.standard_normal((4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g, start = graph.build(graph.lift(x))
    q = x[::40]
    pool, _ = graph.beam_search(graph.lift(x), g, start, np.pad(q, ((0, 0), (0, 1))))
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(p[:20]) & set(t)) / 20 for p, t in zip(pool.tolist(), best.tolist())]) > 0.9


def test_graph_recall_on_a_full_shard():
    r = np.random.default_rng(6)
    base = r.standard_normal((graph.SHARD // 8, 64))
    x = (np.repeat(base, 8, axis=0) + 0.6 * r.standard_normal((graph.SHARD, 64))).astype(np.float32)
    g, start = graph.build(graph.lift(x))
    q = x[::64]
    pool, _ = graph.beam_search(graph.lift(x), g, start, np.pad(q, ((0, 0), (0, 1))))
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(p[:20]) & set(t)) / 20 for p, t in zip(pool.tolist(), best.tolist())]) > 0.9


def test_nearest_matches_brute_force(spark):
    rows = [r[:2] for r in clustered(1)] + [r[:2] for r in ODD] + [(None, clustered(1)[0][1]), (40, clustered(1)[40][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = defaultdict(list)
    for r in sorted(graph.nearest(df, df.where("vec_id % 20 = 0")).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    ok = {i: np.float64(np.float32(v)) for i, v in rows if usable(v) and i is not None}
    asked = [i for i in ok if i % 20 == 0]
    assert set(got) == {i for i in asked if len(ok[i]) == 16 or i == 906}
    hits = total = 0
    for i in got:
        true = sorted((-float(ok[j] @ ok[i]), j) for j in ok if j != i and len(ok[j]) == len(ok[i]))[:20]
        have = got[i]
        assert len(have) == len(true) and all(abs(s - float(ok[j] @ ok[i])) < 1e-9 for j, s in have)
        assert have == sorted(have, key=lambda x: (-x[1], x[0]))
        hits += len({j for _, j in true} & {j for j, _ in have})
        total += len(true)
    assert hits >= 0.97 * total
    assert graph.nearest(df.limit(0), df.limit(0)).count() == 0


def test_queries(spark):
    """The registered queries on the smallest table, against all pairs."""
    from tidepanel.llm.queries import op2_pruned_graph, op5_iterative_quantisation

    d = "/root/testdata/sf0.001"
    rows = {r.vec_id: r for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}
    ok = {i: np.float64(np.float32(r.embedding)) for i, r in rows.items() if usable(r.embedding)}
    got = defaultdict(list)
    for r in sorted(op2_pruned_graph(spark, d).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in ok if i % 20 == 0}
    true = {i: sorted((-float(ok[j] @ ok[i]), j) for j in ok if j != i)[:20] for i in got}
    assert sum(len({j for _, j in true[i]} & {j for j, _ in got[i]}) for i in got) >= 0.97 * sum(map(len, true.values()))
    assert all(abs(s - float(ok[j] @ ok[i])) < 1e-9 for i in got for j, s in got[i])
    links = defaultdict(set)
    unit = {i: v / np.sqrt(v @ v) for i, v in ok.items()}
    for i in ok:
        links[i] |= {j for j in ok if j != i and rows[i].label is not None and rows[i].label == rows[j].label and unit[i] @ unit[j] >= 0.93}
    out = {r.vec_id: r for r in op5_iterative_quantisation(spark, d).collect()}
    assert out.keys() == rows.keys()
    assert sum(r.n_links for r in out.values()) >= 0.98 * sum(map(len, links.values()))
    assert all(r.n_links <= len(links[i]) and r.kept == (r.component_id == i) for i, r in out.items())
