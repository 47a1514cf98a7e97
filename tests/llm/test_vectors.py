import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoframe.llm import hnsw, topk


def vectors(n=600, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=16)
        rows.append((i, v.tolist(), int(rng.integers(0, 3))))
    for k in range(40):  # near copies and exact copies
        i = int(rng.integers(0, n))
        v = np.array(rows[i][1])
        rows.append((n + k, (v + rng.normal(size=16) * rng.choice([0, 0.02, 0.12])).tolist(), rows[i][2]))
    return rows


ODD = [
    (2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [float("inf")] + [1.0] * 15, 1),
    (2005, [None] + [1.0] * 15, 1), (2006, [1.0] * 16, None), (2007, [1.0] * 16, None), (None, [1.0] * 16, 1), (2100, [1.0, 2.0], 1), (2101, [2.0, 4.0, 0.0], 1),
]


def fine(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def pad(v):
    return np.array(list(v) + [0.0] * (16 - len(v)))


def links_brute(rows):
    ok = [(i, pad(v), y) for i, v, y in rows if fine(v) and any(v) and y is not None and i is not None]
    up = {i: i for i, _, _ in rows if i is not None}
    n = dict.fromkeys(up, 0)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, u, y) in enumerate(ok):
        for j, v, z in ok[:a]:
            if y == z and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.98:
                n[i] += 1
                n[j] += 1
                x, w = sorted((find(i), find(j)))
                up[w] = x
    return sorted((i, n[i], find(i), find(i) == i) for i in up)


SCHEMA = "vec_id long, embedding array<double>, label int"


def test_near_duplicates(spark, monkeypatch):
    rows = vectors() + ODD
    got = [tuple(r) for r in hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()]
    assert sorted(g for g in got if g[0] is not None) == links_brute(rows)
    assert [g for g in got if g[0] is None] == [(None, 0, None, False)]
    monkeypatch.setattr(hnsw, "SHARD", 50)
    monkeypatch.setattr(hnsw, "QUERIES", 70)
    got = [tuple(r) for r in hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()]
    assert sorted(g for g in got if g[0] is not None) == links_brute(rows)


def links_by_matrix(x, labels, ids):
    """As links_brute, a label at a time by one product."""
    out = {}
    for y in np.unique(labels):
        at = np.flatnonzero(labels == y)
        near = (x[at] @ x[at].T) / np.outer(np.linalg.norm(x[at], axis=1), np.linalg.norm(x[at], axis=1)) >= 0.98
        np.fill_diagonal(near, False)
        low = np.arange(len(at))
        while True:
            new = np.minimum(low, np.where(near, low[None, :], len(at)).min(axis=1))
            if (new == low).all():
                break
            low = new
        order = np.argsort(ids[at])
        assert (order == np.arange(len(at))).all()
        out.update({int(ids[i]): (int(near[k].sum()), int(ids[at[low[k]]])) for k, i in enumerate(at)})
    return out


def test_near_duplicates_by_graph(spark, monkeypatch):
    """5,500 vectors a label, so every beam runs on a graph; recall of links and groups is measured against all pairs."""
    rng = np.random.default_rng(8)
    n, dims = 11_000, 24
    x = rng.normal(size=(n, dims))
    labels = np.arange(n) % 2
    for k in range(0, 1500, 2):  # pairs, some of them under the threshold
        x[2000 + 2 * k] = x[2 * k] + rng.normal(size=dims) * (0.02, 0.1, 0.2)[k % 3]
    x[6000:6600:2] = x[6000] + rng.normal(size=(300, dims)) * 0.03  # a group
    monkeypatch.setattr(hnsw, "SHARD", 3000)
    monkeypatch.setattr(hnsw.Graph, "search", _counted(hnsw.Graph.search))
    rows = spark.createDataFrame([(i, x[i].tolist(), int(labels[i])) for i in range(n)], SCHEMA).repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(rows).collect()}
    want = links_by_matrix(x, labels, np.arange(n))
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert np.mean([got[i][1] == want[i][1] for i in want]) >= 0.995
    shard = hnsw.Shard({"ids": np.arange(5000), "weights": np.ones(5000, int), "x": hnsw.scaled(x[:5000]), "graph": hnsw.Graph(hnsw._unit(x[:5000]))}, 0.98)
    near, links = shard.recall(shard.x, hnsw._unit(shard.x), np.arange(5000), 4 * hnsw.FIRST_WIDTH)
    assert near >= 0.9 and links >= 0.99


def _counted(search):
    def run(self, q, width):
        assert width < len(self.x) or len(q) <= 600  # scans only of what was widened
        return search(self, q, width)

    return run


def test_many_near_copies_in_bounded_memory():
    """20,000 copies that all link: pairs come in blocks, and only counts and groups are kept."""
    import tracemalloc

    rng = np.random.default_rng(2)
    x = hnsw.scaled(rng.normal(size=8) + 1e-3 * rng.normal(size=(20_000, 8)))
    graph = object.__new__(hnsw.Graph)
    graph.order, graph.x, graph.sizes = np.arange(len(x)), hnsw._unit(x), [len(x)]
    graph.levels = [np.stack([np.roll(np.arange(len(x)), k + 1) for k in range(8)], axis=1).astype(np.int32)]
    shard = hnsw.Shard({"ids": np.arange(len(x)), "weights": np.ones(len(x), int), "x": x, "graph": graph}, 0.98)
    found, groups = np.zeros(len(x), int), hnsw.Union(len(x))
    tracemalloc.start()
    asked = np.arange(0, len(x), 50)
    for rows, cols in shard._at(x[asked], hnsw._unit(x[asked]), asked, len(x)):
        np.add.at(found, rows, 1)
        groups.add(asked[rows], cols)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert (found[: len(asked)] == len(x) - 1).all() and not groups.low.any()


def test_large_and_small_numbers(spark):
    v = np.random.default_rng(0).normal(size=6)
    rows = [(1, (v * 1e200).tolist(), 1), (2, (v * 1e-200).tolist(), 1), (3, v.tolist(), 1), (4, (-v).tolist(), 1)]
    got = sorted(tuple(r) for r in hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_near_duplicates_empty(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA + ", node long, weight int")).collect() == []


def test_graph_recall():
    rng = np.random.default_rng(3)
    x = hnsw._unit(rng.normal(size=(3000, 32)))
    x[1000:1400] = hnsw._unit(x[:1] + 0.01 * rng.normal(size=(400, 32)))
    ids, _ = hnsw.Graph(x).search(x[::30], 64)
    true = np.argsort(-(x[::30] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) >= 0.9


def top_brute(rows, k, every):
    ok = [(i, np.floor(1024 * pad(v)).astype(int)) for i, v, _ in rows if fine(v) and i is not None]
    out = []
    for i, q in ok:
        if i % every == 0:
            best = sorted((-int(q @ x), j) for j, x in ok if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard", [16_384, 100])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "QUERIES", 20)
    rows = vectors() + ODD
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), 10, 20).collect()
    assert sorted(tuple(r) for r in got) == top_brute(rows, 10, 20)


def test_top_k_few_and_none(spark):
    rows = [(0, [1.0, -2.0], 1), (1, [0.0, 0.0], 1), (2, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(0, 1, 1, 0), (0, 2, 2, 0)]
    assert topk.top_k(df.limit(0)).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([2, 16, 64, 256]), st.sampled_from([0.0, 1e-3, 0.02]), st.integers(1, 12))
def test_sorted_lists_against_scan(seed, dims, jitter, k):
    """Jittered copies give near ties; every score is compared with a whole-number scan."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(60, dims))
    x = np.concatenate([base + jitter * rng.normal(size=base.shape) for _ in range(int(rng.integers(1, 40)))])
    ids = rng.permutation(len(x)) // 2  # some ids twice
    lists = topk.SortedLists(ids, x)
    lists.prepare()
    whole = np.floor(x * 1024).astype(np.int64)
    asked = rng.integers(0, len(x), 9)
    for i, (found, scores) in zip(asked, lists.best(x[asked], ids[asked], k), strict=True):
        true = whole @ whole[i]
        others = np.flatnonzero(ids != ids[i])
        order = others[np.lexsort((ids[others], -true[others]))[:k]]
        assert scores.tolist() == true[order].tolist() and found.tolist() == ids[order].tolist()


def test_sorted_lists_of_many_rows():
    rng = np.random.default_rng(1)
    for dims in (64, 256):
        x = rng.normal(size=(10_000, dims))
        lists = topk.SortedLists(np.arange(len(x)), x)
        lists.prepare()
        whole = np.floor(x * 1024).astype(np.int64)
        for i, (found, scores) in zip(range(0, 10_000, 400), lists.best(x[::400], np.arange(0, 10_000, 400), 10), strict=True):
            true = whole @ whole[i]
            true[i] = -(1 << 62)
            order = np.lexsort((np.arange(len(x)), -true))[:10]
            assert scores.tolist() == true[order].tolist() and found.tolist() == order.tolist()


def test_huge_components(spark):
    rows = [(0, [3e18, 1.0], 1), (1, [1.0, 0.5], 1), (2, [-1.0, 0.5], 1), (3, [1e300, 2.0], 1)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), 10, 100).collect()]
    assert sorted(got) == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 2**63 - 1), (0, 3, 2, -(2**63))]


def test_queries_ask_few_shards_of_a_large_label(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 32))
    x[3000:] = x[:3000] + 0.1 * rng.normal(size=(3000, 32))
    monkeypatch.setattr(hnsw, "SHARD", 200)
    rows = spark.createDataFrame([(1, v.tolist(), i, 1) for i, v in enumerate(x)], "label long, vector array<double>, node long, weight long")
    dealt = hnsw._dealt(rows, 0.98).select("node", "leaf", "asks").collect()
    leaf = {r.node: r.leaf for r in dealt}
    assert len(set(leaf.values())) == 32
    assert np.mean([len(r.asks) for r in dealt]) < 16  # all 30 when shards were dealt by a hash
    u = hnsw._unit(x)
    close = [i for i in range(3000) if u[i] @ u[i + 3000] >= 0.98]
    asks = {r.node: set(r.asks) for r in dealt}
    assert len(close) > 2000 and np.mean([leaf[i + 3000] in asks[i] for i in close]) >= 0.99
