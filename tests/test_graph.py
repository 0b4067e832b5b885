import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators import graph as G
from graphloom.operators import learning as L


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_combined_weights(spark):
    typed = frame(spark, [("a", "b", "follow", 1.0), ("a", "b", "reply", 0.6), ("a", "b", "like", 0.2), ("a", "b", "rt", 0.2), ("a", "b", "co", 0.75), ("a", "b", "quote", 0.6), ("a", "b", "mention", 0.5), ("a", "b", "follower", 1.0)], "src string, dst string, type string, w double")
    got = G.combined(typed, {"follow": 1, "reply": 0.5, "like": 0.3, "rt": 0.6, "co": 0.1, "quote": 0.7, "mention": 0.15, "follower": 0}).collect()
    assert [(r.src, r.dst) for r in got] == [("a", "b")]
    assert got[0].w == pytest.approx(2.05)


def test_reciprocity_and_mutual(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string")
    assert {(r.src, r.dst) for r in G.mutual(e).collect()} == {("a", "c"), ("c", "a")}
    assert {r.src: r.reciprocity for r in G.reciprocity(e).collect()} == {"a": 0.5, "b": 0.0, "c": 1.0}


def test_cofollow(spark):
    rows = [(s, d) for s, ds in {"A": "BCD", "B": "CD", "C": "BD", "D": "B", "E": "D"}.items() for d in ds]
    got = {(r.a, r.b): (r.shared, r.jaccard) for r in G.cofollowed(frame(spark, rows, "src string, dst string"), 0.1).collect()}
    assert got == {("B", "C"): (1, 0.25), ("B", "D"): (2, 0.4), ("C", "D"): (2, 0.5)}


def test_observation_weights(spark):
    e = frame(spark, [("a", "b"), ("a", "c"), ("b", "a")], "src string, dst string")
    n = frame(spark, [("a",), ("b",), ("c",)], "id string")
    want = frame(spark, [("a", 4), ("b", 1), ("c", 10)], "id string, expected int")
    got = {(r.src, r.dst): r.w for r in G.inverse_probability(e, want, n).collect()}
    mean = (0.5 + 1 + 0.05) / 3
    assert got[("a", "c")] == pytest.approx(1 / max(0.05, 0.5 * 0.05 / mean))
    assert got[("b", "a")] == pytest.approx(1 / min(1, 0.5 / mean))


def dense_pagerank(a, p, damping=0.85):
    x = p.copy()
    out = a.sum(1)
    for _ in range(500):
        flow = sum(x[i] * a[i] / out[i] for i in range(len(a)) if out[i]) if out.any() else np.zeros(len(a))
        x = damping * (flow + x[out == 0].sum() * p) + (1 - damping) * p
    return x


def test_pagerank_with_dangling_mass(spark):
    e = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 3, 2.0)], "src long, dst long, w double")
    n = frame(spark, [(i,) for i in range(4)], "id long")
    a = np.zeros((4, 4))
    a[0, 1], a[1, 2], a[0, 3] = 1, 1, 2
    seed = frame(spark, [(0, 1.0)], "id long, p double")
    for personal, p in ((None, np.full(4, 0.25)), (seed, np.eye(4)[0])):
        got = {r.id: r.x for r in G.pagerank(e, n, personal, tolerance=1e-9).collect()}
        assert [got[i] for i in range(4)] == pytest.approx(dense_pagerank(a, p), abs=1e-6)
        assert sum(got.values()) == pytest.approx(1)


def test_walks_leak_and_lift(spark):
    e = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, w double")
    n = frame(spark, [(i,) for i in range(4)], "id long")
    seeds = frame(spark, [("a", 3, 2.0)], "class string, id long, w double")
    got = {r.id: r.x for r in G.seeded_walks(e, n, seeds, tolerance=1e-12).collect()}
    assert got[3] == pytest.approx(0.15) and got[2] == pytest.approx(0.15 * 0.85) and got[0] == pytest.approx(0.15 * 0.85**3)
    assert sum(got.values()) < 1


def test_boundary_balances_and_adds_none(spark):
    m = frame(spark, [("a", 1, 1.0), ("a", 2, 1.0), ("b", 3, 1.0), ("b", 1, 0.2)], "class string, id long, w double")
    rows = G.boundary(m).collect()
    sums = {}
    for r in rows:
        sums[r.id] = sums.get(r.id, 0) + r.w
    assert all(s == pytest.approx(1) for s in sums.values())
    w = {(r["class"], r.id): r.w for r in rows}
    assert w[("b", 3)] == pytest.approx(1.0) and w[("a", 2)] == pytest.approx(math.sqrt(1.2 / 2.0))


def test_harmonic_chain(spark):
    e = frame(spark, [(0, 1, 1.0), (1, 2, 1.0)], "src long, dst long, w double")
    n = frame(spark, [(0,), (1,), (2,)], "id long")
    anchors = frame(spark, [(0, 1.0), (2, 0.0)], "id long, y double")
    got = {r.id: r.p for r in G.harmonic(e, anchors, n).collect()}
    assert got[1] == pytest.approx(1.0005 / 2.001) and got[0] == 1 and got[2] == 0
    heavy = frame(spark, [(0, 1, 3.0), (1, 2, 1.0)], "src long, dst long, w double")
    assert {r.id: r.p for r in G.harmonic(heavy, anchors, n).collect()}[1] > 0.5


def test_distances_components_betweenness(spark):
    e = frame(spark, [(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (6, 7)], "src long, dst long")
    n = frame(spark, [(i,) for i in range(8)], "id long")
    d = {r.id: r.distance for r in G.distances(e, n.where("id = 0"), 3).collect()}
    assert d == {0: 0, 1: 1, 4: 1, 2: 2, 3: 2}
    c = {r.id: r.component for r in G.components(e, n).collect()}
    assert c == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 6}
    b = {r.id: r.betweenness for r in G.betweenness(e, n, n).collect()}
    # by hand: 1 on 0-2 and 1 of the paths 0-2, 2 on 1-3, 4 alone on the shorter 0-3
    assert b == pytest.approx({0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0, 7: 0})


def test_searches_from_all_nodes_of_a_wide_graph_by_hand_and_without_rows_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(G, "WORK", 2000)
    monkeypatch.setattr(G, "HELD", 700)  # several tasks, several batches a task
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 40, (90, 2))} | {(50 + i, 51 + i) for i in range(30)}
    nodes = range(90)
    out = {v: [b for a, b in pairs if a == v != b] for v in nodes}
    near = {v: {b for b in nodes if b in out[v] or v in out[b]} for v in nodes}
    between, close = dict.fromkeys(nodes, 0.0), {}
    for s in nodes:
        order, distance, paths = [s], {s: 0}, dict.fromkeys(nodes, 0.0)
        paths[s] = 1
        for v in order:
            for w in out[v]:
                if w not in distance:
                    distance[w] = distance[v] + 1
                    order.append(w)
                paths[w] += paths[v] * (distance[w] == distance[v] + 1)
        share = dict.fromkeys(nodes, 0.0)
        for v in reversed(order):
            share[v] = sum(paths[v] / paths[w] * (1 + share[w]) for w in out[v] if distance[w] == distance[v] + 1)
            between[v] += share[v] * (v != s)
        far, front, hop = {s}, {s}, 0
        total = 0
        while front := {b for a in front for b in near[a]} - far:
            hop, far = hop + 1, far | front
            total += hop * len(front)
        if total:
            close[s] = (len(far) - 1) / (len(nodes) - 1) * (len(far) - 1) / total
    e, n = frame(spark, sorted(pairs), "src long, dst long"), frame(spark, [(i,) for i in nodes], "id long")
    monkeypatch.setattr(G, "distances", None)  # 81 million rows of pairs at 0.1 GB
    assert {r.id: r.betweenness for r in G.betweenness(e, n, n).collect()} == pytest.approx(between)
    assert {r.id: r.closeness for r in G.closeness(G.reach(e, n), len(nodes)).collect()} == pytest.approx(close)


def test_louvain_finds_two_cliques(spark):
    edges = [(i, j, 1.0) for g in (range(5), range(5, 10)) for i in g for j in g if i < j] + [(4, 5, 1.0)]
    e = frame(spark, edges, "a long, b long, w double")
    got = G.louvain(e)
    q = G.modularity(e, got).first()[0]
    best = G.modularity(e, frame(spark, [(i, i // 5) for i in range(10)], "id long, community long")).first()[0]
    assert q >= best - 1e-9


def test_spectral_against_dense(spark):
    rng = np.random.default_rng(0)
    a = rng.random((8, 8)) * (rng.random((8, 8)) < 0.7)
    np.fill_diagonal(a, 0)
    rows = [(int(i), int(j), float(a[i, j])) for i in range(8) for j in range(8) if a[i, j]]
    e = frame(spark, rows, "src long, dst long, w double")
    s = (a + a.T) / 2
    d = 1 / np.sqrt(s.sum(1))
    lap = np.eye(8) - d[:, None] * s * d[None, :]
    got = np.zeros((8, 8))
    for r in L.laplacian(e).collect():
        got[r.src, r.dst] = r.v
    assert got == pytest.approx(lap)
    values, vectors = np.linalg.eigh(lap)
    f = np.array([r.f for r in L.spectral(e, 2, rounds=120).orderBy("id").collect()])
    want = vectors[:, 1:3]
    want = want / np.linalg.norm(want, axis=1, keepdims=True)
    assert np.abs(f @ f.T - want @ want.T).max() < 0.15


def test_ward_and_cut():
    x = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    tree = L.ward(x)
    assert tree[0, 2] == pytest.approx(0.1) and tree[-1, 3] == 5
    labels = L.cut_tree(tree, 3)
    assert labels[0] == labels[1] and labels[2] == labels[3] and len(set(labels)) == 3
    with pytest.raises(ValueError):
        L.ward(np.zeros((L.DRIVER_ORDER + 1, 1)))


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 12), st.integers(1, 6))
def test_diversified_takes_distinct(n, k):
    rng = np.random.default_rng(n * 10 + k)
    got = L.diversified(rng.random(n), rng.random((n, 3)), k)
    assert len(got) == len(set(got)) == min(n, k)


def test_nmf_lowers_the_error(spark):
    rng = np.random.default_rng(1)
    m = rng.random((6, 2)) @ rng.random((2, 5))
    df = frame(spark, [(i, j, float(m[i, j])) for i in range(6) for j in range(5)], "row long, col long, w double")

    def error(rounds):
        w, h = L.nmf(df, 2, rounds)
        a = np.array([r.f for r in w.orderBy("row").collect()])
        b = np.array([r.f for r in h.orderBy("col").collect()])
        assert (a >= 0).all() and (b >= 0).all()
        return np.abs(a @ b.T - m).mean()

    assert error(12) < error(2)
