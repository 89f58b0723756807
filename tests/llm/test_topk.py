"""Top-k search against brute force."""

import random

import numpy as np
import pytest

from wavetally.llm import topk


def brute(rows, k=20, every=20):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok[i, tuple(int(np.floor(64 * x)) for x in v)] = 1
    out = set()
    for q, a in ok:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q and len(b) == len(a))[:k]
            out |= {(q, r + 1, c, -m) for r, (m, c) in enumerate(s)}
    return out


def vectors(kind, n, d, seed=0):
    r = np.random.default_rng(seed)
    if kind == "ties":
        return r.integers(-1, 2, (n, d)) / 4.0
    if kind == "copies":
        v = r.standard_normal((n, d))
        v[: n // 2] = v[0]
        return v
    if kind == "large":
        return r.standard_normal((n, d)) * 1e7
    return r.standard_normal((n, d)) + 3 * r.integers(0, 4, (n, 1))


@pytest.mark.parametrize("kind", ["normal", "ties", "copies", "large"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 70)
    monkeypatch.setattr(topk, "PIVOTS", 5)
    rows = [(i - 40, [float(x) for x in v]) for i, v in enumerate(vectors(kind, 400, 6))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [-1.0, 0.3]), (40, [1.0, 1.0, 1.0]), (7, [2.0, 0.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    assert {tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows)
    assert topk.top_k(df.limit(0)).count() == 0


def test_tree_covers():
    x = np.random.default_rng(2).standard_normal((500, 4))
    order, nodes = topk.cover_tree(x, leaf=10)
    assert sorted(order) == list(range(500))
    for centre, radius, start, stop, children in nodes:
        assert np.linalg.norm(x[order[start:stop]] - centre, axis=1).max() <= radius
        if children:
            assert [nodes[c][2] for c in children] + [stop] == [start] + [nodes[c][3] for c in children]


def test_pruning_skips_far_nodes(monkeypatch):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.5, (400, 8)) * 10 for c in (-20, 0, 20)]).astype(np.int64)
    scored = []
    dot = topk._dot
    monkeypatch.setattr(topk, "_dot", lambda a, b: scored.append(len(a) * len(b)) or dot(a, b))
    q = x[-50:]
    at, ids, scores = topk.dual_search(q, np.arange(5000, 5050), x, np.arange(len(x)), 5, np.full(50, -np.inf))
    assert sum(scored) < 0.6 * len(q) * len(x)
    full = dot(q, x)
    assert all(sorted(scores[at == i], reverse=True) == sorted(full[i], reverse=True)[:5] for i in range(50))
