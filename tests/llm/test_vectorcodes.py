"""Vector codes against plain loops; the tree against comparing with every entry."""

import hashlib
import math

import numpy as np
import pytest

from wavetally.llm import vectorcodes as vc


def plain(rows):
    """``{(vec_id, code, error, label_error, digest)}`` by loops over integers of any size."""
    kept = [(i, [int(math.floor(256 * int(x) if abs(x) >= 2**53 else 256 * x)) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:64]
    if not first:
        return []
    width = len(first[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    step = width // 16
    part = lambda v, p: v[p * step : (p + 1) * step]
    books = [[part(v, p) for _, v in first if len(v) == width] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(2):
        for p in range(16):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g)]
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    out = []
    for i, v, l in kept:
        found = [near(part(v, p), books[p]) for p in range(16)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), l))
    fits = lambda x: x if x is not None and x < 2**63 else None
    sums = {}
    for _, _, d, l in out:
        sums[l] = None if fits(d) is None or sums.get(l, 0) is None else sums.get(l, 0) + d
    return sorted(((i, c, fits(d), fits(sums[l]), digest) for i, c, d, l in out), key=str)


def got(df):
    return sorted((tuple(r) for r in vc.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("kind", ["ties", "copies", "few", "large"])
def test_equals_loops(spark, kind):
    r = np.random.default_rng(4)
    x = {"ties": r.integers(-2, 3, (220, 32)) / 256, "copies": np.repeat(r.standard_normal((70, 16)), 3, axis=0), "few": r.standard_normal((30, 16)), "large": r.standard_normal((90, 16)) * 10.0 ** r.integers(0, 30, (90, 1))}[kind]
    rows = [(k * 7 % 1000 - 100, v.tolist(), None if k % 3 == 0 else k % 4) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert got(df) == plain(rows)


def test_odd_rows(spark):
    one, two = [0.5] * 16, [-0.001] * 16
    rows = [(1, one, 0), (1, one, 0), (None, two, None), (3, None, 1), (4, [None] + one[1:], 1), (5, [float("nan")] + one[1:], 1), (6, [float("inf")] + one[1:], 1), (7, [], 2), (8, two, 2), (9, [1.0] * 32, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string")
    assert got(df) == plain(rows) and len(got(df)) == 4
    assert got(df.where("vec_id = 3")) == got(df.limit(0)) == []


def test_uneven_parts(spark):
    df = spark.createDataFrame([(k, [float(k + j) for j in range(19)], 0) for k in range(5)], "vec_id long, embedding array<double>, label int")
    assert [b.shape[1] for b in vc.encode_vectors(df)[1]] == [2, 2, 2] + [1] * 13
    assert {r.error for r in vc.compressed(df).collect()} == {0}


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(vc, "BROADCAST", 3)
    r = np.random.default_rng(5)
    rows = [(k, r.standard_normal(16).tolist(), None if k % 11 == 0 else k % 7) for k in range(150)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == plain(rows)


@pytest.mark.parametrize("spread", [2, 40, 3000])
def test_tree(spread):
    r = np.random.default_rng(spread)
    entries, x = r.integers(-spread, spread, (64, 4)), r.integers(-spread, spread, (5000, 4))
    d = vc.square_distances(x, entries)
    t = vc.Tree(entries)
    index, best = t.nearest(x)
    assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert spread < 10 or t.measured < 0.75 * d.size
    big = vc.Tree((entries.astype(object) << 70) + 1)
    index, best = big.nearest((x[:200].astype(object) << 70) + 1)
    assert (index == d[:200].argmin(axis=1)).all() and (best == d[:200].min(axis=1).astype(object) << 140).all()
