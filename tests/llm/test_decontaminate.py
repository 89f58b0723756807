"""Contamination against a scan of every window of every document."""

import random
from collections import Counter
from math import log

import numpy as np
import pytest

from wavetally.llm import decontaminate as dc
from wavetally.llm.hashing import shingles, word_hashes


def own_shingles(text):
    return shingles(word_hashes([text])[0], dc.SHINGLE).tolist()


def plain(docs, items, least=0.8):
    """The best window of every document and item, all of them compared: windows have the item's number of shingles."""
    hs = [(i, own_shingles(t)) for i, t in items if t is not None]
    df = Counter(s for _, h in hs for s in set(h))
    n, out = len(hs), {}
    by = {}
    for k, (i, own) in enumerate(hs):
        for s in set(own):
            by.setdefault(s, set()).add(k)
    for d, t in docs:
        s = own_shingles(t)
        for k in sorted(set().union(*(by.get(x, ()) for x in s))):  # an item that shares no shingle with the document has similarity 0
            i, own = hs[k]
            a, best = Counter(own), 0.0
            w = {x: log(1 + n / df[x]) for x in a}
            high_a = sum(m * w[x] for x, m in a.items())
            for at in range(max(len(s) - len(own) + 1, 1)):
                b = Counter(s[at : at + len(own)])
                low = sum(min(m, b[x]) * w[x] for x, m in a.items())
                best = max(best, low / (high_a + sum(m * w.get(x, log(1 + n)) for x, m in b.items()) - low))
            if best >= least:
                out[d, i] = max(round(best, 9), out.get((d, i), 0))
    return out


def fixture():
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(words, k=n))) for i, n in enumerate([5, 6, 9, 15, 20, 30, 45, 59, 120, 400])]
    docs = []
    for n in range(40):
        body = r.choices(words, k=r.randint(0, 300))
        if n % 2:
            t = items[n % len(items)][1].split()
            if n % 3 == 0 and len(t) > 50:
                t[len(t) // 2] = "edited"
            at = r.randint(0, len(body))
            body[at:at] = [x.upper() for x in t] if n % 5 == 0 else t
        docs.append((n, " \n".join(body)))
    return [*docs, (100, None), (101, ""), (102, "w1"), (103, items[4][1])], [*items, (50, "too short"), (51, ""), (52, None), (53, items[3][1])]


def test_equals_every_window(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, similarity string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in dc.contaminated(d, b).collect()}
    want = plain(docs, items)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    clean = {r.doc_id for r in dc.drop_contaminated(d, b).collect()}
    assert clean == {i for i, _ in docs} - {i for i, _ in want}


def test_groups_of_items_give_the_same(spark, monkeypatch):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(d, b).collect()}
    groups = dc.item_groups
    monkeypatch.setattr(dc, "item_groups", lambda benchmark: groups(benchmark, 900))
    assert len(list(groups(b, 900))) > 1
    assert {(r.doc_id, r.item_id): r.similarity for r in dc.contaminated(d, b).collect()} == whole


def test_empty(spark):
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert dc.contaminated(none_d, none_b).count() == 0 and dc.contaminated(some, none_b).count() == 0
    assert dc.drop_contaminated(some, none_b).count() == 1


def test_query_equals_every_window(spark, sf):
    from wavetally.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in QUERIES["op3_benchmark_decontamination"](spark, sf).collect()}
    assert got == pytest.approx(plain(docs, items)) and got


def edited(r, kind, words):
    """A near copy of an item's words: a fifth cut off at an end, or some of them deleted, inserted, replaced or repeated."""
    t, n = list(words), len(words)
    if kind == "cut":
        k = r.randint(1, max(1, n // 5))
        return t[k:] if r.random() < 0.5 else t[:-k]
    for _ in range(max(1, n // 50)):
        at = r.randrange(len(t))
        if kind == "deleted":
            del t[at]
        elif kind == "inserted":
            t.insert(at, f"n{r.randrange(999)}")
        elif kind == "replaced":
            t[at] = f"n{r.randrange(999)}"
        else:
            t[at:at] = t[at : at + 6]
    return t


def test_recall_of_near_copies():
    """Of all pairs that a comparison of every window finds, at least nine in ten are found, for each kind of edit."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    template = r.choices(words, k=7)  # shared by many items, and so of a small weight
    items = [(i, " ".join((template if i % 3 == 0 else []) + r.choices(words, k=r.choice([10, 16, 20, 30, 46, 47, 60, 120])))) for i in range(120)]
    shares = {}
    for kind in ("cut", "deleted", "inserted", "replaced", "repeated"):
        docs = []
        for d in range(240):
            copy = edited(r, kind, items[d % len(items)][1].split())
            docs.append((d, " ".join(copy if d % 2 else r.choices(words, k=40) + copy + r.choices(words, k=40))))
        want = plain(docs, items)
        df = Counter(s for _, t in items for s in set(own_shingles(t)))
        index = dc.Index([(i, np.array(own_shingles(t), np.uint64), np.array([log(1 + len(items) / df[s]) for s in own_shingles(t)])) for i, t in items], log(1 + len(items)))
        got = {(d, i): sim for (d, _), found in zip(docs, index.matches([t for _, t in docs])) for i, (sim, _) in found.items() if sim >= 0.8}
        assert got.keys() <= want.keys() and len(want) > 40
        shares[kind] = len(got) / len(want)
    print(shares)
    assert min(shares.values()) >= 0.9


@pytest.mark.parametrize("n", [3, 200])
def test_hamming_index_finds_all_within_its_radius(n):
    r = random.Random(1)
    items = [(i, np.array(own_shingles(" ".join(f"{i}x{k}" for k in range(30))), np.uint64), np.ones(26)) for i in range(n)]
    ix = dc.Index(items, 1.0)
    mine, prints, _ = ix.classes[0]
    fs = np.array([int(prints[r.randrange(n)]) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 24))) for _ in range(400)], np.uint64)
    row, col = ix._near(0, fs)
    want = {(i, int(mine[k])) for i, f in enumerate(fs) for k, p in enumerate(prints) if int(np.bitwise_count(f ^ p)) <= dc.RADIUS}
    assert set(zip(row.tolist(), col.tolist())) == want and want


def test_very_long_texts_and_large_ids(spark):
    r = random.Random(9)
    items = [(2**60 + i, " ".join(r.choices([f"w{k}" for k in range(500)], k=40))) for i in range(3)]
    long = r.choices([f"w{k}" for k in range(500)], k=60_000)
    docs = [(2**60 + 1, " ".join([*long, *items[0][1].split(), *long])), (None, items[1][1]), (2**60 + 3, items[2][1]), (2**60 + 3, items[2][1]), (5, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((x.doc_id, x.item_id, x.word) for x in dc.contaminated(d, b).collect()), key=str)
    assert got == sorted([(2**60 + 1, 2**60, 60_000), (None, 2**60 + 1, 0), (2**60 + 3, 2**60 + 2, 0), (2**60 + 3, 2**60 + 2, 0)], key=str)
    assert [x.doc_id for x in dc.drop_contaminated(d, b).collect()] == [5]
