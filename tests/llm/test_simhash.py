"""Fingerprints and groups against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavetally.llm import simhash as sh
from wavetally.llm.components import connected_components


def plain_fingerprint(text, n=4):
    ws = ("" if text is None else text).encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + n]), 42) for i in range(max(len(ws) - n + 1, 1))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def texts():
    r = random.Random(7)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa"]
    out = [" ".join(r.choices(words, k=r.randint(30, 300))) for _ in range(25)]
    for base in list(out[:10]):
        ws = base.split()
        for _ in range(6):
            c = list(ws)
            c[r.randrange(len(c))] = "changed"
            out.append("\t".join(c).upper() if r.random() < 0.3 else " \n".join(c))
    return [*out, *out[:5], None, "", "   ", "one two", "one two", "a b c d", "x " * 70_000]


def test_classes_equal_brute_force(spark):
    ts = texts()
    rows = [(i * 3 + 1, t, "shadow", 0) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, _f0 int").repartition(4)
    prints = [plain_fingerprint(t) for t in ts]
    want = {(i * 3 + 1, f"{p:016x}", r * 3 + 1) for i, (p, r) in enumerate(zip(prints, plain_components(prints, 4)))}
    assert {tuple(r) for r in sh.near_duplicate_classes(df).collect()} == want


def test_query_equals_brute_force(spark, sf):
    from wavetally.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(d.text) for d in docs]
    want = {(d.doc_id, f"{p:016x}", docs[r].doc_id) for d, p, r in zip(docs, prints, plain_components(prints, 4))}
    assert {tuple(r) for r in QUERIES["op2_simhash_near_dedup"](spark, sf).collect()} == want


@pytest.mark.parametrize("radius", [1, 3, 4, 10])
@pytest.mark.parametrize("block", [4, 512])
def test_links_keep_all_components(spark, radius, block):
    r = random.Random(radius)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, radius + 2))) for b in base for _ in range(15)} | {r.getrandbits(64) for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s, s) for s in signed], "node long, _f0 long")
    got = {r.node: r.root for r in connected_components(sh.simhash_links(df, radius, block=block)).collect()}
    want = plain_components(prints, radius)
    groups = lambda keys: sorted(sorted(i for i, k in enumerate(keys) if k == g) for g in set(keys))
    assert groups([got.get(s, s) for s in signed]) == groups(want)


@pytest.mark.parametrize("radius", [0, 1, 4, 10, 16])
def test_allocation_leaves_no_gap(radius):
    rng = np.random.default_rng(radius)
    p = rng.uniform(0.1, 0.9, 64)
    plan = sh.allocate(100_000, p, np.eye(64), radius) if radius else [(list(range(64)), 0)]
    assert sum(2 * e + 1 for _, e in plan) >= radius + 1
    assert len({b for bits, _ in plan for b in bits}) == sum(len(bits) for bits, _ in plan)


def test_empty_and_null(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sh.near_duplicate_classes(none).count() == 0
    assert sh.drop_near_duplicates(none).count() == 0
    some = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "other words all of them here")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in sh.near_duplicate_classes(some).collect())
    assert got == [("2", "2"), ("2", "2"), ("4", "2"), ("None", "2"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in sh.drop_near_duplicates(some).collect()) == ["2", "None"]


def test_one_of_each_group_stays(spark):
    ts = [t for t in texts() if t and len(t.split()) > 100]
    df = spark.createDataFrame([(i, t, i, t) for i, t in enumerate(ts)], "doc_id long, text string, node long, _rid string")
    kept = sh.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    exact = {}
    for i, t in enumerate(ts):
        exact.setdefault(" ".join(t.lower().split()), i)
    assert set(ids) <= set(exact.values()) and len(ids) >= 10


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)] + [(500, 501 + i) for i in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 102)}, **{i: 500 for i in range(500, 541)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0


def test_near_copies_equal_brute_force_similarity(spark):
    r = random.Random(5)
    ts = []
    for _ in range(8):
        base = [f"w{r.randrange(5000)}" for _ in range(200)]
        ts.append(" ".join(base))
        for _ in range(12):
            c = list(base)
            for at in r.sample(range(200), r.randint(1, 8)):
                c[at] = f"x{r.randrange(10**6)}"
            ts.append(" ".join(c))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in ts]
    root = list(range(len(ts)))
    for i in range(len(ts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in sh.drop_near_duplicates(df, block=4).collect()) == sorted(set(root))


@pytest.mark.parametrize("n, common, both", [(5, 4, False), (9, 8, True), (27, 24, True), (160, 128, False), (90, 80, True)])
def test_probes_find_pairs_at_the_least_similarity(spark, n, common, both):
    """Simhash keys meet and verify 0.99 of the pairs at 0.8: sets of n and common shingles, or both of n."""
    r, half, pairs = random.Random(n), (np.full(64, 0.5), np.eye(64)), 400
    rows = []
    for k in range(pairs):
        h = np.array([r.getrandbits(64) for _ in range(2 * n - common)], np.uint64)
        for side, x in enumerate((h[:n], h[n - common :] if both else h[:common])):
            f, margin = sh.wide_print(np.sort(x))
            rows.append((2 * k + side, len(x), *(int(w) for w in f), margin))
    heads = spark.createDataFrame(rows, "node long, n_shingles long, _f0 long, _f1 long, _f2 long, _f3 long, margin binary")
    plan = sh.allocate_recall(10**6, [half] * sh.WORDS, 1.6 / 1.8)
    links = sh.simhash_links(heads, sh.LIKELY, sh.LIKELY_WIDE, keyed=sh.probes(heads, plan))
    root = {x.node: x.root for x in connected_components(links).collect()}
    assert sum(root.get(2 * k, -1) == root.get(2 * k + 1, -2) for k in range(pairs)) >= 0.99 * pairs


def test_recall_plan_multiplies_to_its_goal():
    p, corr = np.random.default_rng(3).uniform(0.2, 0.8, 64), np.eye(64)
    for n in (0, 500, 10**5, 10**8):
        plan = sh.allocate_recall(n, [(p, corr)] * sh.WORDS, 1.6 / 1.8)
        assert np.prod([1 - sh.meeting(len(b), e, 1.6 / 1.8) for _, b, e in plan]) <= sh.MISSED
        assert len({(k, b) for k, bits, _ in plan for b in bits}) == sum(len(bits) for _, bits, _ in plan)


def test_similar_links_equal_loops():
    r = random.Random(8)
    sets = [np.array(sorted(r.sample(range(60), r.randint(1, 50))), np.int64) for _ in range(40)]
    sets += [np.unique(np.append(s[1:], 99)) for s in sets]
    links = sh.similar_links(np.arange(len(sets)), sets, 0.8)
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]

    def root(edges):
        r = list(range(len(sets)))
        for a, b in edges:
            r = [min(r[a], r[b]) if x in (r[a], r[b]) else x for x in r]
        return r

    assert near and root(links) == root(near) and len(links) == len(sets) - len(set(root(near)))
