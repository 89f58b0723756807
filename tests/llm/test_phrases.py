"""Collocations against plain loops."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from wavetally.llm import phrases


def plain(rows, longest=5, least=100, share=100, reported=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + m])) for m in range(1, longest + 1) for i in range(len(ws) - m + 1))
    found = {k: a for k, a in counts.items() if a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = {}
    for (lang, p), a in found.items():
        if len(p) < 2 or any(l == lang and len(q) > len(p) and 100 * b >= share * a and inside(p, q) for (l, q), b in found.items()):
            continue
        score, k = min((1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, r + 1, p.decode(), -a, l, b, totals[lang], -s) for lang, got in out.items() for r, (s, a, p, l, b) in enumerate(sorted(got)[:reported])}


def got(spark, rows, **how):
    df = spark.createDataFrame([(k, *r, "x") for k, r in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(3)
    return {tuple(r) for r in phrases.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def texts(seed, n=60):
    r = random.Random(seed)
    words = ["the", "a", "Cat", "dog", "é", "É", "sat", "on", "mat", "x\xa0y", "中"]
    gaps = [" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "\r\n", "!", "\x0b"]
    return [(r.choice(["en", "fr", None, "und"]), "".join(r.choice(words[: r.randint(2, 11)]) + r.choice(gaps) for _ in range(r.randint(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize("seed, how", [(1, {"least": 3}), (2, {"least": 2, "share": 60, "reported": 7}), (3, {"least": 1, "longest": 3})])
def test_equals_loops(spark, monkeypatch, seed, how):
    monkeypatch.setattr(phrases, "HOT", 30)
    monkeypatch.setattr(phrases, "FILTER_BITS", 1 << 15)
    rows = texts(seed)
    assert got(spark, rows, **how) == plain(rows, **how)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """A filter that lets every phrase pass costs work, not results."""
    monkeypatch.setattr(phrases, "_filter_of", lambda level, n: level.sparkSession.sparkContext.broadcast((np.full(1 << 12, 255, np.uint8), 1 << 15)))
    rows = [("en", "a b c d e f " * 40), ("en", "x y. " * 30), ("en", "b c d " * 9)]
    assert got(spark, rows, least=9) == plain(rows, least=9)


@pytest.mark.parametrize("chunk", [1, 7, 50, 1000])
def test_runs_of_texts_keep_every_piece(monkeypatch, chunk):
    """Texts are cut at ends of pieces alone, however long a piece is, and languages stay apart."""
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = [(l or "und", t) for l, t in texts(5)] + [("en", "a b c d e f " * 40), ("fr", "."), ("fr", "x. " * 30)]
    batches = [pa.record_batch({"lang": [l for l, _ in rows[i : i + 9]], "text": [t for _, t in rows[i : i + 9]]}) for i in range(0, len(rows), 9)]
    seen, want = Counter(), Counter()
    for lang, data in phrases._chunks(batches):
        words, code, piece = phrases._words(data)
        names = [w.decode() for w in words.to_pylist()]
        for k in set(piece.tolist()):
            seen[lang, tuple(names[c] for c in code[piece == k])] += 1
    for lang, t in rows:
        for x in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)):
            if ws := tuple(w for w in re.split("[ \t]+", x) if w):
                want[lang, ws] += 1
    assert seen == want


def test_odd_rows(spark):
    rows = [("en", None), (None, ""), ("fr", " . ,"), ("en", "a a a a a")]
    assert got(spark, rows, least=2) == plain(rows, least=2) != set()
    assert got(spark, [("en", "a b")]) == set()
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).count() == 0


def test_products_beyond_64_bits(spark):
    rows = [(10**15 + 7, 10**16 + 61, 10**15 + 9, 3 * 10**15 + 1), (123, 10**13, 200, 199)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    assert {r.score for r in phrases.scored(df).collect()} == {1000 * a * n // (l * r) for a, n, l, r in rows}
