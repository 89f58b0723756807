"""Tokens, languages, lines and language-model scores."""

import hashlib
import random
from collections import Counter, defaultdict
from math import log

import numpy as np
import pytest
from tokenizers import Tokenizer

from wavetally.llm import bpe, langid, linededup, lmscore


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


TEXTS = [
    None, "", "  \n", "Hello, WORLD's 2nd  test don't I'LL", "ΣΑΣ İstanbul Straße ﬁ é Å", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "x" * 4000, "ab" * 3000, "日本語 テキスト 😀👍🏽", "1234567 ½ ²", " a b\x1cc\x85d", "!!!???***", "a\tb\r\nc", "'''s", "can't've",
]


def test_tokens_equal_the_library(spark, library):
    r = random.Random(3)
    texts = [*TEXTS, *("".join(r.choices("abcdeéß '.,1 \n<|>", k=r.randint(0, 80))) for _ in range(200))]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(2)
    got = {x.doc_id: x for x in bpe.token_digests(df).collect()}
    whole = {x.doc_id: x for x in bpe.encode_documents(df).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (whole[i].n_tokens, whole[i].ids, whole[i].decoded) == (len(ids), " ".join(map(str, ids)), text), t
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_query_equals_the_library(spark, sf, library):
    from wavetally.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op7_bpe_encode_decode"](spark, sf).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_merges_equal_a_rescan():
    r = random.Random(5)
    for _ in range(300):
        pairs, base, symbols = {}, 100, 3  # symbols are numbers; a rank's pair gives a new one
        for rank in range(12):
            pairs.setdefault((r.randrange(symbols), r.randrange(symbols)), (len(pairs), symbols))
            symbols += 1
        merged = [new for _, new in pairs.values()]
        word = [r.randrange(3) for _ in range(r.randint(1, 40))]
        want = list(word)
        while True:
            ranked = [(*pairs[p], i) for i, p in enumerate(zip(want, want[1:])) if p in pairs]
            if not ranked:
                break
            _, new, i = min(ranked, key=lambda x: (x[0], x[2]))
            want[i : i + 2] = [new]
        assert bpe.merge_word(word, {a * base + b: rank for (a, b), (rank, _) in pairs.items()}, merged, base) == want


def test_every_letter_equals_the_library(library):
    e = bpe.Encoder(bpe.default_vocabulary())
    assigned = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x323B0 or c > 0xE0000)]
    for c in assigned[::7] + [c for c in assigned if chr(c) in "".join(map(chr, bpe.NEW_LOWER))]:
        ids = library.encode(f"a{chr(c)}b", add_special_tokens=False).ids
        assert e.encode(f"a{chr(c)}b")[1] == " ".join(map(str, ids)), hex(c)


def test_held_out_languages(spark, sf):
    from wavetally.llm.queries import QUERIES

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_language_id"](spark, sf).collect()
    import zlib

    assert len(rows) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    rows = [(i, ("the cat and the dog sat on the mat " if i % 2 else "der hund und die katze sind im haus ") * 3, "en" if i % 2 else "de", "x") for i in range(40)]
    odd = [(100, None, "en", "x"), (101, "", "en", "x"), (102, "12 34 !!", "en", "x"), (None, "the cat sat", None, "x"), (103, "the dog and the cat " * 3000, None, "x")]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"] and not got[None].held_out
    assert got[None].lang_pred == "en"
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in df.collect()} - {100, 101, 102}
    assert langid.identify(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", df.lang.substr(1, 0)).where("false").unionByName(spark.createDataFrame([(1, "abc", None, "x")], df.schema))
    assert langid.identify(unlabelled).first().lang_pred == "und"


def test_mixture_selects_the_set():
    logp = np.log(np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.7, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1]]))
    assert langid.infer(np.array([70, 10, 10, 10]), logp) == [(0, 1.0)]
    (k, share), *more = langid.infer(np.array([400, 210, 90, 90]), logp)
    assert k == 0 and 0.5 < share < 0.9 and [x for x, _ in more] == [1]
    assert langid.infer(np.array([0, 0, 0, 0]), logp) == []


def plain_language(counts, model, penalty=1.0):
    """The best set in loops over grams and languages: expectation-maximisation for every size, the best penalised likelihood."""

    def em(langs):
        pi = {k: 1 / len(langs) for k in langs}
        for _ in range(12 if len(langs) > 1 else 0):
            new = dict.fromkeys(langs, 0.0)
            for g, n in counts.items():
                mix = sum(pi[k] * model[k][g] for k in langs)
                for k in langs:
                    new[k] += n * pi[k] * model[k][g] / mix
            pi = {k: v / sum(counts.values()) for k, v in new.items()}
        return pi, sum(n * log(sum(pi[k] * model[k][g] for k in langs)) for g, n in counts.items())

    every = range(len(model))
    totals = [em([k])[1] for k in every]
    best, chosen = max(totals), {totals.index(max(totals)): 1.0}
    order = sorted(every, key=lambda k, pi=em(list(every))[0]: (-pi[k], k))
    for size in range(2, len(model) + 1):
        pi, ll = em(order[:size])
        if ll - penalty * (size - 1) * log(max(sum(counts.values()), 2)) > best:
            best, chosen = ll - penalty * (size - 1) * log(max(sum(counts.values()), 2)), pi
    return chosen


def test_languages_equal_plain_loops(spark):
    """The operator against counts, mixtures and the choice of a set in loops; five languages, texts of one to five of them."""
    r = random.Random(6)
    alphabets = ["abcde", "efghi", "ijklm", "mnopq", "qrstu"]
    word = lambda k: "".join(r.choices(alphabets[k], k=r.randint(2, 6)))
    text = lambda langs, n: " ".join(word(r.choice(langs)) for _ in range(n))
    rows = [(i, text([i % 5], 30), f"l{i % 5}") for i in range(60)]
    rows += [(100 + i, text(r.sample(range(5), 1 + i % 5), 60 + 40 * (i % 5)), None) for i in range(25)]
    import zlib

    sums = {}
    for i, t, l in rows:
        if l is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[l] = sums.get(l, 0) + langid.gram_buckets(t)
    names = sorted(sums)
    model = [(sums[l] + 0.5) / (sums[l] + 0.5).sum() for l in names]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    sizes = set()
    for row in langid.identify(df).collect():
        c = langid.gram_buckets(dict((i, t) for i, t, _ in rows)[row.doc_id])
        want = plain_language({int(g): int(c[g]) for g in np.flatnonzero(c)}, model)
        got = {x.lang: x.share for x in row.languages}
        assert got.keys() == {names[k] for k in want} and all(abs(got[names[k]] - p) < 1e-3 for k, p in want.items())
        assert (row.lang_pred, row.score) == max(got.items(), key=lambda x: x[1])
        sizes.add(len(got))
    assert max(sizes) >= 4


def plain_grams(text):
    """Counts of grams in a loop over the text's places."""
    t = "".join(c if c > "\x7f" or "a" <= c <= "z" else " " for c in f" {text.lower()} ")
    grams = [t[i : i + 2] for i in range(len(t) - 1) if t[i : i + 2].strip(" ")] + [t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != " "]
    return Counter(grams)


@pytest.mark.parametrize("chunk", [5, 7, 64, 1 << 18])
def test_grams_equal_a_plain_loop(monkeypatch, chunk):
    """One letter has grams, and no gram is counted twice where a text is cut."""
    monkeypatch.setattr(langid, "CHUNK", chunk)
    for text in ("a", "é", " ", "", "ab", "a b", "The Cat!  İstanbul ΣΑΣ 中文", "abcde" * 7 + "é x" * 9):
        want = plain_grams(text)
        got = langid.gram_buckets(text)
        assert got.sum() == sum(want.values())
        buckets = Counter()
        for g, n in want.items():
            codes = [ord(c) for c in g]
            key = (codes[0] * 8191 + codes[1]) * 31 + 7 if len(g) == 2 else ((codes[0] * 8191 + codes[1]) * 8191 + codes[2]) * 33 + 11
            buckets[((key * 0x2545F4914F6CDD1D & 0x7FFFFFFFFFFFFFFF) >> 31) % langid.BUCKETS] += n
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == dict(buckets)


def test_a_text_of_two_chunks_has_every_gram_once():
    text = "ab" * (1 << 19)
    assert len(text) == 4 * langid.CHUNK and langid.gram_buckets(text).sum() == (len(text) + 1) + len(text)


def test_one_letter_has_a_language(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("abc abd bca", "x"), ("éàè èéà", "y")] * 8)] + [(100, "a", None), (101, "é", None), (102, "7 !", None)]
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[100], got[101], got[102]) == (("x", True), ("y", True), ("und", False))


def plain_lines(docs, least):
    sites, first = defaultdict(set), {}
    for i, t, s in docs:
        for line in (t or "").split("\n"):
            if (k := line.strip(" ")) and s is not None:
                sites[k].add(s)
                if i is not None:
                    first[k] = min(first.get(k, i), i)
    out = []
    for i, t, _ in docs:
        lines = (t or "").split("\n")
        gone = [bool((k := x.strip(" ")) and len(sites[k]) >= least and first.get(k) != i) for x in lines]
        out.append((i, None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g), 0 if t is None else len(lines), sum(gone)))
    return out


@pytest.mark.parametrize("least", [1, 3, 40])
def test_lines_equal_brute_force(spark, least):
    r = random.Random(4)
    pool = [f"line {i}" for i in range(30)] + ["", "  ", " line 3 "]
    docs = [(i, "\n".join(r.choices(pool, k=r.randint(0, 12))), f"site{r.randrange(60)}") for i in range(120)]
    docs += [(200, None, "site1"), (201, "", None), (None, "line 1\nown", "site2"), (5, "line 2\nline 2", "site3"), (300, "long " * 20_000 + "\nline 4", "site4")]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, source string, n_lines long").repartition(3)
    key = lambda x: tuple(map(str, x))
    got = sorted(((x.doc_id, x.text, x.n_lines, x.n_removed) for x in linededup.without_spread_lines(df, min_sites=least).collect()), key=key)
    assert got == sorted(plain_lines(docs, least), key=key)
    assert linededup.without_spread_lines(df.limit(0)).count() == 0
    assert linededup.drop_boilerplate(df.withColumn("n_chars", df.doc_id)).columns == [*df.columns, "n_chars"]


def test_only_documents_with_nothing_left_go(spark):
    menu = "\n".join(f"menu entry number {i}" for i in range(40))
    docs = [(i, menu, f"site{i}") for i in range(5)] + [(5, menu + "\nits own line", "site5"), (6, menu + "\n \t", "site6"), (7, " ", "site7")]
    kept = {r.doc_id: r.text for r in linededup.drop_boilerplate(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert kept == {0: menu, 5: "its own line", 7: " "}


def plain_scores(docs):
    ws = [(d, t.encode().lower().split() if t else []) for d, t in docs]
    uni, bi = Counter(), Counter()
    for _, w in ws:
        uni.update([None, *w] if w else [])
        bi.update(zip([None, *w], w))
    n = sum(uni.values()) - uni[None]
    out = []
    for d, w in ws:
        s = [(log(bi[p] / uni[p[0]]), 0) if bi[p] >= 2 else (log(0.4 * uni[p[1]] / n), 1) for p in zip([None, *w], w)]
        out.append((d, len(w), sum(b for _, b in s), sum(a for a, _ in s) / len(s) if s else None))
    return sorted(out, key=lambda r: str(r[:3]))


@pytest.mark.parametrize("share", [1 / 65536, 1 / 50, 1.1])
def test_scores_equal_brute_force(spark, share, monkeypatch):
    monkeypatch.setattr(lmscore, "WORD_SHARE", share)
    monkeypatch.setattr(lmscore, "PAIR_SHARE", share)
    monkeypatch.setattr(lmscore, "TF_BITS", 3)  # so that repeated bigrams take several rows
    r = random.Random(8)
    docs = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 200}" for _ in range(r.randint(0, 120)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "only"), (None, "w1 w2 w1 w2"), (3, docs[3][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rid int").repartition(3)
    got = sorted(((x.doc_id, x.n_tokens, x.n_backoff, x.mean_logprob) for x in lmscore.backoff_scores(df).collect()), key=lambda r: str(r[:3]))
    want = plain_scores(docs)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all((a[3] is None and b[3] is None) or abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want))
    assert lmscore.backoff_scores(df.limit(0)).count() == 0
