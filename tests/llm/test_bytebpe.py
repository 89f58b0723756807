"""Byte-level encoding against the tiktoken library and plain merges."""

import base64
import hashlib
import random

import pytest
import tiktoken

from wavetally.llm import bytebpe, queries


def library(path, pattern):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def lib():
    return library(bytebpe.default_ranks(), bytebpe.default_pattern())


@pytest.fixture(scope="module")
def own():
    return bytebpe.Replay(bytebpe.default_ranks(), bytebpe.default_pattern())


def ids_of(r, texts):
    return [[int(i) for part in parts for w in part for i in w[0].split()] for parts in r.encode(texts)]


def test_every_character(own, lib):
    dense = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0xE0000, 0xE0200)]
    codes = [c for c in {*dense, *range(0, 0x110000, 101)} if not 0xD800 <= c < 0xE000]  # all but the large blocks of one kind
    texts = ["".join(f"a{c}b {c} {c}{c}1{c}.{c}" for c in map(chr, codes[k : k + 64])) for k in range(0, len(codes), 64)]
    assert ids_of(own, texts) == [lib.encode_ordinary(t) for t in texts]


def test_random_texts(own, lib):
    r = random.Random(1)
    alphabet = "ab'sStlreved  \n\t\x85\xa0é中ñ12٣½.,!-_\x1c 🙂"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(5000)]
    texts += ["a" * 5000, "ab" * 4000, "the " * 1000, "x" * 100 + " " * 300, "<|endoftext|>"]
    assert ids_of(own, texts) == [lib.encode_ordinary(t) for t in texts]


def test_parts_of_long_texts(lib, monkeypatch):
    monkeypatch.setattr(bytebpe, "TOGETHER", 50)
    monkeypatch.setattr(bytebpe, "WORDS", 7)
    monkeypatch.setattr(bytebpe, "REMEMBERED", 5)
    r = bytebpe.Replay(bytebpe.default_ranks(), bytebpe.default_pattern())
    texts = [" ".join(f"word{i * k} unseen" for i in range(40)) for k in range(9)] + ["", None, "short", "unseen" * 30]
    assert ids_of(r, texts) == [lib.encode_ordinary(t or "") for t in texts]


def test_a_vocabulary_whose_ranks_fall_while_merging(tmp_path):
    """A merge may make a pair of a lower rank than its own, and a token may be met by several splits."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bcab", b"ab", b"aaa", b"aa", b"aaaa", b"cab", b"bc", b"abab"]
    path = tmp_path / "odd"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    lib, own, r = library(path, r"\S+|\s+"), bytebpe.Replay(str(path), r"\S+|\s+"), random.Random(3)
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 40))) for _ in range(3000)]
    assert ids_of(own, texts) == [lib.encode_ordinary(t) for t in texts]


def test_documents(spark, sf, lib):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {}
    for d in docs.collect():
        ids = lib.encode_ordinary(d.text)
        want[d.doc_id] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode_bytes(ids)).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_byte_bpe_encode_decode(spark, sf).collect()}
    assert got == want
    for r in bytebpe.encode_documents(docs.limit(20)).collect():
        assert bytes(r.decoded).decode() == r.text and list(map(int, r.ids.split())) == lib.encode_ordinary(r.text) and r.n_tokens == len(r.ids.split())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (1, None, 5, "x"), (None, "", 6, None), (2, " a  b ", 7, "y")], "doc_id long, text string, n_tokens int, ids string")
    got = sorted((tuple(r) for r in bytebpe.token_digests(df).collect()), key=str)
    none = hashlib.sha256(b"").hexdigest()
    assert [g[:2] for g in got] == [(1, 0), (1, 0), (2, 4), (None, 0)] and got[0][2:] == got[3][2:] == (none, none)
    assert bytebpe.encode_documents(df).columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert bytebpe.token_digests(df.limit(0)).count() == 0 == bytebpe.encode_documents(df.limit(0)).count()
