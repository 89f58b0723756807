"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from operator import itemgetter

import regex
from pyspark.sql import DataFrame, functions as F

from .shared import added

#: Fixed values of the vocabulary file's pre-tokenizer.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
NO_RANK = 1 << 60


def default_vocabulary() -> str:
    """The installed file of the word-end vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


#: Letters, numbers and lower-case forms of newer characters than the interpreter's own tables may have.
NEW_LETTERS = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5"
    "\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0"
)
NEW_NUMBERS = "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa"
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}

NEW_UPPER = regex.compile("[" + "".join(map(chr, NEW_LOWER)) + "]").search


@cache
def _class_of(kind: str, more: str) -> str:
    """Ranges, for a character class, of the characters whose general category begins with ``kind``, and ``more``."""
    out, start = [more], None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c)).startswith(kind)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@cache
def _all_pieces() -> "regex.Pattern":
    """The pieces' pattern for characters beyond Latin-1, with classes that do not depend on an engine's own tables."""
    return regex.compile(PIECES.replace(r"\p{L}", _class_of("L", NEW_LETTERS)).replace(r"\p{N}", _class_of("N", NEW_NUMBERS)))


def merge_word(symbols: list[int], ranks: dict[int, int], merged: list[int], base: int) -> list[int]:
    """Merge the leftmost pair of the lowest rank until no pair has one.

    ``ranks`` has the rank of the pair (a, b) at ``a * base + b``, ``merged`` the symbol that a rank gives. A segment
    tree over the pairs holds rank and place in one number, so that its root tells the leftmost
    pair of the lowest rank; a merge updates the pairs beside it in logarithmic
    time. A neighbour list skips the symbols merged away.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    get = ranks.get
    leaves = [NO_RANK if (r := get(a * base + b)) is None else r * n + i for i, (a, b) in enumerate(zip(symbols, symbols[1:]))]
    leaves += [NO_RANK] * (size - n + 1)
    rows = [leaves]
    while len(leaves) > 1:
        leaves = list(map(min, leaves[0::2], leaves[1::2]))
        rows.append(leaves)
    tree = [NO_RANK]
    for row in reversed(rows):
        tree += row
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (best := tree[1]) != NO_RANK:
        rank, i = divmod(best, n)
        j = after[i]
        own = symbols[i] = merged[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        touched = [size + i]
        if k < n:
            before[k] = i
            tree[size + j] = NO_RANK
            touched.append(size + j)
            tree[size + i] = NO_RANK if (r := get(own * base + symbols[k])) is None else r * n + i
        else:
            tree[size + i] = NO_RANK
        if (h := before[i]) >= 0:
            tree[size + h] = NO_RANK if (r := get(symbols[h] * base + own)) is None else r * n + h
            touched.append(size + h)
        for t in touched:
            while t := t >> 1:
                x, y = tree[2 * t], tree[2 * t + 1]
                low = x if x < y else y
                if tree[t] == low:
                    break
                tree[t] = low
    return [s for s in symbols if s >= 0]


def _joined(parts: Iterable[tuple[int, str, str]]) -> tuple[int, str, str]:
    parts = list(parts)
    return sum(map(itemgetter(0), parts)), " ".join(map(itemgetter(1), parts)), " ".join(map(itemgetter(2), parts))


class Cache(dict):
    """Tokens of pieces: ``(n_tokens, ids, decoded)``.

    Keeps ``most`` pieces that were met last, and as many older ones; a piece met again counts as new.
    """

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most, self.older = encode, most, {}

    def __missing__(self, word: str) -> tuple[int, str, str]:
        got = self.older.get(word) or self.encode(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = got
        return got


class Encoder:
    """Encodes and decodes texts as the vocabulary file says."""

    def __init__(self, path: str, cached: int = 200_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.ids: dict[str, int] = told["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in told["model"]["merges"]]
        self.base = len(self.ids)
        self.ranks = {self.ids[a] * self.base + self.ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        self.added_ids = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added_ids.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added_ids, key=len, reverse=True))) + ")") if self.added_ids else None
        self.latin_pieces = regex.compile(PIECES).findall
        self.letters = [self.ids[c] for c in byte_letters()]
        self.last_letters = [self.ids[c + WORD_END] for c in byte_letters()]
        self.known = Cache(self._tokens, cached)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces of a normalized text."""
        try:
            text.encode("latin-1")
            return self.latin_pieces(text)
        except UnicodeEncodeError:
            return _all_pieces().findall(text)

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8", "surrogatepass")
        letters = list(map(self.letters.__getitem__, raw))
        letters[-1] = self.last_letters[raw[-1]]
        return merge_word(letters, self.ranks, self.merged, self.base)

    def _tokens(self, piece: str) -> tuple[int, str, str]:
        ids = self.encode_piece(piece)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by a space: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)

    def normalize(self, text: str) -> str:
        """NFC, then lower case by single characters; white space only separates pieces."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.translate(NEW_LOWER) if not text.isascii() and NEW_UPPER(text) else text

    def _plain(self, text: str) -> list[tuple[int, str, str]]:
        return list(map(self.known.__getitem__, self.pieces(self.normalize(text))))

    def encode(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, ids and decoded tokens joined by a space."""
        text = text or ""
        if any(t in text for t in self.added_ids):
            out = []
            for part in self.split_added.split(text):
                out += [(1, str(self.added_ids[part]), part)] if part in self.added_ids else self._plain(part)
        else:
            out = self._plain(text)
        return _joined(out)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The process's encoder: tasks that follow one another in a worker share its pieces."""
    return Encoder(path)


def encode_documents(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``decoded`` (both joined by spaces); a null text counts as empty.

    Columns of these names are replaced. Whole texts of any length; special tokens' strings in a text become those
    tokens. The vocabulary file must be at the same path on every executor.
    """
    path = vocabulary or default_vocabulary()

    def make(batches: Iterable[list]) -> Iterator[tuple]:
        e = encoder(path)
        for texts in batches:
            yield tuple(zip(*map(e.encode, texts))) or ((), (), ())

    return added(docs.drop("n_tokens", "ids", "decoded"), text, make, "n_tokens long, ids string, decoded string")


def token_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``; the digests are made where the tokens are.

    Null and empty texts have no tokens; texts of any length are encoded whole; repeated rows repeat, a null doc_id
    stays null; other columns are ignored; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def make(batches: Iterable[list]) -> Iterator[tuple]:
        e, sha = encoder(path), lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for texts in batches:
            rows = [(n, sha(ids), sha(decoded)) for n, ids, decoded in map(e.encode, texts)]
            yield tuple(zip(*rows)) or ((), (), ())

    return added(rows, "text", make, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])
