"""Byte-level byte-pair encoding by a replay of all merges over the distinct words of a run of texts."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import batched
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .bpe import NEW_LETTERS, NEW_NUMBERS, _class_of
from .shared import added

#: White space as the split pattern means it.
SPACES = "\t-\r \x85\xa0  -     　"
#: Characters of texts whose words are replayed together, and words of a long text that are held at a time.
TOGETHER, WORDS = 1 << 22, 1 << 18
#: Words that a worker remembers of late; it keeps as many older ones. Longer words are not remembered.
REMEMBERED, LONG = 200_000, 64
#: What stands in the symbols between two words, so that no pair spans them.
_END = -1


def default_ranks() -> str:
    """The installed file of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def splitter(pattern: str, letters: str, numbers: str, spaces: str) -> re.Pattern:
    """``pattern`` with its classes of letters, numbers and white space written out, so that they do not depend on an engine's tables."""
    for name, inside in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", spaces)):
        pattern = pattern.replace(name + "+", f"[{inside}]+").replace(name, inside)
    return re.compile(pattern.replace(r"\S", f"[^{spaces}]"))


def _sorted(x: np.ndarray) -> np.ndarray:
    """``x`` in order and without repeats."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


class Replay:
    """A vocabulary of byte strings by rank, and the words whose tokens it has found."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            told = [line.split() for line in f if line.strip()]
        self.tokens = {int(rank): base64.b64decode(token) for token, rank in told}
        self.ranks = {token: rank for rank, token in self.tokens.items()}
        self.letters = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.names = {rank: str(rank) for rank in self.tokens}
        self.base = max(self.tokens) + 1
        rank_of = self.ranks.get
        splits = ((rank_of(t[:k]), rank_of(t[k:]), r) for t, r in self.ranks.items() for k in range(1, len(t)))
        self.pairs = {a * self.base + b: r for a, b, r in splits if a is not None and b is not None}
        self.keys, self.values = np.array(sorted(self.pairs.items()), np.int64).reshape(-1, 2).T.copy()
        self.latin = splitter(pattern, "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0")
        self.pattern, self.all = pattern, None
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def split(self, text: str) -> re.Pattern:
        """The pattern that splits ``text`` into words."""
        try:
            text.encode("latin-1")
            return self.latin
        except UnicodeEncodeError:
            self.all = self.all or splitter(self.pattern, _class_of("L", NEW_LETTERS), _class_of("N", NEW_NUMBERS), SPACES)
            return self.all

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 for none."""
        key = a * self.base + b
        key[(a < 0) | (b < 0)] = -1
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[found] == key, self.values[found], -1)

    def _alone(self, symbols: list[int]) -> list[int]:
        """One word's merges by plain search."""
        while len(symbols) > 1:
            r, i = min((self.pairs.get(a * self.base + b, self.base), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if r == self.base:
                break
            symbols[i : i + 2] = [r]
        return symbols

    def merge(self, words: list[bytes]) -> Iterator[list[int]]:
        """Tokens of each word: the merges in order of rank, each wherever its pair stands.

        An inverted index leads from a pair's rank to the places where it stands, in all words. The lowest
        rank that stands anywhere is merged at all its places, of overlapping ones at the left; only the two
        pairs beside each merge are looked up, and entered in the index. As that rank is also the lowest in each word that
        has it, every word goes through its own merges in their right order, unless a merge makes a pair of a lower rank
        than its own, which no trained vocabulary does: such words are done by themselves.
        """
        if not words:
            return
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words])
        at = np.full(int(ends[-1]) + 2, _END, np.int64)  # with an end before the first and behind the last
        ends += 1
        inside = np.ones(len(at), bool)
        inside[ends - 1] = inside[0] = inside[-1] = False
        at[inside] = self.letters[raw]
        after, before = np.arange(1, len(at) + 1), np.arange(-1, len(at) - 1)
        now = np.full(len(at), -1, np.int64)
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []
        odd: set[int] = set()

        def enter(places: np.ndarray, least: int) -> None:
            rank = now[places] = self._ranks_of(at[places], at[after[places]])
            own, places = np.divmod(_sorted((rank * len(at) + places)[rank >= 0]), len(at))
            if len(own) and own[0] < least:
                odd.update(np.searchsorted(ends, places[own < least], "right").tolist())
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for r, p in zip(own[np.concatenate(([0], cuts))].tolist() if len(own) else [], np.split(places, cuts)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heappush(waiting, r)

        enter(np.arange(len(at) - 1), -1)
        while waiting:
            r = heappop(waiting)
            found = index.pop(r)
            left = _sorted(np.concatenate(found)) if len(found) > 1 else found[0]
            left = left[now[left] == r]  # others have been merged away, or have become another pair
            if not len(left):
                continue
            chained = np.concatenate(([False], after[left[:-1]] == left[1:]))
            if chained.any():
                heads = np.maximum.accumulate(np.where(chained, 0, np.arange(len(left))))
                left = left[(np.arange(len(left)) - heads) % 2 == 0]
            right = after[left]
            following = after[right]
            next_too = np.flatnonzero(following[:-1] == left[1:])  # for a moment, what is merged stands beside the next place's own left symbol
            if len(next_too):
                beside = self._ranks_of(np.full(len(next_too), r), at[following[next_too]])
                odd.update(np.searchsorted(ends, left[next_too[(beside >= 0) & (beside < r)]], "right").tolist())
            at[left], at[right], now[right] = r, _END, -1
            after[left], before[following] = following, left
            enter(np.concatenate((before[left], left)), r)
        kept = at >= 0
        counts = np.add.reduceat(kept, np.concatenate(([1], ends[:-1])), dtype=np.int64).tolist()
        flat, start = at[kept].tolist(), 0
        for k, n in enumerate(counts):
            yield self._alone(self.letters[list(words[k])].tolist()) if k in odd else flat[start : start + n]
            start += n

    def learn(self, words: Iterable[str]) -> dict[str, tuple[str, bytes]]:
        """``(ids, decoded)`` by word, for at least ``words``: those that are in no memory are replayed together."""
        new, found = [], self.known
        if len(found) >= REMEMBERED:
            self.older, found = found, {}
        extra = {}
        for w in words:
            if w not in found:
                got = self.older.get(w)
                if got is not None:
                    found[w] = got
                else:
                    new.append(w)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        whole = [self.ranks.get(b) for b in raw]
        merged = self.merge([b for b, r in zip(raw, whole) if r is None])
        for w, r in zip(new, whole):
            ids = next(merged) if r is None else [r]
            (found if len(w) <= LONG else extra)[w] = " ".join(map(self.names.__getitem__, ids)), self.decode(ids)
        self.known = found
        return found | extra if extra else found

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, texts: list) -> Iterator[Iterator[list[tuple[str, bytes]]]]:
        """For each text (None: empty) its words' tokens, in parts; each text's parts must be used before the next one's."""
        group: list[list[str]] = []
        size = 0

        def told() -> Iterator[Iterator[list]]:
            known = self.learn(set().union(*group))
            for own in group:
                yield iter([list(map(known.__getitem__, own))] if own else [])

        def long(t: str) -> Iterator[list]:
            for part in batched(map(re.Match.group, self.split(t).finditer(t)), WORDS):
                known = self.learn(set(part))
                yield list(map(known.__getitem__, part))

        for t in texts:
            t = t or ""
            if size + len(t) > TOGETHER and group:
                yield from told()
                group, size = [], 0
            if len(t) > TOGETHER:
                yield long(t)
            else:
                group.append(self.split(t).findall(t))
                size += len(t)
        if group:
            yield from told()


@lru_cache(maxsize=1)
def replay(path: str, pattern: str) -> Replay:
    """The process's vocabulary: tasks that follow one another in a worker share its words."""
    return Replay(path, pattern)


def encode_documents(docs: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` (decimal, joined by spaces) and ``decoded`` (the bytes that these ids stand for).

    Each match of ``pattern`` is encoded by itself: a word of the vocabulary is its token, others are merged by rank.
    A null text counts as empty; texts of any length are encoded whole, long ones in parts; special tokens' strings are ordinary text.
    Columns of these names are replaced. The file of ranks must be at the same path on every executor; ``pattern`` may
    name letters, numbers and white space as ``default_pattern`` does.
    """
    path, split = ranks or default_ranks(), pattern or default_pattern()

    def make(batches: Iterable[list]) -> Iterator[tuple]:
        r = replay(path, split)
        for texts in batches:
            out: tuple[list, list, list] = ([], [], [])
            for parts in r.encode(texts):
                words = [w for part in parts for w in part]
                ids = " ".join(map(itemgetter(0), words))
                out[0].append(ids.count(" ") + 1 if ids else 0)
                out[1].append(ids)
                out[2].append(b"".join(map(itemgetter(1), words)))
            yield out

    return added(docs.drop("n_tokens", "ids", "decoded"), text, make, "n_tokens long, ids string, decoded binary")


def token_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``; the digests are made where the tokens are.

    Null and empty texts have no tokens; texts of any length are encoded whole; repeated rows repeat, a null doc_id
    stays null; other columns are ignored; an empty table gives no rows.
    """
    path, split = ranks or default_ranks(), pattern or default_pattern()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def make(batches: Iterable[list]) -> Iterator[tuple]:
        r = replay(path, split)
        for texts in batches:
            out: tuple[list, list, list] = ([], [], [])
            for parts in r.encode(texts):
                n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
                for part in parts:
                    own = " ".join(map(itemgetter(0), part)).encode()
                    ids.update(b" " + own if n else own)
                    decoded.update(b"".join(map(itemgetter(1), part)))
                    n += own.count(b" ") + 1
                out[0].append(n)
                out[1].append(ids.hexdigest())
                out[2].append(decoded.hexdigest())
            yield out

    return added(rows, "text", make, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id"])
