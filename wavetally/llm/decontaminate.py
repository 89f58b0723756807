"""Benchmark decontamination: SimHash windows of the items' sizes, a multi-index over Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import log, sqrt

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .hashing import shingles, word_hashes
from .shared import discard, frugal, kept, written

#: Words of a shingle.
SHINGLE = 5
#: Fingerprints within this many bits are verified. A window at a similarity of 0.8 differs in a bit with a probability of
#: acos(8 / 9) / pi = 0.151 at most, as the weights' roots are what is summed: 64 bits then differ in up to 17 with a probability of 0.995.
RADIUS = 17
#: Blocks of the fingerprint; one of them has at most RADIUS // BLOCKS differing bits.
BLOCKS = 6
#: Weighted similarity from which a document counts as contaminated.
SIMILARITY = 0.8
#: Bytes of item texts that one index holds; a larger benchmark is scanned in several passes.
INDEX_BYTES = 32 << 20
#: Documents that a task works on at a time, and shingles of a run of windows whose bits are summed at a time.
SLICE, CHUNK = 1024, 1 << 13
#: Low bits of a shingle by which most that are in no item are told at once.
FILTER_BITS = 22
#: Units of a shingle's weight in a bit sum.
UNITS = 256


def similarity(item: Counter, window: Counter, weight: dict[int, float], foreign: float) -> float:
    """Sum of the smaller weights over the sum of the larger; a shingle weighs its count times its weight, ``foreign`` if it is not in the item."""
    low = sum(min(n, window[s]) * weight[s] for s, n in item.items() if s in window)
    high = sum(n * weight[s] for s, n in item.items()) + sum(n * weight.get(s, foreign) for s, n in window.items()) - low
    return low / high if high else 0.0


class Index:
    """Items by their number of shingles, with the neighbours of each fingerprint block.

    ``items`` are ``(item_id, shingles, weights)``. A class holds the items of one size: documents are read by windows
    of that size, at every shingle. A window without any shingle of a class's items has similarity 0 with all
    of them, so only the others are fingerprinted.
    """

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], foreign: float, radius: int = RADIUS, blocks: int = BLOCKS):
        self.items, self.foreign, self.radius = [x for x in items if len(x[1])], foreign, radius
        self.widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
        self.offsets = np.cumsum([0, *self.widths[:-1]]).tolist()
        self.flips = [np.array([sum(1 << b for b in f) for r in range(radius // blocks + 1) for f in combinations(range(w), r)], np.int64) for w in self.widths]
        sizes = np.array([len(s) for _, s, _ in self.items], np.int64)
        self.sizes, of_class = np.unique(sizes, return_inverse=True)
        every = np.concatenate([s for _, s, _ in self.items]) if self.items else np.empty(0, np.uint64)
        weights = np.concatenate([w for _, _, w in self.items]) if self.items else np.empty(0)
        self.known, first = np.unique(every, return_index=True)
        self.roots = np.maximum(np.round(np.sqrt(weights[first]) * UNITS), 1).astype(np.int64)
        self.foreign_root = max(round(sqrt(foreign) * UNITS), 1)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._low(self.known)] = True
        # the classes that have a shingle: a run of ``class_of`` from ``begin[k]`` to ``begin[k + 1]``
        pairs = np.unique(np.searchsorted(self.known, every) * max(len(self.sizes), 1) + np.repeat(of_class, sizes))
        self.class_of = pairs % max(len(self.sizes), 1)
        self.begin = np.searchsorted(pairs // max(len(self.sizes), 1), np.arange(len(self.known) + 1))
        self.classes = []
        for k in range(len(self.sizes)):
            mine = np.flatnonzero(of_class == k)
            prints = np.array([self._prints(self.items[i][1], np.zeros(1, np.int64), int(self.sizes[k]))[0] for i in mine], np.uint64)
            self.classes.append((mine, prints, [self._block(prints, o, w) for o, w in zip(self.offsets, self.widths)]))

    @staticmethod
    def _low(s: np.ndarray) -> np.ndarray:
        return (s & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    @staticmethod
    def _block(prints: np.ndarray, offset: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's values in order, and the items that have them."""
        value = ((prints >> np.uint64(offset)) & np.uint64((1 << width) - 1)).astype(np.int64)
        order = np.argsort(value, kind="stable")
        return value[order], order

    def places(self, s: np.ndarray) -> np.ndarray:
        """Place of each shingle among the items' own, or -1."""
        out = np.full(len(s), -1, np.int64)
        maybe = np.flatnonzero(self.filter[self._low(s)])
        if len(maybe) and len(self.known):
            at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
            out[maybe] = np.where(self.known[at] == s[maybe], at, -1)
        return out

    def _prints(self, s: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """Fingerprints of the windows of ``size`` shingles at ``starts``: the bits set in over half of their weight."""
        at = self.places(s)
        w = np.where(at >= 0, self.roots[at], self.foreign_root) if len(self.roots) else np.full(len(s), self.foreign_root)
        out = []
        for lo in range(0, len(starts), CHUNK):
            part = starts[lo : lo + CHUNK]
            a, b = int(part[0]), int(part[-1]) + size
            bits = np.unpackbits(np.ascontiguousarray(s[a:b]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.zeros((b - a + 1, 65), np.int64)
            np.cumsum(bits * w[a:b, None], axis=0, out=sums[1:, :64])
            np.cumsum(w[a:b], out=sums[1:, 64])
            ones = sums[part - a + size] - sums[part - a]
            out.append(np.packbits(2 * ones[:, :64] > ones[:, 64:], axis=1, bitorder="little").view(np.uint64)[:, 0])
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _near(self, k: int, fs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a fingerprint of ``fs`` and an item of class ``k`` that differ in at most ``radius`` bits.

        Such a pair agrees in one of the blocks but for ``radius // blocks`` bits; these are flipped, looked up and verified.
        """
        mine, prints, tables = self.classes[k]
        found = np.zeros((len(fs), len(mine)), bool) if len(mine) <= 64 else None
        rows, cols = [], []
        for (values, order), flips, offset, width in zip(tables, self.flips, self.offsets, self.widths):
            wanted = (((fs >> np.uint64(offset)) & np.uint64((1 << width) - 1)).astype(np.int64)[:, None] ^ flips).ravel()
            begin = np.searchsorted(values, wanted)
            n = np.searchsorted(values, wanted, side="right") - begin
            hit = np.flatnonzero(n)
            n, begin = n[hit], begin[hit]
            row = np.repeat(hit // len(flips), n)
            col = order[np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(hit) else np.empty(0, np.int64)
            near = np.bitwise_count(fs[row] ^ prints[col]) <= self.radius
            if found is not None:
                found[row[near], col[near]] = True
            else:
                rows.append(row[near])
                cols.append(col[near])
        if found is not None:
            row, col = np.nonzero(found)
        else:
            row, col = np.divmod(np.unique(np.concatenate(rows) * len(mine) + np.concatenate(cols)), len(mine))
        return row, mine[col]

    def candidates(self, s: np.ndarray, at: np.ndarray, doc: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(document, item, start, stop)`` of the windows whose fingerprint is near an item's.

        ``at`` are the places of all shingles ``s``, ``doc`` their documents and ``begins`` and ``ends`` the documents' shingles.
        """
        hits = np.flatnonzero(at >= 0)
        n = self.begin[at[hits] + 1] - self.begin[at[hits]]
        where = np.repeat(hits, n)
        klass = self.class_of[np.repeat(self.begin[at[hits]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if len(hits) else np.empty(0, np.int64)
        order = np.lexsort((where, klass))
        where, klass = where[order], klass[order]
        for k in np.unique(klass).tolist():
            size, own = int(self.sizes[k]), where[klass == k]
            d = doc[own]
            short = ends[d] - begins[d] <= size  # the whole document is the only window
            for x in np.unique(d[short]).tolist():
                a, b = int(begins[x]), int(ends[x])
                _, items = self._near(k, self._prints(s[a:b], np.zeros(1, np.int64), b - a))
                yield from ((x, i, a, b) for i in items.tolist())
            own, d = own[~short], d[~short]
            if not len(own):
                continue
            lo, hi = np.maximum(own - size + 1, begins[d]), np.minimum(own, ends[d] - size)
            # windows of one document that have hits not far from each other are read as one run
            new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (lo[1:] > np.maximum.accumulate(hi)[:-1] + 1))))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(own)]):
                first, last = int(lo[a]), int(hi[a:b].max())
                row, items = self._near(k, self._prints(s[first : last + size], np.arange(last - first + 1), size))
                yield from ((int(d[a]), i, first + r, first + r + size) for r, i in zip(row.tolist(), items.tolist()))

    def matches(self, texts: list) -> list[dict[int, tuple[float, int]]]:
        """For each text, its items with the similarity of the best of their windows that were found, and the word it starts at."""
        out: list[dict[int, tuple[float, int]]] = []
        for i in range(0, len(texts), SLICE):
            out += self._matches(texts[i : i + SLICE])
        return out

    def _matches(self, texts: list) -> list[dict[int, tuple[float, int]]]:
        h, n = word_hashes(texts)
        best: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        s = shingles(h, SHINGLE)
        if not len(s) or not len(self.known):
            return best
        word_ends = np.cumsum(n)
        begins, ends = word_ends - n, np.maximum(word_ends - SHINGLE + 1, word_ends - n)
        doc = np.repeat(np.arange(len(n)), n)[: len(s)]
        inside = np.arange(len(s)) < ends[doc]  # shingles that reach over a document's end are none
        at = np.where(inside, self.places(s), -1)
        bags: dict[int, tuple[Counter, dict[int, float]]] = {}
        for d, i, a, b in self.candidates(s, at, doc, begins, ends):
            if i not in bags:
                name, own, w = self.items[i]
                bags[i] = Counter(own.tolist()), dict(zip(own.tolist(), w.tolist()))
            sim, name = similarity(bags[i][0], Counter(s[a:b].tolist()), bags[i][1], self.foreign), self.items[i][0]
            if name not in best[d] or (sim, begins[d] - a) > (best[d][name][0], -best[d][name][1]):
                best[d][name] = (sim, int(a - begins[d]))
        return best


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """A written table ``(key, item_id, bytes, shingles, shared, counts)``, a row for each item row with an id and a text.

    ``shared`` are those of its shingles that other item rows have as well, and ``counts`` how many rows
    have them, counted over the whole benchmark.
    """
    rows = benchmark.where("text is not null and item_id is not null").select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("long").alias("item_id"), "text")

    def make(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = [shingles(word_hashes([t])[0], SHINGLE).view(np.int64) for t in texts]
            columns = [batch.column("key"), batch.column("item_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(own, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "item_id", "bytes", "shingles"])

    items = written(rows.mapInArrow(frugal(make), "key long, item_id long, bytes long, shingles array<long>"), "items")
    each = items.select("key", F.explode(F.array_distinct("shingles")).alias("s"))
    shared = each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    of_item = each.join(shared, "s").groupBy("key").agg(F.collect_list("s").alias("shared"), F.collect_list("n").alias("counts"))
    weighted = written(items.join(of_item, "key", "left"), "weighted")
    discard(items)
    return weighted


def item_groups(benchmark: DataFrame, most: int = INDEX_BYTES) -> Iterator[bytes]:
    """Pickled groups of items, each of about ``most`` bytes of text (or one item), with the shingles' weights, and the weight of any other.

    A shingle of c of n items weighs ``log(1 + n / c)``, with c and n of the whole benchmark, and one that is
    not in the item at hand ``log(1 + n)``; so an item's similarities do not depend on its group. The
    driver holds one group at a time, and a benchmark of any size is worked through in groups.
    """
    rows = item_shingles(benchmark)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    groups = max(1, -(-int(total) // most))
    for g in range(groups):
        items = []
        for r in rows.where(F.pmod(F.xxhash64("key"), F.lit(groups)) == g).orderBy("item_id", "key").toLocalIterator():
            own = np.array(r["shingles"], np.int64)
            count = dict(zip(r["shared"] or [], r["counts"] or []))
            items.append((r["item_id"], own.view(np.uint64), np.log(1 + n / np.array([count.get(s, 1) for s in own.tolist()], float)) if len(own) else np.empty(0)))
        yield pickle.dumps((items, log(1 + n)))
    discard(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), radius: int = RADIUS, least: float = SIMILARITY, blocks: int = BLOCKS) -> DataFrame:
    """``(*keep, item_id, similarity, word)`` for each document row and item that it holds a near copy of.

    ``docs`` are scanned whole, once for each group of items; ``similarity`` is that of the best window of the item's
    number of shingles (a shorter document is one window), ``word`` where it starts. Every window that shares a shingle with items
    of its size is fingerprinted; all items within ``radius`` bits are found and verified exactly. Null texts and
    documents or items of under five words match nothing; texts of any length are read whole; repeated documents give
    repeated rows, items with one id one row; columns that are kept pass as they are; an empty table gives no rows.
    """
    docs = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    schema = docs.drop("text").select("*", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("word")).schema
    sc, out, names = docs.sparkSession.sparkContext, None, schema.names
    for told in item_groups(benchmark):
        sent = sc.broadcast(told)

        def scan(batches: Iterable, sent=sent) -> Iterator:
            import pyarrow as pa

            items, foreign = pickle.loads(sent.value)
            index = Index(items, foreign, radius, blocks)
            for batch in batches:
                found = [(i, item, sim, word) for i, got in enumerate(index.matches(batch.column("text").to_pylist())) for item, (sim, word) in got.items() if sim >= least]
                if found:
                    rows, item, sim, word = zip(*found)
                    own = batch.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(len(names) - 3)), pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(word, pa.int64())], names=names)

        got = docs.mapInArrow(frugal(scan), schema)
        out = got if out is None else out.unionByName(got)
    return out.toDF(*keep, *names[-3:])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a near copy of a benchmark item; see :func:`contaminated`.

    Null, short and clean texts stay, repeated rows are treated alike, and all columns pass as they are.
    """
    for told in item_groups(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(told)

        def clean(batches: Iterable[list], sent=sent) -> Iterator[list]:
            items, foreign = pickle.loads(sent.value)
            index = Index(items, foreign)
            for texts in batches:
                yield [not any(sim >= SIMILARITY for sim, _ in got.values()) for got in index.matches(texts)]

        docs = kept(docs, text, clean)
    return docs
