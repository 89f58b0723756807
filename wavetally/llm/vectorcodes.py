"""Vectors as codes of codebook entries, each part's nearest entry found by a near-neighbour tree over the entries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import frugal, written

#: Parts of a vector, entries of a codebook, and rounds of assignment and replacement.
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components become floor(SCALE * x).
SCALE = 256
#: Split points of a tree's node, and entries up to which a node is searched whole.
SPLITS, LEAF = 6, 6
#: Vectors that are worked on at a time.
BATCH = 8192
#: Integers up to this size have squared distances that fit into 64 bits; larger ones are worked on as integers of any size.
PLAIN = 1 << 25
#: Sums travel as digits to this base, so that they are exact at any size.
DIGIT = 1 << 32
#: Labels whose sums are broadcast; those of further labels are joined by a shuffle.
BROADCAST = 1 << 16
#: Distances are bounded from both sides with this relative margin, far above the error of a root.
MARGIN = 2.0**-40


def square_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two integer arrays, exact."""
    d = x[:, None, :] - y[None, :, :]
    return (d * d).sum(axis=2)


def roots(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers certainly not above and not below the roots of squared distances."""
    if d.dtype == object:
        low = np.frompyfunc(math.isqrt, 1, 1)(d)
        return low, low + 1
    r = np.sqrt(d.astype(np.float64))
    return r * (1 - MARGIN), r * (1 + MARGIN)


class Node:
    """Split points, the other entries dealt to their nearest split point, and the range of each group's distances to every split point."""

    def __init__(self, entries: np.ndarray, own: np.ndarray):
        self.points, self.children, self.ranges = own, [], []
        if len(own) <= LEAF:
            return
        d = square_distances(entries[own], entries[own])
        split = [0]
        far = d[0].copy()
        while len(split) < SPLITS and far.max() > 0:
            split.append(int(far.argmax()))
            far = np.minimum(far, d[split[-1]])
        self.points = own[split]
        rest = np.array([k for k in range(len(own)) if k not in split], np.int64)
        near = d[np.ix_(rest, split)].argmin(axis=1)
        for j in range(len(split)):
            group = rest[near == j]
            if len(group):
                low, high = roots(d[np.ix_(group, split)])
                self.children.append(Node(entries, own[group]))
                self.ranges.append((low.min(axis=0), high.max(axis=0)))


class Tree:
    """A geometric near-neighbour access tree over a codebook's entries."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.root = entries, Node(entries, np.arange(len(entries)))
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's nearest entry, the first of equal ones, and its squared distance.

        A group of entries is passed over for a query only if its range of distances to some split point shows, after
        rounding against it, that all its entries are farther than the best so far; equal ones are still looked
        at, and compared as integers.
        """
        best = np.full(len(x), -1, x.dtype)
        index = np.full(len(x), len(self.entries), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            d = square_distances(x[at], self.entries[node.points])
            self.measured += d.size
            for k, e in enumerate(node.points.tolist()):
                better = (best[at] < 0) | (d[:, k] < best[at]) | ((d[:, k] == best[at]) & (e < index[at]))
                best[at[better]], index[at[better]] = d[better, k], e
            if node.children:
                low, high = roots(d)
                reach = roots(best[at])[1]
                for child, (least, most) in zip(node.children, node.ranges):
                    outside = ((low - most[None, :] > reach[:, None]) | (least[None, :] - high > reach[:, None])).any(axis=1)
                    if not outside.all():
                        todo.append((child, at[~outside.astype(bool)]))
        return index, best


def integers(vectors: list, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of rows of equal length, exact for every finite number."""
    x = np.array(vectors, np.float64)
    if not x.size or np.abs(x).max() * scale < PLAIN:
        return np.floor(x * scale).astype(np.int64)
    return np.frompyfunc(lambda v: (int(v) if abs(v) >= 1 << 53 else 0) * scale or math.floor(v * scale), 1, 1)(x)


def cuts(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end: equal ones, or the first ones longer by one if they cannot be."""
    ends = np.cumsum([width // parts + (k < width % parts) for k in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def assign(x: np.ndarray, trees: list[Tree], where: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part of each row, and the squared distances summed over parts."""
    found = [t.nearest(x[:, a:b].astype(object) if t.entries.dtype == object else x[:, a:b]) for t, (a, b) in zip(trees, where)]
    return np.stack([i for i, _ in found], axis=1), sum(d for _, d in found)


def _trees(books: list[np.ndarray], x: np.ndarray) -> list[Tree]:
    return [Tree(b.astype(object) if x.dtype == object else b) for b in books]


class Coder:
    """Codebooks with their trees: one for plain integers, one for integers of any size, made when it is needed."""

    def __init__(self, books: list[np.ndarray], where: list[tuple[int, int]]):
        self.books, self.where, self.trees = books, where, {}

    def __call__(self, vectors: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = integers(vectors)
        if any(b.dtype == object for b in self.books):
            x = x.astype(object)
        kind = x.dtype == object
        if kind not in self.trees:
            self.trees[kind] = _trees(self.books, x)
        return x, *assign(x, self.trees[kind], self.where)


def sound_vectors(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``(vec_id, x, label)`` of the rows whose vector has components, none of them null or non-finite."""
    x = F.col("x")
    got = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"), F.col(label).alias("label")).where(x.isNotNull() & (F.size(x) > 0))
    return got.where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def _narrow(books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks as plain integers where all of them are small enough."""
    small = all(abs(int(v)) < PLAIN for b in books for v in b.ravel().tolist())
    return [b.astype(np.int64 if small else object) for b in books]


def _digits(v: int) -> Iterator[tuple[int, int]]:
    """Place and value of the digits of ``v``, all with its sign."""
    sign, v, k = (-1 if v < 0 else 1), abs(v), 0
    while v:
        v, low = divmod(v, DIGIT)
        if low:
            yield k, sign * low
        k += 1


def replaced(vectors: DataFrame, books: list[np.ndarray], where: list[tuple[int, int]]) -> list[np.ndarray]:
    """Codebooks with each entry replaced by the floor of its parts' mean; an entry without parts stays.

    Tasks add up their own rows first; what is shuffled and collected is a row for each
    part, entry, component and digit of the sum.
    """

    def sums(pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(books, where)
        total = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
        for pdf in pdfs:
            for lo in range(0, len(pdf), BATCH):
                x, index, _ = coder(pdf["x"].iloc[lo : lo + BATCH].tolist())
                for p, (a, b) in enumerate(where):
                    own = np.zeros((len(books[p]), b - a + 1), x.dtype)
                    np.add.at(own, index[:, p], np.concatenate((x[:, a:b], np.ones((len(x), 1), x.dtype)), axis=1))
                    total[p] = total[p] + own
        rows = [(p, e, c, k, d) for p, t in enumerate(total) for (e, c), v in np.ndenumerate(t) for k, d in _digits(int(v))]
        yield pd.DataFrame(rows, columns=["part", "entry", "component", "place", "digit"])

    told = vectors.select("x").mapInPandas(frugal(sums), "part int, entry int, component int, place int, digit long")
    total = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
    for r in told.groupBy("part", "entry", "component", "place").agg(F.sum("digit").alias("digit")).collect():  # bounded by the codebooks' size
        total[r["part"]][r["entry"], r["component"]] += r["digit"] * DIGIT ** r["place"]
    out = []
    for b, t in zip(books, total):
        n = t[:, -1:]
        used = (n > 0)[:, 0].astype(bool)
        new = b.astype(object)
        new[used] = t[used, :-1] // n[used]
        out.append(new)
    return _narrow(out)


def first_books(vectors: DataFrame, entries: int = ENTRIES) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """The parts of the vectors with the smallest ids, as codebooks, and where the parts are; of rows with one id, the smaller vector first."""
    first = vectors.where("vec_id is not null").select("vec_id", "x").orderBy("vec_id", "x").limit(entries).collect()  # bounded: the codebooks
    if not first:
        return [], []
    width = len(first[0]["x"])
    x = integers([r["x"] for r in first if len(r["x"]) == width])
    where = cuts(width)
    return _narrow([x[:, a:b] for a, b in where]), where


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def encode_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, code, error)`` for each sound vector, and the codebooks of its parts.

    ``code`` has the index of each part's entry as two hexadecimal digits, ``error`` is the squared distance of the
    vector to what its code stands for, as integers; null if it has more than 63 bits.

    Every round reads all vectors; what meets on the driver are codebooks. Each part's entries are in a tree that finds
    the nearest entry, so that ties go to the lower index. Vectors of another length than that of the smallest
    id have no code and are left out; null ids have a code but take no part in the first codebooks; repeated rows repeat;
    further columns are ignored; an empty table gives no rows and no codebooks.
    """
    vectors = sound_vectors(rows, vec_id, embedding, label)
    schema = vectors.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")).schema
    books, where = first_books(vectors)
    if not books:
        return rows.sparkSession.createDataFrame([], schema), []
    vectors = vectors.where(F.size("x") == where[-1][1])
    for _ in range(ROUNDS):
        books = replaced(vectors, books, where)

    def encode(batches: Iterable) -> Iterator:
        import pyarrow as pa

        coder = Coder(books, where)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                x = part.column(part.schema.get_field_index("x"))
                _, index, error = coder(x.values.slice(x.offsets[0].as_py(), len(part) * where[-1][1]).to_numpy(zero_copy_only=False).reshape(len(part), -1))
                code = index.astype(np.uint8).tobytes().hex()
                step = 2 * len(where)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("vec_id")),
                        part.column(part.schema.get_field_index("label")),
                        pa.array([code[k : k + step] for k in range(0, len(code), step)], pa.string()),
                        pa.array([v if v < 1 << 63 else None for v in map(int, error.tolist())], pa.int64()),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    return vectors.mapInArrow(frugal(encode), schema), books


def compressed(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for each sound vector; see :func:`encode_vectors`.

    ``label_error`` sums the errors of equal labels, nulls together; it is null where one of them is, or the sum has more than
    63 bits. The sums of the labels with most rows are broadcast, those of the others are joined by a shuffle, so that no
    label's rows meet in one task.
    """
    codes, books = encode_vectors(rows, vec_id, embedding, label)
    codes = written(codes, "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = codes.groupBy("label").agg(F.count("*").alias("n"), F.when((F.count("error") == F.count("*")) & (total <= (1 << 63) - 1), total.cast("long")).alias("label_error"))
    sums = written(sums, "sums")
    out = ["vec_id", "code", "error", "label_error"]
    large = F.broadcast(sums.orderBy(F.desc("n"), "label").limit(BROADCAST).select(F.col("label").alias("l"), "label_error", F.lit(True).alias("large")))  # BROADCAST rows at most
    joined = codes.join(large, F.col("label").eqNullSafe(F.col("l")), "left")
    if sums.count() > BROADCAST:
        small = sums.select(F.col("label").alias("k"), F.col("label_error").alias("e"))
        rest = joined.where("large is null").join(small, F.col("label").eqNullSafe(F.col("k"))).select("vec_id", "code", "error", F.col("e").alias("label_error"))
        joined = joined.where("large").select(*out).unionByName(rest)
    return joined.select(*out).withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))
