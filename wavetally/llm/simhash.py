"""SimHash fingerprints and their near-duplicate groups by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .shared import added, discard, frugal, plain_names, written

#: Shingles whose bits are counted at a time, which bounds the memory of very long texts.
CHUNK = 1 << 15

#: Words of 64 bits in a fingerprint of the near-copy stage.
WORDS = 4
#: Most differing bits in the first and in the further words that the near-copy stage verifies: at a set similarity of 0.8, 10 and 29 are expected, and sets of a few shingles have up to 12 and 36.
LIKELY, LIKELY_WIDE = 24, 56
#: Share of the pairs at the least similarity that the near-copy stage's plan may miss.
MISSED = 0.0003
#: Distinct shingles up to which a set has further unsure bits flipped, by number: sums of so few signs are often equal.
SMALL = ((9, 2), (64, 1))
#: Shingles that a block of the exact comparison holds.
BLOCK_SHINGLES = 1 << 17


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, split at space and the characters 9 to 13."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(ws: list[bytes], n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``n`` words joined by a space, repeats included; of the whole sequence if it is shorter."""
    if not ws:
        return np.empty(0, np.uint64)
    line = b" ".join(ws)
    if len(ws) <= n:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    lens = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(ws) - n + 1].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist())), np.uint64, len(starts))


def _spread(h: np.ndarray, seed: int) -> np.ndarray:
    x = h ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of ``h``, as a signed integer; 0 without any."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        part = np.ascontiguousarray(h[i : i + CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def add_fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``carry``, or all) with ``_f0``, the fingerprint as a signed integer; null text counts as empty."""

    def make(batches: Iterable[list]) -> Iterator[tuple]:
        for texts in batches:
            yield (np.array([majority(shingle_hashes(words(t), shingle)) for t in texts], np.int64),)

    return added(docs, text, make, "_f0 long", carry)


def bit_statistics(prints: DataFrame, word: str = "_f0") -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows of ``prints``, share of ones per bit of its column ``word``, and the bits' correlations; sums over all rows."""

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = np.zeros((65, 64))
        for pdf in batches:
            b = np.unpackbits(pdf[word].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            c[:64] += b.T @ b
            c[64, 0] += len(b)
        i, j = np.nonzero(c)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": c[i, j]})

    c = np.zeros((65, 64))
    for i, j, s in prints.select(word).mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():  # 65 x 64 rows at most
        c[i, j] = s
    n = max(c[64, 0], 1)
    p = np.diag(c[:64]) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return int(c[64, 0]), p, (c[:64] / n - np.outer(p, p)) / np.outer(sd, sd)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Deal the 64 bits into ``parts``, each grown by the free bit that correlates most with it."""
    free, out = set(range(64)), []
    strength = np.abs(corr).sum(axis=1)
    for k in range(parts):
        size = len(free) // (parts - k)
        part = [max(free, key=lambda b: (strength[b], -b))]
        free.discard(part[0])
        while len(part) < size:
            b = max(free, key=lambda b: (np.abs(corr[b, part]).sum(), -b))
            part.append(b)
            free.discard(b)
        out.append(sorted(part))
    return out


def _within(p: np.ndarray, most: int) -> float:
    """Probability that two rows differ in at most ``most`` bits whose shares of ones are ``p``."""
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for d in 2 * p * (1 - p):
        dist = dist * (1 - d) + np.concatenate(([0.0], dist[:-1])) * d
    return float(dist.sum())


def allocate(n: int, p: np.ndarray, corr: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Partitions of the bits and how many bits each key flips on either side.

    A part that flips e bits finds all pairs within 2e in it, and a part left
    out (-1) none. By the pigeonhole principle, no pair within ``radius`` is
    missed if the found distances, each plus one, add up to ``radius + 1``.
    Dynamic programming over the parts picks the cheapest such flips by the
    estimated rows and candidate pairs; the number of parts is the cheapest too.
    """
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for m in range(2, min(radius + 1, 8) + 1):
        parts = group_bits(corr, m)
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in parts:
            w, new = len(bits), {}
            for e in (-1, 0, 1, 2):
                rows = sum(comb(w, k) for k in range(e + 1))
                pairs = 0.5 * n * n * _within(p[bits], 2 * e) * (1 + e) if e >= 0 else 0.0
                cost = 3e-6 * n * rows + 4e-9 * pairs + (2e-5 * min(2.0**w, n * rows) if e >= 0 else 0)
                for got, (sofar, flips) in table.items():
                    g = min(radius + 1, got + (2 * e + 1 if e >= 0 else 0))
                    if g not in new or sofar + cost < new[g][0]:
                        new[g] = (sofar + cost, [*flips, e])
            table = new
        if radius + 1 in table and table[radius + 1][0] < best[0]:
            best = (table[radius + 1][0], [(b, e) for b, e in zip(parts, table[radius + 1][1]) if e >= 0])
    return best[1]


@lru_cache(maxsize=None)
def meeting(width: int, unsure: int, cosine: float) -> float:
    """Probability that two sets with this cosine meet in a part of ``width`` bits, each flipping any of its ``unsure`` least certain bits."""
    x, y = np.random.default_rng(11).standard_normal((2, 20_000, width))
    y = cosine * x + (1 - cosine * cosine) ** 0.5 * y
    differ = (x > 0) != (y > 0)
    if unsure:
        for z in (x, y):
            np.put_along_axis(differ, np.argpartition(np.abs(z), unsure - 1, axis=1)[:, :unsure], False, 1)
    return float(1 - differ.any(axis=1).mean())


def allocate_recall(n: int, stats: list[tuple[np.ndarray, np.ndarray]], cosine: float, missed: float = MISSED) -> list[tuple[int, list[int], int]]:
    """Partitions ``(word, bits, unsure)`` of the bits of several words, and how many unsure bits each key flips on either side.

    :func:`allocate` guarantees a radius; at the radius of near copies no flips
    that do so tell rows apart. Here the parts' probabilities of finding a pair
    with ``cosine`` take the place of the found distances: their misses multiply to at
    most ``missed``. The rest is the same: dynamic programming deals unequal flips, or leaves
    a part out, by the estimated rows and candidate pairs, and takes the cheapest number of parts.
    """
    step = 0.02
    goal = int(np.ceil(-log(missed) / step))
    best: tuple[float, list[tuple[int, list[int], int]]] = (np.inf, [])
    for m in range(2, 7):
        parts = [(k, bits) for k, (_, corr) in enumerate(stats) for bits in group_bits(corr, m)]
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for k, bits in parts:
            w, new = len(bits), {}
            met = _within(stats[k][0][bits], 0)
            for e in range(-1, 5):
                pairs = 0.5 * n * n * min(1.0, met * 4**e) if e >= 0 else 0.0
                cost = 3e-6 * n * 2**e + 8e-9 * pairs + 2e-5 * min(2.0**w, n * 2**e) if e >= 0 else 0.0
                gain = int(-log(1 - meeting(w, e, cosine)) / step) if e >= 0 else 0
                for got, (sofar, flips) in table.items():
                    g = min(goal, got + gain)
                    if g not in new or sofar + cost < new[g][0]:
                        new[g] = (sofar + cost, [*flips, e])
            table = new
        if goal in table and table[goal][0] < best[0]:
            best = (table[goal][0], [(k, b, e) for (k, b), e in zip(parts, table[goal][1]) if e >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(plan: list[tuple[list[int], int]]) -> list:
    """A struct (part, key) for each key of a row's ``_f0``."""
    out = []
    for k, (bits, e) in enumerate(plan):
        mask = F.lit(_signed(sum(1 << b for b in bits)))
        for r in range(e + 1):
            for flip in combinations(bits, r):
                key = F.col("_f0").bitwiseAND(mask)
                out.append(F.struct(F.lit(k).alias("part"), (key.bitwiseXOR(F.lit(_signed(sum(1 << b for b in flip)))) if flip else key).alias("key")))
    return out


def _linked(node: np.ndarray, prints: list[np.ndarray], limits: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's nodes: pairs of a node and its tree's smallest."""
    def near(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        ok = np.bitwise_count(prints[0][rows][:, None] ^ prints[0][cols][None, :]) <= limits[0]
        if len(prints) > 1 and ok.any():
            i, j = np.nonzero(ok)
            far = sum(np.bitwise_count(f[rows[i]] ^ f[cols[j]]).astype(np.int64) for f in prints[1:]) > limits[1]
            ok[i[far], j[far]] = False
        return ok

    n, everything = len(node), np.arange(len(node))
    linked = np.zeros(n, bool)
    for i in range(0, n, 256):
        linked[i : i + 256] = near(everything[i : i + 256], everything).sum(axis=1) > 1
    left, out = everything[linked], []
    while len(left):
        tree, front, left = [left[:1]], left[:1], left[1:]
        while len(front) and len(left):
            hit = near(front, left).any(axis=0)
            front, left = left[hit], left[~hit]
            tree.append(front)
        ids = node[np.concatenate(tree)]
        root = int(ids.min())
        out += [(int(x), root) for x in ids if x != root]
    return out


def probes(prints: DataFrame, plan: list[tuple[int, list[int], int]]) -> DataFrame:
    """``(node, _f0, .., part, key)`` for each key by ``plan`` of ``prints(node, n_shingles, _f0, .., margin)``; margin has a byte for each bit, small where it is unsure."""
    words = sorted(c for c in prints.columns if c.startswith("_f"))

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                f = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in words], axis=1)
                margin = np.frombuffer(b"".join(batch.column("margin").to_pylist()), np.uint8).reshape(len(f), -1)
                size = batch.column("n_shingles").to_numpy()
                more = np.zeros(len(f), np.int64)
                for most, k in sorted(SMALL, reverse=True):
                    more[size <= most] = k
                for k in np.unique(more):
                    rows = np.flatnonzero(more == k)
                    taken = batch.select(["node", *words]).take(pa.array(rows))
                    for part, (word, bits, unsure) in enumerate(plan):
                        unsure = min(unsure + int(k), len(bits))
                        keys = [f[rows, word] & np.uint64(sum(1 << b for b in bits))]
                        if unsure:
                            least = np.argpartition(margin[np.ix_(rows, 64 * word + np.array(bits))], unsure - 1, axis=1)[:, :unsure]
                            for flip in (np.uint64(1) << np.array(bits, np.uint64)[least]).T:
                                keys += [key ^ flip for key in keys]
                        for key in keys:
                            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.full(len(rows), part, np.int32)), pa.array(key.view(np.int64))], names=["node", *words, "part", "key"])

    return prints.mapInArrow(frugal(run), ", ".join(["node long", *(f"{c} long" for c in words), "part int, key long"]))


def simhash_links(prints: DataFrame, radius: int, wide_radius: int | None = None, block: int = 512, keyed: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)`` between nodes of ``prints(node, _f0, ..)`` with at most ``radius`` differing bits in ``_f0``.

    ``wide_radius`` bounds the differing bits of the further words as well. The
    edges span every group of linked nodes without listing all its pairs.
    Nodes meet in buckets of equal keys; a bucket of over ``block`` nodes is
    dealt over blocks, and each pair of blocks meets in a row of its own.
    ``keyed`` has other keys, from :func:`probes`, which find a stated share of the pairs instead of all.
    """
    extra = sorted(c for c in prints.columns if c.startswith("_f") and c != "_f0")
    rows = keyed
    if rows is None:
        plan = allocate(*bit_statistics(prints), radius)
        rows = prints.select("node", "_f0", *extra, F.explode(F.array(*_keys(plan))).alias("k")).select("node", "_f0", *extra, "k.part", "k.key")
    large = rows.groupBy("part", "key").agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = written(large.select("part", "key", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "large")
    rows = rows.join(large, ["part", "key"], "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    met = rows.groupBy("part", "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")).agg(*(F.collect_list(c).alias(c) for c in ["node", "_f0", *extra])).where(F.size("node") > 1)

    limits = [radius, wide_radius if wide_radius is not None else 64 * len(extra)]
    cols = ["_f0", *extra]

    def verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list[tuple[int, int]] = []
            for node, *fs in zip(pdf["node"], *(pdf[c] for c in cols)):
                node, at = np.unique(np.asarray(node, np.int64), return_index=True)
                found += _linked(node, [np.asarray(f, np.int64).view(np.uint64)[at] for f in fs], limits)
            yield pd.DataFrame(sorted(set(found)), columns=["a", "b"]).astype(np.int64)

    return met.select("node", *cols).mapInPandas(frugal(verify), "a long, b long")


def simhash_groups(prints: DataFrame, radius: int = 4, wide_radius: int | None = None) -> DataFrame:
    """``(node, root)`` for every node of ``prints(node, _f0, ..)`` that has a link; see :func:`simhash_links`."""
    return connected_components(simhash_links(prints, radius, wide_radius))


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    Documents with equal fingerprints are one node; nodes link at ``radius`` or
    fewer differing bits; component_id is the smallest doc_id of the linked
    nodes. Null and wordless texts have fingerprint zero and link like any
    other. Repeated rows stay; a null doc_id never names a component unless the
    component has no other (then null). Texts of any length count whole. Other columns of ``docs`` are ignored.
    An empty table gives no rows.
    """
    prints = written(add_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle, ["doc_id"]), "prints")
    nodes = written(prints.groupBy("_f0").agg(F.min("doc_id").alias("least")), "nodes")
    groups = written(simhash_groups(nodes.select(F.col("_f0").alias("node"), "_f0"), radius), "groups")
    named = nodes.join(groups, nodes["_f0"] == groups["node"], "left").select("_f0", "least", F.coalesce("root", "_f0").alias("root"))
    class_of = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(class_of, "root").select("_f0", "component_id"), "classes")
    return prints.join(named, "_f0", "left").select("doc_id", F.lower(F.lpad(F.hex("_f0"), 16, "0")).alias("fingerprint"), "component_id")


def wide_print(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The ``WORDS`` words of majority bits of distinct hashes, and a byte for each bit that is small where the vote is close."""
    ones = np.zeros(64 * WORDS, np.int64)
    for i in range(0, len(h), 255):  # sums of so many bits fit a byte
        part = np.stack([h[i : i + 255], *(_spread(h[i : i + 255], k) for k in range(1, WORDS))], axis=1)
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    vote = 2 * ones - len(h)
    margin = np.abs(vote)
    return np.packbits(vote > 0, bitorder="little").view(np.int64), (margin * 255 // max(int(margin.max()), 1)).astype(np.uint8).tobytes()


def add_wide_prints(docs: DataFrame, text: str, shingle: int, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` with ``set0`` and ``set1``, 128 bits that tell the text's set of shingles, its size ``n_shingles``, and its fingerprint ``_f0`` to ``_f3`` with ``margin``; see :func:`wide_print`."""

    def make(batches: Iterable[list]) -> Iterator[tuple]:
        for texts in batches:
            whole, size, prints, margins = [], [], [], []
            for t in texts:
                h = shingle_set(t, shingle)
                whole.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes(), 5), np.int64))
                size.append(len(h))
                f, margin = wide_print(h)
                prints.append(f)
                margins.append(margin)
            whole, prints = np.array(whole, np.int64).reshape(-1, 2), np.array(prints, np.int64).reshape(-1, WORDS)
            yield whole[:, 0], whole[:, 1], size, *prints.T, margins

    return added(docs, text, make, f"set0 long, set1 long, n_shingles long, {', '.join(f'_f{k} long' for k in range(WORDS))}, margin binary", carry)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order."""
    return np.unique(shingle_hashes(words(text if isinstance(text, str) else None), n))

def similar_links(node: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of nodes whose sets have a Jaccard similarity of at least ``similarity``: pairs of a node and its tree's first."""
    size = np.array([len(s) for s in sets], np.int64)
    value, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = times[value] > 1
    value, ends = value[shared], np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(sets)), size), shared, len(sets)).astype(np.int64))))
    mark, free, out = np.zeros(len(times), bool), np.ones(len(node), bool), []
    for root in range(len(node)):
        tree = [root] if free[root] else []
        free[root] = False
        while tree:
            x = tree.pop()
            own = value[ends[x] : ends[x + 1]]
            mark[own] = True
            both = np.diff(np.concatenate(([0], np.cumsum(mark[value])))[ends])
            mark[own] = False
            hit = np.flatnonzero(free & (both > 0) & (both >= similarity * (size + size[x] - both) - 1e-9))
            free[hit] = False
            tree += hit.tolist()
            out += [(int(node[y]), int(node[root])) for y in hit]
    return out


def verified_links(members: DataFrame, sets: DataFrame, similarity: float, block: int = 256) -> DataFrame:
    """Edges ``(a, b)`` that span the pairs within groups whose ``sets(node, set)`` have a Jaccard similarity of at least ``similarity``.

    ``members(node, root, n_shingles)`` has the groups. Small ones share a task's calls; one of over ``block``
    nodes or ``BLOCK_SHINGLES`` shingles is dealt over blocks, and each pair of blocks meets in a call of its own.
    """
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"))
    sizes = written(sizes.select("root", "total", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "sizes")
    bins = max(1, (sizes.where("blocks = 1").agg(F.sum("total")).first()[0] or 0) // BLOCK_SHINGLES)
    rows = members.select("node", "root").join(sizes.select("root", "blocks").hint("merge"), "root").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = sets.join(rows.hint("merge"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = F.col("blocks") == 1
    dealt = rows.select("node", "root", "set", F.when(one, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root")).alias("bin"), one.alias("one"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for at in pdf.groupby("root").indices.values():
            if len(at) > 1:
                found += similar_links(pdf["node"].to_numpy()[at], [pdf["set"].iat[i] for i in at], similarity)
        return pd.DataFrame(found, columns=["a", "b"]).astype(np.int64)

    return dealt.groupBy("one", "bin", "lo", "hi").applyInPandas(verify, "a long, b long")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 256) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the smallest doc_id.

    Documents are linked if their sets of shingles have a Jaccard similarity of ``similarity``
    or more; groups are the components. Candidates come from SimHash fingerprints of the sets: correlated bits are
    grouped, dynamic programming deals the flips of unsure bits (:func:`allocate_recall`), and nodes that meet are verified on
    all fingerprint bits. The tasks give edges that span what is likely, so that each group of likely copies has all its nodes;
    within these groups the sets themselves are compared, block by block inside tasks, which give spanning edges again.
    A pair at ``similarity`` is missed with a probability of ``MISSED``, a closer one with less.
    Ties and null doc_ids are decided by a row number, so exactly one row stays. All null, empty and wordless texts have
    the same, empty set: they are one group, of which one row stays. Texts of any length count whole. Columns are those of ``docs``; an empty
    table gives no rows.
    """
    docs, names = plain_names(docs)
    doc_id, text = names[doc_id], names[text]
    rows = written(docs.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("_rid").alias("rid"))
    prints = written(add_wide_prints(rows.select("_rid", doc_id, text), text, shingle, ["_rid", doc_id]), "prints")
    # texts with one set of shingles are one node, named by its first row
    nodes = written(prints.groupBy("set0", "set1").agg(F.min(order).alias("first")).select(F.col("first.rid").alias("node"), "first"), "nodes")
    words = [f"_f{k}" for k in range(WORDS)]
    heads = prints.where("n_shingles > 0").withColumnRenamed("_rid", "node").join(nodes.select("node").hint("merge"), "node", "left_semi")
    heads = written(heads.select("node", "n_shingles", *words, "margin"), "heads")
    discard(prints)
    n, *stats = bit_statistics(heads)
    plan = allocate_recall(n, [tuple(stats), *(bit_statistics(heads, w)[1:] for w in words[1:])], 2 * similarity / (1 + similarity))
    likely = written(connected_components(simhash_links(heads, LIKELY, LIKELY_WIDE, 2 * block, probes(heads, plan))), "likely")
    members = written(likely.join(heads.select("node", "n_shingles").hint("merge"), "node"), "members")
    discard(heads, likely)
    told = rows.select(F.col("_rid").alias("node"), F.col(text).alias("_t")).join(members.select("node").hint("merge"), "node", "left_semi")

    def sets_of(batches: Iterable[list]) -> Iterator[tuple]:
        for texts in batches:
            yield ([shingle_set(t, shingle).view(np.int64) for t in texts],)

    groups = written(connected_components(verified_links(members, added(told, "_t", sets_of, "set array<long>", ["node"]), similarity, block)), "groups")
    kept = nodes.join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    kept = written(kept.select(F.col("first.rid").alias("_rid")), "kept")
    discard(nodes, members, groups)
    return rows.join(kept.hint("merge"), "_rid", "left_semi").select(*(F.col(new).alias(old) for old, new in names.items()))
