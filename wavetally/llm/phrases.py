"""Collocations by stripes: for each prefix, how often each word comes next."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .shared import frugal, written

#: Longest phrase, fewest occurrences, the share (in hundredths) of a longer phrase that takes a phrase out, and phrases reported by language.
LONGEST, LEAST, SHARE, REPORTED = 5, 100, 100, 2000
#: Bytes of text whose stripes are made at a time.
CHUNK = 1 << 23
#: Bits of the filter of frequent phrases that every task holds (16 MB); where it fills up, more phrases are counted than needed, and dropped.
FILTER_BITS = 1 << 27
#: A prefix with at least one in so many of all words has its stripe in slices; there are no more such prefixes than this.
HOT, SLICES = 4096, 64
#: Parts of a language's phrases that are ranked by themselves first.
RANKED = 64
#: Bytes that end a piece, and that part words.
_ENDS, _GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TO_END = bytes(10 if b in _ENDS else 32 if b in _GAPS else b for b in range(256))
#: Bits of one bitmap of Spark's.
_BLOCK = 1 << 15
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _chunks(batches: Iterable) -> Iterator[tuple[str, bytes]]:
    """``(lang, text)`` with pieces ended by line feeds and words parted by spaces, about ``CHUNK`` bytes at a time; a piece stays whole."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def given(lang: str) -> tuple[str, bytes]:
        sizes.pop(lang)
        return lang, b"\n".join(waiting.pop(lang))

    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            lang, raw = langs[i].as_py(), texts[i].as_py().encode("utf-8", "surrogatepass").lower().translate(_TO_END)  # bytes.lower() is for A-Z alone
            while raw:
                cut = len(raw) if len(raw) <= CHUNK else raw.find(b"\n", CHUNK)
                part, raw = (raw, b"") if cut < 0 else (raw[:cut], raw[cut + 1 :])
                waiting.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sizes[lang] >= CHUNK:
                    yield given(lang)
        while sum(sizes.values()) > 2 * CHUNK:
            yield given(max(sizes, key=sizes.get))
    for lang in list(sizes):
        yield given(lang)


def _words(data: bytes) -> tuple:
    """The distinct words of ``data`` as an Arrow array, each word's place there, and its piece's number."""
    import pyarrow as pa

    raw = np.frombuffer(data, np.uint8)
    gap = (raw == 32) | (raw == 10)
    edges = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~gap].tobytes())]).dictionary_encode()
    pieces = np.searchsorted(np.flatnonzero(raw == 10), starts)
    return words.dictionary, words.indices.to_numpy().astype(np.int64), pieces


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 13))


def _hashes(words) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 17) for w in words.to_pylist()], np.uint64)


def _runs(h: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """A hash for each run of ``n`` words."""
    m = max(len(h) - n + 1, 0)
    x = np.full(m, seed, np.uint64)
    for k in range(n):
        x = _mixed(x * _MIX + h[k : k + m])
    return x


class Filter:
    """Bits of frequent phrases: a phrase with no bit is not frequent."""

    def __init__(self, bits: np.ndarray, n_bits: int):
        self.bits, self.n_bits = bits, np.uint64(n_bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h % self.n_bits
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _stripes(lang: str, data: bytes, n: int, frequent, hot: frozenset):
    """A batch ``(lang, prefix, slice, next, count)`` with a row for each prefix of ``n`` words and slice of its stripe; the next words are joined by spaces, which no word has.

    The empty prefix's stripe counts words; its next word ``''`` counts all of them. Only
    prefixes that are frequent count, and only next words with which the words after the first are frequent too.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    words, code, piece = _words(data)
    size, width = len(code), len(words) + 1
    if n == 0:
        prefix, at, following = np.zeros(size, np.int64), np.zeros(1, np.int64), code
        names = pa.array([""], pa.string())
    else:
        own = _hashes(words)
        h = _runs(own[code], n, _seed(lang))
        good = frequent.has(h)
        inside = piece[: size - n] == piece[n:] if size > n else np.zeros(0, bool)
        first = np.flatnonzero(inside & good[:-1] & good[1:]) if len(inside) else np.zeros(0, np.int64)
        following = code[first + n] if len(first) else np.zeros(0, np.int64)
        prefix, at = code[first], first
        for k in range(1, n):
            _, at, prefix = np.unique(prefix * width + code[first + k], return_index=True, return_inverse=True)
            at = first[at]
        if n == 1:
            kinds, where, prefix = np.unique(prefix, return_index=True, return_inverse=True)
            at = first[where]
        parts = [words.cast(pa.string()).take(pa.array(code[at + k])) for k in range(n)]
        names = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
    if not len(following):
        return None
    both, counts = np.unique(prefix * width + following, return_counts=True)
    prefix, following = np.divmod(both, width)
    cut = np.zeros(len(prefix), np.int64)
    many = np.array([(lang, p) in hot for p in names.to_pylist()], bool) if hot else np.zeros(len(names), bool)
    if n == 0 or many.any():
        sliced = np.ones(len(prefix), bool) if n == 0 else many[prefix]
        kinds, where = np.unique(following[sliced], return_inverse=True)
        cut[sliced] = (_mixed(_hashes(words.take(pa.array(kinds)))) % np.uint64(SLICES)).astype(np.int64)[where]
        order = np.lexsort((cut, prefix))
        prefix, following, counts, cut = prefix[order], following[order], counts[order], cut[order]
    new = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (cut[1:] != cut[:-1]))))
    offsets = pa.array(np.append(new, len(prefix)).astype(np.int32))
    nexts = words.cast(pa.string()).take(pa.array(following))
    columns = [pa.array([lang] * len(new), pa.string()), names.take(pa.array(prefix[new])), pa.array(cut[new].astype(np.int32)), pc.binary_join(pa.ListArray.from_arrays(offsets, nexts), " "), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "prefix", "slice", "next", "count"])


def _counted(texts: DataFrame, n: int, sent, hot: frozenset) -> DataFrame:
    """``(lang, prefix, next, a)``: how often ``next`` comes after ``prefix``, from stripes that are merged word by word."""

    def make(batches: Iterable) -> Iterator:
        import pyarrow as pa

        frequent = Filter(*sent.value) if sent is not None else None
        for lang, data in _chunks(batches):
            got = _stripes(lang, data, n, frequent, hot)
            if got is not None:
                yield got
            if n == 0:
                total = len(_words(data)[1])
                yield pa.RecordBatch.from_pydict({"lang": [lang], "prefix": [""], "slice": [0], "next": [""], "count": [[total]]}, pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("slice", pa.int32()), ("next", pa.string()), ("count", pa.list_(pa.int64()))]))

    stripes = texts.mapInArrow(frugal(make), "lang string, prefix string, slice int, next string, count array<long>")
    met = stripes.repartition("lang", "prefix", "slice").select("lang", "prefix", "slice", F.explode(F.arrays_zip(F.split("next", " ").alias("next"), "count")).alias("e"))
    return met.groupBy("lang", "prefix", "slice", F.col("e.next").alias("next")).agg(F.sum("e.count").alias("a")).drop("slice")


def _filter_of(phrases: DataFrame, n: int):
    """The broadcast :class:`Filter` of phrases of ``n`` words, ``FILTER_BITS`` at most."""
    n_bits = FILTER_BITS

    def places(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            h = [_runs(_hashes(pa.array(p.encode("utf-8", "surrogatepass").split(b" "), pa.binary())), n, _seed(l))[0] for l, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array(h, np.uint64) % np.uint64(n_bits)).astype(np.int64))], names=["place"])

    block = F.floor(F.col("place") / _BLOCK)
    found = phrases.select("lang", "phrase").mapInArrow(places, "place long").groupBy(block.alias("block")).agg(F.bitmap_construct_agg(F.col("place") % _BLOCK).alias("bits"))
    bits = np.zeros(n_bits // 8, np.uint8)
    for r in found.collect():  # n_bits at most
        bits[r["block"] * _BLOCK // 8 : (r["block"] + 1) * _BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return phrases.sparkSession.sparkContext.broadcast((bits, n_bits))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, a)`` of all phrases of up to ``longest`` words with at least ``least`` occurrences, and ``(lang, n)``, the number of words.

    A pass for each length: prefixes of ``k`` words key stripes, counters of the word that comes next. Tasks make
    the stripes of a run of texts, and stripes of one prefix are merged word by word. A prefix
    that is not frequent has no stripe; the filter that says so is bounded, and passes some others, which are counted and dropped.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null")
    sent, hot, levels, totals = None, frozenset(), [], None
    for n in range(longest):
        counted = _counted(texts, n, sent, hot)
        counted = counted.where((F.col("a") >= least) | (F.col("next") == "")).select("lang", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), F.lit(n + 1).alias("words"), "a")
        level = written(counted, f"phrases-{n + 1}")
        if n == 0:
            totals, level = level.where("phrase = ''").select("lang", F.col("a").alias("n")), level.where("phrase <> ''")
            all_words = totals.agg(F.sum("n")).first()[0] or 0
        levels.append(level)
        if n + 1 < longest:
            if sent is not None:
                sent.unpersist()
            sent = _filter_of(level, n + 1)
            hot = frozenset((r["lang"], r["phrase"]) for r in level.where(F.col("a") >= max(1, all_words // HOT)).collect())  # HOT rows and a few at most
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, totals


def scored(cut: DataFrame) -> DataFrame:
    """``cut`` with ``score``: ``1000 * a * n / (l * r)`` rounded down, exact for counts of up to 17 digits."""
    big = lambda c: F.col(c).cast("decimal(17,0)")
    both = cut.withColumn("up", big("a") * big("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("down", big("l") * big("r"))
    return both.withColumn("score", F.expr("up div down")).drop("up", "down")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, share: int = SHARE, reported: int = REPORTED) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``reported`` best phrases of two words or more.

    Texts are split into pieces at ``.,;:!?`` and the characters 10 to 13, pieces into words at spaces and tabs; A-Z count as lower case. A null
    language is ``und``, a null text has no words. ``a`` counts a phrase, ``n`` all words. A phrase cut in two has
    ``l`` and ``r`` occurrences of its parts and scores ``1000 * a * n / (l * r)``, rounded down; the lowest
    score of all cuts counts, the first of equal ones. A phrase goes if a phrase that holds it has at least ``share`` hundredths of its
    occurrences; as longer phrases are never more frequent than those inside them, the ones with one word more tell.

    Products have up to 38 digits. Repeated rows count each; texts of any length are read whole, in parts at ends of pieces;
    further columns are ignored; an empty table gives no rows.
    """
    found, totals = frequent_phrases(docs, text, lang, longest, least)
    words = F.split("phrase", " ")
    inner = found.where("words > 1").select("lang", "a", F.explode(F.array(F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.array_join(F.slice(words, 2, F.size(words) - 1), " "))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    several = found.where("words > 1").join(longer, ["lang", "phrase"], "left")
    several = several.where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    part = lambda first, length: F.array_join(F.slice(words, first, length), " ")
    parted = several.select("*", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size(words) - F.col("k")).alias("right"))
    of = lambda side, count: found.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
    parted = parted.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    parted = scored(parted)
    best = parted.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")
    best = written(best, "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = best.withColumn("p", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "p").orderBy(*order))).where(F.col("rank") <= reported)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= reported)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
