"""Stupid-backoff bigram scores of documents, from counts over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .hashing import word_hashes
from .shared import discard, frugal, written

#: Factor of a backed-off score, and the count from which a bigram is in the table.
ALPHA, MIN_COUNT = 0.4, 2
#: A word or bigram is frequent from this share of all tokens; so there are at most 1 / share of each.
WORD_SHARE, PAIR_SHARE = 1 / (1 << 20), 1 / (1 << 16)
#: Word id of a document's start; ids have 47 bits.
START = 1
ID_BITS = 47
#: Tokens and documents that a task counts at a time.
CHUNK, MOST_DOCS = 1 << 20, 1 << 13
#: Bits of a frequent word's place, of a row's kind, of its times seen and of a document's row in its partition.
PLACE_BITS, KIND_BITS, TF_BITS, ROW_BITS = 21, 3, 7, 28
#: Units of a sum that is sent as an integer.
UNITS = 1e11


def word_ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """An id of 47 bits for each word of ``texts``, a start before each text that has words; and each text's number of ids."""
    h, n = word_hashes(texts)
    ids = (h >> np.uint64(64 - ID_BITS)).astype(np.int64) | 2
    first = (np.cumsum(n) - n)[n > 0]
    return np.insert(ids, first, START), n + (n > 0)


def _batches(batches: Iterable) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Word ids of some documents, one behind the other, and each word's rid; about ``CHUNK`` at a time.

    A longer document comes in several parts. Each begins with the last word of the part before, which is told
    by a third value of 1, so that no bigram is lost and no word counts twice.
    """
    for batch in batches:
        rids, texts = batch.column("rid").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
        part = np.cumsum([len(t) if t else 0 for t in texts]) // (4 * CHUNK)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if len(texts) else [0]
        for a, b in zip(cuts, cuts[1:]):
            for lo in range(a, b, MOST_DOCS):
                ids, n = word_ids(texts[lo : min(b, lo + MOST_DOCS)])
                rid = np.repeat(rids[lo : min(b, lo + MOST_DOCS)], n)
                for at in range(0, len(ids), 2 * CHUNK):
                    begin = max(at - 1, 0)
                    yield ids[begin : at + 2 * CHUNK], rid[begin : at + 2 * CHUNK], at - begin


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``x`` in order and how often each occurs."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate((np.ones(min(len(x), 1), bool), x[1:] != x[:-1])))
    return x[first], np.diff(first, append=len(x))


def _place(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of each id in a sorted table, or -1."""
    if not len(table):
        return np.full(len(ids), -1, np.int64)
    at = np.minimum(np.searchsorted(table, ids), len(table) - 1)
    return np.where(table[at] == ids, at, -1)


def _table(names: list[str], *columns: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, c)`` over all documents of ``rows(rid, text)``; tasks send one row per word they met."""

    def count(batches: Iterable) -> Iterator:
        for ids, _, again in _batches(batches):
            yield _table(["word", "c"], *_counted(ids[again:]))

    return rows.mapInArrow(frugal(count), "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_bigrams(rows: DataFrame, words: np.ndarray, least: float) -> DataFrame:
    """``(pair, c)`` of the bigrams of ``words`` that occur ``least`` times or more; a pair is the two words' places."""
    sent = rows.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterable) -> Iterator:
        for ids, _, _ in _batches(batches):
            known, _ = _counted(ids)
            at = _place(sent.value, known)[np.searchsorted(known, ids)]
            both = (at[:-1] >= 0) & (at[1:] >= 0) & (ids[1:] != START)
            yield _table(["pair", "c"], *_counted((at[:-1][both] << PLACE_BITS) | at[1:][both]))

    got = rows.mapInArrow(frugal(count), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
    return got.where(F.col("c") >= least)


def _columns(table: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """A bounded table ``(key, c)`` in order of its keys."""
    pdf = table.toPandas().sort_values(key)
    return pdf[key].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)


def backoff_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """``(doc_id, n_tokens, n_backoff, mean_logprob)`` per row of ``docs``.

    A word w behind v scores c(vw) / c(v) if the bigram table has vw, else
    ``alpha * c(w) / N``; counts are of the whole corpus, the start of a document
    is a word of its own, and N is the number of words without starts. The table
    keeps bigrams seen ``min_count`` times or more. Words are told apart by a hash of 46 bits.

    Words and bigrams above their share of all tokens are few by their definition: their counts are
    known to every task. Any other key is rare, and so no partition gets a hot one. A bigram is
    dealt by its rare word (by either, if both are rare), where that word's count and the bigram's are taken as well.

    Null and wordless texts have no tokens and a null mean; texts of any length are read whole, in parts;
    repeated rows repeat and count; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = rows.select("rid", "text")
    words = written(word_counts(texts), "words")
    starts, total = words.agg(F.sum(F.when(F.col("word") == START, F.col("c"))), F.sum("c")).first()
    total, starts = int(total or 0), int(starts or 0)
    n = max(total - starts, 1)
    hot_words, hot_counts = _columns(words.where((F.col("c") >= max(1.0, total * WORD_SHARE)) | (F.col("word") == START)), "word")  # at most 1 / WORD_SHARE + 1 rows
    discard(words)
    least = max(float(min_count), total * PAIR_SHARE)
    often = np.flatnonzero(hot_counts >= least)
    pairs, pair_counts = _columns(frequent_bigrams(texts, hot_words[often], least), "pair")  # at most 1 / PAIR_SHARE rows
    pairs = (often[pairs >> PLACE_BITS] << PLACE_BITS) | often[pairs & ((1 << PLACE_BITS) - 1)] if len(pairs) else pairs
    sent = spark.sparkContext.broadcast((hot_words, hot_counts, pairs, pair_counts))
    schema = StructType([*(StructField(c, LongType()) for c in ("pk", "other", "code")), rows.schema["doc_id"]])

    def numbered(rid: np.ndarray) -> np.ndarray:
        """Partition and row of a document, beside which a row's times seen have room."""
        row, part = rid & ((1 << 33) - 1), rid >> 33
        if len(rid) and (row.max() >> ROW_BITS or part.max() >> (63 - ROW_BITS - TF_BITS)):
            raise ValueError(f"over {1 << ROW_BITS} documents in a partition, or over {1 << (63 - ROW_BITS - TF_BITS)} partitions")
        return ((part << ROW_BITS) | row) << TF_BITS

    def explode(batches: Iterable) -> Iterator:
        """A row per document and bigram, dealt by pk; other holds the other word and the kind of row, code the document and the times seen.

        Kinds: 0, both words frequent; 1 and 2, the right or the left one rare; 3 and 4, the two rows of two rare
        ones; 6, a document's own row, with its id; 7, a document's sum that needs no table, in units of 1 / UNITS.
        """
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        id_type, names = to_arrow_type(schema["doc_id"].dataType), schema.names

        def frame(pk, other, kind, code, ids=None):
            arrays = [pa.array(c, pa.int64()) for c in (pk, other << KIND_BITS | kind, code)]
            return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(pk), id_type) if ids is None else ids], names=names)

        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            yield frame(rid, np.zeros(len(rid), np.int64), 6, numbered(rid), batch.column("doc_id"))
            for ids, rids, _ in _batches([batch]):
                yield from explode_words(ids, rids, frame)

    def explode_words(ids: np.ndarray, rids: np.ndarray, frame) -> Iterator:
        hot_words, counts, pair_keys, pair_counts = sent.value
        known, _ = _counted(ids)
        docs_of, _ = _counted(rids)
        bits = max(int(len(known)).bit_length(), 1)
        doc_bits = int(len(docs_of)).bit_length()
        local, doc = np.searchsorted(known, ids), np.searchsorted(docs_of, rids)
        inside = ids[1:] != START
        # a bigram of a document as one number, exact: at most 2 * 22 + 14 bits
        key, tf = _counted((((local[:-1] << bits) | local[1:]) << doc_bits | doc[1:])[inside])
        doc, v, w = key & ((1 << doc_bits) - 1), key >> (bits + doc_bits), (key >> doc_bits) & ((1 << bits) - 1)
        at_hot = _place(hot_words, known)
        a, b = at_hot[v], at_hot[w]
        both = (a >= 0) & (b >= 0)
        pair = np.where(both, (a << PLACE_BITS) | b, -1)
        at = np.full(len(pair), -1, np.int64)
        at[both] = _place(pair_keys, pair[both])
        done = at >= 0
        if done.any():
            score = tf[done] * (np.log(pair_counts[at[done]]) - np.log(counts[a[done]]))
            n_done = np.bincount(doc[done], tf[done], minlength=len(docs_of)).astype(np.int64)
            units = np.round(np.bincount(doc[done], score, minlength=len(docs_of)) * UNITS).astype(np.int64)
            some = n_done > 0
            yield frame(units[some], n_done[some], 7, numbered(docs_of[some]))
        left, code = ~done, numbered(docs_of)[doc]
        for kind, mine, pk, other in (
            (0, left & both, -pair - 1, np.zeros(len(pair), np.int64)),
            (1, left & (a >= 0) & (b < 0), known[w], a),
            (2, left & (a < 0) & (b >= 0), known[v], b),
            (3, left & (a < 0) & (b < 0), known[v], known[w]),
            (4, left & (a < 0) & (b < 0), known[w], known[v]),
        ):
            pk, other, times, codes = pk[mine], other[mine], tf[mine], code[mine]
            most = (1 << TF_BITS) - 1
            if (times > most).any():  # a row for each so many times
                more = -(-times // most)
                part = np.concatenate([np.arange(m) for m in more])
                pk, other, codes = np.repeat(pk, more), np.repeat(other, more), np.repeat(codes, more)
                times = np.clip(np.repeat(times, more) - part * most, 0, most)
            if kind in (1, 4):  # rows come in the order of their left words; equal keys beside each other make the shuffle smaller
                near = np.argsort(pk, kind="stable")
                pk, other, times, codes = pk[near], other[near], times[near], codes[near]
            if len(pk):
                yield frame(pk, other, kind, codes | times)

    mask = lambda bits: F.lit((1 << bits) - 1)
    grams = rows.mapInArrow(frugal(explode), schema)
    own = grams.repartition("pk").sortWithinPartitions("pk", "other")
    own = own.withColumns({"kind": F.col("other").bitwiseAND(mask(KIND_BITS)), "tf": F.col("code").bitwiseAND(mask(TF_BITS))})
    # all occurrences of a rare word are the right ones of its kinds 1 and 4; both windows use the one shuffle and its order
    own = own.withColumn("pk_c", F.sum(F.when(F.col("kind").isin(1, 4), F.col("tf"))).over(Window.partitionBy("pk")))
    own = own.withColumn("c", F.sum("tf").over(Window.partitionBy("pk", "other")))
    held = F.broadcast(spark.createDataFrame(_frame_of(hot_counts), "i long, hot_c long"))  # at most 1 / WORD_SHARE + 1 rows
    counted = F.col("kind") < 6
    other, pair = F.shiftright("other", KIND_BITS), -F.col("pk") - 1
    left_place = F.when(F.col("kind") == 0, F.shiftright(pair, PLACE_BITS)).when(F.col("kind") == 1, other)
    right_place = F.when(F.col("kind") == 0, pair.bitwiseAND(mask(PLACE_BITS))).when(F.col("kind") == 2, other)
    place = F.when(~counted, None).when(F.col("c") >= min_count, left_place).otherwise(right_place)  # the count needed: of v if the table has vw, else of w
    own = own.withColumn("i", place).join(held, "i", "left").withColumn("u", F.coalesce("hot_c", "pk_c"))
    seen = F.col("c") >= min_count
    seen_score = F.log("c") - F.log("u")
    back_score = F.log(F.col("u") / n) + log(alpha)
    score = F.when(~counted, 0.0).when(seen, F.when(F.col("kind") != 4, seen_score).otherwise(0.0)).otherwise(F.when(F.col("kind") != 3, back_score).otherwise(0.0))
    zero = F.lit(0).cast("long")
    backed = F.when(counted & ~seen & (F.col("kind") != 3), F.col("tf")).otherwise(zero)
    tokens = F.when(F.col("kind") == 7, other).when(F.col("kind").isin(4, 6), zero).otherwise(F.col("tf"))
    total_score = F.when(F.col("kind") == 7, F.col("pk") / UNITS).otherwise(score * F.col("tf"))
    own = own.select(F.shiftright("code", TF_BITS).alias("doc"), "doc_id", tokens.alias("tf"), total_score.alias("score"), backed.alias("backoff"))
    found = own.groupBy("doc").agg(F.max("doc_id").alias("doc_id"), F.sum("tf").alias("n"), F.sum("score").alias("score"), F.sum("backoff").alias("backoff"))
    mean = F.when(F.col("n") > 0, F.round(F.col("score") / F.col("n"), 6))
    return found.select("doc_id", F.col("n").alias("n_tokens"), F.col("backoff").alias("n_backoff"), mean.alias("mean_logprob"))


def _frame_of(counts: np.ndarray):
    import pandas as pd

    return pd.DataFrame({"i": np.arange(len(counts), dtype=np.int64), "hot_c": counts})
