"""Language identification as mixture inference over character n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .shared import added, discard, frugal, plain_names, written

#: Hash buckets of the character n-grams of a language model.
BUCKETS = 1 << 14
#: Most languages that a model may have: it is held whole by every task, at 64 KB a language.
MOST_LANGUAGES = 1024
#: Characters that are read at a time, which bounds the memory of very long texts.
CHUNK = 1 << 18


def gram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts per bucket of the character bigrams and trigrams of the text with a space before and behind; letters in lower case, all else a space."""
    counts = np.zeros(buckets, np.int64)
    padded = f" {text.lower()} "
    for i in range(0, len(padded) - 1, CHUNK):
        codes = np.frombuffer(padded[i : i + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = (codes > 127) | ((codes >= 97) & (codes <= 122))
        codes = np.where(letter, codes, 32)
        two = (codes[:-1] * 8191 + codes[1:])[:CHUNK]  # a gram counts where it begins
        three = (two[: len(codes) - 2] * 8191 + codes[2:])[codes[1:-1] != 32]
        two = two[((codes[:-1] != 32) | (codes[1:] != 32))[:CHUNK]]
        for g in (two * 31 + 7, three * 33 + 11):
            h = (g * 0x2545F4914F6CDD1D) & 0x7FFFFFFFFFFFFFFF
            counts += np.bincount((h >> 31) % buckets, minlength=buckets)
    return counts


def has_letters(text: str) -> bool:
    """Whether a text has any letter at all."""
    return any(map(str.isalpha, text))


def train(docs: DataFrame, learn: "F.Column", text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities per bucket, from all rows of ``docs`` for which ``learn`` holds.

    Counts are summed over the whole table; what reaches the driver is one row
    per language and bucket at most. Labels of over ``MOST_LANGUAGES`` kinds are refused: they are no languages.
    """

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for t, l in zip(pdf["text"], pdf["lang"]):
                c = gram_buckets(t, buckets)
                if l in sums:
                    sums[l] += c
                else:
                    sums[l] = c
        for l, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": l, "bucket": at.astype(np.int32), "n": c[at]})

    rows = docs.where(learn).select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counted = written(rows.mapInPandas(frugal(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"labels name over {MOST_LANGUAGES} languages")
    got, place = counted.toPandas(), {k: i for i, k in enumerate(langs)}  # at most MOST_LANGUAGES x buckets rows
    discard(counted)
    table = np.full((len(langs), buckets), 0.5)
    table[got["lang"].map(place).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] += got["n"].to_numpy(float)
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def mixture(n: np.ndarray, logp: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float, float]:
    """Proportions by expectation-maximisation of ``n`` grams with ``logp`` (grams x languages), their log-likelihood, and a bound of any proportions'.

    The likelihood is concave in the proportions, so that no others, and none of fewer languages, can beat the bound.
    """
    top = logp.max(axis=1, keepdims=True)
    like = np.exp(logp - top)
    pi = np.full(logp.shape[1], 1 / logp.shape[1])
    total = n.sum()
    for _ in range(rounds if len(pi) > 1 else 0):
        pi = pi * (like.T @ (n / (like @ pi))) / total
    mix = np.maximum(like @ pi, 1e-300)
    found = float(n @ (np.log(mix) + top[:, 0]))
    return pi, found, found + float(total * np.log(max(float((like.T @ (n / mix)).max() / total), 1.0)))


def infer(counts: np.ndarray, logp: np.ndarray, penalty: float = 1.0) -> list[tuple[int, float]]:
    """The languages of the best set and their shares, the largest share first; empty without grams.

    Sets grow one language at a time, in the order of the shares in the mixture
    of all; of all sizes, the set with the best likelihood less ``penalty * log(n)`` for each
    further language wins. Sizes are left out only if the bound of all languages' likelihood
    says that none of them can win. Ties go to the smaller set and the first language.
    """
    at = np.flatnonzero(counts)
    if not len(at):
        return []
    n, lp = counts[at].astype(float), logp[:, at].T
    totals = n @ lp
    first = int(np.argmax(totals))
    chosen, score = [(first, 1.0)], float(totals[first])
    if len(totals) == 1:
        return chosen
    pi, _, bound = mixture(n, lp)
    order = np.argsort(-pi, kind="stable")
    cost = penalty * np.log(max(n.sum(), 2.0))
    for size in range(2, len(order) + 1):
        if bound - cost * (size - 1) <= score:
            break
        own = order[:size]
        p, ll, _ = mixture(n, lp[:, own])
        if ll - cost * (size - 1) > score:
            score = ll - cost * (size - 1)
            chosen = [(int(own[k]), float(p[k])) for k in np.argsort(-p, kind="stable")]
    return chosen


def predict(docs: DataFrame, langs: list[str], logp: np.ndarray, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``carry``, or all) with ``lang_pred``, ``score`` and ``languages``, in place of any columns of these names.

    ``languages`` is the selected set with each one's share of the text, the largest first; ``lang_pred`` and
    ``score`` are the first of them. ``und``, 0.0 and an empty set for a text that is null or has no letter, or without any learned language.
    """
    docs = docs.drop("lang_pred", "score", "languages")
    small = logp.astype(np.float32)

    def make(batches: Iterable[list]) -> Iterator[tuple]:
        table = small.astype(np.float64)
        for texts in batches:
            sets = [infer(gram_buckets(t, table.shape[1]), table) if t and langs and has_letters(t) else [] for t in texts]
            told = [[{"lang": langs[k], "share": min(max(p, 0.0), 1.0)} for k, p in found] for found in sets]
            yield [x[0]["lang"] if x else "und" for x in told], [x[0]["share"] if x else 0.0 for x in told], told

    return added(docs, text, make, "lang_pred string, score double, languages array<struct<lang:string,share:double>>", carry)


def held_out(doc_id: "F.Column") -> "F.Column":
    """Whether crc32 of a doc_id's text leaves 2 when divided by 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, languages)`` per row of ``docs``; see :func:`predict`.

    Learns from text and non-null lang of the rows that are not held out (a null
    doc_id takes no part in learning); predictions see the text alone. Null and
    letterless texts are ``und``; texts of any length are read whole, in parts; repeated rows repeat; other
    columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    langs, logp = train(rows, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return predict(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), langs, logp, carry=["doc_id", "held_out"])


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.4) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or has a share under ``least`` of the text.

    So null, empty and letterless texts go. Repeated rows are treated alike; all columns
    pass as they are; an empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    langs, logp = train(rows, F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    plain, names = plain_names(docs)
    kept = predict(plain, langs, logp, names[text]).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*(F.col(new).alias(old) for old, new in names.items()))
