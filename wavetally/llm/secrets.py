"""Secrets: base patterns, and a battery of randomness tests for tokens that no pattern names."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from math import erfc, exp, log, log10, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .shared import added, written

#: Kinds in the order in which spans with one start are listed; the last is the battery's.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Tokens that the battery tests, and the shortest of them.
MIN_TOKEN = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?" % MIN_TOKEN)
#: What a run without an encoding is split at: the characters foreign to one of the two widest alphabets.
FOREIGN = (re.compile(r"[^_-]+"), re.compile(r"[^+/]+"))
#: Alphabets in the order in which an encoding is inferred.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "upper_hex": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "lower": LOWER,
    "letters": LOWER + UPPER,
    "base36": DIGITS + LOWER,
    "base62": DIGITS + LOWER + UPPER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: False-discovery rate among the tokens found, and the level at which the battery rejects randomness.
FDR, LEVEL = 0.002, 0.01
#: Lengths from which a token belongs to the next stratum.
STRATA = (24, 32, 48, 64)
#: Bins of log10(p) in which a stratum's p-values are counted: a tenth of a unit down to 1e-40.
BINS, PER_UNIT = 400, 10


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns' matches, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(out)]


def encoding_of(token: str) -> str | None:
    """The first alphabet that has all characters of a token; padding does not count."""
    chars = set(token.rstrip("="))
    return next((k for k, a in ALPHABETS.items() if chars <= set(a)), None)


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, token)`` of the runs that have an encoding, and of the long enough parts of mixed ones.

    A run with characters of both base64 and base64url is split at those of either, as
    the secret may be of the other; parts may overlap.
    """
    out = []
    for m in TOKEN.finditer(text):
        if encoding_of(m[0]):
            out.append((m.start(), m.end(), m[0]))
        else:
            parts = {(m.start() + x.start(), m.start() + x.end(), x[0]) for f in FOREIGN for x in f.finditer(m[0])}
            out += sorted(x for x in parts if len(x[2].rstrip("=")) >= MIN_TOKEN)
    return out


def _tail(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * erfc(z / sqrt(2))


def battery(token: str, alphabet: str) -> tuple[float, float]:
    """The chi-squared statistic against uniform symbols, and the battery's p-value of randomness.

    Chi-squared (with its exact mean and variance for short tokens), runs above and
    below the middle of the alphabet, and lag-one serial correlation, joined by Fisher's method.
    """
    x = np.array([alphabet.index(c) for c in token.rstrip("=")], float)
    n, a = len(x), len(alphabet)
    counts = np.bincount(x.astype(int), minlength=a)
    chi = float(a / n * (counts.astype(float) ** 2).sum() - n)
    p = [_tail((chi - (a - 1)) / sqrt(2 * (a - 1) * (n - 1) / n))]
    up = x >= a / 2
    n1, n2 = int(up.sum()), int(n - up.sum())
    if n1 and n2:
        mean = 1 + 2 * n1 * n2 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p.append(2 * _tail(abs(1 + int((up[1:] != up[:-1]).sum()) - mean) / sqrt(var)))
    else:
        p.append(2.0 ** (1 - n))
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / v) if (v := float((d * d).sum())) else 1.0
    p.append(2 * _tail(abs(r + 1 / n) * sqrt(n)))
    half = -sum(log(max(min(q, 1.0), 1e-300)) for q in p)
    return chi, min(1.0, exp(-half) * (1 + half + half * half / 2))


def ordinary_p(chi: float, n: int, size: int, two: float, three: float) -> float:
    """Probability that an ordinary token of ``n`` symbols spreads them as evenly as ``chi`` says.

    The statistic tells how many pairs of symbols agree. ``two`` and ``three`` are the chances that two and three
    symbols of ordinary text agree; with the length, they give the number's mean and variance, and a gamma distribution
    of these, by Wilson and Hilferty's cube root, its lower tail.
    """
    agree = ((chi + n) * n / size - n) / 2
    mean = n * (n - 1) / 2 * two
    var = n * (n - 1) / 2 * (two - two * two) + n * (n - 1) * (n - 2) * max(three - two * two, 0)
    shape = mean * mean / max(var, 1e-9)
    return _tail(-((max(agree, 0.0) / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * 3 * sqrt(shape))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A written table ``(rid, doc_id, base, tokens, ordinary)``: base spans, further tokens outside them, and for some rows how often each ASCII character stands outside both in a run of rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def find(batches: Iterable[list]) -> Iterator[tuple]:
        for texts in batches:
            base, tokens, ordinary = [], [], np.zeros(128, np.int64)
            for t in texts:
                t = t or ""
                own = base_spans(t)
                base.append([{"s": s, "e": e, "kind": k} for s, e, k in own])
                far = -1
                ends = [far := max(far, e) for _, e, _ in own]
                starts = [s for s, _, _ in own]
                clear = lambda a, b: not (i := bisect_right(starts, b - 1)) or ends[i - 1] <= a
                tokens.append([{"s": a, "e": b, "token": x} for a, b, x in tokens_of(t) if clear(a, b)])
                ordinary += characters(t) - sum((characters(t[a:b]) for a, b in runs(own, t)), np.zeros(128, np.int64))
            yield base, tokens, [None] * (len(texts) - 1) + [ordinary.tolist()] if texts else []

    columns = "base array<struct<s:int,e:int,kind:string>>, tokens array<struct<s:int,e:int,token:string>>, ordinary array<long>"
    return written(added(rows, "text", find, columns, ["rid", "doc_id"]), "scanned")


def characters(text: str) -> np.ndarray:
    """How often each ASCII character is in a text."""
    return np.bincount(np.frombuffer(text.encode("ascii", "ignore"), np.uint8), minlength=128)


def runs(base: list[tuple[int, int, str]], text: str) -> list[tuple[int, int]]:
    """Disjoint places of the base spans and of all runs that are long enough to hold tokens."""
    out: list[tuple[int, int]] = []
    for s, e in sorted([(s, e) for s, e, _ in base] + [m.span() for m in TOKEN.finditer(text)]):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def agreements(ordinary: np.ndarray) -> dict[str, tuple[float, float]]:
    """For each alphabet, the chances that two and three of its symbols agree, drawn as they stand in ordinary text."""
    out = {}
    for k, alphabet in ALPHABETS.items():
        q = np.array([ordinary[ord(c)] for c in alphabet], float) + 0.5
        q /= q.sum()
        out[k] = float((q**2).sum()), float((q**3).sum())
    return out


def random_tokens(found: DataFrame, fdr: float = FDR, level: float = LEVEL) -> DataFrame:
    """``(token)`` of the distinct tokens that pass the battery under false-discovery control.

    The texts outside all runs that are long enough for a token tell how ordinary text spreads the symbols of each
    encoding, so that secrets, however many, do not make themselves look ordinary. A token's p-value
    says how likely symbols drawn from ordinary text are to be as even; in each stratum of
    encoding and length, Benjamini and Hochberg's rule picks the p-values to trust. Of those, tokens
    whose randomness the battery rejects are left out.
    """
    tokens = written(found.select(F.explode("tokens").alias("t")).select("t.token").distinct(), "tokens")
    ordinary = np.zeros(128, np.int64)
    for c, n in found.select(F.posexplode("ordinary").alias("c", "n")).groupBy("c").agg(F.sum("n")).collect():  # a row per ASCII character
        ordinary[c] = n
    common = agreements(ordinary)

    def test(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["token"]:
                k, n = encoding_of(t), len(t.rstrip("="))
                if n < MIN_TOKEN:
                    continue
                chi, p = battery(t, ALPHABETS[k])
                even = ordinary_p(chi, n, len(ALPHABETS[k]), *common[k])
                out.append((t, k, sum(n >= x for x in STRATA), int(min(BINS, max(0, -log10(max(even, 1e-300)) * PER_UNIT))), p))
            yield pd.DataFrame(out, columns=["token", "encoding", "stratum", "bin", "p"])

    tested = written(tokens.mapInPandas(test, "token string, encoding string, stratum int, bin int, p double"), "tested")
    least: dict[tuple[str, int], int] = {}
    by: dict[tuple[str, int], dict[int, int]] = {}
    for k, s, b, n in tested.groupBy("encoding", "stratum", "bin").agg(F.count("*")).collect():  # at most encodings x strata x bins rows
        by.setdefault((k, s), {})[b] = n
    for key, bins in by.items():
        total, rank = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            rank += bins[b]
            if 10 ** (-b / PER_UNIT) <= fdr * rank / total:
                least[key] = b
    passed = F.lit(False)
    for (k, s), b in least.items():
        passed = passed | ((F.col("encoding") == k) & (F.col("stratum") == s) & (F.col("bin") >= b))
    return tested.where(passed & (F.col("p") >= level)).select("token")


def outermost(spans: DataFrame) -> DataFrame:
    """The rows of ``spans(rid, s, e, ..)`` that lie in no longer one of their text: by a running maximum along it, not by pairs."""
    # in this order, a span lies in one before it if any of them ends no sooner
    ahead = Window.partitionBy("rid").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_far", F.max("e").over(ahead)).where(F.col("_far").isNull() | (F.col("_far") < F.col("e"))).drop("_far")


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` per row of ``docs``.

    Counts and digest are of the base spans; ``spans`` lists random tokens as well.
    Null and empty texts have none; texts of any length are searched whole; repeated rows repeat; a null
    doc_id stays null; other columns are ignored; an empty table gives no rows.
    """
    found = scan(docs, doc_id, text)
    passed = written(random_tokens(found), "passed")
    hits = found.select("rid", F.explode("tokens").alias("t")).select("rid", "t.s", "t.e", "t.token").join(passed, "token", "left_semi")
    outer = outermost(hits)
    more = written(outer.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("more")), "more")
    rows = found.select("rid", "doc_id", "base").join(more, "rid", "left")
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def sortable(a: str, kind=None):
        def one(x):
            k = x["kind"] if kind is None else kind
            return F.struct(x["s"].alias("s"), order[k].alias("i"), x["e"].alias("e"), k.alias("kind"))

        return F.transform(a, one)

    every = F.when(F.col("more").isNull(), sortable("base")).otherwise(F.array_sort(F.concat(sortable("base"), sortable("more", F.lit("random")))))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed("base"), 256).alias("base_sha256"), listed(every).alias("spans"))
