"""Operators over recordings in blocks: rows ``(keys, channel, block, samples)``, blocks of one size but for a channel's last.

No operator puts a whole channel together: filters carry states from block to block, spectra and windows take what they
need from a block and its neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..config import Config
from ..functions import autoregression as ar, spectral as sp
from .stats import with_below

#: Windows that are worked on together.
RUN = 32
#: The finest resolution that a model's decay may ask for.
FINEST = 20_000


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``rows`` with ``s``, each row's place by ``order`` (distinct within a key) from 0 on; a key of any size is spread over tasks."""
    placed = with_below(rows.withColumn("one", F.lit(1)), keys, order, ["one"])
    return placed.withColumn("s", F.col("below_one").cast("long")).drop("one", "below_one", "all_one")


def blocks_of(samples: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Blocks of ``size`` samples from ``samples(keys, channel, s, x)``, one row a sample."""
    at = F.struct("s", F.col("x").cast("double").alias("x"))
    g = samples.groupBy(*keys, "channel", F.floor(F.col("s") / size).alias("block")).agg(F.array_sort(F.collect_list(at)).alias("v"))
    return g.select(*keys, "channel", "block", F.transform("v", lambda v: v["x"]).alias("samples"))


def scale_by_spread(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Samples over their whole channel's sample spread, not centred; a flat channel is left as it is."""
    on = [*keys, "channel"]
    spread = blocks.select(*on, F.explode("samples").alias("x")).groupBy(*on).agg(F.stddev_samp("x").alias("_sd"))
    x = F.transform("samples", lambda v: v / F.col("_sd"))
    return blocks.join(spread, on).withColumn("samples", F.when(F.col("_sd") > 0, x).otherwise(F.col("samples"))).drop("_sd")


def _ddl(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


class _Steps:
    """What a filter does to states over blocks of a length: the states forward, and the backward ones that forward states leave behind."""

    def __init__(self, sections: list[np.ndarray]):
        self.sections = sections
        self.of = lru_cache(maxsize=64)(self._of)

    def _of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        units = np.eye(2 * len(self.sections))
        y, forward = sp.cascade(np.zeros((len(units), length)), self.sections, units)
        return forward.T, sp.cascade(y[:, ::-1], self.sections)[1].T

    def ends(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after ``x`` from rest, forward, and backward over what comes out."""
        y, forward = sp.cascade(x, self.sections)
        return forward, sp.cascade(y[::-1], self.sections)[1]


def filtered(blocks: DataFrame, keys: list[str], fs: float, highpass: float | None = 0.5, notch_at: float | None = 60.0, pad: int = sp.PAD) -> DataFrame:
    """``blocks`` with ``filtered``: zero-phase high-pass and notch of each channel, ends mirrored.

    A first pass finds the states in which a block leaves the filter that enters it at rest, forward and backward. As the filter is linear,
    these small rows tell by a running product the true states at every block's two ends; a second pass filters each block
    from them. Samples are shuffled once at most, and no task holds more than blocks.
    """
    sections = (sp.butterworth_highpass(4, highpass, fs) if highpass else []) + (sp.notch(notch_at, notch_at / 30, fs) if notch_at else [])
    on = [*keys, "channel", "block"]
    ends_schema = _ddl(blocks, on) + ", n long, forward array<double>, backward array<double>, head array<double>, tail array<double>"

    def ends(pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = _Steps(sections)
        for pdf in pdfs:
            xs = [np.asarray(v, float) for v in pdf["samples"]]
            both = [steps.ends(x) for x in xs]
            near = [x[: pad + 1] for x in xs]
            yield pdf[on].assign(n=[len(x) for x in xs], forward=[f for f, _ in both], backward=[b for _, b in both], head=near, tail=[x[-pad - 1 :] for x in xs])

    def first(parts, wanted: int) -> np.ndarray:
        out: list[np.ndarray] = []
        while sum(map(len, out)) < wanted and (more := next(parts, None)) is not None:
            out.append(more)
        return out

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        steps, pdf = _Steps(sections), pdf.sort_values("block")
        head = np.concatenate(first((np.asarray(v) for v in pdf["head"]), pad + 1))[: pad + 1]
        tail = np.concatenate(first((np.asarray(v) for v in pdf["tail"][::-1]), pad + 1)[::-1])[-pad - 1 :]
        before, behind = sp.mirrored(head, pad)[0], sp.mirrored(tail, pad)[1]
        state = sp.cascade(before, sections)[1]
        entered = []
        for n, e in zip(pdf["n"], pdf["forward"]):
            entered.append(state)
            state = steps.of(n)[0] @ state + e
        state = sp.cascade(sp.cascade(behind, sections, state)[0][::-1], sections)[1]
        left = []
        for n, e, s in zip(pdf["n"][::-1], pdf["backward"][::-1], reversed(entered)):
            left.append(state)
            forward, backward = steps.of(n)
            state = forward @ state + e + backward @ s
        return pdf[on].assign(_entered=entered, _left=left[::-1])

    def run(pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for v, a, b in zip(pdf["samples"], pdf["_entered"], pdf["_left"]):
                y = sp.cascade(np.asarray(v, float), sections, np.asarray(a))[0]
                out.append(sp.cascade(y[::-1], sections, np.asarray(b))[0][::-1])
            yield pdf.drop(columns=["_entered", "_left"]).assign(filtered=out)

    told = blocks.select(*on, "samples").where(F.size("samples") > 0).mapInPandas(ends, ends_schema)
    joined = blocks.join(told.groupBy(*keys, "channel").applyInPandas(scan, _ddl(blocks, on) + ", _entered array<double>, _left array<double>"), on)
    fields = [f for f in joined.schema.fields if f.name not in ("_entered", "_left")]
    return joined.mapInPandas(run, StructType([*fields, *StructType.fromDDL("filtered array<double>").fields]))


def power_spectra(blocks: DataFrame, keys: list[str], fs: float, segment: int, size: int) -> DataFrame:
    """``(keys, channel, bin, power)``: the power spectral density of each channel, Hann segments overlapping by half, from blocks of ``size``.

    A segment's place is arithmetic: the segments inside a block are summed where the block is; for those across a border, each block sends
    its last and its first samples, fewer than a segment. Sums meet by channel and bin. A channel shorter than a
    segment has one segment of its own length.
    """
    if size < segment:
        raise ValueError("blocks must not be shorter than a segment")
    hop, on = max(segment // 2, 1), [*keys, "channel"]
    part_schema = _ddl(blocks, on) + ", border long, right boolean, start long, piece array<double>, length int, count long, total array<double>"

    def inside(pdfs: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for row in pdf.itertuples(index=False):
                x, start, own = np.asarray(row.samples, float), int(row.block) * size, [getattr(row, k) for k in on]
                length = segment if row.block > 0 or len(x) >= segment else len(x)
                skip = -start % hop
                total, count = sp.periodograms(x[skip:], length, max(length // 2, 1) if length < segment else hop)
                if count:
                    rows.append((*own, None, None, None, None, length, count, total))
                if len(x) >= segment or row.block > 0:
                    if row.block > 0:
                        rows.append((*own, int(row.block) - 1, True, start, x[: segment - 1], segment, 0, None))
                    if len(x) == size:
                        rows.append((*own, int(row.block), False, start + size - segment + 1, x[size - segment + 1 :], segment, 0, None))
            yield pd.DataFrame(rows, columns=[*on, "border", "right", "start", "piece", "length", "count", "total"])

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("right")
        x, start = np.concatenate([np.asarray(v, float) for v in pdf["piece"]]), int(pdf["start"].iloc[0])
        total, count = sp.periodograms(x[-start % hop :], segment, hop) if len(pdf) == 2 else (np.zeros(segment // 2 + 1), 0)
        return pdf.iloc[:1][on].assign(length=segment, count=count, total=[total])

    parts = blocks.where(F.size("samples") > 0).select(*on, "block", "samples").mapInPandas(inside, part_schema)
    sums = ["length", "count", "total"]
    borders = parts.where("border is not null").groupBy(*on, "border").applyInPandas(across, _ddl(blocks, on) + ", length int, count long, total array<double>")
    both = parts.where("border is null").select(*on, *sums).unionByName(borders).where(F.col("count") > 0)
    g = both.select(*on, "length", "count", F.posexplode("total").alias("bin", "v")).groupBy(*on, "length", "bin").agg(F.sum("count").alias("count"), F.sum("v").alias("v"))
    squared = F.col("length") * 0.375  # the sum of the squares of a Hann window; of one or two samples below
    squared = F.when(F.col("length") == 1, F.lit(0.0)).when(F.col("length") == 2, F.lit(1.0)).otherwise(squared)
    twice = F.when((F.col("bin") > 0) & (F.col("bin") * 2 < F.col("length")), 2.0).otherwise(1.0)
    return g.select(*on, "bin", F.when(squared > 0, F.col("v") / F.col("count") / (squared * fs) * twice).alias("power"))


def by_run(blocks: DataFrame, keys: list[str], cfg: Config, size: int, make: Callable[[np.ndarray], pd.DataFrame], columns: str) -> DataFrame:
    """``(keys, w, columns)`` for each complete window: ``make`` gets the windows of a run, ``(windows, channels, times)``, and gives a row for each.

    Runs of ``RUN`` windows are worked on together. A run gets from each block the samples that its windows hold, so that only what
    two runs share is sent twice; an incomplete tail has no window. A missing sample is NaN.
    """
    window, step = cfg.window, cfg.step
    start, n = F.col("block") * size, F.size("samples")
    low = F.greatest(F.lit(0).cast("long"), F.ceil((start - window + 1) / step))
    high = F.floor((start + n - 1) / step)
    run = lambda w: F.floor(w / RUN)
    rows = blocks.where(n > 0).withColumn("run", F.explode(F.sequence(run(low), run(high))))
    s, end = F.greatest(start, F.col("run") * (RUN * step)), F.least(start + n, (F.col("run") * RUN + RUN - 1) * step + window)
    rows = rows.withColumn("s", s).where(end > s).select(*keys, "channel", "run", "s", F.slice("samples", (s - start + 1).cast("int"), (end - s).cast("int")).alias("samples"))
    schema = StructType.fromDDL(_ddl(blocks, keys) + ", w long, " + columns)
    names_out = schema.fieldNames()

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["run"].iloc[0]) * RUN * step
        names = {c: i for i, c in enumerate(sorted(pdf["channel"].unique()))}
        x = np.full((len(names), max(int(a) + len(v) for a, v in zip(pdf["s"], pdf["samples"])) - first), np.nan)
        for c, a, v in zip(pdf["channel"], pdf["s"], pdf["samples"]):
            x[names[c], a - first : a - first + len(v)] = v
        if x.shape[1] < window:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names_out})
        stack = np.lib.stride_tricks.sliding_window_view(x, window, axis=1)[:, ::step][:, :RUN].transpose(1, 0, 2)
        out = make(stack)
        out.insert(0, "w", np.arange(len(stack)) + first // step)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    return rows.groupBy(*keys, "run").applyInPandas(together, schema)


def window_models(blocks: DataFrame, keys: list[str], cfg: Config, size: int, order: int, resolution: int | None, bands, lags: int | None = None) -> DataFrame:
    """``(keys, w, valid, reason, radius, decay, resolution, features)`` for each window: a model and its banded connectivity.

    Without a ``resolution``, each window's follows from its model's decay, and the windows of one resolution are worked on
    together; one beyond ``FINEST`` is refused. With ``lags``, reduced models come from autocovariances, the older route. A window whose model is not usable has no
    features and says why; no window stops the others.
    """

    def make(x: np.ndarray) -> pd.DataFrame:
        a, s = ar.fit(x, order)
        reason, radius, decay = ar.checks(a, s)
        wanted = np.where(reason == "", ar.decay_resolution(decay) if resolution is None else resolution, 0)
        reason = np.where(wanted > FINEST, "resolution too fine", reason).astype(object)
        features: list = [None] * len(x)
        for r in np.unique(wanted[reason == ""]):
            at = np.flatnonzero((wanted == r) & (reason == ""))
            for k, v in zip(at, ar.banded(a[at], s[at], int(r), cfg.fs, bands, lags)):
                features[k] = v
        return pd.DataFrame({"valid": reason == "", "reason": reason, "radius": np.where(np.isnan(radius), None, radius), "decay": decay, "resolution": wanted, "features": features})

    return by_run(blocks, keys, cfg, size, make, "valid boolean, reason string, radius double, decay long, resolution long, features array<double>")


def agreement(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, r, mae)`` of the windows with ``features`` on both sides: their correlation and mean absolute difference."""
    both = left.where("valid").select(*keys, F.col("features").alias("x")).join(right.where("valid").select(*keys, F.col("features").alias("z")), keys)
    pairs = both.select(*keys, F.explode(F.arrays_zip("x", "z")).alias("v"))
    return pairs.groupBy(*keys).agg(F.corr("v.x", "v.z").alias("r"), F.avg(F.abs(F.col("v.x") - F.col("v.z"))).alias("mae"))


def model_orders(blocks: DataFrame, keys: list[str], cfg: Config, size: int, most: int = 15) -> DataFrame:
    """``(keys, w, order)``: the order of least BIC per window, all orders from one pass; null where no fit succeeds."""

    def make(x: np.ndarray) -> pd.DataFrame:
        _, bic = ar.information_criteria(x, most)
        none = np.isnan(bic).all(axis=1)
        best = np.where(none, 0, np.nanargmin(np.where(none[:, None], 0.0, bic), axis=1) + 1)
        return pd.DataFrame({"order": pd.array(np.where(none, None, best), dtype="Int64")})

    return by_run(blocks, keys, cfg, size, make, "order long")


def covariance_health(blocks: DataFrame, keys: list[str], cfg: Config, size: int) -> DataFrame:
    """``(keys, w, rank, condition, least, most, n_bad)`` of the channels' covariance per window."""

    def make(x: np.ndarray) -> pd.DataFrame:
        bad = (~np.isfinite(x)).sum(axis=(1, 2))
        x = ar.demeaned(np.nan_to_num(x))
        c = x @ x.transpose(0, 2, 1) / (x.shape[-1] - 1)
        e = np.linalg.eigvalsh(c)
        return pd.DataFrame({"rank": np.linalg.matrix_rank(c, hermitian=True), "condition": np.linalg.cond(c), "least": e[:, 0], "most": e[:, -1], "n_bad": bad})

    return by_run(blocks, keys, cfg, size, make, "rank long, condition double, least double, most double, n_bad long")
