"""Recordings and feature windows: decoding, storage in blocks, and loading."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..config import DEFAULT, Config
from ..functions.scalars import nan_to_null, normalise_name
from .edf import header_of

#: Samples of a stored block.
BLOCK = 1024

ANNOTATION = "file string, event_id int, start_sample bigint, end_sample bigint, start_sec double, end_sec double, duration_sec double"
SEGMENT = (
    "C double, gamma double, k_feat int, patient string, record string, n_windows int, n_event_windows int, record_length double, threshold double, k int, roc_auc double, ap double, seg_accuracy double, seg_specificity double, seg_sensitivity double, seg_precision double, seg_f1 double, tp bigint, fp bigint, fn bigint"
)
EVENT = "patient string, record string, event_start double, event_end double, detected int, latency_s double, threshold double, k int, k_feat int"
FALSE_POSITIVE = "patient string, record string, fp_start double, fp_duration_s double"
RECORDING = "record string, channel_idx int, channel string, sampling_rate double, samples array<float>, error string"


def decode_edf(data: bytes) -> tuple[float, list[str], list[np.ndarray]]:
    """Sampling rate, channel names and physical samples of a European Data Format file with one common rate."""
    h = header_of(data, len(data))
    return h.per[0] / h.seconds, h.labels, h.decode(data[h.size : h.size + 2 * sum(h.per) * h.records])


def read_edf(spark: SparkSession, path: str) -> DataFrame:
    """A row per channel of each whole file below ``path``, by Spark's own reader; a file that cannot be read gives a row with its error. For long files see :mod:`wavetally.sources.edf`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.edf").load(path).select("path", "content")

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                record = p.rsplit("/", 1)[-1].removesuffix(".edf")
                try:
                    fs, names, signals = decode_edf(bytes(content))
                    yield pd.DataFrame({"record": record, "channel_idx": range(len(names)), "channel": names, "sampling_rate": fs, "samples": [s.astype(np.float32) for s in signals], "error": None})
                except (ValueError, IndexError, ZeroDivisionError) as e:
                    yield pd.DataFrame([{"record": record, "channel_idx": -1, "channel": None, "sampling_rate": None, "samples": None, "error": f"{type(e).__name__}: {e}"}])

    return files.mapInPandas(decode, RECORDING)


def to_blocks(channels: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per channel and block of samples, the form in which recordings are stored."""
    n = F.ceil(F.size("samples") / block).cast("int")
    rows = channels.where(F.size("samples") > 0).withColumn("block_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("samples", F.slice("samples", F.col("block_idx") * block + 1, F.lit(block)))


def from_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Channels put together again from their blocks."""
    g = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_idx", "samples"))).alias("b"))
    return g.select(*keys, F.flatten(F.transform("b", lambda x: x["samples"])).alias("samples"))


def write_recordings(blocks: DataFrame, path: str) -> None:
    """Compressed columns, a folder per patient; only the patients written are replaced."""
    blocks.write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("patient").parquet(path)


def montage(channels: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Channels in the fixed order of ``wanted(pos, name)``, for records that have all of them; and what the others miss.

    Names are normalised; of two channels with the same name, the first counts.
    """
    named = channels.withColumn("name", normalise_name(F.col("channel")))
    first = named.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "name").orderBy("channel_idx"))).where("_r = 1").drop("_r")
    hit = first.join(F.broadcast(wanted), "name")
    n = wanted.agg(F.count("*").alias("n"))
    complete = hit.groupBy(*keys).agg(F.count("*").alias("got")).crossJoin(F.broadcast(n)).where("got = n").select(*keys)
    missing = channels.select(*keys).distinct().crossJoin(F.broadcast(wanted)).join(first.select(*keys, "name"), [*keys, "name"], "left_anti")
    return hit.join(complete, keys, "left_semi"), missing.groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("missing"))


def write_montage(channels: DataFrame, wanted: DataFrame, path: str, size: int = BLOCK) -> DataFrame:
    """Store the channels of the montage ``wanted(pos, name)``, as blocks by patient, for the records ``(patient, record)`` that have them all; what the others miss.

    A stored channel's index is its place in the montage, so that every record has the same order.
    """
    keys = ["patient", "record"]
    picked, missing = montage(channels, wanted, keys)
    write_recordings(to_blocks(picked.select(*keys, F.col("pos").alias("channel_idx"), F.col("name").alias("channel"), "sampling_rate", "samples"), size), path)
    return missing


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Stored blocks as the operators over series take them: ``(patient, record, channel, name, sampling_rate, block, samples)``."""
    rows = spark.read.parquet(path)
    return rows.select("patient", "record", F.col("channel_idx").alias("channel"), F.col("channel").alias("name"), "sampling_rate", F.col("block_idx").cast("long").alias("block"), F.col("samples").cast("array<double>").alias("samples"))


def load_windows(spark: SparkSession, path: str, patients: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """Usable feature windows of ``patients`` from a folder with a folder per patient; files that cannot be read are skipped.

    A file's row is a record: ``(record, labels array<int>, windows array<array<struct<real, imag>>>)``. Labels beyond the
    windows are cut off, missing ones are 0; see :func:`usable_windows` for the rest.
    """
    schema = "patient string, record string, labels array<int>, windows array<array<struct<real:double,imag:double>>>"
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path).where(F.col("patient").isin(*patients))
    long = rows.select("patient", "record", "labels", F.posexplode("windows").alias("w", "features"))
    label = F.coalesce(F.get("labels", F.col("w")), F.lit(0))
    return usable_windows(long.select("patient", "record", F.col("w").cast("long").alias("w"), label.alias("label"), "features"), cfg)


def usable_windows(windows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Feature windows whose imaginary parts are negligible, with the record's class by whether any label is left.

    ``windows(patient, record, w, label, features array<struct<real, imag>>)``; a record without a positive
    window belongs to the event-free class and its labels are zero.
    """
    worst = F.array_max(F.transform("features", lambda x: F.abs(x["imag"])))
    rows = windows.withColumn("max_abs_imag", F.coalesce(worst, F.lit(0.0))).where(F.col("max_abs_imag") <= cfg.imag_tolerance)
    rows = rows.withColumn("features", F.transform("features", lambda x: x["real"]))
    return rows.withColumn("record_class", F.max("label").over(Window.partitionBy("patient", "record")))


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a fixed schema; missing numbers come as null, never NaN."""
    schema = T.StructType.fromDDL(schema)
    df = spark.read.csv(path, header=True, schema=schema, nullValue="", nanValue="nan")
    return df.select(*(nan_to_null(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in schema))


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_list(spark: SparkSession, path: str, suffix: str = r"\.h5$") -> DataFrame:
    """Names from a text file: trimmed, blanks dropped, the suffix removed."""
    return spark.read.text(path).select(F.regexp_replace(F.trim("value"), suffix, "").alias("record")).where("record <> ''")


def write_list(df: DataFrame, path: str) -> None:
    df.select("record").write.mode("overwrite").text(path)


def discover(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(path, length, modified)`` of the files below a folder, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def conversion_report(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """Each wanted file with whether it was found; what is missing does not stop the others."""
    named = listing.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path")
    return wanted.join(named, "file", "left").withColumn("missing", F.col("path").isNull())


def lookup_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows(feature_index)`` with ``name`` from ``names(feature_index, name)``, else f and four digits."""
    return rows.join(names, "feature_index", "left").withColumn("name", F.coalesce("name", F.format_string("f%04d", "feature_index")))


def audit(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Counts of expected, found, missing and extra names, in one row."""
    both = expected.select(key).distinct().withColumn("e", F.lit(1)).join(found.select(key).distinct().withColumn("f", F.lit(1)), key, "outer")
    return both.agg(F.count("e").alias("n_expected"), F.count("f").alias("n_found"), F.count_if(F.col("f").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_extra"))


def write_features(features: DataFrame, path: str, **parameters) -> None:
    """A feature table, by patient, with the parameters it was made with in a table of their own beside it."""
    features.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patient").parquet(f"{path}/features")
    rows = [(k, json.dumps(v)) for k, v in sorted(parameters.items())]
    features.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/parameters")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The feature table and its parameters."""
    return spark.read.parquet(f"{path}/features"), {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(f"{path}/parameters").collect()}
