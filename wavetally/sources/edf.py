"""European Data Format files as a data source that many tasks read a file of, range by range."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that one task reads.
RANGE = 32 << 20
SCHEMA = "record string, channel_idx int, channel string, sampling_rate double, start long, samples array<float>, error string"
#: Names and sizes of a signal's header fields.
FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("p_min", 8), ("p_max", 8), ("d_min", 8), ("d_max", 8), ("filter", 80), ("per", 8), ("spare", 32))


@dataclass
class Header:
    """What a file's header says: seconds of a data record, labels, samples a data record, and the scales from stored to physical values."""

    seconds: float
    labels: list[str]
    per: list[int]
    factor: list[float]
    offset: list[float]
    records: int

    @property
    def size(self) -> int:
        """Bytes before the first data record."""
        return 256 * (len(self.labels) + 1)

    def decode(self, raw: bytes) -> list[np.ndarray]:
        """Physical samples of each signal from whole data records: 16-bit integers, a signal after the other in each record."""
        table = np.frombuffer(raw, "<i2").reshape(-1, sum(self.per))
        ends = np.cumsum(self.per)
        return [table[:, e - n : e].ravel() * f + o for e, n, f, o in zip(ends, self.per, self.factor, self.offset)]


def header_of(data: bytes, length: int) -> Header:
    """The header at the start of ``data``, of a file of ``length`` bytes; a number of data records that is not told, or that the file has not, is what it has."""
    text = lambda a, n: data[a : a + n].decode("latin-1").strip()
    records, seconds, n = int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    if n < 1 or len(data) < 256 * (n + 1):
        raise ValueError("the header is not whole")
    at, fields = 256, {}
    for name, size in FIELDS:
        fields[name] = [text(at + i * size, size) for i in range(n)]
        at += n * size
    per = [int(x) for x in fields["per"]]
    lo, hi, dlo, dhi = (list(map(float, fields[f])) for f in ("p_min", "p_max", "d_min", "d_max"))
    if seconds <= 0 or min(per) < 1:
        raise ValueError("data records have no length")
    factor = [(b - a) / (d - c) for a, b, c, d in zip(lo, hi, dlo, dhi)]
    there = max(0, length - 256 * (n + 1)) // (2 * sum(per))
    return Header(seconds, fields["label"], per, factor, [a - c * f for a, c, f in zip(lo, dlo, factor)], min(records, there) if records >= 0 else there)


@dataclass
class FileRange(InputPartition):
    """The ``part``-th of ``parts`` ranges of a file's data records."""

    path: str
    length: int
    part: int
    parts: int


class EdfReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[FileRange]:
        """Ranges by the files' lengths alone; no file is opened before its tasks run."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for f in sorted((f for f in files if f.path.endswith(".edf")), key=lambda f: f.path):
            parts = max(1, -(-f.size // self.size))
            out += [FileRange(f.path, f.size, k, parts) for k in range(parts)]
        return out

    def read(self, partition: FileRange) -> Iterator[tuple]:
        from pyarrow import fs

        record = partition.path.rsplit("/", 1)[-1].removesuffix(".edf")
        try:
            with fs.FileSystem.from_uri(self.path)[0].open_input_file(partition.path) as f:
                first = f.read_at(256, 0)
                header = header_of(f.read_at(256 * (int(first[252:256]) + 1), 0), partition.length)
                start, stop = (header.records * k // partition.parts for k in (partition.part, partition.part + 1))
                width = 2 * sum(header.per)
                signals = header.decode(f.read_at((stop - start) * width, header.size + start * width))
        except (OSError, ValueError, OverflowError, ZeroDivisionError) as e:
            if partition.part == 0:  # one row of a file
                yield record, -1, None, None, None, None, f"{type(e).__name__}: {e}"
            return
        for k, x in enumerate(signals):
            yield record, k, header.labels[k], header.per[k] / header.seconds, start * header.per[k], x.astype(np.float32).tolist(), None


class EdfSource(DataSource):
    """``spark.read.format("edf").load(uri)``: a row per channel and range of a file, with the number of its first sample; option ``bytes``: of a range.

    A file that cannot be read is a row with its error. Files of any length are read by ranges, each by a task of its own; a file's
    header is read by every one of them.
    """

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> EdfReader:
        path = self.options["path"]
        return EdfReader(path if "://" in path or path.startswith("file:") else f"file://{path}", int(self.options.get("bytes", RANGE)))


def read_ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """The files at or below ``path`` by :class:`EdfSource`."""
    spark.dataSource.register(EdfSource)
    return spark.read.format("edf").option("bytes", size).load(path)


def to_blocks(ranges: DataFrame, size: int) -> DataFrame:
    """``(record, channel, name, sampling_rate, block, samples)``: blocks of ``size`` samples from ranges of any length; what meets is a block."""
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.size("samples") - 1) / size)
    rows = ranges.where("error is null and size(samples) > 0").withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block") * size, F.col("start"))
    part = F.slice("samples", (lo - F.col("start") + 1).cast("int"), F.lit(size) - (lo - F.col("block") * size).cast("int"))
    keys = ["record", "channel_idx", "block"]
    g = rows.select(*keys, "channel", "sampling_rate", lo.alias("lo"), part.alias("part")).groupBy(*keys).agg(F.first("channel").alias("name"), F.first("sampling_rate").alias("sampling_rate"), F.array_sort(F.collect_list(F.struct("lo", "part"))).alias("v"))
    return g.select("record", F.col("channel_idx").alias("channel"), "name", "sampling_rate", "block", F.flatten(F.transform("v", lambda x: x["part"])).cast("array<double>").alias("samples"))
