"""Summary texts that list recordings and their annotated intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FILE = r"([A-Za-z]+\d+[a-z]?_\d+\+?\.edf)"
LOOSE_FILE = r"(\S+\.edf)"


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """``(path, value)``: whole texts in Latin-1."""
    return spark.read.option("encoding", "ISO-8859-1").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _times(block: Column, event: str, edge: str, numbered: bool) -> Column:
    number = r"\s*\d+\s*" if numbered else r"\s+"
    return F.transform(F.regexp_extract_all(block, F.lit(rf"(?i){event}{number}{edge} Time:\s*(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))


def parse_summaries(texts: DataFrame, event: str = "Seizure") -> DataFrame:
    """``(path, file, n, start_sec, end_sec)``: an interval a row, a recording without any with nulls.

    A block starts at "File Name:"; one that names no recording is skipped. Start and end times of the ``event``
    with numbers, blanks around them or none, pair up as far as both go; if either is missing, one unnumbered pair
    counts. Of blocks with the same file, the last one of a text holds.
    """
    blocks = texts.select("path", F.posexplode(F.split("value", r"(?i)File Name:")).alias("block_no", "block")).where("block_no > 0 and block like '%.edf%'")
    name = F.coalesce(F.nullif(F.regexp_extract("block", FILE, 1), F.lit("")), F.nullif(F.regexp_extract("block", LOOSE_FILE, 1), F.lit("")))
    b = F.col("block")
    start, end = _times(b, event, "Start", True), _times(b, event, "End", True)
    one_start, one_end = F.slice(_times(b, event, "Start", False), 1, 1), F.slice(_times(b, event, "End", False), 1, 1)
    numbered = (F.size(start) > 0) & (F.size(end) > 0)
    rows = blocks.select("path", "block_no", name.alias("file"), F.when(numbered, start).otherwise(one_start).alias("s"), F.when(numbered, end).otherwise(one_end).alias("e")).where("file is not null")
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy("path", "file").orderBy(F.desc("block_no")))).where("r = 1")
    n = F.least(F.size("s"), F.size("e"))
    pairs = F.zip_with(F.slice("s", F.lit(1), n), F.slice("e", F.lit(1), n), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    out = last.select("path", "file", F.posexplode_outer(pairs).alias("i", "p"))
    return out.select("path", "file", (F.col("i") + 1).alias("n"), F.col("p")["s"].alias("start_sec"), F.col("p")["e"].alias("end_sec"))
