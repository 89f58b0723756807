"""Boilerplate lines by the number of distinct sites they appear on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import plain_names, written

#: Distinct sites from which a line is boilerplate.
MIN_SITES = 5
#: log2 of the sketch's registers; its relative error is about 1.04 / sqrt(2 ** LG_K), of which four count as unsure.
LG_K = 10


def _lines(text: "F.Column") -> "F.Column":
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _norm(line: "F.Column") -> "F.Column":
    return F.trim(line)


def spread_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``(line_hash, first_id, sites)`` of the lines that appear on at least ``min_sites`` distinct sites.

    Each line hash has a HyperLogLog sketch of its sites; partial sketches merge
    where the shuffle brings them together. An estimate clear of the threshold
    decides at once; within the sketch's error, distinct sites are counted
    exactly. ``first_id`` is the smallest doc_id with the line; ``sites`` is the exact count
    near the threshold and the rounded estimate elsewhere. Lines are compared
    without outer spaces; empty lines and null sites do not count.
    """
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.col(site).cast("string").alias("site"), F.explode(F.array_distinct(F.transform(_lines(F.col(text)), _norm))).alias("line"))
    lines = lines.where("line <> '' and site is not null").select("doc_id", "site", F.xxhash64("line", F.length("line")).alias("line_hash"))
    lines = written(lines, "lines")
    # a line with one site, as most have, is no candidate for any threshold of two or more
    sketched = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_id"), F.min("site").alias("a"), F.max("site").alias("b"))
    error = 4 * 1.04 / 2 ** (lg_k / 2)
    sketched = sketched.where(F.lit(min_sites <= 1) | (F.col("a") != F.col("b"))).select("line_hash", "first_id", F.hll_sketch_estimate("sketch").alias("estimate"))
    sketched = written(sketched.where(F.col("estimate") >= min_sites * (1 - error) - 1), "sketched")
    unsure = F.col("estimate") <= min_sites * (1 + error) + 1
    near = sketched.where(unsure).select("line_hash")
    pairs = lines.groupBy("line_hash", "site").agg(F.lit(1).alias("one"))
    counted = pairs.join(near, "line_hash", "left_semi").groupBy("line_hash").agg(F.count("*").alias("exact"))
    both = sketched.join(counted, "line_hash", "left").select("line_hash", "first_id", F.coalesce("exact", "estimate").cast("long").alias("sites"))
    return both.where(F.col("sites") >= min_sites)


def without_spread_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_removed`` and the text without boilerplate lines.

    A boilerplate line stays in the document with the smallest doc_id that has
    it (all rows of that doc_id) and goes from every other. Null texts
    stay null with zero lines; a null doc_id never keeps a boilerplate line;
    repeated rows are treated alike; texts of any length are cut whole; further columns pass through, but any of the two new names are replaced; an
    empty table gives no rows.
    """
    docs, names = plain_names(docs)
    doc_id, text, site = names[doc_id], names[text], names[site]
    spread = written(spread_lines(docs, doc_id, text, site, min_sites), "spread")
    rows = written(docs.withColumn("_rid", F.monotonically_increasing_id()), "rows")
    placed = rows.select("_rid", F.col(doc_id).alias("_id"), F.posexplode(_lines(F.col(text))).alias("_pos", "_line")).select("_rid", "_id", "_pos", F.trim("_line").alias("_line"))
    placed = placed.where("_line <> ''").select("_rid", "_id", "_pos", F.xxhash64("_line", F.length("_line")).alias("line_hash"))
    gone = placed.join(spread, "line_hash").where(~F.col("_id").eqNullSafe(F.col("first_id"))).groupBy("_rid").agg(F.collect_list("_pos").alias("_gone"))
    gone = written(gone, "gone")
    joined = rows.join(gone.hint("merge"), "_rid", "left")
    lines = _lines(F.col(text))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    return joined.select(
        *(F.when(F.col("_gone").isNull(), F.col(c)).otherwise(kept).alias(old) if c == text else F.col(c).alias(old) for old, c in names.items() if old not in ("n_lines", "n_removed")),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def drop_boilerplate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", n_chars: str = "n_chars", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without boilerplate lines, with the same columns; ``n_chars``, if there, follows the text.

    A document goes only if it loses lines and nothing but blanks is left. Null and empty texts stay; texts of any length are cut whole; an
    empty table gives no rows.
    """
    plain, names = plain_names(docs)
    own = names[text]
    rows = without_spread_lines(plain, names[doc_id], own, names[site], min_sites)
    rows = rows.where((F.col("n_removed") == 0) | F.col(own).rlike(r"\S"))
    chars = names.get(n_chars)
    counted = lambda c: F.when(F.col("n_removed") > 0, F.length(own).cast(docs.schema[n_chars].dataType)).otherwise(F.col(c)) if c == chars else F.col(c)
    return rows.select(*(counted(new).alias(old) for old, new in names.items()))
