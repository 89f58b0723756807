"""The given tables in the roles that the operators ask for, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..tables import table


def rnd(c, digits: int = 6):
    """A double rounded for comparison."""
    return F.round(c, digits)


# --- events: a score and a label per window of a record -------------------------------------

SCORES_SQL = """sc AS (
    SELECT user_id AS record, 'p' || lpad((user_id % 24 + 1)::VARCHAR, 2, '0') AS patient,
           row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS w,
           value - 50 AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, event_type, event_id
    FROM events)"""

LENGTHS_SQL = """len AS (SELECT record, patient, count(*) AS n_windows, (count(*) - 1) * 2.5::DOUBLE + 10 AS duration FROM sc GROUP BY record, patient)"""

ANNOTATIONS_SQL = """ann AS (
    SELECT record, patient, w * 2.5::DOUBLE AS start_s, w * 2.5::DOUBLE + 20 + (event_id % 5) * 10 AS end_s
    FROM sc WHERE event_type = 'purchase' AND event_id % 3 = 0)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record, patient, w, score, y)``: a user's events in time order are the windows of a record."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return e.select(
        F.col("user_id").alias("record"),
        F.concat(F.lit("p"), F.lpad((F.col("user_id") % 24 + 1).cast("string"), 2, "0")).alias("patient"),
        (F.row_number().over(order) - 1).cast("long").alias("w"),
        (F.col("value") - 50).alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y"),
        "event_type",
        "event_id",
    )


def annotations(sc: DataFrame) -> DataFrame:
    """``(record, patient, start, end)``: an interval from a part of the purchases."""
    start = F.col("w") * 2.5
    rows = sc.where((F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0))
    return rows.select("record", "patient", start.alias("start"), (start + 20 + (F.col("event_id") % 5) * 10).alias("end"))


# --- lineitem: ranked selections of directed, band-limited edges ------------------------------

SELECTION_SQL = """sel AS (
    SELECT l_orderkey AS record, 'p' || lpad(c_nationkey::VARCHAR, 2, '0') AS patient,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS rank,
           (l_linenumber % 5)::INTEGER AS band, (l_partkey % 18 + 1)::INTEGER AS src, (l_suppkey % 18 + 1)::INTEGER AS tgt,
           l_extendedprice AS price, l_quantity AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_partkey % 18 <> l_suppkey % 18)"""

WEIGHTS_SQL = """wt AS (
    SELECT *, raw / sum(raw) OVER (PARTITION BY patient, record) / n_records AS weight FROM (
        SELECT s.*, (21 - rank)::DOUBLE AS raw, n.n_records FROM sel s
        JOIN (SELECT patient, count(DISTINCT record) AS n_records FROM sel WHERE rank <= 20 GROUP BY patient) n ON s.patient = n.patient
        WHERE rank <= 20))"""


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record, patient, rank, band, src, tgt, price, quantity)``: an order's lines are a fold's ranked features."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate").where("l_partkey % 18 <> l_suppkey % 18")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = l.join(o.join(c, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_orderkey").alias("record"),
        F.concat(F.lit("p"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("patient"),
        F.row_number().over(order).cast("long").alias("rank"),
        (F.col("l_linenumber") % 5).cast("int").alias("band"),
        (F.col("l_partkey") % 18 + 1).cast("int").alias("src"),
        (F.col("l_suppkey") % 18 + 1).cast("int").alias("tgt"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"),
    )


# --- embeddings: feature vectors with a binary label ------------------------------------------

FEATURES_SQL = """ft AS (
    SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y, label, i - 1 AS feature, embedding[i]::DOUBLE AS x
    FROM embeddings, unnest(range(1, len(embedding) + 1)) AS r(i))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, y, label, feature, x)``: the long form of the vectors; label 0 is the positive class."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.when(F.col("label") == 0, 1).otherwise(0).alias("y"), "label", F.posexplode("embedding").alias("feature", "x")).withColumn("x", F.col("x").cast("double"))
