"""Sources, names, sets and reshaping, over the tables as listings, texts and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import scalars as fn
from ..operators import series as sr
from ..operators.stats import quantiles
from ..sources import recordings as rc, summaries as sm
from ..tables import table
from .inputs import SCORES_SQL, rnd, scores
from .registry import query


@query("SELECT p_partkey, regexp_replace(replace(trim(upper(p_name || '-' || p_size)), ' ', ''), '-[0-9]+$', '') AS name, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits FROM part")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", fn.normalise_name(F.concat_ws("-", "p_name", F.col("p_size").cast("string"))).alias("name"), F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"))


@query("SELECT name, p_partkey AS first_key, n FROM (SELECT p_partkey, p_brand AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE r = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each name; a minimum per group, so that no group has to be sorted."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("n"))


@query(f"WITH {SCORES_SQL} SELECT record, 'r' || lpad((record // 10)::VARCHAR, 2, '0') || '_' || lpad((record % 10)::VARCHAR, 2, '0') || '.edf' AS file, row_number() OVER (PARTITION BY record ORDER BY w)::INTEGER AS n, w * 3 AS start_sec, w * 3 + 40 AS end_sec FROM sc WHERE event_type = 'purchase'")
def summary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary texts made from the events of each record, and read back by the parser."""
    sc = scores(spark, sf_dir).where("event_type = 'purchase'")
    g = sc.groupBy("record").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    line = F.transform("ws", lambda w, i: F.format_string("Event %d Start Time: %d seconds\nEvent %d End Time: %d seconds", i + 1, w * 3, i + 1, w * 3 + 40))
    name = F.concat(F.lit("r"), F.lpad(F.floor(F.col("record") / 10).cast("string"), 2, "0"), F.lit("_"), F.lpad((F.col("record") % 10).cast("string"), 2, "0"), F.lit(".edf"))
    texts = g.select(F.col("record").cast("string").alias("path"), F.concat(F.lit("File Name: "), name, F.lit("\nNumber of Events: "), F.size("ws").cast("string"), F.lit("\n"), F.array_join(line, "\n")).alias("value"))
    return sm.parse_summaries(texts, "Event").select(F.col("path").cast("bigint").alias("record"), "file", "n", "start_sec", "end_sec")


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, len(regexp_extract_all(html, '<li>'))::BIGINT AS n_items, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields cut from texts by patterns."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("n_items"), F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))


@query("SELECT (SELECT count(DISTINCT c_nationkey) FROM customer) AS n_expected, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS n_found, (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)) AS n_missing, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer)) AS n_extra")
def set_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return rc.audit(e, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("SELECT o_custkey AS k, 'both' AS side FROM orders INTERSECT SELECT c_custkey, 'both' FROM customer UNION ALL (SELECT c_custkey, 'only' FROM customer EXCEPT SELECT o_custkey, 'only' FROM orders)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return c.intersect(o).withColumn("side", F.lit("both")).unionByName(c.subtract(o).withColumn("side", F.lit("only")))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_partkey, p_brand, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) AS member FROM part")
def membership_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("member", F.lit(True))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(hit, "p_partkey", "left").withColumn("member", F.coalesce("member", F.lit(False)))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM a FULL OUTER JOIN b ON a.k = b.k""")
def full_outer_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "k", "outer").na.fill(0, ["n_customers", "n_suppliers"])


@query("""WITH a AS (SELECT s_nationkey, row_number() OVER (ORDER BY max(s_acctbal) DESC, s_nationkey) AS r, round(max(s_acctbal), 2) AS best FROM supplier GROUP BY 1), b AS (SELECT c_nationkey, row_number() OVER (ORDER BY max(c_acctbal) DESC, c_nationkey) AS r, round(max(c_acctbal), 2) AS top FROM customer GROUP BY 1)
    SELECT r AS place, s_nationkey, best, c_nationkey, top FROM a JOIN b USING (r)""")
def positional_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists sorted on their own and paired by place; each has a row per nation."""
    a = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.round(F.max("s_acctbal"), 2).alias("best"))
    b = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.max("c_acctbal"), 2).alias("top"))
    a = a.withColumn("place", F.row_number().over(Window.orderBy(F.desc("best"), "s_nationkey")).cast("long"))
    b = b.withColumn("place", F.row_number().over(Window.orderBy(F.desc("top"), "c_nationkey")).cast("long"))
    return a.join(b, "place")


@query("SELECT o_orderpriority, n, n_open, n_done FROM (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'F') AS n_done FROM orders GROUP BY 1)")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))


@query("SELECT n_nationkey, n_name, r_name, coalesce(n, 0) AS n_suppliers, coalesce(n_name, 'f' || lpad(n_nationkey::VARCHAR, 4, '0')) AS label FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def reindex_to_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the whole dimension, zero where there is nothing, with names that fall back to a number."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    rows = n.join(s, "n_nationkey", "left").withColumn("feature_index", F.col("n_nationkey"))
    named = rc.lookup_names(rows, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("feature_index"), F.col("n_name").alias("name")))
    return named.select("n_nationkey", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n_suppliers"), F.col("name").alias("label"))


@query("SELECT p_partkey, p_size, ntile(5) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS bin FROM part")
def contiguous_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly equal contiguous bins, the larger ones first."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.ntile(5).over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("long").alias("bin"))


@query(f"WITH {SCORES_SQL} SELECT record, patient, w, round(w * 2.5::DOUBLE, 6) AS start_s, (w * 640)::BIGINT AS start_sample, round(w * 640 / 256.0::DOUBLE, 6) AS back_s, sign(score)::INTEGER AS sign, round(greatest(abs(score), 0.5), 6) AS clipped FROM sc")
def unit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds to samples and back, signs and clipped values."""
    s = scores(spark, sf_dir).withColumn("start_s", F.col("w") * 2.5)
    s = s.withColumn("start_sample", fn.to_samples(F.col("start_s"), 256))
    return s.select("record", "patient", "w", rnd(F.col("start_s")).alias("start_s"), "start_sample", rnd(fn.to_seconds(F.col("start_sample"), 256)).alias("back_s"), F.signum("score").cast("int").alias("sign"), rnd(fn.clip_floor(F.abs("score"), 0.5)).alias("clipped"))


@query(f"WITH {SCORES_SQL} SELECT record, patient, w, greatest(w * 2.5::DOUBLE, 20) AS start_s, least(w * 2.5::DOUBLE + 10, 60) AS end_s FROM sc WHERE w * 2.5 + 10 >= 20 AND w * 2.5 <= 60")
def time_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that touch a range of time, clipped to it."""
    s, e = F.col("w") * 2.5, F.col("w") * 2.5 + 10
    return scores(spark, sf_dir).where((e >= 20) & (s <= 60)).select("record", "patient", "w", F.greatest(s, F.lit(20.0)).alias("start_s"), F.least(e, F.lit(60.0)).alias("end_s"))


@query("SELECT mktsegment, round(median(bal), 6) AS median_balance, row_number() OVER (ORDER BY median(bal), mktsegment) AS place FROM (SELECT c_mktsegment AS mktsegment, c_acctbal AS bal FROM customer) GROUP BY mktsegment")
def ordered_by_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordering dimension: groups by their median; a row per group."""
    g = quantiles(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("mktsegment"), "c_acctbal"), ["mktsegment"], "c_acctbal", {"m": 0.5})
    return g.select("mktsegment", rnd(F.col("m")).alias("median_balance"), F.row_number().over(Window.orderBy("m", "mktsegment")).cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("r", r).where("r <= 3").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, count(*) AS n FROM s GROUP BY user_id, i""")
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user joined into sessions by a gap; the streaming form is in :mod:`wavetally.streaming.alarms`."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id", F.session_window("ts", "90 minutes").alias("s")).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    return g.select("user_id", F.date_format("first_ts", "yyyy-MM-dd HH:mm:ss").alias("first_ts"), "n")


@query("SELECT label AS record, (i - 1)::INTEGER AS channel_idx, count(*)::INTEGER AS n, round(sum(embedding[i]::DOUBLE), 4) AS before, count(*)::INTEGER AS n_back, round(sum(embedding[i]::DOUBLE), 4) AS after FROM embeddings, unnest(range(1, len(embedding) + 1)) r(i) GROUP BY label, i")
def recording_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels in stored blocks: lengths and sums of their samples, and of the blocks when read again."""
    e = sr.numbered(table(spark, sf_dir, "embeddings").select(F.col("label").alias("record"), "vec_id", "embedding"), ["record"], "vec_id")
    long = e.select("record", "s", F.posexplode("embedding").alias("channel", "x"))
    back = sr.blocks_of(long, ["record"], 16).select("record", F.col("channel").alias("channel_idx"), F.explode("samples").alias("x"))
    total = lambda n, s: (F.count("*").cast("int").alias(n), F.round(F.sum(F.col("x").cast("double")), 4).alias(s))
    return long.groupBy("record", F.col("channel").alias("channel_idx")).agg(*total("n", "before")).join(back.groupBy("record", "channel_idx").agg(*total("n_back", "after")), ["record", "channel_idx"])


#: A supplier's lines of a year are the channels of a record: the part's brand names one, order and line number are its place.
MONTAGE_SQL = """ln AS (SELECT l_suppkey * 10000 + year(l_shipdate::DATE) AS record, replace(trim(upper(p_brand)), ' ', '') AS name, l_orderkey * 10 + l_linenumber AS channel_idx, l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
    wanted AS (SELECT DISTINCT replace(trim(upper(p_brand)), ' ', '') AS name FROM part WHERE p_brand LIKE '%3%'),
    ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record, name ORDER BY channel_idx) AS r FROM ln) WHERE r = 1),
    hv AS (SELECT record, name, channel_idx, x FROM ft JOIN wanted USING (name)), ok AS (SELECT record FROM hv GROUP BY record HAVING count(*) = (SELECT count(*) FROM wanted))"""


def _montage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 10000 + F.year("l_shipdate")).alias("record"), "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("channel_idx"), "l_quantity")
    channels = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("record", F.col("p_brand").alias("channel"), "channel_idx", F.col("l_quantity").alias("x"))
    names = part.where("p_brand like '%3%'").select(fn.normalise_name(F.col("p_brand")).alias("name")).distinct()
    wanted = names.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("pos"))  # a row per channel of the montage
    return rc.montage(channels, wanted, ["record"])


@query(f"WITH {MONTAGE_SQL} SELECT record, count(*) AS n_channels, sum(channel_idx)::BIGINT AS checksum, round(sum(x), 2) AS total FROM hv JOIN ok USING (record) GROUP BY record")
def montage_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that have every channel of the montage, and the channels picked: of equal names the first."""
    got, _ = _montage(spark, sf_dir)
    return got.groupBy("record").agg(F.count("*").alias("n_channels"), F.sum("channel_idx").cast("long").alias("checksum"), F.round(F.sum("x"), 2).alias("total"))


@query(f"WITH {MONTAGE_SQL} SELECT l.record, string_agg(w.name, ';' ORDER BY w.name) AS missing FROM (SELECT DISTINCT record FROM ln) l, wanted w WHERE NOT EXISTS (SELECT 1 FROM hv WHERE hv.record = l.record AND hv.name = w.name) GROUP BY l.record")
def montage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other records miss."""
    missing = _montage(spark, sf_dir)[1]
    return missing.select("record", F.array_join(F.array_sort("missing"), ";").alias("missing"))


@query("SELECT label % 3 AS patient, label AS record, vec_id AS w, (label = 0 AND vec_id % 2 = 0)::INTEGER AS label, (max((label = 0 AND vec_id % 2 = 0)::INTEGER) OVER (PARTITION BY label))::INTEGER AS record_class FROM embeddings WHERE vec_id % 11 <> 0")
def usable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complex features made real; windows with an imaginary part beyond the tolerance go."""
    e = table(spark, sf_dir, "embeddings")
    imag = F.when(F.col("vec_id") % 11 == 0, 1e-3).otherwise(0.0)
    rows = e.select((F.col("label") % 3).alias("patient"), F.col("label").alias("record"), F.col("vec_id").alias("w"), ((F.col("label") == 0) & (F.col("vec_id") % 2 == 0)).cast("int").alias("y"), F.transform("embedding", lambda x: F.struct(x.cast("double").alias("real"), imag.alias("imag"))).alias("features")).withColumnRenamed("y", "label")
    return rc.usable_windows(rows).select("patient", "record", "w", "label", "record_class")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4.0::DOUBLE, 1) AS tenths, round_even(l_quantity / 2.0::DOUBLE, 0)::BIGINT AS whole FROM lineitem")
def presentation_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as they are shown: halves go to the even digit."""
    l = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("double")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", F.bround(q / 4, 1).alias("tenths"), F.bround(q / 2, 0).cast("long").alias("whole"))


@query(f"WITH {SCORES_SQL} SELECT patient, count(*) AS n_windows, patient IN ('p03', 'p07', 'p11') AS in_shard, true AS in_all FROM sc GROUP BY patient")
def patient_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run that is told a list of patients takes each of them, and that a run without a list takes all."""
    return scores(spark, sf_dir).groupBy("patient").agg(F.count("*").alias("n_windows")).select("patient", "n_windows", fn.in_shard(F.col("patient"), " p03,p07 , p11,").alias("in_shard"), fn.in_shard(F.col("patient"), " ").alias("in_all"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, list_max(list_transform(v, lambda x: abs(x))) AS peak, v FROM v)
    SELECT vec_id, peak < 0.3 AS rescaled, round(CASE WHEN peak < 0.3 THEN peak * 1000000 ELSE peak END, 3) AS peak_after FROM s""")
def unit_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals whose largest value says volts become microvolts; the others stay."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fixed = e.select("vec_id", "v", fn.to_microvolts(F.col("v"), 0.3).alias("u"))
    peak = lambda c: F.array_max(F.transform(c, lambda x: F.abs(x)))
    return fixed.select("vec_id", (peak("v") < 0.3).alias("rescaled"), F.round(peak("u"), 3).alias("peak_after"))


@query("""WITH m AS (SELECT l_orderkey AS k, l_linenumber - 1 AS i, [l_quantity::DOUBLE, l_extendedprice::DOUBLE] AS r FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i, r) - 1 AS pos FROM m)
    SELECT k, count(*) > 2 AS turned, CASE WHEN count(*) > 2 THEN 2 ELSE count(*) END AS n_rows, CASE WHEN count(*) > 2 THEN count(*) ELSE 2 END AS n_columns, round(sum(r[1]), 2) AS first_sum FROM n GROUP BY k""")
def orientation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of an order's lines by two measures: those with more rows than columns are turned, so that channels come first."""
    l = table(spark, sf_dir, "lineitem")
    row = F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"))
    m = l.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") - 1).alias("i"), row.alias("r")))), lambda x: x["r"]).alias("m"))
    wide = m.select("k", (F.size("m") > 2).alias("turned"), fn.channels_first(F.col("m")).alias("c"), "m")
    total = F.aggregate(F.transform("m", lambda r: r[0]), F.lit(0.0), lambda a, x: a + x)
    return wide.select("k", "turned", F.size("c").cast("long").alias("n_rows"), F.size(F.col("c")[0]).cast("long").alias("n_columns"), F.round(total, 2).alias("first_sum"))
