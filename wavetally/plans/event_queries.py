"""Alarm events and their scoring, over ``events`` as windows of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import DEFAULT
from ..operators import events as ev
from ..operators.intervals import merge_intervals
from ..operators.stats import quantiles
from ..operators.windowing import label_windows
from ..functions.scalars import guarded_ratio, ratio_or_zero
from .inputs import ANNOTATIONS_SQL, LENGTHS_SQL, SCORES_SQL, annotations, rnd, scores
from .registry import query

KEYS = ["record", "patient"]

RUNS_SQL = """runs AS (
    SELECT record, patient, min(w) AS first_w, max(w) AS last_w, count(*) AS n FROM (
        SELECT *, w - row_number() OVER (PARTITION BY record, patient ORDER BY w) AS island FROM sc WHERE score >= 0)
    GROUP BY record, patient, island HAVING count(*) >= 3)"""


def merged_sql(name: str, source: str, keys: str = "record, patient", test: str = "start_s - reach >= 90") -> str:
    """CTEs that merge the intervals of ``source``."""
    return f"""{name}_r AS (SELECT *, max(end_s) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
    {name}_g AS (SELECT *, sum(CASE WHEN reach IS NULL OR {test} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM {name}_r),
    {name} AS (SELECT {keys}, min(start_s) AS start_s, max(end_s) AS end_s FROM {name}_g GROUP BY {keys}, g)"""


def split_sql(name: str, source: str, keys: str = "record, patient") -> str:
    return f"""{name} AS (
    SELECT {keys}, start_s + i * 300 AS start_s, least(start_s + (i + 1) * 300, end_s) AS end_s
    FROM (SELECT *, unnest(range(0, greatest(ceil((end_s - start_s) / 300), 1)::BIGINT)) AS i FROM {source}))"""


MASK_SQL = """raw_alarm AS (
    SELECT r.record, r.patient, round_even(first_w * 2.5::DOUBLE, 0) AS start_s, least(round_even(last_w * 2.5::DOUBLE + 10, 0), round_even(duration, 0)) AS end_s
    FROM runs r JOIN len USING (record, patient)),
    """ + merged_sql("alarm", "raw_alarm", test="start_s - reach > 0")
REF_SQL = """raw_ref AS (
    SELECT DISTINCT a.record, a.patient, greatest(round_even(start_s, 0), 0) AS start_s, least(round_even(end_s, 0), round_even(duration, 0)) AS end_s
    FROM ann a JOIN len USING (record, patient)),
    ref0 AS (SELECT * FROM raw_ref WHERE end_s > start_s)"""
BASE_SQL = f"WITH {SCORES_SQL}, {LENGTHS_SQL}, {ANNOTATIONS_SQL}, {RUNS_SQL}, {MASK_SQL}, {REF_SQL}"
SCORED_SQL = f"{BASE_SQL}, {merged_sql('am', 'alarm')}, {split_sql('hyp', 'am')}, {merged_sql('rm', 'ref0')}, {split_sql('ref', 'rm')}, " + """
    hit AS (SELECT r.*, EXISTS (SELECT 1 FROM hyp h WHERE h.record = r.record AND h.start_s < r.end_s + 60 AND h.end_s > r.start_s - 30) AS hit FROM ref r),
    fp AS (SELECT h.* FROM hyp h WHERE NOT EXISTS (SELECT 1 FROM hit r WHERE r.hit AND r.record = h.record AND h.start_s < r.end_s + 60 AND h.end_s > r.start_s - 30))"""


def prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scores, record lengths, alarm intervals and reference intervals on the grid of seconds."""
    sc = scores(spark, sf_dir)
    lengths = ev.durations(sc, KEYS)
    alarms = ev.alarm_intervals(ev.alarm_runs(sc, KEYS), lengths, KEYS)
    return sc, lengths, alarms, ev.reference_intervals(annotations(sc), lengths, KEYS)


@query(f"WITH {SCORES_SQL}, {LENGTHS_SQL} SELECT record, patient, n_windows, duration FROM len")
def record_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.durations(scores(spark, sf_dir), KEYS)


@query(f"WITH {SCORES_SQL}, {RUNS_SQL} SELECT record, patient, first_w, last_w, n FROM runs")
def persistence_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.alarm_runs(scores(spark, sf_dir), KEYS)


@query(f"WITH {SCORES_SQL}, {LENGTHS_SQL}, {RUNS_SQL}, {MASK_SQL} SELECT record, patient, start_s, end_s FROM alarm")
def alarm_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, alarms, _ = prepared(spark, sf_dir)
    return alarms.withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query(f"{BASE_SQL} SELECT record, patient, start_s, end_s FROM ref0")
def reference_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, _, ref = prepared(spark, sf_dir)
    return ref.withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query(f"WITH {SCORES_SQL}, {RUNS_SQL} SELECT record, patient, (first_w + 2) * 2.5::DOUBLE + 10 AS armed FROM runs")
def arming_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.arming_times(ev.alarm_runs(scores(spark, sf_dir), KEYS), KEYS)


@query(f"{BASE_SQL}, {merged_sql('am', 'alarm')} SELECT record, patient, start_s, end_s FROM am")
def merge_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, alarms, _ = prepared(spark, sf_dir)
    return merge_intervals(alarms, KEYS, DEFAULT.merge_gap_s).withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query(f"{BASE_SQL}, {merged_sql('am', 'alarm')}, {split_sql('hyp', 'am')} SELECT record, patient, start_s, end_s FROM hyp")
def split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, alarms, _ = prepared(spark, sf_dir)
    return ev.scored_events(alarms, KEYS).withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query(
    f"{SCORED_SQL}" + """,
    n AS (SELECT patient, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp FROM (
        SELECT patient, CASE WHEN hit THEN 1 ELSE 0 END AS tp, CASE WHEN hit THEN 0 ELSE 1 END AS fn, 0 AS fp FROM hit
        UNION ALL SELECT patient, 0, 0, 1 FROM fp) GROUP BY patient),
    h AS (SELECT patient, sum(duration) / 3600 AS hours FROM len GROUP BY patient)
    SELECT patient, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp, round(hours, 6) AS hours,
           round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS sensitivity, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision,
           round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
           round(coalesce(fp, 0) / hours, 6) AS fp_per_hour, round(coalesce(fp, 0) / hours * 24, 6) AS fp_per_day
    FROM h LEFT JOIN n USING (patient)"""
)
def event_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per patient: detected, missed and false events, their ratios, and false alarms by time."""
    _, lengths, alarms, ref = prepared(spark, sf_dir)
    counts = ev.event_counts(ev.scored_events(ref, KEYS), ev.scored_events(alarms, KEYS), KEYS)
    counts = counts.groupBy("patient").agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp")))
    hours = lengths.groupBy("patient").agg((F.sum("duration") / 3600).alias("hours"))
    rows = hours.join(counts, "patient", "left").na.fill(0, ["tp", "fn", "fp"])
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return rows.select(
        "patient", "tp", "fn", "fp", rnd(F.col("hours")).alias("hours"),
        rnd(ratio_or_zero(tp, tp + fn)).alias("sensitivity"), rnd(ratio_or_zero(tp, tp + fp)).alias("precision"), rnd(ratio_or_zero(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        rnd(fp / F.col("hours")).alias("fp_per_hour"), rnd(fp / F.col("hours") * 24).alias("fp_per_day"),
    )


@query(f"{SCORED_SQL} SELECT record, patient, start_s, end_s - start_s AS duration_s FROM fp")
def false_positive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, alarms, ref = prepared(spark, sf_dir)
    false = ev.false_alarms(ev.scored_events(ref, KEYS), ev.scored_events(alarms, KEYS), KEYS)
    return false.select("record", "patient", F.col("start").alias("start_s"), (F.col("end") - F.col("start")).alias("duration_s"))


@query(
    f"{BASE_SQL}, {merged_sql('rr', 'ref0', test='start_s - reach > 0')}, " + """
    a AS (SELECT DISTINCT record, patient, unnest(range(start_s::BIGINT, end_s::BIGINT)) AS s FROM alarm),
    r AS (SELECT DISTINCT record, patient, unnest(range(start_s::BIGINT, end_s::BIGINT)) AS s FROM rr)
    SELECT coalesce(a.record, r.record) AS record, coalesce(a.patient, r.patient) AS patient,
           (count(*) FILTER (a.s IS NOT NULL AND r.s IS NOT NULL))::BIGINT AS tp, (count(*) FILTER (r.s IS NULL))::BIGINT AS fp, (count(*) FILTER (a.s IS NULL))::BIGINT AS fn
    FROM a FULL OUTER JOIN r ON a.record = r.record AND a.patient = r.patient AND a.s = r.s GROUP BY 1, 2"""
)
def sample_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, alarms, ref = prepared(spark, sf_dir)
    return ev.sample_counts(ref, alarms, KEYS)


DETECT_SQL = f"""WITH {SCORES_SQL}, {LENGTHS_SQL}, {ANNOTATIONS_SQL}, {RUNS_SQL},
    arm AS (SELECT record, patient, (first_w + 2) * 2.5::DOUBLE + 10 AS armed FROM runs),
    det AS (SELECT a.record, a.patient, a.start_s, a.end_s, min(armed) AS armed FROM (SELECT DISTINCT * FROM ann) a
            LEFT JOIN arm ON a.record = arm.record AND a.patient = arm.patient AND armed BETWEEN start_s - 30 AND end_s + 60 GROUP BY ALL)"""


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = scores(spark, sf_dir)
    return ev.detections(annotations(sc).distinct(), ev.arming_times(ev.alarm_runs(sc, KEYS), KEYS), KEYS)


@query(f"{DETECT_SQL} SELECT record, patient, start_s, end_s, (armed IS NOT NULL)::INTEGER AS detected, armed - start_s AS latency FROM det")
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detections(spark, sf_dir).select("record", "patient", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "detected", F.bround("latency", 6).alias("latency"))


@query(
    f"{DETECT_SQL} SELECT patient, count(*) FILTER (armed IS NOT NULL) AS n_detected, round(median(armed - start_s), 6) AS latency_median, round(avg(armed - start_s), 6) AS latency_mean FROM det GROUP BY patient"
)
def detection_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).withColumn("latency", F.bround("latency", 6))
    return d.groupBy("patient").agg(F.sum("detected").cast("long").alias("n_detected"), rnd(F.median("latency")).alias("latency_median"), rnd(F.avg("latency")).alias("latency_mean"))


def _k_sql(k: int) -> str:
    return SCORED_SQL.replace("HAVING count(*) >= 3", f"HAVING count(*) >= {k}") + f"""
    SELECT {k} AS k, (SELECT count(*) FROM hit WHERE hit) AS tp, (SELECT count(*) FROM hit WHERE NOT hit) AS fn, (SELECT count(*) FROM fp) AS fp, (SELECT sum(duration) FROM len) AS seconds"""


@query(
    "SELECT k, tp, fn, fp, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round(fp / (seconds / 86400), 6) AS fp_per_day FROM ("
    + " UNION ALL ".join(f"SELECT * FROM ({_k_sql(k)})" for k in DEFAULT.k_sweep)
    + ")"
)
def k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All run lengths in one plan: k is a key of the runs, the alarms and the counts."""
    sc = scores(spark, sf_dir)
    lengths = ev.durations(sc, KEYS)
    ks = [*KEYS, "k"]
    swept = ev.alarm_runs(sc.withColumn("k", F.explode(F.array(*map(F.lit, DEFAULT.k_sweep)))), ks, k="k")
    alarms = ev.scored_events(ev.alarm_intervals(swept, lengths, ks), ks)
    ref = ev.scored_events(ev.reference_intervals(annotations(sc), lengths, KEYS), KEYS).withColumn("k", F.explode(F.array(*map(F.lit, DEFAULT.k_sweep))))
    counts = ev.event_counts(ref, alarms, ks).groupBy("k").agg(*(F.sum(c).alias(c) for c in ("tp", "fn", "fp")))
    rows = counts.crossJoin(F.broadcast(lengths.agg(F.sum("duration").alias("seconds"))))  # one row
    tp, fn, fp = F.col("tp"), F.col("fn"), F.col("fp")
    return rows.select("k", "tp", "fn", "fp", rnd(guarded_ratio(tp, tp + fn)).alias("sensitivity"), rnd(ratio_or_zero(2 * tp, 2 * tp + fp + fn)).alias("f1"), rnd(fp / (F.col("seconds") / 86400)).alias("fp_per_day"))


_SWEEP_SQL = "".join(["SELECT k, tp, fn, fp, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(fp / (seconds / 86400), 6) AS fp_per_day FROM (", " UNION ALL ".join(f"SELECT * FROM ({_k_sql(k)})" for k in DEFAULT.k_sweep), ")"])


@query(
    f"WITH s AS ({_SWEEP_SQL}) SELECT s.k, round(s.sensitivity - b.sensitivity, 6) AS sensitivity_delta, round(s.fp_per_day - b.fp_per_day, 6) AS fp_per_day_delta FROM s, s b WHERE b.k = 3"
)
def k_sweep_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep as differences from the default run length."""
    s = k_sweep(spark, sf_dir)
    base = s.where(F.col("k") == DEFAULT.k).select(F.col("sensitivity").alias("s0"), F.col("fp_per_day").alias("f0"))
    return s.crossJoin(F.broadcast(base)).select("k", rnd(F.col("sensitivity") - F.col("s0")).alias("sensitivity_delta"), rnd(F.col("fp_per_day") - F.col("f0")).alias("fp_per_day_delta"))


FP_SQL = f"{SCORED_SQL}, d AS (SELECT record, patient, end_s - start_s AS duration FROM fp)"


def _false_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return false_positive_rows(spark, sf_dir).select("record", "patient", F.col("duration_s").alias("duration"))


@query(
    f"""{FP_SQL} SELECT o.pos, o.bucket, count(d.duration) AS n FROM (VALUES (1, '<=20'), (2, '20-60'), (3, '60-300'), (4, '>=300')) o(pos, bucket)
    LEFT JOIN d ON o.bucket = CASE WHEN duration <= 20 THEN '<=20' WHEN duration < 60 THEN '20-60' WHEN duration < 300 THEN '60-300' ELSE '>=300' END GROUP BY o.pos, o.bucket"""
)
def fp_duration_buckets_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration")
    bucket = F.when(d <= 20, "<=20").when(d < 60, "20-60").when(d < 300, "60-300").otherwise(">=300")
    order = spark.createDataFrame([(1, "<=20"), (2, "20-60"), (3, "60-300"), (4, ">=300")], "pos int, bucket string")
    counts = _false_durations(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return F.broadcast(order).join(counts, "bucket", "left").select("pos", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""{FP_SQL}, t AS (SELECT count(*) FILTER (duration <= 20) AS a, count(*) FILTER (duration > 20 AND duration <= 60) AS b, count(*) FILTER (duration > 60) AS c, count(*) FILTER (duration = 300) AS e, count(*) AS n FROM d)
    SELECT bucket, m AS n, round(100.0 * m / nullif(n, 0)::DOUBLE, 1) AS share FROM t, LATERAL (VALUES ('<=20', a), ('20-60', b), ('>60', c), ('=300', e)) v(bucket, m)"""
)
def fp_duration_buckets_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("duration")
    tests = {"<=20": d <= 20, "20-60": (d > 20) & (d <= 60), ">60": d > 60, "=300": d == 300}
    t = _false_durations(spark, sf_dir).agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in tests.items()))
    rows = t.select("total", F.explode(F.array(*(F.struct(F.lit(k).alias("bucket"), F.col(f"`{k}`").alias("n")) for k in tests))).alias("b"))
    return rows.select("b.bucket", "b.n", F.round(guarded_ratio(100.0 * F.col("b.n"), F.col("total")), 1).alias("share"))


@query(f"{FP_SQL} SELECT round(median(duration), 6) AS median, round(quantile_cont(duration, 0.25::DOUBLE), 6) AS q1, round(quantile_cont(duration, 0.75::DOUBLE), 6) AS q3, count(*) AS n FROM d")
def duration_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _false_durations(spark, sf_dir)
    q = quantiles(d, [], "duration", {"median": 0.5, "q1": 0.25, "q3": 0.75})
    return q.crossJoin(d.agg(F.count("*").alias("n"))).select(*(rnd(F.col(name)).alias(name) for name in ("median", "q1", "q3")), "n")  # one row each


@query(
    f"""{SCORED_SQL}, n AS (SELECT patient, count(*) FILTER (k = 'fn') AS fn, count(*) FILTER (k = 'fp') AS fp FROM (SELECT patient, 'fn' AS k FROM hit WHERE NOT hit UNION ALL SELECT patient, 'fp' FROM fp) GROUP BY patient)
    SELECT patient, fn, fp, round(100.0 * fn / nullif(sum(fn) OVER (), 0)::DOUBLE, 6) AS fn_share, round(100.0 * fp / nullif(sum(fp) OVER (), 0)::DOUBLE, 6) AS fp_share, row_number() OVER (ORDER BY fn DESC, fp DESC, patient) AS place FROM n"""
)
def error_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patient's share of the missed and the false events, the worst first."""
    _, _, alarms, ref = prepared(spark, sf_dir)
    c = ev.event_counts(ev.scored_events(ref, KEYS), ev.scored_events(alarms, KEYS), KEYS).groupBy("patient").agg(F.sum("fn").alias("fn"), F.sum("fp").alias("fp")).where("fn + fp > 0")
    total = c.agg(F.sum("fn").alias("fn_all"), F.sum("fp").alias("fp_all"))
    rows = c.crossJoin(F.broadcast(total))
    place = F.row_number().over(Window.orderBy(F.desc("fn"), F.desc("fp"), "patient"))  # a row per patient
    return rows.select("patient", "fn", "fp", rnd(guarded_ratio(100.0 * F.col("fn"), F.col("fn_all"))).alias("fn_share"), rnd(guarded_ratio(100.0 * F.col("fp"), F.col("fp_all"))).alias("fp_share"), place.cast("long").alias("place"))


@query(
    f"""{SCORED_SQL}, h AS (SELECT patient, record, duration / 3600 AS hours, n_windows FROM len), r AS (SELECT DISTINCT record, patient FROM ref),
    f AS (SELECT record, patient, count(*) AS fp FROM fp GROUP BY ALL)
    SELECT r.record IS NOT NULL AS has_event, count(*) AS n_records, sum(coalesce(fp, 0))::BIGINT AS fp, round(sum(coalesce(fp, 0)) / sum(hours), 6) AS fp_per_hour, round(1000.0 * sum(coalesce(fp, 0)) / sum(n_windows), 6) AS fp_per_1000_windows
    FROM h LEFT JOIN r USING (record, patient) LEFT JOIN f USING (record, patient) GROUP BY 1"""
)
def rate_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False alarms by whether a record has a reference event: counts and rates."""
    _, lengths, alarms, ref = prepared(spark, sf_dir)
    ref = ev.scored_events(ref, KEYS)
    false = ev.false_alarms(ref, ev.scored_events(alarms, KEYS), KEYS).groupBy(*KEYS).agg(F.count("*").alias("fp"))
    rows = lengths.join(ref.select(*KEYS).distinct().withColumn("has_event", F.lit(True)), KEYS, "left").join(false, KEYS, "left")
    g = rows.groupBy(F.coalesce("has_event", F.lit(False)).alias("has_event")).agg(F.count("*").alias("n_records"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"), (F.sum("duration") / 3600).alias("hours"), F.sum("n_windows").alias("n"))
    return g.select("has_event", "n_records", "fp", rnd(F.col("fp") / F.col("hours")).alias("fp_per_hour"), rnd(1000.0 * F.col("fp") / F.col("n")).alias("fp_per_1000_windows"))


@query(
    f"""{BASE_SQL}, o AS (SELECT s.record, s.patient, s.w, sum(CASE WHEN r.start_s IS NULL THEN 0 ELSE greatest(0, least(s.w * 2.5::DOUBLE + 10, r.end_s) - greatest(s.w * 2.5::DOUBLE, r.start_s)) END) AS seconds
        FROM sc s LEFT JOIN rr r ON s.record = r.record AND s.patient = r.patient AND r.start_s < s.w * 2.5::DOUBLE + 10 AND r.end_s > s.w * 2.5::DOUBLE GROUP BY ALL)
    SELECT record, patient, w, seconds, (seconds / 10 >= 0.6)::INTEGER AS label FROM o""".replace("o AS (SELECT s.record", merged_sql("rr", "ref0", test="start_s - reach > 0") + ", o AS (SELECT s.record")
)
def interval_label_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows labelled by the share of them that reference intervals cover."""
    sc, _, _, ref = prepared(spark, sf_dir)
    return label_windows(sc.select(*KEYS, "w"), merge_intervals(ref, KEYS, 0.0, strict=False), KEYS)


@query(
    SCORED_SQL + """,
    lv AS (SELECT 'window' AS level, (count(*) FILTER (score >= 0 AND y = 1))::BIGINT AS tp, (count(*) FILTER (score >= 0 AND y = 0))::BIGINT AS fp, (count(*) FILTER (score < 0 AND y = 1))::BIGINT AS fn FROM sc
        UNION ALL SELECT 'event', (SELECT count(*) FROM hit WHERE hit), (SELECT count(*) FROM fp), (SELECT count(*) FROM hit WHERE NOT hit))
    SELECT level, tp, fp, fn, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS sensitivity, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM lv"""
)
def window_event_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores judged by windows and by events."""
    sc, _, alarms, ref = prepared(spark, sf_dir)
    hit, pos = F.col("score") >= 0, F.col("y") == 1
    by_window = sc.agg(F.lit("window").alias("level"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))
    counts = ev.event_counts(ev.scored_events(ref, KEYS), ev.scored_events(alarms, KEYS), KEYS)
    by_event = counts.agg(F.lit("event").alias("level"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return by_window.unionByName(by_event).select("level", "tp", "fp", "fn", rnd(ratio_or_zero(tp, tp + fn)).alias("sensitivity"), rnd(ratio_or_zero(tp, tp + fp)).alias("precision"), rnd(ratio_or_zero(2 * tp, 2 * tp + fp + fn)).alias("f1"))
