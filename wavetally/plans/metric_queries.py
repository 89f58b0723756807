"""Window-level metrics and their summaries, over ``events`` as scored windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import guarded_ratio, label_number, ratio_or_zero
from ..operators import metrics as mt
from ..tables import table
from .inputs import LENGTHS_SQL, SCORES_SQL, rnd, scores
from .registry import query

KEYS = ["record", "patient"]
METRICS = ["accuracy", "specificity", "sensitivity", "precision", "f1"]
R = lambda names: [rnd(F.col(m)).alias(m) for m in names]

CONFUSION_SQL = f"""{SCORES_SQL}, cn AS (
    SELECT record, patient, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (score >= 0 AND y = 1) AS tp, count(*) FILTER (score < 0 AND y = 0) AS tn,
           count(*) FILTER (score >= 0 AND y = 0) AS fp, count(*) FILTER (score < 0 AND y = 1) AS fn FROM sc GROUP BY record, patient),
    cm AS (SELECT *, (tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE AS accuracy, tn / nullif(tn + fp, 0)::DOUBLE AS specificity, tp / nullif(tp + fn, 0)::DOUBLE AS sensitivity, tp / nullif(tp + fp, 0)::DOUBLE AS precision FROM cn),
    cf AS (SELECT *, 2 * sensitivity * precision / nullif(sensitivity + precision, 0) AS f1 FROM cm)"""
RSQL = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion(scores(spark, sf_dir), KEYS)


@query(f"WITH {CONFUSION_SQL} SELECT record, patient, n, tp, tn, fp, fn, {RSQL} FROM cf")
def confusion_by_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(spark, sf_dir).select(*KEYS, "n", "tp", "tn", "fp", "fn", *R(METRICS))


@query(
    f"""WITH {CONFUSION_SQL} SELECT record, patient, n_pos > 0 AS has_event, {", ".join(f"CASE WHEN n_pos > 0 THEN round({m}, 6) END AS {m}" for m in METRICS)} FROM cf"""
)
def blanked_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of records without any positive window are blank."""
    some = F.col("n_pos") > 0
    return confusion(spark, sf_dir).select(*KEYS, some.alias("has_event"), *(F.when(some, rnd(F.col(m))).alias(m) for m in METRICS))


POOLED_SQL = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE, 6) AS sensitivity, round(sum(tp) / nullif(sum(tp) + sum(fp), 0)::DOUBLE, 6) AS precision, round(coalesce(2 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0)::DOUBLE, 0), 6) AS f1"


@query(f"WITH {CONFUSION_SQL} SELECT {POOLED_SQL} FROM cf")
def pooled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.pooled(confusion(spark, sf_dir)).select("tp", "fp", "fn", *R(["sensitivity", "precision", "f1"]))


MACRO_SQL = f"""mp AS (SELECT patient, {", ".join(f"median({m}) AS {m}" for m in METRICS)} FROM cf GROUP BY patient)"""


@query(f"""WITH {CONFUSION_SQL}, {MACRO_SQL} SELECT {", ".join(f"round(median({m}), 6) AS {m}" for m in METRICS)} FROM mp""")
def macro_median_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.median_of_medians(confusion(spark, sf_dir), "patient", METRICS).select(*R(METRICS))


AUC_SQL = """au AS (SELECT {k}, (sum(CASE WHEN y = 1 THEN rank END) - p * (p + 1) / 2.0::DOUBLE) / nullif(p * (n - p), 0) AS auc FROM (
    SELECT *, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0::DOUBLE AS rank, sum(y) OVER (PARTITION BY {k}) AS p, count(*) OVER (PARTITION BY {k}) AS n FROM {t}) GROUP BY {k}, p, n)"""
AP_SQL = """ap AS (SELECT {k}, sum(p * hits / seen::DOUBLE) / nullif(sum(p), 0) AS ap FROM (
    SELECT {k}, p, sum(n) OVER w AS seen, sum(p) OVER w AS hits FROM (SELECT {k}, score, count(*) AS n, sum(y) AS p FROM {t} GROUP BY {k}, score) WINDOW w AS (PARTITION BY {k} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {k})"""


@query(f"WITH {SCORES_SQL}, {AUC_SQL.format(k='patient', t='sc')} SELECT patient, round(auc, 6) AS auc FROM au")
def roc_auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.roc_auc(scores(spark, sf_dir), ["patient"]).select("patient", *R(["auc"]))


@query(f"WITH {SCORES_SQL}, {AP_SQL.format(k='patient', t='sc')} SELECT patient, round(ap, 6) AS ap FROM ap")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.average_precision(scores(spark, sf_dir), ["patient"]).select("patient", *R(["ap"]))


SEGMENT_SQL = f"WITH {CONFUSION_SQL}, {LENGTHS_SQL}, {AUC_SQL.format(k='record', t='sc')}, {AP_SQL.format(k='record', t='sc')}, sg AS (SELECT cf.*, auc, ap, duration FROM cf JOIN au USING (record) JOIN ap USING (record) JOIN len USING (record, patient))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = scores(spark, sf_dir)
    rows = mt.curves(sc, KEYS)
    return rows.withColumn("duration", (F.col("n") - 1) * 2.5 + 10)


@query(f"{SEGMENT_SQL} SELECT record, patient, n AS n_windows, n_pos, duration, tp, fp, fn, round(auc, 6) AS auc, round(ap, 6) AS ap, {RSQL} FROM sg")
def segment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per record, with its threshold-free and threshold metrics."""
    return segments(spark, sf_dir).select(*KEYS, F.col("n").alias("n_windows"), "n_pos", "duration", "tp", "fp", "fn", *R(["auc", "ap", *METRICS]))


@query(
    f"""{SEGMENT_SQL} SELECT patient, count(*) AS n_records, count(*) FILTER (n_pos > 0) AS n_with_event, round(median(auc), 6) AS auc, round(median(ap), 6) AS ap, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
    round(sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE, 6) AS sensitivity, round(sum(n_pos) / sum(n)::DOUBLE, 6) AS prevalence, round(1000.0 * sum(fp) / sum(n), 6) AS fp_per_1000_windows, round(sum(fp) / (sum(duration) / 3600), 6) AS fp_per_hour FROM sg GROUP BY patient"""
)
def patient_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = segments(spark, sf_dir).groupBy("patient").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("n_pos") > 0).alias("n_with_event"), F.median("auc").alias("auc"), F.median("ap").alias("ap"),
        *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "n", "n_pos", "duration")),
    )
    return g.select(
        "patient", "n_records", "n_with_event", *R(["auc", "ap"]), "tp", "fp", "fn", rnd(guarded_ratio(F.col("tp"), F.col("tp") + F.col("fn"))).alias("sensitivity"),
        rnd(F.col("n_pos") / F.col("n")).alias("prevalence"), rnd(1000.0 * F.col("fp") / F.col("n")).alias("fp_per_1000_windows"), rnd(F.col("fp") / (F.col("duration") / 3600)).alias("fp_per_hour"),
    )


@query(
    f"""WITH {CONFUSION_SQL}, {MACRO_SQL} SELECT 'micro' AS report, round(sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE, 6) AS sensitivity, round(sum(tp) / nullif(sum(tp) + sum(fp), 0)::DOUBLE, 6) AS precision, NULL::DOUBLE AS specificity FROM cf
    UNION ALL SELECT 'macro', round(median(sensitivity), 6), round(median(precision), 6), round(median(specificity), 6) FROM mp
    UNION ALL SELECT 'event records', round(sum(tp) / nullif(sum(tp) + sum(fn), 0)::DOUBLE, 6), round(sum(tp) / nullif(sum(tp) + sum(fp), 0)::DOUBLE, 6), NULL FROM cf WHERE n_pos > 0"""
)
def report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked report rows; a metric that a report does not have is null."""
    c = confusion(spark, sf_dir)
    micro = mt.pooled(c).select(F.lit("micro").alias("report"), "sensitivity", "precision")
    macro = mt.median_of_medians(c, "patient", METRICS).select(F.lit("macro").alias("report"), "sensitivity", "precision", "specificity")
    some = mt.pooled(c.where("n_pos > 0")).select(F.lit("event records").alias("report"), "sensitivity", "precision")
    return micro.unionByName(macro, allowMissingColumns=True).unionByName(some, allowMissingColumns=True).select("report", *R(["sensitivity", "precision", "specificity"]))


@query(
    f"""{SEGMENT_SQL} SELECT patient, round(min(auc), 6) AS auc_min, round(median(auc), 6) AS auc_median, round(max(auc), 6) AS auc_max, round(median(f1), 6) AS f1_median, count(*) FILTER (tp > 0) AS n_detected, count(*) FILTER (tp = 0 AND n_pos > 0) AS n_missed FROM sg GROUP BY patient"""
)
def record_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of a patient's records, and how many were hit or missed altogether."""
    g = segments(spark, sf_dir).groupBy("patient").agg(F.min("auc").alias("auc_min"), F.median("auc").alias("auc_median"), F.max("auc").alias("auc_max"), F.median("f1").alias("f1_median"), F.count_if(F.col("tp") > 0).alias("n_detected"), F.count_if((F.col("tp") == 0) & (F.col("n_pos") > 0)).alias("n_missed"))
    return g.select("patient", *R(["auc_min", "auc_median", "auc_max", "f1_median"]), "n_detected", "n_missed")


# Two protocols: records split by a parity stand for the two ways of validation.
PROTOCOL_SQL = f"""{SEGMENT_SQL}, m AS (SELECT patient, (record // 24) % 2 = 0 AS grouped, avg(accuracy) AS accuracy, avg(specificity) AS specificity, avg(sensitivity) AS sensitivity, avg(auc) AS auc FROM sg GROUP BY 1, 2),
    u AS (UNPIVOT m ON accuracy, specificity, sensitivity, auc INTO NAME metric VALUE v), pr AS (SELECT a.patient, a.metric, a.v AS free, b.v AS grouped FROM u a JOIN u b ON a.patient = b.patient AND a.metric = b.metric AND NOT a.grouped AND b.grouped)"""


def _protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["accuracy", "specificity", "sensitivity", "auc"]
    m = segments(spark, sf_dir).groupBy("patient", (F.floor(F.col("record") / 24) % 2 == 0).alias("grouped")).agg(*(F.avg(c).alias(c) for c in names))
    u = m.unpivot(["patient", "grouped"], names, "metric", "v").where("v is not null")
    return u.groupBy("patient", "metric").agg(F.max(F.when(~F.col("grouped"), F.col("v"))).alias("free"), F.max(F.when(F.col("grouped"), F.col("v"))).alias("grouped")).where("free is not null and grouped is not null")


@query(
    f"{PROTOCOL_SQL} SELECT metric, round(avg(free), 6) AS free, round(avg(grouped), 6) AS grouped, round(avg(free) - avg(grouped), 6) AS abs_diff, round(100 * (avg(free) - avg(grouped)) / avg(grouped), 6) AS rel_diff, count(*) FILTER (free > grouped) AS n_higher, count(*) AS n FROM pr GROUP BY metric"
)
def protocol_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over patients under two protocols, their differences, and how many patients are higher."""
    g = _protocols(spark, sf_dir).groupBy("metric").agg(F.avg("free").alias("free"), F.avg("grouped").alias("grouped"), F.count_if(F.col("free") > F.col("grouped")).alias("n_higher"), F.count("*").alias("n"))
    d = F.col("free") - F.col("grouped")
    return g.select("metric", *R(["free", "grouped"]), rnd(d).alias("abs_diff"), rnd(100 * d / F.col("grouped")).alias("rel_diff"), "n_higher", "n")


@query(f"{PROTOCOL_SQL} SELECT patient, metric, protocol, round(v, 6) AS value FROM (UNPIVOT pr ON free, grouped INTO NAME protocol VALUE v)")
def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protocols(spark, sf_dir).unpivot(["patient", "metric"], ["free", "grouped"], "protocol", "v").select("patient", "metric", "protocol", rnd(F.col("v")).alias("value"))


@query(f"{SEGMENT_SQL} SELECT round(avg(auc), 6) AS auc_mean, round(stddev_samp(auc), 6) AS auc_std, round(avg(ap), 6) AS ap_mean, round(stddev_samp(ap), 6) AS ap_std, round(min(auc), 6) AS auc_min, round(max(auc), 6) AS auc_max FROM sg")
def metric_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir)
    return s.agg(*(rnd(f(c)).alias(f"{c}_{n}") for c in ("auc", "ap") for n, f in (("mean", F.avg), ("std", F.stddev_samp))), rnd(F.min("auc")).alias("auc_min"), rnd(F.max("auc")).alias("auc_max"))


@query(
    f"""WITH {SCORES_SQL}, t AS (SELECT patient, round_even(value_q, 0) AS q FROM (SELECT patient, score / 50 AS value_q FROM sc))
    SELECT patient, count(*) FILTER (q = -1) AS q_m1, count(*) FILTER (q = 0) AS q_0, count(*) FILTER (q = 1) AS q_1, count(*) FILTER (q = 2) AS q_2 FROM t GROUP BY patient"""
)
def order_counts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a small integer per patient, wide and filled with zeros."""
    q = F.bround(F.col("score") / 50, 0).cast("int")
    wide = scores(spark, sf_dir).select("patient", q.alias("q")).groupBy("patient").pivot("q", [-1, 0, 1, 2]).agg(F.count(F.lit(1)))
    return wide.na.fill(0).withColumnsRenamed({"-1": "q_m1", "0": "q_0", "1": "q_1", "2": "q_2"})


@query(
    f"""WITH {SCORES_SQL} SELECT patient, regexp_extract(patient, '([0-9]+)', 1)::INTEGER AS number, count(*) AS n, round(avg(y), 6) AS prevalence, count(DISTINCT record) AS n_records, min(record) AS first_record,
    round((count(*) FILTER (y = 1)) * 1.0::DOUBLE / sum(count(*) FILTER (y = 1)) OVER (), 6) AS share FROM sc GROUP BY patient"""
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class counts, prevalence and share of all positives per patient."""
    sc = scores(spark, sf_dir)
    g = sc.groupBy("patient").agg(F.count("*").alias("n"), F.avg("y").alias("prevalence"), F.count_distinct("record").alias("n_records"), F.min("record").alias("first_record"), F.sum("y").alias("pos"))
    total = sc.agg(F.sum("y").alias("all"))
    return g.crossJoin(F.broadcast(total)).select("patient", label_number(F.col("patient")).alias("number"), "n", rnd(F.col("prevalence")).alias("prevalence"), "n_records", "first_record", rnd(ratio_or_zero(F.col("pos"), F.col("all"))).alias("share"))


@query("""SELECT event_type, count(*) AS n, round(count(*) * 1.0::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type""")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return e.crossJoin(F.broadcast(e.agg(F.sum("n").alias("all")))).select("event_type", "n", rnd(F.col("n") / F.col("all")).alias("share"))


@query(
    """SELECT patient, mode_w AS level FROM (SELECT patient, level AS mode_w, row_number() OVER (PARTITION BY patient ORDER BY count(*) DESC, level) AS r FROM (
    SELECT 'p' || lpad((user_id % 24 + 1)::VARCHAR, 2, '0') AS patient, (round_even(value / 20, 0))::INTEGER AS level FROM events) GROUP BY patient, level) WHERE r = 1"""
)
def mode_by_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent level per patient; of equal ones the smallest."""
    rows = scores(spark, sf_dir).select("patient", F.bround((F.col("score") + 50) / 20, 0).cast("int").alias("level")).groupBy("patient", "level").agg(F.count("*").alias("n"))
    return rows.groupBy("patient").agg(F.max_by("level", F.struct("n", (-F.col("level")).alias("least"))).alias("level"))


@query(
    """SELECT l.quality AS truth, count(*) AS n, count(*) FILTER (d.n_chars >= 1500) AS predicted, round(avg(CASE WHEN (d.n_chars >= 1500) = (l.quality = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL GROUP BY l.quality"""
)
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a length rule: the confusion of a truth table with a prediction."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").where("quality is not null")
    long = F.col("n_chars") >= 1500
    return rows.groupBy(F.col("quality").alias("truth")).agg(F.count("*").alias("n"), F.count_if(long).alias("predicted"), rnd(F.avg(F.when(long == (F.col("quality") == 1), 1.0).otherwise(0.0))).alias("accuracy"))


@query(
    f"""{SEGMENT_SQL}, d AS (SELECT patient, count(*) AS n_events, avg(detected) AS sensitivity, median(CASE WHEN detected = 1 THEN latency END) AS latency FROM (
        SELECT patient, y AS detected, w * 2.5::DOUBLE AS latency FROM sc WHERE event_type = 'purchase' OR y = 1) GROUP BY patient),
    p AS (SELECT patient, sum(fp) / (sum(duration) / 3600) AS fa_per_hour, avg(auc) AS auc, avg(f1) AS f1 FROM sg GROUP BY patient)
    SELECT patient, n_events, round(sensitivity, 6) AS sensitivity, round(latency, 6) AS latency, round(fa_per_hour, 6) AS fa_per_hour, round(auc, 6) AS auc, round(f1, 6) AS f1 FROM d JOIN p USING (patient)"""
)
def performance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event and window performance side by side: latency of detected events only; false alarms are those of windows."""
    sc = scores(spark, sf_dir).where("event_type = 'purchase' or y = 1")
    d = sc.groupBy("patient").agg(F.count("*").alias("n_events"), F.avg("y").alias("sensitivity"), F.median(F.when(F.col("y") == 1, F.col("w") * 2.5)).alias("latency"))
    p = segments(spark, sf_dir).groupBy("patient").agg((F.sum("fp") / (F.sum("duration") / 3600)).alias("fa_per_hour"), F.avg("auc").alias("auc"), F.avg("f1").alias("f1"))
    return d.join(p, "patient").select("patient", "n_events", *R(["sensitivity", "latency", "fa_per_hour", "auc", "f1"]))


@query(
    f"""WITH {SCORES_SQL}, r AS (SELECT patient, record, max(y) AS has, sum(y) AS pos, count(*) AS n FROM sc GROUP BY ALL)
    SELECT patient, sum(pos)::BIGINT AS n_positive, (sum(n - pos) FILTER (has = 1))::BIGINT AS n_within, sum(n - pos)::BIGINT AS n_all, count(*) AS n_records FROM r GROUP BY patient"""
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive windows, and negative ones within event records and in all records, per patient."""
    r = scores(spark, sf_dir).groupBy("patient", "record").agg(F.max("y").alias("has"), F.sum("y").alias("pos"), F.count("*").alias("n"))
    return r.groupBy("patient").agg(F.sum("pos").alias("n_positive"), F.sum(F.when(F.col("has") == 1, F.col("n") - F.col("pos"))).alias("n_within"), F.sum(F.col("n") - F.col("pos")).alias("n_all"), F.count("*").alias("n_records"))


@query(
    f"""WITH {CONFUSION_SQL}, s AS (SELECT 'segment' AS level, {POOLED_SQL} FROM cf), e AS (SELECT 'patient' AS level, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(sensitivity), 6) AS sensitivity, round(avg(precision), 6) AS precision, round(avg(f1), 6) AS f1
    FROM (SELECT patient, {POOLED_SQL} FROM cf GROUP BY patient)) SELECT * FROM s UNION ALL SELECT * FROM e"""
)
def level_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts pooled over all windows, and as means over patients."""
    c = confusion(spark, sf_dir)
    names = ["sensitivity", "precision", "f1"]
    s = mt.pooled(c).select(F.lit("segment").alias("level"), "tp", "fp", "fn", *R(names))
    p = c.groupBy("patient").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = p.withColumns({"sensitivity": rnd(guarded_ratio(tp, tp + fn)), "precision": rnd(guarded_ratio(tp, tp + fp)), "f1": rnd(ratio_or_zero(2 * tp, 2 * tp + fp + fn))})
    return s.unionByName(p.agg(F.lit("patient").alias("level"), *(F.sum(x).alias(x) for x in ("tp", "fp", "fn")), *(rnd(F.avg(x)).alias(x) for x in names)))


@query(
    f"""WITH {SCORES_SQL}, r AS (SELECT record, patient, count(*) AS n_windows, sum((event_type = 'purchase')::INTEGER)::BIGINT AS n_events FROM sc GROUP BY ALL)
    SELECT n_events, count(*) AS n_records, sum(n_windows)::BIGINT AS n_windows, printf('%.6f', avg(n_windows)) AS mean_windows FROM r GROUP BY n_events"""
)
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by their number of events, with a mean as fixed-decimal text."""
    r = scores(spark, sf_dir).groupBy("record", "patient").agg(F.count("*").alias("n_windows"), F.sum((F.col("event_type") == "purchase").cast("int")).alias("n_events"))
    return r.groupBy("n_events").agg(F.count("*").alias("n_records"), F.sum("n_windows").alias("n_windows"), F.format_string("%.6f", F.avg("n_windows")).alias("mean_windows"))
