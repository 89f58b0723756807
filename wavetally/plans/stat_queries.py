"""Statistics, sampling and selection, over ``embeddings`` as feature vectors and ``events`` as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import Config
from ..operators import pipeline as pl, sampling as sp, selection as sl, stats as st, windowing as wd
from ..tables import table
from .inputs import FEATURES_SQL, SCORES_SQL, features, rnd, scores
from .registry import query

BUDGET = Config(budget=3000, strata=10)


@query(f"WITH {FEATURES_SQL} SELECT feature::INTEGER AS feature, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM (SELECT *, (x - avg(x) OVER (PARTITION BY feature)) / stddev_pop(x) OVER (PARTITION BY feature) AS z FROM ft) GROUP BY feature")
def standard_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = st.standardise(features(spark, sf_dir), ["feature"], "x")
    return z.groupBy("feature").agg(rnd(F.first("mean")).alias("mean"), rnd(F.first("sd")).alias("sd"), rnd(F.min("z")).alias("z_min"), rnd(F.max("z")).alias("z_max"))


@query(
    f"""WITH {FEATURES_SQL}, g AS (SELECT feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM ft GROUP BY ALL),
    t AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM g GROUP BY feature)
    SELECT feature::INTEGER AS feature, round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 6) AS f FROM t"""
)
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.anova_f(features(spark, sf_dir), ["feature"]).select("feature", rnd(F.col("f")).alias("f"))


EFFECT_SQL = f"""WITH {FEATURES_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0::DOUBLE AS r FROM ft),
    g AS (SELECT feature, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(x) FILTER (y = 1) AS m1, avg(x) FILTER (y = 0) AS m0, var_samp(x) FILTER (y = 1) AS v1, var_samp(x) FILTER (y = 0) AS v0, sum(r) FILTER (y = 1) AS s FROM rk GROUP BY feature),
    e AS (SELECT *, (s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS auc, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM g)"""


@query(f"{EFFECT_SQL} SELECT feature::INTEGER AS feature, n1, n0, round(m1, 6) AS m1, round(m0, 6) AS m0, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS abs_auc, round(d, 6) AS cohen_d FROM e")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class effects per feature: means, rank AUC and Cohen's d."""
    e = st.class_effects(features(spark, sf_dir), ["feature"])
    return e.select("feature", "n1", "n0", *(rnd(F.col(c)).alias(c) for c in ("m1", "m0", "auc", "abs_auc", "cohen_d")))


@query(
    f"""WITH {FEATURES_SQL}, d AS (SELECT 'within' AS definition, * FROM ft WHERE label < 5 UNION ALL SELECT 'all', * FROM ft),
    rk AS (SELECT *, rank() OVER (PARTITION BY definition, feature ORDER BY x) + (count(*) OVER (PARTITION BY definition, feature, x) - 1) / 2.0::DOUBLE AS r FROM d),
    g AS (SELECT definition, feature, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(r) FILTER (y = 1) AS s FROM rk GROUP BY ALL)
    SELECT definition, feature::INTEGER AS feature, n1, n0, round((s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS auc FROM g"""
)
def effects_by_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two definitions of the negative class in one plan."""
    long = features(spark, sf_dir)
    both = long.where("label < 5").withColumn("definition", F.lit("within")).unionByName(long.withColumn("definition", F.lit("all")))
    return st.class_effects(both, ["definition", "feature"]).select("definition", "feature", "n1", "n0", rnd(F.col("auc")).alias("auc"))


DESCRIPTORS, PERFORMANCE = ["a", "b", "least", "most", "middle", "hits"], ["c", "d", "positives", "alarms"]
PROFILE_SQL = f"""{SCORES_SQL}, pf AS (SELECT patient, record, avg(score) AS a, stddev_samp(score) AS b, min(score)::DOUBLE AS least, max(score)::DOUBLE AS most, median(score) AS middle, avg((score >= 0)::INTEGER) AS hits,
    avg(y) AS c, count(*) * 1.0::DOUBLE AS d, sum(y)::DOUBLE AS positives, sum((score >= 20)::INTEGER)::DOUBLE AS alarms FROM sc GROUP BY ALL)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per record; its values are counted first, so that records with equal windows have equal figures, as ranks ask for."""
    s, n = F.col("score"), F.col("n")
    values = scores(spark, sf_dir).groupBy("patient", "record", "score").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    hit = lambda least: F.sum(F.when(s >= least, n).otherwise(0))
    told = values.groupBy("patient", "record").agg(
        F.collect_list(F.when(s.isNotNull(), F.struct(s.alias("x"), "n"))).alias("v"), F.min(s).cast("double").alias("least"), F.max(s).cast("double").alias("most"), F.percentile(s, 0.5, n).alias("middle"), F.try_divide(hit(0), F.sum(F.when(s.isNotNull(), n))).alias("hits"),
        (F.sum("p") / F.sum(n)).alias("c"), F.sum(n).cast("double").alias("d"), F.sum("p").cast("double").alias("positives"), hit(20).cast("double").alias("alarms"),
    )
    return told.withColumn("v", st.ordered_moments(F.col("v"))).select("patient", "record", F.col("v.mean").alias("a"), F.col("v.sd").alias("b"), *DESCRIPTORS[2:], *PERFORMANCE)


def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = profiles(spark, sf_dir).unpivot(["record", *PERFORMANCE], DESCRIPTORS, "descriptor", "x")
    return st.spearman(one.unpivot(["record", "descriptor", "x"], PERFORMANCE, "metric", "z"), ["descriptor", "metric"], "x", "z")


@query(
    f"""WITH {PROFILE_SQL}, u AS (SELECT l.record, l.name AS descriptor, l.v AS x, r.name AS metric, r.v AS z FROM (UNPIVOT pf ON {", ".join(DESCRIPTORS)} INTO NAME name VALUE v) l JOIN (UNPIVOT pf ON {", ".join(PERFORMANCE)} INTO NAME name VALUE v) r USING (record)),
    k AS (SELECT *, rank() OVER (PARTITION BY descriptor, metric ORDER BY x) + (count(*) OVER (PARTITION BY descriptor, metric, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY descriptor, metric ORDER BY z) + (count(*) OVER (PARTITION BY descriptor, metric, z) - 1) / 2.0::DOUBLE AS rz FROM u)
    SELECT descriptor, metric, count(*) AS n, round(corr(rx, rz), 6) AS rho FROM k GROUP BY ALL"""
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of each descriptor with each metric over records."""
    return rank_correlations(spark, sf_dir).select("descriptor", "metric", "n", rnd(F.col("rho")).alias("rho"))


@query()
def spearman_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two-sided p-values, and a star under five in a hundred; a row per pair of columns."""
    s = st.with_p(rank_correlations(spark, sf_dir), "rho", "n")
    return s.select("descriptor", "metric", "n", "rho", "p", F.when(F.col("p") < 0.05, "*").otherwise("").alias("star"))


@query(f"WITH {PROFILE_SQL} SELECT round(corr(a, c), 6) AS pearson, round(regr_slope(c, a), 9) AS slope, round(regr_intercept(c, a), 6) AS intercept FROM pf")
def straight_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles(spark, sf_dir)
    return p.agg(rnd(F.corr("a", "c")).alias("pearson"), rnd(F.regr_slope("c", "a"), 9).alias("slope"), rnd(F.regr_intercept("c", "a")).alias("intercept"))


@query(
    f"""WITH {SCORES_SQL}, c AS (SELECT patient, y, count(*) AS n FROM sc GROUP BY ALL), r AS (SELECT *, sqrt(sum(n) OVER p / (count(*) OVER p * n)::DOUBLE) AS raw FROM c WINDOW p AS (PARTITION BY patient))
    SELECT patient, y, n, round(raw / (sum(raw * n) OVER (PARTITION BY patient) / sum(n) OVER (PARTITION BY patient)), 6) AS weight FROM r"""
)
def damped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.damped_weights(scores(spark, sf_dir), ["patient"]).select("patient", "y", "n", rnd(F.col("weight")).alias("weight"))


@query(
    f"""WITH {SCORES_SQL}, r AS (SELECT record, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM sc GROUP BY record), t AS (SELECT *, sum(n_neg) OVER () AS neg, greatest(3000 - sum(n_pos) OVER (), 0) AS lft FROM r)
    SELECT record, n_pos, n_neg, (CASE WHEN lft = 0 THEN 0 WHEN neg <= lft THEN n_neg ELSE least(n_neg, greatest(1, round_even(lft * n_neg / neg::DOUBLE, 0))) END)::BIGINT AS quota FROM t"""
)
def stratified_sample_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp.budget_quotas(scores(spark, sf_dir), BUDGET)


@query(
    f"""WITH {SCORES_SQL}, r AS (SELECT record, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM sc GROUP BY record), t AS (SELECT *, sum(n_neg) OVER () AS neg, greatest(3000 - sum(n_pos) OVER (), 0) AS lft FROM r),
    q AS (SELECT record, n_neg, (CASE WHEN lft = 0 THEN 0 WHEN neg <= lft THEN n_neg ELSE least(n_neg, greatest(1, round_even(lft * n_neg / neg::DOUBLE, 0))) END)::BIGINT AS quota FROM t),
    n AS (SELECT sc.*, n_neg, quota, ntile(10) OVER (PARTITION BY record ORDER BY w) AS s FROM sc JOIN q USING (record) WHERE y = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY record, s ORDER BY md5(concat_ws('|', '42', record, w)), w) AS i, quota // least(10, n_neg) + CASE WHEN s <= quota % least(10, n_neg) THEN 1 ELSE 0 END AS part FROM n)
    SELECT record, patient, w, round(score, 6) AS score, y FROM sc WHERE y = 1 UNION ALL SELECT record, patient, w, round(score, 6), y FROM k WHERE i <= part"""
)
def budgeted_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of a budgeted training set; rows are picked in the order of a hash that any engine has."""
    return sp.budgeted_training(scores(spark, sf_dir).select("record", "patient", "w", rnd(F.col("score")).alias("score"), "y"), BUDGET)


FOLD_SQL = f"""WITH {SCORES_SQL}, k AS (SELECT least(5, min(n)) AS k, count(*) AS classes FROM (SELECT y, count(*) AS n FROM sc GROUP BY y)),
    f AS (SELECT event_id, y, CASE WHEN k >= 2 AND classes > 1 THEN (row_number() OVER (PARTITION BY y ORDER BY md5(concat_ws('|', '42', event_id)), event_id) - 1) % k END::INTEGER AS fold FROM sc, k)"""


@query(f"{FOLD_SQL} SELECT event_id, y, fold FROM f")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each class dealt evenly to five folds."""
    return sp.stratified_folds(scores(spark, sf_dir).select("event_id", "y"), ["event_id"], 5)


@query(f"WITH {SCORES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY patient, record ORDER BY md5(concat_ws('|', '42', record, w)), record, w) AS i FROM (SELECT * FROM sc WHERE record NOT IN (SELECT record FROM sc WHERE y = 1 GROUP BY record HAVING count(*) > 8))) SELECT patient, record, w, y FROM k WHERE i <= 30")
def sampled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most thirty windows of every record, without the records that have many events."""
    sc = scores(spark, sf_dir).select("patient", "record", "w", "y")
    many = sc.where("y = 1").groupBy("record").agg(F.count("*").alias("n")).where("n > 8")
    return sp.sample_per_group(sc.join(many, "record", "left_anti"), ["patient", "record"], ["record", "w"], 30, Config().seed).select("patient", "record", "w", "y")


def ranking_sql(rows: str, k: int) -> str:
    """Tables ``fv``, F-values by group, and ``rk``, each group's ranking of ``k`` features as a list, over ``rows(g, vec_id, y, feature, x)``."""
    return f"""WITH RECURSIVE {FEATURES_SQL}, gr AS ({rows}),
    fv AS (SELECT g, feature, (sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (sum(n * v) / (sum(n) - 2)) AS f FROM (SELECT g, feature, y, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM gr GROUP BY ALL) GROUP BY g, feature),
    cr AS (SELECT a.g, a.feature AS a, b.feature AS b, greatest(abs(corr(a.x, b.x)), 0.001::DOUBLE) AS r FROM gr a JOIN gr b ON a.g = b.g AND a.vec_id = b.vec_id GROUP BY ALL),
    st(g, k, best) AS (SELECT g, 1, [arg_max(feature, f * 1e6::DOUBLE - feature * 1e-9::DOUBLE)] FROM fv GROUP BY g
        UNION ALL
        SELECT st.g, any_value(st.k) + 1, list_append(any_value(st.best), arg_max(t.feature, t.score)) FROM st JOIN (
            SELECT s.g, fv.feature, CASE WHEN abs(avg(cr.r) - 1) <= 1e-5 + 1e-8 THEN 0 ELSE any_value(fv.f) / avg(cr.r) END AS score
            FROM st s JOIN fv ON fv.g = s.g JOIN cr ON cr.g = s.g AND cr.b = fv.feature WHERE list_contains(s.best, cr.a) AND NOT list_contains(s.best, fv.feature) AND fv.f > 0 GROUP BY s.g, fv.feature) t ON st.g = t.g
        WHERE st.k < {k} GROUP BY st.g),
    rk AS (SELECT g, best FROM st WHERE k = {k})"""


@query(f"{ranking_sql('SELECT 0 AS g, vec_id, y, feature, x FROM ft', 20)} SELECT 'all' AS \"group\", rank, best[rank]::BIGINT AS feature_index, round(f, 6) AS f FROM rk, unnest(range(1, 21)) AS u(rank) JOIN fv ON fv.g = rk.g AND fv.feature = best[rank]")
def mrmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty features of the vectors, by relevance over redundancy."""
    v = table(spark, sf_dir, "embeddings").select("embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("y"))
    return sl.select_features(v, 20, "embedding", "y").withColumn("f", rnd(F.col("f")))


@query(f"{ranking_sql('SELECT fold AS g, vec_id, y, feature, x FROM ft, unnest(range(5)) AS u(fold) WHERE vec_id % 5 <> fold', 10)} SELECT feature_index::BIGINT AS feature_index, count(*) AS times_selected, count(*) / 5.0::DOUBLE AS fold_fraction FROM (SELECT unnest(best) AS feature_index FROM rk) GROUP BY feature_index")
def mrmr_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection repeated without each fold, and how often a feature comes up."""
    v = table(spark, sf_dir, "embeddings").select("embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold"), "vec_id").where("vec_id % 5 <> fold")
    picked = sl.select_features(v, 10, "embedding", "y", group="fold")
    return picked.groupBy("feature_index").agg(F.count("*").alias("times_selected"), (F.count("*") / 5).alias("fold_fraction"))


#: Features that each fold selects.
TAKEN = 10


def reselected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as windows of three patients' records, and the features selected again without each record."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    w = e.select((F.col("vec_id") % 3).alias("patient"), (F.floor(F.col("vec_id") / 3) % 4).alias("record"), F.floor(F.col("vec_id") / 12).alias("w"), (F.col("label") == 0).cast("int").alias("y"), F.col("embedding").alias("features"))
    return sl.reselected(w, TAKEN)


#: The same as long rows: no budget is met at these sizes, so that a fold trains on all rows of its patient's other records.
RESELECTED_SQL = f"{ranking_sql('SELECT (vec_id % 3) * 10 + fold AS g, vec_id, y, feature, x FROM ft, unnest(range(4)) AS u(fold) WHERE (vec_id // 3) % 4 <> fold', TAKEN)}, lg AS (SELECT rk.g // 10 AS patient, rk.g % 10 AS fold, rank, best[rank]::BIGINT AS feature_index, round(f, 6) AS f FROM rk, unnest(range(1, {TAKEN + 1})) AS u(rank) JOIN fv ON fv.g = rk.g AND fv.feature = best[rank])"


@query(f"{RESELECTED_SQL} SELECT * FROM lg")
def reselection_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reselected(spark, sf_dir).withColumn("f", rnd(F.col("f")))


@query(f"{RESELECTED_SQL} SELECT patient, fold, " + ", ".join(f"max(feature_index) FILTER (rank = {i}) AS f{i}" for i in range(1, TAKEN + 1)) + " FROM lg GROUP BY patient, fold")
def reselection_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.wide_selection(reselected(spark, sf_dir), TAKEN)


@query(f"{RESELECTED_SQL} SELECT patient, feature_index, count(*) AS times_selected, n_folds, round(count(*) / n_folds::DOUBLE, 6) AS fold_fraction, round(avg(rank), 6) AS mean_rank FROM lg JOIN (SELECT patient, count(DISTINCT fold) AS n_folds FROM lg GROUP BY patient) USING (patient) GROUP BY patient, feature_index, n_folds")
def reselection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.selection_frequency(reselected(spark, sf_dir)).withColumns({"fold_fraction": rnd(F.col("fold_fraction")), "mean_rank": rnd(F.col("mean_rank"))})


@query(f"WITH {FEATURES_SQL}, p AS (SELECT a.feature::INTEGER AS a, b.feature::INTEGER AS b, round(corr(a.x, b.x), 6) AS r FROM ft a JOIN ft b ON a.vec_id = b.vec_id AND a.feature < b.feature GROUP BY ALL) SELECT a, b, r, abs(r) > 0.1 AS near, abs(r) = max(abs(r)) OVER () AS largest FROM p")
def channel_correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of all pairs of channels, and the largest of them; a row per pair of channels, whatever the number of vectors."""
    p = st.channel_correlations(table(spark, sf_dir, "embeddings"), "embedding").select("a", "b", rnd(F.col("r")).alias("r"))
    most = p.agg(F.max(F.abs("r")).alias("most"))
    return p.crossJoin(F.broadcast(most)).select("a", "b", "r", (F.abs("r") > 0.1).alias("near"), (F.abs("r") == F.col("most")).alias("largest"))


@query(f"WITH {FEATURES_SQL} SELECT feature::INTEGER AS feature, round(var_samp(x), 6) AS variance, var_samp(x) < 1e-12 AS dead, count(*) FILTER (isnan(x) OR isinf(x)) AS n_bad FROM ft GROUP BY feature")
def dead_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    return features(spark, sf_dir).groupBy("feature").agg(rnd(F.var_samp("x")).alias("variance"), (F.var_samp("x") < 1e-12).alias("dead"), F.count_if(bad).alias("n_bad"))


@query(f"WITH {FEATURES_SQL}, v AS (SELECT * FROM ft), g AS (SELECT vec_id, corr(x, x + (feature % 3) / 10.0::DOUBLE) AS r, avg(abs((feature % 3) / 10.0::DOUBLE)) AS mae FROM v GROUP BY vec_id) SELECT round(avg(r), 6) AS r_mean, round(stddev_samp(r), 6) AS r_sd, round(median(r), 6) AS r_median, round(min(r), 6) AS r_min, round(avg(mae), 6) AS mae_mean, round(max(mae), 6) AS mae_max FROM g")
def resolution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two versions of a vector: correlation and mean absolute error per vector, summarised."""
    v = features(spark, sf_dir).withColumn("z", F.col("x") + (F.col("feature") % 3) / F.lit(10.0))
    g = v.groupBy("vec_id").agg(F.corr("x", "z").alias("r"), F.avg(F.abs(F.col("x") - F.col("z"))).alias("mae"))
    middle = st.quantiles(g, [], "r", {"r_median": 0.5}).select(rnd(F.col("r_median")).alias("r_median"))
    return g.agg(*(rnd(f("r")).alias(f"r_{n}") for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min))), rnd(F.avg("mae")).alias("mae_mean"), rnd(F.max("mae")).alias("mae_max")).crossJoin(middle)  # one row each


@query(f"WITH {FEATURES_SQL} SELECT vec_id, round(min(x), 6) AS least, round(max(x), 6) AS most, count(*) FILTER (isnan(x)) AS n_nan, count(*) FILTER (x = 0) AS n_zero FROM ft GROUP BY vec_id")
def vector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    c = wd.vector_statistics(F.col("v"))
    return e.select("vec_id", rnd(c["least"]).alias("least"), rnd(c["most"]).alias("most"), c["n_nan"].alias("n_nan"), c["n_zero"].alias("n_zero"))


@query(
    f"""WITH {SCORES_SQL}, o AS (SELECT patient, value AS v, row_number() OVER (PARTITION BY patient ORDER BY value) AS i, count(*) OVER (PARTITION BY patient) AS n FROM (SELECT patient, score AS value FROM sc)),
    q AS (SELECT patient, s, greatest(1, least(any_value(n), any_value(n) * s + 0.5)) AS pos FROM o, (VALUES (0.25::DOUBLE), (0.5), (0.75)) t(s) GROUP BY patient, s)
    SELECT q.patient, q.s AS share, round(a.v + (b.v - a.v) * (pos - floor(pos)), 6) AS value FROM q JOIN o a ON a.patient = q.patient AND a.i = floor(pos) JOIN o b ON b.patient = q.patient AND b.i = least(floor(pos) + 1, b.n)"""
)
def midpoint_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles whose i-th value stands at (i - 1/2) / n."""
    counts = scores(spark, sf_dir).groupBy("patient", "score").agg(F.count("*").alias("n"))
    ranked = st.with_below(counts, ["patient"], "score", ["n"])
    n = counts.groupBy("patient").agg(F.sum("n").alias("all"))
    at = F.greatest(F.lit(1.0), F.least(F.col("all").cast("double"), F.col("all") * F.col("share") + 0.5))
    want = n.select("patient", "all", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("share")).withColumn("at", at)
    holds = lambda i: (F.col("below_n") < i) & (i <= F.col("below_n") + F.col("n"))
    lo = F.floor("at")
    rows = ranked.join(want, "patient").groupBy("patient", "share", "at").agg(F.max(F.when(holds(lo), F.col("score"))).alias("low"), F.max(F.when(holds(F.least(lo + 1, F.col("all"))), F.col("score"))).alias("high"))
    return rows.select("patient", "share", rnd(F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - lo)).alias("value"))


@query(
    """WITH v AS (SELECT label, vec_id, i - 1 AS feature, (vec_id * 7 + i) % 641 = 0 AS bad_a, (vec_id * 3 + i) % 523 = 0 AS bad_b, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) r(i)),
    c AS (SELECT label, feature FROM v GROUP BY ALL HAVING NOT bool_or(bad_a) AND NOT bool_or(bad_b)), n AS (SELECT label, count(DISTINCT feature) AS n_all FROM v GROUP BY label)
    SELECT n.label, n_all, count(c.feature) AS n_valid, coalesce(string_agg(c.feature, ',' ORDER BY c.feature), '') AS valid FROM n LEFT JOIN c USING (label) GROUP BY n.label, n_all"""
)
def validity_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of each label's vectors with missing values: the columns that have none in either, which are those to compare."""
    long = features(spark, sf_dir).select("label", "vec_id", "feature", "x")
    i = F.col("feature") + 1
    version = lambda k, m, name: F.when((F.col("vec_id") * k + i) % m == 0, float("nan")).otherwise(F.col("x")).alias(name)
    both = long.select("label", "feature", version(7, 641, "a"), version(3, 523, "b"))
    valid = st.valid_columns(both, ["label"], "feature", ["a", "b"])
    every = long.groupBy("label").agg(F.count_distinct("feature").alias("n_all"))
    got = valid.groupBy("label").agg(F.count("*").alias("n_valid"), F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("valid"))
    return every.join(got, "label", "left").select("label", "n_all", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.coalesce("valid", F.lit("")).alias("valid"))


@query(f"{EFFECT_SQL} SELECT count(*) AS n_features, count(*) FILTER (abs(d) >= 0.2) AS n_apart, round(avg(abs(d)), 6) AS mean_d FROM e")
def class_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes compared over all features; a table of one class is refused."""
    e = st.class_effects(sl.class_contrast(features(spark, sf_dir)), ["feature"])
    return e.agg(F.count("*").alias("n_features"), F.count_if(F.abs("cohen_d") >= 0.2).alias("n_apart"), rnd(F.avg(F.abs("cohen_d"))).alias("mean_d"))


@query(f"{ranking_sql('SELECT 0 AS g, vec_id, y, feature, x FROM ft', 8)} SELECT vec_id, list_transform(best, lambda i: embedding[i + 1]) AS selected FROM embeddings, rk")
def selected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection as a fitted transformer: vectors cut down to the chosen features, in their order of rank."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("y"))
    return pl.FeatureSelector(k=8, inputCol="embedding").fit(v).transform(v).select("vec_id", "selected")
