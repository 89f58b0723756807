"""Networks of selected edges, over ``lineitem`` as ranked selections of folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import guarded_ratio
from ..operators import network as nw
from ..operators.stats import chi_square_tail, quantiles
from .inputs import SELECTION_SQL, WEIGHTS_SQL, rnd, selections
from ..tables import stored
from .registry import query

BASE = f"WITH {SELECTION_SQL}, {WEIGHTS_SQL}"
EDGES = "ed AS (SELECT patient, src, tgt, sum(weight) AS weight FROM wt GROUP BY ALL)"
CH = "ch AS (SELECT patient, channel FROM (SELECT DISTINCT patient FROM wt), range(1, 19) r(channel))"
DEGREES = """dg AS (SELECT ch.patient, ch.channel::INTEGER AS channel, coalesce(o.w, 0) AS out_w, coalesce(i.w, 0) AS in_w FROM ch
    LEFT JOIN (SELECT patient, src AS channel, sum(weight) AS w FROM wt GROUP BY ALL) o USING (patient, channel)
    LEFT JOIN (SELECT patient, tgt AS channel, sum(weight) AS w FROM wt GROUP BY ALL) i USING (patient, channel))"""


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.rank_weights(selections(spark, sf_dir))


def edge_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(patient, band, src, tgt, weight)``: the weights summed once to a bounded table, from which a plan derives all it needs."""
    return weights(spark, sf_dir).groupBy("patient", "band", "src", "tgt").agg(F.sum("weight").alias("weight"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_bands(spark, sf_dir).groupBy("patient", "src", "tgt").agg(F.sum("weight").alias("weight"))


MAP_SQL = """fm AS (SELECT (306 * b + 17 * (s - 1) + (t - 1) - CASE WHEN t > s THEN 1 ELSE 0 END)::INTEGER AS feature_index, b::INTEGER AS band, s::INTEGER AS src, t::INTEGER AS tgt
    FROM range(0, 5) x(b), range(1, 19) y(s), range(1, 19) z(t) WHERE s <> t)"""


@query(f"{BASE}, {MAP_SQL} SELECT fm.feature_index, band, src, tgt, count(w.weight) AS n FROM fm LEFT JOIN wt w USING (band, src, tgt) GROUP BY ALL")
def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole feature dimension with how often each feature was selected."""
    used = weights(spark, sf_dir).groupBy("band", "src", "tgt").agg(F.count("*").alias("used"))
    return nw.feature_map(spark).join(used, ["band", "src", "tgt"], "left").select("feature_index", "band", "src", "tgt", F.coalesce("used", F.lit(0)).alias("n"))


@query(f"{BASE} SELECT record, patient, rank, band, src, tgt, round(weight, 9) AS weight FROM wt")
def rank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).select("record", "patient", "rank", "band", "src", "tgt", rnd(F.col("weight"), 9).alias("weight"))


@query(
    f"""{BASE} SELECT patient, record, count(*) AS n_selected, string_agg(306 * band + 17 * (src - 1) + tgt - 1 - CASE WHEN tgt > src THEN 1 ELSE 0 END, ';' ORDER BY rank) AS feature_indices,
    string_agg(band || '_' || src || '_' || tgt, ';' ORDER BY rank) AS feature_names FROM wt GROUP BY patient, record"""
)
def selection_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per fold with its features in order of rank; a fold has at most twenty."""
    index = 306 * F.col("band") + 17 * (F.col("src") - 1) + F.col("tgt") - 1 - F.when(F.col("tgt") > F.col("src"), 1).otherwise(0)
    rows = weights(spark, sf_dir).select("patient", "record", F.struct("rank", index.cast("string").alias("i"), F.concat_ws("_", *(F.col(c).cast("string") for c in ("band", "src", "tgt"))).alias("name")).alias("f"))
    g = rows.groupBy("patient", "record").agg(F.array_sort(F.collect_list("f")).alias("f"))
    return g.select("patient", "record", F.size("f").cast("long").alias("n_selected"), F.array_join("f.i", ";").alias("feature_indices"), F.array_join("f.name", ";").alias("feature_names"))


@query(f"{BASE}, n AS (SELECT count(DISTINCT record) AS n FROM wt) SELECT band, src, tgt, count(DISTINCT record) AS times_selected, round(count(DISTINCT record) / (SELECT n FROM n)::DOUBLE, 9) AS fold_fraction FROM wt GROUP BY ALL")
def selection_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weights(spark, sf_dir)
    folds = w.select("record").distinct().agg(F.count("*").alias("folds"))
    g = w.groupBy("band", "src", "tgt").agg(F.count_distinct("record").alias("times_selected"))
    return g.crossJoin(F.broadcast(folds)).select("band", "src", "tgt", "times_selected", rnd(F.col("times_selected") / F.col("folds"), 9).alias("fold_fraction"))


BAND_SQL = """bt AS (SELECT band, count(*) AS n, sum(weight) AS w, count(DISTINCT src * 100 + tgt) AS used, avg(rank) AS mean_rank, median(rank) AS median_rank FROM wt GROUP BY band)"""


@query(
    f"""{BASE}, {BAND_SQL} SELECT b.band::INTEGER AS band, coalesce(n, 0) AS n, round(coalesce(w, 0) / (SELECT sum(weight) FROM wt), 6) AS share, coalesce(used, 0) AS n_distinct, round(100.0 * coalesce(used, 0) / 306::DOUBLE, 6) AS coverage,
    round(coalesce(w, 0) / (SELECT sum(weight) FROM wt) * 5, 6) AS over_representation, round(w / n, 9) AS mean_weight FROM range(0, 5) b(band) LEFT JOIN bt ON b.band = bt.band"""
)
def band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every band, selected or not: share of weight, distinct pairs, coverage and over-representation."""
    g = weights(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.count_distinct("src", "tgt").alias("used"))
    g = nw.with_total(g, "w", [])
    total = g.agg(F.max("total").alias("all"))
    rows = spark.range(5).select(F.col("id").cast("int").alias("band")).join(g.drop("total"), "band", "left").crossJoin(F.broadcast(total)).na.fill(0, ["n", "used"])
    share = F.coalesce("w", F.lit(0.0)) / F.col("all")
    return rows.select("band", "n", rnd(share).alias("share"), F.col("used").alias("n_distinct"), rnd(100.0 * F.col("used") / 306).alias("coverage"), rnd(share * 5).alias("over_representation"), rnd(guarded_ratio(F.col("w"), F.col("n")), 9).alias("mean_weight"))


@query(f"{BASE}, {BAND_SQL} SELECT round(x, 6) AS chi2, df, round(exp(-x / 2) * (1 + x / 2), 9) AS p FROM (SELECT sum((n - e) * (n - e) / e) AS x, (count(*) - 1)::INTEGER AS df FROM (SELECT n, sum(n) OVER () / 5::DOUBLE AS e FROM bt))")
def band_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goodness of fit of the five bands' counts against equal ones, with its p-value."""
    g = nw.with_total(weights(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n")), "n", [])
    e = F.col("total") / 5
    x = g.agg(F.sum((F.col("n") - e) * (F.col("n") - e) / e).alias("x"), (F.count("*") - 1).cast("int").alias("df"))
    return x.select(rnd(F.col("x")).alias("chi2"), "df", rnd(chi_square_tail(F.col("x"), 4), 9).alias("p"))


@query(f"{BASE}, {CH}, {DEGREES} SELECT patient, channel, round(out_w, 9) AS out_w, round(in_w, 9) AS in_w, round(out_w - in_w, 9) AS net, round(out_w + in_w, 9) AS total, round((out_w - in_w) / nullif(out_w + in_w, 0), 6) AS asym FROM dg")
def degree_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = nw.degrees(edge_bands(spark, sf_dir), ["patient"])
    return d.select("patient", "channel", rnd(F.col("out"), 9).alias("out_w"), rnd(F.col("in_"), 9).alias("in_w"), rnd(F.col("net"), 9).alias("net"), rnd(F.col("total"), 9).alias("total"), rnd(F.col("asym")).alias("asym"))


@query(f"{BASE}, {CH}, {DEGREES} SELECT patient, round(corr(out_w, in_w), 6) AS out_in_corr FROM dg GROUP BY patient")
def degree_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.degrees(edge_bands(spark, sf_dir), ["patient"]).groupBy("patient").agg(rnd(F.corr("out", "in_")).alias("out_in_corr"))


CUM_SQL = "cs AS (SELECT *, row_number() OVER w AS place, sum(weight) OVER (PARTITION BY patient ORDER BY weight DESC, src, tgt ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY patient) AS share FROM ed WINDOW w AS (PARTITION BY patient ORDER BY weight DESC, src, tgt))"
ROUND_EDGES = EDGES.replace("sum(weight) AS weight", "round(sum(weight), 9) AS weight")


def rounded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("weight", rnd(F.col("weight"), 9))


@query(f"{BASE}, {ROUND_EDGES}, {CUM_SQL} SELECT patient, count(*) AS n_edges, (count(*) FILTER (share < 0.5 - 1e-7) + 1) AS n_half, (count(*) FILTER (share < 0.8 - 1e-7) + 1) AS n_most FROM cs GROUP BY patient")
def edge_cumshare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the heaviest edges hold half and four fifths of a patient's weight."""
    c = nw.cumulative_share(rounded_edges(spark, sf_dir), ["patient"])
    return c.groupBy("patient").agg(F.count("*").alias("n_edges"), (F.count_if(F.col("share") < 0.5 - 1e-7) + 1).alias("n_half"), (F.count_if(F.col("share") < 0.8 - 1e-7) + 1).alias("n_most"))


@query(f"{BASE}, {EDGES} SELECT a.patient, round(sum(least(a.weight, coalesce(b.weight, 0))) / sum(a.weight), 6) AS reciprocity FROM ed a LEFT JOIN ed b ON a.patient = b.patient AND a.src = b.tgt AND a.tgt = b.src GROUP BY a.patient")
def reciprocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.reciprocity(edges(spark, sf_dir), ["patient"]).select("patient", rnd(F.col("reciprocity")).alias("reciprocity"))


@query(f"{BASE} SELECT patient, band, round(sum(weight * abs(src - tgt)) / sum(weight), 6) AS separation FROM wt GROUP BY patient, band")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = edge_bands(spark, sf_dir)
    return w.groupBy("patient", "band").agg(rnd(F.sum(F.col("weight") * F.abs(F.col("src") - F.col("tgt"))) / F.sum("weight")).alias("separation"))


SHARE_SQL = "sh AS (SELECT patient, band, sum(weight) / sum(sum(weight)) OVER (PARTITION BY patient) AS share FROM wt GROUP BY patient, band)"


def band_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares_of(edge_bands(spark, sf_dir))


def shares_of(edges: DataFrame) -> DataFrame:
    """``(patient, band, share)`` of the weights of ``edges(patient, band, .., weight)``."""
    g = edges.groupBy("patient", "band").agg(F.sum("weight").alias("w"))
    return nw.with_total(g, "w", ["patient"]).select("patient", "band", (F.col("w") / F.col("total")).alias("share"))


@query(f"{BASE}, {SHARE_SQL} SELECT patient, round(-sum(share * ln(share)) / ln(5), 6) AS entropy FROM sh GROUP BY patient")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_shares(spark, sf_dir).groupBy("patient").agg(rnd(nw.entropy(F.col("share"), 5)).alias("entropy"))


@query(f"{BASE}, {SHARE_SQL} SELECT patient, arg_max(band, (round(share, 9), -band)) AS dominant, count(*) FILTER (share > 0.2) AS n_above FROM sh GROUP BY patient")
def dominant_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band with the largest share, of equal ones the first, and the number of bands above an equal share."""
    return band_shares(spark, sf_dir).groupBy("patient").agg(F.max_by("band", F.struct(rnd(F.col("share"), 9).alias("s"), (-F.col("band")).alias("b"))).alias("dominant"), F.count_if(F.col("share") > 0.2).alias("n_above"))


@query(f"{BASE}, {SHARE_SQL} SELECT band, round(avg(share), 6) AS mean, round(stddev_samp(share), 6) AS sd, round(stddev_samp(share) / avg(share), 6) AS cv FROM sh GROUP BY band")
def band_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_shares(spark, sf_dir).groupBy("band").agg(rnd(F.avg("share")).alias("mean"), rnd(F.stddev_samp("share")).alias("sd"), rnd(F.stddev_samp("share") / F.avg("share")).alias("cv"))


@query(
    f"""{BASE}, {EDGES}, un AS (SELECT patient, src * 100 + tgt AS dim, weight / sqrt(sum(weight * weight) OVER (PARTITION BY patient)) AS u FROM ed),
    pr AS (SELECT a.patient AS p, b.patient AS q, sum(a.u * b.u) AS c FROM un a JOIN un b ON a.dim = b.dim AND a.patient < b.patient GROUP BY ALL), k AS (SELECT count(DISTINCT patient) AS n FROM un)
    SELECT round((SELECT sum(c) FROM pr) / (n * (n - 1) / 2.0::DOUBLE), 6) AS mean_cosine, n AS n_entities FROM k"""
)
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of the patients' edge profiles, without listing the pairs."""
    e = edges(spark, sf_dir).withColumn("dim", F.col("src") * 100 + F.col("tgt"))
    return nw.mean_cosine(e, "patient", "dim", "weight").select(rnd(F.col("mean_cosine")).alias("mean_cosine"), "n_entities")


@query(f"{BASE}, {EDGES} SELECT patient, round(sum((2 * i - n - 1) * weight) / (max(n) * sum(weight)), 6) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY weight) AS i, count(*) OVER (PARTITION BY patient) AS n FROM ed) GROUP BY patient")
def gini(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nw.gini(edges(spark, sf_dir), ["patient"], "weight").select("patient", rnd(F.col("gini")).alias("gini"))


@query(
    f"""{BASE}, {ROUND_EDGES}, so AS (SELECT patient, src, round(sum(weight), 7) AS w FROM ed GROUP BY ALL), rs AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY w DESC, src) AS r FROM so),
    te AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY weight DESC, src, tgt) AS r FROM ed),
    a AS (SELECT patient, sum(w) FILTER (r <= 2) / sum(w) AS top2, bool_or(src IN (17, 18) AND r <= 2) AS holds FROM rs GROUP BY patient), b AS (SELECT patient, sum(weight) FILTER (r <= 10) / sum(weight) AS top10 FROM te GROUP BY patient)
    SELECT patient, round(top2, 6) AS top2_source_share, holds AS holds_17_18, round(top10, 6) AS top10_edge_share FROM a JOIN b USING (patient)"""
)
def concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the two strongest sources, whether one of two given channels is among them, share of the ten heaviest edges."""
    e = rounded_edges(spark, sf_dir)
    s = e.groupBy("patient", "src").agg(rnd(F.sum("weight"), 7).alias("w")).withColumn("r", F.row_number().over(Window.partitionBy("patient").orderBy(F.desc("w"), "src")))
    a = s.groupBy("patient").agg((F.sum(F.when(F.col("r") <= 2, F.col("w"))) / F.sum("w")).alias("top2"), F.bool_or(F.col("src").isin(17, 18) & (F.col("r") <= 2)).alias("holds_17_18"))
    t = e.withColumn("r", F.row_number().over(Window.partitionBy("patient").orderBy(F.desc("weight"), "src", "tgt")))
    b = t.groupBy("patient").agg((F.sum(F.when(F.col("r") <= 10, F.col("weight"))) / F.sum("weight")).alias("top10"))
    return a.join(b, "patient").select("patient", rnd(F.col("top2")).alias("top2_source_share"), "holds_17_18", rnd(F.col("top10")).alias("top10_edge_share"))


@query(
    f"""{BASE}, {CH}, {DEGREES}, {SHARE_SQL}, nf AS (SELECT patient, 100 + channel AS dim, (out_w - in_w) / sqrt(sum((out_w - in_w) * (out_w - in_w)) OVER (PARTITION BY patient)) AS x FROM dg),
    al AS (SELECT p.patient, p.band AS dim, coalesce(share, 0) AS x FROM (SELECT patient, b::INTEGER AS band FROM (SELECT DISTINCT patient FROM wt), range(0, 5) r(b)) p LEFT JOIN sh USING (patient, band) UNION ALL SELECT * FROM nf),
    ds AS (SELECT patient, sqrt(sum((x - c) * (x - c))) AS distance FROM (SELECT *, avg(x) OVER (PARTITION BY dim) AS c FROM al) GROUP BY patient)
    SELECT arg_min(patient, (round(distance, 9), patient)) AS typical, arg_max(patient, (round(distance, 9), patient)) AS outlier, round(min(distance), 6) AS least, round(max(distance), 6) AS most FROM ds"""
)
def typical_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The patients nearest to and farthest from the mean profile of band shares and unit net flow."""
    w = stored(edge_bands(spark, sf_dir))  # bounded, and read several times
    net = nw.degrees(w, ["patient"])
    norm = net.groupBy("patient").agg(F.sqrt(F.sum(F.col("net") * F.col("net"))).alias("norm"))
    flow = net.join(norm, "patient").select("patient", (F.col("channel") + 100).alias("dim"), (F.col("net") / F.col("norm")).alias("x"))
    zero = w.select("patient").distinct().select("patient", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("dim"), F.lit(0.0).alias("x"))
    bands = shares_of(w).select("patient", F.col("band").alias("dim"), F.col("share").alias("x")).unionByName(zero).groupBy("patient", "dim").agg(F.sum("x").alias("x"))
    every = flow.unionByName(bands)
    centre = every.groupBy("dim").agg(F.avg("x").alias("c"))
    d = every.join(F.broadcast(centre), "dim").groupBy("patient").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))).alias("distance"))
    key = F.struct(rnd(F.col("distance"), 9).alias("d"), "patient")
    return d.agg(F.min_by("patient", key).alias("typical"), F.max_by("patient", key).alias("outlier"), rnd(F.min("distance")).alias("least"), rnd(F.max("distance")).alias("most"))


@query(f"{BASE}, {CH}, {DEGREES} SELECT patient, channel, round((out_w - in_w) / max(abs(out_w - in_w)) OVER (PARTITION BY patient), 6) AS net_flow FROM dg")
def net_flow_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = nw.degrees(edge_bands(spark, sf_dir), ["patient"])
    top = d.groupBy("patient").agg(F.max(F.abs("net")).alias("top"))
    return d.join(top, "patient").select("patient", "channel", rnd(guarded_ratio(F.col("net"), F.col("top"))).alias("net_flow"))


@query(f"{BASE}, {CH}, {DEGREES} SELECT channel, " + ", ".join(f"round(coalesce(sum(CASE WHEN patient = 'p{i:02d}' THEN out_w - in_w END), 0), 9) AS p{i:02d}" for i in range(25)) + " FROM dg GROUP BY channel")
def net_flow_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net flow as a table of channels by patients: the 25 that are known, and any others that there are."""
    d = stored(nw.degrees(edge_bands(spark, sf_dir), ["patient"]))
    known = [f"p{i:02d}" for i in range(25)]
    names = known + sorted(r["patient"] for r in d.select("patient").distinct().collect() if r["patient"] not in known)  # a column each
    wide = d.groupBy("channel").pivot("patient", names).agg(F.sum("net")).na.fill(0.0)
    return wide.select("channel", *(rnd(F.col(n), 9).alias(n) for n in names))


@query(f"{BASE}, {SHARE_SQL} SELECT patient, " + ", ".join(f"round(coalesce(sum(share) FILTER (band = {b}), 0), 6) AS b{b}" for b in range(5)) + " FROM sh GROUP BY patient")
def patient_band_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = band_shares(spark, sf_dir).groupBy("patient").pivot("band", list(range(5))).agg(F.sum("share")).na.fill(0.0)
    return wide.select("patient", *(rnd(F.col(str(b))).alias(f"b{b}") for b in range(5)))


@query(f"WITH {SELECTION_SQL}, tp AS (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY rank, record, band, src, tgt) AS r FROM sel) SELECT patient, band, src, tgt, min(r) AS place FROM tp WHERE r <= 20 GROUP BY ALL")
def top_per_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty selections of a patient over all folds, each feature once."""
    order = Window.partitionBy("patient").orderBy("rank", "record", "band", "src", "tgt")
    top = selections(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r <= 20")
    return top.groupBy("patient", "band", "src", "tgt").agg(F.min("r").cast("long").alias("place"))


@query(f"{BASE} SELECT src, tgt, count(DISTINCT patient) AS n_patients, count(*) AS n FROM wt GROUP BY src, tgt")
def edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights(spark, sf_dir).groupBy("src", "tgt").agg(F.count_distinct("patient").alias("n_patients"), F.count("*").alias("n"))


@query(f"{BASE}, c AS (SELECT patient, src, tgt, count(*) AS n FROM wt GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY patient) AS share FROM c) SELECT src, tgt, round(avg(share), 9) AS mean_share FROM s GROUP BY src, tgt")
def edge_mean_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of an edge over the patients that have it; a patient without it does not count as zero."""
    c = weights(spark, sf_dir).groupBy("patient", "src", "tgt").agg(F.count("*").alias("n"))
    s = nw.with_total(c, "n", ["patient"]).withColumn("share", F.col("n") / F.col("total"))
    return s.groupBy("src", "tgt").agg(rnd(F.avg("share"), 9).alias("mean_share"))


@query(f"""{BASE}, c AS (SELECT patient, 'band' AS axis, band AS item, sum(weight) AS w FROM wt GROUP BY ALL UNION ALL SELECT patient, 'source', src, sum(weight) FROM wt GROUP BY ALL UNION ALL SELECT patient, 'target', tgt, sum(weight) FROM wt GROUP BY ALL),
    s AS (SELECT *, w / sum(w) OVER (PARTITION BY patient, axis) AS share FROM c) SELECT axis, item, round(sum(share) / (SELECT count(DISTINCT patient) FROM wt), 9) AS mean_share, round(sum(w) / (SELECT sum(weight) FROM wt), 9) AS pooled_share FROM s GROUP BY axis, item""")
def normalised_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of bands, sources and targets: within patients and then their mean, and pooled."""
    w = weights(spark, sf_dir)
    axes = F.explode(F.array(*(F.struct(F.lit(n).alias("axis"), F.col(c).alias("item")) for n, c in (("band", "band"), ("source", "src"), ("target", "tgt")))))
    c = w.select("patient", "weight", axes.alias("a")).groupBy("patient", "a.axis", "a.item").agg(F.sum("weight").alias("w"))
    s = nw.with_total(c, "w", ["patient", "axis"])
    n = w.agg(F.count_distinct("patient").alias("n"), F.sum("weight").alias("all"))
    g = s.groupBy("axis", "item").agg(F.sum(F.col("w") / F.col("total")).alias("s"), F.sum("w").alias("w"))
    return g.crossJoin(F.broadcast(n)).select("axis", "item", rnd(F.col("s") / F.col("n"), 9).alias("mean_share"), rnd(F.col("w") / F.col("all"), 9).alias("pooled_share"))


@query(f"WITH {SELECTION_SQL} SELECT band, count(*) AS n, round(avg(rank), 6) AS mean_rank, median(rank) AS median_rank FROM sel GROUP BY band")
def rank_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = selections(spark, sf_dir)
    middle = quantiles(s, ["band"], "rank", {"median_rank": 0.5})
    return s.groupBy("band").agg(F.count("*").alias("n"), rnd(F.avg("rank")).alias("mean_rank")).join(middle, "band")


@query(f"WITH {SELECTION_SQL} SELECT src, tgt, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, src, tgt) AS place FROM sel GROUP BY src, tgt")
def connection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = selections(spark, sf_dir).groupBy("src", "tgt").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"), "src", "tgt")).cast("long"))  # 306 rows


@query(f"""{BASE}, {CH}, {DEGREES} SELECT channel, count(*) FILTER (out_w > in_w) AS n_source_hub, count(*) FILTER (out_w < in_w) AS n_sink_hub, count(DISTINCT patient) AS n FROM dg WHERE abs(out_w - in_w) > 1e-9 GROUP BY channel""")
def hub_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many patients a channel sends more than it receives, or less."""
    d = nw.degrees(edge_bands(spark, sf_dir), ["patient"]).where(F.abs("net") > 1e-9)
    return d.groupBy("channel").agg(F.count_if(F.col("net") > 0).alias("n_source_hub"), F.count_if(F.col("net") < 0).alias("n_sink_hub"), F.count_distinct("patient").alias("n"))


EFFECT_SQL = "ef AS (SELECT patient, band, src, tgt, avg(ln(price) - 10) AS dev, avg(quantity) / 51 AS auc FROM sel GROUP BY ALL)"


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An effect and an AUC per patient and feature, from price and quantity."""
    return selections(spark, sf_dir).groupBy("patient", "band", "src", "tgt").agg(F.avg(F.log("price") - 10).alias("dev"), (F.avg("quantity") / 51).alias("auc"))


@query(f"WITH {SELECTION_SQL}, {EFFECT_SQL}, pm AS (SELECT patient, band, avg(dev) AS m, avg((dev > 0)::INTEGER) AS up, avg((abs(dev) >= 0.8 AND abs(auc - 0.5) >= 0.2)::INTEGER) AS strong FROM ef GROUP BY ALL) SELECT band, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(100 * avg(up), 6) AS increasing, round(100 * avg(strong), 6) AS strong FROM pm GROUP BY band")
def band_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects per band: means within patients, then their mean and spread, and shares that increase or are strong."""
    e = effects(spark, sf_dir)
    strong = (F.abs("dev") >= 0.8) & (F.abs(F.col("auc") - 0.5) >= 0.2)
    p = e.groupBy("patient", "band").agg(F.avg("dev").alias("m"), F.avg((F.col("dev") > 0).cast("int")).alias("up"), F.avg(strong.cast("int")).alias("strong"))
    return p.groupBy("band").agg(rnd(F.avg("m")).alias("mean"), rnd(F.stddev_samp("m")).alias("sd"), rnd(100 * F.avg("up")).alias("increasing"), rnd(100 * F.avg("strong")).alias("strong"))


@query(f"WITH {SELECTION_SQL}, {EFFECT_SQL}, g AS (SELECT src, tgt, avg(abs(dev)) AS importance, CASE WHEN avg(dev) > 0 THEN 'up' ELSE 'down' END AS direction FROM ef GROUP BY ALL) SELECT src, tgt, round(importance, 6) AS importance, direction, row_number() OVER (ORDER BY round(importance, 9) DESC, src, tgt) AS place FROM g QUALIFY place <= 12")
def edge_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve edges with the largest mean effect, and its direction."""
    g = effects(spark, sf_dir).groupBy("src", "tgt").agg(F.avg(F.abs("dev")).alias("importance"), F.when(F.avg("dev") > 0, "up").otherwise("down").alias("direction"))
    top = g.withColumn("place", F.row_number().over(Window.orderBy(F.desc(rnd(F.col("importance"), 9)), "src", "tgt")).cast("long")).where("place <= 12")  # 306 rows
    return top.select("src", "tgt", rnd(F.col("importance")).alias("importance"), "direction", "place")


@query(f"WITH {SELECTION_SQL}, {EFFECT_SQL} SELECT patient, round(avg(dev), 6) AS mean_dev, round(max(abs(auc - 0.5)) + 0.5, 6) AS best_auc FROM ef GROUP BY patient")
def patient_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effects(spark, sf_dir).groupBy("patient").agg(rnd(F.avg("dev")).alias("mean_dev"), rnd(F.max(F.abs(F.col("auc") - 0.5)) + 0.5).alias("best_auc"))


@query(
    f"""{BASE}, {EFFECT_SQL}, s AS (SELECT src, count(*) AS n FROM wt GROUP BY src), i AS (SELECT src, avg(abs(dev)) AS d FROM ef GROUP BY src), t AS (SELECT s.src, n, d, row_number() OVER (ORDER BY round(d, 9) DESC, s.src) AS r FROM s JOIN i USING (src))
    SELECT src, round(n * 1.0::DOUBLE / sum(n) OVER (), 9) AS selected_share, round(d / sum(d) OVER (), 9) AS effect_share, r <= 6 AS in_top, round(100 * sum(CASE WHEN r <= 6 THEN n END) OVER () / sum(n) OVER ()::DOUBLE, 6) AS top_overlap FROM t"""
)
def selected_against_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by share of selections and of effects, and how many selections fall on the six with most effect."""
    s = weights(spark, sf_dir).groupBy("src").agg(F.count("*").alias("n"))
    i = effects(spark, sf_dir).groupBy("src").agg(F.avg(F.abs("dev")).alias("d"))
    t = s.join(i, "src").withColumn("r", F.row_number().over(Window.orderBy(F.desc(rnd(F.col("d"), 9)), "src")))  # 18 rows
    total = t.agg(F.sum("n").alias("n_all"), F.sum("d").alias("d_all"), F.sum(F.when(F.col("r") <= 6, F.col("n"))).alias("n_top"))
    return t.crossJoin(F.broadcast(total)).select("src", rnd(F.col("n") / F.col("n_all"), 9).alias("selected_share"), rnd(F.col("d") / F.col("d_all"), 9).alias("effect_share"), (F.col("r") <= 6).alias("in_top"), rnd(100 * F.col("n_top") / F.col("n_all")).alias("top_overlap"))
