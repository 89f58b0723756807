"""Windows, filters, models and folds, over ``embeddings`` and ``events`` as recordings."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..operators import evaluation as ez, metrics as mt, models as md, pipeline as pl, series as sr, windowing as wd
from ..operators.stats import with_below
from ..tables import table
from .inputs import FEATURES_SQL, SCORES_SQL, features, rnd, scores
from .registry import query

#: A small recording: 16 samples a second, windows of 32 samples every 8.
SMALL = Config(fs=16, window_s=2.0, step_s=0.5)
BANDS = (("slow", 0.5, 2.0), ("mid", 2.0, 4.0), ("fast", 4.0, 8.0))
#: Vectors of a label in order are samples in time; each four components are the channels of a recording.
SERIES_SQL = f"{FEATURES_SQL}, sg AS (SELECT label * 1000 + feature // 4 AS record, feature % 4 AS channel, row_number() OVER (PARTITION BY label, feature ORDER BY vec_id) - 1 AS s, x FROM ft)"


#: Samples of a block.
SIZE = 256


def samples(spark: SparkSession, sf_dir: str, channels: int = 4) -> DataFrame:
    """``(record, channel, s, x)``: all components, as recordings of so many channels each."""
    rows = sr.numbered(table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding"), ["label"], "vec_id")
    long = rows.select("label", "s", F.posexplode("embedding").alias("feature", "x"))
    record = (F.col("label") * 1000 + F.floor(F.col("feature") / channels)).cast("long")
    return long.select(record.alias("record"), (F.col("feature") % channels).alias("channel"), "s", F.col("x").cast("double").alias("x"))


def blocks(spark: SparkSession, sf_dir: str, channels: int = 4) -> DataFrame:
    """``(record, channel, block, samples)``: the same recordings in blocks."""
    return sr.blocks_of(samples(spark, sf_dir, channels), ["record"], SIZE)


def memberships(spark: SparkSession, sf_dir: str, channels: int = 4) -> DataFrame:
    """``(record, w, channel, s, x)``: each sample goes to its windows by arithmetic."""
    rows = samples(spark, sf_dir, channels)
    n = rows.groupBy("record").agg((F.max("s") + 1).alias("n")).withColumn("n_windows", F.floor((F.col("n") - SMALL.window) / SMALL.step) + 1)
    return rows.join(n, "record").withColumn("w", F.explode(wd.windows_of_sample(F.col("s"), F.col("n_windows"), SMALL.window, SMALL.step)))


@query("SELECT user_id AS record, w, w * 8 AS start, w * 8 + 32 AS stop FROM (SELECT user_id, unnest(range(0, greatest(0, (count(*) - 32) // 8 + 1)::BIGINT)) AS w FROM events GROUP BY user_id HAVING count(*) >= 32)")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("record")).agg(F.count("*").alias("n_samples"))
    return wd.sliding_windows(n, ["record"], SMALL)


@query(
    f"""WITH {SERIES_SQL}, n AS (SELECT record, (max(s) + 1 - 32) // 8 + 1 AS nw FROM sg GROUP BY record), m AS (SELECT sg.*, unnest(range(greatest(0, ceil((s - 31) / 8.0))::BIGINT, least(nw - 1, s // 8)::BIGINT + 1)) AS w FROM sg JOIN n USING (record))
    SELECT record, w, channel::INTEGER AS channel, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM m GROUP BY ALL"""
)
def window_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, mean and spread of every window of every channel."""
    w = memberships(spark, sf_dir)
    return w.groupBy("record", "w", "channel").agg(F.count("*").alias("n"), rnd(F.avg("x")).alias("mean"), rnd(F.stddev_samp("x")).alias("sd"))


@query(f"WITH {SERIES_SQL} SELECT record, channel::INTEGER AS channel, s, round(x / stddev_samp(x) OVER (PARTITION BY record, channel), 6) AS x FROM sg")
def scaled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sr.scale_by_spread(blocks(spark, sf_dir), ["record"])
    return c.select("record", "channel", "block", F.posexplode("samples").alias("s", "x")).select("record", "channel", (F.col("block") * SIZE + F.col("s")).alias("s"), rnd(F.col("x")).alias("x"))


@query(
    f"""WITH {FEATURES_SQL}, pt AS (SELECT vec_id, feature * 0.75::DOUBLE AS freq, abs(x) AS v FROM ft), bd(band, lo, hi) AS (VALUES ('delta', 0.5::DOUBLE, 4.0::DOUBLE), ('theta', 4, 8), ('alpha', 8, 13), ('beta', 13, 30), ('gamma', 30, 45)),
    a AS (SELECT vec_id, band, hi - lo AS width, (lead(freq) OVER o - freq) * (lead(v) OVER o + v) / 2 AS area FROM pt JOIN bd ON freq BETWEEN lo AND hi WINDOW o AS (PARTITION BY vec_id, band ORDER BY freq))
    SELECT vec_id, band, round(sum(area) / any_value(width), 6) AS value FROM a GROUP BY vec_id, band"""
)
def band_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector's components as a spectrum, integrated over bands."""
    points = features(spark, sf_dir).select("vec_id", (F.col("feature") * 0.75).alias("freq"), F.abs("x").alias("v"))
    bands = spark.createDataFrame(list(Config().bands), "band string, lo double, hi double")
    return wd.band_trapezoid(points, ["vec_id"], bands).select("vec_id", "band", rnd(F.col("value")).alias("value"))


@query(f"WITH {SERIES_SQL}, p AS (SELECT record, channel, sum(x) AS total, count(*) AS n FROM sg GROUP BY ALL) SELECT record, channel::INTEGER AS channel, n, round(total, 6) AS total, round(total / n, 6) AS level FROM p")
def record_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of recordings: samples and level of each channel."""
    return samples(spark, sf_dir).groupBy("record", "channel").agg(F.count("*").alias("n"), rnd(F.sum("x")).alias("total"), rnd(F.sum("x") / F.count("*")).alias("level"))


@query(f"WITH {SERIES_SQL} SELECT record, channel::INTEGER AS channel, w, round(x - avg(x) OVER (PARTITION BY record, channel, w), 6) AS x, s FROM (SELECT sg.*, unnest(range(greatest(0, ceil((s - 31) / 8.0))::BIGINT, least(nw - 1, s // 8)::BIGINT + 1)) AS w FROM sg JOIN (SELECT record, (max(s) + 1 - 32) // 8 + 1 AS nw FROM sg GROUP BY record) USING (record))")
def demeaned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of every window, less the window's mean of their channel."""
    return wd.demeaned(memberships(spark, sf_dir), ["record", "w", "channel"], "x").select("record", "channel", "w", rnd(F.col("x")).alias("x"), "s")


@query()
def filtered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each channel without its slow drift and one hum frequency: the power before and after."""
    c = sr.filtered(blocks(spark, sf_dir), ["record"], SMALL.fs, 0.5, 6.0)
    power = lambda a: F.sum(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)) / F.sum(F.size(a))
    return c.groupBy("record", "channel").agg(power(F.col("samples")).alias("before"), power(F.col("filtered")).alias("after"))


@query(
    f"""WITH {SERIES_SQL}, n AS (SELECT record, channel, least(32, max(s) + 1) AS len, max(s) + 1 AS n FROM sg GROUP BY ALL), h AS (SELECT *, greatest(1, len // 2) AS hop FROM n),
    m AS (SELECT sg.record, sg.channel, len, seg, s - seg * hop AS i, x - avg(x) OVER (PARTITION BY sg.record, sg.channel, seg) AS x FROM sg JOIN h USING (record, channel), unnest(range(0, (n - len) // hop + 1)) AS u(seg) WHERE s BETWEEN seg * hop AND seg * hop + len - 1),
    d AS (SELECT record, channel, len, seg, bin, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / len)) * cos(2 * pi() * bin * i / len)) AS a, sum(x * (0.5 - 0.5 * cos(2 * pi() * i / len)) * sin(2 * pi() * bin * i / len)) AS b FROM m, unnest(range(0, len // 2 + 1)) AS u(bin) GROUP BY ALL)
    SELECT record, channel::INTEGER AS channel, bin::INTEGER AS bin, round(avg(a * a + b * b) / (0.375 * len * 16) * CASE WHEN bin > 0 AND 2 * bin < len THEN 2 ELSE 1 END, 6) AS power FROM d WHERE len > 2 GROUP BY record, channel, bin, len"""
)
def power_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power spectral density of each channel, in long form."""
    return sr.power_spectra(blocks(spark, sf_dir), ["record"], SMALL.fs, 32, SIZE).withColumn("power", rnd(F.col("power")))


def models(spark: SparkSession, sf_dir: str, resolution: int | None = 32, lags: int | None = None) -> DataFrame:
    return sr.window_models(blocks(spark, sf_dir), ["record"], SMALL, SIZE, 1, resolution, BANDS, lags)


@query()
def var_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Banded directed connectivity of every window, or why its model is not usable."""
    return models(spark, sf_dir).select("record", "w", "valid", "reason", "radius", "decay", F.posexplode_outer("features").alias("feature_index", "value"))


@query()
def var_gc_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at each window's own resolution, as fine as its model's decay asks for."""
    return models(spark, sf_dir, None).select("record", "w", "valid", "reason", "resolution", F.posexplode_outer("features").alias("feature_index", "value"))


def agreed(left: DataFrame, right: DataFrame) -> DataFrame:
    """How far two versions of the windows' features agree, by record."""
    g = sr.agreement(left, right, ["record", "w"]).groupBy("record")
    return g.agg(F.count("*").alias("n_windows"), F.avg("r").alias("r_mean"), F.stddev_samp("r").alias("r_sd"), F.min("r").alias("r_min"), F.avg("mae").alias("mae_mean"), F.max("mae").alias("mae_max"))


@query()
def resolution_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features at the resolution of the models' decay against those at a fixed one: correlation and mean absolute error of the windows."""
    return agreed(models(spark, sf_dir, None), models(spark, sf_dir))


@query()
def route_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the state-space route against those of the older one by autocovariances."""
    return agreed(models(spark, sf_dir), models(spark, sf_dir, lags=100))


@query()
def var_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of least BIC over windows: median and quartiles per record."""
    o = sr.model_orders(blocks(spark, sf_dir, 2), ["record"], SMALL, SIZE, 4).where("order is not null")
    return o.groupBy("record").agg(F.count("*").alias("n_windows"), F.median("order").alias("median_order"), F.percentile("order", F.array(F.lit(0.25), F.lit(0.75))).alias("quartiles"))


@query()
def covariance_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, condition and extreme eigenvalues of the channels of every window."""
    return sr.covariance_health(blocks(spark, sf_dir), ["record"], SMALL, SIZE)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record, w, y, features)``: vectors as windows of ten records."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 10).alias("record"), F.floor(F.col("vec_id") / 10).alias("w"), (F.col("label") == 0).cast("int").alias("y"), F.col("embedding").alias("features"))


#: Training rows of a fold: the budget and strata of the reference.
TRAINING = Config()


@query()
def loro_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one record out: a row per record with the metrics of its out-of-fold scores."""
    s = md.fold_scores(labelled(spark, sf_dir).withColumn("fold", F.col("record")), "fold", TRAINING).where("score is not null")
    return mt.curves(s, ["record"])


@query()
def random_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random windows by class, records ignored: a row per fold."""
    s = md.fold_scores(md.random_folds(labelled(spark, sf_dir), TRAINING), "fold", TRAINING).where("score is not null")
    return mt.curves(s, ["fold"])


@query()
def random_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of random windows of each patient, with their parameters, in the columns of the segment table."""
    return ez.random_protocol(patients(spark, sf_dir)[0], (20, 1.0, 0.001), TRAINING)


@query()
def kernel_map_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel classifier trained on all rows, by a map of the kernel and a linear classifier: its curves by record."""
    rows = pl.balanced(labelled(spark, sf_dir))
    line = LinearSVC(featuresCol="mapped", labelCol="y", weightCol="weight", predictionCol="hit", rawPredictionCol="raw", regParam=1e-3, maxIter=50)
    fitted = Pipeline(stages=[pl.ArrayScaler(), pl.KernelMap(inputCol="scaled", landmarks=200), line]).fit(rows)
    scored = fitted.transform(rows).select("record", "y", vector_to_array("raw")[1].alias("score"))
    return mt.curves(scored, ["record"])


@query()
def nested_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one record out with hyper-parameters chosen inside each fold on a small grid."""
    grid = {"k_feat": (10, 20), "c": (1.0,), "gamma": ("scale",)}
    s = md.fold_scores(labelled(spark, sf_dir).withColumn("fold", F.col("record")), "fold", TRAINING, grid)
    return s.groupBy("fold", "k_feat", "c", "gamma", "error").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0).alias("n_alarm"))


def patients(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows of four patients' records, some of them without events, and the annotations that their positive windows make."""
    rows = labelled(spark, sf_dir).withColumn("patient", F.concat(F.lit("p"), F.floor(F.col("w") % 4).cast("string"))).withColumn("w", F.floor(F.col("w") / 4))
    rows = rows.withColumn("y", F.when(F.col("record") % 5 < 3, F.col("y")).otherwise(0))
    start = F.col("w") * TRAINING.step_s
    return rows, rows.where("y = 1").select("patient", "record", start.alias("start"), (start + TRAINING.window_s).alias("end"))


@query()
def patient_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation: a row per patient with its event, sample and window metrics and the parameters chosen most."""
    windows, annotations = patients(spark, sf_dir)
    found = ez.evaluate(windows, annotations, {"k_feat": (8, 16), "c": (1.0,), "gamma": ("scale",)}, (2, 3), TRAINING)
    return found.summary


@query(f"WITH {SCORES_SQL} SELECT record, patient, max(y) AS record_class, count(*) AS n, row_number() OVER (ORDER BY record) AS fold FROM sc GROUP BY record, patient HAVING max(y) <> min(y)")
def fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that can be left out: those with both classes; a row per record."""
    g = scores(spark, sf_dir).groupBy("record", "patient").agg(F.max("y").alias("record_class"), F.min("y").alias("low"), F.count("*").alias("n")).where("record_class <> low").withColumn("one", F.lit(1))
    return with_below(g, [], "record", ["one"]).select("record", "patient", "record_class", "n", (F.col("below_one") + 1).cast("long").alias("fold"))
