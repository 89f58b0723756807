"""Stages of pipelines: what they learn, and that they are the same after saving and loading."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC

from wavetally.config import Config
from wavetally.operators import pipeline as pl, stats as st
from wavetally.operators.models import Fitted


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(8)
    x = r.standard_normal((240, 6)) * [1, 5, 0.1, 1, 1, 0] + 3
    y = ((x[:, 0] - 3) + (x[:, 1] - 3) / 5 + 0.5 * r.standard_normal(240) > 0.4).astype(int)
    return x, y


def test_stages_equal_the_plain_fit_and_are_kept(spark, rows, tmp_path):
    x, y = rows
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "i long, features array<double>, y int").repartition(3)
    stages = [pl.ArrayScaler(), pl.FeatureSelector(k=3, inputCol="scaled"), pl.KernelClassifier(c=2.0, inputCol="selected")]
    fitted = Pipeline(stages=stages).fit(df)
    got = {r.i: r.score for r in fitted.transform(df).collect()}
    f = Fitted(x, y, 3, Config())
    assert fitted.stages[1].getOrDefault("chosen") == f.ranking
    want = f.decide(x, 3, 2.0, "scale")
    assert np.abs(np.array([got[i] for i in range(len(x))]) - want).max() < 0.02
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    assert {r.i: r.score for r in again.transform(df).collect()} == got
    Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "plan"))
    refitted = Pipeline.load(str(tmp_path / "plan")).fit(df)
    assert {r.i: r.score for r in refitted.transform(df).collect()} == pytest.approx(got, abs=1e-9)


def test_a_mapped_kernel_comes_near_the_kernel(spark, tmp_path):
    """Products of mapped rows are kernel values, and a linear classifier of all rows ranks as the kernel classifier does."""
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 4))
    y = ((x**2).sum(axis=1) + 0.5 * r.standard_normal(600) > 3.5).astype(int)
    df = pl.balanced(spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "i long, features array<double>, y int"))
    assert df.agg({"weight": "avg"}).first()[0] == pytest.approx(1.0)
    m = pl.KernelMap(landmarks=300, gamma=0.2).fit(df)
    m.write().overwrite().save(str(tmp_path / "map"))
    rows = pl.KernelMapModel.load(str(tmp_path / "map")).transform(df).orderBy("i").collect()
    phi = np.array([row.mapped.toArray() for row in rows])
    k = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(phi @ phi.T - k).mean() < 0.01
    line = LinearSVC(featuresCol="mapped", labelCol="y", weightCol="weight", predictionCol="hit", rawPredictionCol="raw", regParam=1e-3)
    fitted = Pipeline(stages=[m, line]).fit(df)
    score = np.array([row.raw[1] for row in fitted.transform(df).orderBy("i").collect()])
    plain = np.array([row.score for row in pl.KernelClassifier(c=1.0, gamma=0.2).fit(df).transform(df).orderBy("i").collect()])
    auc = lambda s: np.mean(s[y == 1][:, None] > s[y == 0][None, :])
    assert abs(auc(score) - auc(plain)) < 0.01 and auc(score) > 0.9


def test_a_budget_keeps_both_classes(spark, rows):
    x, y = rows
    df = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "features array<double>, y int")
    m = pl.KernelClassifier(budget=40).fit(df)
    assert 1 < len(m.getOrDefault("multipliers")) <= 41 and len(m.getOrDefault("rows")) == 6 * len(m.getOrDefault("multipliers"))
    with pytest.raises(ValueError):
        pl.KernelClassifier().fit(df.where("y = 1"))


def test_quantiles(spark):
    r = np.random.default_rng(3)
    rows = [(k, float(v)) for k in ("a", "b", None) for v in np.round(r.standard_normal(r.integers(1, 400)), 1)] + [("c", None), ("d", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = {"low": 0.1, "mid": 0.5, "q3": 0.75, "top": 1.0}
    got = {r.k: r for r in st.quantiles(df.where("k is not null"), ["k"], "v", shares).collect()}
    assert got.keys() == {"a", "b", "d"}
    for k, row in got.items():
        own = [v for n, v in rows if n == k]
        assert [row[n] for n in shares] == pytest.approx(list(np.quantile(own, list(shares.values()))))
    (whole,) = st.quantiles(df, [], "v", {"mid": 0.5}).collect()
    assert whole.mid == pytest.approx(np.median([v for _, v in rows if v is not None]))
