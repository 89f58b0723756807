"""Scaling, selection and a kernel classifier as stages of ``pyspark.ml`` pipelines, over array columns.

Fitted stages hold their numbers as parameters, so that pipelines of them are saved and loaded as any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..config import DEFAULT
from ..functions.kernel_svm import KernelSvm, scale
from .models import class_weights
from .sampling import hash_order
from .selection import select_features


class _Columns(HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """What all stages have: names of columns."""

    def _own(self, given: dict | None = None, **defaults):
        self._setDefault(inputCol="features", labelCol="y", **defaults)
        self._set(**{k: v for k, v in (given or {}).items() if v is not None})

    def _fitted(self, model: Model, **numbers) -> Model:
        return model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), labelCol=self.getLabelCol(), **numbers)


def _param(name: str, doc: str, kind) -> Param:
    return Param(Params._dummy(), name, doc, kind)


class ArrayScalerModel(Model, _Columns):
    """Arrays less ``mean``, over ``spread``, component by component."""

    mean = _param("mean", "of each component", TypeConverters.toListFloat)
    spread = _param("spread", "population standard deviation of each component, one if it is constant", TypeConverters.toListFloat)

    def __init__(self):
        super().__init__()
        self._own(outputCol="scaled")

    def _transform(self, df: DataFrame) -> DataFrame:
        zipped = F.arrays_zip(F.col(self.getInputCol()).alias("x"), F.lit(self.getOrDefault("mean")).alias("m"), F.lit(self.getOrDefault("spread")).alias("s"))
        return df.withColumn(self.getOutputCol(), F.transform(zipped, lambda v: (v["x"] - v["m"]) / v["s"]))


class ArrayScaler(Estimator, _Columns):
    """Learns means and spreads of the components of an array column."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None):
        super().__init__()
        self._own(self._input_kwargs, outputCol="scaled")

    def _fit(self, df: DataFrame) -> ArrayScalerModel:
        long = df.select(F.posexplode(self.getInputCol()).alias("i", "x"))
        got = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # a row per component
        return self._fitted(ArrayScalerModel(), mean=[r["m"] for r in got], spread=[r["s"] if r["s"] and r["s"] > 0 else 1.0 for r in got])


class FeatureSelectorModel(Model, _Columns):
    """Keeps the chosen components of each array, in their order of rank."""

    chosen = _param("chosen", "places of the components", TypeConverters.toListInt)

    def __init__(self):
        super().__init__()
        self._own(outputCol="selected")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.getOutputCol(), F.array(*(F.col(self.getInputCol())[i] for i in self.getOrDefault("chosen"))))


class FeatureSelector(Estimator, _Columns):
    """Chooses the ``k`` components of most relevance and least redundancy; see :func:`.selection.select_features`."""

    k = _param("k", "components to keep", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, k=None, inputCol=None, outputCol=None, labelCol=None):
        super().__init__()
        self._own(self._input_kwargs, k=20, outputCol="selected")

    def _fit(self, df: DataFrame) -> FeatureSelectorModel:
        rows = select_features(df, self.getOrDefault("k"), self.getInputCol(), self.getLabelCol()).orderBy("rank").collect()  # k rows
        return self._fitted(FeatureSelectorModel(), chosen=[r["feature_index"] for r in rows] or [0])


class KernelClassifierModel(Model, _Columns):
    """Scores by a Gaussian kernel over the rows that the fit has kept, as many as the training budget at most."""

    rows = _param("rows", "kept rows, one behind the other", TypeConverters.toListFloat)
    multipliers = _param("multipliers", "signed multiplier of each kept row", TypeConverters.toListFloat)
    bias = _param("bias", "added to every score", TypeConverters.toFloat)
    scale = _param("scale", "factor of squared distances", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._own(outputCol="score")

    def _transform(self, df: DataFrame) -> DataFrame:
        a, bias, g = np.array(self.getOrDefault("multipliers")), self.getOrDefault("bias"), self.getOrDefault("scale")
        x = np.array(self.getOrDefault("rows")).reshape(len(a), -1)

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            if not len(a):
                return pd.Series(np.full(len(v), bias))
            z = np.array(v.tolist(), float).reshape(len(v), -1)
            d = (z * z).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * z @ x.T
            return pd.Series(np.exp(-g * np.maximum(d, 0)) @ a + bias)

        return df.withColumn(self.getOutputCol(), score(F.col(self.getInputCol())))


class KernelClassifier(Estimator, _Columns):
    """A weighted support-vector classifier, fitted on at most ``budget`` rows: of each class its share, and one at least, in the order of a hash of the rows."""

    c = _param("c", "penalty", TypeConverters.toFloat)
    gamma = _param("gamma", "factor of squared distances; 0: one over the number of components times their variance", TypeConverters.toFloat)
    budget = _param("budget", "rows of the training set", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, c=None, gamma=None, budget=None, inputCol=None, outputCol=None, labelCol=None):
        super().__init__()
        self._own(self._input_kwargs, c=1.0, gamma=0.0, budget=DEFAULT.budget, outputCol="score")

    def _fit(self, df: DataFrame) -> KernelClassifierModel:
        rows = df.select(F.col(self.getInputCol()).cast("array<double>").alias("x"), F.col(self.getLabelCol()).cast("int").alias("y")).where("x is not null and y in (0, 1)")
        n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(n) < 2:
            raise ValueError("the training rows have one class")
        budget, c, gamma, power = self.getOrDefault("budget"), self.getOrDefault("c"), self.getOrDefault("gamma") or "scale", DEFAULT.weight_power
        rows = rows.withColumn("h", F.to_json("x")).withColumn("h", hash_order(DEFAULT.seed, "h"))
        parts = [rows.where(F.col("y") == y).orderBy("h").limit(max(1, round(min(1.0, budget / sum(n.values())) * m))) for y, m in sorted(n.items())]

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["y", "h"])
            x, y = np.array(pdf["x"].tolist(), float), pdf["y"].to_numpy()
            m = KernelSvm(c, gamma).fit(x, y, class_weights(y, power))
            return pd.DataFrame({"rows": [x[m.on].ravel()], "multipliers": [m.beta[m.on]], "bias": [m.bias], "scale": [m.kernel.gamma]})

        got = parts[0].unionByName(parts[1]).groupBy().applyInPandas(fit, "rows array<double>, multipliers array<double>, bias double, scale double").first()  # within the budget
        return self._fitted(KernelClassifierModel(), **got.asDict())


class KernelMapModel(Model, _Columns):
    """Vectors whose products come near the values of a Gaussian kernel: its values at the landmarks, times a fixed matrix."""

    landmarks = _param("landmarks", "rows, one behind the other", TypeConverters.toListFloat)
    weights = _param("weights", "the matrix, row by row", TypeConverters.toListFloat)
    scale = _param("scale", "factor of squared distances", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._own(outputCol="mapped")

    def _transform(self, df: DataFrame) -> DataFrame:
        w, g = np.array(self.getOrDefault("weights")), self.getOrDefault("scale")
        side = round(len(w) ** 0.5)
        w, x = w.reshape(side, side), np.array(self.getOrDefault("landmarks")).reshape(side, -1)

        @F.pandas_udf("array<double>")
        def mapped(v: pd.Series) -> pd.Series:
            z = np.array(v.tolist(), float).reshape(len(v), -1)
            d = (z * z).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * z @ x.T
            return pd.Series(list(np.exp(-g * np.maximum(d, 0)) @ w))

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(F.col(self.getInputCol()))))


class KernelMap(Estimator, _Columns):
    """Nystroem's map of a Gaussian kernel from ``landmarks`` rows, taken in the order of a hash.

    A linear classifier over the mapped rows, such as ``LinearSVC``, is a kernel classifier that is trained on all rows, where they are; only
    the landmarks meet on the driver.
    """

    landmarks = _param("landmarks", "rows that the kernel is taken at", TypeConverters.toInt)
    gamma = _param("gamma", "factor of squared distances; 0: one over the number of components times their variance", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, landmarks=None, gamma=None, inputCol=None, outputCol=None):
        super().__init__()
        self._own(self._input_kwargs, landmarks=256, gamma=0.0, outputCol="mapped")

    def _fit(self, df: DataFrame) -> KernelMapModel:
        rows = df.select(F.col(self.getInputCol()).cast("array<double>").alias("x")).where("x is not null").distinct()
        took = rows.withColumn("h", F.to_json("x")).orderBy(hash_order(DEFAULT.seed, "h")).limit(self.getOrDefault("landmarks")).collect()  # the landmarks
        x = np.array([r["x"] for r in took])
        g = self.getOrDefault("gamma") or scale(x)
        values, vectors = np.linalg.eigh(np.exp(-g * ((x[:, None] - x[None]) ** 2).sum(axis=2)))
        good = values > 1e-10 * values[-1]
        root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
        return self._fitted(KernelMapModel(), landmarks=x.ravel(), weights=root.ravel(), scale=float(g))


def balanced(df: DataFrame, label: str = "y", power: float = DEFAULT.weight_power) -> DataFrame:
    """``df`` with ``weight``: damped class weights with mean one, for classifiers that are trained on all rows."""
    n = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    raw = n.crossJoin(total).withColumn("_w", F.pow(F.col("_all") / (F.col("_classes") * F.col("_n")), F.lit(power)))  # a row per class
    mean = raw.agg((F.sum(F.col("_w") * F.col("_n")) / F.sum("_n")).alias("_mean"))
    told = raw.crossJoin(mean).select(label, (F.col("_w") / F.col("_mean")).alias("weight"))
    return df.join(F.broadcast(told), label)
