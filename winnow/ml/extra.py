"""Learners that MLlib lacks, with its fit and transform: nearest neighbours, ridge classifier."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.neighbors import LeafIndex, knn_index, knn_predict


class NearestNeighbours:
    """Mean label, or most frequent one, of the ``k`` nearest training rows.  Rows are identified by column ``key``."""

    def __init__(self, features: int, classify: bool, k: int = 5) -> None:
        self.columns, self.classify, self.k = [f"_x{i}" for i in range(features)], classify, k
        self.known: DataFrame | None = None
        self.index: LeafIndex | None = None

    def _flat(self, df: DataFrame, *more: str) -> DataFrame:
        x = vector_to_array("features")
        return df.select("key", *more, *[x[i].alias(n) for i, n in enumerate(self.columns)])

    def fit(self, df: DataFrame) -> NearestNeighbours:
        model = NearestNeighbours(len(self.columns), self.classify, self.k)
        model.known = model._flat(df, "label")
        return model

    def transform(self, df: DataFrame) -> DataFrame:
        if self.index is None:  # one for all tables that are scored
            self.index = knn_index(self.known, "key", self.columns, self.k)
        got = knn_predict(self.known, self._flat(df), "key", "key", self.columns, "label", self.k, self.classify, self.index)
        return df.join(got, "key")


class RidgeClassifier:
    """Penalised least squares on +1 for a class and -1 for the others; the class with the largest value wins."""

    def __init__(self, classes: int, alpha: float = 1.0) -> None:
        self.classes, self.alpha = classes, alpha
        self.models: list = []

    def fit(self, df: DataFrame) -> RidgeClassifier:
        model, n = RidgeClassifier(self.classes, self.alpha), max(df.count(), 1)
        for i in range(self.classes if self.classes > 2 else 1):
            on = i if self.classes > 2 else 1
            d = df.withColumn("_y", F.when(F.col("label") == on, 1.0).otherwise(-1.0))
            one = LinearRegression(labelCol="_y", regParam=self.alpha / n, standardization=False, predictionCol=f"_r{i}").fit(d)
            model.models.append(one)
        return model

    def transform(self, df: DataFrame) -> DataFrame:
        for one in self.models:
            df = one.transform(df)
        names = [one.getPredictionCol() for one in self.models]
        if self.classes > 2:
            best = F.array_position(F.array(*names), F.greatest(*names)) - 1
        else:
            best = F.col(names[0]) > 0
        return df.withColumn("prediction", best.cast("double")).drop(*names)
