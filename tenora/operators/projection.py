"""Linear projections: factor analysis, and a transformer that applies a fitted matrix."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


class LinearProjection(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """``output = input @ matrix`` on a vector column, in Arrow batches."""

    matrix = Param(Params._dummy(), "matrix", "rows of the matrix as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, matrix: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        weights = np.array(json.loads(self.getOrDefault(self.matrix)))

        @F.pandas_udf(ArrayType(DoubleType()))
        def project(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in parts:
                yield pd.Series(list(np.stack(x.to_numpy()) @ weights)) if len(x) else pd.Series([], dtype=object)

        projected = project(vector_to_array(F.col(self.getInputCol())))
        return df.withColumn(self.getOutputCol(), array_to_vector(projected))


def fit_factors(
    covariance: np.ndarray, n_rows: int, k: int, tol: float = 1e-2, max_iter: int = 1000
) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (k x d) and noise variances (d) by expectation maximisation on a covariance matrix.

    Barber, Bayesian Reasoning and Machine Learning, section 21.2: alternate between the leading
    eigenvectors of the noise-scaled covariance and the residual variances.
    """
    tiny = 1e-12
    d = len(covariance)
    if k > d:
        raise ValueError(f"{k} factors asked of {d} features")
    variance = np.diag(covariance)
    noise = np.ones(d)
    loadings, before = np.zeros((k, d)), -np.inf
    for _ in range(max_iter):
        scale = np.sqrt(noise) + tiny
        values, vectors = np.linalg.eigh(covariance / scale[:, None] / scale[None, :])
        top, rest = values[::-1][:k], values[::-1][k:]
        basis = vectors[:, ::-1][:, :k].T
        loadings = np.sqrt(np.maximum(top - 1.0, 0.0))[:, None] * basis * scale
        fit = np.log(np.maximum(top, tiny)).sum() + max(rest.sum(), 0.0) + k
        likelihood = -n_rows / 2.0 * (d * np.log(2 * np.pi) + fit + np.log(noise).sum())
        if likelihood - before < tol:
            break
        before = likelihood
        noise = np.maximum(variance - (loadings**2).sum(0), tiny)
    return loadings, noise


def implied_covariance(loadings: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """The covariance that a fitted factor model gives its features; its diagonal is that of the data at the optimum."""
    return loadings.T @ loadings + np.diag(noise)


def posterior_matrix(loadings: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """d x k matrix that maps centred rows to the posterior mean of the factors."""
    weighted = loadings / noise
    return weighted.T @ np.linalg.inv(np.eye(len(loadings)) + weighted @ loadings.T)


def scaled_covariance(point: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(covariance of the standardised features, mean, one over deviation, rows) from ``moments`` of some parts.

    The deviation is the sample's, as in the built-in scaler; a constant feature is scaled by 0. The covariance is the
    population's.
    """
    n = sum(p[0] for p in parts)
    total, products = sum(p[1] for p in parts), sum(p[2] for p in parts)
    covariance = products / max(n, 1) - np.outer(total, total) / max(n, 1) ** 2
    variance = np.maximum(np.diag(covariance), 0.0) * n / max(n - 1, 1)
    tiny = 1e-12 * np.maximum(np.diag(products) / max(n, 1), 1e-300)
    scale = np.where(variance > tiny, 1 / np.sqrt(np.where(variance > tiny, variance, 1.0)), 0.0)
    return covariance * scale[:, None] * scale[None, :], point + total / max(n, 1), scale, int(n)


def leading_directions(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(d x k matrix of the leading eigenvectors, share of the variance of every eigenvector in falling order).

    An eigenvector points so that its entry of largest size, the first of equals, is positive.
    """
    values, directions = np.linalg.eigh(covariance)
    values, directions = np.maximum(values[::-1], 0.0), directions[:, ::-1]
    largest = np.argmax(np.round(np.abs(directions), 9), axis=0)
    directions = directions * np.where(directions[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    return directions[:, :k], values / max(values.sum(), 1e-300)


class FactorAnalysis(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Factor analysis of an already standardised vector column.

    Spark reduces the rows to one d x d matrix (d is the number of features); the iteration works on that
    matrix alone, whatever the number of rows.
    """

    k = Param(Params._dummy(), "k", "number of factors", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, k: int | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> LinearProjection:
        return self.fit_covariance(*covariance_matrix(df, self.getInputCol()))

    def fit_covariance(self, covariance: np.ndarray, n_rows: int) -> LinearProjection:
        """Fit from an already computed covariance, to share it between several sizes."""
        matrix = posterior_matrix(*fit_factors(covariance, n_rows, self.getOrDefault(self.k)))
        return LinearProjection(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(), matrix=json.dumps(matrix.tolist())
        )


def covariance_matrix(df: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """Population covariance of a vector column and the row count; constant features give zeros."""
    got = df.select(Summarizer.metrics("variance", "count").summary(F.col(column)).alias("s")).first()["s"]
    n = int(got["count"])
    spread = np.sqrt(got["variance"].toArray() * (n - 1) / n)
    correlation = np.nan_to_num(Correlation.corr(df, column).first()[0].toArray())
    np.fill_diagonal(correlation, 1.0)
    return correlation * spread[:, None] * spread[None, :], n
