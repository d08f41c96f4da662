"""Customer segmentation: standardise, reduce, k-means, with a search over the sizes."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenora.operators.aggregate import value_shares
from tenora.operators.clustering import (
    anova_f,
    explain_clusters,
    label_encode,
    safe_silhouette,
    spread_metrics,
    variances,
)
from tenora.operators.kmeans import NearestCentre, Reduction, fit_many, moments, silhouettes, spread_out, vectors
from tenora.operators.projection import LinearProjection, fit_factors, leading_directions, posterior_matrix, scaled_covariance
from tenora.operators.select import columns_of, sample_rows
from tenora.sources.sinks import load_model, save_model

CLUSTER = "Cluster"


@dataclass(frozen=True)
class SearchSpace:
    """What to try. ``score_on='raw'`` scores on the untransformed features instead of the scaled ones."""

    reducers: Sequence[str] = ("pca", "factors")
    n_components: Sequence[int] = (5, 10, 15)
    n_clusters: Sequence[int] = (5, 7, 9)
    folds: int = 3
    restarts: int = 10
    max_iter: int = 300
    seed: int = 42
    score_on: str = "scaled"

    def __post_init__(self) -> None:
        for name in ("reducers", "n_components", "n_clusters"):
            if len(getattr(self, name)) == 0:
                raise ValueError(f"{name} cannot be empty")
        if unknown := set(self.reducers) - {"pca", "factors"}:
            raise ValueError(f"unknown reducers {sorted(unknown)}")
        if self.score_on not in ("scaled", "raw"):
            raise ValueError("score_on must be 'scaled' or 'raw'")

    def candidates(self) -> list[tuple[str, int, int]]:
        return list(product(self.reducers, self.n_components, self.n_clusters))


@dataclass
class Segmenter:
    """Segments the customers of ``df``; the key stays on every row, so labels are joined, never aligned."""

    df: DataFrame
    key: str
    target: str
    exclude: Sequence[str] = ()
    sample: float = 1.0
    seed: int = 42
    features: list[str] = field(default_factory=list)
    best_model: PipelineModel | None = None
    best_params: dict | None = None
    best_score: float | None = None
    scores: list[dict] = field(default_factory=list)
    passes: int = 0

    def __post_init__(self) -> None:
        self.df = sample_rows(self.df, self.sample, self.seed, [self.key])
        if not self.features:
            out = {self.key, self.target, CLUSTER, *self.exclude}
            self.features = [c for c in columns_of(self.df, "numeric") if c not in out]

    # --- feature selection ----------------------------------------------------------------------------

    def feature_selection(self, method: str = "variance", threshold: float = 0.01, k: int = 20) -> Segmenter:
        """Keep features above a variance, or the ``k`` with the largest F value against the target."""
        if method == "variance":
            rows = variances(self.df, self.features).filter(F.col("variance") > threshold)
            keep = {r["feature"] for r in rows.select("feature").collect()}
        elif method == "kbest":
            df = self.df
            if self.target in columns_of(df, "text"):
                df = label_encode(df, self.target, self.target)
            best = anova_f(df, self.features, self.target).orderBy(F.desc_nulls_last("f_value"), "feature")
            keep = {r["feature"] for r in best.limit(min(k, len(self.features))).collect()}
        else:
            raise ValueError("method must be 'variance' or 'kbest'")
        self.features = [c for c in self.features if c in keep]
        return self

    def univariate_selector(self, k: int = 20) -> UnivariateFeatureSelector:
        """The built-in counterpart of ``kbest`` as a pipeline stage."""
        selector = UnivariateFeatureSelector(
            featuresCol="features", labelCol=self.target, outputCol="selected", selectionMode="numTopFeatures"
        )
        return selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)

    # --- fitting --------------------------------------------------------------------------------------

    def scaling(self, df: DataFrame) -> PipelineModel:
        assembler = VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="error")
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
        return PipelineModel([assembler, scaler.fit(assembler.transform(df))])

    def _reducers(self, covariance: np.ndarray, n_rows: int, space: SearchSpace) -> dict[tuple[str, int], np.ndarray]:
        """A matrix per (reducer, size), from the covariance of the scaled features."""
        sizes = list(space.n_components)
        if max(sizes) > len(self.features):
            raise ValueError(f"{max(sizes)} components asked of {len(self.features)} features")
        found: dict[tuple[str, int], np.ndarray] = {}
        if "pca" in space.reducers:
            directions, _ = leading_directions(covariance, max(sizes))
            found |= {("pca", k): directions[:, :k] for k in sizes}
        if "factors" in space.reducers:
            found |= {("factors", k): posterior_matrix(*fit_factors(covariance, n_rows, k)) for k in sizes}
        return found

    @staticmethod
    def _kmeans(reduced: DataFrame, k: int, space: SearchSpace) -> KMeansModel:
        """Lowest-inertia model over the restarts, fitted one after another by the built-in estimator."""
        best = None
        for seed in range(space.seed, space.seed + space.restarts):
            model = KMeans(
                featuresCol="reduced", predictionCol=CLUSTER, k=k, seed=seed, initMode="k-means||",
                maxIter=space.max_iter,
            ).fit(reduced)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
        return best

    def fit(self, space: SearchSpace | None = None) -> Segmenter:
        """Score every candidate on every fold and refit the best one on all rows.

        Folds come from a hash of the key: deterministic, balanced, and without ordering the rows globally. All models
        of all folds, restarts included, go through each pass over the rows together (``fit_many``).
        """
        space = space or SearchSpace()
        fold = F.pmod(F.xxhash64(F.col(self.key), F.lit(space.seed)), F.lit(space.folds)).cast("int")
        rows = spread_out(vectors(self.df.withColumn("_fold", fold), self.key, self.features, "_fold")).persist()
        try:
            point, parts = moments(rows, space.folds)
            tried, scored_shift, scored_scale = [], [], []
            for f in range(space.folds):
                others = [p for g, p in enumerate(parts) if g != f] if space.folds > 1 else parts
                reductions, shift, scale = self._reductions(point, others, space, f if space.folds > 1 else None)
                tried += [(f, name, red) for name, red in reductions.items()]
                scored_shift += [shift if space.score_on == "scaled" else 0 * shift] * len(reductions) * len(space.n_clusters)
                scored_scale += [scale if space.score_on == "scaled" else 0 * scale + 1] * len(reductions) * len(space.n_clusters)
            self.passes = fit_many(rows, [red for *_, red in tried], space.max_iter)
            judged = [(f, name, k, red) for f, name, red in tried for k in space.n_clusters]
            found = silhouettes(rows, [(red, red.best(k)) for *_, k, red in judged], scored_shift, scored_scale)
            self.scores = [
                {"reducer": name[0], "n_components": name[1], "n_clusters": k, "fold": f, "silhouette": s}
                for (f, name, k, _), s in zip(judged, found)]

            def mean_score(candidate: tuple[str, int, int]) -> float:
                got = [
                    r["silhouette"] for r in self.scores
                    if (r["reducer"], r["n_components"], r["n_clusters"]) == candidate
                ]
                return sum(got) / len(got)

            best = max(space.candidates(), key=mean_score)
            self.best_params = dict(zip(("reducer", "n_components", "n_clusters"), best))
            self.best_score = mean_score(best)
            self.best_model = self._refit(rows, best, space, (point, parts))
        finally:
            rows.unpersist()
        return self

    def _reductions(
        self, point: np.ndarray, parts: list, space: SearchSpace, held_out: int | None = None
    ) -> tuple[dict[tuple[str, int], Reduction], np.ndarray, np.ndarray]:
        """(reductions with their models, mean, one over deviation) fitted on the rows of the given moments."""
        covariance, mean, scale, n = scaled_covariance(point, parts)
        models = [(k, seed) for k in space.n_clusters for seed in range(space.seed, space.seed + space.restarts)]
        matrices = self._reducers(covariance, n, space)
        return {
            name: Reduction(mean, scale[:, None] * matrix, list(models), held_out, float((matrix * (covariance @ matrix)).sum(0).mean()))
            for name, matrix in matrices.items()
        }, mean, scale

    def _refit(self, rows: DataFrame, candidate: tuple[str, int, int], space: SearchSpace, known: tuple) -> PipelineModel:
        reducer, size, k = candidate
        narrowed = replace(space, reducers=(reducer,), n_components=(size,), n_clusters=(k,))
        reductions, mean, scale = self._reductions(*known, narrowed)
        red = reductions[reducer, size]
        fit_many(rows, [red], space.max_iter)
        matrix = self._reducers(*scaled_covariance(*known)[::3], narrowed)[reducer, size]
        return PipelineModel([
            *self.scaling(self.df).stages,
            LinearProjection(inputCol="scaled", outputCol="reduced", matrix=json.dumps(matrix.tolist())),
            NearestCentre.of(red.best(k), "reduced", CLUSTER),
        ])

    def fit_one(self, reducer: str, n_components: int, n_clusters: int, space: SearchSpace | None = None) -> Segmenter:
        """Fit one chosen candidate on all rows, without a search."""
        self.best_params = {"reducer": reducer, "n_components": n_components, "n_clusters": n_clusters}
        rows = spread_out(vectors(self.df, self.key, self.features)).persist()
        try:
            self.best_model = self._refit(rows, (reducer, n_components, n_clusters), space or SearchSpace(), moments(rows, 1))
        finally:
            rows.unpersist()
        return self

    # --- use ------------------------------------------------------------------------------------------

    def _model(self) -> PipelineModel:
        if self.best_model is None:
            raise ValueError("the model is not trained: call fit() or load() first")
        return self.best_model

    def predict(self, df: DataFrame | None = None) -> DataFrame:
        """Rows with their cluster; the intermediate vectors are dropped."""
        rows = self.df if df is None else df
        return self._model().transform(rows.drop(CLUSTER)).select(
            *[c for c in rows.columns if c != CLUSTER], F.col(CLUSTER).cast("int").alias(CLUSTER)
        )

    def fit_predict(self, space: SearchSpace | None = None) -> DataFrame:
        return self.fit(space).predict()

    def evaluate(self, features: str = "scaled") -> dict[str, float]:
        """Silhouette, Calinski-Harabasz and Davies-Bouldin on the chosen features; inertia of the model."""
        labelled = self._model().transform(self.df.drop(CLUSTER)).select("features", "scaled", "reduced", CLUSTER)
        spread = spread_metrics(labelled, features, CLUSTER).first()
        return {
            "silhouette": safe_silhouette(labelled, features, CLUSTER),
            "calinski_harabasz": spread["calinski_harabasz"],
            "davies_bouldin": spread["davies_bouldin"],
            "inertia": spread_metrics(labelled, "reduced", CLUSTER).first()["inertia"],
        }

    def explain(self, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(size, share and feature means per cluster; shares of the target's values per cluster)."""
        return explain_clusters(labelled, CLUSTER, self.features), value_shares(labelled, self.target, [CLUSTER])

    def save(self, path: str) -> None:
        save_model(self._model(), path)

    def load(self, path: str) -> Segmenter:
        self.best_model = load_model(self.df.sparkSession, path)
        return self


def principal_components(df: DataFrame, key: str, features: Sequence[str], k: int = 3) -> tuple[DataFrame, list[float]]:
    """(key, pc1.., Cluster when present) of the standardised features, and the explained variance ratios.

    Each component points so that its weight of largest size, the first of equals, is positive.
    """
    rows = vectors(df, key, features)
    covariance, mean, scale, _ = scaled_covariance(*moments(rows, 1))
    directions, ratios = leading_directions(covariance, k)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    centred = vector_to_array("_features")
    shifted = F.zip_with(centred, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    matrix = scale[:, None] * directions
    cells = [F.aggregate(F.zip_with(shifted, F.array(*[F.lit(float(w)) for w in matrix[:, i]]), lambda x, w: x * w),
                         F.lit(0.0), lambda s, x: s + x).alias(f"pc{i + 1}") for i in range(k)]
    shown = [c for c in (CLUSTER,) if c in df.columns]
    return assembler.transform(df).select(key, *cells, *shown), [float(x) for x in ratios[:k]]
