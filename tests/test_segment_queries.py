"""The registered segmentations run the operator's whole search over whole embeddings."""

import pytest
from pyspark.sql import functions as F

from tenora.catalog import load
from tenora.catalog.segments import _embedding_columns
from tenora.plans.segmentation import SearchSpace, Segmenter

SF = "/root/testdata/sf0.001"


def test_queries_search_the_default_space(spark, monkeypatch):
    spaces = []

    def fit(self, space=None):
        spaces.append(space or SearchSpace())
        self.scores = [{"reducer": "pca", "n_components": 5, "n_clusters": 5, "fold": 0, "silhouette": 0.0}]
        return self

    monkeypatch.setattr(Segmenter, "fit", fit)
    monkeypatch.setattr(Segmenter, "predict", lambda self: self.df.withColumn("Cluster", F.lit(0)))
    for name in ("segmented_embeddings", "segmentation_search"):
        load()[name].build(spark, SF)
    assert spaces == [SearchSpace(), SearchSpace()] and spaces[0].restarts == 10


def test_embeddings_are_taken_whole(spark, tmp_path):
    for name, sizes in (("same", (70, 70)), ("mixed", (70, 60))):
        rows = [(i, "a", [float(i)] * n) for i, n in enumerate(sizes)]
        spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    assert len(_embedding_columns(spark, f"{tmp_path}/same").columns) == 72
    with pytest.raises(ValueError, match="60 to 70"):
        _embedding_columns(spark, f"{tmp_path}/mixed")


def test_silhouette_blocks_follow_the_rows(spark, monkeypatch):
    from tenora.catalog import segments

    asked = []
    monkeypatch.setattr(segments.C, "silhouettes_euclidean", lambda *args, **kwargs: asked.append(kwargs) or args[0])
    load()["silhouette_euclidean"].build(spark, SF)
    assert asked == [{}]


def test_queries_run_the_whole_search(spark):
    got = load()["segmentation_search"].build(spark, SF)
    cells = {(r.reducer, r.n_components, r.n_clusters, r.fold) for r in got.collect()}
    assert len(cells) == got.count() == 2 * 3 * 3 * 3
    assert all(-1.0 <= r.silhouette <= 1.0 for r in got.collect())
    labelled = load()["segmented_embeddings"].build(spark, SF)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert labelled.count() == rows.count() and labelled.select("Cluster").distinct().count() in (5, 7, 9)
