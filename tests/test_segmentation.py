import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tenora.operators.clustering import (
    as_vector,
    safe_silhouette,
    silhouettes_euclidean,
    spread_metrics,
)
from tenora.operators.kmeans import NearestCentre, Reduction, fit_many, moments, silhouettes, vectors
from tenora.operators.projection import (
    FactorAnalysis,
    LinearProjection,
    fit_factors,
    leading_directions,
    posterior_matrix,
    scaled_covariance,
)
from tenora.plans.segmentation import SearchSpace, Segmenter, principal_components


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0, 0, 0], [9, 0, 0, 3], [0, 9, 3, 0]])
    data = [
        (f"c{i:03d}", *map(float, centres[i % 3] + rng.normal(0, 0.4, 4)), float(i % 3), 7.0) for i in range(150)
    ]
    return spark.createDataFrame(data, "id string, a double, b double, c double, d double, target double, flat double")


def test_search_recovers_blobs_keeps_keys_and_survives_reload(spark, blobs, tmp_path):
    s = Segmenter(blobs, "id", "target", exclude=["flat"])
    space = SearchSpace(n_components=(2, 3), n_clusters=(2, 3), restarts=2)
    out = s.fit_predict(space)
    assert s.best_params["n_clusters"] == 3 and len(s.scores) == 2 * 2 * 2 * 3
    got = {r["id"]: (r["target"], r["Cluster"]) for r in out.collect()}
    assert len(got) == 150 and len(set(got.values())) == 3
    s.save(str(tmp_path / "model"))
    again = Segmenter(blobs, "id", "target", exclude=["flat"]).load(str(tmp_path / "model"))
    shuffled = again.predict(blobs.orderBy(F.rand(5)).repartition(5))
    assert {r["id"]: r["Cluster"] for r in shuffled.collect()} == {k: v[1] for k, v in got.items()}
    metrics = s.evaluate()
    assert metrics["silhouette"] > 0.8 and metrics["davies_bouldin"] < 0.5
    means, shares = s.explain(out)
    assert sum(r["size"] for r in means.collect()) == 150
    assert all(abs(r["pct"] - 100) < 1e-9 for r in shares.collect())


def test_many_models_agree_with_separate_fits(spark, blobs):
    features = ["a", "b", "c", "d"]
    s = Segmenter(blobs, "id", "target", features=features)
    rows = vectors(blobs.withColumn("_fold", F.col("target").cast("int")), "id", features, "_fold")
    point, parts = moments(rows, 3)
    x = np.array([[r[c] for c in features] for r in blobs.collect()])
    covariance, mean, scale, n = scaled_covariance(point, parts)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert n == 150 and np.allclose(mean, x.mean(0)) and np.allclose(covariance, np.cov(z.T, bias=True))
    reds = [Reduction(mean, scale[:, None] * np.eye(4), [(k, seed) for k in (2, 3, 5) for seed in range(42, 52)]),
            Reduction(mean, scale[:, None] * np.eye(4), [(3, 1)], held_out=0)]
    passes = fit_many(rows, reds)
    assert passes == 5 + max(max(r.passes) for r in reds) + 1  # draws, moves, and one pass for the last inertia
    scaled = s.scaling(blobs).transform(blobs).select(F.col("scaled").alias("reduced"))
    for k in (2, 3, 5):
        own = min(i for m, i in zip(reds[0].models, reds[0].inertia) if m[0] == k)
        assert own <= 1.02 * s._kmeans(scaled, k, SearchSpace(restarts=3)).summary.trainingCost
        centres = reds[0].best(k)
        assert np.isclose(own, ((z[:, None] - centres) ** 2).sum(2).min(1).sum())
    model = PipelineModel([s.scaling(blobs), NearestCentre.of(reds[0].best(3), "scaled", "Cluster")])
    found = silhouettes(rows, [(reds[0], reds[0].best(3)), (reds[1], reds[1].best(3)), (reds[0], reds[0].centres[0][:1])], [mean] * 3, [scale] * 3)
    assert np.isclose(found[0], safe_silhouette(model.transform(blobs), "scaled", "Cluster"))
    assert found[2] == -1.0  # a single cluster
    again = [Reduction(mean, scale[:, None] * np.eye(4), [(3, 43)])]
    fit_many(rows.repartition(7), again)
    assert np.allclose(again[0].centres[0], reds[0].centres[11])  # (3, 43): the same rows in any partitioning


def test_fit_of_empty_and_tiny_frames(spark):
    empty = vectors(spark.createDataFrame([], "id long, v array<double>"), "id", "v")
    red = Reduction(np.zeros(2), np.eye(2), [(2, 1)])
    fit_many(empty, [red])
    assert len(red.centres[0]) == 0
    same = vectors(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "id long, v array<double>"), "id", "v")
    red = Reduction(np.zeros(2), np.eye(2), [(2, 1)])
    fit_many(same, [red])
    assert red.centres[0].tolist() == [[1.0, 2.0]] and red.inertia == [0.0]


def test_components_point_the_same_way(blobs):
    points, ratios = principal_components(blobs, "id", ["a", "b"], 2)
    r = np.corrcoef(np.array([[p["a"], p["b"]] for p in blobs.collect()]).T)[0, 1]
    assert np.allclose(ratios, [(1 + abs(r)) / 2, (1 - abs(r)) / 2])
    directions, _ = leading_directions(np.array([[1.0, -0.5], [-0.5, 1.0]]), 2)
    assert np.allclose(directions, [[0.5**0.5, 0.5**0.5], [-(0.5**0.5), 0.5**0.5]])


def test_feature_selection(blobs):
    kept = Segmenter(blobs, "id", "target").feature_selection("variance", 0.01).features
    assert kept == ["a", "b", "c", "d"]
    assert set(Segmenter(blobs, "id", "target").feature_selection("kbest", k=2).features) == {"a", "b"}
    with pytest.raises(ValueError):
        Segmenter(blobs, "id", "target").feature_selection("other")


def test_guards(blobs):
    with pytest.raises(ValueError):
        SearchSpace(n_clusters=())
    with pytest.raises(ValueError):
        SearchSpace(reducers=("umap",))
    with pytest.raises(ValueError):
        Segmenter(blobs, "id", "target").predict()


def test_inertia_falls_as_k_grows(blobs):
    s = Segmenter(blobs, "id", "target", exclude=["flat"])
    rows = s.scaling(blobs).transform(blobs).select(F.col("scaled").alias("reduced"))
    cost = [s._kmeans(rows, k, SearchSpace(restarts=2)).summary.trainingCost for k in (2, 3, 5)]
    assert cost[0] >= cost[1] >= cost[2]


def _brute(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, c in enumerate(labels):
        same = (labels == c) & (np.arange(len(labels)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == o].mean() for o in set(labels) if o != c)
        out.append((b - a) / max(a, b))
    return np.array(out)


def test_euclidean_silhouette_equals_brute_force_for_any_block_count(spark, blobs):
    pdf = blobs.orderBy("id").toPandas()
    x, labels = pdf[["a", "b", "c", "d"]].to_numpy(), (pdf.index.to_numpy() % 4)
    df = spark.createDataFrame(
        [(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, labels))] + [(999, [50.0] * 4, 9)],
        "id int, v array<double>, k int")
    want = _brute(np.vstack([x, [50.0] * 4]), np.append(labels, 9))
    for blocks in (1, 3):
        got = silhouettes_euclidean(df, "id", "v", "k", blocks=blocks).orderBy("id").toPandas()
        assert np.allclose(got["silhouette"], want)


def test_silhouette_guard_and_spread_metrics(spark):
    one = as_vector(spark.createDataFrame([(0, [1.0, 2.0]), (0, [2.0, 1.0])], "k int, v array<double>"), "v")
    assert safe_silhouette(one, "v", "k") == -1.0
    single = as_vector(spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [9.0])], "k int, v array<double>"), "v")
    assert safe_silhouette(single, "v", "k") == -1.0
    got = spread_metrics(spark.createDataFrame(
        [(0, [0.0]), (0, [2.0]), (1, [10.0]), (1, [12.0])], "k int, v array<double>"), "v", "k").first()
    assert (got["inertia"], got["calinski_harabasz"], got["davies_bouldin"]) == (4.0, 50.0, 0.2)


def test_factor_analysis_recovers_structure(spark):
    rng = np.random.default_rng(0)
    loadings = np.array([[1.0, 0.9, 0.8, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0, 0.9, 0.8]])
    x = rng.normal(size=(3000, 2)) @ loadings + rng.normal(scale=0.3, size=(3000, 6))
    x = (x - x.mean(0)) / x.std(0)
    got, noise = fit_factors(np.cov(x.T, bias=True), len(x), 2, tol=1e-8)
    assert np.abs(got.T @ got + np.diag(noise) - np.cov(x.T, bias=True)).max() < 0.03
    df = as_vector(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v")
    model = FactorAnalysis(inputCol="v", outputCol="f", k=2).fit(df)
    f = np.array([r["f"].toArray() for r in model.transform(df).collect()])
    wanted = x @ posterior_matrix(*fit_factors(np.cov(x.T, bias=True), len(x), 2))
    assert np.allclose(np.abs(np.corrcoef(f.T, wanted.T)[:2, 2:]).max(1), 1.0, atol=1e-6)


def test_projection_round_trips_through_storage(spark, tmp_path):
    p = LinearProjection(inputCol="v", outputCol="w", matrix="[[1.0], [2.0]]")
    p.write().overwrite().save(str(tmp_path / "p"))
    df = as_vector(spark.createDataFrame([([3.0, 4.0],)], "v array<double>"), "v")
    assert LinearProjection.load(str(tmp_path / "p")).transform(df).first()["w"].toArray().tolist() == [11.0]


def test_principal_components(blobs):
    points, ratios = principal_components(blobs, "id", ["a", "b", "c", "d"])
    assert points.columns == ["id", "pc1", "pc2", "pc3"] and points.count() == 150
    assert ratios == sorted(ratios, reverse=True) and sum(ratios) <= 1.0 + 1e-9


def test_more_components_than_features_are_refused(spark, blobs):
    with pytest.raises(ValueError, match="15 components"):
        Segmenter(blobs, "id", "target", exclude=["flat"]).fit_one("pca", 15, 2)


def test_euclidean_silhouette_far_from_zero_repeated_keys_and_odd_labels(spark):
    rng = np.random.default_rng(3)
    v = 1e6 + rng.normal(size=(300, 5))
    v[10] = v[11]
    label = [None if i % 50 == 7 else int(v[i, 0] > 1e6) for i in range(300)]
    df = spark.createDataFrame([(None if i == 5 else i // 2 if i > 290 else i, v[i].tolist(), label[i]) for i in range(300)], "id long, v array<double>, k int")
    got = {(r.id, r.k): r.silhouette for r in silhouettes_euclidean(df, "id", "v", "k", blocks=4).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    sides = np.array([-1 if k is None else k for k in label])
    for i in range(0, 140):
        if label[i] is None:
            assert got[i, None] == 0.0
        elif i != 5:
            a = d[i, sides == label[i]].sum() / ((sides == label[i]).sum() - 1)
            b = d[i, sides == 1 - label[i]].mean()
            assert np.isclose(got[i, label[i]], (b - a) / max(a, b), atol=1e-7)
    assert (None, label[5]) in got


def test_euclidean_silhouette_takes_each_distance_once(monkeypatch):
    from tenora.operators import clustering as C

    x, y = np.random.default_rng(4).normal(size=(700, 3)), np.random.default_rng(5).normal(size=(900, 3))
    cells, plain = [], C._distances
    monkeypatch.setattr(C, "_distances", lambda a, b, s: cells.append(len(a) * len(b)) or plain(a, b, s))
    to_y, to_x = C._distance_sums(x, y, np.ones((700, 1)), np.ones((900, 1)))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    assert sum(cells) == 700 * 900 and np.allclose(to_y[:, 0], d.sum(1)) and np.allclose(to_x[:, 0], d.sum(0))


def test_draws_are_shared_by_models_of_a_seed_and_ties_go_to_the_first(monkeypatch):
    from tenora.operators import kmeans as K

    calls, plain = [], K._uniform
    monkeypatch.setattr(K, "_uniform", lambda ids, seed, step: calls.append(seed) or plain(ids, seed, step))
    rng = np.random.default_rng(2)
    x, ids, part = rng.normal(size=(700, 4)), np.arange(700, dtype=np.uint64), np.zeros(700, dtype=int)
    red = Reduction(np.zeros(4), np.eye(4), [(k, s) for k in (2, 3) for s in (1, 2)])
    other = Reduction(np.zeros(4), np.eye(4), list(red.models))
    for r in (red, other):
        r.centres = [np.zeros((0, 4)) for _ in r.models]
    work, _ = K._drawn([(n, m, r) for n, r in enumerate((red, other)) for m in range(4)], 0)
    drawn = work(iter([(ids, part, x)])).reshape(2, 4, 5)
    assert sorted(calls) == [1, 2] and np.array_equal(drawn[0], drawn[1]) and np.array_equal(drawn[0, 0], drawn[0, 2])
    for m, seed in enumerate((1, 2)):
        assert np.array_equal(drawn[0, m, 1:], x[np.argmin(-np.log(plain(ids, seed, 0)))])
    red.centres = [x[[3, 3]], x[[5, 3]], x[[1, 2, 1]], x[[7, 8, 9]]]
    sums = K._moved([(red, [0, 1, 2, 3])])(iter([(ids, part, x)]))
    for _, m, cost, count, total in K._unpacked(sums, [(red, [0, 1, 2, 3])]):
        far = ((x[:, None] - red.centres[m][None]) ** 2).sum(-1)
        first = far.argmin(1)
        assert np.isclose(cost, far.min(1).sum()) and count.sum() == 700
        if m != 1:
            assert count.tolist() == [float((first == j).sum()) for j in range(len(count))]
            assert np.allclose(total, [x[first == j].sum(0) for j in range(len(count))])
