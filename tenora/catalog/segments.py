"""Feature preparation, cluster quality and segmentation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tenora.catalog.basics import FLOATS, NUMERIC
from tenora.catalog.profile_sql import with_profile, with_raw
from tenora.catalog.registry import register
from tenora.operators import clustering as C
from tenora.operators.kmeans import moments, vectors
from tenora.operators.projection import FactorAnalysis, fit_factors, implied_covariance, scaled_covariance
from tenora.operators.select import encode_binary, standardize
from tenora.plans.profile import FLAG_COLUMNS, profile, raw_customers, read_table
from tenora.plans.segmentation import SearchSpace, Segmenter, principal_components

#: Every numeric column but the key, the target, its label and the cluster.
FEATURES = ["Zip_Code", *[c for c in NUMERIC if c not in ("Churn_Score", "Churn_Label", "Cluster")]]
#: Columns of an empty embeddings table.
DIMENSIONS = 64


def _unioned(parts) -> str:
    return " UNION ALL ".join(parts)


@register("binary_encoding", "M1 F8 Q3", with_raw(
    "SELECT Customer_ID, " + ", ".join(
        f"CAST({c} IN ('Yes', 'Male') AS INT) AS {c}" for c in ["Gender", *FLAG_COLUMNS]) + " FROM raw_customers"))
def _(spark, sf):
    names = ["Gender", *FLAG_COLUMNS]
    raw = raw_customers(profile(spark, sf)).select("Customer_ID", *names)
    return encode_binary(raw, names)


@register("standardised_floats", "M2", with_profile(
    ", s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FLOATS) + " FROM profile) "
    "SELECT Customer_ID, " + ", ".join(
        f"round(coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0), 6) AS {c}" for c in FLOATS) + " FROM profile, s"))
def _(spark, sf):
    return standardize(profile(spark, sf).select("Customer_ID", *FLOATS), FLOATS)


@register("label_encoding", "M4", (
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS priority_code FROM orders"))
def _(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return C.label_encode(orders, "o_orderpriority", "priority_code").drop("o_orderpriority")


def _digits(v: str) -> tuple[str, str]:
    """Leading digits and power of ten, the same however the sum was ordered and however large it is."""
    return f"round({v} / pow(10, floor(log10({v}))), 6) AS digits", f"CAST(floor(log10({v})) AS INT) AS power"


@register("feature_variances", "M5", with_profile(_unioned(
    f"SELECT '{c}' AS feature, {", ".join(_digits("v"))} FROM (SELECT var_pop({c}) AS v FROM profile) WHERE v > 0.01" for c in FEATURES)))
def _(spark, sf):
    found = C.variances(profile(spark, sf), FEATURES).filter(F.col("variance") > 0.01)
    return found.selectExpr("feature", *_digits("variance"))


def _anova_sql(columns, label) -> str:
    return with_profile(_unioned(
        f"SELECT '{c}' AS feature, round((sum(n * (m - g) * (m - g)) / nullif(count(*) - 1, 0)) / "
        f"nullif(sum(w) / (sum(n) - count(*)), 0), 6) AS f_value FROM ("
        f"SELECT {label}, count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS w, "
        f"(SELECT avg({c}) FROM profile) AS g FROM profile GROUP BY {label})" for c in columns))


@register("anova_f_values", "M6", _anova_sql(FEATURES, "Customer_Status"))
def _(spark, sf):
    return C.anova_f(profile(spark, sf), FEATURES, "Customer_Status")


_LONG = (
    "x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), "
    "m AS (SELECT label, d, avg(v) AS m FROM x GROUP BY label, d), g AS (SELECT d, avg(v) AS g FROM x GROUP BY d), "
    "s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), "
    "r AS (SELECT x.vec_id, x.label, sum((v - m) * (v - m)) AS d2 FROM x JOIN m USING (label, d) GROUP BY x.vec_id, x.label), "
    "c AS (SELECT label, sum(d2) AS within, avg(sqrt(d2)) AS scatter FROM r GROUP BY label), "
    "b AS (SELECT label, sum((m - g) * (m - g)) AS b2 FROM m JOIN g USING (d) GROUP BY label), "
    "p AS (SELECT m1.label AS i, m2.label AS j, sqrt(sum((m1.m - m2.m) * (m1.m - m2.m))) AS dist "
    "FROM m m1 JOIN m m2 ON m1.d = m2.d AND m1.label <> m2.label GROUP BY m1.label, m2.label), "
    "w AS (SELECT i, max((ci.scatter + cj.scatter) / dist) AS worst FROM p JOIN c ci ON ci.label = i "
    "JOIN c cj ON cj.label = j GROUP BY i)"
)


@register("cluster_spread_metrics", "M14", (
    f"WITH {_LONG} SELECT (SELECT count(*) FROM embeddings) AS rows, (SELECT count(*) FROM s) AS clusters, "
    "round((SELECT sum(within) FROM c), 6) AS inertia, "
    "round((SELECT sum(n * b2) FROM b JOIN s USING (label)) * ((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM s)) / "
    "((SELECT sum(within) FROM c) * ((SELECT count(*) FROM s) - 1)), 6) AS calinski_harabasz, "
    "round((SELECT avg(worst) FROM w), 6) AS davies_bouldin"))
def _(spark, sf):
    return C.spread_metrics(read_table(spark, sf, "embeddings"), "embedding", "label")


def _silhouette_sql(distance: str) -> str:
    return (
        "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
        f"t AS (SELECT a.vec_id, a.label, b.label AS other, sum({distance}) AS total, count(*) AS n FROM e a, e b "
        "GROUP BY a.vec_id, a.label, b.label), "
        "q AS (SELECT vec_id, label, max(CASE WHEN other = label THEN total / nullif(n - 1, 0) END) AS a, "
        "min(CASE WHEN other <> label THEN total / n END) AS b FROM t GROUP BY vec_id, label), "
        "z AS (SELECT vec_id, label, CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM q)"
    )


@register("silhouette_euclidean", "M12", (
    f"WITH {_silhouette_sql('list_distance(a.v, b.v)')} SELECT vec_id, label, round(s, 6) AS silhouette FROM z"))
def _(spark, sf):
    return C.silhouettes_euclidean(read_table(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@register("silhouette_squared", "M12", (
    f"WITH {_silhouette_sql('list_distance(a.v, b.v) * list_distance(a.v, b.v)')} "
    "SELECT round(avg(s), 6) AS silhouette FROM z"))
def _(spark, sf):
    rows = C.as_vector(read_table(spark, sf, "embeddings"), "embedding")
    return spark.createDataFrame([(C.safe_silhouette(rows, "embedding", "label"),)], "silhouette double")


@register("clusters_explained", "M15", with_profile(
    "SELECT Cluster, count(*) AS size, " + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in FEATURES) +
    ", round(100.0 * count(*) / (SELECT count(*) FROM profile), 6) AS size_percent FROM profile GROUP BY Cluster"))
def _(spark, sf):
    return C.explain_clusters(profile(spark, sf), "Cluster", FEATURES)


@register("clusters_explained_target", "M15 A12", with_profile(
    "SELECT Cluster, Churn_Score, count(*) AS n, "
    "round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY Cluster), 6) AS pct FROM profile GROUP BY Cluster, Churn_Score"))
def _(spark, sf):
    wide = profile(spark, sf)
    return Segmenter(wide, "Customer_ID", "Churn_Score", features=FEATURES).explain(wide)[1]


def _embedding_columns(spark, sf):
    """One column a dimension, as many as the vectors have; vectors of different lengths raise."""
    rows = read_table(spark, sf, "embeddings")
    least, most = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if least != most:
        raise ValueError(f"embeddings have {least} to {most} dimensions")
    size = DIMENSIONS if most is None else most
    return rows.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)])


@register("factor_projection", "M7 M9")
def _(spark, sf):
    segmenter = Segmenter(_embedding_columns(spark, sf), "vec_id", "label")
    scaled = segmenter.scaling(segmenter.df).transform(segmenter.df).select("vec_id", "scaled")
    model = FactorAnalysis(inputCol="scaled", outputCol="reduced", k=5).fit(scaled)
    cells = vector_to_array("reduced")
    return model.transform(scaled).select("vec_id", *[cells[i].alias(f"f{i + 1}") for i in range(5)])


@register("principal_components", "M8 M16 V5")
def _(spark, sf):
    return principal_components(profile(spark, sf), "Customer_ID", FEATURES)[0]


def _z_sql(columns) -> str:
    """Standardised by the sample's deviation, a constant column as 0."""
    return ("s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in columns) + " FROM profile), "
            "z AS (SELECT Customer_ID, " + ", ".join(f"coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0) AS {c}" for c in columns) + " FROM profile, s)")


@register("scaled_features", "M7", with_profile(
    f", {_z_sql(FEATURES)} SELECT Customer_ID, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM z"))
def _(spark, sf):
    segmenter = Segmenter(profile(spark, sf), "Customer_ID", "Churn_Score", exclude=["Churn_Label"])
    cells = vector_to_array("scaled")
    rows = segmenter.scaling(segmenter.df).transform(segmenter.df)
    return rows.select("Customer_ID", *[cells[segmenter.features.index(c)].alias(c) for c in FEATURES])


@register("component_norms", "M8 M16", with_profile(
    f", {_z_sql(FEATURES)} SELECT Customer_ID, round(" + " + ".join(f"{c} * {c}" for c in FEATURES) + ", 6) AS norm FROM z"))
def _(spark, sf):
    k = len(FEATURES)
    points, _ = principal_components(profile(spark, sf), "Customer_ID", FEATURES, k)
    squares = [F.col(f"pc{i + 1}") * F.col(f"pc{i + 1}") for i in range(k)]
    return points.select("Customer_ID", sum(squares[1:], squares[0]).alias("norm"))


@register("component_variances", "M16", with_profile(
    ", r AS (SELECT abs(corr(Tenure_in_Months, CLTV)) AS r FROM profile) SELECT 1 AS component, round((1 + r) / 2, 6) AS ratio FROM r "
    "UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM r"))
def _(spark, sf):
    _, ratios = principal_components(profile(spark, sf), "Customer_ID", ["Tenure_in_Months", "CLTV"], 2)
    return spark.createDataFrame(list(enumerate(ratios, 1)), "component int, ratio double")


@register("factor_variances", "M9", (
    "SELECT CAST(d AS INT) AS dimension, 1.0::DOUBLE AS variance FROM (SELECT unnest(range(max(len(embedding)))) AS d FROM embeddings)"))
def _(spark, sf):
    segmenter = Segmenter(_embedding_columns(spark, sf), "vec_id", "label")
    covariance, _, _, n = scaled_covariance(*moments(vectors(segmenter.df, "vec_id", segmenter.features), 1))
    implied = implied_covariance(*fit_factors(covariance, n, 5, tol=1e-9))
    ratio = [float(x) for x in implied.diagonal() / covariance.diagonal()]
    found = spark.createDataFrame(list(enumerate(ratio)), "dimension int, variance double")
    return found.withColumn("variance", F.round("variance", 3))


@register("segmented_embeddings", "M3 M7 M8 M10 M13")
def _(spark, sf):
    segmenter = Segmenter(_embedding_columns(spark, sf), "vec_id", "label")
    return segmenter.fit(SearchSpace()).predict().select("vec_id", "label", "Cluster")


@register("segmentation_search", "M11 M17 M18")
def _(spark, sf):
    segmenter = Segmenter(profile(spark, sf), "Customer_ID", "Churn_Score", exclude=["Churn_Label"])
    segmenter.fit(SearchSpace())
    return spark.createDataFrame(segmenter.scores, "reducer string, n_components int, n_clusters int, fold int, silhouette double")
