"""Cluster quality and explanation, computed from labelled rows by distributed aggregation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenora.functions.rates import mean_of, share_of
from tenora.operators.aggregate import non_null
from tenora.operators.keys import numbered
from tenora.operators.lookup import join_groups, to_long


def as_vector(df: DataFrame, column: str) -> DataFrame:
    """Array column to an ML vector column (a vector stays as it is)."""
    if isinstance(df.schema[column].dataType, VectorUDT):
        return df
    return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def silhouette_possible(df: DataFrame, cluster: str) -> bool:
    """At least two clusters and no cluster with a single row."""
    got = cluster_sizes(df, cluster).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("smallest")).first()
    return got["k"] > 1 and got["smallest"] > 1


def safe_silhouette(df: DataFrame, features: str, cluster: str) -> float:
    """Mean silhouette with squared Euclidean distance in one linear pass; -1 where it is undefined."""
    if not silhouette_possible(df, cluster):
        return -1.0
    scorer = ClusteringEvaluator(
        featuresCol=features, predictionCol=cluster, metricName="silhouette", distanceMeasure="squaredEuclidean"
    )
    return scorer.evaluate(df.withColumn(cluster, F.col(cluster).cast("double")))


#: Bytes of one block of rows, as doubles, and the rows of two blocks whose distances are held at once.
BLOCK_BYTES, TILE = 1 << 25, (256, 2048)
#: Squared distances below this part of the squared norms are added up again from the differences, as the product cancels.
CANCELS = 1e-5


def _distances(x: np.ndarray, y: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows by one matrix product of the shifted rows; those that would lose digits by differences."""
    u, v = x - shift, y - shift
    norms = (u * u).sum(1)[:, None] + (v * v).sum(1)
    squared = u @ (-2.0 * v.T)
    squared += norms
    rows, columns = np.nonzero(~(squared > CANCELS * norms))
    for at in range(0, len(rows), TILE[1]):
        i, j = rows[at:at + TILE[1]], columns[at:at + TILE[1]]
        squared[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return np.sqrt(squared, out=squared)


def _distance_sums(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the distances of each row of ``x`` to the clusters of ``y``, and the other way, from one-hot members."""
    to_y, to_x = np.zeros((len(x), of_y.shape[1])), np.zeros((len(y), of_x.shape[1]))
    whole = x[np.isfinite(x).all(1)]
    shift = whole.mean(0) if len(whole) else np.zeros(x.shape[1])
    for i in range(0, len(x), TILE[0]):
        for j in range(0, len(y), TILE[1]):
            found = _distances(x[i:i + TILE[0]], y[j:j + TILE[1]], shift)
            to_y[i:i + TILE[0]] += found @ of_y[j:j + TILE[1]]
            to_x[j:j + TILE[1]] += found.T @ of_x[i:i + TILE[0]]
    return to_y, to_x


def _members(labels: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The clusters, and a column for each with one where a row is its member."""
    coded = labels.combine_chunks().dictionary_encode("encode")
    member = np.zeros((len(coded), len(coded.dictionary)))
    member[np.arange(len(coded)), coded.indices.to_numpy()] = 1.0
    return coded.dictionary, member


def silhouettes_euclidean(
    df: DataFrame, key: str, features: str, cluster: str, blocks: int | None = None, block_rows: int | None = None
) -> DataFrame:
    """(key, cluster, silhouette) with plain Euclidean distance, for data of any size.

    The exact value needs every distance, so the work is quadratic; it is cut into pairs of blocks that fit a task, each
    distance once for both its rows. A task adds up the distances of the rows of a block to each cluster of the other and
    emits those sums only, never the pairs. Prefer :func:`safe_silhouette` on large data.
    """
    vectors = as_vector(df, features)
    if blocks is None:
        n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array(features)))).first()
        most = block_rows or max(1, BLOCK_BYTES // (8 * max(1, width or 1)))
        cores = df.sparkSession.sparkContext.defaultParallelism
        blocks = max(1, -(-n // most), min(-(-n // 256), math.isqrt(4 * cores)))  # pairs of blocks enough for the cores
    rows = vectors.select(
        F.col(key).alias("id"),
        F.col(cluster).cast("int").alias("cluster"),
        vector_to_array(features).alias("x"),
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block"),
    )
    kind = df.schema[key].dataType
    names = ["id", "cluster", "to", "total", "n"]

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            own = a["low"][0].as_py() == a["high"][0].as_py()
            x, y = (np.stack(t["x"].to_numpy()) for t in (a, b))
            (seen_a, of_a), (seen_b, of_b) = _members(a["cluster"]), _members(b["cluster"])
            to_b, to_a = _distance_sums(x, y, of_a, of_b)
            for rows, total, seen, member in ((a, to_b, seen_b, of_b), (b, to_a, seen_a, of_a))[:1 if own else 2]:
                at, k = np.repeat(np.arange(len(total)), len(seen)), len(seen)
                found.append(pa.table([
                    rows["id"].take(at), rows["cluster"].take(at), seen.take(np.tile(np.arange(k), len(total))),
                    pa.array(total.ravel()), pa.array(np.tile(member.sum(0).astype("int64"), len(total)))], names=names))
        return pa.concat_tables(found) if found else pa.table(
            [a["id"].slice(0, 0), a["cluster"].slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64()), pa.array([], pa.int64())], names=names)

    left = rows.withColumn("low", F.col("block")).withColumn("high", F.explode(F.sequence("block", F.lit(blocks - 1)))).drop("block")
    right = rows.withColumn("high", F.col("block")).withColumn("low", F.explode(F.sequence(F.lit(0), "block"))).drop("block")
    partial = left.groupBy("low", "high").cogroup(right.groupBy("low", "high")).applyInArrow(
        sums, f"id {kind.simpleString()}, cluster int, to int, total double, n bigint"
    )
    per_cluster = partial.groupBy("id", "cluster", "to").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    own = F.col("to") == F.col("cluster")
    scored = per_cluster.groupBy("id", "cluster").agg(
        F.max(F.when(own, F.try_divide(F.col("total"), (F.col("n") - 1).cast("double")))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    value = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return scored.select(F.col("id").alias(key), F.col("cluster").alias(cluster), value.alias("silhouette"))


def spread_metrics(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """One row: rows, clusters, inertia, Calinski-Harabasz and Davies-Bouldin of the given labels.

    Centroids are a partial-aggregated mean per cluster; distances to them are a second aggregation. Only
    one row per cluster remains for the final formula.
    """
    rows = as_vector(df, features).select(F.col(cluster).alias("c"), F.col(features).alias("v"))
    centres = rows.groupBy("c").agg(Summarizer.mean(F.col("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    whole = vector_to_array(rows.select(Summarizer.mean(F.col("v"))).scalar())
    centres = centres.select("c", "n", vector_to_array("m").alias("m"))
    distance = squared_distance(vector_to_array("v"), F.col("m"))
    per_cluster = (
        rows.join(centres, "c")  # measured size decides how
        .withColumn("d2", distance)
        .groupBy("c", "n", "m")
        .agg(F.sum("d2").alias("within"), F.avg(F.sqrt("d2")).alias("scatter"))
        .withColumn("whole", whole)
        .withColumn("between", F.col("n") * squared_distance(F.col("m"), F.col("whole")))
    )
    cell = F.struct("c", "m", "scatter")
    totals = per_cluster.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("clusters"),
        F.sum("within").alias("inertia"),
        F.sum("between").alias("between"),
        F.collect_list(cell).alias("cs"),
    )

    def worst(a: Column) -> Column:
        others = F.filter("cs", lambda b: b["c"] != a["c"])
        return F.array_max(F.transform(others, lambda b: F.try_divide(
            a["scatter"] + b["scatter"], F.sqrt(squared_distance(a["m"], b["m"]))
        )))

    mean_worst = F.aggregate(F.transform("cs", worst), F.lit(0.0), lambda s, x: s + x) / F.col("clusters")
    return totals.select(
        "rows", "clusters", "inertia",
        F.try_divide(
            F.col("between") * (F.col("rows") - F.col("clusters")), F.col("inertia") * (F.col("clusters") - 1)
        ).alias("calinski_harabasz"),
        mean_worst.alias("davies_bouldin"),
    )


def explain_clusters(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Size, share and feature means of each cluster."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return non_null(df, [cluster]).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), *[mean_of(c).alias(f"avg_{c}") for c in features]
    ).withColumn("size_percent", share_of(F.col("size"), total))


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, f_value): between-label over within-label variance of each feature."""
    long = to_long(non_null(df, [label]), features, [label])
    # Shift by the overall mean first: sums of squares of far-off values would lose their digits.
    means = long.groupBy("column").agg(F.avg("value").alias("m"))
    v = F.col("value") - F.col("m")
    per_label = join_groups(long, means, ["column"]).groupBy("column", label).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")
    )
    sums = per_label.groupBy("column").agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("g"),
    )
    between = F.col("g") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("q") - F.col("g")
    return sums.select(
        F.col("column").alias("feature"),
        F.try_divide(between * (F.col("n") - F.col("k")), within * (F.col("k") - 1)).alias("f_value"),
    )


def variances(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, variance), population form."""
    return to_long(df, features).groupBy(F.col("column").alias("feature")).agg(F.var_pop("value").alias("variance"))


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Alphabetical ordinal of a text category, from 0; null stays null. Any number of categories."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = numbered(df.sparkSession, found, [column], "_code", start=0, unique=True)
    coded = df.join(codes.withColumnRenamed(column, "_category"), F.col(column) == F.col("_category"), "left")
    return coded.select(*[c for c in df.columns if c != name], F.col("_code").cast("int").alias(name))
