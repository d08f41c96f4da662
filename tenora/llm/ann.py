"""Approximate nearest neighbours by learned partitions, largest inner product first.

Fitting, on a bounded sample: the neighbour graph of the sample is cut into parts of equal size that keep neighbours
together, and a small classifier learns the part of a vector, given the parts of its neighbours. Indexing: every
vector goes to its most probable part. Searching: a query goes to its most probable parts, as many as it took on the
sample to find the wanted share of true neighbours, and all vectors there are ranked exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tenora.llm.common import hash32
from tenora.session import stored

NEAREST = 20
#: Vectors the model is fitted on, about; the choice follows a hash of the vector.
SAMPLE = 4096
#: Vectors per part that the number of parts aims at, and the most parts.
PART_ROWS, MAX_PARTS = 1024, 256
#: Share of true neighbours to find on the sample.
WANTED_RECALL = 0.95
#: Most queries and most vectors that meet in one task, and vectors compared at once.
QUERY_ROWS, INDEX_ROWS, BLOCK = 1024, 65_536, 2048
#: Neighbours per vector in the graph, rounds of moving vectors between parts, steps of the classifier.
DEGREE, ROUNDS, STEPS = 16, 20, 300
#: What summing in another order can change an inner product by, relative to the lengths.
_SLACK = 1e-9


def graph(points: np.ndarray, degree: int) -> np.ndarray:
    """Positions of the ``degree`` nearest other points of each point, nearest first."""
    out = np.empty((len(points), min(degree, len(points) - 1)), dtype=np.int64)
    for at in range(0, len(points), BLOCK):
        near = points[at : at + BLOCK] @ points.T
        near[np.arange(len(near)), at + np.arange(len(near))] = -np.inf
        out[at : at + BLOCK] = np.argsort(-near, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def _fill(score: np.ndarray, room: int) -> np.ndarray:
    """Give each row its best column that still has room, rows with the most to lose first."""
    ranked = np.argsort(-score, axis=1, kind="stable")
    top = np.take_along_axis(score, ranked[:, :2], axis=1)
    part, left = np.empty(len(score), dtype=np.int64), np.full(score.shape[1], room)
    for i in np.argsort(top[:, -1] - top[:, 0], kind="stable"):
        part[i] = next(p for p in ranked[i] if left[p])
        left[part[i]] -= 1
    return part


def balanced_parts(points: np.ndarray, near: np.ndarray, parts: int, seed: int = 42) -> np.ndarray:
    """A part per point, none above a twentieth over the mean, with few neighbours in different parts.

    Parts grow around spread centres, then points move, round after round, to where most of their neighbours are.
    """
    rng, room = np.random.default_rng(seed), math.ceil(1.05 * len(points) / parts)
    centres = points[rng.choice(len(points), parts, replace=False)]
    for _ in range(8):
        part = _fill(points @ centres.T, room)
        centres = np.stack([points[part == p].mean(axis=0) if (part == p).any() else centres[p] for p in range(parts)])
    for _ in range(ROUNDS):
        votes = np.zeros((len(points), parts))
        for column in near.T:
            votes[np.arange(len(points)), part[column]] += 1.0
            np.add.at(votes, (column, part), 1.0)
        votes[np.arange(len(points)), part] += 0.5
        moved = _fill(votes, room)
        if (moved == part).all():
            break
        part = moved
    return part


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # dimensions + 1 rows, a column per part
    probes: int

    def scores(self, points: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(points, axis=1, keepdims=True)
        unit = np.divide(points, length, out=np.zeros_like(points), where=length > 0)
        return unit @ self.weights[:-1] + self.weights[-1]


def fit(points: np.ndarray, parts: int, wanted: float = WANTED_RECALL) -> Model:
    """Cut the neighbour graph, train the classifier on the neighbours' parts, and choose the number of probes."""
    n, d = points.shape
    parts = max(1, min(parts, n // 4))
    if parts == 1:
        return Model(np.zeros((d + 1, 1)), 1)
    near = graph(points, DEGREE)
    part = balanced_parts(points, near, parts)
    goal = np.zeros((n, parts))
    for column in near.T:
        goal[np.arange(n), part[column]] += 1
    goal[np.arange(n), part] += near.shape[1] / 2
    goal /= goal.sum(axis=1, keepdims=True)
    length = np.linalg.norm(points, axis=1, keepdims=True)
    x = np.hstack([points / length, np.ones((n, 1))])
    weights, mean, square = np.zeros((d + 1, parts)), 0.0, 0.0
    for step in range(1, STEPS + 1):  # softmax regression by Adam
        logits = x @ weights
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        slope = x.T @ (e / e.sum(axis=1, keepdims=True) - goal) / n + 1e-5 * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights = weights - 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    model = Model(weights, parts)
    score = model.scores(points)
    own, order = score.argmax(axis=1), np.argsort(-score, axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each part in a query's order
    needed = place[np.arange(n)[:, None], own[near]]
    recall = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    return Model(weights, int(np.argmax(recall >= min(wanted, recall[-1]))) + 1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) with vectors of float or double, without null ids and vectors null, zero or holding null, NaN or infinity."""
    kind = vectors.schema[vector].dataType.simpleString()
    cells = F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(key).alias("vec_id"), cells.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(~bad & F.exists("v", lambda x: x != 0))


def _matrix(column, width: int) -> np.ndarray:
    """A matrix of list cells; shorter vectors are padded with zeros."""
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def train(spark: SparkSession, rows: DataFrame, total: int, width: int, sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` distinct vectors in one task; the model (width x parts numbers) comes to the driver."""
    parts = min(MAX_PARTS, math.ceil(total / PART_ROWS))
    chance = hash32(F.lit("ann"), F.xxhash64("v")) / float(2**32)
    chosen = rows.filter(chance < min(1.0, sample / max(1, total))).select("v").distinct()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [v for batch in batches for v in batch.column(0).to_pylist()]
        model = fit(_matrix(got, width), parts) if got else Model(np.zeros((width + 1, 1)), 1)
        yield pa.RecordBatch.from_arrays([
            pa.array(model.weights.ravel()), pa.array([model.probes] * model.weights.size, pa.int32())], ["w", "probes"])

    found = chosen.repartition(1).sortWithinPartitions("v").mapInArrow(learn, "w double, probes int").collect()
    if not found:
        return Model(np.zeros((width + 1, 1)), 1)
    return Model(np.array([r[0] for r in found]).reshape(width + 1, -1), found[0][1])


def search(
    spark: SparkSession, vectors: DataFrame, queries, key: str = "vec_id", vector: str = "embedding",
    nearest: int = NEAREST, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every query row, ties to the smaller id.

    ``queries`` is a condition on ``vec_id``. Candidates are all rows but those with the query's own id. Rows without
    an id and vectors that are null, zero or hold null or non-finite numbers take no part; shorter vectors count as padded with zeros. Copies of a
    vector under other ids are all candidates. Rows that repeat an id are one candidate each; a repeated query is asked
    once, with its smallest vector.

    A part with more vectors than the mean is cut into blocks of about the mean, and its queries into blocks too, so a
    task holds one block of each, however many vectors are alike. A query first meets its most probable part; the last
    score it needs from there bounds what its other parts return. A query whose parts hold fewer than ``nearest``
    candidates asks all other parts too, so it gets as many as there are.
    """
    rows = stored(spark, usable(vectors, key, vector), "vectors")
    total, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    model = train(spark, rows, total, width, sample)
    parts, probes = model.weights.shape[1], model.probes

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                best = model.scores(_matrix(part.column(1).to_pylist(), width))
                order = np.argsort(-best, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(list(order), pa.list_(pa.int32()))], ["vec_id", "v", "parts"])

    kind, cells = rows.schema["vec_id"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
    routed = stored(spark, rows.mapInArrow(assign, f"vec_id {kind}, v {cells}, parts array<int>"), "routed")
    index = routed.select("vec_id", "v", F.get("parts", F.lit(0)).alias("part"))
    asked = routed.filter(queries).groupBy("vec_id").agg(F.min(F.struct("v", "parts")).alias("q")).select(
        "vec_id", "q.v", F.posexplode("q.parts").alias("probe", "part"))
    mean = min(INDEX_ROWS, max(1, math.ceil(total / parts)))
    own, of_index = hash32(F.lit("block"), F.col("vec_id")), _blocks(index, mean)

    def count_of(numbers: dict[int, int]):
        return F.element_at(F.array(*[F.lit(numbers.get(p, 1)) for p in range(parts)]), F.col("part") + 1)

    def best(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(have) and len(ask):
            order = np.argsort(have["vec_id"].to_numpy(), kind="stable")
            ids, points = have["vec_id"].to_numpy()[order], _matrix(have["v"].to_numpy()[order], width)
            for at in range(0, len(ask), 256):
                some = ask.iloc[at : at + 256]
                out += _top(some["vec_id"].to_numpy(), _matrix(some["v"].to_numpy(), width), some["bound"].to_numpy(),
                            ids, points, nearest)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    def met(ask: DataFrame) -> DataFrame:
        """Every query with its part's vectors: each vector meets all blocks of queries, each query all of vectors."""
        of_queries = _blocks(ask, QUERY_ROWS)
        left = index.filter(F.col("part").isin(list(of_queries))).withColumn("block", (own % count_of(of_index)).cast("int")).withColumn(
            "asked", F.explode(F.sequence(F.lit(0), count_of(of_queries) - 1)))
        right = ask.withColumn("asked", (own % count_of(of_queries)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), count_of(of_index) - 1)))
        cell = ["part", "block", "asked"]
        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
            best, f"query_id {kind}, vec_id {kind}, score double")

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)

    lowest = F.lit(float("-inf"))
    first = stored(spark, ranked(met(asked.filter("probe = 0").withColumn("bound", lowest))), "first-part")
    bounds = first.filter(F.col("rank") == nearest).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    others = stored(spark, asked.filter("probe > 0").join(bounds, "vec_id", "left").fillna(float("-inf"), ["bound"]), "others")
    found = stored(spark, ranked(first.drop("rank").union(met(others))), "found")
    if parts > probes:
        named = F.col("query_id").alias("vec_id")
        few = asked.join(found.filter(F.col("rank") == nearest).select(named), "vec_id", "left_anti")
        rest = F.sequence(F.lit(0), F.lit(parts - 1))
        few = stored(spark, few.groupBy("vec_id").agg(F.first("v").alias("v"), F.collect_set("part").alias("met")).select(
            "vec_id", "v", F.explode(F.array_except(rest, "met")).alias("part"), F.lit(float("-inf")).alias("bound")), "few")
        if not few.isEmpty():
            found = ranked(found.drop("rank").union(met(few)))
    return found.select("query_id", "rank", "vec_id", "score")


def _blocks(df: DataFrame, size: int) -> dict[int, int]:
    """Blocks of about ``size`` rows per part; at most one row per part comes to the driver."""
    return {r[0]: math.ceil(r[1] / size) for r in df.groupBy("part").count().collect()}


def _top(names, queries: np.ndarray, bounds: np.ndarray, ids, points: np.ndarray, nearest: int) -> list[tuple]:
    """The best of one block for each query, none below its bound. Ranked by a matrix product, decided by sums in one
    fixed order, so equal vectors have equal scores."""
    near, out = queries @ points.T, []
    near[names[:, None] == ids[None, :]] = -np.inf
    slack = _SLACK * np.linalg.norm(queries, axis=1) * max(1e-300, float(np.linalg.norm(points, axis=1).max()))
    for i, name in enumerate(names):
        row = near[i]
        floor = np.partition(row, -nearest)[-nearest] if len(row) > nearest else -np.inf
        at = np.nonzero((row >= max(floor, bounds[i]) - slack[i]) & (row > -np.inf))[0]
        score = (points[at] * queries[i]).sum(axis=1)
        for j in np.lexsort((ids[at], -score))[:nearest]:
            if score[j] >= bounds[i]:
                out.append((name, ids[at[j]], score[j]))
    return out
