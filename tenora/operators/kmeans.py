"""Many k-means models over the same rows, all carried through each pass together.

A search fits hundreds of models: every restart and cluster count of every reduction of every fold. Fitted one after
another, each needs its own passes over the data; here one pass serves all of them. A row is reduced once per reduction,
its distances to the centres of all models of that reduction are one matrix product, and a task emits only the sums per
model and cluster. So the number of passes is that of the slowest model, not the sum over models. Centres start by
k-means++: each pass draws the next centre of every model, weighted by squared distance, through the least of
exponential variables that come from a hash of the row's key, so any partitioning draws the same rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose distances are held at once.
BLOCK_ROWS = 4096
#: Rows whose distances to all centres of a reduction are held at once, few enough for the caches.
TILE_ROWS = 512
#: Above so many partitions their sums are added up in tasks first.
DIRECT_PARTITIONS = 64


@dataclass
class Reduction:
    """Models on ``(x - shift) @ matrix``, fitted on all rows but those of ``held_out``."""

    shift: np.ndarray
    matrix: np.ndarray
    models: list[tuple[int, int]]  # (clusters, seed)
    held_out: int | None = None
    spread: float = 1.0  # mean variance of the reduced columns
    centres: list[np.ndarray] = field(default_factory=list)
    inertia: list[float] = field(default_factory=list)
    passes: list[int] = field(default_factory=list)

    def rows(self, x: np.ndarray, part: np.ndarray) -> np.ndarray:
        return np.ones(len(x), dtype=bool) if self.held_out is None else part != self.held_out

    def reduced(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) @ self.matrix

    def best(self, k: int) -> np.ndarray:
        """Centres of the model of ``k`` clusters with the lowest inertia; the first of equals."""
        at = min((i for i, m in enumerate(self.models) if m[0] == k), key=lambda i: self.inertia[i])
        return self.centres[at]


def vectors(df: DataFrame, key: str, features: str | Sequence[str], part: str | None = None) -> DataFrame:
    """(id, part, x): a hash of the key, the fold, and the features as one array; rows with a null feature raise."""
    if isinstance(features, str):
        x = vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features).cast("array<double>")
    else:
        x = F.array(*[F.col(c).cast("double") for c in features])
    whole = F.when(F.exists(x, lambda v: v.isNull()), F.raise_error(F.lit("a feature is null")).cast("array<double>")).otherwise(x)
    return df.select(F.xxhash64(key).alias("id"), (F.col(part).cast("int") if part else F.lit(0)).alias("part"), whole.alias("x"))


def spread_out(rows: DataFrame) -> DataFrame:
    """The same rows on at least as many partitions as there are cores, as every pass computes much on few bytes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    few = rows.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count() < cores
    return rows.repartition(cores, "id") if few else rows


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            cut = batch.slice(at, BLOCK_ROWS)
            x = cut.column(2).flatten().to_numpy(zero_copy_only=False).reshape(cut.num_rows, -1)
            yield cut.column(0).to_numpy(zero_copy_only=False).view(np.uint64), cut.column(1).to_numpy(zero_copy_only=False), x


def gather(rows: DataFrame, partitions: int, work: Callable, merge: Callable) -> np.ndarray | None:
    """``merge`` of one float array a partition, ``work(blocks)``; partial merges run in tasks where there are many."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([work(blocks(batches)).astype(float).tobytes()], pa.binary())], ["sums"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0).to_pylist():
                one = np.frombuffer(row)
                total = one if total is None else merge(np.stack([total, one]))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    found = rows.mapInArrow(once, "sums binary")
    if partitions > DIRECT_PARTITIONS:
        found = found.repartition(math.isqrt(partitions)).mapInArrow(together, "sums binary")
    parts = [np.frombuffer(r["sums"]) for r in found.collect()]  # a bounded number of arrays of one size
    return merge(np.stack(parts)) if parts else None


def _uniform(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    """A number in (0, 1) for each id."""
    h = ids + np.uint64((0x9E3779B97F4A7C15 * (seed * 1009 + step + 1)) & 0xFFFFFFFFFFFFFFFF)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(factor)
    h ^= h >> np.uint64(31)
    return ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def _squared(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((z * z).sum(1)[:, None] - 2 * z @ centres.T + (centres * centres).sum(1), 0.0)


def _drawn(todo: list[tuple[int, int, Reduction]], step: int) -> tuple[Callable, Callable]:
    """Work that draws the next centre of each listed model: per model, the least key and its row.

    Models of one reduction and seed have drawn the same centres so far, whatever their number, and draw the same next.
    """
    sizes = [1 + r.matrix.shape[1] for _, _, r in todo]
    starts = np.cumsum([0, *sizes])
    groups: dict[int, tuple[Reduction, dict[int, list[int]]]] = {}
    for place, (_, m, red) in enumerate(todo):
        groups.setdefault(id(red), (red, {}))[1].setdefault(red.models[m][1], []).append(place)
    shared = [
        (red, [(seed, places, red.centres[todo[places[0]][1]]) for seed, places in seeds.items()]) for red, seeds in groups.values()]

    def work(parts: Iterator) -> np.ndarray:
        best = np.full(starts[-1], np.inf)
        for ids, part, x in parts:
            keys = {seed: -np.log(_uniform(ids, seed, step)) for seed in {s for _, seeds in shared for s, *_ in seeds}}
            for red, seeds in shared:
                own = red.rows(x, part)
                z = red.reduced(x[own])
                if not len(z):
                    continue
                norm = (z * z).sum(1)
                for seed, places, centres in seeds:
                    chance = keys[seed][own]
                    if step:
                        far = np.maximum((centres @ (-2 * z.T) + (centres * centres).sum(1)[:, None]).min(0) + norm, 0.0)
                        far[far <= 1e-12 * norm] = 0.0  # the row is a centre, up to rounding: never drawn again
                        with np.errstate(divide="ignore"):
                            chance = chance / far
                    i = int(np.argmin(chance))
                    for place in places:
                        if chance[i] < best[starts[place]]:
                            best[starts[place]], best[starts[place] + 1:starts[place + 1]] = chance[i], z[i]
        return best

    def merge(found: np.ndarray) -> np.ndarray:
        out = found[0].copy()
        for at, end in zip(starts[:-1], starts[1:]):
            out[at:end] = found[np.argmin(found[:, at]), at:end]
        return out

    return work, merge


def _by_size(red: Reduction, active: list[int]) -> list[tuple[list[int], int, np.ndarray]]:
    """(models, their number of centres k, (-2 times a centre, its squared norm)); the first centres of all models come first."""
    found = []
    for k in sorted({len(red.centres[m]) for m in active}):
        models = [m for m in active if len(red.centres[m]) == k]
        centres = np.stack([red.centres[m] for m in models], axis=1).reshape(k * len(models), -1)
        found.append((models, k, np.column_stack([-2 * centres, (centres * centres).sum(1)])))
    return found


def _nearest(known: np.ndarray, norm: np.ndarray, models: int, k: int, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows and their sum of each centre, costs of the models) of some reduced rows (z, 1); the first of equal centres counts."""
    far = (centres @ known.T).reshape(k, models, len(known))
    least = far.min(0)
    total = (far == least).astype(float).reshape(k * models, len(known)) @ known
    if total[:, -1].sum() != models * len(known):  # some row has several nearest centres, or is not a number
        total = (far.argmin(0) == np.arange(k)[:, None, None]).astype(float).reshape(k * models, len(known)) @ known
    return total, np.maximum(least + norm, 0.0).sum(1)


def _moved(todo: list[tuple[Reduction, list[int]]]) -> Callable:
    """Work that adds up, per model, its inertia and for every cluster the rows and their sum."""
    sized = [(red, active, _by_size(red, active)) for red, active in todo]

    def work(parts: Iterator) -> np.ndarray:
        sums = [[(np.zeros(len(models)), np.zeros((k * len(models), 1 + red.matrix.shape[1]))) for models, k, _ in groups]
                for red, _, groups in sized]
        for _, part, x in parts:
            for (red, _, groups), totals in zip(sized, sums):
                z = red.reduced(x[red.rows(x, part)])
                known = np.column_stack([z, np.ones(len(z))])
                norm = (z * z).sum(1)
                for at in range(0, len(z), TILE_ROWS):
                    cut = slice(at, at + TILE_ROWS)
                    for (models, k, centres), (cost, total) in zip(groups, totals):
                        found, costs = _nearest(known[cut], norm[cut], len(models), k, centres)
                        cost += costs
                        total += found
        found = []
        for (red, active, groups), totals in zip(sized, sums):
            cells = {}
            for (models, k, _), (cost, total) in zip(groups, totals):
                total = total.reshape(k, len(models), -1)
                cells |= {m: (cost[i], total[:, i, -1], total[:, i, :-1]) for i, m in enumerate(models)}
            found += [np.array([cells[m][0] for m in active])]
            found += [np.concatenate([cells[m][part].ravel() for m in active]) for part in (1, 2)]
        return np.concatenate(found)

    return work


def _added(found: np.ndarray) -> np.ndarray:
    return found.sum(0)


def _unpacked(sums: np.ndarray, todo: list[tuple[Reduction, list[int]]]) -> Iterator[tuple[Reduction, int, float, np.ndarray, np.ndarray]]:
    at = 0
    for red, active in todo:
        sizes, width = [len(red.centres[m]) for m in active], red.matrix.shape[1]
        cost = sums[at:at + len(active)]
        at += len(active)
        count = sums[at:at + sum(sizes)]
        at += sum(sizes)
        total = sums[at:at + sum(sizes) * width].reshape(-1, width)
        at += sum(sizes) * width
        begin = 0
        for m, k, c in zip(active, sizes, cost):
            yield red, m, float(c), count[begin:begin + k], total[begin:begin + k]
            begin += k


def fit_many(rows: DataFrame, reductions: Sequence[Reduction], max_iter: int = 300, tol: float = 1e-4) -> int:
    """Fit every model of every reduction; centres and inertia are left in the reductions. Returns the passes made.

    ``rows`` is (id, part, x) of ``vectors``, read once a pass, so it should be stored or persisted. A model stops when the
    squared moves of its centres add up to at most ``tol`` times the reduction's spread, or after ``max_iter`` moves. Where a fold has fewer different rows than clusters
    a model has that many centres only. Only centres and sums per cluster reach the driver.
    """
    partitions = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    passes = 0
    for red in reductions:
        red.centres = [np.zeros((0, red.matrix.shape[1])) for _ in red.models]
        red.inertia, red.passes = [math.inf] * len(red.models), [0] * len(red.models)
    for step in range(max((k for r in reductions for k, _ in r.models), default=0)):
        todo = [(n, m, r) for n, r in enumerate(reductions) for m, (k, _) in enumerate(r.models) if k > step == len(r.centres[m])]
        if not todo:
            break
        drawn, at = gather(rows, partitions, *_drawn(todo, step)), 0
        passes += 1
        for _, m, red in todo:
            width = red.matrix.shape[1]
            if drawn is not None and np.isfinite(drawn[at]):
                red.centres[m] = np.vstack([red.centres[m], drawn[at + 1:at + 1 + width]])
            at += 1 + width
    active = {id(r): [m for m in range(len(r.models)) if len(r.centres[m])] for r in reductions}
    for turn in range(max_iter + 1):
        todo = [(r, active[id(r)]) for r in reductions if active[id(r)]]
        if not todo:
            break
        sums = gather(rows, partitions, _moved(todo), _added)
        passes += 1
        for red, m, cost, count, total in list(_unpacked(sums, todo)):
            red.inertia[m] = cost
            if red.passes[m] < 0 or turn == max_iter:  # the last pass only measured the final centres
                active[id(red)].remove(m)
                continue
            moved = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], red.centres[m])
            far = ((moved - red.centres[m]) ** 2).sum()
            red.centres[m] = moved
            red.passes[m] = -(turn + 1) if far <= tol * red.spread else turn + 1
    for red in reductions:
        red.passes = [abs(p) for p in red.passes]
    return passes


def labels(red: Reduction, centres: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _squared(red.reduced(x), centres).argmin(1)


def silhouettes(rows: DataFrame, models: Sequence[tuple[Reduction, np.ndarray]], shifts: Sequence[np.ndarray], scales: Sequence[np.ndarray]) -> list[float]:
    """Mean silhouette (squared Euclidean) of each model on its held-out rows, or on all rows if none are held out.

    Distances are between ``(x - shift) * scale``. -1 where there are fewer than two clusters or one of a single row.
    Two passes for all models: sums per cluster, from which every mean distance follows, then the silhouettes.
    """
    partitions = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    counts = [len(c) for _, c in models]
    width = len(models[0][0].shift) + 2
    starts = np.cumsum([0, *[k * width for k in counts]])

    def seen(n: int, part: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        red, centres = models[n]
        own = np.ones(len(x), dtype=bool) if red.held_out is None else part == red.held_out
        return labels(red, centres, x[own]), (x[own] - shifts[n]) * scales[n]

    def first(parts: Iterator) -> np.ndarray:
        total = np.zeros(starts[-1])
        for _, part, x in parts:
            for n, k in enumerate(counts):
                label, v = seen(n, part, x)
                member = (label[:, None] == np.arange(k)).astype(float)
                known = np.column_stack([np.ones(len(v)), (v * v).sum(1), v])
                total[starts[n]:starts[n + 1]] += (member.T @ known).ravel()
        return total

    sums = gather(rows, partitions, first, _added)
    if sums is None:
        return [-1.0] * len(models)
    known = [sums[a:b].reshape(k, width) for a, b, k in zip(starts[:-1], starts[1:], counts)]
    known = [s[s[:, 0] > 0] if len(s) else s for s in known]
    found = [np.flatnonzero(sums[a:b].reshape(k, width)[:, 0] > 0) for a, b, k in zip(starts[:-1], starts[1:], counts)]

    def second(parts: Iterator) -> np.ndarray:
        total = np.zeros(len(models))
        for _, part, x in parts:
            for n, s in enumerate(known):
                if len(s) < 2 or s[:, 0].min() < 2:
                    continue
                label, v = seen(n, part, x)
                if not len(v):
                    continue
                place = np.searchsorted(found[n], label)
                mean = (v * v).sum(1)[:, None] - 2 * v @ (s[:, 2:] / s[:, :1]).T + s[:, 1] / s[:, 0]
                at = np.arange(len(v))
                size = s[place, 0]
                a = mean[at, place] * size / (size - 1)
                mean[at, place] = np.inf
                b = mean.min(1)
                most = np.maximum(a, b)
                total[n] += np.divide(b - a, most, out=np.zeros_like(a), where=most > 0).sum()
        return total

    scores = gather(rows, partitions, second, _added)
    return [float(t / s[:, 0].sum()) if len(s) > 1 and s[:, 0].min() > 1 else -1.0 for t, s in zip(scores, known)]


def moments(rows: DataFrame, parts: int) -> tuple[np.ndarray, list[tuple[float, np.ndarray, np.ndarray]]]:
    """(point, per part: rows, sum and sum of outer products of ``x - point``), in two passes; the point is the mean."""
    partitions = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    width = rows.select(F.max(F.size("x"))).first()[0] or 0

    def sums(cells: Iterator) -> np.ndarray:
        total = np.zeros(1 + width)
        for _, _, x in cells:
            total += np.append(len(x), x.sum(0))
        return total

    total = gather(rows, partitions, sums, _added)
    point = total[1:] / max(total[0], 1.0)

    def products(cells: Iterator) -> np.ndarray:
        total = np.zeros((parts, 1 + width + width * width))
        for _, part, x in cells:
            for p in range(parts):
                v = x[part == p] - point
                total[p] += np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
        return total.ravel()

    cells = gather(rows, partitions, products, _added).reshape(parts, -1)
    return point, [(c[0], c[1:1 + width], c[1 + width:].reshape(width, width)) for c in cells]


class NearestCentre(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Number of the centre nearest to a vector column, the smallest of equals, in Arrow batches."""

    centres = Param(Params._dummy(), "centres", "rows of the centres as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, centres: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, centres: np.ndarray, inputCol: str, outputCol: str) -> NearestCentre:
        return cls(inputCol=inputCol, outputCol=outputCol, centres=json.dumps(centres.tolist()))

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in json.loads(self.getOrDefault(self.centres))]

    def _transform(self, df: DataFrame) -> DataFrame:
        centres = np.array(json.loads(self.getOrDefault(self.centres)))

        @F.pandas_udf("int")
        def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in parts:
                yield pd.Series(_squared(np.stack(x.to_numpy()), centres).argmin(1) if len(x) else [], dtype="int32")

        return df.withColumn(self.getOutputCol(), nearest(vector_to_array(F.col(self.getInputCol()))))
