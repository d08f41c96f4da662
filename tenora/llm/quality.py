"""Quality rules: exact text measures, and a logistic regression over hashed word and character n-grams.

The classifier is trained on a bounded sample of labelled rows, its probabilities are calibrated on rows it was not
trained on, and whole texts are scored in Arrow batches against fixed thresholds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.llm.common import hash32, small_batches

BITS = 16
#: Labelled rows the classifier is fitted on, about; the choice follows a hash of the id.
SAMPLE = 3000
#: Documents below these are rejected.
MIN_WORDS, MAX_REPEATED, MIN_PROBABILITY = 50, 0.5, 0.5
#: Passes over the sample, and how strongly weights are pulled to zero.
PASSES, RIDGE = 150, 1e-5
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_MIX = np.uint32(0x9E3779B1)
_PART = 1 << 18


def measures(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text in UTF-8 and its words."""
    chars = sum(len(w) for w in words)
    joined = b"".join(words)
    following = len(joined.translate(None, bytes(range(128)) + bytes(range(192, 256))))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    repeated = 0
    for line in data.split(b"\n"):
        if line.strip(_SPACE):
            repeated += line in seen
            seen.add(line)
    firsts: dict[tuple, int] = {}
    marks = bytearray(len(words))
    for i, window in enumerate(zip(words, words[1:], words[2:])):
        if (first := firsts.setdefault(window, i)) != i:
            marks[i : i + 3] = marks[first : first + 3] = b"\1\1\1"
    return len(words), chars - following, symbols, repeated, sum(marks)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint32(salt)) * _MIX
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def families(data: bytes, words: list[bytes]) -> Iterator[np.ndarray]:
    """Hashed features: single words, pairs of words, and runs of 3 and 4 bytes, in parts of bounded size."""
    h = np.fromiter((zlib.crc32(w) for w in words), dtype=np.uint32, count=len(words))
    yield [_mixed(h, 1)]
    yield [_mixed(h[:-1] * np.uint32(31) + h[1:], 2)]
    for n in (3, 4):
        parts = []
        for at in range(0, max(0, len(data) - n + 1), _PART):
            b = np.frombuffer(data, dtype=np.uint8)[at : at + _PART + n - 1].astype(np.uint32)
            run = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                run = run * np.uint32(257) + b[k : len(b) - n + 1 + k]
            parts.append(_mixed(run, n))
        yield parts


@dataclass(frozen=True)
class Model:
    """Weights per hashed feature, with the line that turns their sum into a calibrated log-odds."""

    weights: np.ndarray
    slope: float
    intercept: float

    def log_odds(self, data: bytes, words: list[bytes]) -> float:
        total = 0.0
        for parts in families(data, words):
            if n := sum(len(p) for p in parts):
                total += sum(float(self.weights[p].sum(dtype=np.float64)) for p in parts) / n
        return self.slope * total + self.intercept


def features(data: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their shares, each family summing to 1."""
    total = np.zeros(1 << BITS)
    for parts in families(data, words):
        if n := sum(len(p) for p in parts):
            for p in parts:
                total += np.bincount(p, minlength=1 << BITS) / n
    at = np.nonzero(total)[0]
    return at.astype(np.int32), total[at].astype(np.float32)


def _sums(bins: np.ndarray, n: int, weigh: Callable[[slice], np.ndarray]) -> np.ndarray:
    """Totals per bin of ``weigh(part)``, a part of the entries at a time."""
    total = np.zeros(n)
    for at in range(0, len(bins), _PART):
        part = slice(at, at + _PART)
        total += np.bincount(bins[part], weigh(part), n)
    return total


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit on four of five rows by adaptive gradient steps and calibrate on the fifth (all, if one class is missing there)."""
    held = np.arange(len(labels)) % 5 == 4
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held = np.zeros(len(labels), dtype=bool)
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row, n = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows]), len(rows)
    rows.clear()  # the sample is held once
    weights, bias, square, square_b = np.zeros(1 << BITS), 0.0, np.full(1 << BITS, 1e-12), 1e-12
    share = np.where(labels == 1, 0.5 / max(1, (labels[~held] == 1).sum()), 0.5 / max(1, (labels[~held] == 0).sum()))
    share[held] = 0.0
    for _ in range(PASSES):
        score = _sums(row, n, lambda p: value[p] * weights[at[p]]) + bias
        miss = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * share
        slope = _sums(at, 1 << BITS, lambda p: value[p] * miss[row[p]]) + RIDGE * weights / (1 << BITS)
        square, square_b = square + slope**2, square_b + miss.sum() ** 2
        weights, bias = weights - slope / np.sqrt(square), bias - 0.2 * miss.sum() / np.sqrt(square_b)
    score = _sums(row, n, lambda p: value[p] * weights[at[p]]) + bias
    use = held if held.any() else ~held
    a, b, scale = 1.0, 0.0, max(1e-9, float(np.abs(score[use]).mean()))
    x, y = score[use] / scale, labels[use]
    hits = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))  # smoothed targets
    for _ in range(50):  # Newton steps for slope and intercept
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, g = p * (1 - p) + 1e-6, p - hits
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, [(g * x).sum(), g.sum()])
    return Model(weights.astype(np.float32), float(a / scale), float(a / scale * bias + b))


def train(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
    label: str = "quality", sample: int = SAMPLE,
) -> Model | None:
    """A model from about ``sample`` labelled documents; None where the sample lacks one of the two labels.

    Repeated label rows count once (the lower label), as do repeated documents. Rows are turned into features where
    they lie; the features of the sample, and nothing else, meet in one task, which returns the weights.
    """
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(
        F.min(label).cast("int").alias("y"))
    share = min(1.0, sample / max(1, known.count()))
    chosen = F.broadcast(known.filter(hash32(F.lit("quality"), F.col("id")) < int(share * 2**32)))
    rows = small_batches(docs).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(chosen, "id").groupBy("id", "y").agg(
        F.min("text").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(d, d.split()) for d in (_utf8(t.as_py()) for t in batch.column(2))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["id", "y", "at", "share"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            rows += [(a.values.to_numpy(), s.values.to_numpy()) for a, s in zip(batch.column(2), batch.column(3))]
            labels += batch.column(1).to_pylist()
        if len(set(labels)) == 2:
            m = fit(rows, np.array(labels))
            yield pa.RecordBatch.from_arrays([
                pa.array([m.weights], pa.list_(pa.float32())), pa.array([m.slope]), pa.array([m.intercept])],
                ["weights", "slope", "intercept"])

    kind = docs.schema[key].dataType.simpleString()
    got = (
        rows.select("id", "y", "text").mapInArrow(describe, f"id {kind}, y int, at array<int>, share array<float>")
        .repartition(1).sortWithinPartitions("id").mapInArrow(learn, "weights array<float>, slope double, intercept double")
        .collect()
    )
    return Model(np.array(got[0][0], dtype=np.float32), got[0][1], got[0][2]) if got else None


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def judge(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = MIN_PROBABILITY) -> DataFrame:
    """``row`` (all columns), the five measures, base_failed, probability and kept, for every document.

    Null and empty texts have no words and fail. Without a model the base rules alone decide and the probability is null.
    """
    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_odds double")
    def measured(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            data = _utf8(t)
            words = data.split()  # bytes: splits at space and U+0009 to U+000D only
            odds = None if model is None else model.log_odds(data, words)
            out.append((*measures(data, words), odds))
        return pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_odds"])

    n = F.col("n_words")
    return (
        small_batches(docs).select(F.struct("*").alias("row"), measured(F.col(text).cast("string")).alias("m")).select("row", "m.*")
        .withColumn("base_failed", (n < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * n))
        .withColumn("probability", 1 / (1 + F.exp(-F.col("log_odds"))))
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("probability"), F.lit(1.0)) >= threshold))
        .drop("log_odds")
    )


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judge(docs, train(spark, docs, labels, text=text), text=text).filter("kept").select("row.*")
