"""Language identification by nearest centroid.

A text is a vector of hashed letter 3-grams, weighted by root count times inverse document frequency and scaled to length
1. Every language has several centroids, found by spherical clustering. The nearest centroid by cosine gives the
language, and a text is rejected if it is much farther from it than the training texts of that language and length are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenora.llm.common import hash32, release, small_batches

BITS = 13
#: Texts per language that centroids are fitted on, about; the choice follows a hash.
SAMPLE = 500
CENTROIDS = 4
#: A text is rejected below this share of the cosine that all but LOW of the training texts of its language and length
#: reach. Lengths are classes of grams by powers of two; a class of fewer than ENOUGH texts has the next shorter one's.
SHARE, LOW, ENOUGH = 0.6, 0.01, 50
_CLASSES, _STEPS = 64, 200
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Bytes whose runs, and texts whose dense vectors, are held at once.
_PART, _ROWS = 1 << 18, 32


def grams(text: str | None) -> np.ndarray:
    """Counts of hashed 3-byte runs of the lower-cased letters, words set apart by one space; zeros without letters."""
    total = np.zeros(1 << BITS, dtype=np.float32)
    letters = _NOT_LETTERS.sub(" ", (text or "").lower())
    if letters == " " or not any(map(str.isalpha, letters)):
        return total
    data = np.frombuffer(f" {letters.strip()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for at in range(0, len(data) - 2, _PART):
        b = data[at : at + _PART + 2].astype(np.uint32)
        h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
        total += np.bincount((h ^ (h >> np.uint32(15))) >> np.uint32(32 - BITS), minlength=1 << BITS)
    return total


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A unit vector per row of counts, zero for texts without letters."""
    out = np.sqrt(counts) * idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def vectors(texts, idf: np.ndarray) -> np.ndarray:
    return weighted(np.stack([grams(t) for t in texts]), idf)


def floors_of(counts: dict[tuple[str, int, int], int]) -> dict[str, np.ndarray]:
    """The least cosine accepted, per language and length class, from counts by language, class and cosine step."""
    floors = {}
    for lang in {key[0] for key in counts}:
        table = np.zeros((_CLASSES, _STEPS + 1))
        for (name, size, step), n in counts.items():
            if name == lang:
                table[size, step] += n
        least, floors[lang] = 0.0, np.zeros(_CLASSES)
        for size, row in enumerate(table):
            if row.sum() >= ENOUGH:
                least = SHARE * int((np.cumsum(row) > LOW * row.sum()).argmax()) / _STEPS
            floors[lang][size] = least
    return floors


def cluster(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are the point nearest the mean and then those least like the chosen."""
    chosen = [int((points @ points.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(points)):
        chosen.append(int((points @ points[chosen].T).max(axis=1).argmin()))
    centres = points[chosen]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                total = points[own == c].sum(axis=0)
                centres[c] = total / max(1e-9, float(np.linalg.norm(total)))
    return centres


@dataclass(frozen=True)
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: dict[str, np.ndarray] = field(default_factory=dict)  # of each language, by length class

    def predict(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and length class of each text; UNKNOWN and 0 without letters."""
        names, scores, sizes = [], [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(texts), _ROWS):
            counts = np.stack([grams(t) for t in texts[at : at + _ROWS]])
            v = weighted(counts, self.idf)
            cosine = v @ self.centroids.T
            best, lettered = cosine.argmax(axis=1), v.any(axis=1)
            names += [self.languages[b] if has else UNKNOWN for b, has in zip(best, lettered)]
            scores.append(np.where(lettered, np.clip(cosine.max(axis=1), 0, 1), 0))
            sizes.append(np.log2(np.maximum(1, counts.sum(axis=1, dtype=np.float64))).astype(np.int64))
        return names, np.concatenate(scores), np.concatenate(sizes)

    def rejects(self, names: list[str], scores: np.ndarray, sizes: np.ndarray) -> list[bool]:
        """Whether each text, as predicted, is UNKNOWN or too far from the centroids of its language."""
        none = np.zeros(_CLASSES)
        return [n == UNKNOWN or bool(s < self.floors.get(n, none)[k]) for n, s, k in zip(names, scores, sizes)]


def train(
    spark: SparkSession, docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, k: int = CENTROIDS,
) -> Model | None:
    """A model from rows with a language; None if there is no such row with a letter.

    Document frequencies are counted over all rows. Centroids are fitted on about ``sample`` distinct texts of each
    language, one task per language. The model (k vectors per language) comes to the driver and goes to every task. The
    distance of rejection is learned from all rows whose own language is predicted; from them come at most
    _CLASSES x _STEPS counts per language.
    """
    known = small_batches(docs).filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                total += grams(t.as_py()) > 0
            n += batch.num_rows
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["gram", "n"])
        release()

    counted = known.select("text").mapInArrow(frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect()
    found = dict(map(tuple, counted))  # at most one number per hashed gram
    rows = max(1, found.pop(-1, 0))
    idf = np.zeros(1 << BITS, dtype=np.float32)
    for gram, n in found.items():
        idf[gram] = np.log((1 + rows) / (1 + n)) + 1

    chance = hash32(F.lit("lang"), F.md5("text")) / float(2**32)
    sizes = F.broadcast(known.groupBy("lang").agg(F.count("*").alias("n")))  # far smaller than the model, a row per language
    picked = known.join(sizes, "lang").filter(chance < sample / F.col("n")).select("lang", "text").distinct()

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        points = vectors(pdf.sort_values("text")["text"], idf)
        points = points[points.any(axis=1)]
        got = cluster(points, k) if len(points) else points
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(got), "centroid": [c.tolist() for c in got]})

    models = picked.groupBy("lang").applyInPandas(centres, "lang string, centroid array<float>").collect()
    models.sort(key=lambda r: (r[0], r[1]))
    if not models:
        return None
    model = Model([r[0] for r in models], np.array([r[1] for r in models], dtype=np.float32), idf)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            names, scores, classes = model.predict(batch.column(1).to_pylist())
            seen.update((n, int(k), int(s * _STEPS)) for n, own, s, k in zip(names, batch.column(0).to_pylist(), scores, classes) if n == own)
        columns = list(zip(*((*key, n) for key, n in seen.items()))) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["lang", "size", "step", "n"])
        release()

    near = known.mapInArrow(distances, "lang string, size int, step int, n long").groupBy("lang", "size", "step").agg(F.sum("n"))
    return replace(model, floors=floors_of({tuple(r[:3]): r[3] for r in near.collect()}))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``row`` (all columns), lang_pred, score (cosine, 0 to 1) and rejected, for every document.

    Null texts, texts without a letter, and all texts if there is no model, are UNKNOWN with score 0, and rejected.
    Only the text is an input.
    """
    @F.pandas_udf("lang string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "rejected": True})
        names, scores, sizes = model.predict(list(texts))
        return pd.DataFrame({"lang": names, "score": scores, "rejected": model.rejects(names, scores, sizes)})

    found = small_batches(docs).select(F.struct("*").alias("row"), predicted(F.col(text).cast("string")).alias("p"))
    return found.select(
        "row", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: CRC-32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def keep_known(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are not rejected, with their own columns.

    Null texts and texts without a letter go; of short texts nearly all stay, as training texts of their length are far
    from the centroids too. Long texts are read whole, rows that are alike have the same fate, and the language column
    (null or not) decides nothing. A table without a labelled text, or an empty one, leaves no row.
    """
    model = train(spark, docs.filter(~held_out(F.col(key))), text, lang)
    return identify(docs, model, text).filter(~F.col("rejected")).select("row.*")
