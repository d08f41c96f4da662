"""Packing tokenised documents into sequences of a fixed length by minimum bin slack.

Pieces are packed by length alone, so the plan is made from a histogram of at most ``capacity`` lengths, whatever the number
of documents: each bin takes the longest length left and the fullest combination of available lengths beside it, found
by a subset-sum over bitsets; the combination is repeated until one of its lengths runs out, so at most ``capacity``
different bins are ever computed. Pieces then find their place by their rank among those of equal length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.llm.common import hash32, rank_rows, release, small_batches
from tenora.session import stored

CAPACITY = 2048
#: Closes every document.
END_ID = 0
#: Distinct runs of characters whose ids a task remembers at once, and their characters; documents tokenised together.
_REMEMBERED, _CHARACTERS, _TOGETHER = 200_000, 4_000_000, 64
#: Runs that the tokenizer never joins with each other: letters, and other visible characters of ASCII but the apostrophe.
_LETTERS, _OTHERS = "a-zß-öø-ÿ", "!-&(-@\\[-`{-~"
_RUNS = re.compile(f"[{_LETTERS}]+|[{_OTHERS}]+")
_PLAIN = re.compile(f"[{_LETTERS}{_OTHERS} \n]*")


class WordTokenizer(dict):
    """Ids of whole texts, tokenising every distinct run of characters once.

    Made for tokenizers that lower case, drop white space, and never join across it or between letters and other
    characters. A text of Latin letters and ASCII is cut into such runs, and any other text at its spaces and newlines,
    so the ids of the text are those of its parts. The runs' ids always come from the tokenizer, and a text that spells
    out one of its added tokens, in any case, is given to it whole. As a dictionary it numbers the runs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [c for c in map(chr, range(256)) if re.fullmatch(f"[{_LETTERS}]", c)]
        self.spelt = str.maketrans({c: as_bytes.pre_tokenize_str(c)[0][0] for c in letters})
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.held = 0
        self.ids, self.starts = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)

    def __missing__(self, run: str) -> int:
        self.new.append(run)
        self[run] = number = len(self)
        return number

    def _learn(self) -> None:
        found, model, spelt, encode = [], self.tokenizer.model, self.spelt, self.tokenizer.encode
        for run in self.new:
            if run.isascii() and run.isalpha() and run.islower():
                found.append([t.id for t in model.tokenize(run)])
            elif run.isalpha() and _RUNS.fullmatch(run):
                found.append([t.id for t in model.tokenize(run.translate(spelt))])
            else:
                found.append(encode(run, add_special_tokens=False).ids)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), dtype="<u4", count=int(lengths.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.held += sum(map(len, self.new))
        self.new = []

    def runs(self, text: str) -> list[str]:
        if self.added is not None and self.added.search(text):
            return [text]
        try:
            text.encode("latin-1")  # where lower case is the same, letter by letter, everywhere
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        low = text.lower()
        return _RUNS.findall(low) if _PLAIN.fullmatch(low) else text.replace("\n", " ").split(" ")

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self) > _REMEMBERED or self.held > _CHARACTERS:
            self._forget()
        cut = [self.runs(t) for t in texts]
        sizes = np.cumsum([0, *map(len, cut)])
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=int(sizes[-1]))
        if self.new:
            self._learn()
        first = self.starts[number]
        lengths = self.starts[number + 1] - first
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], lengths)
        return np.split(self.ids[at], ends[sizes[1:-1]])


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document: its ids, then END_ID, cut only where longer than ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit numbers. A null text is an empty one: a single END_ID.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[key].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    names = schema.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordTokenizer(tokenizer), np.array([END_ID], dtype="<u4")
        for batch in batches:
            for first in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(first, _TOGETHER)
                row, piece, start, length, ids = [], [], [], [], []
                for i, own in enumerate(words.batch([t or "" for t in part.column(1).to_pylist()])):
                    own = np.append(own, end)
                    for k, at in enumerate(range(0, len(own), capacity)):
                        row.append(i), piece.append(k), start.append(at)
                        length.append(min(capacity, len(own) - at)), ids.append(own[at : at + capacity].tobytes())
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                ], names)
        del words
        release()

    return small_batches(docs).select(F.col(key), F.col(text).cast("string")).mapInArrow(cut, schema)


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths with their numbers, of total at most ``room`` and as near it as any combination of ``counts`` comes."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... of a length reach every number of it
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left, take = left - take, take * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first_rank, last_rank, first_bin, per_bin, offset): where pieces of a length go, by rank from 0.

    A run's pieces fill ``per_bin`` places from ``offset`` on in each bin from ``first_bin`` on.
    """
    left, used, bins, runs = {n: c for n, c in counts.items() if c}, dict.fromkeys(counts, 0), 0, []
    while left:
        longest = max(left)
        others = dict(left)
        others[longest] -= 1
        pattern: dict[int, int] = {longest: 1}
        for length, number in fullest(others, capacity - longest):
            pattern[length] = pattern.get(length, 0) + number
        times, offset = min(left[n] // k for n, k in pattern.items()), 0
        for length, number in pattern.items():
            runs.append((length, used[length], used[length] + times * number - 1, bins, number, offset))
            used[length] += times * number
            left[length] -= times * number
            if not left[length]:
                del left[length]
            offset += length * number
        bins += times
    return runs


def pack(spark: SparkSession, rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``doc_id``, ``piece`` and ``length``, all other columns kept.

    ``rows`` is read several times, so it should be stored. The plan (a few thousand runs, bounded by the capacity) is
    broadcast. Equal rows are interchangeable.
    """
    marked = rows.select(
        F.struct("*").alias("row"), F.col("length").alias("length_"), F.col("doc_id").alias("id_"),
        F.col("piece").alias("piece_no_"), hash32(F.col("doc_id"), F.col("piece")).alias("h_"))
    narrow = marked.select("length_", "h_")
    counts = {r[0]: r[1] for r in narrow.groupBy("length_").count().collect()}  # at most ``capacity`` rows
    runs = spark.createDataFrame(
        plan_bins(counts, capacity),
        "run_length long, first_rank long, last_rank long, first_bin long, per_bin long, first_offset long")
    ranked = rank_rows(spark, marked, narrow, "length_", [], "h_", [F.col("id_"), F.col("piece_no_")])
    rank = F.col("rank_") - 1
    nth = rank - F.col("first_rank")
    return ranked.join(
        F.broadcast(runs), (F.col("length_") == F.col("run_length")) & rank.between(F.col("first_rank"), F.col("last_rank"))
    ).select(
        "row.*", (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("per_bin") * F.col("length_")).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from packed pieces with their ``ids``; at most ``capacity`` pieces meet in one row."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("length"),
        joined.alias("ids"))


def sequence_fill(packed: DataFrame) -> DataFrame:
    """(sequence_id, pieces, filled) for reports."""
    return packed.groupBy("sequence_id").agg(F.count("*").alias("pieces"), F.sum("length").alias("filled"))


def packed_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    cut = pieces(docs, tokenizer, capacity=capacity).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(spark, stored(spark, cut, "pieces"), capacity)
