"""Periodic runs of words, found by internal pattern matching.

A run of period q and at least 4 q words holds an aligned block of B words, B the power of two with q < B <= 2 q, and on
one side of the block at least q more words, so the block occurs again exactly q words away on that side and nowhere
nearer. So every aligned block of every dyadic length asks for its nearest occurrences in the two neighbouring windows.
Occurrences of a block are an interval of the suffix array; a wavelet tree over the array answers the range successor
and predecessor of a position within it. The distance is the difference of the arithmetic progression that the
occurrences form and the candidate period; it is extended to both sides by comparing dyadic blocks, which gives the
whole run or shows that there is none. About as many blocks as words are asked for, and blocks that occur once are not.

Many texts are searched together: words are numbered anew in each text, so no block occurs in two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.llm.common import small_batches

#: A run repeats its period at least so often, and has at least so many words.
LEAST_REPEATS, LEAST_WORDS = 4, 6
#: Words searched together; a longer text is searched alone.
_TOGETHER = 1 << 16


def dyadic_ranks(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Suffix array by prefix doubling: (positions in order, ranks, group sizes), the last two for 1, 2, 4, ... words.

    The rank of a position is where the group of equal blocks starts in the order; deeper lengths only reorder inside
    groups. Blocks that run over the end are equal to none. Lengths go up to ``longest``.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    key = symbols[order]
    ranks, sizes, block = [], [], 1
    rank, slots = np.zeros(n, dtype=np.int32), np.arange(n)
    size = np.ones(n, dtype=np.int32)
    while True:
        fresh = np.ones(len(slots), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(fresh)
        lengths = np.diff(np.append(heads, len(slots)))
        rank, size = rank.copy(), size.copy()
        rank[order[slots]] = np.repeat(slots[heads], lengths)
        size[slots[heads]] = lengths
        ranks.append(rank), sizes.append(size)
        if 2 * block > longest:
            return order, ranks, sizes
        slots = slots[np.repeat(lengths > 1, lengths)]
        at = order[slots]
        follows = np.full(len(at), -1, dtype=np.int64)
        inside = at + block < n
        follows[inside] = rank[at[inside] + block]
        key = rank[at].astype(np.int64) * (n + 1) + follows + 1
        sort = np.argsort(key, kind="stable")
        order[slots], key = at[sort], key[sort]
        block *= 2


class WaveletTree:
    """Range counts and range selection over numbers below ``limit``, one layer of prefix counts a bit."""

    def __init__(self, values: np.ndarray, limit: int):
        self.layers = []
        for bit in range(max(1, int(limit).bit_length()) - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~ones)]).astype(np.int32)
            self.layers.append((bit, zeros, zeros[-1]))
            values = np.concatenate([values[~ones], values[ones]])

    def below(self, first: np.ndarray, last: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values in slots ``first`` to ``last - 1`` are less than ``bound``."""
        found = np.zeros(len(first), dtype=np.int64)
        for bit, zeros, middle in self.layers:
            a, b = zeros[first], zeros[last]
            right = (bound >> bit & 1).astype(bool)
            found += np.where(right, b - a, 0)
            first, last = np.where(right, middle + first - a, a), np.where(right, middle + last - b, b)
        return found

    def nth(self, first: np.ndarray, last: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value with ``n`` smaller ones before it in slots ``first`` to ``last - 1``."""
        value = np.zeros(len(first), dtype=np.int64)
        for bit, zeros, middle in self.layers:
            a, b = zeros[first], zeros[last]
            right = n >= b - a
            n = np.where(right, n - (b - a), n)
            value += np.where(right, 1 << bit, 0)
            first, last = np.where(right, middle + first - a, a), np.where(right, middle + last - b, b)
        return value


def _candidates(order: np.ndarray, ranks: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions (i, j), i < j, where a block starts and occurs again a candidate period later."""
    n = len(order)
    if len(ranks) < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    repeated = sizes[1][ranks[1][order]] > 1  # only slots of blocks that occur twice are ever asked for
    moved = np.concatenate([[0], np.cumsum(repeated)])
    tree = WaveletTree(order[repeated].astype(np.int64), n)
    left, right = [], []
    for level in range(1, len(ranks)):
        block = 1 << level
        at = np.arange(0, n - block + 1, block)
        rank = ranks[level][at]
        many = sizes[level][rank] > 1
        at, rank = at[many], rank[many].astype(np.int64)
        first, last = moved[rank], moved[rank + sizes[level][rank]]
        before = tree.below(first, last, at)
        for step, asked in ((1, before + 1 < last - first), (-1, before > 0)):
            here = at[asked]
            there = tree.nth(first[asked], last[asked], before[asked] + step)
            distance = np.abs(there - here)
            fits = (2 * distance >= block) & (distance < block)
            left.append(np.minimum(here, there)[fits]), right.append(np.maximum(here, there)[fits])
    return np.concatenate(left), np.concatenate(right)


def _common(i: np.ndarray, j: np.ndarray, ranks: list[np.ndarray], forward: bool) -> np.ndarray:
    """How many words are equal from ``i`` and ``j`` (i < j) on, or right before them, by blocks of halving length."""
    n, done = len(ranks[0]), np.zeros(len(i), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        block, rank = 1 << level, ranks[level]
        going = np.arange(len(i))
        while len(going):  # more than once only for the longest block
            if forward:
                going = going[j[going] + done[going] + block <= n]
                a, b = i[going] + done[going], j[going] + done[going]
            else:
                going = going[i[going] - done[going] >= block]
                a, b = i[going] - done[going] - block, j[going] - done[going] - block
            going = going[rank[a] == rank[b]]
            done[going] += block
            if level < len(ranks) - 1:
                break
    return done


def find_runs(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. Equal numbers are equal words.

    ``longest`` bounds the words of one text; texts must not share numbers.
    """
    if len(symbols) < LEAST_WORDS:
        return np.zeros((0, 3), dtype=np.int64)
    order, ranks, sizes = dyadic_ranks(symbols, max(1, longest // 2))
    i, j = _candidates(order, ranks, sizes)
    if not len(i):
        return np.zeros((0, 3), dtype=np.int64)
    start = i - _common(i, j, ranks, forward=False)
    length, period = j + _common(i, j, ranks, forward=True) - start, j - i
    found = np.unique(np.stack([start, period, length], axis=1), axis=0)
    found = found[found[:, 2] >= np.maximum(LEAST_WORDS, LEAST_REPEATS * found[:, 1])]
    return found[:, [0, 2, 1]]


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """``find_runs`` of each text, given as its words, with places counted inside the text."""
    parts, used = [], 0
    for words in texts:
        numbers = dict(zip(dict.fromkeys(words), count(used)))
        parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)))
        used += len(numbers)
    ends = np.cumsum([0, *map(len, texts)])
    found = find_runs(np.concatenate(parts), max(map(len, texts)))
    cut = np.searchsorted(found[:, 0], ends)
    return [found[a:b] - [at, 0, 0] for a, b, at in zip(cut[:-1], cut[1:], ends[:-1])]


def _described(words: list[bytes], runs: np.ndarray) -> tuple:
    collapsed, best, listed = words, (None, None, None, None), ""
    if len(runs):
        kept = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(kept, runs[:, 0] + runs[:, 2], 1)
        np.add.at(kept, runs[:, 0] + runs[:, 1], -1)
        collapsed = list(compress(words, (np.cumsum(kept[:-1]) == 0).tolist()))
        rows = runs.tolist()
        start, length, period = max(rows, key=lambda r: ((r[1] << 64) // r[2], -r[0], -r[2]))  # exact below 2**32 words
        best = (start, length, period, 1000 * length // period)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in rows)
    digest = [hashlib.sha256(x).hexdigest() for x in (listed.encode(), b" ".join(collapsed))]
    return len(words), len(runs), *best, *digest, b" ".join(collapsed)


_COLUMNS = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, collapsed string")


def collapse(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per document: its number of runs, the strongest run, digests, and the text without the repetitions.

    A run is a stretch of consecutive words of smallest period q, at least max(6, 4 q) words long, that cannot be made
    longer; every word that a run holds after its first q words is left out of ``collapsed``. The strongest run has the
    greatest exact length / period, ties by start, then period. A null, empty or wordless text has no words and no runs.
    Repeated rows and null keys give a row each, and extra columns are ignored. Whole texts are searched; memory grows
    with the longest text (about 150 bytes a word) and not with their number. No shuffle.
    """
    schema = T._parse_datatype_string(_COLUMNS)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *schema.fields[:None if keep_text else -1]])
    names, width = schema.names, len(schema) - 1

    def emit(keys: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        rows = [_described(w, r)[:width] for w, r in zip(texts, runs_of(texts))]
        columns = [pa.array(c, pa.string() if f.dataType == T.StringType() else pa.int64())
                   if f.name != "collapsed" else pa.array(c, pa.binary()).cast(pa.string())
                   for c, f in zip(zip(*rows), schema.fields[1:])]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *columns], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            texts, size, first = [], 0, 0
            for i in range(batch.num_rows):
                words = (column[i].as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes: the six white spaces only
                if texts and size + len(words) > _TOGETHER:
                    yield emit([ids.slice(first, i - first)], texts)
                    texts, size, first = [], 0, i
                texts.append(words)
                size += len(words)
            if texts:
                yield emit([ids.slice(first)], texts)

    return small_batches(docs).select(F.col(key), F.col(text).cast("string")).mapInArrow(search, schema)


def planted(key: Column, text: Column) -> Column:
    """The text with a periodic tail in a tenth of the documents, chosen and shaped by the CRC-32 of the key.

    With h = crc32(key) and g = h // 10, a text of n words with h % 10 = 0 keeps its first a = g % n words; the
    1 + (n - a) // (3 + g % 8) words from there on are repeated up to the old length, joined by one space. Others, and
    those with a null key or without words, stay as they are.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(text)


def planted_runs(docs: DataFrame) -> DataFrame:
    """``collapse`` of a documents table with periodic tails ``planted``."""
    text = planted(F.col("doc_id"), F.col("text").cast("string"))
    return collapse(docs.select("doc_id", text.alias("text")), keep_text=False).drop("n_words")
