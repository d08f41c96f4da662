"""Passages that repeat across documents, found level by level: windows repeated at one length are extended to twice it.

The first level looks at windows of about half the least length. Of those inside each least window only the one with the
smallest hash stands for it, the same wherever the window occurs, so a quarter of the places are shuffled and no repeat
is lost. Only least windows that hold a repeated one are hashed (128 bits) and counted. From then on a window of twice
the length is a candidate if both its halves repeat, its hash is made of theirs, and the levels go on until no
candidate repeats. Every level is one count of hashes and one join with those that occur in two documents, so a passage
in very many documents costs partial counts and a split join, never a group in one task. Documents with the same words
throughout are one document to all levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.llm.common import discard, settled, small_batches

#: Words of the shortest window that counts as a repeat.
LEAST = 13
#: Bytes of text, or words of one long text, that are hashed together.
_TOGETHER = 1 << 21
#: Stands for an unknown id, which is larger than all others.
_UNKNOWN = (1 << 63) - 1

_RNG = np.random.default_rng(13)
_FACTORS = _RNG.integers(1, 1 << 63, (3, 4096), dtype=np.uint64) | np.uint64(1)
_BYTE_FACTORS = _RNG.integers(1, 1 << 63, (2, 4096), dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: the six white spaces only


def _scrambled(total: np.ndarray) -> np.ndarray:
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


def _factors(table: np.ndarray, size: int) -> np.ndarray:
    turns = np.arange(size, dtype=np.uint64) // np.uint64(table.shape[1])
    return np.resize(table, (size,)) if size <= table.shape[1] else np.resize(table, (size,)) * (turns * np.uint64(2) + np.uint64(1))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, hashes as (2, n), the words with one space after each) of the words in a stretch of bytes.

    The two 64-bit hashes of a word are independent: sums of its bytes by random factors of their places.
    """
    word = ~_SPACE[data]
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(np.concatenate([before[1:] & ~word[1:], word[-1:]])) + 1
    size = ends - starts
    spaced = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    letters = data[word]
    spaced[place + np.repeat(begin, size)] = letters
    if not len(size):
        return starts, np.zeros((2, 0), dtype=np.uint64), spaced
    longest, at = int(size.max()), np.cumsum(size) - size
    hashes = np.stack([
        _scrambled(np.add.reduceat((letters + np.uint64(1)) * f[place], at) + f[size])
        for f in (_factors(_BYTE_FACTORS[k:k + 1], longest + 1) for k in (0, 1))])
    return starts, hashes, spaced


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int, family: int) -> np.ndarray:
    """64-bit hashes of the windows of ``size`` words at ``starts``; families are independent of each other."""
    factors = _factors(_FACTORS[family:family + 1], size)
    total = np.zeros(len(starts), dtype=np.uint64)
    for k in range(size):
        total += words[starts + k] * factors[k]
    return _scrambled(total)


def first_size(least: int) -> int:
    return (least + 1) // 2


def _standing(words: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For k = 0, 1, ...: (first-level hashes, least windows, which of them the first-level window k words in stands for).

    Texts end at ``ends``; of equal smallest hashes all stand for the window.
    """
    size, n = first_size(least), len(words)
    if n < least:
        return
    hashes = window_hashes(words, np.arange(n - size + 1), size, 0)
    inside, starts = least - size + 1, np.arange(n - least + 1)
    smallest = np.minimum.reduce([hashes[k:k + len(starts)] for k in range(inside)])
    whole = ends[np.searchsorted(ends, starts, side="right")] - starts >= least
    for k in range(inside):
        yield hashes, starts, whole & (hashes[k:k + len(starts)] == smallest)


def representatives(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the first-level windows that stand for a window of ``least`` words; texts end at ``ends``."""
    chosen, hashes = np.zeros(len(words), dtype=bool), np.zeros(0, dtype=np.uint64)
    for k, (hashes, starts, stands) in enumerate(_standing(words, ends, least)):
        chosen[k:k + len(starts)] |= stands
    places = np.flatnonzero(chosen)
    return places, hashes[places]


def represented(words: np.ndarray, ends: np.ndarray, least: int, places: np.ndarray) -> np.ndarray:
    """Starts of the windows of ``least`` words that a first-level window at one of ``places`` (flags) stands for."""
    found = np.zeros(len(words), dtype=bool)
    for k, (_, starts, stands) in enumerate(_standing(words, ends, least)):
        found[:len(starts)] |= stands & places[k:k + len(starts)]
    return np.flatnonzero(found)


def _pieces(text: bytes) -> Iterator[np.ndarray]:
    """A text in pieces of about _TOGETHER bytes, cut at white space."""
    data, at = np.frombuffer(text, dtype=np.uint8), 0
    while at < len(data):
        end = at + _TOGETHER
        while end < len(data) and not (gaps := np.flatnonzero(_SPACE[data[end:end + _TOGETHER]])).size:
            end += _TOGETHER
        end = min(len(data), end + (int(gaps[0]) if end < len(data) else 0))
        yield data[at:end]
        at = end


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
    """(first row, words of each row, hashes of all words, digest of each row's words) of groups of texts."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)) if len(column) else []
    at = 0
    while at < len(sizes):
        if sizes[at] > _TOGETHER:
            digest, found = xxhash.xxh3_128(), []
            for piece in _pieces(column[at].as_py()):
                _, hashes, spaced = word_hashes(piece)
                digest.update(spaced), found.append(hashes)
            hashes = np.concatenate(found, axis=1)
            yield at, np.array([hashes.shape[1]]), hashes, [digest.digest()]
            at += 1
            continue
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _TOGETHER, side="right")))
        part = np.frombuffer(b" ".join(column[at:upto].to_pylist()), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum(sizes[at:upto] + 1)])
        starts, hashes, spaced = word_hashes(part)
        cut = np.searchsorted(starts, bounds)
        gaps = np.flatnonzero(spaced == 32) + 1
        edges = np.concatenate([[0], gaps])[cut]
        view = memoryview(spaced)
        yield at, np.diff(cut), hashes, [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        at = upto


def _stretches(first: int, counts: np.ndarray, hashes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, offsets, hashes, ends): what is searched together, a group of texts or a part of a long one.

    Parts of a text overlap by one word less than a window, so every window lies in exactly one of them.
    """
    if len(counts) > 1 or counts[0] <= _TOGETHER:
        yield np.arange(first, first + len(counts)), np.zeros(len(counts), dtype=np.int64), hashes, np.cumsum(counts)
        return
    for at in range(0, int(counts[0]) - least + 1, _TOGETHER):
        part = hashes[:, at:at + _TOGETHER + least - 1]
        yield np.array([first]), np.array([at]), part, np.array([part.shape[1]])


def _first_level(docs: DataFrame, least: int) -> DataFrame:
    """The representative windows of every text as (h, id, at), and one row (id, t, words, n) for each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, counts, hashes, digests in _texts(batch.column(2)):
                none, own = pa.nulls(len(counts), pa.int64()), slice(first, first + len(counts))
                yield pa.RecordBatch.from_arrays(
                    [none, batch.column(0)[own], none.cast(pa.int32()), batch.column(1)[own], pa.array(digests, pa.binary()), pa.array(counts)], names)
                for rows, offsets, part, ends in _stretches(first, counts, hashes, least):
                    place, h = representatives(part[0], ends, least)
                    text = np.searchsorted(ends, place, side="right")
                    begins = np.concatenate([[0], ends[:-1]])
                    at = place - begins[text] + offsets[text]
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(ids[rows[text]]), pa.array(at.astype(np.int32)), none,
                         pa.nulls(len(at), pa.binary()), none], names)

    names = ["h", "id", "at", "t", "words", "n"]
    return docs.select("id", "t", "text").mapInArrow(find, "h long, id long, at int, t long, words binary, n long")


def _columns(rows: np.ndarray, ids: np.ndarray, us: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(ids[rows]), pa.array(us[rows]), pa.array(at.astype(np.int32)), pa.array(a.view(np.int64)),
        pa.array((b >> np.uint64(32)).astype(np.uint32).view(np.int32)),
    ], ["id", "u", "at", "a", "b"])


#: A window's text (id, u), place and hash of 96 bits.
_WINDOWS = "id long, u long, at int, a long, b int"


def _least_windows(suspects: DataFrame, least: int) -> DataFrame:
    """(id, u, at, a, b): windows of ``least`` words for which one of the text's repeated first-level windows stands."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, us = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for first, counts, hashes, _ in _texts(batch.column(2)):
                for rows, offsets, part, ends in _stretches(first, counts, hashes, least):
                    begins, flags = np.concatenate([[0], ends[:-1]]), np.zeros(part.shape[1], dtype=bool)
                    asked = batch.column(3).take(pa.array(rows))
                    text = np.repeat(np.arange(len(rows)), asked.value_lengths().to_numpy())
                    place = asked.flatten().to_numpy() - offsets[text] + begins[text]
                    flags[place[(place >= begins[text]) & (place < ends[text])]] = True
                    at = represented(part[0], ends, least, flags)
                    text = np.searchsorted(ends, at, side="right")
                    a, b = (window_hashes(part[f - 1], at, least, f) for f in (1, 2))
                    yield _columns(rows[text], ids, us, at - begins[text] + offsets[text], a, b)

    return suspects.select("id", "u", "text", "places").mapInArrow(find, _WINDOWS)


def _mixed(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, family: int) -> np.ndarray:
    return window_hashes(np.concatenate([a, b, c, d]).reshape(4, -1).T.ravel(), 4 * np.arange(len(a)), 4, family)


def _doubled(windows: DataFrame, size: int) -> DataFrame:
    """(id, u, at, a, b): windows of twice the size whose two halves are among a text's ``windows``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, us = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for first in range(0, batch.num_rows, 256):
                part = batch.column(2).slice(first, 256)
                row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                flat = part.flatten()
                at, a, b = (flat.field(k).to_numpy() for k in range(3))
                place = (row << 32) + at
                order = np.argsort(place)
                place, row, at, a, b = place[order], row[order], at[order], a[order].view(np.uint64), b[order].astype(np.uint64)
                half = np.searchsorted(place, place + size)
                one = np.flatnonzero(place[np.minimum(half, len(place) - 1)] == place + size)
                two = half[one]
                found = (_mixed(a[one], b[one], a[two], b[two], f) for f in (1, 2))
                yield _columns(first + row[one], ids, us, at[one], *found)

    return windows.select("id", "u", "windows").mapInArrow(find, _WINDOWS)


def _in_two(spark: SparkSession, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, least_id): the hashes that occur in two documents, with the smallest id of one; a row a key."""
    seen = windows.groupBy(*keys).agg(F.min("id").alias("least_id"), F.max("id").alias("most_id"))
    return settled(spark, seen.filter("least_id < most_id").drop("most_id"), "keys").hint("shuffle_hash")


def _repeated(spark: SparkSession, windows: DataFrame) -> DataFrame:
    """(id, u, windows): each text's windows (at, a, b, later) that occur in two documents.

    ``later`` says that one of them has a smaller id. A text's windows are at most as many as its words.
    """
    later = (F.col("least_id") < F.col("id")).alias("later")
    kept = windows.join(_in_two(spark, windows, ["a", "b"]), ["a", "b"]).select("id", "u", "at", "a", "b", later)
    by_text = kept.repartition("id", "u").groupBy("id", "u")
    return settled(spark, by_text.agg(F.collect_list(F.struct("at", "a", "b", "later")).alias("windows")), "windows")


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t, key, text) with ``t`` a hash that tells texts of one id apart."""
    known = F.coalesce(F.col(key).cast("long"), F.lit(_UNKNOWN))
    whole = F.col(text).cast("string")
    return small_batches(docs).select(known.alias("id"), F.xxhash64(whole).alias("t"), F.col(key).alias("key"), whole.alias("text"))


def levels(
    spark: SparkSession, texts: DataFrame, first: DataFrame, own: DataFrame, least: int = LEAST, longest: int | None = None,
) -> Iterator[tuple[int, DataFrame]]:
    """(size, windows) for the least size and its doublings, until none repeats or ``longest`` is passed.

    ``texts`` has (id, t, text), ``first`` its settled ``_first_level``, which is deleted, and ``own`` the (id, t, u) of
    one row for each different sequence of words, (id, u) telling them apart. Windows are those of ``_repeated``; a
    level's table is deleted when the one after the next is asked for.
    """
    places = first.filter("h is not null").select("h", "id", "at")
    found = places.join(_in_two(spark, places, ["h"]), "h").select("id", "at").repartition("id")
    places = settled(spark, found.groupBy("id").agg(F.collect_list("at").alias("places")), "places")
    discard(spark, first)
    asked = own.join(places, "id")
    suspects = texts.select("id", "t", "text").join(asked, ["id", "t"]).dropDuplicates(["id", "t"]).drop("t")
    before = suspects = settled(spark, suspects, "suspects")
    size, windows = least, _repeated(spark, _least_windows(suspects, least))
    while not windows.isEmpty():
        yield size, windows
        discard(spark, before)
        if longest is not None and 2 * size > longest:
            return
        before, windows = windows, _repeated(spark, _doubled(windows, size))
        size *= 2


def _covered(later: DataFrame, least: int) -> DataFrame:
    """(id, u, spans): the words that windows starting at the places ``at`` cover, as sorted (start, length)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for places in batch.column(2):
                at = np.sort(places.values.to_numpy())
                opens = np.flatnonzero(np.diff(at, prepend=at[0] - least - 1) > least)
                ends = at[np.append(opens[1:], len(at)) - 1] + least
                found.append([{"start": s, "length": e - s} for s, e in zip(at[opens].tolist(), ends.tolist())])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["id", "u", "spans"])

    return later.mapInArrow(join, "id long, u long, spans array<struct<start:int,length:int>>")


def spans(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(id, t, spans, longest) of every document with words to remove; spans are sorted (start, length) without overlap.

    ``id`` is the key, the largest long if null, and ``t`` the hash of the text. See ``without_repeats``.
    """
    marked = _marked(docs, key, text)
    first = settled(spark, _first_level(marked, least), "first-windows")
    told = first.filter("h is null").select("id", "t", "words", "n")
    one = told.groupBy("words").agg(F.min("id").alias("least_id"))
    only = told.groupBy("id").agg((F.min("t") == F.max("t")).alias("only"))  # most ids have one text, which needs no hash
    told = told.join(one, "words").join(only, "id").select("id", "t", "n", "least_id", F.when(~F.col("only"), F.col("t")).otherwise(0).alias("u"))
    told = settled(spark, told.distinct(), "classes")
    own = told.filter(F.col("id") == F.col("least_id")).select("id", "t", "u")
    parts, sizes = None, None
    for size, windows in levels(spark, marked, first, own, least):
        later = windows.select("id", "u", F.expr("transform(filter(windows, w -> w.later), w -> w.at)").alias("at")).filter("size(at) > 0")
        if parts is None:
            parts = settled(spark, _covered(later, least), "parts")
        reached = settled(spark, later.select("id", "u", F.lit(size).alias("longest")), "reached")
        sizes = reached if sizes is None else sizes.union(reached)
    copies = told.filter((F.col("id") > F.col("least_id")) & (F.col("n") >= least))
    doubled = F.length(F.bin(F.floor(F.col("n") / least))) - 1  # how often the window can be doubled
    whole = copies.select(
        "id", "t", F.array(F.struct(F.lit(0).cast("int").alias("start"), F.col("n").cast("int").alias("length"))).alias("spans"),
        (least * F.pow(F.lit(2.0), doubled)).cast("long").alias("longest"))
    if parts is None:
        return settled(spark, whole, "spans")
    parts = parts.join(sizes.groupBy("id", "u").agg(F.max("longest").cast("long").alias("longest")), ["id", "u"])
    parts = parts.join(own, ["id", "u"]).drop("u")
    return settled(spark, parts.unionByName(whole), "spans")


def without_repeats(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, n_removed, longest, text) of every row, without the words that repeat a document before it.

    A word goes if a window of ``least`` words covers it whose word sequence also starts in a document with a smaller
    id; windows are judged on the input. ``text`` is the words left, joined by one space, and ``longest`` the largest
    of ``least``, twice that, ... at which a window of the document repeats one of a smaller id (0: none). Ids are
    whole numbers. A null id is larger than all others, rows of one id do not repeat each other, and repeated rows all
    get the same result. Null, empty and wordless texts, and those of fewer words than ``least``, lose nothing. Extra
    columns are ignored; an empty table gives no rows.
    """
    found = spans(spark, docs, key, text, least)
    joined = _marked(docs, key, text).join(found, ["id", "t"], "left").select("key", "text", "spans", "longest")
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *T._parse_datatype_string(
        "n_words long, n_removed long, longest long, text string").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            for body, parts in zip(batch.column(1), batch.column(2)):
                words = _words(body.as_py())
                total.append(len(words))
                for part in reversed(parts.as_py() or []):
                    del words[part["start"]:part["start"] + part["length"]]
                removed.append(total[-1] - len(words)), kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), batch.column(3).fill_null(0),
                 pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    return joined.mapInArrow(cut, schema)

