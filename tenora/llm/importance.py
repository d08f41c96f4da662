"""Importance resampling towards a target text collection, with hashed features found by position-table CRC-32.

A feature is a run of consecutive words, its bucket the CRC-32 of its bytes. CRC-32 is affine over XOR: a message's
value is a constant of its length, XORed with one contribution for each byte that depends only on the byte and on its
distance from the end. So the contributions of all bytes of all features of many texts are looked up at once in a table
(distance, byte) and XORed per feature by ``bitwise_xor.reduceat``. Features longer than the table are cut into blocks
of its width, whose values are folded from the first block to the last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.llm.common import small_batches
from tenora.operators.keys import numbered
from tenora.session import stored

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Distances in the table. Features of more bytes are folded block by block.
WIDTH = 64
#: Bytes of text whose features are hashed at once; a longer text is cut between words.
_AT_ONCE = 1 << 21

# Fixed value: the reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def position_table(width: int = WIDTH) -> np.ndarray:
    """Contribution of a byte at each distance from the end of a message, as (distance, byte)."""
    table = np.zeros((width, 256), dtype=np.uint32)
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> 1) ^ np.uint32(_POLYNOMIAL), row >> 1)
    table[0] = row
    for d in range(1, width):
        table[d] = (table[d - 1] >> 8) ^ table[0][table[d - 1] & 0xFF]
    return table


_TABLE = position_table()
_FLAT = _TABLE.ravel()
_CONSTANTS = np.array([zlib.crc32(bytes(n)) for n in range(WIDTH + 1)], dtype=np.uint32)


def _beyond(state: np.ndarray) -> np.ndarray:
    """The linear states after WIDTH further zero bytes."""
    return np.bitwise_xor.reduce([_TABLE[WIDTH - 1 - j][(state >> np.uint32(8 * j)) & 0xFF] for j in range(4)])


def crc32_spans(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """CRC-32 of every span ``data[first:last]`` of at least one byte."""
    length = last - first
    if not len(length):
        return np.zeros(0, dtype=np.uint32)
    blocks = -(-length // WIDTH)
    opening = np.cumsum(blocks) - blocks  # each span's first block, which takes what is left over from whole blocks
    nth = np.arange(blocks.sum()) - np.repeat(opening, blocks)
    end = np.repeat(last - (blocks - 1) * WIDTH, blocks) + nth * WIDTH
    begin = np.where(nth, end - WIDTH, np.repeat(first, blocks))
    size = end - begin
    at = np.cumsum(size) - size
    byte = np.arange(size.sum()) + np.repeat(begin - at, size)
    values = _FLAT[((np.repeat(end, size) - 1 - byte) << 8) | data[byte]]
    part = np.bitwise_xor.reduceat(values, at)
    state = part[opening]
    for k in range(1, int(blocks.max())):
        rows = np.flatnonzero(blocks > k)
        state[rows] = _beyond(state[rows]) ^ part[opening[rows] + k]
    constant = _CONSTANTS[np.minimum(length, WIDTH)]
    for n in np.unique(length[length > WIDTH]).tolist():
        constant[length == n] = zlib.crc32(bytes(n))
    return state ^ constant


def _features(data: np.ndarray, bounds: np.ndarray, grams: int, buckets: int, known: int = 0) -> tuple[np.ndarray, ...]:
    """(text of each word, text of each feature, bucket of each feature) of texts ``data[bounds[i]:bounds[i + 1]]``.

    Features of which no word comes after the first ``known`` words are left out.
    """
    low = _LOWER[data]
    word = _IS_WORD[low]
    cut = np.zeros(len(low) + 1, dtype=bool)
    cut[bounds] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | cut[1:-1]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = np.searchsorted(bounds, starts, side="right") - 1
    size = ends - starts
    spaced = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)  # the words, one space after each
    spaced[np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)] = low[word]
    close = np.cumsum(size + 1) - 1
    texts, found = [], []
    for k in range(1, grams + 1):
        i = np.arange(max(0, known - k + 1), len(size) - k + 1)
        i = i[owner[i] == owner[i + k - 1]]
        texts.append(owner[i])
        found.append(crc32_spans(spaced, (close - size)[i], close[i + k - 1]) % np.uint32(buckets))
    return owner[known:], np.concatenate(texts), np.concatenate(found)


def _parts(text: bytes, grams: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts cut between words, each led by the last ``grams - 1`` words before it, and their number."""
    word, carried, at = _IS_WORD[_LOWER], [], 0
    while at < len(text):
        end = min(at + _AT_ONCE, len(text))
        piece = np.frombuffer(text, np.uint8, end - at, at)
        gaps = np.flatnonzero(~word[piece]) if end < len(text) else np.zeros(0)
        if end < len(text) and len(gaps):
            end = at + int(gaps[-1]) + 1
        while end < len(text) and not len(gaps):  # one word longer than a part
            step = np.frombuffer(text, np.uint8, min(_AT_ONCE, len(text) - end), end)
            gaps = np.flatnonzero(~word[step])
            end += int(gaps[0]) + 1 if len(gaps) else len(step)
        part = text[at:end]
        yield b" ".join([*carried, part]), len(carried)
        if grams > 1:
            tail = _LOWER[np.frombuffer(part, np.uint8)]
            tail[~_IS_WORD[tail]] = 32
            carried = (carried + tail.tobytes().split())[-(grams - 1):]
        at = end


def _chunks(column: pa.Array, grams: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, number of texts, *_features) over parts of a column of texts, in order; a long text comes in parts."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset))
    at = 0
    while at < len(sizes):
        if sizes[at] > _AT_ONCE:
            for part, known in _parts(column[at].as_py(), grams):
                yield at, 1, *_features(np.frombuffer(part, np.uint8), np.array([0, len(part)]), grams, buckets, known)
            at += 1
            continue
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _AT_ONCE, side="right")))
        data = b"".join(column[at:upto].to_pylist())
        bounds = np.concatenate([[0], np.cumsum(sizes[at:upto])])
        yield at, upto - at, *_features(np.frombuffer(data, np.uint8), bounds, grams, buckets)
        at = upto


def bucket_counts(docs: DataFrame, text: str = "text", grams: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any. At most ``buckets`` rows a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for *_, found in _chunks(batch.column(0), grams, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = small_batches(docs).select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(of_docs: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """What one feature of each bucket adds to a weight, from the counts of all buckets in documents and target."""
    s, t, extra = of_docs.astype(float), of_target.astype(float), float(len(of_docs))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + extra) / ((s + 1) * (t.sum() + extra)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", grams: int = 1) -> DataFrame:
    """(key, n_words, n_features, weight) of every document."""
    buckets = len(gain)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[
        T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    names = schema.names

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.zeros((3, batch.num_rows), dtype=np.int64)
            for at, n, words, texts, found in _chunks(batch.column(1), grams, buckets):
                got[0, at:at + n] += np.bincount(words, minlength=n)
                got[1, at:at + n] += np.bincount(texts, minlength=n)
                got[2, at:at + n] += np.bincount(texts, weights=gain[found], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, got)], names)

    return small_batches(docs).select(key, F.col(text).cast("string")).mapInArrow(weighed, schema)


def _totals(docs: DataFrame, text: str, grams: int, buckets: int) -> np.ndarray:
    total = np.zeros(buckets, dtype=np.int64)
    for r in bucket_counts(docs, text, grams, buckets).collect():  # at most ``buckets`` rows
        total[r["bucket"]] = r["n"]
    return total


def resample(
    spark: SparkSession, docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    grams: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document, the drawn ones ranked 1, 2, 3, ...

    Features are all runs of 1 to ``grams`` words of whole texts, lower-cased from A to Z only. A document's weight is
    the sum of its features' log ratios of target to documents; the score adds Gumbel noise from a hash of its id, so
    drawing the highest ``percent`` of those with ``min_words`` words samples without replacement by weight, the same on
    each rerun. Ties go to the smaller id, then to any order. A null or wordless text has no features, weight 0 and is
    never drawn; a null id is hashed as ``null`` and comes last among ties; repeated rows are each weighed and may each
    be drawn. Empty documents give no rows, and an empty target only lowers weights. Extra columns are ignored.

    The corpus is read twice. Bucket counts are summed inside each task first, so no key is ever crowded; scores are
    ranked through ``numbered``, which splits ties too.
    """
    gain = gains(_totals(docs, text, grams, buckets), _totals(target, target_text, grams, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weights = weigh(docs, gain, key, text, grams).withColumnRenamed(key, "doc_id")
    scored = weights.withColumn("score", F.col("weight") + noise)
    many = F.col("n_words") >= min_words
    scored = stored(spark, scored.select("doc_id", "n_features", "weight", "score", (~many).alias("short")), "scored")
    drawn = scored.filter(~F.col("short")).count() * percent // 100
    order = [F.col("short").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = numbered(spark, scored, order, "place")
    return ranked.select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))


#: ``resample`` of documents towards benchmark in SQL. CRC-32 is computed byte by byte, once for each distinct word.
SQL = f"""
WITH steps AS (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END) AS c FROM range(256) r(i)),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
dw AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(words) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark) GROUP BY w),
distinct_words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
b AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295,
      list_transform(range(len(x) // 2), lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) % {BUCKETS} AS bucket FROM distinct_words, tab),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS t FROM bw JOIN b USING (w) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS alls, coalesce((SELECT sum(t) FROM t), 0) AS allt),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (alls + {BUCKETS}.0) / ((s + 1) * (allt + {BUCKETS}.0)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
v AS (SELECT rid, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY rid),
e AS (SELECT doc_id, coalesce(len(words), 0) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN v USING (rid)),
r AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score,
    n_features < {MIN_WORDS} AS short FROM e),
o AS (SELECT *, row_number() OVER (PARTITION BY short ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY short) AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN NOT short AND place <= n * {PERCENT} // 100 THEN place END AS rank FROM o
"""
