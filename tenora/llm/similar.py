"""Texts whose sets of word shingles overlap, by SimHash fingerprints and then an exact similarity join on prefixes.

Each text has a SimHash fingerprint of its shingles, and Golay keys of it as in ``simhash``. Of the texts that share a
key, each is held against the one of the least fingerprint, if NEAR_BITS or fewer differ, and verified on the sets. So
near copies are linked in a linear number of pairs. What the fingerprints miss is found by the exact join:

All shingles have one order: by the count of their group of hashes, then by hash. Two sets of the least similarity or
more share a shingle among the first fifth of both, so only those first fifths are joined, and no pair can be missed.
Passages that many documents share make their groups larger, so they come late in the order and bring few texts together.

Texts that share a shingle are first held against one of them: the most central one, whose shingles most others share,
and then one of any part still apart. Near copies of one text are so linked in a linear number of pairs. Pairs that are
still apart after ROUNDS of this are compared, but only if the places of the shared shingle leave room for enough others.

Pairs are first held against each other by sketches of a few bits a shingle, which tell nearly all that are not alike. Sets
are never stored for all texts, but hashed again from the texts of the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenora.llm.common import discard, release, settled, small_batches
from tenora.llm.components import components
from tenora.llm.fingerprints import BLOCK, keyed, majority

SHINGLE_WORDS = 5
#: Least similarity, as a fraction of whole numbers.
LEAST, OF = 4, 5
ROUNDS = 2
#: Differing bits up to which two fingerprints that share a key are verified; alike texts of the given tables differ in up to 11.
NEAR_BITS = 11
#: Shingles below this, a quarter of all, are in one list of a set, the others in a second.
LOW = -(1 << 62)
#: Keys of the prefixes are dealt into so many parts that are joined one after another, so that not all are in a shuffle at once.
PARTS = 4
#: Pairs whose sketches or sets are in a shuffle at once, as a share of the texts; what is more goes in parts.
SKETCHED, COMPARED = 4, 0.25
#: Shingles are counted and ordered by the leading bits of their hash, which bounds what is sent to the tasks (4 MB).
GROUP_BITS = 18
#: Rows of a table with 64 bits each that marks wanted nodes; as many bits bound what is sent to the tasks.
MARKS = 1 << 17
#: Least bits of a sketch for each shingle.
SKETCH_BITS = 2


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.empty(0, dtype=np.int64)
    n, joined, digest = max(1, len(words) - SHINGLE_WORDS + 1), memoryview(b" ".join(words)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist())
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in spans), np.uint64, n).view(np.int64))


def shingles_of(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles of one text; a text with fewer words is one shingle, one without words has none."""
    return _hashes(_words(text))


def _groups(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - GROUP_BITS)).astype(np.int64)


def prefix_of(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray, named: np.ndarray | None = None) -> np.ndarray:
    """The shingles of one text, given by rising hash, of which a text that is alike holds one: the first by count and hash.

    ``named`` holds what ``frequent`` lists by rising value, for each shingle; left out, those are the shingles themselves.
    """
    if not len(shingles):
        return shingles
    size, rank = len(shingles), np.zeros(len(shingles), dtype=np.int64)
    if len(frequent):
        named = shingles if named is None else named
        at = np.minimum(np.searchsorted(frequent, named), len(frequent) - 1)
        rank = np.where(frequent[at] == named, counts[at], 0)
    return shingles[np.argsort(rank, kind="stable")[: size - -(-LEAST * size // OF) + 1]]


@F.pandas_udf(T.BinaryType())
def _digests(texts: pd.Series) -> pd.Series:
    return pd.Series([xxhash.xxh3_128_digest(b" ".join(_words(t))) for t in texts], dtype=object)


def node(text: Column) -> Column:
    """The same for texts of the same words up to case and white space."""
    return _digests(text)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def fingerprint_of(shingles: np.ndarray) -> int:
    """SimHash of distinct shingles as a signed number; 0 for none."""
    if not len(shingles):
        return 0
    parts = (shingles[at : at + BLOCK] for at in range(0, len(shingles), BLOCK))
    return int(np.uint64(majority(parts, len(shingles))).view(np.int64))


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit, in a power of two of words; SKETCH_BITS a shingle or more.

    Sketches of two sets differ in no more bits than the sets in shingles. The halves of a sketch make one of half its bits.
    """
    bits = 64 << max(0, (SKETCH_BITS * len(shingles) - 1).bit_length() - 6)
    odd = np.bincount((shingles & (bits - 1)), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _halves(found: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Where the shingles below LOW lie in each sorted set, and where the others."""
    cut = [int(np.searchsorted(x, LOW)) for x in found]
    return [(0, c) for c in cut], [(c, len(x)) for x, c in zip(found, cut)]


def _hashed(
    batches: Iterator[pa.RecordBatch], marks: np.ndarray | None = None,
) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """The nodes and sets of the texts of each batch, or of those texts only whose nodes have a mark."""
    known: set[bytes] = set()  # copies within a task, so that a text has at most one row a task
    for batch in batches:
        nodes, found = [], []
        for text in batch.column(0).to_pylist():
            words = _words(text)
            node = xxhash.xxh3_128_digest(b" ".join(words))
            if node not in known and (marks is None or marked(marks, node)):
                known.add(node), nodes.append(node), found.append(_hashes(words))
        yield nodes, found
    release()


def _described(nodes: list[bytes], found: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(nodes, pa.binary()), pa.array([len(x) for x in found], pa.int32()),
            pa.array([fingerprint_of(x) for x in found], pa.int64()), _lists([sketch_of(x) for x in found])]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nodes, found in _hashed(batches):
        yield pa.RecordBatch.from_arrays(_described(nodes, found), ["node", "size", "fp", "sketch"])


def _shingled(batches: Iterator[pa.RecordBatch], marks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for nodes, found in _hashed(batches, marks):
        halves = [_lists([x[a:b] for x, (a, b) in zip(found, ends)]) for ends in _halves(found)]
        yield pa.RecordBatch.from_arrays([*_described(nodes, found), *halves], ["node", "size", "fp", "sketch", "low", "rest"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << GROUP_BITS, dtype=np.int64)
    for _, found in _hashed(batches):
        counts += np.bincount(_groups(np.concatenate([*found, np.empty(0, np.int64)])), minlength=len(counts))
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["group", "n"])


DESCRIBED = "node binary, size int, fp long, sketch array<long>"


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return small_batches(docs).select(F.col(text).cast("string").alias("text"))


def sets(spark: SparkSession, docs: DataFrame, text: str = "text", nodes: DataFrame | None = None) -> DataFrame:
    """(node, size, fp, sketch, low, rest) of every text, its shingles below LOW and the others by rising hash.

    Copies of a text that met in different tasks repeat its row. Of ``nodes``, if given, all are returned, and few others;
    their marks are tested where the texts are hashed, as a second worker for each task would need memory of its own.
    """
    marks = None if nodes is None else _marks(nodes).toArrow()  # at most MARKS rows
    if marks is not None:
        bits = np.zeros(MARKS, dtype=np.int64)
        bits[marks["mark_row"].to_numpy()] = marks["marked"].to_numpy()
        marks = spark.sparkContext.broadcast(bits)

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shingled(batches, marks and marks.value)

    return _texts(docs, text).mapInArrow(shingled, f"{DESCRIBED}, low array<long>, rest array<long>")


def described(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, size, fp, sketch) of every text, stored. Copies that met in different tasks repeat a row."""
    return settled(spark, _texts(docs, text).mapInArrow(_sketched, DESCRIBED), "texts")


def _mark() -> tuple[Column, Column]:
    """The row and the bit that mark a node."""
    h, one = F.xxhash64("node"), F.lit(1).cast("long")
    return F.pmod(h, F.lit(MARKS)).cast("int"), F.call_function("shiftleft", one, F.shiftrightunsigned(h, 58).cast("int"))


def marked(marks: np.ndarray, node: bytes) -> bool:
    """Whether a node's bit is set, as by ``_mark``."""
    h = xxhash.xxh64_intdigest(node, 42)  # the hash and seed of F.xxhash64
    return bool(int(marks[h & (MARKS - 1)]) >> (h >> 58) & 1)


def _marks(nodes: DataFrame) -> DataFrame:
    row, bit = _mark()
    return nodes.groupBy(row.alias("mark_row")).agg(F.bit_or(bit).alias("marked"))


def _among(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Column]:
    """The rows, and whether their node may be among the given ones: always true for those, seldom for others.

    The given nodes are marked in a table of bits of bounded size, so neither they nor the rows are shuffled.
    """
    row, bit = _mark()
    return (rows.join(F.broadcast(_marks(nodes)), row == F.col("mark_row"), "left"),
            F.coalesce(F.col("marked").bitwiseAND(bit) != 0, F.lit(False)))


def _counts(spark: SparkSession, docs: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The groups of hashes by rising number, and how many shingles of texts each has. Any order of shingles is right."""
    counts = settled(spark, _texts(docs, text).mapInArrow(_counted, "group long, n long").groupBy("group").agg(
        F.sum("n").alias("n")), "groups")
    got = counts.orderBy("group").toArrow()  # at most 2 ** GROUP_BITS rows
    return got["group"].to_numpy(), got["n"].to_numpy()


def _prefixes(spark: SparkSession, docs: DataFrame, text: str) -> DataFrame:
    """(node, size, place, key, n) of all shingles of the prefixes that several texts have in theirs, stored."""
    order = spark.sparkContext.broadcast(_counts(spark, docs, text))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, counts = order.value
        for nodes, found in _hashed(batches):
            first = [prefix_of(x, groups, counts, _groups(x)) for x in found]
            sizes = pa.array([len(x) for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), sizes, _lists(first)], ["node", "size", "keys"])

    listed = _texts(docs, text).mapInArrow(prefixes, "node binary, size int, keys array<long>")
    listed = settled(spark, listed.select("node", "size", F.posexplode("keys").alias("place", "key")), "prefixes")
    shared = None
    for part in range(PARTS):
        mine = listed.filter(F.pmod(F.xxhash64("key"), F.lit(PARTS)) == part)
        several = settled(spark, mine.select("key", F.xxhash64("node").alias("text")).groupBy("key").agg(
            F.count("*").alias("n"), F.min("text").alias("a"), F.max("text").alias("b")).filter("a < b").select("key", "n"), "shared-keys")
        one = settled(spark, mine.join(several, "key"), "shared-prefixes")
        shared = one if shared is None else shared.union(one)
    discard(spark, listed)
    return shared


def _room(a: tuple[str, str], b: tuple[str, str]) -> Column:
    """Whether two texts can be alike whose first shared shingle has these places, from (size, place) of both."""
    most = F.least(F.col(a[0]) - F.col(a[1]), F.col(b[0]) - F.col(b[1]))
    return most * (LEAST + OF) >= LEAST * (F.col(a[0]) + F.col(b[0]))


def _joined(spark: SparkSession, pairs: DataFrame, rows: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(pairs with size_u, size_v, of_u, of_v, the table to discard after). ``rows`` returns (node, size, of) of asked nodes."""
    asked = settled(spark, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "asked")
    wanted = settled(spark, rows(asked).dropDuplicates(["node"]), "wanted")
    both = pairs.select("u", "v")
    for k in "uv":
        both = both.join(wanted.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("of").alias(f"of_{k}")), k)
    return both, wanted


def _differing() -> Column:
    """In how many bits the sketches of_u and of_v differ, the longer of them folded. Alike texts' lengths are at most a half apart."""
    def folded(a: str, b: str) -> Column:
        half = (F.size(a) / 2).cast("int")
        halves = F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(a) > F.size(b), halves).otherwise(F.col(a))

    bits = F.zip_with(folded("of_u", "of_v"), folded("of_v", "of_u"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda total, n: total + n)


def _verified(
    spark: SparkSession, pairs: DataFrame, found: DataFrame, whole: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The pairs (u, v) whose sets are alike. Those stay that could be by their sketches, then the sets are compared.

    ``found`` has (node, size, sketch) of all texts. ``whole`` returns (node, size, low, rest) of the given nodes at least;
    left out, they are in ``found``.
    """
    def chosen(nodes: DataFrame) -> DataFrame:
        rows, may = _among(found, nodes)
        return rows.filter(may)

    def sketches(nodes: DataFrame) -> DataFrame:
        return chosen(nodes).select("node", "size", F.col("sketch").alias("of"))

    def lists(nodes: DataFrame) -> DataFrame:
        return (whole or chosen)(nodes).select("node", "size", F.concat("low", "rest").alias("of"))

    sizes, common, total = F.col("size_u") + F.col("size_v"), F.size(F.array_intersect("of_u", "of_v")), found.count()
    for name, rows, most, alike in (
            ("possible", sketches, SKETCHED, _differing() * (LEAST + OF) <= (OF - LEAST) * sizes),
            ("alike", lists, COMPARED, common * (LEAST + OF) >= LEAST * sizes)):
        if not (n := pairs.count()):
            break
        parts, left = 1 + int(n / (most * total)), None
        for part in range(parts):  # by v, which many pairs may share
            both, wanted = _joined(spark, pairs.filter(F.pmod(F.xxhash64("v"), F.lit(parts)) == part), rows)
            one = settled(spark, both.filter(alike).select("u", "v"), name)
            discard(spark, wanted)
            left = one if left is None else left.union(one)
        pairs = left
    return pairs


def _ordered(pairs: DataFrame) -> DataFrame:
    """(u, v) with u > v from pairs (node, other)."""
    return pairs.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def _near(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Pairs u > v of nodes whose fingerprints are near: of texts sharing a Golay key, each with that of the least fingerprint.

    Texts of one fingerprint are paired with one of them, which stands for it.
    """
    texts = found.filter("size > 0").select("node", "size", "fp")
    standing = settled(spark, texts.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first")).select("fp", "first.*"), "fingerprints")
    keys = settled(spark, standing.select("fp").mapInArrow(keyed, "fp long, key long"), "golay-keys")
    heads = keys.groupBy("key").agg(F.min("fp").alias("head"), F.max("fp").alias("last")).filter("head < last").select("key", "head")
    near = settled(spark, keys.join(heads, "key").filter((F.col("fp") != F.col("head")) & (
        F.bit_count(F.col("fp").bitwiseXOR(F.col("head"))) <= NEAR_BITS)).select("fp", "head").distinct(), "near")
    discard(spark, keys)
    head = standing.select(F.col("fp").alias("head"), F.col("node").alias("other"), F.col("size").alias("other_size"))
    pairs = near.join(standing, "fp").join(head, "head").select("node", "size", "other", "other_size")
    same = texts.join(head, F.col("fp") == F.col("head")).filter("node <> other").select("node", "size", "other", "other_size")
    alike = F.least("size", "other_size") * OF >= LEAST * F.greatest("size", "other_size")
    return settled(spark, _ordered(pairs.union(same).filter(alike)), "near-pairs")


def links(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """Pairs u > v of nodes that connect all texts at the least similarity or above, directly or through others."""
    found = described(spark, docs, text)

    def whole(nodes: DataFrame) -> DataFrame:
        return sets(spark, docs, text, nodes)

    seen = _near(spark, found)
    edges = _verified(spark, seen, found, whole)
    shared = _prefixes(spark, docs, text)
    central = shared.groupBy("node").agg(F.sum("n").alias("central"))
    places = settled(spark, shared.join(central, "node").select("node", "size", "place", "key", "central").distinct(), "keyed")
    discard(spark, shared)
    for turn in range(ROUNDS + 1):
        roots = components(spark, edges)
        rows, may = _among(places, roots)
        linked = rows.filter(may).select(*places.columns).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        state = linked.unionByName(rows.filter(~may).select(*places.columns, F.col("node").alias("root")))
        first = F.struct(-F.col("central"), "node") if not turn else F.struct(F.xxhash64("root", "key", F.lit(turn)), F.xxhash64("node"))
        heads = state.groupBy("key").agg(
            F.min_by(F.struct("node", "size", "place", "root"), first).alias("head"),
            (F.min("root") < F.max("root")).alias("parted")).filter("parted")
        heads = heads.select("key", *[F.col(f"head.{c}").alias(f"head_{c}") for c in ("node", "size", "place", "root")])
        near = _room(("size", "place"), ("head_size", "head_place"))
        if turn < ROUNDS:
            pairs = state.join(heads, "key").filter((F.col("root") != F.col("head_root")) & near).select(
                "node", F.col("head_node").alias("other"))
        else:  # every pair of two parts: texts of other parts than the head's with all texts
            state = settled(spark, state.join(heads.select("key", "head_root"), "key"), "parted")
            other = state.select("key", F.col("node").alias("other"), *[F.col(c).alias(f"other_{c}") for c in ("size", "place", "root")])
            once = (F.col("other_root") == F.col("head_root")) | (F.col("node") > F.col("other"))
            pairs = state.filter("root <> head_root").join(other, "key").filter(
                (F.col("root") != F.col("other_root")) & once & _room(("size", "place"), ("other_size", "other_place")))
        pairs = settled(spark, _ordered(pairs).join(seen, ["u", "v"], "left_anti"), "pairs")
        seen = seen.union(pairs)
        edges = edges.union(_verified(spark, pairs, found, whole))
    discard(spark, found), discard(spark, places)
    return edges.distinct()
