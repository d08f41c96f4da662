"""Importance resampling: CRC-32 of spans, cutting of long texts, and drawn documents against a plain version."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tenora.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, weight int, bucket string, n_words int, place int"


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams_of(text, grams):
    words = words_of(text)
    return [" ".join(words[i:i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def by_hand(rows, target, grams, buckets=10_000, percent=10, min_words=20):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(place(f) for _, text in rows for f in grams_of(text, grams))
    t = collections.Counter(place(f) for text in target for f in grams_of(text, grams))
    alls, allt = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        found = grams_of(text, grams)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (alls + buckets) / ((s[b] + 1) * (allt + buckets)))) for b in map(place, found))
        name = "null" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words_of(text))])
    many = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for n, r in enumerate(many[: percent * len(many) // 100], 1):
        r[4] = n
    return [tuple(r[:5]) for r in out]


def test_crc_of_spans():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 30_000, dtype=np.uint8)
    first = rng.integers(0, 20_000, 300)
    last = first + rng.choice([1, 2, 7, 63, 64, 65, 128, 129, 500, 9000], 300)
    got = importance.crc32_spans(data, first, last)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(first, last)]
    assert len(importance.crc32_spans(data, first[:0], last[:0])) == 0


@pytest.mark.parametrize("grams", [1, 3])
def test_long_texts_are_cut_between_words(monkeypatch, grams):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "Bé", "x" * 90, "日本", "9!", "--"]) for _ in range(n)) for n in (0, 3, 200, 30, 1)]
    texts += [None, "y" * 700, "y" * 300 + " z"]
    monkeypatch.setattr(importance, "_AT_ONCE", 64)
    want, got = [collections.Counter(zlib.crc32(f.encode()) % 10_000 for f in grams_of(t, grams)) for t in texts], [collections.Counter() for _ in texts]
    words = np.zeros(len(texts), dtype=int)
    for at, n, owners, owner, found in importance._chunks(pa.array(texts), grams, 10_000):
        words[at:at + n] += np.bincount(owners, minlength=n)
        for i, b in zip(owner.tolist(), found.tolist()):
            got[at + i][b] += 1
    assert got == want and words.tolist() == [len(words_of(t)) for t in texts]


@pytest.mark.parametrize("grams", [1, 2])
def test_drawn_documents(spark, grams):
    rng = random.Random(3)
    vocabulary = ["the", "And", "haus", "Über", "x|y", "###", "日本", "q" * 100] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 19, 20, 60, 300])))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, rows[3][1]), (7, rows[7][1]), (7, rows[7][1]), (203, " ".join(rng.choices(vocabulary, k=20_000)))]
    rows += [(8, rows[7][1])] * 40
    target = [" ".join(rng.choices(vocabulary[:8], k=50)) for _ in range(9)] + [None]
    docs = spark.createDataFrame([(*r, 1, "b", 2, 3) for r in rows], DOCS).repartition(3)
    goal = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, doc_id int")
    got = importance.resample(spark, docs, goal, grams=grams)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows, target, grams), key=key)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_empty_tables(spark):
    docs, goal = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(spark, docs, goal).count() == 0
    some = spark.createDataFrame([(1, "a " * 25)], "doc_id long, text string")
    assert importance.resample(spark, some, goal, percent=100).first()["rank"] == 1
