"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from tenora.llm import periodic
from tenora.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def runs_by_hand(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(6, 4 * q) and not any(start == s and q % p == 0 and length <= m for s, m, p in found):
                w = words[start:start + length]
                if all(w[d:] != w[:-d] for d in range(1, q)):
                    found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted_by_hand(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def row_by_hand(words):
    runs = runs_by_hand(words)
    dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    listed = "".join("%d,%d,%d\n" % r for r in runs).encode()
    return (len(runs), *top, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()), kept


def looped(rng, size, alphabet):
    words = [b"%d" % rng.randrange(alphabet) for _ in range(size)]
    for _ in range(rng.randint(0, 3)):
        p, at = rng.randint(1, 12), rng.randint(0, len(words))
        base = [b"%d" % rng.randrange(alphabet) for _ in range(p)]
        words[at:at] = [base[i % p] for i in range(rng.randint(0, 6 * p))]
    return words


def test_runs_of_random_texts():
    rng = random.Random(3)
    for _ in range(300):
        texts = [looped(rng, rng.choice([0, 1, 5, 6, 7, 12, 30, 80, 200]), rng.choice([1, 2, 2, 3, 5, 50])) for _ in range(rng.randint(1, 6))]
        for words, got in zip(texts, periodic.runs_of(texts)):
            assert [tuple(r) for r in got.tolist()] == runs_by_hand(words), words


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 700, 500)
    tree = periodic.WaveletTree(values, 700)
    a = rng.integers(0, 400, 200)
    b = a + rng.integers(1, 100, 200)
    x = rng.integers(0, 701, 200)
    assert tree.below(a, b, x).tolist() == [(values[i:j] < k).sum() for i, j, k in zip(a, b, x)]
    n = (b - a) // 2
    assert tree.nth(a, b, n).tolist() == [sorted(values[i:j])[k] for i, j, k in zip(a, b, n)]


def test_collapse(spark):
    rng = random.Random(4)
    rows = [(i, b" ".join(looped(rng, 40, 3)).decode()) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t"), (None, rows[5][1]), (5, rows[5][1]), (63, "é " * 9 + "x y"), (64, "ab cd\n" * 40_000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_runs int, start string").repartition(3)
    got = sorted(map(tuple, periodic.collapse(docs).collect()), key=str)
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        if doc_id == 64:
            listed, kept = (b"0,80000,2\n"), b"ab cd"
            row = (1, 0, 80_000, 2, 40_000_000, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())
        else:
            row, kept = row_by_hand(words)
        want.append((doc_id, len(words), *row, kept.decode()))
    assert got == sorted(want, key=str)
    assert periodic.collapse(docs.limit(0)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(d, *row_by_hand(planted_by_hand(d, t))[0]) for d, t in docs if len((t or "").split()) < 1500]
    short = {r[0] for r in want}
    got = QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = list(map(tuple, got.collect()))
    assert len(found) == len(docs) and sorted(r for r in found if r[0] in short) == sorted(want)
    assert any(r[1] for r in want)


def test_planted_tails(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(200)] + [(None, "a b"), (201, None), (202, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: (r[1] or "").encode().split() for r in docs.select("doc_id", periodic.planted(docs.doc_id, docs.text)).collect()}
    assert got == {i: planted_by_hand(i, t) for i, t in rows}
    assert any(planted_by_hand(i, t) != (t or "").encode().split() for i, t in rows)
