"""Removal of passages that repeat across documents against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from tenora.llm import repeats
from tenora.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def by_hand(rows, least=13):
    """(doc_id, n_words, n_removed, longest, kept) of each row."""
    order = lambda i: (i is None, i or 0)
    texts, first, size = [(d, (t or "").encode().split()) for d, t in rows], {}, least
    longest, gone = [0] * len(rows), [set() for _ in rows]
    while True:
        first = {}
        for d, w in texts:
            for i in range(len(w) - size + 1):
                k = tuple(w[i:i + size])
                first[k] = min(first.get(k, order(d)), order(d))
        for n, (d, w) in enumerate(texts):
            for i in range(len(w) - size + 1):
                if first[tuple(w[i:i + size])] < order(d):
                    longest[n] = size
                    if size == least:
                        gone[n] |= set(range(i, i + size))
        if size not in longest:
            break
        size *= 2
    return [(d, len(w), len(g), m, b" ".join(x for i, x in enumerate(w) if i not in g).decode()) for (d, w), g, m in zip(texts, gone, longest)]


def key(row):
    return tuple((x is None, x) for x in row)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "x|y", "日本"]
    passages = [rng.choices(vocabulary, k=n) for n in (12, 13, 14, 26, 60, 130)]
    rows = []
    for i in range(90):
        words = rng.choices(vocabulary, k=rng.choice([0, 5, 12, 13, 40, 200]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((rng.randint(-5, 200), rng.choice([" ", "\n", " \t "]).join(words)))
    base = rng.choices(vocabulary, k=150)
    for i in range(25):  # near copies, exact copies, and the same words with other white space
        edited = list(base)
        edited[rng.randrange(150)] = "edit"
        rows += [(300 + i, " ".join(edited)), (400 + i, " ".join(base)), (450 + i, "\n".join(base))]
    rows += [(600, None), (601, ""), (602, " \n"), (None, rows[3][1]), (None, " ".join(base)), (7, " ".join(base[:80])), (7, " ".join(base[20:])), (7, " ".join(base[20:]))]
    rows += [(700, "na " * 40), (701, "na " * 30), (702, "na na nu " * 20)]
    return rows


@pytest.mark.parametrize("least", [13, 4])
def test_against_all_windows(spark, least):
    rows = corpus(least)
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], "doc_id long, text string, id int, t string, at int").repartition(3)
    got = repeats.without_repeats(spark, docs, least=least)
    assert got.columns == ["doc_id", "n_words", "n_removed", "longest", "text"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows, least), key=key)


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    rng = random.Random(9)
    words = rng.choices([f"w{i}" for i in range(5000)], k=30_000)
    rows = [(1, " ".join(words)), (2, " ".join(words[100:9000] + ["x"] + words[9001:20_000])), (3, " ".join(words[29_980:]))]
    got = {r.doc_id: r for r in repeats.without_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 19_899, 20] and got[2].text == "x" and got[2].longest == 13 * 512
    import pyarrow as pa

    def found(together):
        monkeypatch.setattr(repeats, "_TOGETHER", together)
        places, digests = {}, []
        for first, counts, hashes, digest in repeats._texts(pa.array([" ".join(words), None, "a\nb " * 20])):
            digests += digest
            for rows_, offsets, part, ends in repeats._stretches(first, counts, hashes, 13):
                place, h = repeats.representatives(part[0], ends, 13)
                text = np.searchsorted(ends, place, side="right")
                begins = np.concatenate([[0], ends[:-1]])
                places |= {(r, p): x for r, p, x in zip(rows_[text].tolist(), (place - begins[text] + offsets[text]).tolist(), h.tolist())}
        return places, digests

    assert found(1 << 21) == found(700) == found(90)


def test_word_hashes():
    text = " é ab\tab\n\n" + "x" * 9000 + " " + "x" * 9001 + " ba \x0b"
    starts, hashes, spaced = repeats.word_hashes(np.frombuffer(text.encode(), np.uint8))
    own = text.encode().split()
    assert spaced.tobytes() == b" ".join(own) + b" " and [text.encode()[i:].split()[0] for i in starts] == own
    assert all(len(set(h.tolist())) == 5 and h[1] == h[2] for h in hashes)
    assert repeats.word_hashes(np.frombuffer(b" \n", np.uint8))[1].shape == (2, 0)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(spark, docs).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_repeated_passages"](spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "longest"]
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest(), m) for d, n, g, m, k in by_hand(rows)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r[2] for r in want)
