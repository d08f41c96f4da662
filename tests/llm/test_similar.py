"""The pipeline's near-copy stage against all pairs of five-word shingle sets."""

import random

import numpy as np
from pyspark.sql import functions as F

from tenora.llm import similar, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_hand(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            x, y = sets[a], sets[b]
            if a < b and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and (not x or len(x & y) >= 0.8 * len(x | y)):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    return set(root.values())


def test_edited_copies_leave_one_each(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts, base = {}, rng.choices(words, k=400)
    for i in range(120):  # one crowd: each a few edits from one text, so not all are near each other
        text = list(base)
        for at in rng.sample(range(400), rng.randint(0, 14)):
            text[at] = rng.choice(words)
        texts[i] = " ".join(text)
    for i in range(120, 180, 3):  # pairs just above and below the least similarity, and short texts
        text = rng.choices(words, k=200)
        texts[i], edited = " ".join(text), list(text)
        for at in range(0, 5 * rng.randint(1, 9), 5):
            edited[at] = "edited"
        texts[i + 1], texts[i + 2] = " ".join(edited).upper(), " ".join(text[:3])
    texts |= {180: None, 181: "", 182: " \n"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in simhash.deduplicate(spark, docs).collect()]
    assert len(got) == len(set(got)) and set(got) == kept_by_hand(texts)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id for r in simhash.deduplicate(spark, docs).collect()}
    assert got == kept_by_hand(dict(map(tuple, docs.collect())))


def test_shingles():
    a, b = similar.shingles_of("A b c d e f"), similar.shingles_of("a  b c d e g")
    assert len(a) == len(b) == 2 and len(np.intersect1d(a, b)) == 1
    assert np.array_equal(a, similar.shingles_of("a b c d e f"))
    assert not len(similar.shingles_of(None)) and not len(similar.shingles_of(" ")) and len(similar.shingles_of("b")) == 1


def test_alike_sets_share_a_key_of_their_prefixes_with_room_for_the_rest():
    rng = np.random.default_rng(7)
    frequent, none = np.sort(rng.choice(400, 60, replace=False)), np.empty(0, dtype=np.int64)
    counts = rng.integers(17, 40, 60)
    for _ in range(2000):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 60)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 400, rng.integers(0, 6))]))
        common = len(np.intersect1d(a, b))
        if not len(b) or 5 * common < 4 * (len(a) + len(b) - common):
            continue
        for order in ((none, none), (frequent, counts)):
            x, y = (similar.prefix_of(s, *order).tolist() for s in (a, b))
            first = next(k for k in x if k in y)
            most = min(len(a) - x.index(first), len(b) - y.index(first))
            assert most >= common and 9 * most >= 4 * (len(a) + len(b))


def test_passages_of_many_texts(spark):
    rng = random.Random(6)
    words, shared = [f"w{i}" for i in range(4000)], [f"s{i}" for i in range(120)]
    texts = {i: " ".join(shared + rng.choices(words, k=rng.choice([30, 200]))) for i in range(150)}  # alike only in part
    for i in range(150, 190):
        text = texts[rng.randrange(150)].split()
        text[rng.randrange(len(text))] = "edit"
        texts[i] = " ".join(text)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.deduplicate(spark, docs).collect()} == kept_by_hand(texts)


def test_fingerprints_bring_near_copies_together_in_linear_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=600)
    texts = {}
    for i in range(80):
        text = list(base)
        text[rng.randrange(600)] = "edit"
        texts[i] = " ".join(text)
    for i in range(80, 140):
        texts[i] = " ".join(rng.choices(words, k=600))
    docs = spark.createDataFrame([*texts.items(), *texts.items()], "doc_id long, text string").repartition(3)
    found = similar.sets(spark, docs)
    near = similar._near(spark, found)
    assert 70 <= near.count() <= 48 * 80  # never all pairs of the crowd
    root = {r.node: r.root for r in similar.components(spark, similar._verified(spark, near, found)).collect()}
    nodes = {r.text: r.node for r in docs.select("text", similar.node(docs["text"]).alias("node")).collect()}
    crowd = [root.get(nodes[texts[i]], nodes[texts[i]]) for i in range(80)]
    assert max(map(crowd.count, crowd)) >= 70 and not any(nodes[texts[i]] in root for i in range(80, 140))


def test_copies_of_a_task_are_one_set(spark):
    docs = spark.createDataFrame([(i, "A  b c d e f g") for i in range(50)] + [(50, None), (51, " ")], "doc_id long, text string").coalesce(1)
    got = similar.sets(spark, docs).orderBy("size").collect()
    assert [(r.size, len(r.low) + len(r.rest), r.fp == 0) for r in got] == [(0, 0, True), (3, 3, False)]


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles(spark):
    rng, rows = np.random.default_rng(9), []
    for n in (0, 1, 3, 32, 33, 64, 250, 260, 3000):
        a = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        for kept in (1.0, 0.95, 0.85, 0.3, 0.0):
            b = np.unique(np.concatenate([a[rng.random(len(a)) < kept], rng.integers(-(1 << 63), (1 << 63) - 1, n // 20)]))
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                rows.append((len(a) + len(b), len(np.setxor1d(a, b)), similar.sketch_of(a).tolist(), similar.sketch_of(b).tolist()))
    a = rng.integers(-(1 << 63), (1 << 63) - 1, 300)  # unlike ones of equal size
    rows += [(600, 600, similar.sketch_of(a).tolist(), similar.sketch_of(a + 12345).tolist())]
    assert any(len(r[2]) != len(r[3]) for r in rows)  # one is folded
    got = spark.createDataFrame(rows, "sizes int, apart int, of_u array<long>, of_v array<long>").select(
        "sizes", "apart", similar._differing().alias("bits")).collect()
    assert all(0 <= r.bits <= r.apart and (r.bits == 0 or r.apart) for r in got)
    assert 9 * got[-1].bits > 600  # so they are told apart


def test_among_returns_all_wanted_nodes_and_few_others(spark):
    rows = spark.range(4000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("node"), "id")
    marked, may = similar._among(rows, rows.filter("id % 10 = 0").select("node"))
    got = [r.id for r in marked.filter(may).collect()]
    assert len(got) == len(set(got)) and set(range(0, 4000, 10)) <= set(got) and len(got) < 450
    marked, may = similar._among(rows, rows.limit(0).select("node"))
    assert marked.filter(may).count() == 0 and marked.filter(~may).count() == 4000


def test_sets_of_texts_that_no_pair_needs_are_not_written(spark, monkeypatch):
    rng = random.Random(10)
    words, written, settled = [f"w{i}" for i in range(4000)], [], similar.settled
    texts = {i: " ".join(rng.choices(words, k=150)) for i in range(300)}  # no two alike
    texts |= {300 + i: texts[i] + " more" for i in range(10)}

    def noted(spark, df, name):
        out = settled(spark, df, name)
        longs = [f.name for f in out.schema if f.dataType.simpleString() == "array<bigint>"]
        written.append(max([0, *out.agg(*[F.sum(F.size(c)) for c in longs]).first()]) if longs else 0)
        return out

    monkeypatch.setattr(similar, "settled", noted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert similar.links(spark, docs).count() == 10
    assert max(filter(None, written)) < 310 * 146 / 4  # whole sets of the 20 texts of pairs, and sketches


def test_sets_of_given_nodes(spark):
    docs = spark.createDataFrame([(f"{i} a b c d e f {i}",) for i in range(400)], "text string").repartition(3)
    named = docs.select("text", similar.node(F.col("text")).alias("node"))
    asked = named.filter("text like '1%'").select("node")
    got = {bytes(r.node) for r in similar.sets(spark, docs, "text", asked).collect()}
    assert {bytes(r.node) for r in asked.collect()} <= got and len(got) < 150
    assert similar.sets(spark, docs, "text", asked.limit(0)).count() == 0
