"""Each corpus operator against a plain version on small tables with nulls, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from oracle import compare, connect
from pyspark.sql import functions as F

from tenora.catalog.registry import Query
from tenora.llm import ann, chat, golay, langid, mixing, packing, quality, sharding, simhash, urlfilter, warc
from tenora.llm.queries import QUERIES, SQL, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, fp string, id_ string, rank_ int"


def words_of(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like internal ones."""
    rng = random.Random(1)
    vocabulary = ["the", "and", "haus", "Über", "maison", "ça", "año", "x|y", "###"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 60, 300]))), rng.choice(["en", "de", None]),
             rng.choice(["b", "a", "", None]), i, "r", 1, "f", "i", 0) for i in range(60)]
    long = " ".join(rng.choices(vocabulary, k=9000))
    extra = [(60, None), (61, ""), (62, " \n\t"), (None, "a b c"), (63, long), (64, long + " more"), (3, rows[3][1]), (3, rows[3][1]), (65, "!!! 123")]
    rows += [(i, t, None, "a", None, None, None, None, None, None) for i, t in extra]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SF), Query(name, (), QUERIES[name], SQL[name]), SF) is None


def test_mixture(spark, odd, empty):
    got = mixing.copies(spark, odd).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "copies").collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").split(None)) if (r.text or "").isascii() else True
        by[r.source].append(r)
    total = sum(r.size for r in got)
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    size = {s: sum(r.size for r in by[s]) for s in by}
    full, goal = set(), {}
    while True:  # hand the excess on until nobody is above
        rest, share = total - sum(3 * size[s] for s in full), sum(weight[s] for s in by if s not in full)
        goal = {s: 3 * size[s] if s in full else rest * weight[s] / share for s in by}
        more = {s for s in by if s not in full and goal[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    for s, rows in by.items():
        assert all(r.source_size == size[s] and math.isclose(r.target, goal[s]) and 0 <= r.copies <= 3 for r in rows)
        assert abs(sum(r.size * r.copies for r in rows) - goal[s]) <= max(r.size for r in rows)
    again = mixing.copies(spark, odd.repartition(7)).select("row.doc_id", "size", "copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mixing.copies(spark, odd).select("row.doc_id", "size", "copies").collect())
    mixed = mixing.mix(spark, odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(spark, empty).count() == 0


def test_golay_and_keys():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 300).astype(np.uint32)
    for _ in range(2):  # two flips keep a common index
        other = words ^ (1 << rng.integers(0, 23, 300)).astype(np.uint32) ^ (1 << rng.integers(0, 23, 300)).astype(np.uint32)
        sets = []
        for w in (words, other):
            at, index = golay.near_indices(w)
            sets.append([set(index[at == i]) for i in range(300)])
        assert all(a & b for a, b in zip(*sets)) and {len(s) for s in sets[0]} <= {1, 6}
    fps = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    near = fps.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)
    keys = [collections.defaultdict(set), collections.defaultdict(set)]
    for k, f in zip(keys, (fps, near)):
        for at, key in zip(*simhash.keys_of(f)):
            k[at].add(key)
    assert all(keys[0][i] & keys[1][i] for i in range(200))


def plain_fingerprint(text):
    words = words_of(text)
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd, empty):
    got = simhash.near_groups(spark, odd).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    group = {f: f for _, f in prints}

    def find(f):
        return f if group[f] == f else find(group[f])

    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 3:
                group[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i, f in prints:
        least[find(f)] += [i] if i is not None else []
    want = [(i, f"{f:016x}", min(least[find(f)], default=None)) for i, f in prints]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.deduplicate(spark, odd)
    assert kept.columns == odd.columns and kept.count() == len(least)
    assert simhash.near_groups(spark, empty).count() == 0 and simhash.deduplicate(spark, empty).count() == 0


def test_quality_measures(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(3, 1, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(spark, odd, labels)
    got = quality.judge(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        text = r.row.text or ""
        words = [w.decode() for w in text.encode().split()]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {w for w, n in collections.Counter(windows).items() if n > 1}
        marked = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
        lines = [x for x in text.split("\n") if x.split()]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)
    assert quality.train(spark, empty, labels) is None and quality.judge(empty, None).count() == 0
    assert all(r.kept != r.base_failed for r in quality.judge(odd, None).collect())


def test_quality_learns(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.filter("doc_id % 2 = 0")
    judged = quality.judge(docs, quality.train(spark, docs, seen)).select("row.doc_id", "base_failed", "kept")
    unseen = judged.join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in unseen) >= 0.97 * len(unseen)


def test_warc(spark):
    html = "<p>" + "é" * 2000
    rows = [(1, "http://a/\r\nX: y%0A", html), (2, None, html), (2, "u", html), (3, "u", "short"), (4, "u", "short"), (5, "u", None),
            (6, "u", ""), (None, "u", html), (None, "v", "z" * 200), (None, "w", "z" * 200), (7, "u", "a\r\n\r\nb\0" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    from tenora.session import scratch_path

    chunks = warc.read(warc.write(spark, pages, scratch_path(spark, "warc")), 1000).collect()
    texts = collections.defaultdict(bytes)
    for r in sorted(chunks, key=lambda r: r.chunk):
        assert len(r.data) <= 1000 and r.chunk_start == len(texts[r.page_id, r.url])
        texts[r.page_id, r.url] += r.data
        assert r.digest_so_far == hashlib.sha256(texts[r.page_id, r.url]).hexdigest()
    assert texts["1", rows[0][1]] == html.encode() and texts["7", "u"] == rows[-1][2].encode()
    got = sorted(map(str, (tuple(r) for r in warc.round_trip(spark, pages).collect())))
    first = {html: 1}
    want = [(i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(),
             *(("revisit", first[h]) if first.get(h, i) != i else ("response", None))) for i, _, h in rows]
    assert got == sorted(map(str, want))
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(spark, docs.filter(~langid.held_out(F.col("doc_id"))))
    got = langid.identify(docs, model).filter(langid.held_out(F.col("row.doc_id"))).select("row.lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    seen = {r.row.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(seen[i].lang_pred == "und" and seen[i].score == 0 and seen[i].rejected for i in (60, 61, 62, 65))
    assert all(0 <= r.score <= 1 for r in seen.values())
    assert langid.train(spark, empty) is None and {r.lang_pred for r in langid.identify(odd, None).collect()} == {"und"}
    held = {r[0]: r[1] for r in docs.select("doc_id", langid.held_out(F.col("doc_id"))).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())


def test_language_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(spark, docs.filter(~langid.held_out(F.col("doc_id"))))
    centroids = [dict(enumerate(c.tolist())) for c in model.centroids]
    for r in langid.identify(docs.limit(200), model).collect():
        letters = f" {langid._NOT_LETTERS.sub(' ', (r.row.text or '').lower()).strip()} ".encode()
        weights = collections.Counter()
        for at in range(len(letters) - 2):
            h = int.from_bytes(letters[at : at + 3], "big") * 0x9E3779B1 % 2**32
            weights[(h ^ h >> 15) >> (32 - langid.BITS)] += 1
        weights = {g: math.sqrt(n) * float(model.idf[g]) for g, n in weights.items()}
        length = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        cosines = [sum(w * c[g] for g, w in weights.items()) / length for c in centroids]
        if letters.strip():
            assert abs(max(cosines) - r.score) < 1e-4
            assert max(c for c, name in zip(cosines, model.languages) if name == r.lang_pred) > max(cosines) - 1e-4


def test_language_rejects_noise_and_languages_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model, rng = langid.train(spark, docs.filter(~langid.held_out(F.col("doc_id")))), random.Random(3)
    held = langid.identify(docs.filter(langid.held_out(F.col("doc_id"))), model)
    assert held.filter("rejected").count() <= 0.002 * held.count()
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto".split()
    italian = "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione".split()
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)) for n in (50, 100, 200)]
    other = [" ".join(rng.choices(words, k=n)) for words in (finnish, italian) for n in (100, 500)] + ["все люди рождаются свободными " * 30]
    texts = spark.createDataFrame([(t,) for t in noise + other], "text string")
    assert [r.rejected for r in langid.identify(texts, model).collect()] == [True] * 8


def test_rejection_distances():
    counts = {("en", 8, s): 10 for s in range(100, 110)} | {("en", 9, 150): 3, ("en", 10, 180): 1000, ("en", 10, 20): 5, ("de", 3, 10): 1}
    floors = langid.floors_of(counts)
    assert floors["en"][[0, 8, 9, 10, 11]].round(9).tolist() == [0, 0.3, 0.3, 0.54, 0.54] and not floors["de"].any()


def test_shards(spark, odd, empty):
    got = sharding.shard(spark, odd, slots=64).collect()
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, None if r.text is None else zlib.crc32(r.text.encode())) for r in odd.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(spark, empty).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = sharding.shard(spark, docs)
    loads = [r[0] for r in placed.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert max(loads) - min(loads) < 0.001 * sum(loads)
    many = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))  # a third of all rows without an id
    split = sharding.shard(spark, many)
    loads = [r[0] for r in split.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert max(loads) - min(loads) < 0.001 * sum(loads) and split.groupBy("virtual_slot").count().agg(F.max("count")).first()[0] < 20
    used = sharding.slot_bytes(placed)
    assert {r[0]: r[1] for r in placed.select("virtual_slot", "next_shard").collect()} == {
        r[0]: r[1] for r in sharding.grown_map(placed.select("virtual_slot", "shard").distinct(), used, 8).collect()}
    before = placed.select("virtual_slot", "shard").distinct()
    after = {r[0]: r[1] for r in sharding.grown_map(before, used, 8).collect()}
    assert all(after[r[0]] in (r[1], 8) for r in before.collect())
    grown = [sum(r.bytes for r in used.collect() if after[r.virtual_slot] == s) for s in range(9)]
    assert min(grown) > 0.9 * sum(grown) / 9


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())  # as it comes: added tokens in a text are tokens
    spelt = [(900, "hi <|endoftext|> x"), (901, "<|startoftext|>a"), (902, "<|ENDOFTEXT|> b<|startoftext|>"), (903, "<| endoftext |>")]
    odd = odd.select("doc_id", "text").unionByName(spark.createDataFrame(spelt, "doc_id long, text string"))
    cut = packing.pieces(odd, tokenizer_path()).collect()
    ids = collections.Counter((r.doc_id, tuple([*plain.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in odd.collect())
    assert sum(r.length for r in cut) == sum(len(i) * n for (_, i), n in ids.items())
    for r in cut:
        part = tuple(np.frombuffer(r.ids, dtype="<u4"))
        assert any(d == r.doc_id and i[r.start : r.start + 2048] == part for d, i in ids) and r.start == 2048 * r.piece
    packed = packing.pack(spark, packing.pieces(odd, tokenizer_path()))
    whole = packing.sequences(packed).collect()
    bins = collections.defaultdict(list)
    for r in packed.collect():
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in cut) // 2048) and all(len(r.ids) == 4 * r.length for r in whole)
    assert packing.packed_documents(spark, empty, tokenizer_path()).count() == 0


def test_tokenizer_by_runs():
    words = packing.WordTokenizer(tokenizer_path())
    texts = ["", " ", "don't stop. I'll 'S can't", "été ÉTÉ étª aª bª", "Straße ẞ İI ΣΑΣ 你好 😀 a\tb\x0bc\x1cd e", "x²y 12ab34 <|endoftext|>hi",
             "a\u200bb --- ### @@ ``~~ {}[]\\", "œuvre naïve×3÷2 e\u0301", "''s 's'S re've", "ab,CD;Ef" * 500]
    want = [e.ids for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [a.tolist() for a in words.batch(texts)] == want == [words.batch([t])[0].tolist() for t in texts]


def test_subset_sum():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(5)}
        room, best = rng.randint(1, 60), {0}
        for length, n in counts.items():
            best = {b + k * length for b in best for k in range(n + 1) if b + k * length <= room}
        got = packing.fullest(counts, room)
        assert sum(n * k for n, k in got) == max(best) and all(k <= counts[n] for n, k in got)


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/1", "x://example.net/enx", "http://net/", "http://net", "http://b.com/.net/", "http://example.com/de/?q",
            "http://k.org/fr/a?b#c", "http://planet/", None, "", "no host", "http://" + "a" * 5000 + ".net/", "http://ÄÖ.net/é", "a://b\0.net/", "http://net:80/"]
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, rule string")
    for r in urlfilter.judge(pages).collect():
        url = ([*urls, urls[0]])[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = rest.split("#")[0].split("?")[0].split("/")[0]
        path = rest[len(host) :].split("#")[0].split("?")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if ("." + host).endswith("." + h) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fit)[1:] if fit else (None, "allow")))
    assert urlfilter.judge(pages.limit(0)).count() == 0
    many = urlfilter.ShiftAnd([f"*x{i}?y*" for i in range(40)])
    assert many.match([b"ax7.y", b"", b"x39zy!"]).sum(axis=1).tolist() == [1, 0, 1]


def test_chat(spark):
    rows = [(1, 0, "user", "hi <|im_end|> \\ <\\|im_sep|>"), (1, 1, "user", None), (1, 2, "assistant", "a<|im_start|>"), (1, 3, "assistant", ""),
            (1, None, "system", "</s>[INST] <<SYS>>"), (2, 0, None, "x<"), (2, 0, "ro\nle\\n", "|y"), (None, 1, "assistant", "z"), (3, 1, "user", "<"), (3, 1, "user", "<")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(turns)
    back = {r.conv_id: r for r in chats.select("conv_id", chat.parse_chat(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l"), "formatted").collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t.role, t.text) for t in back[conv].t] == [r[2:] for r in own]
        assert back[conv].l == "".join(r[3] for r in own if r[2] == "assistant")
    assert back[1].formatted.count("<|im_start|>") == 3 and back[1].formatted.count("<|im_sep|>") == 2 and "[INST]" not in back[1].formatted
    assert chat.digests(chat.format_chats(turns.limit(0))).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    points = (centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    points[1000:2000] = points[1000]  # a third of all rows are one vector
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(9000, None), (9020, [0.0] * 16), (9040, [None] * 16), (9060, [float("nan")] * 16), (9080, [float("inf")] * 16), (9100, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = ann.search(spark, vectors, F.col("vec_id") % 20 == 0).toPandas()
    x, ids = np.zeros((3001, 16)), np.array([*range(3000), 9100])
    x[:3000], x[3000, :2] = points, [1, 2]
    hits = 0
    assert set(got["query_id"]) == {i for i in ids if i % 20 == 0}
    for q, g in got.groupby("query_id"):
        score = (x * x[ids == q]).sum(axis=1)
        score[ids == q] = -np.inf
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and not (g["vec_id"] == q).any()
        assert g["score"].tolist() == [score[ids == v][0] for v in g["vec_id"]]
        assert (np.lexsort((g["vec_id"], -g["score"])) == np.arange(20)).all()
        hits += len(set(g["vec_id"]) & set(ids[np.lexsort((ids, -score))[:20]]))
    assert hits >= 0.9 * len(got)
    assert ann.search(spark, vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_gives_all_it_can(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 5
    points = (centres[rng.integers(0, 12, 20_000)] + 0.2 * rng.normal(size=(20_000, 8))).astype(np.float32)
    points[:40] = rng.normal(size=(40, 8)) * 0.01  # far from all clusters
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(None, [1.0] * 8), (2**53 + 1, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = ann.search(spark, vectors, (F.col("vec_id") % 20 == 0) | (F.col("vec_id") > 2**53)).groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("rank").alias("last")).collect()
    assert len(got) == 1001 and all(r.n == r.last == 20 for r in got) and 2**53 + 1 in {r.query_id for r in got}
    few = ann.search(spark, vectors.filter("vec_id < 10"), F.col("vec_id") == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == list(range(1, 10))
