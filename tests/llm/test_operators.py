"""The ten operators against brute force, exact round trips and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framewright.llm import bpe, chunks, components, decontaminate, line_dedup, near_dups, quality, queries, sharding, substrings, suffixes, topk, warc
from framewright.llm.common import shared_dir

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, sf, key):
    frame = queries.QUERIES[key](spark, sf)
    relation = duck.sql(queries.ORACLE_SQL[key])
    names = sorted(relation.columns)
    assert sorted(frame.columns) == names
    assert sorted(map(repr, map(tuple, frame.select(*names).collect()))) == sorted(map(repr, relation.select(*[f'"{n}"' for n in names]).fetchall()))


def test_empty_tables(spark, no_documents):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    results = [line_dedup.query(no_documents), quality.query(no_documents, labels), suffixes.query(no_documents), decontaminate.query(no_documents, items), sharding.query(no_documents), near_dups.query(no_documents), topk.query(vectors), bpe.digest(no_documents, queries.BPE_FILE), substrings.query(no_documents), warc.query(pages)]
    assert [r.count() for r in results] == [0] * 10


def test_line_dedup_of_odd_documents(odd_documents):
    got = {(r["doc_id"], r["kept_text"]) for r in line_dedup.dedup(odd_documents).collect()}
    assert (1, "Alpha beta gamma delta epsilon zeta\nshared line of text here") in got
    assert (2, "alone in its document today") in got and (None, "only the null id has this one") in got
    assert (3, "") in got and (4, "") in got and (7, "the end \t\n \n") in got
    assert line_dedup.dedup(odd_documents).columns == [*odd_documents.columns, "n_lines", "n_dropped", "kept_text"]


def test_quality_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.query(docs, labels).join(labels, "doc_id").where("held_out")
    row = judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("score")).first()
    assert row[1] > 1000 and row[0] > 0.97
    once = quality.query(docs, labels).where("held_out").select("doc_id").first()["doc_id"]
    assert zlib.crc32(str(once).encode()) % 3 == 1


def test_quality_of_odd_documents(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.query(odd_documents, labels).collect()
    assert len(rows) == 10 and all(abs(r["score"] - 2 / 3) < 1e-9 and r["predicted"] == 1 for r in rows)  # one label, 1: (1 + 1) / (1 + 2)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.FEATURES), rng.normal(size=(2, 2)), 1.0, 0.0)
    features = rng.normal(size=(5, quality.FEATURES)).astype(np.float32)
    odds, total, good = features.astype(np.float64) @ model.weights, 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> i) & 1 for i in range(5)]
        weight = np.exp(sum(odds[i] for i in range(5) if y[i]) + sum(model.chain[a, b] for a, b in zip(y, y[1:])))
        total += weight
        good += weight * np.array(y)
    assert np.allclose(model.marginals(features, np.array([5])), good / total)


def brute_bytes(texts, length):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_suffixes_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab \n") for _ in range(rng.choice([90, 150, 400]))) for _ in range(6)] + ["a" * 300, "ab" * 200, "é" * 150]
    texts = ["".join(rng.choice(pool)[rng.randrange(60) :] for _ in range(rng.randrange(5))) for _ in range(40)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [(t or "").encode() for t in texts]
    for r, (t, g) in zip(suffixes.dedup(docs, batches=3).orderBy("doc_id").collect(), zip(raw, brute_bytes(raw, 200), strict=True), strict=True):
        runs = int((np.diff(g.astype(int), prepend=0) > 0).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(t), int(g.sum()), runs)
        assert bytes(r["kept"]) == bytes(b for b, x in zip(t, g) if not x)


def test_suffixes_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 700)
    text = bytes(random.Random(4).choices(b"abcd", k=3000))
    text = text + text[500:1800]
    whole = suffixes.Stretches([text], 200)
    assert sum(h - a + 1 for a, h in zip(whole.low, whole.high)) == len(text) - 199
    docs, starts, hashes, _ = whole.strings(np.arange(len(whole.grams)))
    assert len(set(zip(docs.tolist(), starts.tolist()))) == len(starts)
    first = {}
    for s, h in zip(starts.tolist(), hashes.tolist()):
        assert first.setdefault(h, text[s : s + 200]) == text[s : s + 200]


def test_decontamination_blocks_and_odd_items(spark, odd_documents):
    items = spark.createDataFrame([(1, "Alpha beta, gamma"), (2, "漢字"), (3, None), (4, ""), (None, "delta epsilon"), (5, "nothing of this")], "item_id long, text string")
    one = decontaminate.find(odd_documents, items).drop("longest").collect()
    many = decontaminate.find(odd_documents, items, block_bytes=4).drop("longest").collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))
    first = next(r for r in one if r["doc_id"] == 1)
    assert (first["n_hit"], first["items"], first["hit_spans"]) == (5, [1], [0, 5])
    assert [r["items"] for r in one if r["doc_id"] == 8] == [[2]]
    kept = {r["doc_id"] for r in decontaminate.remove(odd_documents, items).collect()}
    assert kept == {2, 3, 4, None, 5, 6, 7}


def test_sharding_is_a_permutation(spark, odd_documents):
    for n in (1, 2, 5, 17, 1000):
        rows = sharding.assign(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 16).collect()
        assert sorted(r["place"] for r in rows) == list(range(n))
    got = sharding.query(odd_documents).collect()
    assert len(got) == 10 and sorted((r["shard"], r["slot"]) for r in got) == [(i, 0) for i in range(10)]
    assert {r["text_crc32"] for r in got if r["doc_id"] in (3, 4)} == {0}
    again = sharding.query(odd_documents.repartition(7, "owner")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 60, 120]))] for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(8):
            words = list(b)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            texts.append(rng.choice([" ", "\n", "  "]).join(words))
    texts += [None, "", "  "]
    sets = []
    for t in texts:
        w = [x for x in re.split(f"[{SPACE}]+", (t or "").translate(LOWER)) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    label[i] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dups.query(docs).collect()}
    assert got == {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


def test_near_duplicates_of_odd_documents(odd_documents):
    got = near_dups.query(odd_documents).collect()
    assert len(got) == 10
    assert {(r["doc_id"], r["component_id"]) for r in got} >= {(5, 5), (6, 5), (3, 3), (4, 4), (None, None)}
    assert near_dups.dedup(odd_documents).count() == 9


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (91, 90), (5, 5)], "u long, v long")
    got = {r["node"]: r["label"] for r in components.components(chain).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {91: 90}
    assert components.components(chain.where("false")).count() == 0


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=6).round(2)]) for i in range(0, 400, 2)]
    rows += [(100, None), (101, [1.0, None]), (103, [float("nan")] * 6), (105, [float("inf")] * 6), (None, [0.0] * 6), (7, [0.5]), (9, []), (9, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 100 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, topk.query(vectors).collect())) == sorted(want)
    usable_df = topk.quantise(vectors)
    assert sorted(map(tuple, topk.search(usable_df, usable_df.where("vec_id % 100 = 0"), 10, 2).collect())) == sorted(want)


def test_bpe_equals_the_library(spark, sf, odd_documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.BPE_FILE)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd_documents.select("doc_id", "text"))
    rng = random.Random(3)
    noise = ["".join(rng.choice("aab  \n\t.é🎉0'sD<|>_") for _ in range(rng.randrange(50))) for _ in range(300)] + ["a" * n for n in range(70)]
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(noise)], "doc_id long, text string"))
    want = []
    for doc_id, text in docs.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.digest(docs, queries.BPE_FILE).collect())
    whole = bpe.decode(bpe.encode(odd_documents, queries.BPE_FILE), queries.BPE_FILE)
    assert all(r["decoded"] == (r["text"] or "") for r in whole.collect())


def test_substrings_of_odd_documents(odd_documents):
    got = {(r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.dedup(odd_documents).collect()}
    assert (3, 0, 0) in got and (4, 0, 0) in got and (6, 30_001, 30_000) in got
    assert any(d == 5 and removed == 30_000 - 997 - 19 + 19 for d, _, removed in got) or any(d == 5 and 0 < removed < 30_000 for d, _, removed in got)


@pytest.mark.parametrize("seed", range(2))
def test_substrings_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[f"v{rng.randrange(30)}" for _ in range(rng.choice([10, 25, 60]))] for _ in range(5)]
    texts = [" \n".join(w for _ in range(rng.randrange(4)) for w in rng.choice(passages)) for _ in range(30)] + [None]
    words = [[w for w in re.split(f"[{SPACE}]+", t or "") if w] for t in texts]
    seen, gone = set(), [np.zeros(len(w), bool) for w in words]
    for d, w in enumerate(words):
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[d][i : i + 20] = True
            seen.add(key)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in substrings.dedup(docs).collect():
        d = r["doc_id"]
        assert r["kept_text"] == " ".join(w for w, g in zip(words[d], gone[d]) if not g) and r["n_removed"] == int(gone[d].sum())


def test_count_min_never_underestimates():
    sizes = substrings.Sizes(1000)
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64)
    for row in range(substrings.DEPTH):
        keys = sizes.cell_keys(hashes, row)
        assert len(np.unique(keys)) <= len(hashes) and (keys < sizes.cells * substrings.CELLS).all()


def test_warc_odd_pages(spark):
    rows = [(1, "http://a.example/x?q=1", "<p>1</p>"), (2, "http://a.example/x?q=1", "<p>1</p>"), (3, None, None), (4, "not a url\r\nX: y", ""), (None, "http://b.example", "<p>1</p>"), (5, "http://[bad", "é" * 70_000), (5, "http://[bad", "é" * 70_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write_archives(pages, folder)
    back = warc.merge_index(warc.read_archives(manifest, folder)).collect()
    assert [warc.capture_order(tuple(r)) for r in back] == sorted(warc.capture_order(tuple(r)) for r in back)
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back)
    assert got == [(0, "revisit", 1, 8), (1, "response", None, 8), (2, "revisit", 1, 8), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 140_000), (5, "response", None, 140_000)]


def test_loser_tree():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7):
        runs = [sorted([("k", "t", rng.randrange(50), "r", i) for i in range(rng.randrange(6))], key=warc.capture_order) for _ in range(n)]
        merged = list(warc.LoserTree([iter(r) for r in runs]))
        assert merged == sorted((x for r in runs for x in r), key=warc.capture_order) or [warc.capture_order(m) for m in merged] == sorted(warc.capture_order(x) for r in runs for x in r)


def test_vocabulary_is_outside_the_repository():
    assert "/repo/" not in public_tokenizers.path("byte_bpe_50k.json")


def test_rows_without_an_id_lie_in_many_buckets(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    keys = docs.select("doc_id", F.lit(1).alias("size"), F.crc32(F.encode("text", "utf-8")).alias("text_crc32"), F.lit(1).alias("copies"))
    numbered = sharding.number_groups(keys, "doc_id")
    assert max(r["count"] for r in numbered.groupBy("bucket").count().collect()) < 30
    assert sorted(r["first"] for r in numbered.collect()) == list(range(3000))


def test_chunks_leave_nothing_in_the_catalogue(spark, odd_documents):
    before = {t.name for t in spark.catalog.listTables()}
    found = substrings.query(odd_documents)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert found.count() == 10


def test_chunks_and_shards_grow_with_the_root(spark, monkeypatch):
    gb = 1 << 30
    assert chunks.grown(4, gb // 2) == 4 and chunks.grown(4, 4 * gb) == 8 and chunks.grown(4, 10_000 * gb) == 16 and chunks.grown(4, 10_000 * gb, 2) == 8
    rng = random.Random(7)
    pool = [" ".join(f"v{rng.randrange(40)}" for _ in range(rng.choice([15, 40, 90]))) for _ in range(8)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(4)))) for i in range(60)], "doc_id long, text string").repartition(3).cache()
    whole = [sorted(map(tuple, op.dedup(docs).collect())) for op in (suffixes, substrings)]
    for name, size in (("CHUNK_BYTES", 500), ("BUCKET_BYTES", 2_000), ("GROW_FROM", 4_000)):
        monkeypatch.setattr(chunks, name, size)
    for module, name, size in ((suffixes, "SHARD_BYTES", 1_500), (substrings, "CELLS", 1 << 9), (substrings, "HASH_SHARD_BYTES", 1_000)):
        monkeypatch.setattr(module, name, size)
    assert [sorted(map(tuple, op.dedup(docs).collect())) for op in (suffixes, substrings)] == whole


def test_merge_of_sorted_runs():
    rng = np.random.default_rng(1)
    parts = []
    for n in (0, 1, 50, 400):
        g, c = rng.integers(0, 40, n, dtype=np.uint64), rng.integers(0, 9, n, dtype=np.uint64)
        order = np.lexsort((c, g))
        parts.append((g[order], c[order]))
    grams, contents = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = suffixes._merged(grams, contents)
    assert sorted(order.tolist()) == list(range(451))
    assert list(zip(grams[order].tolist(), contents[order].tolist())) == sorted(zip(grams.tolist(), contents.tolist()))
