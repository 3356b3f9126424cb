"""Columns with clashing names, null ids, and the models against their definitions."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import bpe, decontaminate, line_dedup, near_dups, quality, queries, sharding, substrings, suffixes, topk, warc
from framewright.llm.common import shared_dir

CLASHES = ["__gone", "__lines", "__tag", "__id", "score", "predicted", "n_words", "items", "longest", "n_lines", "kept_text", "owner", "batch", "label", "ids"]


@pytest.fixture(scope="module")
def clashing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHES])


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_clashing_columns(spark, sf, clashing, stage):
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, clashing, sf)
    plain = run(spark, clashing.select("doc_id", "text", "lang", "source", "n_chars"), sf)
    if stage < 4:
        assert out.columns == clashing.columns
        assert out.where(" or ".join(f"`{c}` is distinct from 7" for c in CLASHES)).count() == 0
    same = plain.columns
    assert sorted(map(repr, out.select(same).collect())) == sorted(map(repr, plain.collect()))


def test_queries_take_clashing_columns(spark, sf, clashing):
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    vectors, pages = (spark.read.parquet(f"{sf}/{t}.parquet").limit(50).select("*", *[F.lit(7).alias(c) for c in ["q", "wide", "block", "digest", "size", "first_id"]]) for t in ("embeddings", "pages"))
    found = [line_dedup.query(clashing), quality.query(clashing, labels), suffixes.query(clashing), decontaminate.query(clashing, items), sharding.query(clashing), near_dups.query(clashing), bpe.digest(clashing, queries.BPE_FILE), substrings.query(clashing)]
    assert [f.count() for f in found] == [60] * 8
    assert bpe.encode(clashing, queries.BPE_FILE).count() == line_dedup.dedup(clashing).count() == decontaminate.find(clashing, items).count() == 60
    assert warc.query(pages).count() == 50 and topk.query(vectors).where("rank = 1").count() <= 50


def test_null_ids_that_are_copies_go(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (None, "one two three four five six"), (None, None)], "doc_id long, text string")
    assert [r["doc_id"] for r in near_dups.dedup(docs.limit(2)).collect()] == [1]


def test_slabs_give_the_same_bits(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 60, 9)
    shingles = rng.integers(0, 400, int(sizes.sum()))
    shared = np.unique(rng.integers(0, 400, 300))
    whole = near_dups._bit_rows(sizes, shingles, shared)
    monkeypatch.setattr(near_dups, "SLAB", 64)
    assert (near_dups._bit_rows(sizes, shingles, shared) == whole).all()
    row = np.repeat(np.arange(9), sizes)
    assert np.bitwise_count(whole).sum() == len({(r, s) for r, s in zip(row.tolist(), shingles.tolist()) if s in set(shared.tolist())})


def test_near_copies_by_blocks_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):
        words = base[: rng.randrange(40, 60)]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    group = list(range(60))
    for _ in range(60):
        for a, b in itertools.combinations(range(60), 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    got = {r["doc_id"]: r["component_id"] for r in near_dups.query(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(group))


def plain_merging(word, ranks):
    """Byte-pair encoding as defined: the first pair of the least rank merges, until none has one."""
    parts = list(word)
    while True:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 30), default=None)
        if at is None or (parts[at], parts[at + 1]) not in ranks:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_gadgets_equal_plain_merging(seed):
    rng = random.Random(seed)
    letters = [b"a", b"b", b"c"][: 2 + seed % 2]
    tokens, merges = list(letters), []
    while len(merges) < 25:
        pair = rng.choice(tokens), rng.choice(tokens)
        if pair[0] + pair[1] not in tokens and len(pair[0] + pair[1]) < 9:
            merges.append(pair)
            tokens.append(pair[0] + pair[1])
    numbers = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens[len(letters) :])}
    automaton = bpe.Automaton({i: t for t, i in numbers.items()}, [(numbers[a], numbers[b], numbers[a + b]) for a, b in merges])
    ranks = {pair: i for i, pair in enumerate(merges)}
    words = [bytes(w) for n in range(1, 8) for w in itertools.product(b"abc"[: len(letters)], repeat=n)][:3000]
    words += [bytes(rng.choice(b"abc") for _ in range(60)) for _ in range(50)]
    ids, ends = automaton.walk(np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words]))
    begins = np.append(0, ends[:-1])
    for word, a, b in zip(words, begins, ends, strict=True):
        assert ids[a:b].tolist() == [numbers[t] for t in plain_merging([bytes([x]) for x in word], ranks)]


def test_vocabularies_of_other_kinds_are_refused(spark, tmp_path):
    path = tmp_path / "other.json"
    path.write_text('{"model": {"type": "WordPiece", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}}')
    with pytest.raises(ValueError, match="other.json"):
        bpe.digest(spark.createDataFrame([(1, "a")], "doc_id long, text string"), str(path))


def test_long_texts_are_coded_slice_by_slice(monkeypatch):
    from pathlib import Path

    coder = bpe._loaded.setdefault("test", bpe.Coder(Path(queries.BPE_FILE).read_text(encoding="utf-8")))
    texts = ["one two  three\n four <|endoftext|> five" * 9, None, "x" * 500, "a b " * 100]
    whole = coder.digest(texts)
    monkeypatch.setattr(bpe, "SLICE", 16)
    assert coder.digest(texts) == whole
    assert coder.decode(coder.encode(texts)) == [(t or "").encode() for t in texts]


def test_gradient_of_the_field():
    rng = np.random.default_rng(3)
    lengths, labels = np.array([4, 1, 7, 3]), np.array([1, 0, 0, 1])
    mask = np.arange(7) < lengths[:, None]
    flat, balance = rng.normal(size=(int(lengths.sum()), 5)), rng.uniform(0.2, 2, 4)
    start = rng.normal(size=9) * 0.5
    value = lambda p: quality.likelihood(p[:5], p[5:].reshape(2, 2), flat, mask, labels, balance)
    _, gradient = value(start)
    for i in range(9):
        step = np.zeros(9)
        step[i] = 1e-5
        assert abs((value(start + step)[0] - value(start - step)[0]) / 2e-5 - gradient[i]) < 1e-6


def test_field_against_all_labellings():
    rng = np.random.default_rng(5)
    weights, chain, flat = rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=(6, 3))
    scores = flat @ weights
    total, good = 0.0, np.zeros(6)
    for labels in itertools.product((0, 1), repeat=6):
        p = np.exp(sum(s for s, y in zip(scores, labels) if y) + sum(chain[a, b] for a, b in zip(labels, labels[1:])))
        total += p
        good += p * np.array(labels)
    model = quality.Model(weights, chain, 1.0, 0.0)
    assert np.allclose(model.marginals(flat, np.array([6])), good / total)
    held = scores.sum() + 5 * chain[1, 1] - np.log(total)
    beta = np.concatenate([weights, chain.reshape(-1)])
    assert np.isclose(quality.likelihood(weights, chain, flat, np.ones((1, 6), bool), np.array([1]), np.ones(1))[0], held - quality.PENALTY / 2 * beta @ beta)


@pytest.mark.parametrize("label", (0, 1))
def test_labels_of_one_kind(spark, label):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(label).alias("quality"))
    rows = quality.query(docs, labels).collect()
    assert {r["predicted"] for r in rows} == {label} and all((r["score"] > 0.5) == bool(label) for r in rows)


def test_longest_match_passes_a_window(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(["x", *words[5:35], "y", *words[:14]])), (2, " ".join(words[:12])), (3, "short one"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "short one")], "item_id long, text string")
    got = {r["doc_id"]: (r["longest"], r["n_hit"], r["items"]) for r in decontaminate.find(docs, items).collect()}
    assert got == {1: (30, 44, [1]), 2: (12, 0, []), 3: (2, 2, [2]), 4: (0, 0, [])}


def test_archives_are_read_side_by_side_and_merged(spark, monkeypatch):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".example/p"), F.col("id") % 50).alias("url"), F.concat(F.lit("body "), F.col("id") % 30).alias("html"))
    folder = shared_dir(spark, "warc-many")
    manifest = warc.write_archives(pages.repartition(5), folder)
    files = manifest.count()
    captures = warc.read_archives(manifest, folder)
    assert files > 1 and captures.rdd.getNumPartitions() == files
    merged = warc.merge_index(captures, 60)
    assert merged.rdd.getNumPartitions() > 3
    order = [warc.capture_order(tuple(r)) for r in merged.collect()]
    assert order == sorted(order) and len(order) == 400
    assert merged.where("record_type = 'response'").count() == 30


def test_records_of_an_archive():
    file = "part-0.warc.gz"
    one, two = (warc.parse(warc.record(warc.record_id(file, n), 5, "http://a.example/", b"", 4, "X", 3, "http://b.example/")) for n in (1, 2))
    assert one["headers"]["WARC-Record-ID"] != two["headers"]["WARC-Record-ID"]
    assert one["headers"]["WARC-Refers-To-Target-URI"] == "http://b.example/" and "WARC-Refers-To-Date" in one["headers"]
    assert warc.parse(warc.info(file))["headers"]["WARC-Type"] == "warcinfo"
