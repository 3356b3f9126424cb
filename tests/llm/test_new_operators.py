"""The Jaccard join, the Merkle manifest and whitening against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import bpe, chunks, decontaminate, jaccard_join, manifest, quality, queries, substrings, suffixes, topk, whitening

DOCS = "doc_id long, source string, lang string, n_chars int, text string"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans({c: c + 32 for c in range(65, 91)})))


def joined(rows, size=3, percent=90):
    """(doc_id, shingles, component) of each row by all pairs."""
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if (w := words_of(t)) else set() for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (common and 100 * common >= percent * len(sets[i] | sets[j])):
                a, b = label[i], label[j]
                label = [min(a, b) if c in (a, b) else c for c in label]
    least = defaultdict(lambda: 2**63)
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min(least[c], i)
    return sorted((i, len(s), least[c]) for (i, _), s, c in zip(rows, sets, label, strict=True))


def mutated(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        if rng.random() < 0.5:
            words[at] = f"n{rng.randrange(10**6)}"
        else:
            del words[at]
    return words


@pytest.fixture(scope="module")
def corpus():
    """Groups of copies at all distances from the threshold, short texts, and a template that many share."""
    rng, rows = random.Random(5), []
    for length in (4, 9, 12, 20, 33, 60, 150, 400):
        for _ in range(4):
            base = [f"w{rng.randrange(3000)}" for _ in range(length)]
            for _ in range(6):
                rows.append(mutated(rng, base, rng.choice([0, 0, 1, 1, 2, length // 40, length // 25])) or ["x"])
    frame = [f"t{i}" for i in range(14)]
    rows += [[*frame, f"v{i}", f"u{i % 7}"] for i in range(40)]
    texts = [" ".join(w) for w in rows] + [None, "", "  ", "One", "one", "two words", "TWO words"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts, strict=True))


@pytest.mark.parametrize("key_cost", (0.05, 1e-9))
def test_jaccard_join_against_all_pairs(spark, corpus, monkeypatch, key_cost):
    monkeypatch.setattr(jaccard_join, "KEY_COST", key_cost)
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    for percent in (90, 75):
        got = sorted(map(tuple, jaccard_join.link(docs, percent).collect()))
        assert got == joined(corpus, percent=percent)


def test_jaccard_join_exchanges_a_dear_segment(spark):
    """Where a template fills a segment, its keys go and one-deletion keys of another segment come."""
    rng = random.Random(3)
    rows = [(i, " ".join([f"t{j}" for j in range(16)] + [f"x{rng.randrange(500)}" for _ in range(2)])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    plain = jaccard_join.swaps
    jaccard_join.swaps = lambda *a: seen.append(plain(*a)) or seen[-1]
    try:
        got = sorted(map(tuple, jaccard_join.query(docs).collect()))
    finally:
        jaccard_join.swaps = plain
    assert seen[0] and got == joined(rows)


def test_segments_hold_the_pigeonhole():
    """Sets within the bound of their band agree in a segment, or differ by one shingle in one with an allowance of 2."""
    rng, bands = np.random.default_rng(2), jaccard_join.Bands(90, 5000)
    for _ in range(300):
        size = int(rng.integers(20, 3000))
        one = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        band = bands.of(len(one))[0]
        count = bands.segments(band)
        gone = rng.choice(len(one), min(count - 1, len(one) // 12), replace=False)
        two = np.delete(one, gone)
        if 100 * len(two) < 90 * len(one) or band not in bands.of(len(two)):
            continue
        assert set(jaccard_join.segment_keys(one, band, count)[0]) & set(jaccard_join.segment_keys(two, band, count)[0])
        less = np.delete(one, gone[:1])
        place = int((one[gone[0]] >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)) if len(gone) else None
        if place is not None:
            near = set(jaccard_join.segment_keys(one, band, count, np.array([place]))[0])
            assert near & set(jaccard_join.segment_keys(less, band, count)[0])


def test_jaccard_join_of_odd_documents(spark, odd_documents, no_documents):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.query(odd_documents).collect()}
    assert {r[0] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None} and (3, 0, 3) in rows and (6, 998, 5) in rows and (5, 997, 5) in rows
    assert jaccard_join.query(no_documents).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def proofs(rows):
    """The digest's rows by plain loops."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, sha(*map(field, row)), row))

    def tree(hashes):
        levels = [hashes]
        while len(levels[-1]) > 1:
            levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        groups[name].sort(key=lambda t: t[:3])
    trees = [tree([t[2] for t in groups[name]]) for name in names]
    top, out = tree([t[-1][0] for t in trees]), []
    for k, name in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(groups[name]):
            held, siblings = leaf, ""
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                held = sha(*map(field, (*row[:4], row[4].replace("\n", ""))))
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    start = at // 3 * 3
                    run, own = level[start : start + 3], at - start
                    siblings += "".join(run[:own] + run[own + 1 :])
                    held, at = sha(*run[:own], held, *run[own + 1 :]), at // 3
            out.append((row[0], leaf, trees[k][-1][0], top[-1][0], sha(siblings), held, held == top[-1][0]))
    return out


@pytest.mark.parametrize("count", (0, 1, 2, 4, 28, 2500))
def test_manifest_against_loops(spark, count):
    rows = [(None if i % 7 == 0 else i // 2, None if i % 5 == 0 else "hot" if count > 100 else f"ü{i % 9}", "en", i, ["a\nb", None, "", "x\n漢\n"][i % 4]) for i in range(count)]
    rows += rows[:1] * 3
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit(1)).withColumn("tree", F.lit("x"))
    assert sorted(map(repr, map(tuple, manifest.query(docs.repartition(3)).collect()))) == sorted(map(repr, proofs(rows)))


def test_manifest_joins_many_upper_nodes(spark, monkeypatch):
    monkeypatch.setattr(manifest, "BROADCAST_NODES", 0)
    rows = [(i, f"s{i % 3}", None, None, f"text {i}\n") for i in range(3 * 2300)]
    assert sorted(map(tuple, manifest.query(spark.createDataFrame(rows, DOCS)).collect())) == sorted(proofs(rows))


def covariance_form(vectors, most=32):
    """Ids, n, deviations, whitened and explained by the covariance's eigenvectors."""
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, width = len(kept), max((len(v) for _, v in kept), default=0)
    x = [[math.floor(Fraction(c) * 64) + 1000000 for c in v] + [1000000] * (width - len(v)) for _, v in kept]
    sums = [sum(c) for c in zip(*x, strict=True)]
    apart = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    rows = np.array([[t / n for t in r] for r in apart])
    values, parts = np.linalg.eigh(rows.T @ rows / n)
    values, parts = values[::-1], parts[:, ::-1]
    k = min(most, width)
    with np.errstate(all="ignore"):
        white = rows @ parts[:, :k] / np.sqrt(np.maximum(values[:k], 0))
    return [i for i, _ in kept], n, [sum(t * t for t in r) for r in apart], white, values[:k] / values.sum()


def assert_whitened(frame, vectors, same=True):
    ids, n, away, white, explained = covariance_form(vectors)
    got = defaultdict(dict)
    for r in frame.collect():
        got[r["vec_id"]][r["component"]] = r
        assert r["n"] == n and r["identity_error"] <= 1e-6
    assert sorted(got) == sorted(ids) and all(sorted(g) == list(range(1, white.shape[1] + 1)) for g in got.values())
    assert [got[i][1]["deviation"] for i in ids] == [d if d < 1 << 63 else None for d in away]
    ours = np.array([[math.nan if got[i][c + 1]["whitened"] is None else got[i][c + 1]["whitened"] for c in range(white.shape[1])] for i in ids])
    real = explained > 1e-18
    assert np.isnan(ours).all(axis=0).tolist() == (~real).tolist()
    assert np.allclose([got[ids[0]][c + 1]["explained"] for c in np.flatnonzero(real)], explained[real], rtol=1e-6)
    if same:
        assert np.allclose(ours[:, real] * np.sign((ours * white).sum(axis=0))[real], white[:, real], atol=1e-6)


def test_whitening_against_eigenvectors(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert_whitened(whitening.query(frame.repartition(3)), [(r["vec_id"], r["embedding"]) for r in frame.collect()])


def test_whitening_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(c) for c in rng.normal(size=5) * [1e6, 1e3, 10, 1, 0.1]]) for i in range(200)]
    vectors += [(900, None), (901, [1.0, None]), (902, [math.nan]), (903, [1.0, 2.0]), (904, []), (905, [math.inf] * 5)]
    kind = "vec_id long, embedding array<double>, n long, component string"
    frame = spark.createDataFrame([(*v, 1, "x") for v in vectors], kind)
    assert_whitened(whitening.query(frame), vectors)
    monkeypatch.setattr(whitening, "FEW", 0)  # sums by a group-by
    assert_whitened(whitening.query(frame), vectors)
    assert whitening.query(frame.where("false")).count() == 0 and whitening.query(frame.where("vec_id = 904")).count() == 0
    assert [r["whitened"] for r in whitening.query(frame.where("vec_id = 903")).collect()] == [None, None]


def test_whitening_finds_repeated_eigenvalues(spark):
    corners = np.vstack([np.eye(40) * 7, -np.eye(40) * 7])
    vectors = [(i, [float(c) for c in r]) for i, r in enumerate(corners)]
    assert_whitened(whitening.query(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")), vectors, same=False)
    flat = [(i, [float(i % 3), 1.0, float(i % 3)]) for i in range(30)]
    assert_whitened(whitening.query(spark.createDataFrame(flat, "vec_id long, embedding array<double>")), flat, same=False)
    big = [(i, [1e13 * (i + 1), float(i)]) for i in range(20)]
    assert_whitened(whitening.query(spark.createDataFrame(big, "vec_id long, embedding array<double>")), big)


def test_decontamination_has_one_pass(spark):
    """One worker reads all blocks of the benchmark; results do not depend on their number, and short overlaps have their length."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 20, 40])))) for i in range(60)]
    texts = []
    for i in range(80):
        words = rng.choices(vocabulary, k=50)
        cut = items[rng.randrange(60)][1].split()
        texts.append((i, " ".join(words[:20] + cut[: rng.randrange(41)] + words[20:])))
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = decontaminate.find(docs, benchmark), decontaminate.find(docs, benchmark, block_bytes=400)
    assert many._jdf.queryExecution().toString().count("MapInArrow") == one._jdf.queryExecution().toString().count("MapInArrow")
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))

    def longest(a, b):
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
            best = max(best, *row)
        return best

    for r in one.collect():
        assert r["longest"] == max(longest(r["text"].split(), t.split()) for _, t in items)


def test_search_keeps_the_best_of_a_task(spark, monkeypatch):
    """Rows for the window are at most k for each query and task, over many blocks of rows and of queries."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(7)
    rows = [(i, [float(c) for c in rng.normal(size=6)]) for i in range(3000)]
    vectors = topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)).cache()
    folders = []
    plain = topk.shared_dir
    monkeypatch.setattr(topk, "shared_dir", lambda s, name: folders.append((name, plain(s, name))) or folders[-1][1])
    found = topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10, query_block=7)
    whole = {i: [math.floor(1024 * c) for c in v] for i, v in rows}
    want = {(q, n + 1, i, -s) for q in range(0, 3000, 100) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(whole[q], w, strict=True)), i) for i, w in whole.items() if i != q)[:10])}
    assert {tuple(r) for r in found.collect()} == want
    kept = spark.read.schema(topk.RESULT).option("recursiveFileLookup", "true").parquet(dict(folders)["search"])
    assert kept.count() <= 10 * 30 * 2 and "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_quality_trains_on_one_row_an_id(spark):
    good, bad = "A plain sentence of ordinary words, with an end.", "$$$ CLICK | HERE | NOW | 1234567 !!! $$$"
    rows = [(i, "\n".join([good if i % 2 else bad] * (i % 4 + 1))) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    trained = plain.where(~quality.held_out("doc_id")).first()
    copied = plain.unionByName(spark.range(10_000).select(F.lit(trained["doc_id"]).cast("long").alias("doc_id"), F.lit(trained["text"] + "\nmore").alias("text")))
    one, many = quality.fit(plain, labels), quality.fit(copied, labels)
    assert np.array_equal(one.weights, many.weights) and np.array_equal(one.chain, many.chain)


def test_quality_scores_by_enumeration(spark):
    """The query's scores are the length-weighted marginals over all labellings of the lines, through the logistic function."""
    rng = random.Random(2)
    good, bad = ["A plain sentence of words.", "It has an end, as usual.", "short"], ["$$$ 12 | 34 | 56 !!!", "BUY BUY BUY NOW", ""]
    rows = [(i, "\n".join(rng.choices(good if i % 2 else bad, k=rng.randrange(1, 6)) + rng.choices(good + bad, k=1))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.query(docs, labels).collect()}
    for i, text in rows:
        features, weights, _ = quality.line_features([text.encode()])
        odds, total, marginal = features.astype(float) @ model.weights, 0.0, np.zeros(len(features))
        for code in range(1 << len(features)):
            y = [code >> n & 1 for n in range(len(features))]
            mass = np.exp(sum(o for o, one in zip(odds, y, strict=True) if one) + sum(model.chain[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, marginal = total + mass, marginal + mass * np.array(y)
        mean = float(weights @ (marginal / total) / weights.sum())
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-(model.scale * mean + model.offset))), abs=1e-6)


def test_chunks_never_pass_the_allowed_buckets(spark, monkeypatch):
    """Whatever the input's size, the table of chunks keeps within Spark's limit; the results do not depend on it."""
    monkeypatch.setattr(chunks, "BUCKET_BYTES", 64)
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 64)
    passage = "a passage of many words that is found again, and again, in several of these texts; it has to be long enough to be one " * 3
    docs = spark.createDataFrame([(i, f"text {i} begins. {passage if i % 3 else ''} and ends {i}") for i in range(40)], "doc_id long, text string")
    wanted = [sorted(map(tuple, operator.query(docs).collect())) for operator in (suffixes, substrings)]
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        assert [sorted(map(tuple, operator.query(docs).collect())) for operator in (suffixes, substrings)] == wanted
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert any(r[2] for r in wanted[0])


def test_slices_end_at_sure_boundaries(monkeypatch):
    """Texts without spaces between words are cut as well, and encoded as the library does it."""
    import tokenizers

    monkeypatch.setattr(bpe, "SLICE", 32)
    coder, library = bpe.Coder(open(queries.BPE_FILE, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(queries.BPE_FILE)
    rng = random.Random(4)
    pieces = ["漢字", "。", "かな", "\n", "\n\n", "abc", "'s", "'", "'ll", "12", " ", "  ", "\t", "!?", "é", "x'", "🎉"]
    for _ in range(40):
        text = "".join(rng.choices(pieces, k=300))
        parts = list(coder.slices([text]))
        assert len(parts) > 5 and max(sum(len(p) for _, p, _ in part) for part in parts) < 80
        words = [p for part in parts for _, p, _ in part]
        assert "".join(words) == text
        assert [i for w in words for i in library.encode(w, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids
