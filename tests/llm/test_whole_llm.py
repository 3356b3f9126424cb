"""Cases in which an operator once did less than its whole job."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import quality, topk


def test_topk_keeps_large_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.choice([0, 3, 6, 9, 14])]) for i in range(0, 500, 5)]
    rows += [(1000, [1e308, -1e300, 3.0, 0.25]), (1100, [-1e308]), (1200, [40_000.0, 0.0, 0.0, 1.0]), (1201, [40_000.0, 0.0, 0.0, 1.0]), (1202, []), (1203, [float("inf")] * 4), (1300, [0.001] * 9000)]
    rows += [(1400 + i, [1e15 + i * 0.125, 1e-3]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    usable = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if all(map(math.isfinite, v))]
    exact, longs = set(), set()
    for q, a in usable:
        if q % 100 == 0:
            for k, (s, i) in enumerate(sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q)[:10]):
                exact.add((q, k + 1, i, str(-s)))
                longs.add((q, k + 1, i, -s if -(1 << 63) <= -s < 1 << 63 else None))
    assert {r[0] for r in exact} >= {1000, 1100, 1200, 1300, 1400}
    ready = topk.quantise(vectors)
    assert {tuple(r) for r in topk.search(ready, ready.where("vec_id % 100 = 0"), 10, 3, text=True).collect()} == exact
    assert {tuple(r) for r in topk.query(vectors).collect()} == longs


def test_quality_sample_survives_a_very_long_document(spark):
    good, bad = "A plain sentence of ordinary words, with an end.", "$$$ CLICK | HERE | NOW | 1234567 !!! $$$"
    rows = [(i, "\n".join([good if i % 2 else bad] * 3)) for i in range(1, 60)]
    first = spark.range(60, 2000).where(~quality.held_out("id")).orderBy(F.xxhash64("id")).first()["id"]
    docs = spark.createDataFrame([*rows, (first, "\n".join([good] * 130_000))], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i, _ in rows], (first, 1, 0)], "doc_id long, quality int, toxic int")
    judged = {r["doc_id"]: r["predicted"] for r in quality.query(docs, labels).collect()}
    assert judged == {i: i % 2 for i, _ in rows} | {first: 1}


def test_quality_sample_has_both_labels(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(quality, "SAMPLE_LINES", 100)
    docs = spark.createDataFrame([(i, "\n".join(["$$$ 123 | 456 | !!!" if i == 2998 else "plain words in a line"] * 10)) for i in range(2000, 3000)], "doc_id long, text string")
    labels = docs.where(~quality.held_out("doc_id") | (F.col("doc_id") == 2998)).select("doc_id", (F.col("doc_id") != 2998).cast("int").alias("quality"))
    assert labels.where(~quality.held_out("doc_id") & (F.col("doc_id") == 2998)).count() == 1
    assert quality.fit(docs, labels) is not None
