"""The pipeline, stage by stage: each stage's rows against SQL or the tokenizers library over what its predecessor kept."""

import hashlib

import corpus_pipeline
import duckdb

from framewright.llm import decontaminate, line_dedup, near_dups, quality, queries


def test_stages(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    outputs = [docs.toArrow()]
    for _, stage in corpus_pipeline.STAGES:
        outputs.append(stage(spark, spark.createDataFrame(outputs[-1]), sf).toArrow())
    con = duckdb.connect()
    con.sql(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
    for i, table in enumerate(outputs):
        con.register(f"stage{i}", table)
        if i < 5:
            assert table.schema.names == docs.columns

    good = {r["doc_id"] for r in quality.query(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert set(outputs[1]["doc_id"].to_pylist()) == good and len(good) > 0.7 * len(outputs[0])

    want = dict(con.sql(f"select doc_id, kept_sha256 from ({line_dedup.oracle('stage1')})").fetchall())
    got = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in zip(outputs[2]["doc_id"].to_pylist(), outputs[2]["text"].to_pylist(), strict=True)}
    assert got == want and [len(t) for t in outputs[2]["text"].to_pylist()] == outputs[2]["n_chars"].to_pylist()

    kept = con.sql(f"select doc_id from ({near_dups.oracle('stage2')}) where kept").fetchall()
    assert sorted(outputs[3]["doc_id"].to_pylist()) == sorted(d for (d,) in kept)
    clean = con.sql(f"select doc_id from ({decontaminate.oracle('stage3')}) where not contaminated").fetchall()
    assert sorted(outputs[4]["doc_id"].to_pylist()) == sorted(d for (d,) in clean)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.BPE_FILE)
    tokens = {d: len(library.encode(t or "", add_special_tokens=False).ids) for d, t in zip(outputs[4]["doc_id"].to_pylist(), outputs[4]["text"].to_pylist(), strict=True)}
    assert dict(zip(outputs[5]["doc_id"].to_pylist(), outputs[5]["n_tokens"].to_pylist(), strict=True)) == tokens
