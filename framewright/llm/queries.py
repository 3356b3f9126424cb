"""The registered queries of the thirteen operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers

from framewright.llm import bpe, decontaminate, jaccard_join, line_dedup, manifest, near_dups, quality, sharding, substrings, suffixes, topk, warc, whitening
from framewright.llm.common import table

#: The vocabulary of the BPE query.
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")

QUERIES = {
    "op1_line_dedup": lambda spark, sf_dir: line_dedup.query(table(spark, sf_dir, "documents")),
    "op2_quality": lambda spark, sf_dir: quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_suffixes": lambda spark, sf_dir: suffixes.query(table(spark, sf_dir, "documents")),
    "op4_decontaminate": lambda spark, sf_dir: decontaminate.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op5_sharding": lambda spark, sf_dir: sharding.query(table(spark, sf_dir, "documents")),
    "op6_near_dups": lambda spark, sf_dir: near_dups.query(table(spark, sf_dir, "documents")),
    "op7_topk": lambda spark, sf_dir: topk.query(table(spark, sf_dir, "embeddings")),
    "op8_bpe": lambda spark, sf_dir: bpe.digest(table(spark, sf_dir, "documents"), BPE_FILE),
    "op9_substrings": lambda spark, sf_dir: substrings.query(table(spark, sf_dir, "documents")),
    "op10_warc": lambda spark, sf_dir: warc.query(table(spark, sf_dir, "pages")),
    "op11_jaccard_join": lambda spark, sf_dir: jaccard_join.query(table(spark, sf_dir, "documents")),
    "op12_manifest": lambda spark, sf_dir: manifest.query(table(spark, sf_dir, "documents")),
    "op13_whitening": lambda spark, sf_dir: whitening.query(table(spark, sf_dir, "embeddings")),
}

ORACLE_SQL = {
    "op1_line_dedup": line_dedup.oracle(),
    "op3_suffixes": suffixes.ORACLE,
    "op4_decontaminate": decontaminate.oracle(),
    "op5_sharding": sharding.oracle(),
    "op6_near_dups": near_dups.oracle(),
    "op7_topk": topk.ORACLE,
    "op9_substrings": substrings.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_jaccard_join": jaccard_join.oracle(),
    "op12_manifest": manifest.oracle(),
}
