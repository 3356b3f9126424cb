"""Operator 1: line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends and with A-Z lower-cased; keys of at least `min_chars` code points
count. Documents are taken in batches of ascending ids. A batch's distinct keys, each with its smallest id, are merge-anti-joined
with the runs, and those that no run holds become a new run of level 0. Runs are tables bucketed and sorted by the key's
hash as grouped batches are partitioned, so the anti-joins are sort-merge joins without a shuffle. Once `fanout` runs stand on a level,
they are compacted, by a merge without a shuffle, into one run of the next level. The runs never share a key, so together they name each key's owner: the
smallest id that holds it. Lines whose document is not the owner go.

Keys are compared by two 64-bit hashes with different seeds. Line texts are never shuffled; keys are counted per partition before
any shuffle, so a line that a third of all documents hold is one row for each task. Where lines meet their owners, Spark splits hot
partitions (skew join).

Defined cases. A null or empty text is one empty line. A null id counts as one document with the largest id. Rows with the same id are
one document: they keep each other's lines, and each is cleaned by itself. An empty table gives an empty result. Any other columns of
any name stay; only input columns that are called as the new ones are (`names`) give way to them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import ascii_lower, drop_path, private, shared_dir, without

#: The bytes stripped at both ends of a line.
SPACES = " \t\n\x0b\x0c\r"
LAST_ID = 2**63 - 1
NAMES = ("n_lines", "n_dropped", "kept_text")


def line_hashes(line: Column, min_chars: int) -> Column:
    """Array of the two hashes of a line's key, null for short keys."""
    key = ascii_lower(F.trim(line, F.lit(SPACES)))
    return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(F.lit(11), key).alias("h1"), F.xxhash64(F.lit(29), key).alias("h2")))


def lines_of(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """owner (the id, ordered), text_hash, position, h1, h2 of every line with a long enough key."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("owner"), F.xxhash64(text_col).alias("text_hash"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("position", "line"))
    return rows.select("owner", "text_hash", "position", line_hashes(F.col("line"), min_chars).alias("h")).where("h is not null").select("owner", "text_hash", "position", "h.h1", "h.h2")


class Runs:
    """The family of runs: a list of tables on each level, all below one shared folder."""

    def __init__(self, spark: SparkSession, fanout: int):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # as grouped batches are partitioned
        self.levels: list[list[tuple[str, str]]] = []

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def write(self, keys: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_dir(self.spark, "line-run")
        keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def add(self, batch: DataFrame) -> None:
        """Adds the keys (h1, h2, owner) that no run holds yet, then compacts full levels."""
        fresh = batch
        for run in self.tables():
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self.write(fresh))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0][0])
            for name, _ in full[1:]:
                other = self.spark.table(name).withColumnRenamed("owner", "other")
                merged = merged.join(other.hint("merge"), ["h1", "h2"], "full_outer").select("h1", "h2", F.coalesce("owner", "other").alias("owner"))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self.write(merged))
            for name, path in full:
                self.spark.sql(f"drop table {name}")
                drop_path(self.spark, path)
            level += 1

    def owners(self) -> DataFrame:
        """All keys with their owners, read as plain files: the reader may split hot partitions."""
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(*[path for level in self.levels for _, path in level])

    def forget(self) -> None:
        """Drops the tables from the catalogue; the files stay."""
        for level in self.levels:
            for name, _ in level:
                self.spark.sql(f"drop table {name}")


def batches_of(docs: DataFrame, batches: int, id_col: str) -> Column:
    """The number of the batch, of ascending ids and about as many documents, that an `owner` belongs to."""
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("owner"))
    cuts = ids.agg(F.percentile_approx("owner", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + (F.col("owner") > cut).cast("int")
    return number


def dedup(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = NAMES) -> DataFrame:
    """All columns, and those called `names`: lines, dropped lines, and the lines that stay, joined by a line feed."""
    spark = docs.sparkSession
    docs = without(docs, names)
    path = shared_dir(spark, "lines")
    numbered = lines_of(docs, min_chars, id_col, text_col).withColumn("batch", batches_of(docs, batches, id_col))
    numbered.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(numbered.schema).parquet(path)  # a batch is a folder of its own: each is read once
    runs = Runs(spark, fanout)
    try:
        for number in range(batches):
            runs.add(lines.where(F.col("batch") == number).groupBy("h1", "h2").agg(F.min("owner").alias("owner")))
        owners = runs.owners().withColumnRenamed("owner", "first_owner")
    finally:
        runs.forget()
    owner, text_hash, gone, split = private("owner", "text_hash", "gone", "lines")
    late = lines.join(owners, ["h1", "h2"]).where("first_owner < owner")
    keys = late.groupBy(F.col("owner").alias(owner), F.col("text_hash").alias(text_hash)).agg(F.collect_set("position").alias(gone))
    at = (F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)) == keys[owner]) & (F.xxhash64(docs[text_col]) == keys[text_hash])
    joined = docs.join(keys, at, "left").withColumn(split, F.split(F.coalesce(docs[text_col], F.lit("")), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    whole = F.coalesce(docs[text_col], F.lit(""))
    kept = F.when(F.col(gone).isNull(), whole).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(split), i)), "\n"))
    dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    counts = [F.size(split).cast("long").alias(names[0]), dropped.alias(names[1]), kept.alias(names[2])]
    return joined.select(*[docs[c] for c in docs.columns], *counts)


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def oracle(docs: str = "documents", min_chars: int = 10) -> str:
    """DuckDB SQL of the digest."""
    return f"""
with split_lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from {docs}),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from split_lines),
judged as (select *, length(k) >= {min_chars} and min(doc_id) over (partition by k) < doc_id as gone from keyed)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256 from judged group by doc_id"""
