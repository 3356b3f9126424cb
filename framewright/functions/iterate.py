"""Iterate-until-stable and pointer doubling on DataFrames.

Each round is written as a table to the folder that spark.checkpoint.dir names, so lineage stays short and a lost executor
costs no recomputation of earlier rounds. Only counters reach the driver. All groups (frames, shapes, graphs) advance in the same rounds.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a temporary folder only in a local session without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-rounds-")
    return f"{base.rstrip('/')}/round-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: one pass, no lineage. Joins shuffle it: pixels and links are many times as large in memory as in
    their files, by whose size Spark would broadcast them."""
    return _cut(df)[0]


def _cut(df: DataFrame) -> tuple[DataFrame, str]:
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge"), path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeats `step`, which returns the next state with a boolean `changed` column, until no row has changed.

    There is no limit of rounds: every step must bring its rows nearer to their end. A round's table is deleted once the next is written.
    """
    before = None
    while True:
        after, path = _cut(step(state))
        state = after.drop("changed")
        if before is not None:
            _delete(after.sparkSession, before)
        before = path
        if not after.where("changed").take(1):
            return state


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node and `label`, the least node of its component, for `nodes` (node) under `links` (a, b): neighbours' minimum, then a pointer jump, each round."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())

    def step(now: DataFrame) -> DataFrame:
        near = both.join(now.select(F.col("node").alias("b"), F.col("label").alias("low")), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        new = now.join(near, "node", "left").select("node", "label", F.least("label", "low").alias("low"))
        ahead = new.select(F.col("node").alias("low"), F.col("low").alias("low2"))
        return new.join(ahead, "low").select("node", F.col("low2").alias("label"), (F.col("low2") < F.col("label")).alias("changed"))

    return until_stable(nodes.select("node", F.col("node").alias("label")), step)


def order_by_doubling(links: DataFrame, keys: list[str]) -> DataFrame:
    """Rank of every node of chains: `links` has keys, node, next (null at the end); the result has keys, node, head (the chain's last node), rank.

    rank counts the steps to the end; each round doubles the length of the jumps. The links must not close a ring.
    """
    state = links.select(*keys, "node", F.coalesce("next", "node").alias("jump"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("rank"))

    def step(now: DataFrame) -> DataFrame:
        ahead = now.select(*keys, F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("rank").alias("rank2"))
        return now.join(ahead, [*keys, "jump"]).select(*keys, "node", F.col("jump2").alias("jump"), (F.col("rank") + F.col("rank2")).alias("rank"), (F.col("jump2") != F.col("jump")).alias("changed"))

    return until_stable(cut(state), step).withColumnRenamed("jump", "head")
