"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's shared folder, which spark.checkpoint.dir names.

    Only in a local session without that setting a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts lineage and outlives executors."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` as `materialise` gives it, and its path, for tables that are deleted once the next is written."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a shared path that no later job reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def private(*names: str) -> list[str]:
    """Column names that no input has."""
    token = uuid.uuid4().hex
    return [f"{name}_{token}" for name in names]


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` less the columns of these names, which new ones replace."""
    taken = {n.lower() for n in names}
    return df.select(*[df[c] for c in df.columns if c.lower() not in taken])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
