"""Row numbers in a global order without a global sort in one task: a range partition, counts, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.iterate import cut


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """The rows with `name`, from 0 on, in the given order; rows that are equal in it are numbered in any order.

    Rows are dealt by ranges of the order and sorted inside each range; what every range begins with follows from the counts of those before it,
    a table with a row for each partition, which is broadcast.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = cut(dealt.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    counts = held.groupBy("__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(counts.select("__part", (before - F.col("__first")).alias("__shift")))
    return held.join(shifts, "__part").withColumn(name, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")
