"""Queries of the streaming operators: each stream is run to its end over the frames of the embeddings and its sink is returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions.iterate import shared_path
from framewright.operators import compose, frames
from framewright.plans.base import Views, query
from framewright.plans.frame_queries import NEXT, rounded
from framewright.plans.source_queries import scratch
from framewright.streaming import streams


#: Frames of a file that a stream picks up.
FILE_FRAMES = 5000
#: Triggers at most over what has landed: with more files than that, a trigger takes several.
TRIGGERS = 16


def landed(s: Views) -> tuple[str, int]:
    """The frames as files that a stream picks up one by one, in order of the frame number, and their number: four, or one for FILE_FRAMES frames."""
    path, files = scratch(s, "stream"), max(4, -(-s.frames8.count() // FILE_FRAMES))
    last = s.frames8.agg(F.max("frame_idx")).first()[0] or 0
    kept = s.frames8.withColumn("part", F.floor(F.col("frame_idx") * files / (last + 1)))
    parts = shared_path(s.spark)
    kept.repartition("part").write.partitionBy("part").parquet(parts)  # a folder a part, so that each is read once
    for part in range(files):  # one after another, as files come to a stream
        s.spark.read.schema(kept.schema).parquet(parts).where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path, files


def arriving(s: Views):
    """The stream of the landed files, in TRIGGERS triggers at most."""
    path, files = landed(s)
    return streams.read_stream(s.spark, path, -(-files // TRIGGERS))


def sink(s: Views, stream, mode: str = "append"):
    """Runs a stream over what is there, into a Parquet table."""
    path = scratch(s, "sink")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", scratch(s, "checkpoint")).trigger(availableNow=True).start(path).awaitTermination()
    return s.spark.read.parquet(path)


@query("h1_differences", f"select video_id, frame_idx, list(v order by y, x) as data from (select video_id, y, x, frame_idx, {NEXT} - v as v from pixels8) where v is not null group by 1, 2", "pixels8")
def h1(s: Views):
    key, before = "spark.sql.streaming.stateStore.providerClass", s.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return sink(s, streams.differences(arriving(s)))
    finally:
        s.spark.conf.set(key, before)


@query("h2_running", "select video_id, y, x, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, count(*) as n from pixels8 group by 1, 2, 3", "pixels8")
def h2(s: Views):
    path = scratch(s, "running")

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number:06d}")

    running = streams.running_statistics(arriving(s))
    stream = running.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(s, "checkpoint")).trigger(availableNow=True).start()
    stream.awaitTermination()
    last = max(p["batchId"] for p in stream.recentProgress if p["sink"]["numOutputRows"] != 0) if stream.recentProgress else 0
    return rounded(s.spark.read.parquet(f"{path}/{last:06d}"), "mean", "std")


@query("h3_filters", "select video_id, frame_idx, y - 2 as y, x - 1 as x, 255 - v as v from pixels8 where frame_idx % 10 = 0 and x >= 1 and x < 5 and y >= 2 and y < 7", "pixels8")
def h3(s: Views):
    steps = (lambda p: frames.every_nth(p, 10), lambda p: frames.crop(p, 1, 2, 4, 5), lambda p: frames.map_values(p, lambda v: 255 - v))
    return sink(s, streams.filtered(arriving(s), *steps))


@query("h4_listener", "select video_id, frame_idx, sum(v)::bigint as total from pixels8 group by 1, 2", "pixels8")
def h4(s: Views):
    path = scratch(s, "listener")
    seen = lambda batch, number: batch.select("video_id", "frame_idx", F.aggregate("data", F.lit(0).cast("long"), lambda a, v: a + v).alias("total")).write.mode("overwrite").parquet(f"{path}/batch={number}")
    streams.fan_out(arriving(s), scratch(s, "checkpoint"), seen).awaitTermination()
    return s.spark.read.parquet(path).drop("batch")


@query("h5_two_consumers", "select video_id, 'bright' as kind, count(*) as n from pixels8 where v >= 140 group by 1 union all select video_id, 'frames', count(distinct frame_idx) from pixels8 group by 1", "pixels8")
def h5(s: Views):
    path = scratch(s, "consumers")

    def bright(batch, number: int) -> None:
        batch.select("video_id", F.explode("data").alias("v")).where("v >= 140").groupBy("video_id").agg(F.lit("bright").alias("kind"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/bright/batch={number}")

    def count(batch, number: int) -> None:
        batch.groupBy("video_id").agg(F.lit("frames").alias("kind"), F.count_distinct("frame_idx").alias("n")).write.mode("overwrite").parquet(f"{path}/frames/batch={number}")

    streams.fan_out(arriving(s), scratch(s, "checkpoint"), bright, count).awaitTermination()
    both = s.spark.read.parquet(f"{path}/bright").unionByName(s.spark.read.parquet(f"{path}/frames"))
    return both.groupBy("video_id", "kind").agg(F.sum("n").alias("n"))


@query("g11_annotate", "select video_id, frame_idx, y, x, case when y = 0 then 255 else v end as v from pixels8", "pixels8")
def g11(s: Views):
    """Annotates a copy of a running video: a static layer on every batch."""
    path = scratch(s, "annotated")
    layer = s.spark.createDataFrame([(0, x, 1, 255) for x in range(8)], "y int, x int, z int, color int")
    draw = lambda batch, number: compose.layers(streams.filtered(batch), layer).write.mode("overwrite").parquet(f"{path}/batch={number}")
    streams.fan_out(arriving(s), scratch(s, "checkpoint"), draw).awaitTermination()
    return s.spark.read.parquet(path).drop("batch")
