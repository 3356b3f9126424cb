"""Streaming forms of the frame operators, by Structured Streaming over packed frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from framewright.sources.catalog import FRAMES, unpack

DIFFERENCES = "video_id int, frame_idx long, data array<int>"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Packed frames from a folder to which Parquet files are added."""
    return spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class PreviousFrame(StatefulProcessor):
    """Keeps the last frame of each video; a gap in the numbers starts anew. Frames of a video must arrive in order, trigger by trigger;
    how many come at once is bounded by the files of a trigger."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "frame_idx long, data array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        held = None if state is None else (state[0], np.array(state[1], np.int32))
        batch = pd.concat(list(rows)).sort_values("frame_idx")  # one trigger's frames of one video: as many as its files hold
        numbers, differences = [], []
        for number, data in zip(batch["frame_idx"].tolist(), batch["data"], strict=True):
            data = np.asarray(data, np.int32)
            if held is not None and held[0] == number - 1:
                numbers.append(held[0])
                differences.append(data - held[1])
            held = (number, data)
        if held is not None:
            self.last.update((int(held[0]), held[1].tolist()))
        yield pd.DataFrame({"video_id": pd.Series([key[0]] * len(numbers), dtype="int32"), "frame_idx": pd.Series(numbers, dtype="int64"), "data": differences})

    def close(self) -> None:
        pass


def differences(frames: DataFrame) -> DataFrame:
    """Difference of consecutive frames; the state is one packed frame for each video. Needs the RocksDB state store."""
    return frames.groupBy("video_id").transformWithStateInPandas(statefulProcessor=PreviousFrame(), outputStructType=DIFFERENCES, outputMode="append", timeMode="None")


def running_statistics(frames: DataFrame) -> DataFrame:
    """Running mean and sample deviation of each pixel; use update or complete mode."""
    return unpack(frames).groupBy("video_id", "y", "x").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count(F.lit(1)).alias("n"))


def filtered(frames: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless filters on a stream: the same functions as on tables."""
    pixels = unpack(frames).drop("c")
    for step in steps:
        pixels = step(pixels)
    return pixels


class ProgressLog(StreamingQueryListener):
    """Keeps the number of rows of every trigger of every stream, by the stream's run: a listener for `spark.streams.addListener`."""

    def __init__(self) -> None:
        self.rows: dict[str, list[int]] = {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.runId)] = []

    def onQueryProgress(self, event) -> None:
        self.rows.setdefault(str(event.progress.runId), []).append(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def fan_out(frames: DataFrame, checkpoint: str, *consumers: Callable[[DataFrame, int], None]):
    """Several consumers of one stream: every batch is kept once and handed to each in turn."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for consumer in consumers:
                consumer(batch, number)
        finally:
            batch.unpersist()

    return frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
