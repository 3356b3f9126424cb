"""Sources, catalogues and sinks of frame tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.numbering import numbered

#: Schema of packed frames as stored.
FRAMES = T.StructType([T.StructField("video_id", T.IntegerType()), T.StructField("frame_idx", T.LongType()), T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("data", T.ArrayType(T.IntegerType()))])


def video_catalogue(pixels: DataFrame) -> DataFrame:
    """Width, height, frame count and colour flag of each video."""
    color = F.max("c") > 0 if "c" in pixels.columns else F.lit(False)
    return pixels.groupBy("video_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count_distinct("frame_idx").alias("frame_count"), color.alias("is_color"))


def unpack(frames: DataFrame) -> DataFrame:
    """Long pixels of packed frames; `c` is left out of grey ones."""
    p = frames.select("video_id", "frame_idx", "width", "channels", F.posexplode("data").alias("p", "v"))
    cell = F.floor(F.col("p") / F.col("channels"))
    return p.select("video_id", "frame_idx", F.floor(cell / F.col("width")).cast("int").alias("y"), (cell % F.col("width")).cast("int").alias("x"), (F.col("p") % F.col("channels")).alias("c"), "v")


def pack(pixels: DataFrame, height: int, width: int, channels: int = 1) -> DataFrame:
    """Packed frames of long pixels: each frame's values in row-major order."""
    c = F.col("c") if "c" in pixels.columns else F.lit(0)
    items = F.array_sort(F.collect_list(F.struct(((F.col("y") * width + F.col("x")) * channels + c).alias("p"), "v")))
    return pixels.groupBy("video_id", "frame_idx").agg(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("channels"), F.transform(items, lambda s: s["v"]).alias("data"))


def write_frames(frames: DataFrame, path: str) -> None:
    """Parquet by video, sorted by frame so that row groups prune seeks."""
    frames.repartition("video_id").sortWithinPartitions("video_id", "frame_idx").write.mode("overwrite").partitionBy("video_id").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frame tables below a path or glob, with the file they come from."""
    return spark.read.schema(FRAMES).parquet(path).withColumn("file", F.input_file_name())


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _byte_values(data: pd.Series) -> pd.Series:
    """The bytes of each value as numbers."""
    return data.map(lambda raw: np.frombuffer(raw, np.uint8).astype(np.int32))


def png(height: int, width: int, channels: int, data) -> bytes:
    """An image file of a packed frame, grey or red, green, blue."""
    rows = np.asarray(data, np.uint8).reshape(height, width * channels)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    parts = ((b"IHDR", head), (b"IDAT", zlib.compress(lines)), (b"IEND", b""))
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in parts)


def write_images(frames: DataFrame, folder: str) -> int:
    """Writes each packed frame as an image below `folder` (a URI that all machines reach), named by video and frame number; how many."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                with files.open_output_stream(f"{root}/{r['video_id']:08d}-{r['frame_idx']:012d}.png") as out:
                    out.write(png(r["height"], r["width"], r["channels"], r["data"]))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return frames.select("video_id", "frame_idx", "height", "width", "channels", "data").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _same_form(path: Column) -> Column:
    """A path with one slash behind its scheme: sources write one or three."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def read_images(spark: SparkSession, pattern: str) -> DataFrame:
    """An image stack: the sorted paths number the frames; pixels come as blue, green, red."""
    images = spark.read.format("image").load(pattern).select("image.*")
    paths = spark.read.format("binaryFile").load(pattern).select(_same_form(F.col("path")).alias("origin"))  # no content is read, let alone decoded
    order = numbered(paths, [F.col("origin")], "frame_idx")
    known = images.withColumn("origin", _same_form(F.col("origin"))).join(order, "origin").where("height > 0")
    p = known.select("frame_idx", "width", "nChannels", F.posexplode(_byte_values("data")).alias("p", "v"))
    cell = F.floor(F.col("p") / F.col("nChannels"))
    return p.select(F.lit(0).alias("video_id"), "frame_idx", F.floor(cell / F.col("width")).cast("int").alias("y"), (cell % F.col("width")).cast("int").alias("x"), (F.col("p") % F.col("nChannels")).alias("c"), "v")


#: Numbers of a block of files whose lengths are added up together.
BLOCK = 4096


def concatenated(files: DataFrame) -> DataFrame:
    """Running frame offset of numbered files (idx, n). Sums of blocks of BLOCK numbers are added up first, then those within a block."""
    numbered = files.select("idx", "n", F.floor(F.col("idx") / BLOCK).alias("block"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = numbered.groupBy("block").agg(F.sum("n").alias("sum")).select("block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("block").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(blocks, "block")
    return placed.select("idx", "n", (F.col("start") + F.col("inner")).alias("offset"))


def agreeing(files: DataFrame) -> DataFrame:
    """Whether all files share rate, size and colour."""
    return files.agg((F.count_distinct(F.struct("fps", "width", "height", "is_color")) <= 1).alias("agree"))


def contiguous(files: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Files numbered from `start` up to the first gap, or `stop`."""
    known = files.where((F.col("idx") >= start) & (F.lit(True) if stop is None else F.col("idx") <= stop))
    last = known.select("idx").join(known.select((F.col("idx") - 1).alias("idx")), "idx", "left_anti").agg(F.min("idx")).first()[0]
    if last is None or not known.where(F.col("idx") == start).take(1):
        return known.where("false")
    return known.where(F.col("idx") <= last)


def locate(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """File and local frame of global frame numbers (`frame`): an equi-join on ranges of an average file's length."""
    at = concatenated(files).where("n > 0")
    size = max(1, round(at.agg(F.avg("n")).first()[0] or 1))
    spans = at.withColumn("cell", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.col("n") - 1) / size))))
    found = wanted.withColumn("cell", F.floor(F.col("frame") / size)).join(spans, "cell").where("frame >= offset and frame < offset + n")
    return found.select("frame", "idx", (F.col("frame") - F.col("offset")).alias("local"))


def overwrite(pixels: DataFrame, patch: DataFrame, upsert: bool = False) -> DataFrame:
    """Values replaced by those of a patch with the same keys; with `upsert` new keys are added."""
    keys = [c for c in pixels.columns if c != "v"]
    return pixels.join(patch.select(*keys, F.col("v").alias("__p")), keys, "full_outer" if upsert else "left").withColumn("v", F.coalesce("__p", "v")).drop("__p")


def noise(spark: SparkSession, frames: int, height: int, width: int, mean: float = 0.0, std: float = 1.0, seed: int = 0, bounds: tuple[int, int] | None = None) -> DataFrame:
    """A video of Gaussian noise; with bounds the values saturate and become integers."""
    cells = height * width
    value = F.randn(seed) * std + mean
    if bounds:
        value = F.least(F.lit(float(bounds[1])), F.greatest(F.lit(float(bounds[0])), value)).cast("int")
    return spark.range(frames * cells).select(F.lit(0).alias("video_id"), F.floor(F.col("id") / cells).alias("frame_idx"), F.floor(F.col("id") % cells / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"), value.alias("v"))


def refreshed(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """A catalogue (idx, fps, duration, is_new) with the files it lacks: rate from 'num/den', duration from the frame count if unknown."""
    ratio = F.split("rate", "/")
    fps = ratio[0].cast("double") / ratio[1].cast("double")
    fresh = found.join(catalogue.select("idx"), "idx", "left_anti").withColumn("fps", fps).select("idx", "fps", F.coalesce("duration", F.col("n") / F.col("fps")).alias("duration"), F.lit(True).alias("is_new"))
    return catalogue.select("idx", "fps", "duration", F.lit(False).alias("is_new")).unionByName(fresh)


def gaps(series: DataFrame, key: str, index: str, lengths: DataFrame) -> DataFrame:
    """What `filled` cannot fill, by key: `leading` indices before the first value; `trailing` ones after the last, and whether the series
    may end there (`ended`: fewer than 5, or than a hundredth of the length). `lengths` has key and n, the length that is promised."""
    ends = series.groupBy(key).agg(F.min(index).alias("a"), F.max(index).alias("z"))
    known = lengths.join(ends, key, "left").select(key, "n", F.coalesce("a", "n").alias("leading"), F.coalesce(F.col("n") - 1 - F.col("z"), F.lit(0)).alias("trailing"))
    return known.select(key, "leading", "trailing", ((F.col("trailing") < 5) | (F.col("trailing") < 0.01 * F.col("n"))).alias("ended"))


def filled(series: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Missing indices between the first and last take the last value before them; `gaps` tells what lies outside."""
    dense = series.groupBy(key).agg(F.min(index).alias("a"), F.max(index).alias("z")).select(key, F.explode(F.sequence("a", "z")).alias(index))
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(index).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dense.join(series.select(key, index, value), [key, index], "left").select(key, index, last.alias(value))


def as_bytes(value: Column, mode: str) -> Column:
    """Cast to 0..255: wrap, or abs_saturate (rounded magnitude, at most 255)."""
    return F.pmod(value.cast("int"), F.lit(256)) if mode == "wrap" else F.least(F.lit(255), F.round(F.abs(value)).cast("int"))
