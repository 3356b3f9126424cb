"""Chunks of whole documents, and number lists packed for the shuffle.

A chunk is a few MB of documents, ordered by id, as one compressed row. Operators that look at every window of every document exchange
sorted hashes between chunks and hash shards, and get back one bit for each hash, in the same order: texts
themselves are shuffled once, into a table bucketed by chunk, which later steps read without a shuffle.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import shared_dir

#: Bytes of text in a chunk (a longer document is a chunk alone) and in a bucket of chunks.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Inputs up to this size keep those sizes; beyond it chunks and shards grow with the root of the input, to at most `GROWTH` times.
GROW_FROM = 1 << 30
GROWTH = 4
LAST_ID = 2**63 - 1
CHUNK = "chunk long, blob binary"


def grown(size: int, total: int, most: int = GROWTH) -> int:
    """A chunk's or shard's size for `total` bytes of text, at most `most` times what small inputs have.

    As both grow with the root, the rows that chunks and shards exchange follow the input itself, not its square, up to 16 GB.
    The bound keeps what a task holds to some hundred MB.
    """
    return int(size * min(most, max(1.0, math.sqrt(total / GROW_FROM))))


def pack_documents(owners: list[int], known: list[bool], texts: list[bytes]) -> bytes:
    """Documents by ascending id as a compressed Arrow stream."""
    order = sorted(range(len(owners)), key=owners.__getitem__)
    batch = pa.record_batch({"owner": pa.array([owners[i] for i in order], pa.int64()), "known": pa.array([known[i] for i in order]), "text": pa.array([texts[i] for i in order], pa.binary())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_documents(blob: bytes) -> tuple[np.ndarray, list[int | None], list[bytes]]:
    """Ids for ordering, ids as given, and texts of a chunk."""
    table = pa.ipc.open_stream(blob).read_all()
    owners = table.column("owner").to_numpy()
    return owners, [o if k else None for o, k in zip(owners.tolist(), table.column("known").to_pylist(), strict=True)], table.column("text").to_pylist()


def _pack(chunk_bytes: int):
    """Documents of a task in chunks of about `chunk_bytes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        owners, known, texts, size = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | seen], pa.int64()), pa.array([pack_documents(owners, known, texts)], pa.binary())], ["chunk", "blob"])

        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or b""
                if texts and size + len(text) > chunk_bytes:
                    yield chunk()
                    owners, known, texts, size, seen = [], [], [], 0, seen + 1
                owners.append(LAST_ID if owner is None else owner)
                known.append(owner is not None)
                texts.append(text)
                size += len(text)
        if texts:
            yield chunk()

    return run


def stage(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The chunk table (chunk, blob), bucketed by chunk in the shared folder, and the bytes of all texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("owner"), F.encode(F.col(text_col), "utf-8").alias("text"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))  # more are refused; a bucket then holds more chunks, read one by one
    buckets, name = min(most, max(1, -(-total // grown(BUCKET_BYTES, total)))), f"chunks_{uuid.uuid4().hex}"
    rows.mapInArrow(_pack(grown(CHUNK_BYTES, total)), CHUNK).repartition(buckets, "chunk").write.bucketBy(buckets, "chunk").option("path", shared_dir(spark, "chunks")).saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"drop table {name}")  # from the catalogue only: the files, which `chunks` reads, stay
    return chunks, total


def squeeze(planes: np.ndarray) -> bytes:
    """A number array as zstd over its byte planes, without those that are all zero at the top."""
    width = planes.dtype.itemsize
    raw = planes.view(np.uint8).reshape(-1, width)
    while width > 1 and not raw[:, width - 1].any():
        width -= 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw[:, :width].T).tobytes())


def unsqueeze(data: bytes, dtype: type) -> np.ndarray:
    width, full = data[0], np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], full), np.uint8)
    out[:, :width] = raw.T
    return out.reshape(-1).view(dtype)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers by their differences."""
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(bool)).tobytes()


def unbits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count).astype(bool)


def slices_by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """The parts of an ascending array of shard numbers."""
    edges = np.searchsorted(keys, np.arange(shards + 1))
    return [(s, slice(int(edges[s]), int(edges[s + 1]))) for s in np.flatnonzero(np.diff(edges)).tolist()]


def scramble(values: np.ndarray, key: int) -> np.ndarray:
    """A keyed bijective mix of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = values * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))
