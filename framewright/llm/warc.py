"""Operator 10: WARC archives, written, read back and merged into one ordered capture index.

Writing: rows with equal payloads (SHA-1, another 64-bit hash and size) of at least `min_bytes` bytes form a group; the one with the
smallest id becomes a `response` record, the others `revisit` records that name its address and date and carry no payload. Every Spark
task writes its own archive files (a `warcinfo` record first, one gzip member a record) below the shared folder, and a new file beyond `FILE_BYTES`. File names carry the task
attempt, and only files that a successful attempt lists are read, so lost executors leave no doubles.

Reading: each archive is streamed record by record, as many archives at once as there are; payload digests are checked. The captures of
a file, sorted by (URL key, timestamp, id), are a run. The runs are range-partitioned by these three columns into parts of about
`rows_per_partition` rows; Spark brings the rows of a run together again in their order, spilling if it must, and each part merges
its pieces of all runs with a loser tree, a cursor on each, which gives a globally ordered capture history. A hot host or URL is split,
because timestamp and id are part of the range.

Defined cases. A null html is an empty payload; a null url has no target URI and the key ''. A null id ranks after every other
id; a group of null ids only is all responses. Rows that share both the smallest id and the payload are all responses. An empty
table gives no archives and no captures. Only the id, url and html columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import materialise, shared_dir

#: Compressed bytes after which a task begins a new archive.
FILE_BYTES = 32 << 20
#: The first capture's time; a page is captured a second after the one before it.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
SECONDS = 10**9
MANIFEST = "file string, records long"
CAPTURE = "url_key string, captured_at string, page_id long, run string, at long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """A sortable key: host labels from the right, then path and query. An address that cannot be split is its own key."""
    try:
        parts = urlsplit(url or "")
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url or ""
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "") if host else (url or "")


def record_id(file: str, number: int) -> str:
    """The id of a file's record: file names are unique."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{file} {number}')}>"


def captured(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % SECONDS)).strftime("%Y-%m-%dT%H:%M:%SZ")


def address(url: str) -> str:
    return quote(url, safe="".join(chr(c) for c in range(33, 127)))


def packed(content: bytes) -> bytes:
    """One gzip member."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def info(file: str) -> bytes:
    """The record that opens an archive."""
    fields = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {record_id(file, 0)}", f"WARC-Date: {captured(0)}", f"WARC-Filename: {file}"]
    lines += ["Content-Type: application/warc-fields", f"Content-Length: {len(fields)}", "", ""]
    return "\r\n".join(lines).encode() + fields + b"\r\n\r\n"


def record(name: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record; `payload` is empty for a revisit, `size` and `digest` are those of the full payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {captured(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + address(url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Date: {captured(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + address(refers_url))
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}", "", ""]
    return "\r\n".join(lines).encode() + http + b"\r\n\r\n"


def classify(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, digest (SHA-1 hex), and refers_to and refers_url (null for a response)."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keys = ["digest", "more", "size"]
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("more"), F.octet_length("payload").alias("size"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    groups = rows.where(F.col("size") >= min_bytes).groupBy(keys).agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = groups.where("copies > 1 and first is not null").select(*keys, F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    refers = [F.when(revisit, F.col("first_id")).alias("refers_to"), F.when(revisit, F.col("first_url")).alias("refers_url")]
    return rows.join(groups, keys, "left").select("page_id", "url", "payload", "digest", *refers)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        names, counts, out, written = [], [], None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or written >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz")
                    counts.append(0)
                    out, written = files.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                    out.write(packed(info(names[-1])))
                counts[-1] += 1
                digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                kept = b"" if row["refers_to"] is not None else row["payload"]
                name = record_id(names[-1], counts[-1])
                member = packed(record(name, row["page_id"], row["url"], kept, len(row["payload"]), digest, row["refers_to"], row["refers_url"]))
                out.write(member)
                written += len(member)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["file", "records"])

    return write


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives below `folder` (a URI that all machines reach) and returns the manifest: file, records."""
    return materialise(classify(pages, min_bytes, id_col, url_col, html_col).mapInArrow(_writer(folder), MANIFEST), "warc-manifest")


def members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every gzip member of a stream, one at a time."""
    at, rest, ended = 0, b"", False
    while True:
        start, unpacker, parts = at, zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    ended = True
                    break
            parts.append(unpacker.decompress(rest))
            at += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data
        if ended:
            if parts:
                raise ValueError("an archive ends inside a record")
            return
        yield start, b"".join(parts)


def parse(content: bytes) -> dict:
    """Headers, HTTP headers and payload of one record."""
    head, _, block = content.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http_headers = [line.split(": ", 1) for line in http.decode().split("\r\n")[1:]] if headers["Content-Type"].startswith("application/http") else []
    return {"headers": headers, "http": dict(http_headers), "payload": payload}


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        names = [f.name for f in schema_of(CAPTURE)]
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                run = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for at, content in members(stream):
                        r = parse(content)
                        if r["headers"]["WARC-Type"] == "warcinfo":
                            continue
                        h, size, kind = r["headers"], int(r["http"]["Content-Length"]), r["headers"]["WARC-Type"]
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(r["payload"]) != size or base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest):
                            raise ValueError(f"{name}: the record at {at} does not match its digest")
                        page, refers = (int(h[k]) if k in h else None for k in ("Page-ID", "Refers-To-Page-ID"))
                        run.append((url_key(h.get("WARC-Target-URI")), h["WARC-Date"], page, name, at, size, digest, kind, refers))
                if len(run) != expected:
                    raise ValueError(f"{name}: {len(run)} records, {expected} written")
                run.sort(key=capture_order)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*run, strict=True), schema_of(CAPTURE), strict=True)], names)

    return read


def capture_order(row: tuple) -> tuple:
    """URL key, timestamp, id (nulls first), then the place in the archives."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[3], row[4]


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed archives; the rows of a file are one locally sorted run."""
    return manifest.repartition(max(1, manifest.count()), "file").mapInArrow(_reader(folder), CAPTURE)


class LoserTree:
    """Merges sorted sequences: inner nodes hold the losers of their matches, the root the winner."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.size = runs, max(1, len(runs))
        self.heads = [self.take(i) for i in range(len(runs))] or [None]
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.beats(a, b) else (b, a)
        self.losers[0] = winners[1] if self.size > 1 else 0

    def take(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (capture_order(row), row)

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x[0] <= y[0]

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[winner := self.losers[0]]) is not None:
            yield head[1]
            self.heads[winner] = self.take(winner)
            node = (winner + self.size) // 2
            while node:
                if self.beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.losers[0] = winner


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of one range partition, which come one after another, each in order."""
    runs: dict[str, list[pa.RecordBatch]] = {}
    names = [f.name for f in schema_of(CAPTURE)]
    for batch in batches:
        piece = batch.select(names)
        codes = piece.column("run").dictionary_encode()
        edges = np.flatnonzero(np.diff(codes.indices.to_numpy(), prepend=-1, append=-1)).tolist()
        for a, b in zip(edges, edges[1:]):
            runs.setdefault(codes.dictionary[codes.indices[a].as_py()].as_py(), []).append(piece.slice(a, b - a))
    out: list[tuple] = []
    for row in LoserTree([_cursor(pieces) for _, pieces in sorted(runs.items())]):
        out.append(row)
        if len(out) == 50_000:
            yield _batch(out, names)
            out = []
    if out:
        yield _batch(out, names)


def _cursor(pieces: list[pa.RecordBatch], rows: int = 1024) -> Iterator[tuple]:
    """The rows of a run, a few at a time."""
    for piece in pieces:
        for at in range(0, piece.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in piece.slice(at, rows).columns), strict=True)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema_of(CAPTURE), strict=True)], names)


def merge_index(captures: DataFrame, rows_per_partition: int = 500_000) -> DataFrame:
    """The capture history in global order: partition after partition, row after row."""
    runs = materialise(captures, "warc-runs")
    parts = max(1, -(-runs.count() // rows_per_partition))
    order = ["url_key", "captured_at", F.col("page_id").asc_nulls_first()]
    return runs.repartitionByRange(parts, *order).sortWithinPartitions("run", *order, "at").mapInArrow(_merge, CAPTURE)


def query(pages: DataFrame) -> DataFrame:
    """The contract's digest: writes archives, reads them back, merges the index."""
    folder = shared_dir(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder)
    merged = merge_index(read_archives(manifest, folder))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key")


ORACLE = """
with digests as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h,
  reverse(regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':.*', '')) as host, url from pages),
grouped as (select *, min(page_id) over (partition by h) as first_id,
  list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::int) as quads from digests)
select page_id, payload_bytes,
  list_reduce(list_transform(quads, lambda q: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q >> s) & 31)::int + 1, 1)), lambda x, y: x || y)), lambda x, y: x || y) as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to,
  array_to_string(list_reverse(string_split(reverse(host), '.')), ',') || ')' || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')
    || coalesce('?' || nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '') as url_key
from grouped"""
