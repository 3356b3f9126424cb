"""Operator 3: removal of repeated byte strings by a logarithmic family of sampled suffix arrays.

Sampling. Among the `GRAM`-byte strings of each `length`-byte string the one with the smallest hash (leftmost if tied) is
its anchor. Equal strings have the same anchor at the same offset, so it is enough to index the suffixes at anchors: about one in 70.
Consecutive strings with one anchor form a stretch; a stretch's content is all the bytes of its strings.

Index. A suffix array of a batch of documents is the list of its anchors, sorted by (hash of the leading gram, hash
of the stretch's content), cut into shards by ranges of the gram's hash; equal neighbours are equal suffixes, so that the
order serves matching as the lexical one does, and shards stay even whatever the text. Batches come one after another. A new batch's
array is merge-scanned against all levels: entries with equal gram and content are long matches, and both sides are reported. Then
the batch becomes a run of level 0, and equal-sized levels merge, so that n batches leave at most log2(n) + 1 runs.

Exactness. A stretch whose content occurs twice is repeated as a whole. Where stretches share a gram but not the
content (at the rims of repeated regions), the final scan of the levels asks one stretch of each content for the hashes of all its
strings; these are counted by ranges of hashes. Each chunk of documents then cuts its repeated bytes. Nothing depends on where
stretches begin or end, so long documents are cut into pieces without loss.

A gram or string that all documents share is one entry for each chunk and content, and strings are dealt by their own hash: hot groups
need no salt. Nothing is broadcast.

Defined cases. A null or empty text has no bytes. Ids may be null or repeated: rows are separate documents. Empty table: no rows. Other
columns are not read. Cuts may split a UTF-8 character; kept bytes are returned as binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import chunks as C
from framewright.llm.common import drop_path, shared_dir
from framewright.llm.substrings import REPLY, _rows

GRAM = 64
#: Bytes that are hashed together; longer texts go piece by piece.
PIECE = 1 << 20
#: Bytes of text for each shard of the index (grows as chunks.grown says).
SHARD_BYTES = 32 << 20
#: Odd base of the polynomial hashes (mod 2^64).
BASE = 0x9E3779B97F4A7C15
CONTENT_BITS = np.uint64((1 << 48) - 1)
ENTRY = "kind int, shard int, chunk long, keys binary, contents binary, many binary, refs binary, level int"
#: Kinds of rows: entries of a chunk, a run of a level, reported entries (whole stretch repeated; strings asked for), strings.
FRESH, RUN, WHOLE, ASKED, STRINGS = range(5)


class Tables:
    """Powers of the base and its inverse, and a random 64-bit number for each byte value."""

    def __init__(self, size: int):
        self.up, self.down = self.powers(BASE, size), self.powers(pow(BASE, -1, 1 << 64), size)
        self.bytes = C.scramble(np.arange(256, dtype=np.uint64), 5)

    @staticmethod
    def powers(base: int, size: int) -> np.ndarray:
        out = np.full(size + 1, base, np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.cumprod(out, dtype=np.uint64)


_tables: list[Tables] = []


def tables(size: int) -> Tables:
    if not _tables or len(_tables[0].up) <= size:
        _tables[:] = [Tables(max(size, 2 * PIECE))]
    return _tables[0]


class Buffer:
    """Pieces of documents in a row, with prefix sums for hashes of any substring."""

    def __init__(self, parts: list[tuple[int, int, bytes]]):
        self.docs = np.array([p[0] for p in parts], np.int64)
        self.bases = np.array([p[1] for p in parts], np.int64)
        sizes = np.array([len(p[2]) for p in parts], np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        raw = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        self.tables = tables(len(raw))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(self.tables.bytes[raw] * self.tables.up[: len(raw)], out=self.sums[1:])

    def hashes(self, at: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[ends] - self.sums[at]) * self.tables.down[at if isinstance(at, np.ndarray) else slice(at.start, at.stop)]


def buffers(texts: list[bytes], length: int) -> Iterator[Buffer]:
    held, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            part = text[at : at + PIECE + length - 1]
            if held and size + len(part) > PIECE:
                yield Buffer(held)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield Buffer(held)


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by minima from both ends of blocks of that size."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


class Stretches:
    """All stretches of a chunk: document, first and last start, and the sorted distinct (gram, content) entries."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.texts = length, texts
        found = [self._of(b) for b in buffers(texts, length)]
        self.doc, self.low, self.high, gram, content = (np.concatenate(x) if found else np.zeros(0, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 5, (np.int64, np.int64, np.int64, np.uint64, np.uint64), strict=True))
        order = np.lexsort((content, gram))
        g, c = gram[order], content[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        firsts = np.flatnonzero(new)
        self.grams, self.contents, self.first = g[firsts], c[firsts], order[firsts]
        self.many = np.diff(np.concatenate([firsts, [len(g)]])) > 1
        self.entry = np.zeros(len(g), np.int64)
        self.entry[order] = np.cumsum(new) - 1

    def _of(self, b: Buffer) -> tuple:
        length, n = self.length, len(b.sums) - 1
        grams = C.scramble(b.hashes(slice(0, n - GRAM + 1), slice(GRAM, n + 1)), 3)
        bits = np.uint64(int(n).bit_length())
        places = np.arange(len(grams), dtype=np.uint64)
        least = sliding_least((grams >> bits << bits) | places, length - GRAM + 1) & np.uint64((1 << int(bits)) - 1)
        valid = np.zeros(len(least), bool)
        for begin, end in zip(b.begins.tolist(), b.ends.tolist(), strict=True):
            valid[begin : end - length + 1] = True
        starts = np.flatnonzero(valid)
        anchors = least[starts].astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        low, high, anchor = starts[heads], starts[np.concatenate([heads[1:], [len(starts)]]) - 1], anchors[heads]
        part = np.searchsorted(b.ends, low, "right")
        shape = (high - low).astype(np.uint64) << np.uint64(32) | (anchor - low).astype(np.uint64)
        content = C.scramble(b.hashes(low, high + length) ^ C.scramble(shape, 9), 4) & CONTENT_BITS
        shift = b.bases[part] - b.begins[part]
        return b.docs[part], low + shift, high + shift, C.scramble(grams[anchor], 13), content  # minima lie low: mixed anew, they spread over all shards

    def strings(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, start, hash and 16 more bits of every string of the first stretch of each entry."""
        chosen = self.first[entries]
        chosen = chosen[np.lexsort((self.low[chosen], self.doc[chosen]))]
        docs, starts, hashes, more = [], [], [], []
        edges = np.searchsorted(self.doc[chosen], np.arange(len(self.texts) + 1))
        for b in buffers([t if edges[i + 1] > edges[i] else b"" for i, t in enumerate(self.texts)], self.length):
            for d, base, begin, end in zip(b.docs.tolist(), b.bases.tolist(), b.begins.tolist(), b.ends.tolist(), strict=True):
                own = chosen[edges[d] : edges[d + 1]]
                own = own[(self.low[own] >= base) & (self.high[own] + self.length <= base + end - begin)]
                if not len(own):
                    continue
                counts = self.high[own] - self.low[own] + 1
                at = np.repeat(self.low[own] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
                local = at - base + begin
                raw = b.hashes(local, local + self.length)
                docs.append(np.full(len(at), d))
                starts.append(at)
                hashes.append(C.scramble(raw, 21))
                more.append((self.grams[self.entry[np.repeat(own, counts)]] & np.uint64(0xFFFF)).astype(np.uint16))
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        return tuple(np.concatenate(x) for x in (docs, starts, hashes, more))


def by_range(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _entries(shards: int, length: int):
    """The entries of each chunk by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                s, out = Stretches(C.unpack_documents(blob.as_py())[2], length), []
                for shard, part in C.slices_by_shard(by_range(s.grams, shards), shards):
                    out.append((FRESH, shard, chunk, C.squeeze_sorted(s.grams[part]), C.squeeze(s.contents[part]), C.bits(s.many[part]), None, None))
                yield from _rows(out, ENTRY).to_batches()

    return run


def _merged(grams: np.ndarray, contents: np.ndarray) -> np.ndarray:
    """The order by (gram, content) of sorted runs put one after another.

    The stable sort takes the runs as they are and only merges them; entries that share a gram are then put in the order of their contents.
    """
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    tied = np.zeros(len(g), bool)
    tied[1:] = g[1:] == g[:-1]
    tied[:-1] |= tied[1:]
    shared = order[tied]
    order[tied] = shared[np.lexsort((contents[shared], grams[shared]))]
    return order


class Run:
    """A sorted array of entries: gram, content, whether seen more than once, and one place (chunk, index in its shard's list)."""

    def __init__(self, grams, contents, many, chunks, indexes):
        self.columns = (grams, contents, many, chunks, indexes)
        self.grams, self.contents, self.many, self.chunks, self.indexes = self.columns

    @staticmethod
    def of_chunks(table: pa.Table) -> list[Run]:
        """The sorted entries of each chunk of a batch."""
        runs = []
        for chunk, keys, contents, many in zip(*(table.column(c) for c in ("chunk", "keys", "contents", "many"))):
            grams = C.unsqueeze_sorted(keys.as_py())
            runs.append(Run(grams, C.unsqueeze(contents.as_py(), np.uint64), C.unbits(many.as_py(), len(grams)), np.full(len(grams), chunk.as_py(), np.int64), np.arange(len(grams))))
        return runs or [Run.empty()]

    @staticmethod
    def empty() -> Run:
        return Run(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))

    @staticmethod
    def unpack(row: dict) -> Run:
        grams = C.unsqueeze_sorted(row["keys"])
        refs = row["refs"]
        cut = int.from_bytes(refs[:8], "little")
        return Run(grams, C.unsqueeze(row["contents"], np.uint64), C.unbits(row["many"], len(grams)), C.unsqueeze(refs[8 : 8 + cut], np.uint64).view(np.int64), C.unsqueeze(refs[8 + cut :], np.uint64).view(np.int64))

    def pack(self, shard: int, level: int) -> tuple:
        chunks = C.squeeze(self.chunks.view(np.uint64))
        return RUN, shard, None, C.squeeze_sorted(self.grams), C.squeeze(self.contents), C.bits(self.many), len(chunks).to_bytes(8, "little") + chunks + C.squeeze(self.indexes.view(np.uint64)), level

    @staticmethod
    def merge(runs: list[Run]) -> tuple[Run, list[tuple[np.ndarray, np.ndarray]]]:
        """Merge of sorted runs, one entry for each (gram, content), and the places of entries newly seen to repeat."""
        grams, contents, many, chunks, indexes = (np.concatenate(x) for x in zip(*(r.columns for r in runs), strict=True))
        order = _merged(grams, contents)
        g, c = grams[order], contents[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        firsts, group = np.flatnonzero(new), np.cumsum(new) - 1
        sizes = np.diff(np.concatenate([firsts, [len(g)]]))
        repeats = sizes > 1
        news = order[repeats[group] & ~many[order]]
        seen = np.logical_or.reduceat(many[order], firsts) if len(firsts) else np.zeros(0, bool)
        first = order[firsts]
        return Run(grams[first], contents[first], seen | repeats, chunks[first], indexes[first]), [(chunks[news], indexes[news])]


def _reports(kind: int, shard: int, chunks: np.ndarray, indexes: np.ndarray) -> list[tuple]:
    """Rows that tell each chunk which entries of its list for the shard are reported."""
    order = np.lexsort((indexes, chunks))
    chunks, indexes = chunks[order], indexes[order]
    edges = np.flatnonzero(np.diff(chunks, prepend=-1, append=-1)) if len(chunks) else np.zeros(0, np.int64)
    return [(kind, shard, int(chunks[a]), C.squeeze_sorted(np.unique(indexes[a:b]).astype(np.uint64)), None, None, None, None) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _add_batch(merge_below: int):
    """Merge-scans a batch against all levels of a shard; merges it with the levels below `merge_below`."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        kinds = np.array(table.column("kind").to_pylist())
        batch, found = Run.merge(Run.of_chunks(table.filter(pa.array(kinds == FRESH))))
        levels = {row["level"]: Run.unpack(row) for row in table.filter(pa.array(kinds == RUN)).to_pylist()}
        for level in levels.values():  # the scan of two sorted arrays: equal entries on both sides are matches
            found += Run.merge([batch, level])[1]
            known = _member(batch, level)
            batch = Run(batch.grams, batch.contents, batch.many | known, batch.chunks, batch.indexes)
        joined = [batch, *(r for n, r in sorted(levels.items()) if n < merge_below)]
        out = [(Run.merge(joined)[0] if len(joined) > 1 else batch).pack(shard, merge_below)]
        out += _reports(WHOLE, shard, *(np.concatenate(x) for x in zip(*found, strict=True)))
        return _rows(out, ENTRY)

    return run


def _member(a: Run, b: Run) -> np.ndarray:
    """Which entries of `a` are in `b`."""
    if not len(b.grams):
        return np.zeros(len(a.grams), bool)
    both = np.concatenate([a.grams, b.grams]), np.concatenate([a.contents, b.contents])
    order = _merged(*both)
    same = (both[0][order][1:] == both[0][order][:-1]) & (both[1][order][1:] == both[1][order][:-1])
    hit = np.zeros(len(order), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return hit[: len(a.grams)]


def _ask(table: pa.Table) -> pa.Table:
    """The last scan of a shard's levels: grams with several contents, one of them seen once."""
    shard = table.column("shard")[0].as_py()
    run, _ = Run.merge([Run.unpack(row) for row in table.to_pylist()])
    starts = np.flatnonzero(np.diff(run.grams, prepend=run.grams[:1] + np.uint64(1))) if len(run.grams) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(run.grams)]]))
    once = np.add.reduceat(~run.many, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    wanted = np.repeat((sizes > 1) & (once > 0), sizes)
    return _rows(_reports(ASKED, shard, run.chunks[wanted], run.indexes[wanted]), ENTRY)


def _marked(s: Stretches, shards: int, table: pa.Table, kind: int) -> np.ndarray:
    """Entries of the chunk that the rows of a kind report."""
    edges = np.searchsorted(by_range(s.grams, shards), np.arange(shards))
    parts = [edges[shard] + C.unsqueeze_sorted(keys).astype(np.int64) for k, shard, keys in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "keys")), strict=True) if k == kind]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def _strings(shards: int, length: int):
    """Hashes of all strings of the stretches that were asked for, each once, with a mark on those met twice."""

    def run(key: tuple, chunk: pa.Table, reports: pa.Table) -> pa.Table:
        if not reports.num_rows:
            return _rows([], ENTRY)
        s = Stretches(C.unpack_documents(chunk.column("blob")[0].as_py())[2], length)
        hashes, more, twice, _ = _distinct(*s.strings(_marked(s, shards, reports, ASKED))[2:])
        return _rows([(STRINGS, shard, key[0].as_py(), C.squeeze_sorted(hashes[p]), C.squeeze(more[p]), C.bits(twice[p]), None, None) for shard, p in C.slices_by_shard(by_range(hashes, shards), shards)], ENTRY)

    return run


def _distinct(hashes: np.ndarray, more: np.ndarray) -> tuple:
    """Distinct strings in order, those met twice, and the place of each input among them."""
    order = np.lexsort((more, hashes))
    h, m = hashes[order], more[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (m[1:] != m[:-1])
    firsts = np.flatnonzero(new)
    place = np.zeros(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return h[firsts], m[firsts], np.diff(np.concatenate([firsts, [len(h)]])) > 1, place


def _count_strings(table: pa.Table) -> pa.Table:
    """Which strings of a range of hashes occur twice."""
    keys = [C.unsqueeze_sorted(k.as_py()) for k in table.column("keys")]
    hashes, more = np.concatenate(keys), np.concatenate([C.unsqueeze(x.as_py(), np.uint16) for x in table.column("contents")])
    many = np.concatenate([C.unbits(x.as_py(), len(k)) for x, k in zip(table.column("many"), keys, strict=True)])
    _, _, twice, place = _distinct(hashes, more)
    twice = twice.copy()
    twice[place[many]] = True
    flags, edges = twice[place], np.cumsum([0] + [len(k) for k in keys])
    return _rows([(STRINGS, s, c, C.bits(flags[edges[i] : edges[i + 1]])) for i, (s, c) in enumerate(zip(table.column("shard").to_pylist(), table.column("chunk").to_pylist(), strict=True))], REPLY)


def _cut(shards: int, length: int, bytes_too: bool):
    """What is left of each document."""

    def run(key: tuple, chunk: pa.Table, reports: pa.Table) -> pa.Table:
        _, ids, texts = C.unpack_documents(chunk.column("blob")[0].as_py())
        s, out = Stretches(texts, length), []
        whole = s.many.copy()
        whole[_marked(s, shards, reports, WHOLE)] = True
        chosen = np.flatnonzero(whole[s.entry])
        doc, low, high = s.doc[chosen], s.low[chosen], s.high[chosen] + length
        asked = _marked(s, shards, reports, ASKED)
        if len(asked):
            docs, starts, hashes, more = s.strings(asked)
            hashes, _, _, place = _distinct(hashes, more)
            flags = np.zeros(len(hashes), bool)
            answers = {sh: f for k, sh, f in zip(*(reports.column(c).to_pylist() for c in ("kind", "shard", "flags")), strict=True) if k == STRINGS}
            for shard, p in C.slices_by_shard(by_range(hashes, shards), shards):
                flags[p] = C.unbits(answers[shard], p.stop - p.start)
            hit = flags[place]
            doc, low, high = np.concatenate([doc, docs[hit]]), np.concatenate([low, starts[hit]]), np.concatenate([high, starts[hit] + length])
        order = np.argsort(doc, kind="stable")
        doc, low, high = doc[order], low[order], high[order]
        edges = np.searchsorted(doc, np.arange(len(texts) + 1))
        for i, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
            kept, removed, spans = text, 0, 0
            if edges[i + 1] > edges[i]:
                change = np.zeros(len(text) + 1, np.int64)
                np.add.at(change, low[edges[i] : edges[i + 1]], 1)
                np.add.at(change, high[edges[i] : edges[i + 1]], -1)
                gone = np.cumsum(change[:-1]) > 0
                removed, spans = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=np.int8(0)) > 0).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((doc_id, len(text), removed, spans, kept if bytes_too else hashlib.sha256(kept).hexdigest()))
        return _rows(out, _out_schema(bytes_too))

    return run


def _out_schema(bytes_too: bool) -> str:
    return "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept binary" if bytes_too else "kept_sha256 string")


def dedup(docs: DataFrame, length: int = 200, batches: int = 4, id_col: str = "doc_id", text_col: str = "text", bytes_too: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (or, without `bytes_too`, only its SHA-256 kept_sha256) of every document."""
    spark = docs.sparkSession
    chunks, total = C.stage(docs, id_col, text_col)
    shards = max(1, -(-total // C.grown(SHARD_BYTES, total)))
    levels: dict[int, str] = {}
    reports: list[DataFrame] = []
    for n in range(batches):
        rows = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(batches)) == n).mapInArrow(_entries(shards, length), ENTRY)
        for path in levels.values():
            rows = rows.unionByName(spark.read.schema(ENTRY).parquet(path).where(F.col("kind") == RUN))
        below = 0
        while below in levels:
            below += 1
        path = shared_dir(spark, f"suffixes-{n}")
        rows.groupBy("shard").applyInArrow(_add_batch(below), ENTRY).write.partitionBy("kind").parquet(path)
        for merged in range(below):
            drop_path(spark, f"{levels.pop(merged)}/kind={RUN}")
        levels[below] = path
        reports.append(spark.read.schema(ENTRY).parquet(path).where(F.col("kind") == WHOLE))
    runs = [spark.read.schema(ENTRY).parquet(path).where(F.col("kind") == RUN) for path in levels.values()]
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    path = shared_dir(spark, "asked")
    every.groupBy("shard").applyInArrow(_ask, ENTRY).write.parquet(path)
    asked = spark.read.schema(ENTRY).parquet(path)
    strings = chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(_strings(shards, length), ENTRY)
    counted = strings.groupBy("shard").applyInArrow(_count_strings, REPLY)
    known = asked
    for report in reports:
        known = known.unionByName(report)
    answers = known.select("kind", "shard", "chunk", "keys").unionByName(counted, allowMissingColumns=True)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_cut(shards, length, bytes_too), _out_schema(bytes_too))


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    return dedup(docs, bytes_too=False)


ORACLE = """
with hexed as (select doc_id, encode(coalesce(text, '')) as b, hex(encode(coalesce(text, ''))) as h from documents),
strings as (select doc_id, i, md5(b[i + 1:i + 200]) as k from hexed, unnest(range(octet_length(b) - 199)) t(i)),
repeated as (select doc_id, i from strings qualify count(*) over (partition by k) > 1),
starts as (select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -1000) > 200 as fresh from repeated),
runs as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as r from starts),
spans as (select doc_id, r, min(i) as a, max(i) + 200 as z from runs group by doc_id, r),
gaps as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as p from spans),
heads as (select doc_id, count(*) as n_spans, sum(z - a) as n_removed, max(z) as last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) as t from gaps join hexed using (doc_id) group by doc_id)
select doc_id, octet_length(b) as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when n_spans is null then h else t || substr(h, 2 * last + 1) end)) as kept_sha256
from hexed left join heads using (doc_id)"""
