"""Operator 4: benchmark decontamination by suffix arrays of the training text.

Every task builds word-level suffix arrays over shards of its documents (texts of one Arrow batch, at most `SHARD_WORDS` words unless a
single document is longer) and binary-searches every suffix of every benchmark item in each shard. A search gives the longest match of the suffix up to a window
and, where a whole window matches, the range of the array that holds all its locations. A verbatim match longer than a window is
a run of windows, joined again for the whole length. Locations mark document words as hit; documents with enough hit words are
contaminated. Nothing is shuffled.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. Words are compared by their
number in the benchmark's vocabulary, so equality is exact; words that the benchmark lacks match nothing.

The benchmark is written to the shared folder in blocks of about `BLOCK_BYTES` bytes, one row each, made by tasks. The rows are read in one
pass whatever the number of blocks: a shard meets block after block, and a worker holds one of them at a time (a single block is kept for the next
shard). Nothing is broadcast, and the benchmark does not pass the driver.

`longest` is the longest verbatim match of a document with any item, in words, window or not: each suffix of a shard is compared with its two
neighbours among the benchmark's sorted suffixes; matches beyond a window have the length of their run.

Defined cases. Null or empty texts have no words and are not contaminated. Item ids may repeat (each id is listed once); items with a null
id count for hits but are not listed. Repeated or null document ids: rows are judged one by one. Empty tables
give empty results or no hits. Other columns of any name stay; only those called as the new ones are (`names`) give way to them.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import private, shared_dir, without

#: Fixed value: the words of the contract, after lower-casing A-Z.
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
TO_LOWER = {c: c + 32 for c in range(65, 91)}
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 1 << 19
NAMES = ("n_words", "n_hit", "hit_spans", "items", "longest")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(TO_LOWER)) if text else []


class Block:
    """The items of a benchmark block: vocabulary, words in a row, and all suffixes, cut after a window, in order."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.names: list[int | None] = []
        words, starts, lengths, owners = [], [], [], []
        for item_id, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if own:
                size = min(window, len(own))
                for i in range(len(own)):
                    starts.append(len(words) + i)
                    lengths.append(size if i + size <= len(own) else 0)  # 0: a suffix shorter than a window
                    owners.append(len(self.names))
                words += own + [0] * window
                self.names.append(item_id)
        self.words = np.array(words + [0] * window, np.int32)
        starts, lengths, owners = (np.array(x, np.int64) for x in (starts, lengths, owners))
        order = np.lexsort(self._suffixes(starts).T[::-1]) if len(starts) else starts
        self.starts, self.lengths, self.owners = starts[order], lengths[order], owners[order]
        self.suffixes = self._suffixes(self.starts)

    def _suffixes(self, starts: np.ndarray) -> np.ndarray:
        return self.words[starts[:, None] + np.arange(self.window)].astype(np.int64)

    def pack(self) -> bytes:
        fields = self.window, list(self.vocabulary), self.names, self.words, self.starts, self.lengths, self.owners
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(fields))

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        """A block written by `pack`: the tasks of this very job have written it."""
        block = cls.__new__(cls)
        block.window, vocabulary, block.names, block.words, block.starts, block.lengths, block.owners = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        block.vocabulary = {w: i + 1 for i, w in enumerate(vocabulary)}
        block.suffixes = block._suffixes(block.starts)
        return block


class SuffixArray:
    """Sorted suffixes, cut after `depth` words, of a row of words in which 0 stands for words that match nothing."""

    def __init__(self, words: np.ndarray, depth: int):
        self.depth = depth
        self.words = np.concatenate([words, np.zeros(depth, np.int64)])
        starts, rank, reach = np.flatnonzero(words), self.words.copy(), 1
        while reach < depth and len(starts):  # prefix doubling: rank by 1, 2, 4, ... words; what matches nothing keeps rank 0
            ahead = rank[np.minimum(starts + reach, len(rank) - 1)]
            rank[starts] = np.unique((rank[starts] << 32) | ahead, return_inverse=True)[1] + 1
            reach *= 2
        self.order = starts[np.argsort(rank[starts], kind="stable")]

    def compare(self, places: np.ndarray, wanted: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """-1, 0 or 1 for the suffixes at `places` of the array against the wanted words, and the words in common."""
        own = self.words[self.order[places][:, None] + np.arange(self.depth)]
        within = np.arange(self.depth) < lengths[:, None]
        differs = (own != wanted) & within
        common = np.where(differs.any(axis=1), differs.argmax(axis=1), lengths)
        at = np.minimum(common, self.depth - 1)
        rows = np.arange(len(own))
        sign = np.sign(own[rows, at] - wanted[rows, at])
        return np.where(common >= lengths, 0, sign), common

    def bound(self, wanted: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
        """First place whose suffix is not below (upper: above) the wanted words, by binary search."""
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.order), np.int64)
        while (active := np.flatnonzero(low < high)).size:
            middle = (low[active] + high[active]) // 2
            sign, _ = self.compare(middle, wanted[active], lengths[active])
            right = (sign < 0) | ((sign == 0) & upper)
            low[active] = np.where(right, middle + 1, low[active])
            high[active] = np.where(right, high[active], middle)
        return low

    def longest(self, wanted: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the wanted suffixes (in order, 0 past their end) and of those of the array: the words of the longest match, a window at most.

        In the merged order of both a suffix shares most with a neighbour. `places` are those of the wanted ones in the array.
        """
        before = np.searchsorted(places, np.arange(len(self.order)), "right")  # wanted suffixes up to each of the array

        def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Words in common of each two suffixes; 0 where a place is beyond the ends. Few pairs are looked at beyond their first words."""
            out, alive = np.zeros(len(a), np.int64), np.flatnonzero((a >= 0) & (a < len(self.order)) & (b >= 0) & (b < len(wanted)))
            for k in range(self.depth):
                word = wanted[b[alive], k]
                alive = alive[(self.words[self.order[a[alive]] + k] == word) & (word > 0)]
                if not alive.size:
                    break
                out[alive] = k + 1
            return out

        own, asked = np.arange(len(self.order)), np.arange(len(wanted))
        return np.maximum(common(own, before - 1), common(own, before)), np.maximum(common(places - 1, asked), common(places, asked))


def match_shard(texts: list[list[str]], block: Block) -> list[tuple[np.ndarray, set[int], int]]:
    """For each document of a shard: hit words, the items whose windows occur, and the longest verbatim match in words.

    A match longer than a window is a run of windows: the same shift between the benchmark's words and the shard's, one word on each time.
    """
    window, lookup = block.window, block.vocabulary.get
    ends = np.cumsum([0] + [len(t) + 1 for t in texts])
    row = np.zeros(int(ends[-1]), np.int64)
    for i, t in enumerate(texts):
        row[ends[i] : ends[i + 1] - 1] = [lookup(w, 0) for w in t]
    out = [(np.zeros(len(t), bool), set(), 0) for t in texts]
    array = SuffixArray(row, window)
    if not len(array.order) or not len(block.suffixes):
        return out
    whole = np.full(len(block.suffixes), window, np.int64)
    places = array.bound(block.suffixes, whole, False)
    short, longest = array.longest(block.suffixes, places)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, np.searchsorted(ends, array.order, "right") - 1, short)
    marks = np.zeros(len(row) + 1, np.int64)
    found = np.flatnonzero((block.lengths > 0) & (longest >= block.lengths))
    if found.size:
        first = array.bound(block.suffixes[found], block.lengths[found], False)
        counts = array.bound(block.suffixes[found], block.lengths[found], True) - first
        suffix = np.repeat(found, counts)
        at = array.order[np.arange(int(counts.sum())) + np.repeat(first - (np.cumsum(counts) - counts), counts)]
        size, origin, document = block.lengths[suffix], block.starts[suffix], np.searchsorted(ends, at, "right") - 1
        np.add.at(marks, at, 1)
        np.add.at(marks, at + size, -1)
        order = np.lexsort((at, at - origin))
        begins = np.ones(len(order), bool)
        begins[1:] = (np.diff(at[order]) != 1) | (np.diff((at - origin)[order]) != 0)
        runs = np.cumsum(begins) - 1
        np.maximum.at(most, document[order], (size[order] + np.arange(len(order)) - np.flatnonzero(begins)[runs]))
        covered = np.cumsum(marks[:-1]) > 0
        for pair in np.unique(document * len(block.names) + block.owners[suffix]).tolist():
            out[pair // len(block.names)][1].add(pair % len(block.names))
    else:
        covered = np.zeros(len(row), bool)
    return [(covered[ends[i] : ends[i + 1] - 1], out[i][1], int(most[i])) for i in range(len(texts))]


def _spans(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of hits, in turn."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()


_kept: dict[str, Block] = {}  # a worker's, if its benchmark is a single block


def _packer(window: int, block_bytes: int):
    """The items of a task as blocks of at most `block_bytes` bytes (a longer item alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([Block(held, window).pack()], pa.binary())], ["block"])

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bytes_ = len((text or "").encode())
                if held and size + bytes_ > block_bytes:
                    yield block()
                    held, size = [], 0
                held.append((item, text))
                size += bytes_
        if held:
            yield block()

    return run


def _blocks(folder: str) -> Iterator[Block]:
    """The blocks of the folder, one at a time."""
    if folder in _kept:
        yield _kept[folder]
        return
    _kept.clear()
    files, root = pyarrow.fs.FileSystem.from_uri(folder)
    paths = sorted(f.path for f in files.get_file_info(pyarrow.fs.FileSelector(root)) if f.path.endswith(".parquet"))
    seen = 0
    for path in paths:
        with files.open_input_file(path) as stream:
            for batch in pyarrow.parquet.ParquetFile(stream).iter_batches(batch_size=1, columns=["block"]):
                seen += 1
                block = Block.unpack(batch.column(0)[0].as_py())
                yield block
    if seen == 1:
        _kept[folder] = block


def _matcher(folder: str, text_at: int, added: list[str]):
    """Adds the hits of all blocks as the columns `added`: words, spans, items and longest match."""

    def judge(shard: list[list[str]]) -> list[tuple]:
        found = [([], [], 0) for _ in shard]
        for block in _blocks(folder):
            for i, (hit, own, most) in enumerate(match_shard(shard, block)):
                spans, items, longest = found[i]
                named = {n for j in own if (n := block.names[j]) is not None}
                found[i] = _union(spans, _spans(hit)), sorted({*items, *named}), max(longest, most)
        return [(len(words), *rest) for words, rest in zip(shard, found, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            found, shard, held = [], [], 0
            for i in range(batch.num_rows):
                shard.append(words_of(column[i].as_py()))
                held += len(shard[-1])
                if held >= SHARD_WORDS or i == batch.num_rows - 1:
                    found += judge(shard)
                    shard, held = [], 0
            counts, spans, ids, most = zip(*found, strict=True) if found else ((), (), (), ())
            numbers = pa.list_(pa.int64())
            new = [pa.array(counts, pa.int64()), pa.array(spans, numbers), pa.array(ids, numbers), pa.array(most, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    return run


def _union(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of spans."""
    out: list[int] = []
    for start, end in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, names: tuple[str, ...] = NAMES) -> DataFrame:
    """All columns and those called `names`: number of words, of hit words, spans (starts and ends of the runs of hit words, in turn),
    ids of the items, and the words of the longest verbatim match."""
    spark, kept = docs.sparkSession, without(docs, names)
    numbers, added = T.ArrayType(T.LongType()), private("n_words", "spans", "items", "longest")
    kinds = (T.LongType(), numbers, numbers, T.LongType())
    schema = T.StructType([*kept.schema, *(T.StructField(name, kind) for name, kind in zip(added, kinds, strict=True))])
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_dir(spark, "benchmark")
    dealt = items.coalesce(1) if total <= block_bytes else items.repartition(-(-total // block_bytes))
    dealt.mapInArrow(_packer(window, block_bytes), "block binary").write.parquet(folder)
    out = kept.mapInArrow(_matcher(folder, kept.columns.index(text_col), added), schema)
    n_words, spans, items, longest = (F.col(name) for name in added)
    hits = F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1), F.lit(0).cast("long"), lambda n, i: n + F.when(i % 2 == 1, F.get(spans, i)).otherwise(-F.get(spans, i)))
    n_hit = F.when(F.size(spans) > 0, hits).otherwise(0).cast("long")
    return out.select(*[out[c] for c in kept.columns], *(c.alias(n) for c, n in zip((n_words, n_hit, spans, items, longest), names, strict=True)))


def contaminated(parts: int = 20, n_words: str = "n_words", n_hit: str = "n_hit"):
    """The contract's rule: some hit, and hits are at least a `parts`th of the words."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * parts >= F.col(n_words))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 13, parts: int = 20) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    names = private(*NAMES)
    return find(docs, benchmark, window, names=tuple(names)).where(~contaminated(parts, names[0], names[1])).drop(*names)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest."""
    found = find(docs.select("doc_id", "text"), benchmark)
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of the digest."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with items as (select item_id, {words} as w from benchmark),
windows as (select distinct item_id, least(13, len(w)) as size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as k from items, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) where len(w) > 0),
sizes as (select distinct size from windows),
doc_words as (select doc_id, {words} as w from {docs}),
found as (select doc_id, i, s.size, array_to_string(w[i:i + s.size - 1], ' ') as k from doc_words, sizes s, unnest(range(1, len(w) - s.size + 2)) t(i)),
hits as (select f.doc_id, f.i, f.size, x.item_id from found f join windows x on f.size = x.size and f.k = x.k),
hit_words as (select doc_id, count(distinct i + j) as n_hit from hits, unnest(range(size)) t(j) group by doc_id),
listed as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from hits group by doc_id),
judged as (select d.doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(l.n_items, 0) as n_items, coalesce(l.names, '') as names
  from doc_words d left join hit_words h on d.doc_id = h.doc_id left join listed l on d.doc_id = l.doc_id)
select doc_id, n_words, n_hit, n_items, sha256(names) as items_sha256, n_hit > 0 and 20 * n_hit >= n_words as contaminated from judged"""
