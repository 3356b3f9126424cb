"""Operator 9: removal of repeated word windows with a count-min prefilter.

A window is `window` consecutive words of one document; a window whose words also start earlier (smaller id, or the same document and an
earlier start) is repeated, and every word that a repeated window covers goes.

First pass: each chunk of documents makes its count-min sketch of all its window hashes, as the sorted list of its non-zero cells with
a mark on those counted more than once. The sketches are merged by ranges of cells; a merged count is never below the
number of times that any of its windows occurs. Each chunk gets back a bit for each of its cells: counted at least
twice over all documents. Second pass: only windows estimated repeated (all their cells are counted twice) are grouped exactly,
by 96 bits of hash: a chunk sends each distinct window once, with its first place; the group's first
place in order keeps its words. As no repeated window has a cell counted once, none is lost.

The cells follow the number of windows, in ranges of fixed size: nothing is broadcast and no task holds more than a chunk, a range of
cells or a range of hashes. A window that all documents share is one entry for each chunk, so hot windows need no salt.

Defined cases. A null or empty text has no words. A null id comes after all others. Rows with equal ids are separate
documents in an order that is arbitrary but the same throughout. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import chunks as C
from framewright.llm.common import materialise

#: Cells of a range of the sketch (these sizes grow as chunks.grown says); rows of the sketch (cells that a window has).
CELLS = 1 << 22
DEPTH = 2
#: Sketch cells in each row for each byte of text: about four for each window.
CELLS_PER_BYTE = 0.6
#: Bytes of text for each range of hashes in the exact pass.
HASH_SHARD_BYTES = 24 << 20
KEEP_WORDS = 300_000
EXCHANGE = "kind int, shard int, chunk long, keys binary, extra binary, places binary"
REPLY = "kind int, shard int, chunk long, flags binary"


class WordHashes(dict):
    """Hashes of words, kept for the next time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEEP_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_memo = WordHashes()  # a worker's, for all its chunks


def _left(words: list[bytes], gone: np.ndarray) -> list[bytes]:
    """The words that stay, run by run."""
    edges, out = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(1), append=np.int8(1))).tolist(), []
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out += words[a:b]
    return out


class Windows:
    """The window hashes of a chunk: `hashes` of the valid windows and their `starts` in the row of all words."""

    def __init__(self, texts: list[bytes], window: int, memo: WordHashes):
        counts, parts = [], []
        for text in texts:
            words = text.split()
            counts.append(len(words))
            parts.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
        self.window = window
        self.ends = np.cumsum(counts)
        self.words = words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        usable = np.maximum(0, np.array(counts, np.int64) - window + 1)
        begins = self.ends - counts
        self.starts = np.repeat(begins - np.concatenate([[0], np.cumsum(usable)[:-1]]), usable) + np.arange(int(usable.sum())) if len(counts) else np.zeros(0, np.int64)
        self.owner_row = np.repeat(np.arange(len(counts)), usable)
        self.hashes = self._roll(words, window)[self.starts] if len(self.starts) else np.zeros(0, np.uint64)

    @staticmethod
    def _roll(words: np.ndarray, window: int) -> np.ndarray:
        """Hash of `window` words from every place: halves of doubling size put together."""
        out, size, level, reach = None, 0, words, 1
        with np.errstate(over="ignore"):
            while True:
                if window & reach:
                    if out is None:
                        out, size = level, reach
                    else:
                        out, size = _join(level[: len(out) - reach] if len(out) > reach else level[:0], out[reach:], reach), size + reach
                reach *= 2
                if reach > window:
                    return out
                level = _join(level[: -(reach // 2)], level[reach // 2 :], reach)


def _join(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    n = min(len(left), len(right))
    return C.scramble(left[:n] * np.uint64(0x2545F4914F6CDD1D) + right[:n], size)


class Sizes:
    """Numbers of shards, from the bytes of all texts."""

    def __init__(self, total: int):
        self.range = C.grown(CELLS, total)
        self.cells = max(1, -(-int(total * CELLS_PER_BYTE) // self.range))
        self.hashes = max(1, -(-total // C.grown(HASH_SHARD_BYTES, total, 2)))

    def cell_keys(self, hashes: np.ndarray, row: int) -> np.ndarray:
        """Cell of each hash in a row of the sketch: shard in the high bits, cell of the shard in the low ones."""
        mixed = C.scramble(hashes, row + 1)
        return (mixed >> np.uint64(32)) % np.uint64(self.cells) * np.uint64(self.range) + (mixed & np.uint64(0xFFFFFFFF)) % np.uint64(self.range)

    def hash_shard(self, hashes: np.ndarray) -> np.ndarray:
        """Shards are ranges of hashes, so that sorted hashes lie shard by shard."""
        return ((hashes >> np.uint64(32)) * np.uint64(self.hashes) >> np.uint64(32)).astype(np.int64)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


def _sketches(sizes: Sizes, window: int):
    """The chunk's sketch: for each range of cells the cells in use, and a mark on those used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                windows, out = Windows(C.unpack_documents(blob.as_py())[2], window, _memo), []
                for row in range(DEPTH):
                    cells, counts = np.unique(sizes.cell_keys(windows.hashes, row), return_counts=True)
                    for shard, part in C.slices_by_shard((cells // np.uint64(sizes.range)).astype(np.int64), sizes.cells):
                        out.append((row, row * sizes.cells + shard, chunk, C.squeeze_sorted(cells[part] % np.uint64(sizes.range)), C.bits(counts[part] > 1), None))
                yield from _rows(out, EXCHANGE).to_batches()

    return run


def _merge_cells(size: int):
    """Sums the sketches of a range of cells (up to 2) and says which cells are counted twice."""

    def run(table: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.uint8)
        for keys, extra in zip(table.column("keys"), table.column("extra")):
            cells = C.unsqueeze_sorted(keys.as_py())
            counts[cells] = np.minimum(counts[cells] + 1 + C.unbits(extra.as_py(), len(cells)), 2)
        out = [(kind.as_py(), shard.as_py(), chunk.as_py(), C.bits(counts[C.unsqueeze_sorted(keys.as_py())] > 1)) for kind, shard, chunk, keys in zip(*(table.column(c) for c in ("kind", "shard", "chunk", "keys")))]
        return _rows(out, REPLY)

    return run


def _estimated(windows: Windows, sizes: Sizes, replies: dict[tuple[int, int], bytes]) -> np.ndarray:
    """Places, among the chunk's windows, of those that all rows of the sketch count twice."""
    repeated = np.ones(len(windows.hashes), bool)
    for row in range(DEPTH):
        keys = sizes.cell_keys(windows.hashes, row)
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        cells = ordered[new]
        twice = np.zeros(len(cells), bool)
        for shard, part in C.slices_by_shard((cells // np.uint64(sizes.range)).astype(np.int64), sizes.cells):
            twice[part] = C.unbits(replies[row, row * sizes.cells + shard], part.stop - part.start)
        repeated[order] &= twice[np.cumsum(new) - 1]
    return np.flatnonzero(repeated)


def _replies(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(k, s): f for k, s, f in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "flags")), strict=True)}


def _candidates(sizes: Sizes, window: int):
    """Distinct windows estimated repeated: hash, 32 more bits, and the id of the first place in the chunk."""

    def run(key: tuple, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        owners, _, texts = C.unpack_documents(chunk.column("blob")[0].as_py())
        windows = Windows(texts, window, _memo)
        places = _estimated(windows, sizes, _replies(replies))
        hashes, first = np.unique(windows.hashes[places], return_index=True)
        more = _more_bits(windows, places[first])
        owner = owners[windows.owner_row[places[first]]].astype(np.uint64)
        out = [(DEPTH, shard, key[0].as_py(), C.squeeze_sorted(hashes[part]), C.squeeze(more[part]), C.squeeze(owner[part])) for shard, part in C.slices_by_shard(sizes.hash_shard(hashes), sizes.hashes)]
        return _rows(out, EXCHANGE)

    return run


def _more_bits(windows: Windows, places: np.ndarray) -> np.ndarray:
    """32 bits of another hash of the windows at `places`: their word hashes in a polynomial with another base."""
    out = np.zeros(len(places), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(windows.window):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x5851F42D4C957F2D) + windows.words[windows.starts[places] + j]
    return (C.scramble(out, 77) >> np.uint64(32)).astype(np.uint32)


def _group_exactly(table: pa.Table) -> pa.Table:
    """Which entries of a range of hashes are not the first place of their window."""
    chunk = np.array(table.column("chunk").to_pylist(), np.int64)
    keys = [C.unsqueeze_sorted(k.as_py()) for k in table.column("keys")]
    sizes = np.array([len(k) for k in keys])
    hashes = np.concatenate(keys)
    more = np.concatenate([C.unsqueeze(x.as_py(), np.uint32) for x in table.column("extra")])
    owner = np.concatenate([C.unsqueeze(x.as_py(), np.uint64) for x in table.column("places")]).view(np.int64)
    order = np.lexsort((np.repeat(chunk, sizes), owner, more, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (more[order][1:] == more[order][:-1])
    later = np.zeros(len(order), bool)
    later[order[1:]] = same
    edges = np.cumsum(np.concatenate([[0], sizes]))
    return _rows([(DEPTH, s, c, C.bits(later[edges[i] : edges[i + 1]])) for i, (s, c) in enumerate(zip(table.column("shard").to_pylist(), chunk.tolist(), strict=True))], REPLY)


def _outcome(sizes: Sizes, window: int, texts_too: bool):
    """Word counts and what is left of each document."""

    def run(key: tuple, chunk: pa.Table, replies: pa.Table) -> pa.Table:
        _, ids, texts = C.unpack_documents(chunk.column("blob")[0].as_py())
        windows, answers = Windows(texts, window, _memo), _replies(replies)
        places = _estimated(windows, sizes, answers)
        hashes, first, inverse = np.unique(windows.hashes[places], return_index=True, return_inverse=True)
        elsewhere = np.zeros(len(hashes), bool)
        for shard, part in C.slices_by_shard(sizes.hash_shard(hashes), sizes.hashes):
            elsewhere[part] = C.unbits(answers[DEPTH, shard], part.stop - part.start)
        repeated = elsewhere[inverse]
        repeated |= first[inverse] != np.arange(len(places))
        change = np.zeros(int(windows.ends[-1]) + 1 if len(windows.ends) else 1, np.int64)
        at = windows.starts[places[repeated]]
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
        gone, out, begin = np.cumsum(change[:-1]) > 0, [], 0
        for doc_id, text, end in zip(ids, texts, windows.ends.tolist(), strict=True):
            words, mask = text.split(), gone[begin:end]
            kept = b" ".join(words if not mask.any() else _left(words, mask))
            out.append((doc_id, len(words), int(mask.sum()), kept.decode() if texts_too else hashlib.sha256(kept).hexdigest()))
            begin = end
        return _rows(out, f"{OUT}, {'kept_text' if texts_too else 'kept_sha256'} string")

    return run


OUT = "doc_id long, n_words long, n_removed long"


def dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", texts_too: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (or, without `texts_too`, only its SHA-256 kept_sha256) of every document."""
    chunks, total = C.stage(docs, id_col, text_col)
    sizes = Sizes(total)
    cells = chunks.mapInArrow(_sketches(sizes, window), EXCHANGE)
    counted = materialise(cells.groupBy("shard").applyInArrow(_merge_cells(sizes.range), REPLY), "cell-counts")
    found = _cogroup(chunks, counted, _candidates(sizes, window), EXCHANGE)
    judged = found.groupBy("shard").applyInArrow(_group_exactly, REPLY)
    return _cogroup(chunks, counted.unionByName(judged), _outcome(sizes, window, texts_too), f"{OUT}, {'kept_text' if texts_too else 'kept_sha256'} string")


def _cogroup(chunks: DataFrame, replies: DataFrame, function, schema: str) -> DataFrame:
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(function, schema)


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    return dedup(docs, texts_too=False)


ORACLE = """
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) as k from words, unnest(range(1, len(w) - 18)) t(i)),
repeated as (select doc_id, i from windows qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select doc_id, list(distinct i + j order by i + j) as g from repeated, unnest(range(20)) t(j) group by doc_id),
pairs as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words),
stay as (select p.doc_id, string_agg(word, ' ' order by p.i) as t from pairs p anti join (select doc_id, unnest(g) as i from gone) x on p.doc_id = x.doc_id and p.i = x.i group by p.doc_id)
select w.doc_id, len(w.w) as n_words, coalesce(len(g.g), 0) as n_removed, sha256(coalesce(s.t, '')) as kept_sha256
from words w left join gone g on w.doc_id = g.doc_id left join stay s on w.doc_id = s.doc_id"""
