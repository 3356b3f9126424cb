"""Operator 7: exact top-k inner products by a bit-sliced index.

Components are quantised to floor(scale * x). Each block of candidate rows is turned into bit slices: for every component and every
bit one bitmap over the rows. A query's scores over a block are the sum of its weights times these slices: a set bit of a weight
puts a slice at the weight's place, negative weights use the complement of the slice, and carry-save adders reduce
the slices of each place to a sum, in bitmap arithmetic only. The top rows are selected from the most significant slice of the
sum downward; the rows that tie at the boundary are resolved by the smaller id. The few selected rows of each block then
get their exact integer scores, and a window over those takes the k best of each query.

The sliced blocks are written once, to the shared folder. Queries are written there by block, of at most `query_block` rows (a stated query set against all
rows): a block is what the driver collects and broadcasts at once, so neither grows with the input, and each block is one job that reads the
slices. A task keeps the k best of each query over all its blocks of rows. Candidates are never shuffled; k rows a query and task are.

Vectors with a component that quantises to +-2^25 or beyond, or of more than 8,192 components, are wide: their scores could pass 63 bits.
Pairs with a wide side are scored in floating point with an error bound, and all rows that could be among the k best by it in whole
numbers of any size. All other pairs use the slices.

Defined cases. Rows whose vector is null or holds a null or non-finite component take no part, as queries or candidates; neither do rows with
a null id. Vectors of different lengths: missing components count as 0. A query does not
meet rows that have its own id. Repeated rows are separate candidates, in any order among themselves. Fewer than k candidates: all of
them. Empty table: no rows. Ranks are exact for all scores; a score beyond 63 bits, which SQL cannot give either, is null as a long, and all
of its digits come with `text=True`.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import materialise, shared_dir

SCALE = 1024
#: Narrow vectors: components below LIMIT and at most WIDTH of them, so that scores stay below 2^63.
LIMIT = 1 << 25
WIDTH = 1 << 13
#: Rows of a candidate block; bytes of a broadcast block of queries follow from QUERY_BLOCK and the vector length.
BLOCK_ROWS = 1 << 14
QUERY_BLOCK = 2048
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A score beyond 63 bits has side 1 or -1, score 0, and a key that sorts as the score does.
RESULT = "query_id long, vec_id long, score long, side int, key string"
INDEX = "wide boolean, block binary"
NINES = str.maketrans("0123456789", "9876543210")


def quantise(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, and q (array<long>) or, for wide vectors, wide (scale and x, not quantised yet), of the rows that take part."""
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    parts = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x))
    usable = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    narrow = F.forall(vector, lambda x: F.abs(F.lit(float(scale)) * x) < LIMIT) & (F.size(vector) <= WIDTH)
    wide = F.struct(F.lit(scale).cast("long").alias("scale"), vector.alias("x"))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("vec_id"), F.when(narrow, parts).alias("q"), F.when(~narrow, wide).alias("wide"))


class WideVector:
    """The components of a vector as whole numbers of any size, and as floats (times 2^-20, so that none overflows)."""

    def __init__(self, scale: int, x: list[float]):
        self.scale, self.x = scale, np.array(x, np.float64)
        with np.errstate(over="ignore"):
            scaled = np.floor(self.x * float(scale))
        self.floats = np.where(np.isfinite(scaled), scaled * 2.0**-20, self.x * 2.0**-20 * scale)

    def whole(self) -> list[int]:
        out = []
        for x in self.x.tolist():
            scaled = x * float(self.scale)
            out.append(math.floor(scaled) if math.isfinite(scaled) else int(x) * self.scale)
        return out


class WideBlock:
    """Rows that are scored against a query in floating point first, then exactly where the error bound leaves it open."""

    def __init__(self, ids: np.ndarray, rows: list[WideVector] | np.ndarray):
        self.ids, self.rows = ids, rows
        if isinstance(rows, np.ndarray):
            floats = rows * 2.0**-20
        else:
            floats = np.zeros((len(rows), max((len(r.x) for r in rows), default=0)))
            for i, r in enumerate(rows):
                floats[i, : len(r.x)] = r.floats
        self.floats = floats / 2.0 ** np.frexp(np.abs(floats).max(initial=1e-300))[1]

    def whole(self, i: int) -> list[int]:
        return self.rows[i].tolist() if isinstance(self.rows, np.ndarray) else self.rows[i].whole()

    def select(self, query: list[int], floats: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best rows, ties to the smaller id."""
        width = min(self.floats.shape[1], len(floats))
        able = np.flatnonzero(self.ids != query_id)
        if len(able) > k:
            weight = floats[:width] / 2.0 ** np.frexp(np.abs(floats[:width]).max(initial=1e-300))[1]
            near = self.floats[able, :width]
            error = (width + 8) * (2.0**-51 * (np.abs(near) @ np.abs(weight)) + 1e-300)
            score = near @ weight
            able = able[score + error >= np.partition(score - error, len(able) - k)[len(able) - k]]
        exact = [(sum(a * b for a, b in zip(query, self.whole(i), strict=False)), int(self.ids[i])) for i in able.tolist()]
        return sorted(exact, key=lambda e: (-e[0], e[1]))[:k]


def _key(score: int) -> tuple[int, int, str | None]:
    """score, side and key of a row of RESULT."""
    if -(1 << 63) <= score < 1 << 63:
        return score, 0, None
    digits = str(abs(score))
    return (0, 1, f"{len(digits):05d}{digits}") if score > 0 else (0, -1, f"{len(digits):05d}{digits}".translate(NINES))


class SlicedBlock:
    """The bit slices of a block of rows, ordered by id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        n, width = self.rows.shape
        self.words = -(-n // 64)
        self.valid = self.pack(np.ones(n, bool))
        low = self.rows.min(axis=0) if width else np.zeros(0, np.int64)
        lifted = (self.rows - low).astype(np.uint64)
        self.slices = [[self.pack((lifted[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(int(lifted[:, d].max()).bit_length())] for d in range(width)]

    def pack(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: len(flags)] = flags
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def unpack(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def sum_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the scores plus a constant of the block."""
        places: list[list[np.ndarray]] = []
        for d, weight in enumerate(query[: len(self.slices)].tolist()):
            chosen, weight = (self.slices[d], weight) if weight >= 0 else ([s ^ FULL for s in self.slices[d]], -weight)
            bit = 0
            while weight:
                if weight & 1:
                    while len(places) < bit + len(chosen):
                        places.append([])
                    for b, bitmap in enumerate(chosen):
                        places[bit + b].append(bitmap)
                weight >>= 1
                bit += 1
        out, place = [], 0
        while place < len(places):
            column = places[place]
            if len(column) > 1 and place + 1 == len(places):
                places.append([])
            while len(column) > 2:  # carry-save adder: three slices of a place become one, and one of the next place
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                places[place + 1].append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                column[:] = [a ^ b]
                places[place + 1].append(a & b)
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            place += 1
        return out

    def select(self, query: np.ndarray, query_id: int, k: int) -> np.ndarray:
        """Positions of the k best rows, ties to the smaller id."""
        able = self.valid
        own = np.arange(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right"))
        if len(own):
            flags = np.zeros(len(self.ids), bool)
            flags[own] = True
            able = able & ~self.pack(flags)
        sure, open_rows = np.zeros(self.words, np.uint64), able
        taken = 0
        if int(np.bitwise_count(able).sum()) > k:
            for bitmap in reversed(self.sum_slices(query)):
                ones = open_rows & bitmap
                count = int(np.bitwise_count(ones).sum())
                if taken + count > k:
                    open_rows = ones
                else:
                    sure, taken = sure | ones, taken + count
                    open_rows = open_rows & ~bitmap
                    if taken == k:
                        break
            return np.concatenate([self.unpack(sure), self.unpack(open_rows)[: k - taken]])
        return self.unpack(able)


def _pack(block: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(block))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows as blocks: sliced ones, and those of wide vectors."""
    held_ids, held_rows, wide, held = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        blocks = []
        if held_ids:
            width = max(r.shape[1] for r in held_rows)
            blocks.append((False, SlicedBlock(np.concatenate(held_ids), np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in held_rows]))))
        if wide:
            blocks.append((True, WideBlock(np.array([i for i, _ in wide], np.int64), [v for _, v in wide])))
        for kind, block in blocks:
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([_pack(block)], pa.binary())], ["wide", "block"])

    for batch in batches:
        narrow, others = batch.filter(pc.is_valid(batch.column(1))), batch.filter(pc.is_valid(batch.column(2)))
        if narrow.num_rows:
            held_ids.append(narrow.column(0).to_numpy())
            held_rows.append(_matrix(narrow.column(1)))
        wide += [(i, WideVector(v["scale"], v["x"])) for i, v in zip(others.column(0).to_pylist(), others.column(2).to_pylist(), strict=True)]
        held += batch.num_rows
        if held >= BLOCK_ROWS:
            yield from flush()
            held_ids, held_rows, wide, held = [], [], [], 0
    if held:
        yield from flush()


def _search(queries, k: int):
    """The k best rows of each query among the blocks of a task; those with a wide side apart from the others."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, weights, wide_ids, wide_queries = queries.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        apart: dict[int, list[tuple[int, int]]] = {}

        def keep(query: int, found: list[tuple[int, int]]) -> None:
            apart[query] = sorted([*apart.get(query, []), *found], key=lambda e: (-e[0], e[1]))[:k]

        for batch in batches:
            for wide, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = pickle.loads(zstandard.ZstdDecompressor().decompress(data.as_py()))
                width = 0 if wide else block.rows.shape[1]
                for at, (query_id, weight) in enumerate(zip(query_ids.tolist(), weights, strict=True)):
                    if wide:
                        keep(at, block.select(weight.tolist(), weight * 2.0**-20, query_id, k))
                        continue
                    weight = np.pad(weight, (0, max(0, width - len(weight))))
                    rows = block.select(weight, query_id, k)
                    scores, ids = block.rows[rows] @ weight[:width], block.ids[rows]
                    if at in best:
                        scores, ids = np.concatenate([best[at][0], scores]), np.concatenate([best[at][1], ids])
                        order = np.lexsort((ids, -scores))[:k]
                        scores, ids = scores[order], ids[order]
                    best[at] = scores, ids
                if len(wide_ids):
                    rows = block if wide else WideBlock(block.ids, block.rows)
                    for at, (query_id, query) in enumerate(zip(wide_ids.tolist(), wide_queries, strict=True)):
                        keep(len(query_ids) + at, rows.select(query.whole(), query.floats, query_id, k))
        names = ["query_id", "vec_id", "score", "side", "key"]
        if best:
            columns = [np.repeat(query_ids[list(best)], [len(s) for s, _ in best.values()]), np.concatenate([i for _, i in best.values()]), np.concatenate([s for s, _ in best.values()])]
            yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in columns], pa.array(np.zeros(len(columns[0]), np.int32)), pa.nulls(len(columns[0]), pa.string())], names)
        everyone = [*query_ids.tolist(), *wide_ids.tolist()]
        pairs = [(everyone[at], i, *_key(score)) for at, found in apart.items() for score, i in found]
        if pairs:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*pairs, strict=True), kinds, strict=True)], names)

    return search


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """The lists as rows, short ones filled with 0."""
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, query_block: int = QUERY_BLOCK, text: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query; both sides as `quantise` gives them. `text`: scores as text."""
    spark = candidates.sparkSession
    index = materialise(candidates.select("vec_id", "q", "wide").mapInArrow(_index, INDEX), "slices")
    blocks = max(1, -(-queries.count() // query_block))
    asked, results = shared_dir(spark, "queries"), shared_dir(spark, "search")
    queries.select("vec_id", "q", "wide", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block").write.partitionBy("block").parquet(asked)
    numbered = spark.read.schema(f"vec_id long, q array<long>, wide {queries.schema['wide'].dataType.simpleString()}, block int").parquet(asked)
    spark.createDataFrame([], RESULT).write.parquet(f"{results}/none")
    for b in range(blocks):
        for p, piece in enumerate(_pieces(numbered.where(F.col("block") == b).select("vec_id", "q", "wide"), query_block)):
            narrow, wide = [r for r in piece if r[1] is not None], [r for r in piece if r[1] is None]
            ids = np.array([r[0] for r in narrow], np.int64)
            weights = np.zeros((len(narrow), max((len(r[1]) for r in narrow), default=0)), np.int64)
            for i, r in enumerate(narrow):
                weights[i, : len(r[1])] = r[1]
            sent = (ids, weights, np.array([r[0] for r in wide], np.int64), [WideVector(r[2]["scale"], r[2]["x"]) for r in wide])
            held = spark.sparkContext.broadcast(sent)
            index.mapInArrow(_search(held, k), RESULT).write.parquet(f"{results}/{b}-{p}")
            held.destroy()  # its queries leave the executors and the driver
    found = spark.read.schema(RESULT).option("recursiveFileLookup", "true").parquet(results)
    best = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), F.desc("key"), "vec_id")
    digits = F.substring("key", 6, 1 << 20)
    written = F.when(F.col("side") == 0, F.col("score").cast("string")).when(F.col("side") == 1, digits).otherwise(F.concat(F.lit("-"), F.translate(digits, "0123456789", "9876543210")))
    score = written if text else F.when(F.col("side") == 0, F.col("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def _pieces(rows: DataFrame, size: int) -> Iterator[list]:
    """The rows in lists of at most `size`, fetched a partition at a time."""
    held: list = []
    for row in rows.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def query(vectors: DataFrame) -> DataFrame:
    """The contract's search: ids divisible by 100 against all rows, 10 results each."""
    usable = quantise(vectors)
    return search(usable, usable.where("vec_id % 100 = 0"), 10)


ORACLE = """
with usable as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as query_id, b.vec_id as vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score
  from usable a join usable b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10"""
