"""Operator 6: near-duplicate documents by MinHash, banding, verification and connected components.

A document's set is its distinct shingles of `SHINGLE` words. Documents with equal sets form a class, and only one document of
each class goes on. `PERMUTATIONS` universal hash minima are its signature; bands of `ROWS` minima put it into buckets. Two rounds
look at the buckets' members; each ends with the connected components (large-star and small-star in turn) of all links so far:

1. Each member is paired with the leader (least member) of each of its buckets.
2. Buckets whose members are in different components are open. Their members are dealt into blocks of about `BLOCK` documents by leader
   and grade of size, and block pairs that share an open bucket, and whose sizes allow links, are compared on the full sets, inside a task, by bit matrices over the shingles that
   both blocks have. Only links between components leave the task, one for each document and component.

Pairs of round 1 are checked by size and signature, then confirmed on the full sets. After round 2 every two members of a bucket are
in one component or have been compared, so no link that the bands find is lost to the choice of pairs.

Two sets of similarity 0.75 share a bucket but for 5 cases in a million, and pass the signature check but for 1 in a million; higher
similarities are missed less. A group of copies is one class; a group of near copies takes a pair for each document and band at most in round 1, and
what stays apart is compared by blocks, never expanded into rows of pairs. The full sets are built for documents in pairs or open buckets
only: their ids are broadcast up to `BROADCAST_IDS`, joined by a shuffle beyond that.

Defined cases. Null or empty texts, and texts without words, have no shingles, are linked with nothing and kept. Texts of fewer words than a
shingle have one, the whole sequence. A null id counts as the largest. Rows that share an id are one document: it has the
links of each of them. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import chunks as C
from framewright.llm.common import LOWER, UPPER, materialise
from framewright.llm.components import components
from framewright.llm.substrings import Windows, WordHashes

SHINGLE = 5
PERMUTATIONS, ROWS = 128, 4
#: Share of equal minima below which a pair isn't confirmed: over five standard deviations below 0.75.
LEAST_SHARE = 0.55
BROADCAST_IDS = 1_000_000
#: Documents of a block in round 2.
BLOCK = 256
#: Shingles whose bits are laid out at once when two blocks are compared (a byte each for every document of a block).
SLAB = 1 << 16
LAST_ID = 2**63 - 1
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
SIGNED = "owner long, known boolean, n long, c1 long, c2 long, sig array<int>"


def shingles(text: bytes, memo: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of `size` words."""
    text = text.translate(TO_LOWER)
    found = Windows([text], size, memo).hashes
    if len(found):
        return np.unique(found)
    words = text.split()
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64) if words else np.zeros(0, np.uint64)


def hash_family(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of multiply-shift hashes from 64 to 32 bits."""
    drawn = C.scramble(np.arange(2 * PERMUTATIONS, dtype=np.uint64), seed)
    return drawn[:PERMUTATIONS] | np.uint64(1), drawn[PERMUTATIONS:]


def signature(found: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The minimum of each hash over the set."""
    least = np.full(PERMUTATIONS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), 2048):
            np.minimum(least, (found[at : at + 2048, None] * family[0] + family[1]).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, family = WordHashes(), hash_family()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            owners, sizes, first, second, sigs = part.column(0).to_pylist(), [], [], [], []
            for text in part.column(1):
                found = shingles(text.as_py() or b"", memo)
                whole = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(len(found))
                first.append((whole >> 64) - (1 << 63))
                second.append((whole & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                sigs.append(signature(found, family) if len(found) else np.zeros(0, np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([LAST_ID if o is None else o for o in owners], pa.int64()), pa.array([o is not None for o in owners]), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), lists], ["owner", "known", "n", "c1", "c2", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingles(t.as_py() or b"", memo).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["owner", "shingles"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("owner"), F.encode(F.col(text_col), "utf-8").alias("text"))


def _buckets(reps: DataFrame) -> DataFrame:
    """key, rep, n: a row for each band of each representative."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // ROWS - 1)), lambda b: F.xxhash64(b, F.slice("sig", b * ROWS + 1, ROWS)))
    return reps.select("rep", "n", F.explode(keys).alias("key"))


def _similar(size_a: Column, size_b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be that similar."""
    return 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)


class Verifier:
    """Confirms candidate pairs (a, b) on the documents' full sets."""

    def __init__(self, docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, percent: int):
        self.docs, self.reps, self.percent = _texts(docs, id_col, text_col), reps, percent

    def sets(self, ids: DataFrame) -> DataFrame:
        """owner and shingles of the documents with the given ids (`owner`)."""
        ids = materialise(ids.distinct(), "ids")
        wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        known = self.docs.withColumn("owner", F.coalesce("owner", F.lit(LAST_ID))).join(wanted, "owner", "left_semi")
        return materialise(known.mapInArrow(_sets, "owner long, shingles array<long>"), "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The edges (u, v) among the pairs."""
        a, b = (self.reps.select(*[F.col(c).alias(f"{c}_{side}") for c in ("rep", "n", "sig")]) for side in "ab")
        checked = pairs.join(a, pairs["a"] == F.col("rep_a")).join(b, pairs["b"] == F.col("rep_b"))
        equal = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        checked = checked.where(_similar(F.col("n_a"), F.col("n_b"), self.percent) & (equal >= int(LEAST_SHARE * PERMUTATIONS)))
        checked = materialise(checked.select("a", "b").distinct(), "pairs")
        sets = self.sets(checked.select(F.col("a").alias("owner")).unionByName(checked.select(F.col("b").alias("owner"))))
        a, b = (sets.select(F.col("owner").alias(side), F.col("shingles").alias(f"set_{side}")) for side in "ab")
        both = checked.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
        return both.where((F.col("common") > 0) & (100 * F.col("common") >= self.percent * (F.size("set_a") + F.size("set_b") - F.col("common")))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def link(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    signed = materialise(_texts(docs, id_col, text_col).mapInArrow(_sign, SIGNED), "signatures")
    classes = materialise(signed.where("n > 0").groupBy("c1", "c2").agg(F.min("owner").alias("rep")), "classes")
    reps = signed.join(classes, ["c1", "c2"]).where("n > 0 and owner = rep").select("rep", "n", "sig")
    reps = materialise(reps, "representatives")
    rows = _buckets(reps)
    shared = rows.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("key", "least")
    members = materialise(rows.join(shared, "key"), "members")
    verifier = Verifier(docs, reps, id_col, text_col, percent)
    stars = members.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialise(verifier.confirm(stars), "links")
    labels = components(links)
    more = crossing_links(_parted(members, labels, "rep").withColumnRenamed("part_rep", "part"), verifier, percent)
    if more.take(1):
        labels = components(links.unionByName(more))
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("c1", "c2", F.coalesce("label", "rep").alias("part"))
    out = signed.select("owner", "known", "n", "c1", "c2").join(named, ["c1", "c2"], "left")
    out = out.select(F.when(F.col("known"), F.col("owner")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("part")).otherwise(F.col("owner")).alias("part"), "owner")
    return out.select("doc_id", "n_shingles", F.when(F.col("part") != LAST_ID, F.col("part")).alias("component_id"), (F.col("part") == F.col("owner")).alias("kept"))


def _parted(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Adds part_<name>: the component that a node is in by now."""
    named = labels.select(F.col("node").alias(name), F.col("label").alias("__label"))
    return rows.join(named, name, "left").withColumn(f"part_{name}", F.coalesce("__label", name)).drop("__label")


def crossing_links(placed: DataFrame, verifier: Verifier, percent: int) -> DataFrame:
    """Links (u, v) between components of the members (key, rep, least, part) of a bucket."""
    mixed = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    open_rows = materialise(placed.join(mixed, "key", "left_semi").select("key", "rep", "least", "part").distinct(), "open")
    homes = open_rows.groupBy("rep").agg(F.min("least").alias("leader"), F.min("part").alias("part"))
    grade = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)) if percent < 100 else F.col("n")
    homes = homes.join(verifier.reps.select("rep", "n"), "rep").withColumn("grade", grade)
    sizes = homes.groupBy("leader", "grade").agg(F.count(F.lit(1)).alias("size"))
    block = F.xxhash64("leader", "grade", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK)))
    homes = materialise(homes.join(sizes, ["leader", "grade"]).select("rep", "part", "n", block.alias("block")), "homes")
    sets = verifier.sets(homes.select(F.col("rep").alias("owner")))
    blocks = sets.join(homes, sets["owner"] == homes["rep"]).select("block", "rep", "part", "shingles").groupBy("block").applyInArrow(_block, "block long, blob binary")
    blocks = materialise(blocks, "blocks")
    spans = homes.groupBy("block").agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    met = open_rows.join(homes.select("rep", "block"), "rep").select("key", "block").distinct().join(spans, "block")
    a, b = (met.select("key", F.col("block").alias(s), F.col("least_n").alias(f"least_{s}"), F.col("most_n").alias(f"most_{s}")) for s in "ab")
    may = (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a"))
    pairs = a.join(b, "key").where((F.col("a") <= F.col("b")) & may).select("a", "b").distinct()
    both = pairs.join(blocks.select(F.col("block").alias("a"), F.col("blob").alias("blob_a")), "a").join(blocks.select(F.col("block").alias("b"), F.col("blob").alias("blob_b")), "b")
    return materialise(both.select("blob_a", "blob_b").mapInArrow(_compare(percent), "u long, v long").distinct(), "more-links")


def _block(table: pa.Table) -> pa.Table:
    """The documents of a block as one compressed row."""
    lists = table.column("shingles").combine_chunks()
    sink = pa.BufferOutputStream()
    content = pa.record_batch({"rep": table.column("rep").combine_chunks(), "part": table.column("part").combine_chunks(), "shingles": lists})
    with pa.ipc.new_stream(sink, content.schema) as out:
        out.write_batch(content)
    packed = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "blob": pa.array([packed], pa.binary())})


def _unblock(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, components, set sizes, and all shingles in a row."""
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    lists = table.column("shingles").combine_chunks()
    return table.column("rep").to_numpy(), table.column("part").to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()


def _bit_rows(sizes: np.ndarray, shingles: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """A bit for each document and shared shingle, in 64-bit words; built for SLAB shingles at a time."""
    place = np.minimum(np.searchsorted(shared, shingles), len(shared) - 1)
    known = shared[place] == shingles
    row, place = np.repeat(np.arange(len(sizes)), sizes)[known], place[known]
    out = np.zeros((len(sizes), -(-len(shared) // 64)), np.uint64)
    for at in range(0, len(shared), SLAB):
        inside = (place >= at) & (place < at + SLAB)
        flags = np.zeros((len(sizes), -(-min(SLAB, len(shared) - at) // 64) * 64), np.uint8)
        flags[row[inside], place[inside] - at] = 1
        bits = np.packbits(flags, axis=1).view(np.uint64)
        out[:, at // 64 : at // 64 + bits.shape[1]] = bits
    return out


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1), strict=True):
                (ids, parts, sizes, shingles), (ids2, parts2, sizes2, shingles2) = _unblock(one.as_py()), _unblock(two.as_py())
                shared = np.intersect1d(shingles, shingles2)
                found: list[tuple[int, int]] = []
                if len(shared):
                    rows, rows2 = _bit_rows(sizes, shingles, shared), _bit_rows(sizes2, shingles2, shared)
                    for i in range(len(ids)):
                        common = np.bitwise_count(rows[i] & rows2).sum(axis=1, dtype=np.int64)
                        near = np.flatnonzero((common > 0) & (100 * common >= percent * (sizes[i] + sizes2 - common)) & (parts2 != parts[i]))
                        found += [(int(ids[i]), int(ids2[j])) for j in near[np.unique(parts2[near], return_index=True)[1]]]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["u", "v"])

    return run


def dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are kept: one of each group, with their own columns."""
    gone = link(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["gone_id"]), "left_anti")


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    return link(docs)


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of the digest: all pairs that share a shingle, then closure."""
    return f"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {docs}),
shingles as (select distinct doc_id, md5_number(array_to_string(w[i:i + least(5, len(w)) - 1], ' ')) as s from words, unnest(range(1, greatest(len(w) - 3, 2))) t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from common join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, r) as (select doc_id, doc_id from words union select v, r from reach join links on u = reach.doc_id),
least_of as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from least_of left join sizes using (doc_id)"""
