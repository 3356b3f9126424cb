"""Operator 11: exact n-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set is its distinct shingles of `SHINGLE` words; documents with equal sets form a class, and one document of each goes on.
Sizes are cut into bands. In band k, whose largest size is `hi`, two sets that link differ in at most H = hi (100 - p) / p shingles, so the
universe of shingles is dealt by hash into H + 1 segments: sets that link are equal in one segment at least. A document gives a key for
each of its segments, under its own band and, if a smaller partner can be there, under the band below.

More generally every segment has an allowance: 0 (not looked at), 1 (equal) or 2 (equal, or one shingle more or less, found by one-deletion
neighbourhoods). The allowances of a band must sum to H + 1. Allocation is by cost: the pairs that a segment's keys make are counted over all
documents, and a dear segment goes (0) where the one-deletion keys of a cheap one (2) make fewer. Documents that share a key are candidates:

1. Each is paired with the least member of each of its keys. Pairs are confirmed on the full sets, and linked documents become components.
2. Keys whose members are still in different components are open: their members are compared by blocks, by bit matrices over the shared shingles, never
   expanded into rows of pairs.

After that every two members of a key are in one component or have been compared, so no link is lost; nothing is sampled or capped. The one bound, `SWAPS`
exchanges of allowances, only leaves the others at 1. Sets are compared by 64-bit hashes of their shingles.

Defined cases. Null or empty texts, and texts without words, have no shingles and are linked with nothing. Texts of fewer words than a
shingle have one, the whole sequence. A null id counts as the largest. Rows that share an id are one document: it has the
links of each of them. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import chunks as C
from framewright.llm.common import drop_path, materialise, stored
from framewright.llm.components import components
from framewright.llm.near_dups import BROADCAST_IDS, LAST_ID, _parted, _similar, _texts, crossing_links, shingles
from framewright.llm.substrings import WordHashes

SHINGLE, PERCENT = 3, 90
#: Exchanges of allowances at most; those that save most come first.
SWAPS = 10_000
#: What a key costs, in pairs (it is dealt, grouped and joined, where a pair is joined with two sets), and what a shingle that is read again costs.
KEY_COST, READ_COST = 0.05, 0.05
#: `keys` are those of the segments under band `band` (`own` of them), then under the band below.
DESCRIBED = "owner long, known boolean, n long, c1 long, c2 long, band int, own int, keys array<long>"
KEYS = "key long, rep long, slot long"


class Bands:
    """Bands of sizes, each (100 / percent) ** 2 times as wide as the one below."""

    def __init__(self, percent: int, largest: int = 1):
        self.percent, self.starts = percent, [1]
        self.reach(largest)

    def reach(self, size: int) -> None:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * 10_000 // self.percent**2 + 1)

    def segments(self, band: int) -> int:
        """One more than the number of shingles in which sets that link, the smaller of them in this band, can differ."""
        return (100 - self.percent) * (self.starts[band + 1] - 1) // self.percent + 1

    def of(self, size: int) -> list[int]:
        """The bands under which a set of this size gives keys; not those in which only equal sets link."""
        self.reach(size)
        band = int(np.searchsorted(self.starts, size, "right")) - 1
        both = [band, band - 1] if band and self.percent * size <= 100 * (self.starts[band] - 1) else [band]
        return [b for b in both if self.segments(b) > 1]


def slot_of(band: int, segment: int | np.ndarray) -> np.ndarray:
    return np.uint64(band << 32) + np.asarray(segment, np.uint64)


def segment_keys(found: np.ndarray, band: int, count: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys and slots of an ascending set of hashes: of all segments, or the one-deletion keys of the wanted ones.

    A segment holds a range of hashes. A key is a mix of the sum of the segment's mixed hashes, so that taking one away is a subtraction.
    """
    mixed = C.scramble(found, 11)
    place = ((found >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(place, np.arange(count + 1))
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    sums = upto[edges[1:]] - upto[edges[:-1]]
    if wanted is None:
        slots = slot_of(band, np.arange(count))
    else:
        inside = np.isin(place, wanted)
        sums, slots = sums[place[inside]] - mixed[inside], slot_of(band, place[inside])
    return C.scramble(sums + C.scramble(slots, 12), 13), slots


def _describe(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bands = WordHashes(), Bands(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, first, second, under, own, keys = [], [], [], [], [], []
                for text in part.column(1):
                    found = shingles(text.as_py() or b"", memo, SHINGLE)
                    whole = xxhash.xxh3_128_intdigest(found.tobytes())
                    own_bands = bands.of(len(found)) if len(found) else []
                    each = [segment_keys(found, b, bands.segments(b))[0] for b in own_bands]
                    sizes.append(len(found))
                    first.append((whole >> 64) - (1 << 63))
                    second.append((whole & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                    under.append(own_bands[0] if each else None)
                    own.append(len(each[0]) if each else 0)
                    keys.append(np.concatenate(each) if each else np.zeros(0, np.uint64))
                owners, offsets = part.column(0), np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).view(np.int64)))
                columns = [owners.fill_null(LAST_ID), owners.is_valid(), *[pa.array(c, pa.int64()) for c in (sizes, first, second)], pa.array(under, pa.int32()), pa.array(own, pa.int32()), listed]
                yield pa.RecordBatch.from_arrays(columns, ["owner", "known", "n", "c1", "c2", "band", "own", "keys"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingles(t.as_py() or b"", memo, SHINGLE).view(np.int64) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["owner", "shingles"])


def _less(bands: Bands, doubled: dict[int, np.ndarray]):
    """The one-deletion keys of documents in the segments `doubled` (by band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys, slots, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for owner, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    found = shingles(text.as_py() or b"", memo, SHINGLE)
                    for band in bands.of(len(found)) if len(found) else []:
                        if band in doubled:
                            key, slot = segment_keys(found, band, bands.segments(band), doubled[band])
                            keys.append(key)
                            slots.append(slot)
                            owners.append(np.full(len(key), owner))
                columns = [np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(slots).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "rep", "slot"])

    return run


def of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with the given ids (`owner`), which are broadcast up to a bound."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "owner", "left_semi")


class Confirmer:
    """Confirms candidate pairs (a, b) on the documents' full sets; `reps` has rep and n."""

    def __init__(self, docs: DataFrame, reps: DataFrame, percent: int):
        self.docs, self.reps, self.percent = docs.withColumn("owner", F.coalesce("owner", F.lit(LAST_ID))), reps, percent
        self.held: str | None = None

    def texts(self, ids: DataFrame) -> DataFrame:
        """owner and text of the documents with the given ids (`owner`)."""
        return of_ids(self.docs, ids)

    def sets(self, ids: DataFrame) -> DataFrame:
        """owner and shingles of the documents with the given ids; this table takes the place of the one before, which is deleted."""
        texts = self.texts(materialise(ids.distinct(), "ids"))
        self.release()
        found, self.held = stored(texts.mapInArrow(_sets, "owner long, shingles array<long>"), "sets")
        return found

    def release(self) -> None:
        if self.held:
            drop_path(self.docs.sparkSession, self.held)
        self.held = None

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The edges (u, v) among the pairs, to be written before the next call."""
        a, b = (self.reps.select(F.col("rep").alias(f"rep_{side}"), F.col("n").alias(f"n_{side}")) for side in "ab")
        checked = pairs.join(a, pairs["a"] == F.col("rep_a")).join(b, pairs["b"] == F.col("rep_b"))
        checked = materialise(checked.where(_similar(F.col("n_a"), F.col("n_b"), self.percent)).select("a", "b").distinct(), "pairs")
        sets = self.sets(checked.select(F.col("a").alias("owner")).unionByName(checked.select(F.col("b").alias("owner"))))
        a, b = (sets.select(F.col("owner").alias(side), F.col("shingles").alias(f"set_{side}")) for side in "ab")
        both = checked.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
        return both.where(100 * F.col("common") >= self.percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def swaps(shared: DataFrame, reps: DataFrame, bands: Bands) -> list[tuple[int, int, int]]:
    """(band, dear segment, cheap segment) of the exchanges that save pairs, from the rows (slot, documents) of documents with keys that `documents` of them share.

    The dearest segment of a band is set against the cheapest, the second against the second cheapest, and so on. One-deletion keys are
    taken to double a segment's pairs, and cost `KEY_COST` for each shingle. A band's exchanges must also pay for reading its documents again.
    """
    spark, low = shared.sparkSession, F.lit((1 << 32) - 1)
    pairs = (F.col("documents").cast("double") - 1) / 2  # each of a key's documents has its share
    paid = shared.groupBy("slot").agg(F.sum(pairs).alias("pairs"))
    spans = [(k, a, b - 1, bands.segments(k)) for k, (a, b) in enumerate(zip(bands.starts, bands.starts[1:], strict=False))]
    spans = F.broadcast(spark.createDataFrame(spans, "band int, least long, most long, segments long"))  # a row for each band: some dozens
    load = reps.join(spans, F.col("n").between(F.col("least"), F.col("most"))).groupBy("band", "segments").agg((F.sum("n") / F.max("segments") * KEY_COST).alias("key_cost"), (F.sum("n") * READ_COST).alias("read_cost"))
    every = load.where("segments > 1").withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("segments") - 1), lambda s: F.shiftleft(F.col("band").cast("long"), 32) + s)))
    every = every.join(paid, "slot", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.col("pairs").desc(), "slot"))
    ranked = materialise(every.withColumn("rank", rank), "segments")
    dear = ranked.where("2 * rank <= segments and pairs > key_cost").select("band", "rank", "key_cost", "read_cost", "pairs", F.col("slot").bitwiseAND(low).alias("dear"))
    cheap = ranked.select("band", (F.col("segments") + 1 - F.col("rank")).alias("rank"), F.col("pairs").alias("more"), F.col("slot").bitwiseAND(low).alias("cheap"))
    gain = F.col("pairs") - F.col("key_cost") - F.col("more")
    paying = dear.join(cheap, ["band", "rank"]).withColumn("gain", gain).where("gain > 0")
    paying = paying.withColumn("all", F.sum("gain").over(Window.partitionBy("band"))).where(F.col("all") > F.col("read_cost"))
    best = paying.orderBy(F.col("gain").desc(), "band", "dear").limit(SWAPS)
    return [(r["band"], r["dear"], r["cheap"]) for r in best.collect()]


def met(rows: DataFrame, *keys: str) -> DataFrame:
    """key, rep and slot with `documents`, `low` and `high`: how many rows have these keys, their least and largest rep. All rows are shuffled once."""
    group = Window.partitionBy(*keys)
    return rows.select("key", "rep", "slot", F.count(F.lit(1)).over(group).alias("documents"), F.min("rep").over(group).alias("low"), F.max("rep").over(group).alias("high"))


def candidates(described: DataFrame, confirmer: Confirmer, bands: Bands) -> DataFrame:
    """key, rep, least: the documents that share a key with others, and the least of those."""
    reps = confirmer.reps
    rows = of_ids(described.select("owner", "band", "own", "keys"), materialise(reps.select(F.col("rep").alias("owner")).distinct(), "ids"))
    rows = rows.select(F.col("owner").alias("rep"), "band", "own", F.posexplode("keys").alias("place", "key"))
    below = F.col("place") >= F.col("own")
    slot = F.shiftleft((F.col("band") - below.cast("int")).cast("long"), 32) + F.col("place") - F.when(below, F.col("own")).otherwise(0)
    rows = rows.select("key", "rep", slot.alias("slot"))
    shared, held = stored(met(rows, "key", "slot").where("documents > 1"), "shared")
    exchanged = swaps(shared, confirmer.reps, bands)
    found = shared.select("key", "rep")
    if exchanged:
        spark = rows.sparkSession
        gone = spark.createDataFrame([(int(slot_of(band, place)),) for band, *both in exchanged for place in both], "slot long")
        doubled = {band: np.array(sorted(cheap for b, _, cheap in exchanged if b == band)) for band in {e[0] for e in exchanged}}
        sizes = F.lit(False)
        for band in doubled:  # its own documents, and those of the next band
            sizes = sizes | F.col("n").between(bands.starts[band], (bands.starts + [1 << 62])[min(band + 2, len(bands.starts))] - 1)
        texts = confirmer.texts(materialise(reps.where(sizes).select(F.col("rep").alias("owner")).distinct(), "ids")).select("owner", "text")
        less = texts.mapInArrow(_less(bands, doubled), KEYS)
        spots = spark.createDataFrame([(int(slot_of(band, cheap)),) for band, _, cheap in exchanged], "slot long")
        here = rows.join(F.broadcast(spots), "slot", "left_semi").unionByName(less)  # `SWAPS` slots at most
        found = shared.join(F.broadcast(gone), "slot", "left_anti").select("key", "rep").unionByName(met(here, "key").where("low < high").select("key", "rep"))
    found = materialise(found.distinct(), "found")
    drop_path(found.sparkSession, held)
    heads = found.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("key", "least")
    return materialise(found.join(heads, "key"), "members")


def link(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    texts = _texts(docs, id_col, text_col)
    described = materialise(texts.mapInArrow(_describe(percent), DESCRIBED), "described")
    classes = materialise(described.where("n > 0").groupBy("c1", "c2").agg(F.min("owner").alias("rep")), "classes")
    reps = materialise(described.join(classes, ["c1", "c2"]).where("n > 0 and owner = rep").select("rep", "n").distinct(), "representatives")
    largest = reps.agg(F.max("n")).first()[0] or 0
    confirmer = Confirmer(texts, reps, percent)
    members = candidates(described, confirmer, Bands(percent, largest))
    stars = members.where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    links = materialise(confirmer.confirm(stars), "links")
    confirmer.release()
    labels = components(links)
    more = crossing_links(_parted(members, labels, "rep").withColumnRenamed("part_rep", "part"), confirmer, percent)
    confirmer.release()
    if more.take(1):
        labels = components(links.unionByName(more))
    named = classes.join(labels, classes["rep"] == labels["node"], "left").select("c1", "c2", F.coalesce("label", "rep").alias("part"))
    out = described.join(named, ["c1", "c2"], "left").select("owner", "known", "n", F.when(F.col("n") > 0, F.col("part")).otherwise(F.col("owner")).alias("part"))
    return out.select(F.when(F.col("known"), F.col("owner")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("part") != LAST_ID, F.col("part")).alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest."""
    return link(docs)


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of the digest: all pairs that share a shingle, then closure."""
    return f"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {docs}),
shingles as (select distinct doc_id, md5_number(array_to_string(w[i:i + least({SHINGLE}, len(w)) - 1], ' ')) as s from words, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) t(i) where len(w) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from common join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * c >= {PERCENT} * (x.n + y.n - c)),
reach(doc_id, r) as (select doc_id, doc_id from words union select v, r from reach join links on u = reach.doc_id),
least_of as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, coalesce(n, 0) as n_shingles, component_id from least_of left join sizes using (doc_id)"""
