"""Operator 5 [native]: reproducible shuffle and sharding by a Feistel permutation.

Rows get global numbers 0..n-1 in the order (bucket, id, size, checksum), where bucket is a mix of id and checksum, so that
rows of one id (or none) with different texts lie in many buckets. A Feistel
network over the product of two near-square radices permutes the numbers; results at or beyond n walk the cycle
until they fall below n. Shard and slot follow from the permuted number alone: `p mod shards` and `p div shards`, so
shard sizes differ by one row at most and slots have no gaps. Anyone who knows n, the seed and a row's number can compute
where the row is without a lookup.

Row numbers need no global sort: the numbers inside a bucket come from a window per bucket, and a bucket's first number
from a running sum over the table of bucket counts, which has `NUMBER_BUCKETS` rows at most whatever the input.

Defined cases. A null text has no bytes (size 1) and the checksum of the empty string. A null id counts as 0 in
the mix and comes before the others of its bucket. Rows equal in id, size and checksum take consecutive numbers, in any order among themselves; they
are first counted per partition, so no task gets a hot group's rows. An empty table gives an empty result. Only the id and
text columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the table of bucket counts at most.
NUMBER_BUCKETS = 4096
#: Steps of a cycle walk. At most sqrt(n)+1 of the domain's points lie at or beyond n, so a walk this long has
#: a probability under (1/sqrt(n))^64 and none happens at all below n = 3,600. A walk that is not over fails the job.
WALK = 64
ROUNDS = 4
#: Prime modulus and odd multipliers of the round function; all products stay below 2^63.
PRIME, MUL_A, MUL_B = 2147483647, 1540483477, 1099087573


def mix(value: Column, key: int | Column) -> Column:
    """A keyed mix of a non-negative number into 0..2^31-1, in plain integer arithmetic."""
    a = (value % PRIME + (F.lit(key).cast("long") if isinstance(key, int) else key)) * MUL_A % PRIME
    a = a.bitwiseXOR(F.shiftright(a, 15))
    b = a * MUL_B % PRIME
    return b.bitwiseXOR(F.shiftright(b, 13))


def round_keys(seed: int) -> list[int]:
    """The keys of the rounds, below 2^31."""
    return [(seed * 7919 + r * 104729 + 12345) % PRIME for r in range(ROUNDS)]


def feistel(value: Column, left: Column, right: Column, seed: int) -> Column:
    """One pass of the network over 0..left*right-1; the two radices change places each round."""
    rounds = F.array(*[F.struct(F.lit(key).cast("long").alias("key"), (left if i % 2 == 0 else right).alias("radix")) for i, key in enumerate(round_keys(seed))])
    halves = F.struct(F.floor(value / right).cast("long").alias("l"), (value % right).cast("long").alias("r"))
    done = F.aggregate(rounds, halves, lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + mix(s["r"], k["key"])) % k["radix"]).cast("long").alias("r")))
    return done["l"] * right + done["r"]


def permute(value: Column, n: Column, seed: int) -> Column:
    """The place of row number `value` among `n` rows."""
    left = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    right = F.ceil(n.cast("double") / left).cast("long")
    once = feistel(value, left, right, seed)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda p, _: F.when(p < n, p).otherwise(feistel(p, left, right, seed)))
    walked = F.when(once < n, once).otherwise(walked)
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk is not over")).cast("long"))


def number_groups(keys: DataFrame, id_col: str) -> DataFrame:
    """Adds to a table of distinct keys with a `copies` count: `first` (the first row number of the key) and `n`."""
    of_id = mix(F.coalesce(F.abs(F.col(id_col) % PRIME), F.lit(0)), 97)
    keys = keys.withColumn("bucket", mix(F.col("text_crc32"), of_id) % NUMBER_BUCKETS)
    everything = Window.orderBy("bucket")  # over NUMBER_BUCKETS rows at most
    starts = keys.groupBy("bucket").agg(F.sum("copies").alias("rows")).select("bucket", (F.sum("rows").over(everything) - F.col("rows")).alias("start"), F.sum("rows").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    inside = Window.partitionBy("bucket").orderBy(F.col(id_col).asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return keys.withColumn("upto", F.sum("copies").over(inside)).join(F.broadcast(starts), "bucket").withColumn("first", F.col("start") + F.col("upto") - F.col("copies"))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 20) -> DataFrame:
    """Shard and slot of every row: columns id, size, text_crc32, row_number, place, shard, slot.

    `size` is the text's UTF-8 bytes plus 1. The texts themselves are not shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    keys = slim.groupBy(id_col, "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    numbered = number_groups(keys, id_col).select(id_col, "size", "text_crc32", "n", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("row_number"))
    place = numbered.withColumn("place", permute(F.col("row_number"), F.col("n"), seed))
    return place.select(id_col, "size", "text_crc32", "row_number", "place", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 20) -> None:
    """Writes the rows below `path`, one folder a shard, each file sorted by slot. Ids must be unique and not null here."""
    placed = assign(docs, shards, id_col, text_col, seed).select(id_col, "shard", "slot")
    docs.drop("shard", "slot").join(placed, id_col).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest: 16 shards under the law `rows`."""
    placed = assign(docs, 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _mix_sql(value: str, key: int | str) -> str:
    a = f"((({value}) % {PRIME} + {key}) * {MUL_A} % {PRIME})"
    a = f"xor({a}, {a} >> 15)"
    b = f"({a} * {MUL_B} % {PRIME})"
    return f"xor({b}, {b} >> 13)"


def oracle() -> str:
    """The same law in DuckDB: one ordered numbering, the network round by round, a recursive cycle walk."""

    def network(value: str) -> str:
        """SQL of a lateral chain that maps `value` to `p`, the network's output."""
        chain = f"(select {value} // rgt as l0, {value} % rgt as r0) q0"
        for i, key in enumerate(round_keys(20)):
            chain += f", lateral (select r{i} as l{i + 1}, (l{i} + {_mix_sql(f'r{i}', key)}) % {'lft' if i % 2 == 0 else 'rgt'} as r{i + 1}) q{i + 1}"
        return f"lateral (select l{ROUNDS} * rgt + r{ROUNDS} as p from {chain})"

    return f"""
with recursive steps(c, k, x) as (select c, 0, c from range(256) t(c) union all
  select c, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from steps where k < 8),
crc_table as (select list(x order by c) as t from steps where k = 8),
sized as (select doc_id, strlen(coalesce(text, '')) + 1 as size, hex(encode(coalesce(text, ''))) as h from documents),
summed as (select doc_id, size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::bigint)),
  lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) as text_crc32 from sized, crc_table),
numbered as (select *, count(*) over () as n, row_number() over (order by {_mix_sql('text_crc32', _mix_sql(f'coalesce(abs(doc_id % {PRIME}), 0)', 97))} % {NUMBER_BUCKETS}, doc_id nulls first, size, text_crc32) - 1 as k from summed),
radices as (select *, ceil(n / lft)::bigint as rgt from (select *, ceil(sqrt(n))::bigint as lft from numbered)),
walk as (select radices.*, z.p as p from radices, {network('k')} z
  union all select w.* exclude (p), z.p from walk w, {network('w.p')} z where w.p >= w.n)
select doc_id, size, text_crc32, 'rows' as law, (p % 16)::int as shard, p // 16 as slot, null::int as grown_shard from walk where p < n"""
