"""Operator 12: a Merkle manifest of a dataset, with an inclusion proof for every row, by pointer jumping.

Every row is a leaf: the SHA-256 of its fields. The leaves of a group (a source), in id order, form a tree of runs of `ARITY`; the
groups' roots, in group order, form one more tree above, whose root stands for the whole dataset.

1. Leaves are numbered within their group by a range partition, a count for each partition, and offsets: no group is sorted in one task.
2. Trees grow `STEPS` levels a round: blocks of `ARITY ** STEPS` neighbouring nodes meet in one row, so a round costs one shuffle and the
   next one has 729 times fewer nodes. Each node below a root becomes a row that names its parent and holds its siblings left and right
   of it: the segment of a proof that leads to the parent.
3. Proofs come from pointer jumping: a self-join on "my ancestor is your key" appends the ancestor's segments to a row's own and doubles the
   distance, until every leaf has reached the root; that takes log2(height) joins. A round keeps leaves, and of the inner nodes those that a later round can meet.

A node at distance d has up to `ARITY ** d` descendants that ask for it. From distance 8 on the nodes asked for are counted: at
most `BROADCAST_NODES` are broadcast, more are joined with `SALTS` copies of each, so that no task gets all rows below one node.

Defined cases. A null field is `-`, any other value its UTF-8 byte count, a colon and the value. Null groups and null ids come first; rows of
one group and id are ordered by their leaf; equal rows are leaves of their own, in any order. A group of one row has its leaf as its root. An empty
table has no rows and no root. Only the named columns are read, so other columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.common import drop_path, materialise, shared_dir

ARITY, STEPS = 3, 6
BROADCAST_NODES = 20_000
SALTS = 16
#: The number of the tree above the groups.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STATE = ("tree", "level", "at", "to_tree", "to_level", "to_at", "segments", "subroot", "id", "leaf", "altered")


def digest(*parts: Column) -> Column:
    """The SHA-256 of the parts, one after another, in lower-case hexadecimal digits."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as part of a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    """The leaf of a row with these values."""
    return digest(*map(field, values))


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows sorted by range partition, with `part` and `row`; and for each group and part: `first` row, `before` (rows of the group in earlier parts), `total`.

    A row's number in its group is `row - first + before`. The second table has a row for each partition and each group at most.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    spread = F.monotonically_increasing_id()  # parts rows that are equal in all else
    dealt = rows.withColumn("spread", spread).repartitionByRange(*keys, "spread").sortWithinPartitions(*keys, "spread").drop("spread")
    staged = materialise(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "numbered")
    parts = staged.groupBy(*group, "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(*group)
    return staged, parts.withColumn("before", F.sum("rows").over(whole.orderBy("part")) - F.col("rows")).withColumn("total", F.sum("rows").over(whole)).drop("rows")


def height(count: Column) -> Column:
    """Levels above `count` leaves: the least h with ARITY ** h >= count."""
    powers = F.array(*[F.lit(ARITY**h).cast("long") for h in range(40)])
    return F.size(F.filter(powers, lambda p: p < count))


def _above(below: Column) -> Column:
    """The hashes of the runs of a level."""
    runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda run: F.sha2(F.concat_ws("", F.slice(below, run * ARITY + 1, ARITY)), 256))


def _grow(nodes: DataFrame, base: int) -> DataFrame:
    """One row a block of nodes (tree, high, at, hash, id, altered): the hashes of its levels, `steps` of them, and its leaves' own columns."""
    member = F.struct("at", "hash", "id", "altered")
    blocks = nodes.withColumn("block", F.floor(F.col("at") / ARITY**STEPS).cast("long")).groupBy("tree", "high", "block").agg(F.sort_array(F.collect_list(member)).alias("members"))
    blocks = blocks.withColumn("steps", F.least(F.col("high") - base, F.lit(STEPS))).withColumn("level0", F.col("members.hash"))
    for step in range(1, STEPS + 1):
        blocks = blocks.withColumn(f"level{step}", F.when(F.col("steps") >= step, _above(F.col(f"level{step - 1}"))))
    return blocks.withColumn("top", F.coalesce(*[F.col(f"level{step}") for step in range(STEPS, -1, -1)])[0])


SEGMENTS = "array<struct<left:binary,right:binary>>"
NODE = f"struct<level:int,at:bigint,to_tree:bigint,to_level:int,to_at:bigint,segments:{SEGMENTS},subroot:string,id:bigint,leaf:string,altered:string>"


def _nodes(base: int, step: int, group_tree: bool) -> Column:
    """The nodes of a block's level `step`, as structs."""
    here, level, high = F.col(f"level{step}"), base + step, F.col("high")
    rooted = (high <= level + 1) & F.lit(group_tree)

    def packed(hashes: Column) -> Column:
        return F.unhex(F.concat_ws("", hashes))

    def node(i: Column) -> Column:
        run = F.floor(i / ARITY).cast("int") * ARITY
        segment = F.struct(packed(F.slice(here, run + 1, i - run)).alias("left"), packed(F.slice(here, i + 2, run + ARITY - 1 - i)).alias("right"))
        at = F.col("block") * ARITY ** (STEPS - step) + i
        to_tree, to_level = F.when(rooted, F.lit(TOP)).otherwise(F.col("tree")), F.when(rooted, 0).otherwise(level + 1)
        to_at = F.when(rooted, F.col("tree")).otherwise(F.floor(at / ARITY))
        segments = F.when(high > 0, F.array(segment)).otherwise(F.array())
        own = [F.col("members")[i][c] for c in ("id", "hash", "altered")] if group_tree and level == 0 else [F.lit(None)] * 3
        return F.struct(F.lit(level), at, to_tree, to_level, to_at, segments, F.when(rooted, F.col("top")), *own).cast(NODE)

    there = (F.col("steps") > step) | F.lit(group_tree and level == 0)
    return F.when(there, F.transform(F.sequence(F.lit(0), F.size(here) - 1), node)).otherwise(F.array().cast(f"array<{NODE}>"))


def _state(blocks: DataFrame, base: int, group_tree: bool) -> DataFrame:
    """The nodes below the roots, each with the segment to its parent; a lone leaf points to its root's place in the tree above, without a segment."""
    nodes = F.concat(*[_nodes(base, step, group_tree) for step in range(STEPS)])
    return blocks.select("tree", F.explode(nodes).alias("node")).select("tree", "node.*")


def _trees(leaves: DataFrame, tallest: int, group_tree: bool) -> tuple[DataFrame, DataFrame]:
    """The nodes of trees from leaves (tree, high, at, hash, id, altered), and each tree's root (tree, hash)."""
    states, roots, nodes, base = [], [], leaves, 0
    while True:
        blocks = materialise(_grow(nodes, base), "blocks")
        states.append(_state(blocks, base, group_tree))
        roots.append(blocks.where(F.col("high") <= base + STEPS).select("tree", F.col("top").alias("hash")))
        base += STEPS
        if tallest <= base:
            break
        above = blocks.where(F.col("high") > base)
        nodes = above.select("tree", "high", F.col("block").alias("at"), F.col("top").alias("hash"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("altered"))
    nodes, found = states[0], roots[0]
    for more, other in zip(states[1:], roots[1:], strict=True):
        nodes, found = nodes.unionByName(more), found.unionByName(other)
    return nodes, found


def _jump(state: DataFrame, distance: int) -> DataFrame:
    """Every row that has not reached the root goes on to where its ancestor, `distance` levels up, points to."""
    inner = (F.col("level") >= distance) | (F.col("tree") == TOP)
    ahead = state.where(inner).select(*[F.col(c).alias(f"next_{c}") for c in STATE[:8]])
    stay = state.where(F.col("id").isNotNull() | F.col("leaf").isNotNull() | (F.col("level") >= 2 * distance) | (F.col("tree") == TOP))
    keys = (stay["to_tree"] == ahead["next_tree"]) & (stay["to_level"] == ahead["next_level"]) & (stay["to_at"] == ahead["next_at"])
    if distance >= 8:
        if ahead.count() <= BROADCAST_NODES:
            ahead = F.broadcast(ahead)
        else:
            stay = stay.withColumn("salt", F.pmod(F.xxhash64("tree", "level", "at"), F.lit(SALTS)).cast("int"))
            ahead = ahead.withColumn("next_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            keys = keys & (stay["salt"] == ahead["next_salt"])
    met = stay.join(ahead, keys, "left")
    on = {f"to_{c}": F.coalesce(f"next_to_{c}", f"to_{c}").alias(f"to_{c}") for c in ("tree", "level", "at")}
    on["segments"] = F.when(F.col("next_tree").isNull(), F.col("segments")).otherwise(F.concat("segments", "next_segments")).alias("segments")
    on["subroot"] = F.coalesce("subroot", "next_subroot").alias("subroot")
    return met.select(*[on.get(c, F.col(c)) for c in STATE])


def manifest(rows: DataFrame) -> tuple[DataFrame, str | None]:
    """Of rows (id long, grp, leaf, altered): id, leaf, altered, subroot, segments from leaf to root (left and right siblings, binary); and the root.

    `altered` goes along unchanged.
    """
    spark = rows.sparkSession
    staged, parts = ranked(materialise(rows, "leaves"), ["grp"], ["id", "leaf"])  # written first, as ranking looks at its rows twice
    parts = materialise(parts, "parts")
    groups, order = ranked(parts.groupBy("grp").agg(F.max("total").alias("total")), [], ["grp"])
    order = order.select("part", (F.col("before") - F.col("first")).alias("shift"), F.col("total").alias("groups"))
    groups = materialise(groups.join(order, "part").select(F.col("grp").alias("of"), (F.col("row") + F.col("shift")).alias("tree"), "groups", height(F.col("total")).alias("high")), "groups")
    tallest, count = groups.agg(F.max("high"), F.max("groups")).first()
    if count is None:
        return spark.createDataFrame([], f"id long, leaf string, altered string, subroot string, segments {SEGMENTS}"), None
    placed = parts.join(groups, parts["grp"].eqNullSafe(groups["of"])).select(F.col("grp").alias("of"), F.col("part").alias("of_part"), "tree", "high", (F.col("before") - F.col("first")).alias("shift"))
    leaves = staged.join(placed, (staged["part"] == placed["of_part"]) & staged["grp"].eqNullSafe(placed["of"])).select("tree", "high", (F.col("row") + F.col("shift")).alias("at"), F.col("leaf").alias("hash"), "id", "altered")
    nodes, roots = _trees(leaves, tallest, True)
    rise = next(h for h in range(40) if ARITY**h >= count)
    upper = roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(rise).alias("high"), F.col("tree").alias("at"), "hash", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("altered"))
    above, root = _trees(upper, rise, False)
    path = shared_dir(spark, "segments")
    nodes.unionByName(above).write.parquet(path)
    state, distance, most = spark.read.schema(nodes.schema).parquet(path), 1, max(tallest, 1) + rise  # a lone leaf is a step behind
    while distance < most:
        state, last = _jump(state, distance), path
        distance *= 2
        if distance < most:
            path = shared_dir(spark, "segments")
            state.write.parquet(path)
            state = spark.read.schema(nodes.schema).parquet(path)
            drop_path(spark, last)
    done = state.where(F.col("leaf").isNotNull()).select("id", "leaf", "altered", "subroot", "segments")
    return done, root.first()["hash"]


def folded(leaf: Column, segments: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(segments, leaf, lambda below, s: digest(F.lower(F.hex(s["left"])), below, F.lower(F.hex(s["right"]))))


def proof_digest(segments: Column) -> Column:
    """The SHA-256 of all siblings of a proof, from leaf to root, left to right."""
    return F.sha2(F.concat_ws("", F.transform(segments, lambda s: F.lower(F.concat(F.hex(s["left"]), F.hex(s["right"]))))), 256)


def query(docs: DataFrame) -> DataFrame:
    """The contract's digest: rows with an even checksum of the id are tampered with (their text loses its line feeds) and verified again."""
    ids = F.col("doc_id").cast("long")
    odd = F.crc32(F.encode(ids.cast("string"), "utf-8")) % 2 == 0
    others, text = [F.col(c) for c in FIELDS[1:-1]], F.col("text")
    cut = F.when(odd & (F.instr(text, "\n") > 0), leaf_of(ids, *others, F.replace(text, F.lit("\n"), F.lit(""))))
    rows = docs.select(ids.alias("id"), F.col("source").alias("grp"), leaf_of(ids, *others, text).alias("leaf"), cut.alias("altered"))
    proofs, root = manifest(rows)
    back = folded(F.coalesce("altered", "leaf"), F.col("segments"))
    out = proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("segments")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL of the digest: trees level by level, then a climb from every leaf with its own and its tampered hash."""

    def value(column: str) -> str:
        return f"coalesce(strlen({column}::varchar)::varchar || ':' || {column}::varchar, '-')"

    others = " || ".join(value(c) for c in FIELDS[1:-1])
    return f"""
with recursive steps(c, k, x) as (select c, 0, c from range(256) t(c) union all
  select c, k + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from steps where k < 8),
crc_table as (select list(x order by c) as t from steps where k = 8),
summed as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda b: ('0x' || b)::bigint)),
  lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) as crc from {docs}, crc_table),
hashed as (select doc_id, source, sha256({value('doc_id')} || {others} || {value('text')}) as leaf,
  sha256({value('doc_id')} || {others} || {value("(case when crc % 2 = 0 then replace(text, chr(10), '') else text end)")}) as altered from summed),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p, dense_rank() over (order by encode(source) nulls first) - 1 as tree from hashed),
up(tree, lvl, p, h) as (select tree, 0, p, leaf from leaves union all
  select tree, lvl + 1, p // {ARITY}, sha256(string_agg(h, '' order by p)) from (select *, count(*) over (partition by tree) as c from up) where c > 1 group by tree, lvl, p // {ARITY}),
subroots as (select tree, arg_max(h, lvl) as subroot, max(lvl) as high from up group by tree),
over_all(lvl, p, h) as (select 0, tree, subroot from subroots union all
  select lvl + 1, p // {ARITY}, sha256(string_agg(h, '' order by p)) from (select *, count(*) over () as c from over_all) where c > 1 group by lvl, p // {ARITY}),
top as (select arg_max(h, lvl) as root, max(lvl) as rise from over_all),
runs as (select tree, lvl, p // {ARITY} as q, list(h order by p) as hs from up group by all union all select null, lvl, p // {ARITY}, list(h order by p) from over_all group by all),
climb(doc_id, leaf, tree, lvl, p, proof, acc, up_there) as (select doc_id, leaf, tree, 0, p, '', altered, false from leaves union all
  select c.doc_id, c.leaf, c.tree, case when turn then 0 else c.lvl + 1 end, case when turn then c.tree else c.p // {ARITY} end,
    case when turn then c.proof else c.proof || list_aggregate(list_concat(hs[:c.p % {ARITY}], hs[c.p % {ARITY} + 2:], ['']), 'string_agg', '') end,
    case when turn then c.acc else sha256(list_aggregate(list_concat(hs[:c.p % {ARITY}], [c.acc], hs[c.p % {ARITY} + 2:]), 'string_agg', '')) end, c.up_there or turn
  from (select c.*, not up_there and lvl = high as turn from climb c join subroots using (tree)) c cross join top
  left join runs r on r.tree is not distinct from (case when c.up_there then null else c.tree end) and r.lvl = c.lvl and r.q = c.p // {ARITY} where not (c.up_there and c.lvl = rise))
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, acc as folded_root, acc = root as verified
from climb join subroots using (tree) cross join top where up_there and lvl = rise"""
