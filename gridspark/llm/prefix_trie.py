"""Conversation prefix trie: the turns that rebuilt conversations share, merged family by family.

The conversations c of one base c - c % 100 are a family. Each is rebuilt from its base's first turns and its own rest,
and each distinct sequence of first turns is a node. Turns travel as two 64-bit hashes of role and text and a length,
never as text. A node's key is its depth and the exclusive or of a mix of every turn's hashes with its place (two times
64 bits): such a key can be continued from any place, so no conversation has to be in one task from its first turn on.

1. The hashed turns are range-partitioned by conversation and turn, and numbered by their place in the sorted partition.
   Blocks of `BLOCK` rows are the units from here on: of a hot conversation or family there are many.
2. Turns and conversations are cogrouped by family and block. Each group rebuilds its conversations and builds the small
   trie of the family's turns there; a conversation that began in an earlier block starts with the key it had there.
3. Only the combined nodes of these tries are exchanged for the global merge.
4. What a node gathers from its subtree comes without walking levels. A node is owned by its smallest member, and what a
   conversation owns is the end of its path; so a subtree holds the rest of its owner's path, summed along the path in
   blocks of depths, and all that is owned by its other members, summed over their paths above what they own.

The ids of the conversations that end at a node are listed by family, and the lists streamed in order through SHA-256,
which can't be computed in parts: one task reads the lists of a node, sorted by Spark, and holds one of them.

Defined results: a null turn is first; turns that tie are ordered by the MD5 of role and text; a null role or text is
empty; rows without a conv_id belong to no conversation; % keeps the sign, so family 0 has the ids -99 to 99; repeated
rows are turns of their own; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import written

FAMILY, SHARED = 100, 6
#: Rows of a block of turns, and depths of a block of a path.
BLOCK_BITS, DEPTHS = 16, 4096
KEY = ["depth", "k1", "k2"]
NODES = "kind int, conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, chars long, n long, ends string"
NODE, PLACE = 0, 1


def family_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def shared_turns(conv_id: Column) -> Column:
    """How many turns of its base a conversation begins with."""
    return (F.crc32(conv_id.cast("string")) % SHARED).cast("long")


# ------------------------------------------------------------------------------------------------ turns


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, d1, d2, chars) of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.md5(said).alias("tie"), F.xxhash64(F.lit(1), said).alias("d1"), F.xxhash64(F.lit(2), said).alias("d2"), F.length(text).cast("long").alias("chars")
    )


def numbered_turns(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(family, conv_id, block, seq, d1, d2, chars): seq rises with a conversation's turns, and by one inside a block."""
    hashed = written(hashed_turns(conversations)).withColumn("any", F.monotonically_increasing_id())  # equal rows can be parted
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("tie"), F.col("any")]
    ordered = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    seq = ordered.withColumn("seq", F.monotonically_increasing_id())
    return written(seq.select(family_of(F.col("conv_id")).alias("family"), "conv_id", F.shiftright("seq", block_bits).alias("block"), "seq", "d1", "d2", "chars"))


def pieces_of(turns: DataFrame) -> DataFrame:
    """A row for each conversation and block it has turns in: (family, conv_id, block, start, n, total, h). The turn of
    number seq there is the (seq - start)-th of the conversation, from 0."""
    each = turns.groupBy("family", "conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"))
    by_conv = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("n").over(by_conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("family", "conv_id", "block", (F.col("low") - before).alias("start"), "n", before.alias("before"), F.sum("n").over(by_conv).alias("total"), shared_turns(F.col("conv_id")).alias("h"))


def base_heads(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """(family, base): the first turns of the base conversations, as structs (d1, d2, chars) in order."""
    first = pieces.where(F.col("before") < SHARED - 1).where("conv_id = family").select("conv_id", "block", "start")
    at = turns.where("conv_id = family").join(first, ["conv_id", "block"]).withColumn("r", F.col("seq") - F.col("start")).where(F.col("r") < SHARED - 1)
    ordered = F.array_sort(F.collect_list(F.struct("r", "d1", "d2", "chars")))  # at most five
    return at.groupBy("family").agg(F.transform(ordered, lambda t: F.struct(t["d1"].alias("d1"), t["d2"].alias("d2"), t["chars"].alias("chars"))).alias("base"))


# ------------------------------------------------------------------------------------------------ keys


def mixed(digest: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64 well mixed bits of a turn's hash and its place from 1 (the finaliser of a splittable generator)."""
    with np.errstate(over="ignore"):
        z = digest.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def column(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return table.column(table.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def carried_keys(turns: DataFrame, sides: DataFrame) -> DataFrame:
    """(conv_id, block, c1, c2): what a conversation's own turns of earlier blocks add to its keys. Only conversations
    that lie in more than one block take part."""
    parted = sides.where("total > n").select("conv_id", "block", "start", "n_base", "h")
    rows = turns.join(parted, ["conv_id", "block"]).select("conv_id", "block", (F.col("seq") - F.col("start")).alias("r"), "h", "n_base", "d1", "d2").where("r >= h")
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = column(batch, "n_base") + column(batch, "r") - column(batch, "h") + 1
            keys = [mixed(column(batch, d), place).view(np.int64) for d in ("d1", "d2")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, keys)], schema=schema)

    each = rows.mapInArrow(run, "conv_id long, block long, x1 long, x2 long").groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parted.select("conv_id", "block").join(each, ["conv_id", "block"], "left")
    return blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0).cast("long")).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))])


# ------------------------------------------------------------------------------------------------ family tries


def family_trie(turns: pa.Table, sides: pa.Table) -> pa.Table:
    """The combined nodes of a family's turns in one block, and each conversation's places on them."""
    seq, conv = column(turns, "seq"), column(turns, "conv_id")
    order = np.lexsort((seq, conv))
    seq, conv = seq[order], conv[order]
    digests = [column(turns, d)[order] for d in ("d1", "d2")]
    chars = column(turns, "chars")[order]
    places: list[tuple[np.ndarray, ...]] = []  # conv_id, depth, k1, k2, p1, p2, chars, ends
    for side in sides.to_pylist():
        c, h, n_base = side["conv_id"], side["h"], side["n_base"]
        low, high = np.searchsorted(conv, c, "left"), np.searchsorted(conv, c, "right")
        r = seq[low:high] - side["start"]
        own = slice(low + int(np.searchsorted(r, h, "left")), high)
        depth = n_base + (seq[own] - side["start"]) - h + 1
        base = side["base"] or []
        head = [mixed(np.array([b[d] for b in base], dtype=np.int64), np.arange(1, n_base + 1)) for d in ("d1", "d2")]
        begins = side["before"] == 0
        keys, parents = [], []
        for x, (d, carry) in enumerate(zip(digests, ("c1", "c2"))):
            z = mixed(d[own], depth)
            start = np.bitwise_xor.reduce(head[x], initial=np.uint64(0)) ^ np.array([side[carry]], dtype=np.int64).view(np.uint64)[0]
            run = np.bitwise_xor.accumulate(np.concatenate([[start], z]).astype(np.uint64))
            if begins:  # the root and the base's turns, too
                run = np.concatenate([np.bitwise_xor.accumulate(np.concatenate([[np.uint64(0)], head[x]]).astype(np.uint64)), run[1:]])
            keys.append(run.view(np.int64) if begins else run[1:].view(np.int64))
            parents.append(np.concatenate([[0], run[:-1].view(np.int64)]) if begins else run[:-1].view(np.int64))
        said = chars[own]
        if begins:
            depth = np.concatenate([np.arange(n_base + 1), depth])
            said = np.concatenate([[0], [b["chars"] for b in base], said]).astype(np.int64)
        length = n_base + max(side["total"] - h, 0)
        places.append((np.full(len(depth), c), depth.astype(np.int64), *keys, *parents, said, depth == length))
    conv, depth, k1, k2, p1, p2, said, ends = (np.concatenate(x) for x in zip(*places))
    order = np.lexsort((conv, k2, k1, depth))
    d, a, b = depth[order], k1[order], k2[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    top, count = order[first], np.diff(np.append(first, len(d)))  # the smallest member is first
    nothing = lambda n: pa.nulls(n, pa.int64())
    n, m = len(top), len(conv)
    nodes = [np.full(n, NODE, dtype=np.int32), conv[top], depth[top], k1[top], k2[top], p1[top], p2[top], said[top], count.astype(np.int64)]
    paths = [np.full(m, PLACE, dtype=np.int32), conv, depth, k1, k2]
    columns = [pa.concat_arrays([pa.array(x), pa.array(y) if y is not None else nothing(m)]) for x, y in zip(nodes, [*paths, None, None, None, None])]
    ended: list[list[str] | None] = [None] * n
    group = np.cumsum(new) - 1
    for at in np.flatnonzero(ends[order]):  # one for each conversation that ends here, by node and then by id
        ended[group[at]] = ended[group[at]] or []
        ended[group[at]].append(str(conv[order[at]]))
    columns.append(pa.concat_arrays([pa.array([x and ",".join(x) for x in ended], pa.string()), pa.nulls(m, pa.string())]))
    return pa.Table.from_arrays(columns, names=[f.split()[0] for f in NODES.split(", ")])


def family_tries(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """NODES of all families: nodes (kind NODE: n members of the family, conv_id the smallest of them, p1, p2 the
    parent's key, ends the ids of those that end there) and the places of conversations (kind PLACE)."""
    turns = numbered_turns(conversations, block_bits)
    pieces = written(pieces_of(turns))
    base = F.slice(F.coalesce("base", F.array().cast("array<struct<d1:bigint,d2:bigint,chars:bigint>>")), F.lit(1), F.col("h").cast("int"))
    sides = written(pieces.join(base_heads(turns, pieces), "family", "left").withColumn("base", base).withColumn("n_base", F.size("base").cast("long")))
    carried = written(carried_keys(turns, sides))
    sided = sides.join(carried, ["conv_id", "block"], "left").fillna(0, ["c1", "c2"])
    keys = ["family", "block"]
    return turns.groupBy(*keys).cogroup(sided.groupBy(*keys)).applyInArrow(family_trie, NODES)


# ------------------------------------------------------------------------------------------------ global merge


def end_digests(tries: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the nodes at which conversations end. A family's ids are together in the order of
    all ids, so the lists that its tries have made are hashed one after another."""
    lists = tries.where(F.col("kind") == NODE).where("ends is not null").select(*KEY, F.substring_index("ends", ",", 1).cast("long").alias("first"), "ends")
    ends = lists.repartition(*KEY).sortWithinPartitions(*KEY, "first")
    schema = pa.schema([*[(k, pa.int64()) for k in KEY], ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if key != current:
                    if digest:
                        out.append((*current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if digest:
            out.append((*current, digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return ends.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def merged_nodes(tries: DataFrame) -> DataFrame:
    """The nodes of all families as one trie: KEY, p1, p2, conv_id (smallest member), n_convs, chars, n_children."""
    nodes = tries.where(F.col("kind") == NODE).groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("chars").alias("chars"))
    nodes = written(nodes)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    return written(nodes.join(children, KEY, "left").fillna(0, ["n_children"]))


def with_subtrees(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """KEY, n_leaves, saved_tokens of each node."""
    own = nodes.select(*KEY, "conv_id", F.floor(F.col("depth") / DEPTHS).alias("stretch"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    both = ("leaf", "saved")
    # the rest of the owner's path, from the node on
    stretches = own.groupBy("conv_id", "stretch").agg(*[F.sum(x).alias(x) for x in both], F.min("depth").alias("top"))
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = stretches.select("conv_id", "stretch", *[F.sum(x).over(deeper).alias(f"later_{x}") for x in both]).where("later_leaf is not null")
    below = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rest = own.select(*KEY, "conv_id", "stretch", *[F.sum(x).over(below).alias(x) for x in both]).join(written(later), ["conv_id", "stretch"], "left")
    rest = rest.select(*KEY, *[(F.col(x) + F.coalesce(f"later_{x}", F.lit(0))).alias(x) for x in both])
    # what other members own deeper down
    owned = stretches.groupBy("conv_id").agg(*[F.sum(x).alias(x) for x in both], F.min("top").alias("top")).where("top > 0 and (leaf > 0 or saved > 0)")
    above = places.join(written(owned), "conv_id").where("depth < top").groupBy(*KEY).agg(*[F.sum(x).alias(f"other_{x}") for x in both])
    total = lambda x: F.col(x) + F.coalesce(f"other_{x}", F.lit(0))
    return rest.join(above, KEY, "left").select(*KEY, total("leaf").alias("n_leaves"), total("saved").alias("saved_tokens"))


def trie_report(conversations: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    tries = written(family_tries(conversations, block_bits))
    places = tries.where(F.col("kind") == PLACE).select("conv_id", *KEY)
    nodes = merged_nodes(tries)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    placed = nodes.join(with_subtrees(nodes, places), KEY).join(end_digests(tries), KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return placed.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


ORACLE = f"""
with recursive crc(n, v, step) as (
  select n, n::bigint, 0 from range(256) t(n)
  union all select n, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from crc where step < 8
), look as (
  select list(v order by n) as t from crc where step = 8
), turn as (
  select conv_id, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as said, length(coalesce(text, ''))::bigint as chars,
         row_number() over (partition by conv_id order by turn nulls first, md5(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as r
  from conversations where conv_id is not null
), conv as (
  select conv_id, conv_id - conv_id % {FAMILY} as base,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {SHARED} as h
  from (select distinct conv_id from turn), look
), path as (
  select c.conv_id, t.r, 0 as own, t.said, t.chars from conv c join turn t on t.conv_id = c.base and t.r < c.h
  union all select c.conv_id, t.r, 1, t.said, t.chars from conv c join turn t on t.conv_id = c.conv_id and t.r >= c.h
), step as (
  select conv_id, row_number() over w as depth, chars, md5(string_agg(said, ',') over w) as key, count(*) over (partition by conv_id) as len from path window w as (partition by conv_id order by own, r rows unbounded preceding)
), place as (
  select conv_id, depth, key, coalesce(lag(key) over (partition by conv_id order by depth), '') as parent, chars, depth = len as ends from step
  union all select c.conv_id, 0, '', null, 0, not exists (select 1 from step s where s.conv_id = c.conv_id) from conv c
), node as (
  select depth, key, min(conv_id) as conv_id, any_value(parent) as parent, count(*) as n_convs, any_value(chars) as chars, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from place group by depth, key
), own as (
  select n.*, (n_convs - 1) * chars as saved, (select count(*) from node k where k.depth = n.depth + 1 and k.parent = n.key) as n_children from node n
), part as (
  select q.depth, q.key, sum(o.saved) as saved_tokens, count(*) filter (where o.n_children = 0) as n_leaves
  from own o join place p on p.conv_id = o.conv_id and p.depth = o.depth join place q on q.conv_id = o.conv_id and q.depth <= o.depth group by q.depth, q.key
)
select n.conv_id::bigint as conv_id, n.depth::bigint as depth, m.conv_id::bigint as parent_conv_id, n.n_convs::bigint as n_convs, n.n_children::bigint as n_children, part.n_leaves::bigint as n_leaves, part.saved_tokens::bigint as saved_tokens, n.ends_sha256
from own n join part using (depth, key) left join node m on m.depth = n.depth - 1 and m.key = n.parent
"""
