"""The prefix trie of conversations, level by level: who shares which beginning, and what sharing saves.

Level by level, the live conversations are grouped by (parent node, next turn), and the
smallest conv_id of a group names the node. Where all conversations of a node go on
alike, by hashes of what is left of them, no deeper level can part them: they leave the
loop, and the rest of the node's path comes from its smallest conversation at once. So
there are as many levels as turns up to the last parting of ways, however long the
conversations are. Leaves and savings are then rolled up by joins from the deepest
level back to the root.

Groups are summed before the shuffle, and nodes that very many conversations share are
joined back by broadcast, so no task gets all rows of a node. The members that end at a
node are listed in ranges of conv_id, and the ranges hashed one after the other. Each
level is written to the shared folder. Turns are compared by 128 bits of role and text,
what is left of conversations by 128 bits.

Defined results: rows without conv_id belong to no conversation; a null role or text is
empty; turns come in the order of their number, null first, and equal numbers by the
hash of role and text; repeated rows are turns of their own; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import join_hot, settle

#: Members of a node are listed in ranges of so many conv_ids.
RANGE = 1024
EMPTY = hashlib.sha256().hexdigest()


def own_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, th, size): each conversation's turns, numbered from 1; their hashes and code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.md5(both).alias("th"), F.length(text).cast("long").alias("size"))
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "th"))
    return turns.select("conv_id", pos.alias("pos"), F.unhex("th").alias("th"), "size")


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns) after each took the first h turns of the hundred's first conversation in place of its own.

    h is the crc32 of the decimal conv_id modulo 6. ``turns`` should be settled.
    """
    sizes = settle(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "trie-sizes")
    asked = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int").alias("h"))
    found = asked.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    plan = settle(found.select("conv_id", "base", "h", F.least(F.col("h"), F.coalesce("base_n", F.lit(0))).alias("k")), "trie-plan")
    heads = turns.filter("pos <= 5").select(F.col("conv_id").alias("base"), "pos", "th", "size").join(plan.filter("k > 0"), "base").filter("pos <= k")
    tails = turns.join(plan, "conv_id").filter("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("k"))
    names = ["conv_id", F.col("pos").alias("depth"), "th", "size"]
    return plan.select("conv_id"), heads.select(*names).unionByName(tails.select(*names))


def _with_rest(turns: DataFrame) -> DataFrame:
    """Turns with the number, code points and hashes of the turns after them."""
    after = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)

    def hashed(salt: int) -> Column:
        return F.coalesce(F.bit_xor(F.xxhash64(F.lit(salt), "depth", "th")).over(after), F.lit(0))

    return turns.select("*", F.count(F.lit(1)).over(after).alias("left"), F.coalesce(F.sum("size").over(after), F.lit(0)).alias("below"), hashed(1).alias("rest1"), hashed(2).alias("rest2"))


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of rows (node, depth, member)."""
    listed = F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",")
    ranges = ends.groupBy("node", "depth", F.floor(F.col("member") / RANGE).alias("range")).agg(listed.alias("part"))
    dealt = ranges.repartition("node", "depth").sortWithinPartitions("node", "depth", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for node, depth, part in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "part"))):
                if (node, depth) == key:
                    state.update(b"," + part.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256(part.encode())
            yield _hash_batch(out)
        if key:
            yield _hash_batch([(*key, state.hexdigest())])

    return dealt.mapInArrow(run, "conv_id bigint, depth int, ends_sha256 string")


def _hash_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["conv_id", "depth", "ends_sha256"])


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def build(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node of the trie of ``turns`` (conv_id, depth, th, size) of all ``conversations`` (conv_id).

    conv_id, the smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves;
    saved_tokens; ends_sha256, of the members that end there.
    """
    spark = conversations.sparkSession
    first, many = conversations.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    if not many:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    rest = settle(_with_rest(turns), "trie-turns")
    turnless = conversations.join(rest.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
    ends = [turnless.select(F.lit(first).alias("node"), F.lit(0).alias("depth"), F.col("conv_id").alias("member"))]
    live = settle(rest.filter("depth = 1").withColumn("parent", F.lit(first)), "trie-live")
    levels, depth, bare = [], 0, rest
    alike = [F.min(c) == F.max(c) for c in ("left", "rest1", "rest2")]
    while live.take(1):
        depth += 1
        groups = live.groupBy("parent", "th").agg(
            F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("left").alias("longest"), F.max("below").alias("below"),
            reduce(Column.__and__, alike).alias("done"),
        )
        nodes = settle(groups, "trie-nodes")
        levels.append(nodes)
        marks = nodes.select("parent", "th", "node", "done", "n")
        placed = settle(join_hot(live.select("conv_id", "parent", "th", "left"), marks, ("parent", "th"), "n"), "trie-placed")
        stopped = placed.filter(F.col("done") | (F.col("left") == 0))
        ends.append(stopped.select("node", (F.lit(depth) + F.col("left")).cast("int").alias("depth"), F.col("conv_id").alias("member")))
        onward = placed.filter(~F.col("done") & (F.col("left") > 0)).select("conv_id", F.col("node").alias("parent"))
        if depth >= 4 and depth & (depth - 1) == 0:  # later levels needn't read the turns of conversations that left
            bare = settle(bare.filter(F.col("depth") > depth).join(onward.select("conv_id"), "conv_id", "left_semi"), "trie-turns")
        live = settle(onward.join(bare.filter(F.col("depth") == depth + 1), "conv_id"), "trie-live")

    nodes, paths, below = [], [], None
    for level in range(depth, 0, -1):
        here = levels[level - 1].withColumnRenamed("node", "conv_id")
        whole = here.filter("done").select(
            "conv_id", "parent", "n", F.least(F.col("longest"), F.lit(1)).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            ((F.col("n") - 1) * (F.col("size") + F.col("below"))).alias("saved"),
        )
        if below is not None:
            parted = here.filter(~F.col("done")).drop("below").join(below, "conv_id")
            whole = whole.unionByName(parted.select("conv_id", "parent", "n", "n_children", "n_leaves", ((F.col("n") - 1) * F.col("size") + F.col("s")).alias("saved")))
        rolled = settle(whole, "trie-rolled")
        below = rolled.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("s"))
        named = {"depth": F.lit(level), "parent_conv_id": F.col("parent"), "n_convs": F.col("n"), "saved_tokens": F.col("saved")}
        nodes.append(rolled.withColumns(named))
        paths.append(here.filter(F.col("done") & (F.col("longest") > 0)).select("conv_id", "n", F.lit(level).alias("top")))
    if paths:
        path = reduce(DataFrame.unionByName, paths).join(rest, "conv_id").filter(F.col("depth") > F.col("top"))
        nodes.append(path.select(
            "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.least(F.col("left"), F.lit(1)).alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("size") + F.col("below"))).alias("saved_tokens"),
        ))
    own = {"depth": F.lit(0), "parent_conv_id": F.lit(None).cast("long"), "n_convs": F.lit(many)}
    if below is None:
        root = conversations.filter(F.col("conv_id") == first).withColumns(own | {"n_children": F.lit(0), "n_leaves": F.lit(1), "saved_tokens": F.lit(0)})
    else:
        root = below.withColumnRenamed("s", "saved_tokens").withColumns(own)
    nodes.append(root)
    every = reduce(DataFrame.unionByName, [n.select(*NODE) for n in nodes])
    hashed = _hashed_ends(reduce(DataFrame.unionByName, [e.select(F.col("node").cast("long").alias("node"), "depth", F.col("member").cast("long").alias("member")) for e in ends]))
    out = every.join(hashed, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return out.select(*[F.col(c).cast("long").alias(c) for c in NODE], "ends_sha256")


def trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) that share their hundred's first turns."""
    return build(*shared_heads(settle(own_turns(rows), "trie-own")))


# crc32 by a table of its 256 steps, as SQL has none
ORACLE = """
with recursive steps(i, v, k) as (select i, i, 0 from range(256) r(i) union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from steps where k < 8),
tab as (select list(v order by i) as t from steps where k = 8),
said as (select conv_id as c, turn, md5(len(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as th, len(coalesce(text, '')) as size from conversations where conv_id is not null),
own as (select c, list(th order by turn nulls first, th) as ths, list(size order by turn nulls first, th) as sizes from said group by c),
asked as (
    select c, ths, sizes, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
           lambda s, x: xor(t[(xor(s, x) & 255) + 1], s >> 8)), 4294967295) % 6 as h from own, tab),
rebuilt as (select a.c, coalesce(b.ths[:h], []) || a.ths[h + 1:] as ths, coalesce(b.sizes[:h], []) || a.sizes[h + 1:] as sizes from asked a left join own b on b.c = a.c - a.c % 100),
prefix as (select c, d, md5(array_to_string(ths[:d], '')) as key, coalesce(sizes[d], 0) as size, len(ths) as n from (select *, unnest(range(len(ths) + 1)) as d from rebuilt)),
node as (select d, key, min(c) as c, count(*) as n, max(size) as size, max(n) = d as leaf, coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '') as ends from prefix group by d, key),
up as (select p.d, p.key, x.d as deep, x.n, x.size, x.leaf from node x join prefix p on p.c = x.c and p.d <= x.d),
sums as (select d, key, sum((n - 1) * size)::bigint as saved, count(*) filter (leaf) as leaves, count(*) filter (deep = d + 1) as children from up group by d, key)
select x.c as conv_id, x.d as depth, y.c as parent_conv_id, x.n as n_convs, s.children as n_children, s.leaves as n_leaves, s.saved as saved_tokens, sha256(x.ends) as ends_sha256
from node x join sums s on s.d = x.d and s.key = x.key left join prefix p on p.c = x.c and p.d = x.d - 1 left join node y on y.d = p.d and y.key = p.key"""
