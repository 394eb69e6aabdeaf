"""N-gram Jaccard join over a count-vector R-tree, and the classes its links form.

A document is the set of its distinct word shingles. Shingles are hashed into
groups, twice. By a fixed hash, ``AXES`` groups give the document's point: the
number of its shingles in each group. Two documents share at most the sum of the
smaller coordinates, so a pair, or two boxes of points, whose summed minima (of
upper corners) stay below the needed overlap can't link. By a second hash, groups
are so many that a linked pair has at least one group exactly equal: a pair with
similarity s has at most ``(a + b)(1 - s) / (1 + s)`` shingles on one side only, and
there is one group more than that, and some to spare. Only documents with an equal
group meet. As a linked pair shares several groups, each document leaves out its
most common ones, all but one of the number that must be shared.

Equal groups are the partitions of the index, and each has a tree. A tree is packed by
class, size and parts of about ``LEAF`` points; a node has a box: the upper corner of
its points, the range of their sizes and that of their classes. The trees are descended
level by level, all at once: a pair of nodes whose bounds allow a link is replaced by
the pairs of their children, and pairs of points in the last leaves are verified in
full. Equal sets are one point, and in trees of more than ``PIVOTED`` points these are first
verified against one of them, the pivot: those that became one class by verified links
are skipped by the descent. So no link between classes is lost, large groups of copies
aren't compared pair by pair, and no tree is one task's work.

Defined results: null text or text without words has an empty set (size 0) and
links with nothing; fewer words than a shingle make one shingle of all words; rows
of one id are one document with the links of all its sets; a null id is a
class of its own; an empty table gives an empty result; extra columns are ignored.
Shingles are compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import join_hot, join_spread, settle
from tallygrid.llm.components import components
from tallygrid.llm.words import MIX_A, Runs, filled, mixed, slices, split_words, text_of, word_hashes

#: A power of two. Too few axes make the minima of unrelated sets add up to most of their sizes.
AXES = 64
#: Points in a leaf, and children of an inner node below the levels of class and size.
LEAF, FAN = 128, 8
#: Rounds against one pivot before the descent, in trees of more than so many points. With fewer pivots
#: the descent gives more pairs to verify, whose sets take more disk.
ROUNDS, PIVOTED = 1, 1
#: Groups named beyond those that decide, by share, and groups beyond those named, so that few are empty.
SLACK, SPARE = 0.15, 1.1
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, index of each one's text), by text and hash."""
    lowered = [t.as_buffer().to_pybytes().translate(ASCII_LOWER) for t in filled(batch.column("text"))]
    ids, ends, distinct = split_words(pa.array(lowered, pa.large_binary()).cast(pa.large_string()))
    runs = Runs(word_hashes(distinct)[ids])
    n = np.diff(ends)
    many = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    own = np.repeat(np.arange(len(n)), many)
    start = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + ends[own]
    values = runs.hash(start, np.minimum(start + k, ends[1:][own]))
    by = np.lexsort((values, own))
    values, own = values[by], own[by]
    first = np.concatenate(([True], (values[1:] != values[:-1]) | (own[1:] != own[:-1]))) if len(own) else np.zeros(0, bool)
    return values[first], own[first]


def _apart(total: np.ndarray, percent: int) -> np.ndarray:
    """Shingles on one side only, at most, of a linked pair with ``total`` shingles in both sets."""
    return np.floor(total * (100 - percent) / (100 + percent) + 1e-9)


class Roles:
    """How documents of these sizes take part in the buckets: ``number`` of groups (0: not at all), how
    many groups may ``differ`` in a linked pair, how many are ``named``, and how many must be ``shared``."""

    def __init__(self, number: np.ndarray, differ: np.ndarray, percent: int):
        self.number, self.differ = number, differ
        self.named = _named(differ)
        self.shared = np.floor(SLACK * percent / 100 * differ + 1e-9).astype(np.int64) + 1


def _named(differ: np.ndarray) -> np.ndarray:
    return np.ceil((1 + SLACK) * (differ + 1) - 1e-9).astype(np.int64)


def roles(size: np.ndarray, percent: int) -> list[Roles]:
    """As the smaller of a pair, or one of like size, and as the larger one of a pair with fewer groups.

    The smaller of a pair sets the number of groups, from what may differ to its largest
    partner. Numbers are powers of two, so most documents have one for both roles. Of the
    groups that aren't empty in both, the first ``named`` ones of the smaller count differ in
    ``differ`` at most; the rest of them are equal, and both documents name those.
    """
    def widest(a: np.ndarray) -> np.ndarray:
        return _apart(a + np.floor(a * 100 / percent), percent)

    def number(a: np.ndarray) -> np.ndarray:
        apart = widest(a)
        groups = 2 ** np.ceil(np.log2(SPARE * _named(apart)) - 1e-9)
        return np.where(apart > 0, groups, 0).astype(np.int64)  # where nothing may differ only equal sets link

    own, below = number(size), number(np.ceil(size * percent / 100 - 1e-9))
    most = np.floor(np.floor(below / SPARE + 1e-9) / (1 + SLACK) + 1e-9) - 1
    return [Roles(own, widest(size), percent), Roles(np.where(below < own, below, 0), np.maximum(np.minimum(most, _apart(2 * size, percent)), 0), percent)]


def _summary(batch: pa.RecordBatch, k: int, percent: int) -> pa.RecordBatch:
    """(doc_id, n, h1, h2, groups, shared) of every text: set size, set hash, log2 of its number of groups, and needs by role."""
    values, own = shingle_sets(batch, k)
    n = np.bincount(own, minlength=batch.num_rows)
    ends = np.concatenate(([0], np.cumsum(n)))

    def summed(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        return sums[ends[1:]] - sums[ends[:-1]]

    content = mixed(values + MIX_A)
    h1, h2 = summed(content), summed(mixed(content + MIX_A))
    smaller, larger = roles(n, percent)
    groups = np.log2(np.maximum(smaller.number, 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(groups), pa.array(smaller.shared), pa.array(larger.shared)],
        names=["doc_id", "n", "h1", "h2", "groups", "shared", "shared_below"],
    )


def _keys(batch: pa.RecordBatch, k: int, percent: int) -> pa.RecordBatch:
    """(doc_id, key): a hash of the content of each group that a document names, the number's log2 in its last five bits.

    A document with too few groups that aren't empty names its empty ones too: they may be all that a pair shares.
    """
    values, own = shingle_sets(batch, k)
    rows = batch.num_rows
    n = np.bincount(own, minlength=rows)
    content = mixed(values + MIX_A)
    keys, owners = [], []
    for role in roles(n, percent):
        base = np.cumsum(role.number) - role.number
        inside = role.number[own] > 0
        at = base[own[inside]] + ((values[inside] >> np.uint64(20)).astype(np.int64) & (role.number[own[inside]] - 1))
        by = np.argsort(at, kind="stable")
        at, owner, x = at[by], own[inside][by], content[inside][by]
        cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        slot, owner, sums = at[cut], owner[cut], np.add.reduceat(x, cut) if len(cut) else x[:0]
        full = np.bincount(owner, minlength=rows)
        place = np.arange(len(slot)) - (np.cumsum(full) - full)[owner]
        first = place < role.named[owner]
        bare = np.flatnonzero((role.number > 0) & (full < role.named))
        empty = np.setdiff1d(np.concatenate([np.arange(base[i], base[i] + role.number[i]) for i in bare] or [slot[:0]]), slot)
        slot = np.concatenate((slot[first], empty))
        owner = np.concatenate((owner[first], np.searchsorted(base + role.number, empty, side="right") if len(empty) else empty))
        sums = np.concatenate((sums[first], np.zeros(len(empty), np.uint64)))
        groups = role.number[owner]
        key = mixed(sums + mixed((groups << 20 | slot - base[owner]).astype(np.uint64)))
        keys.append(key & ~np.uint64(31) | np.log2(np.maximum(groups, 1)).astype(np.uint64))
        owners.append(owner)
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(keys).view(np.int64))], names=["doc_id", "key"])


def _sets(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """(doc_id, point, shingles) of every text."""
    values, own = shingle_sets(batch, k)
    rows = batch.num_rows
    ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=rows)))).astype(np.int32)
    axis = (values >> np.uint64(64 - (AXES - 1).bit_length())).astype(np.int64)
    point = np.bincount(own * AXES + axis, minlength=rows * AXES).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * AXES), pa.array(point)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))],
        names=["doc_id", "point", "shingles"],
    )


def _mapped(texts: DataFrame, cut, columns: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (cut(x) for x in slices(batches))

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {columns}")


def _bound(a: str, b: str) -> Column:
    """Shingles that two points, or any two points of two boxes with these upper corners, share at most."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets link; the points' bound comes first."""
    pairs = settle(pairs, "join-pairs")
    left = sets.select(F.col("doc_id").alias("a"), F.col("point").alias("pa"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("point").alias("pb"), F.col("shingles").alias("sb"))
    both = join_spread(pairs, left, "a", "b").join(right, "b")
    total = F.size("sa") + F.size("sb")
    may = _bound("pa", "pb") * (100 + percent) >= total * percent
    shared = F.when(may, F.size(F.array_intersect("sa", "sb")))
    return both.filter(shared * (100 + percent) >= total * percent).select("a", "b")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Documents link when their ``k``-word shingle sets have at least ``percent``
    percent of their union in common; ``component_id`` is the smallest id that
    links lead to, the document's own included.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    summary = settle(_mapped(texts, lambda x: _summary(x, k, percent), "n bigint, h1 bigint, h2 bigint, groups int, shared bigint, shared_below bigint"), "join-summary")
    named = summary.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    alike = settle(named.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("root")), "join-sets")
    met = _memberships(_mapped(texts.filter(F.col("doc_id").isNotNull()), lambda x: _keys(x, k, percent), "key bigint"), named)

    # few enough ids are broadcast by their size on disk; else texts are shuffled
    wanted = settle(met.select(F.col("doc_id").alias("w")).distinct(), "join-wanted")
    chosen = texts.join(wanted, F.col("doc_id") == F.col("w"), "left_semi")
    sets = settle(_mapped(chosen, lambda x: _sets(x, k), "point array<int>, shingles array<bigint>"), "join-points")

    found = None
    for turn in range(ROUNDS):
        classed = met.withColumn("class", F.col("doc_id")) if found is None else _classed(met, found)
        found = _joined(found, verified(_against_pivots(classed, turn, percent), sets, percent))
    classed = met.withColumn("class", F.col("doc_id")) if found is None else _classed(met, found)
    found = _joined(found, verified(descend(classed, sets, percent), sets, percent))

    several = _several(summary)
    if several.take(1):
        found = _joined(found, _between_sets(several, named, alike))
    tops = _tops(alike, found)
    same = (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("n") == F.col("sn"))
    result = summary.select("doc_id", "n", "h1", "h2").join(tops, same & F.col("doc_id").isNotNull(), "left")
    # an id's empty sets go where its others do
    ids = several.join(found.select("node", F.col("root").alias("id_top")), F.col("s_id") == F.col("node")).select("s_id", "id_top")
    result = result.join(ids, F.col("doc_id") == F.col("s_id"), "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("id_top", "top", "doc_id").alias("component_id"))


def _several(summary: DataFrame) -> DataFrame:
    """(s_id) of the ids with several different sets."""
    one = F.struct("h1", "h2", "n")
    ids = summary.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("s_id")).agg(F.min(one).alias("x"), F.max(one).alias("y"))
    return settle(ids.filter(F.col("x") != F.col("y")).select("s_id"), "join-several-sets")


def _between_sets(several: DataFrame, named: DataFrame, alike: DataFrame) -> DataFrame:
    """(a, b): each id of several sets with the first document of every one of them."""
    sets = named.select("doc_id", "h1", "h2", "n").join(several, F.col("doc_id") == F.col("s_id"), "left_semi").distinct()
    roots = alike.select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("n").alias("sn"), "root")
    same = (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("n") == F.col("sn"))
    return sets.join(roots, same).select(F.col("doc_id").alias("a"), F.col("root").alias("b"))


def _memberships(keys: DataFrame, named: DataFrame) -> DataFrame:
    """(key, doc_id, n): the first document of every set in the buckets where different sets meet.

    A document that shares fewer groups, with whomever, than a linked pair must is left
    out, and each one's most common groups are: a linked pair shares so many that one of
    the rarer ones is among them.
    """
    keys = settle(keys, "join-keys")
    twice = settle(_crowded(keys), "join-live")
    met = join_hot(keys, twice, ("key",), "c").groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    own = named.select(F.col("doc_id").alias("o"), "h1", "h2", "n", "groups", "shared", "shared_below")
    met = met.join(own, F.col("doc_id") == F.col("o")).withColumn("keys", _enough(F.col("keys"))).filter(F.size("keys") > 0)
    met = met.select("doc_id", "h1", "h2", "n", "groups", "shared", "shared_below", F.explode("keys").alias("key"))
    attributes = [F.first(c).alias(c) for c in ("groups", "shared", "shared_below")]  # the same for one set
    heads = settle(met.groupBy("key", "h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"), *attributes), "join-heads")
    # copies of one set don't meet each other: once more, among different sets
    several = settle(_crowded(heads).withColumn("often", F.col("c")), "join-several")
    met = join_hot(heads, several, ("key",), "c").groupBy("doc_id", "n", "h1", "h2", "groups", "shared", "shared_below")
    met = met.agg(F.collect_list(F.struct("often", "key")).alias("keys"))
    return settle(met.select("doc_id", "n", F.explode(_rarest(F.col("keys"))).alias("key")), "join-met")


def _crowded(rows: DataFrame) -> DataFrame:
    """(key, c) of the keys that several rows have."""
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1)


def _by_role(keys: Column, key) -> list[tuple[Column, str]]:
    """The keys of each role, with the column that says how many must be shared in it."""
    own = lambda x: key(x).bitwiseAND(31) == F.col("groups")
    return [(F.filter(keys, own), "shared"), (F.filter(keys, lambda x: ~own(x)), "shared_below")]


def _enough(keys: Column) -> Column:
    """The keys of the roles in which a document shares enough groups."""
    none = F.array().cast("array<bigint>")
    return F.concat(*[F.when(F.size(x) >= F.col(need), x).otherwise(none) for x, need in _by_role(keys, lambda x: x)])


def _rarest(keys: Column) -> Column:
    """The keys of (often, key) but, in each role, the most common ones: one less than must be shared."""
    some = [F.slice(F.sort_array(x), 1, F.greatest(F.size(x) - F.col(need) + 1, F.lit(0)).cast("int")) for x, need in _by_role(keys, lambda x: x["key"])]
    return F.transform(F.concat(*some), lambda x: x["key"])


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes (node, root) with the new links added."""
    return components(links if found is None else links.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "join-links")


def _tops(alike: DataFrame, found: DataFrame) -> DataFrame:
    classes = found.select("node", F.col("root").alias("class_root"))
    return alike.join(classes, F.col("root") == F.col("node"), "left").select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("n").alias("sn"), F.coalesce("class_root", "root").alias("top"))


def _classed(met: DataFrame, found: DataFrame) -> DataFrame:
    """The memberships of buckets that still hold several classes, with the class."""
    classes = found.select(F.col("node"), F.col("root").alias("known"))
    classed = met.join(classes, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "n", F.coalesce("known", "doc_id").alias("class"))
    classed = settle(classed, "join-classed")
    spread = classed.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count(F.lit(1)).alias("many"))
    open_ = settle(spread.filter(F.col("x") < F.col("y")).select("key", "many"), "join-open-keys")
    return settle(join_hot(classed, open_, ("key",), "many"), "join-open")


def _against_pivots(classed: DataFrame, turn: int, percent: int) -> DataFrame:
    """(a, b): the pivot of each tree of more than PIVOTED points with the members of other classes, sizes permitting."""
    rank = F.struct("doc_id", "n", "class") if turn == 0 else F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("r"), "doc_id", "n", "class")
    pivots = classed.groupBy("key").agg(F.min(rank).alias("c"), F.count(F.lit(1)).alias("many"))
    pivots = pivots.filter(F.col("many") > PIVOTED).select("key", F.col("c.doc_id").alias("c_id"), F.col("c.n").alias("c_n"), F.col("c.class").alias("c_class"), "many")
    near = (F.least("n", "c_n") * 100 >= F.greatest("n", "c_n") * percent) & (F.col("class") != F.col("c_class"))
    pairs = join_hot(classed, settle(pivots, "join-pivots"), ("key",), "many").filter(near)
    return pairs.select(F.least("doc_id", "c_id").alias("a"), F.greatest("doc_id", "c_id").alias("b")).distinct()


#: What a node is known by, from the root's children on; parts have levels of their own.
PATH = ("own", "height", "part")
BOX = ("lo", "hi", "n_lo", "n_hi", "corner")


def _corner() -> Column:
    """The largest of each coordinate of ``corners``."""
    return F.aggregate("corners", F.array_repeat(F.lit(0), AXES), lambda s, c: F.zip_with(s, c, lambda x, y: F.greatest(x, y)))


def _boxed(rows: DataFrame, by: list[str], corner: str, *more: Column) -> DataFrame:
    """The nodes that ``rows`` with boxes (or points) fall into, with the box around them."""
    nodes = rows.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("n_lo").alias("n_lo"), F.max("n_hi").alias("n_hi"), F.collect_list(corner).alias("corners"), *more)
    return nodes.withColumn("corner", _corner()).drop("corners")


def packed(classed: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """The levels of all buckets' trees, from the roots' children to the leaves, which have ``members``.

    Each has (key, node, parent) and the box. Large classes stand apart and small ones
    together, then points of like size, then parts of about LEAF points by a hash.
    """
    # an id of several sets stands at the corner of their points, which bounds each of them
    points = sets.groupBy(F.col("doc_id").alias("p_id")).agg(F.collect_list("point").alias("corners")).select("p_id", _corner().alias("point"))
    sizes = settle(classed.groupBy("key", "class").agg(F.count(F.lit(1)).alias("many")), "join-sizes")
    few = F.sum(F.when(F.col("many") < LEAF, F.col("many")).otherwise(0))
    small = settle(sizes.groupBy("key").agg(few.alias("few"), F.sum("many").alias("all"), F.max("many").alias("most")), "join-small")
    large = sizes.filter(F.col("many") >= LEAF).withColumn("weight", F.col("many"))
    rows = join_hot(classed, small.select("key", "few", "all"), ("key",), "all")
    big = join_hot(rows, settle(large, "join-large"), ("key", "class"), "weight")
    rest = rows.join(large.select("key", "class"), ["key", "class"], "left_anti").withColumn("many", F.lit(None).cast("long"))
    sized = big.unionByName(rest).join(points, F.col("doc_id") == F.col("p_id"))

    own = F.when(F.col("many").isNotNull(), F.col("class"))
    parts = F.greatest(F.ceil(F.coalesce("many", "few") / LEAF), F.lit(1))
    part = F.pmod(F.when(F.col("many").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("class")), parts)
    height = F.floor(F.log("n") / float(np.log(100 / percent)))
    placed = sized.select("key", own.alias("own"), height.alias("height"), part.alias("part"), "doc_id", "n", "class", "point")
    placed = placed.select("*", F.col("class").alias("lo"), F.col("class").alias("hi"), F.col("n").alias("n_lo"), F.col("n").alias("n_hi"))
    leaves = settle(_boxed(placed, ["key", *PATH], "point", F.collect_list(F.struct("doc_id", "n", "class", "point")).alias("members")), "join-leaves")

    levels, below = [leaves], leaves.drop("members")
    most = (small.agg(F.max(F.greatest("few", "most"))).first()[0] or 0) / LEAF
    while most > FAN:
        most /= FAN
        below = _boxed(below.withColumn("part", F.floor(F.col("part") / FAN)), ["key", *PATH], "corner")
        levels.append(below)
    for path in (PATH[:2], PATH[:1]):
        below = _boxed(below, ["key", *path], "corner")
        levels.append(below)
    levels = levels[::-1]

    def name(depth: int, level: int) -> Column:
        """The number of a node's ancestor (or of itself) on a level, from a node on the level ``depth``."""
        columns = [F.col(c) for c in PATH[: min(level + 1, 3)]]
        if level >= 2:
            columns[2] = F.floor(columns[2] / FAN ** (depth - level))
        return F.xxhash64(F.lit(level), *columns)

    return [x.select("key", name(i, i).alias("node"), (name(i, i - 1) if i else F.lit(0)).alias("parent"), *BOX, *(["members"] if i == len(levels) - 1 else [])) for i, x in enumerate(levels)]


def descend(classed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different classes in one bucket that neither boxes nor points rule out."""
    levels = packed(classed, sets, percent)
    sides = lambda level, s, more=(): level.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "parent", *BOX, *more)])
    one_class = (F.col("l_lo") == F.col("l_hi")) & (F.col("r_lo") == F.col("r_hi")) & (F.col("l_lo") == F.col("r_lo"))
    reach = (F.col("l_n_hi") * 100 >= F.col("r_n_lo") * percent) & (F.col("r_n_hi") * 100 >= F.col("l_n_lo") * percent)
    bound = _bound("l_corner", "r_corner") * (100 + percent) >= (F.col("l_n_lo") + F.col("r_n_lo")) * percent
    open_ = (F.col("l_node") <= F.col("r_node")) & ~one_class & reach & bound
    # the roots' children of a bucket: its large classes, and all small ones together
    pairs = sides(levels[0], "l").join(sides(levels[0], "r"), "key").filter(open_).select("key", "l_node", "r_node")
    for level in levels[1:]:
        last = ("members",) if "members" in level.columns else ()
        above = settle(pairs.select("key", F.col("l_node").alias("l_parent"), F.col("r_node").alias("r_parent")), "join-nodes")
        left, right = sides(level, "l", last), sides(level, "r", last)
        # a node and itself: each pair of children once; two nodes: all pairs of children, by number
        both = above.join(left, ["key", "l_parent"]).join(right, ["key", "r_parent"])
        within = F.when(F.col("l_parent") == F.col("r_parent"), F.col("l_node") <= F.col("r_node")).otherwise(True)
        both = both.filter(within & ~one_class & reach & bound)
        if not last:
            pairs = both.select("key", "l_node", "r_node")

    def may(p, q):
        near = (F.least(p["n"], q["n"]) * 100 >= F.greatest(p["n"], q["n"]) * percent) & (p["class"] != q["class"])
        return near & (_bound(p["point"], q["point"]) * (100 + percent) >= (p["n"] + q["n"]) * percent)

    def partners(p):
        return F.transform(F.filter("r_members", lambda q: may(p, q)), lambda q: F.struct(F.least(p["doc_id"], q["doc_id"]).alias("a"), F.greatest(p["doc_id"], q["doc_id"]).alias("b")))

    found = both.select(F.explode(F.flatten(F.transform("l_members", partners))).alias("pair"))
    return found.select("pair.a", "pair.b").distinct()


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') as g
      from (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 90 * (x.n + y.n - c)),
r(doc, other) as (select a, b from l union select r.doc, l.b from r join l on l.a = r.other)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.top, d.doc_id)) as component_id
from d left join n using (doc_id) left join (select doc, min(other) as top from r group by doc) m on m.doc = d.doc_id
"""
