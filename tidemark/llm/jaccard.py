"""Similarity join on sets of word shingles, by signature trees.

Equal sets are one leaf.  Every leaf has keys (see ``shingles``), and two leaves
that link have one in common; a key's smallest leaf is its hub, and the leaves
that share a key with one hub are a tree, so two that link are in one tree.  A
traversal of pairs of nodes (see ``signature_trees``) tells, in the task that
holds the trees, which leaves their bitmaps allow to link; it hands on one link
of each leaf at most, to the component that these form.

Then sets move, each once: a component of leaves that may link is searched in
one task, again by a signature tree, and pairs are verified there on the sets
themselves; pairs of one verified component aren't looked at again, and one
verified link of each leaf leaves the task.  A component of more elements than
``BLOCK`` is searched tree by tree, a tree of more in blocks, all of which have
the hub; then pairs of blocks, dealt by component, are searched for the links
between different components that are left.  No step has a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import release_memory, texts_in_chunks
from tidemark.llm.components import connected
from tidemark.llm.scratch import discard, tables, written
from tidemark.llm.shingles import LONGS, SizeClasses, segment_keys, shingle_sets, signatures
from tidemark.llm.signature_trees import Forest, grown, needed, traverse

#: Elements of sets that are searched as one; a larger tree is cut into blocks.
BLOCK = 1 << 20
#: Leaves of a tree whose bitmaps are searched as one; those of a larger one all may link.
TREE_ROWS = 20_000
#: Elements, and bitmaps, that a task holds, about.
GROUP, GROUP_ROWS = 2 << 20, 20_000
#: Rows of a few longs that may be broadcast: some ten MB. More are joined by a shuffle.
BROADCAST_ROWS = 300_000


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _text_id(text: str) -> Column:
    """16 bytes that tell texts apart, also those that share a key; a null text is as an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _set_ids(hashes: np.ndarray, starts: np.ndarray) -> pa.Array:
    raw, at = memoryview(np.ascontiguousarray(hashes)).cast("B"), (starts * 8).tolist()
    return pa.array([xxhash.xxh3_128_digest(raw[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:])], pa.binary())


def keyed_sets(docs: DataFrame, size: int, classes: SizeClasses) -> DataFrame:
    """(key, text_id, n, set_id, low, signature, keys) of ``docs`` (key, text_id, text); a set without elements has no id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in_chunks(batches):
            hashes, starts = shingle_sets(texts, size)
            keys, at = segment_keys(hashes, starts, classes)
            n, some = np.diff(starts), np.diff(starts) > 0
            low = np.zeros(len(n), np.uint64)
            low[some] = hashes[starts[:-1][some]]
            grid = signatures(hashes, starts)
            columns = [part["key"], part["text_id"], pa.array(n, pa.int64()), _set_ids(hashes, starts), pa.array(low.view(np.int64), pa.int64()), _lists(grid.ravel(), np.arange(len(n) + 1) * LONGS), _lists(keys, at)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "text_id", "n", "set_id", "low", "signature", "keys"])

    return docs.mapInArrow(make, f"key {docs.schema['key'].dataType.simpleString()}, text_id binary, n bigint, set_id binary, low bigint, signature array<bigint>, keys array<bigint>")


def leaves(docs: DataFrame, size: int) -> DataFrame:
    """(node, units, hashes) of ``docs`` (node, units, set_id, text): rows whose text has another set are left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in_chunks(batches):
            hashes, starts = shingle_sets(texts, size)
            same = pa.compute.equal(part["set_id"], _set_ids(hashes, starts))
            yield pa.RecordBatch.from_arrays([part["node"], part["units"], _lists(hashes, starts)], names=["node", "units", "hashes"]).filter(same)

    return docs.mapInArrow(make, f"node bigint, units {docs.schema['units'].dataType.simpleString()}, hashes array<bigint>")


def _trees(unit: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A tree's number for each row, sorted by unit and side, and the pairs of trees: a unit's two, or its one with itself."""
    new = np.append(True, (unit[1:] != unit[:-1]) | (side[1:] != side[:-1]))[: len(unit)]
    tree, unit = np.cumsum(new) - 1, unit[new]
    first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])[: len(unit)])
    return tree, np.stack([first, np.append(first[1:], len(unit)) - 1], 1)


def _links(node: np.ndarray, root: np.ndarray) -> pa.Table:
    far = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": node[far], "b": node[root[far]]})


def may_link(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): what ties the leaves of each tree together that may link; of ``rows`` (lo, node, n, low, signature)."""

    def search(table: pa.Table) -> pa.Table:
        release_memory()
        lo, node, n, low = (table[c].to_numpy() for c in ("lo", "node", "n", "low"))
        order = np.lexsort((low, lo))
        bits = table["signature"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LONGS)[order]
        tree, pairs = _trees(lo[order], np.zeros(len(lo), np.int8))
        nodes, who = np.unique(node[order], return_inverse=True)
        forest = Forest(len(nodes))
        traverse(grown(tree, n[order], bits), pairs, percent, who, forest, lambda p, q: forest.join(who[p], who[q]))
        return _links(nodes, forest.root)

    parts = max(1, -(-rows.count() // GROUP_ROWS))
    return rows.withColumn("part", F.pmod(F.xxhash64("lo"), F.lit(parts))).groupBy("part").applyInArrow(search, "a bigint, b bigint")


def links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): what ties the leaves of each unit together that link; of ``rows`` (part, unit, side, node, component, hashes).

    Of a unit with two sides, leaves of one side aren't compared with each
    other, nor are those of one component.
    """

    def search(table: pa.Table) -> pa.Table:
        release_memory()
        unit, side, node, component = (table[c].to_numpy() for c in ("unit", "side", "node", "component"))
        hashes = table["hashes"].combine_chunks()
        starts, values = hashes.offsets.to_numpy(), hashes.values.to_numpy()
        low = values[starts[:-1]].view(np.uint64)  # no set is empty
        near = np.full(len(low), np.iinfo(np.uint64).max)
        _, team = np.unique(component, return_inverse=True)
        np.minimum.at(near, team, low)
        order = np.lexsort((low, team, near[team], side, unit))
        n = np.diff(starts)[order]
        begin = starts[:-1][order].astype(np.int64)
        _, dense = np.unique(values, return_inverse=True)
        at = np.append(0, np.cumsum(n))
        element = dense[np.repeat(begin - at[:-1], n) + np.arange(at[-1])].astype(np.int32)
        bits = signatures(values[np.repeat(begin - at[:-1], n) + np.arange(at[-1])].view(np.uint64), at)
        tree, pairs = _trees(unit[order], side[order])
        nodes, who = np.unique(node[order], return_inverse=True)
        forest, mark = Forest(len(nodes)), np.zeros(dense.max(initial=0) + 1, bool)
        known, place = np.unique(component[order], return_index=True)  # a node's component is the same in every row
        forest.join(who, who[place][np.searchsorted(known, component[order])])

        def meet(p: np.ndarray, q: np.ndarray) -> None:
            by = np.argsort(p, kind="stable")
            p, q = p[by], q[by]
            head = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            for i, j in zip(head.tolist(), np.append(head[1:], len(p)).tolist()):
                x = p[i]
                y = q[i:j]
                y = y[forest.root[who[y]] != forest.root[who[x]]]
                if not len(y):
                    continue
                mine = element[at[x] : at[x + 1]]
                mark[mine] = True
                size = n[y]
                ends = np.cumsum(size)
                both = np.add.reduceat(mark[element[np.repeat(at[y] - ends + size, size) + np.arange(ends[-1])]], ends - size, dtype=np.int64)
                mark[mine] = False
                y = y[(100 + percent) * both >= needed(n[x], size, percent)]
                if len(y):
                    forest.join(np.full(len(y), who[x]), who[y])

        traverse(grown(tree, n, bits), pairs, percent, who, forest, meet)
        return _links(nodes, forest.root)

    return rows.groupBy("part").applyInArrow(search, "a bigint, b bigint")


def _with_sets(placed: DataFrame, named: DataFrame, plain: DataFrame, size: int) -> DataFrame:
    """Rows of :func:`links` for ``placed`` (node, unit, side, component, size): each text is read once, by its key and text."""
    parts = max(1, -(-(placed.agg(F.sum("size")).first()[0] or 0) // GROUP))
    part = F.pmod(F.xxhash64("unit"), F.lit(parts))
    units = placed.groupBy("node").agg(F.collect_list(F.struct(part.alias("part"), "unit", "side", "component")).alias("units"))
    wanted = _bounded(written(units.join(named, "node"), "wanted"))

    def joined(rows: DataFrame) -> DataFrame:
        return rows.join(wanted, rows["key"].eqNullSafe(wanted["key"]) & (rows["text_id"] == wanted["text_id"]))

    texts = joined(plain).select("node", "units", wanted["set_id"], "text")
    if joined(named.select("key", "text_id")).count() > wanted.count():  # rows that share key and text
        texts = texts.dropDuplicates(["node"])
    return leaves(texts, size).select("node", F.explode("units").alias("u"), "hashes").select("u.*", "node", "hashes")


def _units(members: DataFrame, groups: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where each leaf is searched first, (node, unit, side, component, size), and the leaves (lo, node, size) of trees that are cut into blocks."""
    sized = written(groups.join(sizes, "node"), "sized")  # node, label, size
    total = sized.groupBy("label").agg(F.sum("size").alias("total"))
    large = written(total.filter(F.col("total") > BLOCK).select("label"), "large")
    whole = sized.join(_bounded(large), "label", "left_anti").select("node", F.xxhash64("label").alias("unit"), "size")
    own = members.join(sized.join(_bounded(large), "label", "left_semi").select("node", "size"), "node").select("lo", "node", "size")
    trees = own.groupBy("lo").agg(F.ceil(F.sum("size") / BLOCK).cast("long").alias("blocks"))
    dealt = written(own.join(trees, "lo"), "dealt")
    block = F.when(F.col("node") == F.col("lo"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks"))))
    cut = dealt.select("node", "lo", F.explode(block).alias("block"), "size").select("node", F.xxhash64("lo", "block").alias("unit"), "size")
    placed = whole.unionByName(cut).select("node", "unit", F.lit(0).cast("tinyint").alias("side"), F.col("node").alias("component"), "size")
    return written(placed, "placed"), dealt.filter("blocks > 1").select("lo", "node", "size")


def _between(dealt: DataFrame, labels: DataFrame) -> DataFrame:
    """Where leaves of cut trees are searched again: pairs of blocks that hold different components.

    A component with many elements in a tree has blocks of its own.
    """
    of = dealt.join(labels, "node", "left").select("lo", "node", "size", F.coalesce("label", "node").alias("component"))
    mixed = of.groupBy("lo").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.sum("size").alias("held")).filter("c0 < c1").select("lo", "held")
    of = written(of.join(mixed, "lo"), "open")
    own = of.groupBy("lo", "component").agg(F.sum("size").alias("own")).filter(F.col("own") > BLOCK / 8)
    alone = F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / BLOCK)))
    mingled = F.pmod(F.xxhash64("component"), F.ceil(F.col("held") / BLOCK)).cast("long")
    rows = written(of.join(own, ["lo", "component"], "left").withColumn("block", F.when(F.col("own").isNull(), mingled).otherwise(alone)), "rows")
    blocks = rows.groupBy("lo", "block").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    a, b = (blocks.select("lo", *[F.col(c).alias(f"{c}_{side}") for c in ("block", "c0", "c1")]) for side in "ab")
    one = (F.col("c0_a") == F.col("c1_a")) & (F.col("c0_b") == F.col("c1_b")) & (F.col("c0_a") == F.col("c0_b"))
    pairs = a.join(b, "lo").filter((F.col("block_a") <= F.col("block_b")) & ~one).select("lo", "block_a", "block_b")
    ends = pairs.withColumn("block", F.explode(F.array_distinct(F.array("block_a", "block_b"))))
    side = (F.col("block") != F.col("block_a")).cast("tinyint").alias("side")
    return written(rows.join(ends, ["lo", "block"]).select("node", F.xxhash64("lo", "block_a", "block_b").alias("unit"), side, "component", "size"), "between")


def _grouped(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(key, text_id, n, label, component) for each row of ``docs``: label names its component, component is the smallest key there; both are null without shingles."""
    classes = SizeClasses.of(percent)
    plain = docs.select(F.col(key).alias("key"), _text_id(text).alias("text_id"), F.col(text).alias("text"))
    since = tables()
    keyed = written(keyed_sets(plain, size, classes).withColumn("row", F.monotonically_increasing_id()), "keyed", free=True)
    signed = written(keyed.drop("keys", "low", "signature"), "signed")
    some = keyed.filter("n > 0")
    sets = written(some.groupBy("set_id").agg(F.min("row").alias("node"), F.min("key").alias("low"), F.count(F.lit(1)).alias("copies")), "sets")
    copied = _bounded(sets.filter("copies > 1").select("set_id", "node"))
    first = some.join(copied, "set_id", "left").filter(F.col("node").isNull() | (F.col("node") == F.col("row"))).drop("node")
    keys = first.select(F.explode("keys").alias("seg"), F.col("row").alias("node"))
    trees = written(keys.groupBy("seg").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("held")).filter("lo < hi"), "trees", free=True)
    large = keys.join(_bounded(trees.filter("held > 2").select("seg", "lo")), "seg").select("lo", "node")
    pairs = trees.filter("held = 2").select("lo", F.col("hi").alias("node"))
    tied = large.unionByName(pairs).filter("lo < node").distinct()
    members = written(tied.select("lo", F.explode(F.array("lo", "node")).alias("node")).distinct(), "members", free=True)
    wide = _bounded(written(members.groupBy("lo").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > TREE_ROWS).select("lo"), "wide"))
    signs = first.select(F.col("row").alias("node"), "n", F.col("low"), "signature")
    near = may_link(written(members.join(wide, "lo", "left_anti").join(signs, "node"), "signs"), percent)
    near = near.unionByName(members.join(wide, "lo", "left_semi").filter("lo < node").select(F.col("node").alias("a"), F.col("lo").alias("b")))
    groups = written(connected(near), "groups", free=True)
    discard(docs.sparkSession, since, ("signed", "sets", "members", "groups"))
    named = signed.select(F.col("row").alias("node"), "key", "text_id", "set_id")
    sizes = signed.select(F.col("row").alias("node"), F.col("n").alias("size"))
    placed, dealt = _units(members, groups, sizes)
    star = written(links(_with_sets(placed, named, plain, size), percent), "star", free=True)
    labels = connected(star)
    if not dealt.isEmpty():
        rest = written(links(_with_sets(_between(dealt, labels), named, plain, size), percent), "rest", free=True)
        labels = connected(star.unionByName(rest))
    lows = labels.join(sets.select("node", "low"), "node").select("node", "label", "low")
    lowest = written(lows.join(lows.groupBy("label").agg(F.min("low").alias("component")), "label").select("node", "label", "component"), "lowest", free=True)
    discard(docs.sparkSession, since, ("signed", "sets", "lowest"))
    found = sets.join(lowest, "node", "left").select("set_id", F.coalesce("label", "node").alias("label"), F.coalesce("component", "low").alias("component"))
    return signed.select("key", "text_id", "n", "set_id").join(found, "set_id", "left").drop("set_id")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id.

    Two texts link when 100 * (shared shingles) >= ``percent`` * (shingles of
    either); component_id is the smallest key reachable by links, itself
    included.  Words are runs of bytes other than white space of ASCII, A-Z
    lower-cased; a text of fewer than ``size`` words is one shingle.  A null,
    empty or blank text has no shingles and links with nothing.  Equal texts
    link; rows that share a key and a text are the same; null keys count only
    where a component has no other.  An empty table gives an empty result;
    other columns are not read.
    """
    out = _grouped(docs, key, text, size, percent)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id"))


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of :func:`jaccard_components`, and the rows that link with nothing.

    The row of the smallest key stays, a null key only where there is no other;
    of several texts of that key the one with the smallest hash.  Rows are told
    apart by key and text; of rows that share both, one stays.
    """
    since = tables()
    rows = written(_grouped(docs, key, text, size, percent).filter("n > 0").drop("n"), "rows", free=True)
    first = F.col("key").eqNullSafe(F.col("component"))
    tied = rows.filter(first).groupBy("label").agg(F.min("text_id").alias("stays"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("label", "stays")
    tied = written(rows.filter(first).join(_bounded(written(tied, "tied")), "label").select("key", "text_id", "stays"), "ties")
    later = rows.filter(~first).select("key", "text_id").unionByName(tied.filter("text_id != stays").select("key", "text_id"))
    later = written(later.select(F.col("key").alias("_key"), F.col("text_id").alias("_id")).distinct(), "later", free=True)
    same = tied.filter("text_id = stays").groupBy(F.col("key").alias("_key"), F.col("text_id").alias("_id")).agg(F.count(F.lit(1)).alias("held")).filter("held > 1").drop("held")
    same = written(same, "same")
    discard(docs.sparkSession, since, ("later", "same"))

    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("key"), _text_id(text).alias("text_id"))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, F.col("key").eqNullSafe(F.col("_key")) & (F.col("text_id") == F.col("_id")), how)

    kept = joined(held, later, "left_anti")
    if not same.isEmpty():
        kept = joined(kept, same, "left_anti").unionByName(joined(kept, same, "left_semi").dropDuplicates(["key", "text_id"]))
    return kept.select("row.*")
