"""Trie of conversation prefixes with subtree sums over heavy paths.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Turns are dealt by
ranges of (conversation, turn), so that a conversation of any length spreads over tasks, and numbered by counts a range.
A prefix is named by the exclusive or of digests of its turns with their places, in two lanes of 64 bits: a running
value, whose parent's name is the same without the last turn. Nodes are a group by name.

Subtree sums go by heavy-path decomposition. The heavy child of a node is the one with most members, smallest member
first; every other child is light and has half of its parent's members at most, so a conversation passes at most
log2(conversations) light nodes. They are gathered as an array a conversation, which tells each node its path and its
parent path. Paths add themselves up, the deepest ones first, each round handing totals to the nodes they hang from;
then every path is an array (cut into blocks of ``BLOCK`` nodes) along which sums run backwards.

Digests of the members that end in a node are made of sorted stretches of ids, joined where they lie and hashed as a
stream, so that no task holds the ids of one node.

Defined cases: rows without a conversation id take no part; null roles and texts are empty; null turns come first; rows
of equal turn are ordered by a digest of role and text, equal rows count as often as they occur; texts of any length
take part by digest and length; an empty table has no nodes, not even a root; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.runtime import drop_written, written

#: Nodes of a path in one array; ids in one stretch of a node's members.
BLOCK, STRETCH = 4_096, 8_192
#: Conversations of one hundred share an opening of up to five turns.
GROUP, MOST_BORROWED = 100, 5

NODE = ["hi", "lo"]
PARENT = ["up_hi", "up_lo"]
PATH = ["path_hi", "path_lo"]
Opening = Callable[[Column], tuple[Column, Column]]


def shared_opening(conv: Column) -> tuple[Column, Column]:
    """The conversation that lends its first turns, and how many it lends in place of as many own ones."""
    lent = F.crc32(conv.cast("string").cast("binary")) % (MOST_BORROWED + 1)
    return conv - conv % GROUP, lent.cast("int")


def own_opening(conv: Column) -> tuple[Column, Column]:
    """Conversations as they are."""
    return conv, F.lit(0)


def _ordered(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Slim rows in ranges ``part``: what a turn says leaves as a digest and a length."""
    said = F.coalesce(F.col(text), F.lit(""))
    spoke = F.coalesce(F.col(role), F.lit(""))
    slim = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.unhex(F.sha2(F.concat(F.char_length(spoke).cast("string"), F.lit(":"), spoke, said), 256)).alias("said"),
        F.char_length(said).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    dealt = slim.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "said", "row")
    return written(dealt.withColumn("part", F.spark_partition_id()), "trie-turns")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("said"), F.col("row")]


def _stretches(turns: DataFrame, opening: Opening) -> DataFrame:
    """A row per conversation and range: turns before it, and of the conversation its lent turns (``borrowed``)."""
    conv = F.col("conv")
    lender, lent = opening(conv)
    first = Window.partitionBy("conv").orderBy(*_order())
    heads = (
        turns.where(lender == conv)
        .withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= MOST_BORROWED)
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct("place", "said", "chars"))).alias("head"))
        .withColumnRenamed("conv", "lender")
    )
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), lender.alias("lender"), lent.alias("lent"))
    borrowed = F.when(F.col("lent") > 0, F.slice("head", 1, F.greatest("lent", F.lit(1))))
    return written(placed.join(heads, "lender", "left").select("conv", "part", "before", "lent", borrowed.alias("borrowed")), "trie-stretches")


def _lanes(place: Column, said: Column) -> list[Column]:
    digest = F.sha2(F.concat(place.cast("string"), F.lit(":"), F.hex(said)), 256)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]


def _rebuilt(turns: DataFrame, stretches: DataFrame) -> DataFrame:
    """``conv, part, depth, a, b, chars``: turns at their places, lent ones in a part before all others."""
    own = turns.join(stretches, ["conv", "part"])
    place = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*_order())) + F.col("before")
    size = F.coalesce(F.size("borrowed"), F.lit(0))
    own = own.select("conv", "part", place.alias("place"), "lent", size.alias("size"), "said", "chars").where("place > lent")
    own = own.select("conv", "part", (F.col("place") - F.col("lent") + F.col("size")).alias("depth"), "said", "chars")
    lent = stretches.where("before = 0").select("conv", F.lit(-1).alias("part"), F.explode("borrowed").alias("t"))
    both = own.unionByName(lent.select("conv", "part", F.col("t.place").cast("long").alias("depth"), "t.said", "t.chars"))
    a, b = _lanes(F.col("depth"), F.col("said"))
    return written(both.select("conv", "part", "depth", a.alias("a"), b.alias("b"), "chars"), "trie-rebuilt")


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """``conv, depth, chars``, the prefix's name ``hi, lo`` and its parent's ``up_hi, up_lo``."""
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rebuilt.groupBy("conv", "part").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = before.select("conv", "part", *(F.coalesce(F.expr(f"bit_xor({c})").over(earlier), F.lit(0)).alias(f"before_{c}") for c in "ab"))
    running = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = rebuilt.join(before, ["conv", "part"]).select(
        "conv", "depth", "chars", "a", "b", *(F.bit_xor(c).over(running).bitwiseXOR(F.col(f"before_{c}")).alias(n) for c, n in zip("ab", NODE, strict=True))
    )
    return written(named.select("conv", "depth", "chars", *NODE, F.col("hi").bitwiseXOR(F.col("a")).alias("up_hi"), F.col("lo").bitwiseXOR(F.col("b")).alias("up_lo")), "trie-prefixes")


def _nodes(prefixes: DataFrame, stretches: DataFrame) -> DataFrame:
    """Nodes with their members counted; the root stands for all conversations, those without turns too."""
    below = prefixes.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.any_value(c).alias(c) for c in ("depth", "chars", *PARENT))
    )
    root = stretches.where("before = 0").agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(zero.alias("hi"), zero.alias("lo"), "conv_id", "n_convs", zero.alias("depth"), zero.alias("chars"), none.alias("up_hi"), none.alias("up_lo"))
    return written(below.unionByName(root), "trie-nodes")


def _tree(nodes: DataFrame) -> DataFrame:
    """Nodes with their children counted, their parent's smallest member, and whether they begin a path (``light``)."""
    heavy = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("order"), *NODE)).alias("heavy")
    children = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"), heavy)
    children = children.withColumnsRenamed(dict(zip(PARENT, NODE, strict=True)))
    whole = written(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    parents = whole.where("n_children > 0").select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("chosen"))
    light = F.col("chosen").isNull() | (F.col("chosen.hi") != F.col("hi")) | (F.col("chosen.lo") != F.col("lo"))
    return written(whole.drop("heavy").join(parents, PARENT, "left").withColumn("light", light).drop("chosen"), "trie-tree")


def _on_paths(tree: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Nodes with their path, named by its first node, the light nodes above it (``level``) and the path it hangs from."""
    begun = tree.where("light AND depth > 0").select(*NODE)
    passed = prefixes.select("conv", "depth", *NODE).join(begun, NODE).groupBy("conv")
    lights = passed.agg(F.array_sort(F.collect_list(F.struct("depth", *NODE))).alias("lights"))  # log2(conversations) at most
    known = tree.join(lights.withColumnRenamed("conv", "conv_id"), "conv_id", "left")
    above = F.filter(F.coalesce("lights", F.array().cast("array<struct<depth:bigint,hi:bigint,lo:bigint>>")), lambda x: x["depth"] <= F.col("depth"))
    known = known.withColumn("lights", above).withColumn("level", F.size("lights"))
    head = lambda back, c: F.coalesce(F.try_element_at("lights", F.col("level") - back).getField(c), F.lit(0))
    at = lambda back, c: F.when(F.col("level") > back, head(back, c)).otherwise(F.lit(0).cast("long"))
    return written(
        known.select("*", *(at(0, c).alias(f"path_{c}") for c in NODE), *(at(1, c).alias(f"from_{c}") for c in NODE), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
        .drop("lights"),
        "trie-on-paths",
    )


def _attached(nodes: DataFrame) -> DataFrame:
    """``hi, lo, more_leaves, more_saved``: what the light paths hanging from a node hold, made level by level."""
    head = F.max(F.when(F.col("light"), F.struct(*PARENT, "from_hi", "from_lo"))).alias("head")
    paths = written(nodes.groupBy(*PATH, "level").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), head), "trie-paths")
    paths = paths.select(*PATH, "level", "leaves", "saved", *(F.col(f"head.{c}").alias(c) for c in (*PARENT, "from_hi", "from_lo")))
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done: list[DataFrame] = []
    for level in range(deepest, 0, -1):
        now = paths.where(F.col("level") == level).drop("level")
        if done:
            carried = done[-1].groupBy(F.col("from_hi").alias("path_hi"), F.col("from_lo").alias("path_lo")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            now = now.join(carried, PATH, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s")
        done.append(written(now, f"trie-level-{level}"))
    hung = reduce(DataFrame.unionByName, done) if done else paths.drop("level").where("false")
    return hung.groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


KEPT = ["hi", "lo", "conv_id", "parent_conv_id", "n_convs", "n_children"]
SUMMED_DDL = "depth long, " + ", ".join(f"{c} long" for c in KEPT) + ", n_leaves long, saved_tokens long"


def _suffix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums along each array from its end, over what later blocks of the same path hold."""
    for batch in batches:
        arrays = batch.column("path")
        ends = np.asarray(arrays.offsets)
        flat = arrays.flatten()  # of this batch's rows alone, whereas offsets may begin later
        starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
        out = {c: flat.field(c) for c in ("depth", *KEPT)}
        for name, c in (("n_leaves", "leaves"), ("saved_tokens", "saved")):
            total = np.concatenate([[0], np.cumsum(flat.field(c).to_numpy(zero_copy_only=False))])
            until = total[ends] + batch.column(f"later_{c}").to_numpy(zero_copy_only=False)
            out[name] = pa.array(np.repeat(until, ends - starts) - total[:-1], pa.int64())
        yield pa.RecordBatch.from_pydict(out)


def _summed(nodes: DataFrame) -> DataFrame:
    """Every node with its subtree's sums: paths as arrays by depth, in blocks, the later blocks' totals beside each."""
    whole = nodes.join(_attached(nodes), NODE, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")})
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    whole = written(whole.select(*PATH, block, "depth", *KEPT, "leaves", "saved"), "trie-values")
    totals = whole.groupBy(*PATH, "block").agg(*(F.sum(c).alias(c) for c in ("leaves", "saved")))
    later = Window.partitionBy(*PATH).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = totals.select(*PATH, "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("leaves", "saved")))
    arrays = whole.groupBy(*PATH, "block").agg(F.array_sort(F.collect_list(F.struct("depth", *KEPT, "leaves", "saved"))).alias("path"))
    return arrays.join(after, [*PATH, "block"]).select("path", "later_leaves", "later_saved").mapInArrow(_suffix_sums, SUMMED_DDL)


def _stretch_ids(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node, comma-joined, up to ``size`` of them in a row."""
    for batch in batches:
        hi, lo, conv = (batch.column(c).to_numpy() for c in ("hi", "lo", "conv"))
        new = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])][: len(hi)])
        cuts = np.unique(np.concatenate([new, np.arange(0, len(hi), size)])).astype(int)
        texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], len(hi)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(hi[cuts]), pa.array(lo[cuts]), pa.array(conv[cuts]), pa.array(texts, pa.string())], names=["hi", "lo", "first", "ids"])


def _hash_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node over its stretches, which come one after the other."""
    at, digest = None, None
    ready: list[tuple[int, int, str]] = []
    for batch in batches:
        for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
            if (hi, lo) == at:
                digest.update(b",")
            else:
                if at is not None:
                    ready.append((*at, digest.hexdigest()))
                at, digest = (hi, lo), hashlib.sha256()
            digest.update(ids.encode())
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ready, strict=True)], names=["hi", "lo", "ends_sha256"])
            ready = []
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], names=["hi", "lo", "ends_sha256"])


def _ends(prefixes: DataFrame, stretches: DataFrame) -> DataFrame:
    """``hi, lo, ends_sha256`` of nodes in which members end."""
    last = prefixes.groupBy("conv").agg(F.max(F.struct("depth", *NODE)).alias("last"))
    ends = stretches.where("before = 0").select("conv").join(last, "conv", "left").select("conv", *(F.coalesce(f"last.{c}", F.lit(0)).alias(c) for c in NODE))
    sorted_ids = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    size = STRETCH
    joined = sorted_ids.mapInArrow(lambda batches: _stretch_ids(batches, size), "hi long, lo long, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hash_stretches, "hi long, lo long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, opening: Opening = own_opening, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node: its name ``hi, lo`` and ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``; ``opening`` says whose first turns a conversation takes in place of its own."""
    turns = _ordered(conversations, conv, turn, role, text)
    stretches = _stretches(turns, opening)
    rebuilt = _rebuilt(turns, stretches)
    prefixes = _prefixes(rebuilt)
    drop_written(turns, rebuilt)
    tree = _tree(_nodes(prefixes, stretches))
    summed = _summed(_on_paths(tree, prefixes))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return summed.join(_ends(prefixes, stretches), NODE, "left").select(
        *NODE, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
