"""Communities of large graphs by modularity: rounds of moves as joins, aggregated graphs between levels.

Every frame is keyed by a graph ``g`` and ``id``; any number of graphs of any size go together. A round moves nodes to
neighbouring communities of which none both loses and gains, and of many moves out of or into one community only those
that pay even if all of them happen; so every round raises the modularity, and no round has to be taken back. When no move pays, communities become nodes and the rounds go on among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.runtime import drop_written, written

#: Gains of a move under this count as none; so do rises of a graph's modularity in a round.
LEAST_GAIN, LEAST_RISE = 1e-12, 2e-3


def both_ways(edges: DataFrame) -> DataFrame:
    """``g, i, j, w`` of undirected ``g, u, v, w``, each edge once, without loops."""
    turned = edges.select("g", F.col("v").alias("i"), F.col("u").alias("j"), "w")
    return edges.select("g", F.col("u").alias("i"), F.col("v").alias("j"), "w").unionByName(turned)


def modularity(both: DataFrame, labels: DataFrame) -> DataFrame:
    """``g, communities, modularity`` of the partition ``g, id, c``, from ``g, i, j, w`` in both directions."""
    ends = both.join(labels.select("g", F.col("id").alias("i"), F.col("c").alias("ci")), ["g", "i"]).join(labels.select("g", F.col("id").alias("j"), F.col("c").alias("cj")), ["g", "j"])
    each = ends.groupBy("g", F.col("ci").alias("c")).agg(F.sum("w").alias("total"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0)).alias("inside"))
    two_m = F.sum("total")
    return each.groupBy("g").agg(F.count(F.lit(1)).alias("communities"), (F.sum("inside") / two_m - F.sum(F.col("total") * F.col("total")) / (two_m * two_m)).alias("modularity"))


def _qualities(both: DataFrame, placed: DataFrame, names: list[str]) -> DataFrame:
    """``g`` and ``q_name``, the modularity of each of several partitions of ``placed``, in one pass over the edges."""
    ends = both
    for end in "ij":
        ends = ends.join(placed.select("g", F.col("id").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in names)), ["g", end])
    found = ends.groupBy("g").agg(F.sum("w").alias("m2"), *(F.sum(F.when(F.col(f"{c}_i") == F.col(f"{c}_j"), F.col("w")).otherwise(0)).alias(f"inside_{c}") for c in names))
    for c in names:
        squares = placed.groupBy("g", c).agg(F.sum("k").alias("total")).groupBy("g").agg(F.sum(F.col("total") * F.col("total")).alias(f"squares_{c}"))
        found = found.join(squares, "g")
    return found.select("g", *((F.col(f"inside_{c}") / F.col("m2") - F.col(f"squares_{c}") / (F.col("m2") * F.col("m2"))).alias(f"q_{c}") for c in names))


def _moves(both: DataFrame, placed: DataFrame) -> DataFrame:
    """``g, id, c0, c, gain, k, m2``: each node's best move that pays, the smallest community among equals; ``placed`` has
    ``g, id, c``, the node's degree ``k`` and its graph's ``m2``."""
    totals = placed.groupBy("g", "c").agg(F.sum("k").alias("total"))
    away = both.where("i <> j").join(placed.select("g", F.col("id").alias("j"), "c"), ["g", "j"])
    links = away.groupBy("g", F.col("i").alias("id"), "c").agg(F.sum("w").alias("l"))
    own = placed.join(links.withColumnRenamed("l", "l0"), ["g", "id", "c"], "left").join(totals.withColumnRenamed("total", "total0"), ["g", "c"])
    own = own.select("g", "id", "k", "m2", F.col("c").alias("c0"), F.coalesce("l0", F.lit(0)).alias("l0"), "total0")
    possible = links.join(own, ["g", "id"]).where("c <> c0").join(totals, ["g", "c"])
    gain = 2 * (F.col("l") - F.col("l0")) / F.col("m2") - 2 * F.col("k") * (F.col("total") - F.col("total0") + F.col("k")) / (F.col("m2") * F.col("m2"))
    best = possible.withColumn("gain", F.round(gain, 14)).where(F.col("gain") > LEAST_GAIN)
    best = best.groupBy("g", "id", "c0", "k", "m2").agg(F.max(F.struct("gain", (-F.col("c")).alias("c"))).alias("best"))
    return best.select("g", "id", "c0", (-F.col("best.c")).alias("c"), F.col("best.gain").alias("gain"), "k", "m2")


def _chosen(moves: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """``g, id, free`` and ``g, id, careful``: all moves of a round and those that surely raise the modularity; and what
    is kept for them while the round lasts.

    A community loses or gains, as its best move out or in is the better one. Two moves out of one community, or into
    one, change each other's gain by less than ``2 k1 k2 / m2^2`` downwards, so a move happens if it pays beside all
    others, or if it is the best one of both its communities.
    """
    moves = moves.withColumn("first", F.struct("gain", (-F.col("id")).alias("order"))).persist()
    out = moves.groupBy("g", F.col("c0").alias("c")).agg(F.max("first").alias("out"))
    into = moves.groupBy("g", "c").agg(F.max("first").alias("into"))
    roles = out.join(into, ["g", "c"], "full").select("g", "c", (F.col("out").isNotNull() & (F.col("into").isNull() | (F.col("out") > F.col("into")))).alias("loses"))
    losing, gaining = roles.where("loses").select("g", F.col("c").alias("c0")), roles.where("NOT loses").select("g", "c")
    able = moves.join(losing, ["g", "c0"], "left_semi").join(gaining, ["g", "c"], "left_semi").persist()
    leaving = able.groupBy("g", "c0").agg(F.max("first").alias("leaves"), F.sum("k").alias("k_leave"))
    coming = able.groupBy("g", "c").agg(F.max("first").alias("comes"), F.sum("k").alias("k_come"))
    met = able.join(leaving, ["g", "c0"]).join(coming, ["g", "c"])
    best = (F.col("first") == F.col("leaves")) & (F.col("first") == F.col("comes"))
    pays = F.col("gain") > 2 * F.col("k") * (F.col("k_leave") + F.col("k_come") - 2 * F.col("k")) / (F.col("m2") * F.col("m2"))
    return able.select("g", "id", F.col("c").alias("free")), met.where(best | pays).select("g", "id", F.col("c").alias("careful")), [moves, able]


def _settled(both: DataFrame, labels: DataFrame) -> tuple[DataFrame, bool]:
    """Labels after rounds of moves until none pays, and whether any node moved."""
    nodes = both.groupBy("g", F.col("i").alias("id")).agg(F.sum("w").alias("k"))
    weight = both.groupBy("g").agg(F.sum("w").alias("m2"))
    placed = written(labels.join(nodes, ["g", "id"]).join(weight, "g").select("g", "id", "c", "k", "m2"), "communities-placed")
    quality = written(_qualities(both, placed, ["c"]).select("g", F.col("q_c").alias("q")), "communities-quality")
    any_moved = False
    while True:
        free, careful, kept = _chosen(_moves(both, placed))
        tried = placed.join(free, ["g", "id"], "left").join(careful, ["g", "id"], "left")
        tried = written(tried.select("g", "id", "k", "m2", F.coalesce("free", "c").alias("free"), F.coalesce("careful", "c").alias("careful")), "communities-tried")
        for frame in kept:
            frame.unpersist()
        made = quality.join(_qualities(both, tried, ["free", "careful"]), "g")
        made = written(made.select("g", F.greatest("q", "q_free", "q_careful").alias("q"), (F.col("q_free") >= F.col("q_careful")).alias("all"), F.col("q").alias("before")), "communities-quality")
        rise = made.agg(F.max(F.col("q") - F.col("before"))).first()[0] or 0.0
        if rise <= LEAST_RISE:
            drop_written(tried, made)
            return placed.select("g", "id", "c"), any_moved
        # of the two tables just written; so the round before goes
        after = tried.join(made, "g").select("g", "id", F.when(F.col("all"), F.col("free")).otherwise(F.col("careful")).alias("c"), "k", "m2")
        drop_written(placed, quality)
        placed, quality, any_moved = after, made.select("g", "q"), True


def _levels(both: DataFrame, labels: DataFrame) -> DataFrame:
    """From a partition on: communities as nodes, moved among each other, level by level."""
    while True:
        mine, other = labels.select("g", F.col("id").alias("i"), F.col("c").alias("ci")), labels.select("g", F.col("id").alias("j"), F.col("c").alias("cj"))
        above = written(both.join(mine, ["g", "i"]).join(other, ["g", "j"]).groupBy("g", F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.sum("w").alias("w")), "communities-level")
        alone = written(above.select("g", F.col("i").alias("id")).distinct().withColumn("c", F.col("id")), "communities-labels")
        found, moved = _settled(above, alone)
        if not moved:
            drop_written(above, found)
            return labels
        joined = labels.join(found.select("g", F.col("id").alias("c"), F.col("c").alias("root")), ["g", "c"]).select("g", "id", F.col("root").alias("c"))
        following = written(joined, "communities-labels")
        drop_written(above, found, labels)
        labels = following


def find_communities(edges: DataFrame) -> DataFrame:
    """``g, id, c`` for every node of undirected ``g, u, v, w`` (long ids, each edge once, no loops); communities are named
    by their smallest node. Equal gains go to smaller names, so equal graphs give equal communities."""
    both = written(both_ways(edges), "communities-edges")
    labels = written(both.select("g", F.col("i").alias("id")).distinct().withColumn("c", F.col("id")), "communities-labels")
    labels, _ = _settled(both, labels)
    labels = _levels(both, labels)
    labels, moved = _settled(both, labels)  # single nodes again, now that communities have grown
    if moved:
        labels = _levels(both, labels)
    smallest = labels.groupBy("g", "c").agg(F.min("id").alias("least"))
    return written(labels.join(smallest, ["g", "c"]).select("g", "id", F.col("least").alias("c")), "communities")


def split_counts(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``g, intra, inter``: edges inside and between communities."""
    ends = edges.join(labels.select("g", F.col("id").alias("u"), F.col("c").alias("cu")), ["g", "u"]).join(labels.select("g", F.col("id").alias("v"), F.col("c").alias("cv")), ["g", "v"])
    same: Column = F.col("cu") == F.col("cv")
    return ends.groupBy("g").agg(F.count_if(same).alias("intra"), F.count_if(~same).alias("inter"))
