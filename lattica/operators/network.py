"""Graphs: nearest neighbours, Forman-Ricci curvature, splits, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import STATE
from lattica.runtime import drop_written, written


def effective_k(k: int, nodes: Column) -> Column:
    """At most half of the other nodes, two at least: a complete graph has no structure to see."""
    return F.greatest(F.lit(1), F.least(F.lit(k), F.greatest(F.lit(2), F.floor((nodes - 1) / 2))))


def nearest_neighbours(distances: DataFrame, keys: list[str], k: int = STATE.neighbours) -> DataFrame:
    """``keys, u, v`` with u < v: each node's k nearest by (distance, name), joined undirected.

    ``distances`` has ``a < b`` and ``d`` for each pair.
    """
    both = distances.select(*keys, F.col("a").alias("i"), F.col("b").alias("j"), "d").unionByName(distances.select(*keys, F.col("b").alias("i"), F.col("a").alias("j"), "d"))
    node = Window.partitionBy(*keys, "i")
    ranked = both.withColumn("rank", F.row_number().over(node.orderBy("d", "j"))).withColumn("nodes", F.count(F.lit(1)).over(node) + 1)
    near = ranked.where(F.col("rank") <= effective_k(k, F.col("nodes")))
    return near.select(*keys, F.least("i", "j").alias("u"), F.greatest("i", "j").alias("v")).distinct()


def forman_ricci(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, u, v, curvature``: 4 - degrees + 3 * triangles on the edge."""
    both = edges.select(*keys, F.col("u").alias("i"), F.col("v").alias("j")).unionByName(edges.select(*keys, F.col("v").alias("i"), F.col("u").alias("j")))
    # neighbour lists are as long as a node's degree; an edge's triangles are the neighbours that its ends share
    around = both.groupBy(*keys, "i").agg(F.collect_set("j").alias("near"))
    ends = edges.join(around.select(*keys, F.col("i").alias("u"), F.col("near").alias("near_u")), [*keys, "u"]).join(
        around.select(*keys, F.col("i").alias("v"), F.col("near").alias("near_v")), [*keys, "v"]
    )
    value = 4 - F.size("near_u") - F.size("near_v") + 3 * F.size(F.array_intersect("near_u", "near_v"))
    return ends.select(*keys, "u", "v", value.cast("double").alias("curvature"))


def rigidity(curvature: DataFrame, keys: list[str], summary: str = "median", floor: float = STATE.rigidity_floor) -> DataFrame:
    """``keys, curvature, eta``: median or mean curvature and ``1 / (|curvature| + floor)``."""
    middle = F.median("curvature") if summary == "median" else F.avg("curvature")
    return curvature.groupBy(*keys).agg(F.round(middle, 9).alias("curvature")).withColumn("eta", F.round(1 / (F.abs("curvature") + floor), 9))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct ``u < v`` of ``source, target``; loops go."""
    return edges.where("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).distinct()


def split_by_label(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts of edges inside and between labels; edges with unknown ends go."""
    labelled = edges.join(nodes.select(F.col("id").alias("u"), F.col("label").alias("lu")), "u").join(nodes.select(F.col("id").alias("v"), F.col("label").alias("lv")), "v")
    return labelled.agg(F.count_if(F.col("lu") == F.col("lv")).alias("intra"), F.count_if(F.col("lu") != F.col("lv")).alias("inter"))


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable): labels move along edges and jump to their label's label."""
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "graph-edges")
    labels = written(both.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct(), "graph-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("component").alias("m"))
        moved = labels.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", F.least("component", "m").alias("component"))
        jump = moved.select(F.col("id").alias("component"), F.col("component").alias("root"))
        following = written(moved.join(jump, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "graph-labels")
        changed = following.join(labels.withColumnRenamed("component", "before"), "id").where("component <> before").limit(1).count()
        drop_written(labels)
        labels = following
        if not changed:
            return labels


def cosine_distances(vectors: DataFrame) -> DataFrame:
    """``a < b, d`` for all pairs of a small stated set of vectors ``id, x``."""
    left, right = vectors.select(F.col("id").alias("a"), F.col("x").alias("xa")), vectors.select(F.col("id").alias("b"), F.col("x").alias("xb"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    cosine = F.try_divide(dot("xa", "xb"), F.sqrt(dot("xa", "xa")) * F.sqrt(dot("xb", "xb")))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", F.round(1 - cosine, 9).alias("d"))
