"""Connected components of links too many for one machine, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.runtime import drop_written, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every id with a link; ``links`` has long columns ``a, b``.

    Each round points every node's larger neighbours at its smallest one, then its smaller ones; rounds end when the
    edges stay as they are, after a number that grows with the logarithm of the longest path. Every round is written
    to the shared folder. A node with very many links only ever takes part in a minimum, which is combined before
    the exchange, and in a join whose other side has one row for it, which adaptive execution can split.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    signature = _signature(edges)
    while signature[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # nodes with a smaller neighbour; written, so that both sides of the join are exchanges, which can be split
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u").select(F.col("u").alias("v"), "m"), "least")
        large = edges.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = written(large, "large-star")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = written(moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        drop_written(edges, least, large)
        edges, before, signature = following, signature, _signature(following)
        if signature == before:
            break
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
