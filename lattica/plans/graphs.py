"""Queries on graphs too large for one task: communities, their modularity, leading eigenvalues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators import communities, spectra
from lattica.plans import oracle as o
from lattica.plans.catalog import STRONG, TRADE, query, trade_graph
from lattica.runtime import table, written


def _weighted(graph: DataFrame) -> DataFrame:
    """A graph with one key and edges that weigh one."""
    return graph.select(F.lit(0).cast("long").alias("g"), F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), F.lit(1).cast("long").alias("w"))


@query(o.sql(TRADE.format(percent=STRONG), "two AS (SELECT u AS i, v AS j FROM tgraph UNION ALL SELECT v, u FROM tgraph)",
             "ends AS (SELECT p.n_regionkey AS ci, q.n_regionkey AS cj FROM two JOIN nation p ON p.n_nationkey = i JOIN nation q ON q.n_nationkey = j)",
             "parts AS (SELECT ci, count(*) AS total, count(*) FILTER (ci = cj) AS inside FROM ends GROUP BY ci)",
             "SELECT count(*) AS communities, round(sum(inside) / sum(total) - sum(CAST(total AS DOUBLE) * total) / (CAST(sum(total) AS DOUBLE) * sum(total)), 9) AS modularity FROM parts HAVING count(*) > 0"))
def region_modularity(spark, sf_dir):
    """How well regions part the trade graph: the modularity of nations by region."""
    both = communities.both_ways(_weighted(trade_graph(spark, sf_dir)))
    regions = table(spark, sf_dir, "nation").select(F.lit(0).cast("long").alias("g"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("c"))
    return communities.modularity(both, regions).select("communities", F.round("modularity", 9).alias("modularity"))


@query()
def trade_communities(spark, sf_dir):
    """The trade graph's communities by rounds of moves: ``communities, modularity, intra, inter``."""
    graph = written(_weighted(trade_graph(spark, sf_dir)), "trade-graph")
    labels = communities.find_communities(graph)
    return communities.modularity(communities.both_ways(graph), labels).join(communities.split_counts(graph, labels), "g").drop("g")


def repeat_trades(spark, sf_dir) -> DataFrame:
    """``u, v``: customers (even numbers) and suppliers (odd ones) that traded more than once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    pairs = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    a, b = 2 * F.col("o_custkey"), 2 * F.col("l_suppkey") + 1
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


@query()
def repeat_trade_spectrum(spark, sf_dir):
    """Concentration, rigidity, gap and diversity of the leading eigenvalues of the repeat trades' giant component."""
    found = spectra.graph_five(written(repeat_trades(spark, sf_dir), "repeat-trades"))
    return found.select("nodes", "edges", F.size("values").alias("eigenvalues"), *(F.round(c, 6).alias(c) for c in ("oh", "oh_nodes", "eta", "density", "gap", "xi", "lambda_1")))
