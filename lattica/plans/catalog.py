"""The engine's queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.config import STATE
from lattica.operators import coupling, events, network, series, state
from lattica.plans import oracle as o
from lattica.runtime import table
from lattica.sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


def one_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.returns(panels.complete_rows(panels.forward_filled(panels.full_grid(panels.trade_panel(spark, sf_dir)))))


def all_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.returns(panels.weekly_universes(spark, sf_dir))


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.numbered(panels.revenue_series(spark, sf_dir))


# Panels ----------------------------------------------------------------------------------------------------------


@query(o.sql(o.MONTH_NATION, o.CLEAN, "SELECT uid, t, asset, x FROM whole"))
def panel_clean_ffill(spark, sf_dir):
    return panels.complete_rows(panels.forward_filled(panels.full_grid(panels.trade_panel(spark, sf_dir, "month", asset="n_name")))).select("uid", "t", "asset", "x")


@query(o.sql(o.MONTH_NATION, o.CLEAN, "SELECT asset, count(x) AS have, count(*) AS cells, min(t) FILTER (x IS NOT NULL) AS first_valid, round(count(x) / count(*), 6) AS coverage FROM grid GROUP BY asset"))
def panel_coverage(spark, sf_dir):
    grid = panels.full_grid(panels.trade_panel(spark, sf_dir, "month", asset="n_name"))
    valid = F.min(F.when(F.col("x").isNotNull(), F.col("t")))
    return grid.groupBy("asset").agg(F.count("x").alias("have"), F.count(F.lit(1)).alias("cells"), valid.alias("first_valid"), F.round(F.count("x") / F.count(F.lit(1)), 6).alias("coverage"))


TRIM = """span AS (SELECT uid, min(t) AS first, max(t) AS last FROM filled GROUP BY uid
), early AS (
  SELECT f.uid, asset, min(t) AS start FROM filled f WHERE x IS NOT NULL GROUP BY 1, 2
), kept0 AS (
  SELECT e.uid, e.asset, e.start FROM early e JOIN span s USING (uid) WHERE e.start <= s.first + CAST(floor((s.last - s.first) * 0.4::DOUBLE) AS INTEGER)
), kept AS (
  SELECT f.* FROM filled f JOIN kept0 k USING (uid, asset) WHERE t >= (SELECT max(start) FROM kept0 z WHERE z.uid = f.uid)
), thick AS (
  SELECT uid, asset FROM kept GROUP BY 1, 2 HAVING count(x) >= greatest(floor((SELECT count(DISTINCT t) FROM kept z WHERE z.uid = kept.uid) * 0.5::DOUBLE), 44)
), counted AS (SELECT k.*, count(x) OVER (PARTITION BY uid, t) AS have, count(*) OVER (PARTITION BY uid, t) AS want FROM kept k JOIN thick USING (uid, asset))"""


@query(o.sql(o.PRIORITY, o.CLEAN, TRIM, "SELECT uid, t, asset, x FROM counted WHERE have = want"))
def panel_trimmed(spark, sf_dir):
    return panels.trimmed(panels.trade_panel(spark, sf_dir, uid="o_orderpriority"), STATE.window).select("uid", "t", "asset", "x")


@query(o.sql(*o.ONE, "SELECT uid, t, asset, round(r, 6) AS r FROM rets"))
def log_returns(spark, sf_dir):
    return one_returns(spark, sf_dir).select("uid", "t", "asset", *r6("r"))


@query(o.sql(*o.ONE[:2], "SELECT uid, t, asset, round(x / before - 1, 6) AS r FROM (SELECT *, lag(x) OVER (PARTITION BY uid, asset ORDER BY t) AS before FROM whole) WHERE before IS NOT NULL"))
def simple_returns(spark, sf_dir):
    clean = panels.complete_rows(panels.forward_filled(panels.full_grid(panels.trade_panel(spark, sf_dir))))
    return panels.returns(clean, "simple").select("uid", "t", "asset", *r6("r"))


@query(o.sql(o.MONTH_NATION, o.CLEAN, """placed AS (SELECT *, row_number() OVER (PARTITION BY uid, asset ORDER BY t) AS i FROM grid
), ends AS (
  SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1,
         last_value(x IGNORE NULLS) OVER b AS x0, first_value(x IGNORE NULLS) OVER a AS x1
  FROM placed WINDOW b AS (PARTITION BY uid, asset ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY uid, asset ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
             "SELECT uid, t, asset, round(CASE WHEN x IS NOT NULL THEN x WHEN i - i0 <= 3 AND x1 IS NOT NULL THEN x0 + (x1 - x0) * ((i - i0) / (i1 - i0)) END, 6) AS x FROM ends"))
def interpolated_gaps(spark, sf_dir):
    grid = panels.full_grid(panels.trade_panel(spark, sf_dir, "month", asset="n_name"))
    return panels.interpolated(grid).select("uid", "t", "asset", *r6("x"))


# Coupling --------------------------------------------------------------------------------------------------------


@query(o.sql(*o.ALL, o.EDGES, "SELECT uid, t, a, b, round(c, 6) AS c FROM edges"))
def rolling_pearson_edges(spark, sf_dir):
    return coupling.rolling_pearson(all_returns(spark, sf_dir)).select("uid", "t", "a", "b", *r6("c"))


@query(o.sql(*o.ALL, o.EDGES, o.SHRUNK, "SELECT uid, t, round(round(avg(c), 9) + 1e-11, 6) AS mean_corr, round(round(avg(abs(c)), 9) + 1e-11, 6) AS mean_abs_corr FROM shrunk GROUP BY uid, t"))
def rolling_mean_coupling(spark, sf_dir):
    edges = coupling.shrunk(coupling.rolling_pearson(all_returns(spark, sf_dir)))
    return coupling.mean_coupling(edges).select("uid", "t", *(F.round(F.col(c) + 1e-11, 6).alias(c) for c in ("mean_corr", "mean_abs_corr")))


SPEARMAN = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY uid, asset ORDER BY t) AS i FROM rets
), wins AS (
  SELECT p.uid, e.t, p.t AS s, p.asset, p.r FROM placed p JOIN placed e ON e.uid = p.uid AND e.asset = p.asset AND e.i BETWEEN p.i AND p.i + 21 WHERE e.i >= 22
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY uid, t, asset ORDER BY r) + (count(*) OVER (PARTITION BY uid, t, asset, r) - 1) / 2.0::DOUBLE AS k FROM wins
), spear AS (
  SELECT l.uid, l.t, l.asset AS a, m.asset AS b, corr(l.k, m.k) AS c FROM ranked l JOIN ranked m ON l.uid = m.uid AND l.t = m.t AND l.s = m.s AND l.asset < m.asset GROUP BY 1, 2, 3, 4)"""


@query(o.sql(*o.ONE, SPEARMAN, f"SELECT uid, t, a, b, round(round({o.CORR.format(c='c')}, 9) + 1e-11, 6) AS c FROM spear"))
def rolling_spearman_edges(spark, sf_dir):
    return coupling.rolling_spearman(one_returns(spark, sf_dir)).select("uid", "t", "a", "b", F.round(F.round("c", 9) + 1e-11, 6).alias("c"))


@query(o.sql(*o.ALL, o.EDGES, o.SHRUNK, "SELECT uid, t, a, b, round(c, 6) AS c, round(d, 6) AS d, round(greatest(least(1 - c, 2.0::DOUBLE), 0.0::DOUBLE), 6) AS d_plain FROM dist"))
def shrunk_corr_distance(spark, sf_dir):
    edges = coupling.shrunk(coupling.rolling_pearson(all_returns(spark, sf_dir)))
    c = F.col("c")
    return edges.select("uid", "t", "a", "b", *r6("c"), F.round(F.round(coupling.angular_distance(c), 9), 6).alias("d"), F.round(coupling.plain_distance(c), 6).alias("d_plain"))


@query(o.sql(*o.ALL, o.VOL, "SELECT uid, t, round(vol, 6) AS vol FROM vols"))
def realized_vol(spark, sf_dir):
    return coupling.realized_volatility(all_returns(spark, sf_dir)).select("uid", "t", *r6("vol"))


MOVED = f"""placed AS (SELECT *, row_number() OVER (PARTITION BY uid, a, b ORDER BY t) AS i, count(*) OVER (PARTITION BY uid, a, b) AS n FROM pairs
), sides AS (
  SELECT uid, a, b, corr(ra, rb) FILTER (i > n - 22) AS cn, corr(ra, rb) FILTER (i <= 252) AS cq FROM placed GROUP BY 1, 2, 3
), moved0 AS (SELECT uid, a, b, round({o.CORR.format(c="cn")}, 6) AS corr_now, round({o.CORR.format(c="cq")}, 6) AS corr_quiet FROM sides
), moved AS (SELECT *, round(corr_now - corr_quiet, 6) AS delta FROM moved0
), shifted AS (
  SELECT *, row_number() OVER (PARTITION BY uid ORDER BY abs(delta) DESC, a, b) AS rank, CASE WHEN delta > 0 THEN 'coupling' ELSE 'decoupling' END AS kind FROM moved WHERE abs(delta) >= 0.1)"""
PAIRS = o.EDGES.split("\n), edges AS")[0] + ")"


@query(o.sql(*o.ALL, PAIRS, MOVED, "SELECT uid, a, b, corr_now, corr_quiet, delta, CAST(rank AS BIGINT) AS rank, kind FROM shifted"))
def anomalous_pairs_topk(spark, sf_dir):
    return events.shifted_pairs(all_returns(spark, sf_dir), 0.1).withColumn("rank", F.col("rank").cast("long"))


@query(o.sql(*o.ALL, PAIRS, MOVED, "SELECT uid, count(*) AS n, count(*) FILTER (kind = 'coupling') AS coupling, count(*) FILTER (kind = 'decoupling') AS decoupling, round(avg(abs(delta)) + 1e-9, 6) AS mean_shift FROM shifted GROUP BY uid"))
def pair_summary(spark, sf_dir):
    return events.pair_summary(events.shifted_pairs(all_returns(spark, sf_dir), 0.1))


BITS = """placed AS (SELECT *, row_number() OVER (PARTITION BY uid, a, b ORDER BY t) AS i, count(*) OVER (PARTITION BY uid, a, b) AS n FROM edges
), med AS (SELECT uid, a, b, round(quantile_cont(c, 0.5), 9) AS m FROM placed WHERE i <= floor(n * 0.4::DOUBLE) GROUP BY 1, 2, 3
), bits AS (SELECT p.uid, p.t, p.a, p.b, p.i, CAST(p.c < m AS INTEGER) AS bit FROM placed p JOIN med USING (uid, a, b)
), strings AS (SELECT uid, t, min(i) AS i, string_agg(CAST(bit AS VARCHAR), '' ORDER BY a, b) AS s FROM bits GROUP BY uid, t
), joined AS (
  SELECT e.uid, e.t, e.i, count(*) AS have, string_agg(p.s, '' ORDER BY p.t) AS s FROM strings e JOIN strings p ON p.uid = e.uid AND p.i BETWEEN e.i - 14 AND e.i GROUP BY 1, 2, 3
), complexities AS (
  SELECT uid, t, i, CASE WHEN have < 3 THEN 1.0::DOUBLE ELSE round((1 + len(list_filter(range(1, len(s)), lambda k: s[k] <> s[k + 1]))) / (len(s) / log2(len(s) + 1.0::DOUBLE)), 9) END AS complexity FROM joined)"""


@query(o.sql(*o.ALL, o.EDGES, BITS, "SELECT uid, t, round(complexity, 6) AS complexity FROM complexities"))
def symbol_run_complexity(spark, sf_dir):
    return coupling.run_complexity(coupling.symbols(coupling.rolling_pearson(all_returns(spark, sf_dir)))).select("uid", "t", *r6("complexity"))


@query(o.sql(*o.ALL, o.EDGES, BITS, """SELECT uid, t, round(complexity, 6) AS complexity, round(CASE WHEN n = 10 THEN -slope ELSE 0.0::DOUBLE END, 6) + 0.0::DOUBLE AS depletion FROM (
  SELECT *, regr_slope(complexity, i) OVER w AS slope, count(*) OVER w AS n FROM complexities WINDOW w AS (PARTITION BY uid ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""))
def complexity_depletion(spark, sf_dir):
    found = coupling.run_complexity(coupling.symbols(coupling.rolling_pearson(all_returns(spark, sf_dir))))
    return coupling.depletion_rate(found).select("uid", "t", *r6("complexity"), (F.round("depletion", 6) + 0.0).alias("depletion"))


# Graphs ----------------------------------------------------------------------------------------------------------


def _distances(spark, sf_dir):
    edges = coupling.shrunk(coupling.rolling_pearson(all_returns(spark, sf_dir)))
    return edges.withColumn("d", F.round(coupling.angular_distance(F.col("c")), 9))


@query(o.sql(*o.ALL, o.EDGES, o.SHRUNK, o.graph("uid", "t"), "SELECT uid, t, u, v FROM graph"))
def knn_graph_edges(spark, sf_dir):
    return network.nearest_neighbours(_distances(spark, sf_dir), ["uid", "t"])


@query(o.sql(*o.ALL, o.EDGES, o.SHRUNK, o.graph("uid", "t"), "SELECT uid, t, curvature, round(1 / (abs(curvature) + 0.05::DOUBLE), 6) AS eta FROM rigid"))
def forman_ricci_rigidity(spark, sf_dir):
    keys = ["uid", "t"]
    graph = network.nearest_neighbours(_distances(spark, sf_dir), keys)
    return network.rigidity(network.forman_ricci(graph, keys), keys).select("uid", "t", "curvature", *r6("eta"))


CENTROIDS = """vecs AS (SELECT label AS id, i, avg(e) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i
), xs AS (SELECT id, list(v ORDER BY i) AS x FROM vecs GROUP BY id
), dist AS (SELECT 'c' AS g, p.id AS a, q.id AS b, round(1 - list_cosine_similarity(p.x, q.x), 9) AS d FROM xs p JOIN xs q ON p.id < q.id)"""


@query(o.sql(CENTROIDS, o.graph("g"), "SELECT u, v, curvature FROM curved"))
def centroid_graph_curvature(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "e"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("e").cast("double")).alias("v"))
    vectors = means.groupBy(F.col("label").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))
    graph = network.nearest_neighbours(network.cosine_distances(vectors).withColumn("g", F.lit("c")), ["g"])
    return network.forman_ricci(graph, ["g"]).select("u", "v", "curvature")


TRADE = """flows AS (
  SELECT least(c_nationkey, s_nationkey) AS u, greatest(c_nationkey, s_nationkey) AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2
), tgraph AS (SELECT u, v FROM (SELECT u, v, 100 * n * count(*) OVER () > {percent} * sum(n) OVER () AS strong FROM flows) WHERE strong)"""
#: Percent of the mean number of items between two nations that an edge stands for at least.
STRONG = 100


def trade_flows(spark, sf_dir, *more: str) -> DataFrame:
    """Items by pair of customer and supplier nation, of all orders: ``u, v, n`` and the other columns; a few hundred rows a group."""
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    ordered = table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    supplied = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    joined = ordered.join(supplied, F.col("o_orderkey") == F.col("l_orderkey")).where("c_nationkey <> s_nationkey")
    keyed = joined.select(*(F.expr(m) for m in more), F.least("c_nationkey", "s_nationkey").alias("u"), F.greatest("c_nationkey", "s_nationkey").alias("v"))
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))


def trade_graph(spark, sf_dir, percent: int = STRONG) -> DataFrame:
    """Pairs of nations with more items between them than the mean pair, undirected."""
    flows = trade_flows(spark, sf_dir)
    whole = Window.partitionBy()  # over pairs of nations, a few hundred rows
    return flows.withColumn("strong", 100 * F.col("n") * F.count(F.lit(1)).over(whole) > percent * F.sum("n").over(whole)).where("strong").select("u", "v")


@query(o.sql(TRADE.format(percent=STRONG), "SELECT count(*) FILTER (a.n_regionkey = b.n_regionkey) AS intra, count(*) FILTER (a.n_regionkey <> b.n_regionkey) AS inter FROM tgraph JOIN nation a ON a.n_nationkey = u JOIN nation b ON b.n_nationkey = v"))
def intra_inter_split(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("label"))
    return network.split_by_label(trade_graph(spark, sf_dir), nodes)


@query(o.sql(TRADE.format(percent=STRONG), "ends AS (SELECT u AS id FROM tgraph UNION SELECT v FROM tgraph)", "SELECT (SELECT count(*) FROM tgraph) AS edges, count(*) AS nodes, round(2 * (SELECT count(*) FROM tgraph) / (count(*) * (count(*) - 1)), 6) AS density FROM ends HAVING count(*) > 1"))
def graph_density(spark, sf_dir):
    graph = trade_graph(spark, sf_dir)
    ends = graph.select(F.explode(F.array("u", "v")).alias("id"))
    counted = ends.agg((F.count(F.lit(1)) / 2).cast("long").alias("edges"), F.countDistinct("id").alias("nodes"))
    return counted.where("nodes > 1").select("edges", "nodes", F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"))


@query(o.sql(TRADE.format(percent=130), "two AS (SELECT u, v FROM tgraph UNION SELECT v, u FROM tgraph)", "reach AS (SELECT u AS id, u AS other FROM two UNION SELECT r.id, t.v FROM reach r JOIN two t ON t.u = r.other)", "SELECT id, min(other) AS component FROM reach GROUP BY id", recursive=True))
def graph_components(spark, sf_dir):
    return network.components(trade_graph(spark, sf_dir, 130))


# State -----------------------------------------------------------------------------------------------------------


def _oh_state(spark, sf_dir):
    return state.universe_windows(spark, sf_dir)


@query(o.sql(*o.WINDOWS, "SELECT uid, t, round(eta_ref, 6) AS eta_ref, round(lambda_c, 6) AS lambda_c, round(oh, 6) AS oh FROM ohs"))
def oh_curvature_baseline(spark, sf_dir):
    return _oh_state(spark, sf_dir).select("uid", "t", *r6("eta_ref", "lambda_c", "oh"))


@query(o.sql(*o.WINDOWS, f"SELECT uid, count(*) AS rows, round(quantile_cont(oh, 0.75), 6) AS q75, round(quantile_cont(oh, 0.95), 6) AS q95, round(quantile_cont(oh, 0.968), 6) AS oh_pre, round(greatest(quantile_cont(mean_corr, 0.99), max(mean_corr)) * 1.02::DOUBLE, 6) AS critical FROM ohs WHERE {o.CALM} GROUP BY uid"))
def calm_quantiles(spark, sf_dir):
    q = lambda p: F.round(F.percentile("oh", F.lit(p)), 6)
    critical = F.greatest(F.percentile("mean_corr", F.lit(0.99)), F.max("mean_corr")) * 1.02
    return _oh_state(spark, sf_dir).where(series.quiet()).groupBy("uid").agg(F.count(F.lit(1)).alias("rows"), q(0.75).alias("q75"), q(0.95).alias("q95"), q(0.968).alias("oh_pre"), F.round(critical, 6).alias("critical"))


CANDIDATES = """span AS (SELECT uid, min(t) AS first, min(t) FILTER (rn = floor(n * 0.4::DOUBLE) + 1) AS search_to FROM state1 GROUP BY uid
), ends AS (SELECT uid, first, search_to, unnest(range(0, CAST(floor((search_to - first - 1) / 14) AS BIGINT) + 1)) AS k FROM span WHERE search_to > first
), raw AS (SELECT uid, k, search_to - CAST(k * 14 AS INTEGER) AS raw_end, greatest(search_to - CAST(k * 14 AS INTEGER) - 504, first) AS raw_start FROM ends
), candidates AS (SELECT r.uid, CAST(k AS INTEGER) AS k, min(t) AS "start", max(t) AS "end", count(*) AS rows FROM raw r JOIN state1 s ON s.uid = r.uid AND s.t BETWEEN raw_start AND raw_end GROUP BY r.uid, k)"""
SCORES = """inside AS (SELECT s.*, c.k, c."start", c."end" FROM state1 s JOIN candidates c ON c.uid = s.uid AND s.t BETWEEN c."start" AND c."end"
), stepped AS (SELECT *, abs(eta - lag(eta) OVER w) AS de, abs(mean_corr - lag(mean_corr) OVER w) AS dm FROM inside WINDOW w AS (PARTITION BY uid, k ORDER BY t)
), scores AS (
  SELECT uid, k, "start", "end", count(*) AS rows, round(stddev_pop(eta) + stddev_pop(mean_corr) + avg(de) + avg(dm) + 0.25::DOUBLE * avg(vol), 6) AS score FROM stepped GROUP BY ALL HAVING count(*) >= 22
), tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score, "start", k) AS rank FROM scores) WHERE rank <= 5)"""
BASE = o.WINDOWS[:-1]


def _windows(spark, sf_dir):
    return state.universe_windows(spark, sf_dir).drop("eta_ref", "lambda_c", "oh")


@query(o.sql(*BASE, CANDIDATES, "SELECT * FROM candidates"))
def calm_candidates(spark, sf_dir):
    return state.quiet_candidates(_windows(spark, sf_dir).select("uid", "t"))


@query(o.sql(*BASE, CANDIDATES, SCORES, 'SELECT uid, k, "start", "end", rows, score, CAST(rank AS INTEGER) AS rank FROM tops'))
def calm_score_topn(spark, sf_dir):
    frame = _windows(spark, sf_dir)
    return state.quiet_top(state.quiet_scores(frame, state.quiet_candidates(frame.select("uid", "t")).drop("rows"), STATE.window))


RISES = """first AS (SELECT uid, k, count(*) AS m, greatest(quantile_cont(eta, 0.05), 1e-12) AS ref FROM inside GROUP BY uid, k
), pressed AS (SELECT i.uid, i.k, m, CAST(row_number() OVER (PARTITION BY i.uid, i.k ORDER BY t) - 1 AS BIGINT) AS j, round(ref / (eta + 1e-12::DOUBLE), 9) AS pressure FROM inside i JOIN first f ON f.uid = i.uid AND f.k = i.k WHERE m >= 40
), strained AS MATERIALIZED (SELECT *, greatest(round(pressure - (quantile_cont(pressure, 0.968) OVER (PARTITION BY uid, k) + 0.08::DOUBLE), 9), 0.0::DOUBLE) AS drive FROM pressed
), built(uid, k, j, phi) AS (
  SELECT uid, k, j, greatest(drive, 1e-6::DOUBLE) FROM strained WHERE j = 0
  UNION ALL SELECT b.uid, b.k, b.j + 1, greatest(0.97::DOUBLE * b.phi + s.drive, 1e-6::DOUBLE) FROM built b JOIN strained s ON s.uid = b.uid AND s.k = b.k AND s.j = b.j + 1
), steps AS (
  SELECT b.*, CAST(floor(0.75::DOUBLE * m) AS BIGINT) AS e, greatest(round(phi - lag(phi) OVER (PARTITION BY b.uid, b.k ORDER BY b.j), 9), 0.0::DOUBLE) AS step FROM built b JOIN strained s ON s.uid = b.uid AND s.k = b.k AND s.j = b.j
), rises AS (
  SELECT uid, k, greatest(median(step) FILTER (j >= 1 AND j - 1 >= greatest(e - 1, 0)) / (median(step) FILTER (j >= 1 AND j - 1 < greatest(e - 1, 3)) + 1e-12::DOUBLE) - 1.5::DOUBLE, 0.0::DOUBLE) AS ratio,
         CASE WHEN count(*) FILTER (j >= e) >= 8 THEN greatest(252 * regr_slope(phi, j) FILTER (j >= e), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS slope FROM steps GROUP BY uid, k
), judged AS (
  SELECT s.uid, s.k, s."start", s."end", s.rows, round(coalesce(ratio, 0.0::DOUBLE), 6) AS rise_ratio, round(coalesce(slope, 0.0::DOUBLE), 6) AS rise_slope,
         round(0.5::DOUBLE * coalesce(ratio, 0.0::DOUBLE) + 0.5::DOUBLE * coalesce(slope, 0.0::DOUBLE), 6) AS penalty, s.score AS plain FROM scores s LEFT JOIN rises r ON r.uid = s.uid AND r.k = s.k
), weighed AS (SELECT *, round(plain + penalty, 6) AS score FROM judged)"""


@query(o.sql(*BASE, CANDIDATES, SCORES, RISES, 'SELECT uid, k, "start", "end", rows, rise_ratio, rise_slope, penalty, score, CAST(row_number() OVER (PARTITION BY uid ORDER BY score, "start", k) AS INTEGER) AS rank FROM weighed QUALIFY rank <= 5', recursive=True))
def calm_penalised(spark, sf_dir):
    """The best quiet windows when a memory that builds up at a window's end counts against it."""
    frame = _windows(spark, sf_dir)
    candidates = state.quiet_candidates(frame.select("uid", "t")).drop("rows")
    scored = state.quiet_penalised(state.quiet_scores(frame, candidates, STATE.window), state.quiet_rises(frame, candidates))
    return state.quiet_top(scored).select("uid", "k", "start", "end", "rows", *r6("rise_ratio", "rise_slope"), "penalty", "score", "rank")


@query(o.sql(*BASE, CANDIDATES, SCORES, """chosen AS (SELECT s.uid, s.eta, c.k FROM state1 s JOIN tops c ON c.uid = s.uid AND s.t BETWEEN c."start" AND c."end"
), refs AS (SELECT uid, k, greatest(quantile_cont(eta, 0.05), 1e-12) AS eta_ref FROM chosen GROUP BY uid, k
), lams AS (SELECT c.uid, c.k, eta_ref, quantile_cont(eta_ref / (eta + 1e-12), 0.99) * 1.02::DOUBLE AS lambda_c, quantile_cont(eta_ref / (eta + 1e-12), 0.968) AS pre FROM chosen c JOIN refs USING (uid, k) GROUP BY c.uid, c.k, eta_ref)""",
             "SELECT uid, count(*) AS candidates, round(median(eta_ref), 6) AS eta_ref, round(median(lambda_c), 6) AS lambda_c, round(median(pre / lambda_c), 6) AS oh_pre FROM lams GROUP BY uid"))
def calm_ensemble(spark, sf_dir):
    frame = _windows(spark, sf_dir)
    top = state.quiet_top(state.quiet_scores(frame, state.quiet_candidates(frame.select("uid", "t")).drop("rows"), STATE.window))
    return state.quiet_ensemble(frame, top)


@query(o.sql(*o.FULL, "SELECT uid, t, round(oh_pre, 6) AS oh_pre, round(phi, 6) AS phi, round(phi_c, 6) AS phi_c FROM state", recursive=True))
def phi_memory_floor(spark, sf_dir):
    return state.with_memory(_oh_state(spark, sf_dir)).select("uid", "t", *r6("oh_pre", "phi", "phi_c"))


@query(o.sql(*o.FULL, "SELECT uid, t, round(oh, 6) AS oh, round(phi, 6) AS phi, regime FROM state", recursive=True))
def regime_classify(spark, sf_dir):
    return state.universe_state(spark, sf_dir).select("uid", "t", *r6("oh", "phi"), "regime")


FLAGGED = "flagged AS (SELECT uid, t, regime AS flag FROM state)"


@query(o.sql(*o.FULL, FLAGGED, o.RUNS, 'SELECT uid, flag, "start", "end", length FROM runs', recursive=True))
def regime_runs(spark, sf_dir):
    return series.runs(state.universe_state(spark, sf_dir), F.col("regime"))


@query(o.sql(*o.FULL, FLAGGED, o.RUNS, """SELECT s.uid, round(avg(CAST(regime = 'flow' AS INTEGER)), 6) AS share_flow, round(avg(CAST(regime = 'shift' AS INTEGER)), 6) AS share_shift, round(avg(CAST(regime = 'rigid' AS INTEGER)), 6) AS share_rigid,
  round(sum(phi), 6) AS phi_integral, round(max(phi), 6) AS phi_max, round(avg(eta) FILTER (regime = 'rigid'), 6) AS eta_rigid,
  coalesce((SELECT max(length) FROM runs r WHERE r.uid = s.uid AND flag = 'rigid'), 0) AS tau_max, coalesce((SELECT round(avg(length), 6) FROM runs r WHERE r.uid = s.uid AND flag = 'rigid'), 0.0::DOUBLE) AS tau_mean FROM state s GROUP BY s.uid""", recursive=True))
def regime_fractions(spark, sf_dir):
    return state.regime_summary(state.universe_state(spark, sf_dir))


@query(o.sql(*o.FULL, """cums AS (SELECT *, sum(phi) OVER (PARTITION BY uid ORDER BY t ROWS UNBOUNDED PRECEDING) AS cum, max(phi) OVER (PARTITION BY uid) AS peak FROM state
), peaks AS (SELECT uid, min(rn) FILTER (phi = peak) AS event FROM cums GROUP BY uid
), two AS (SELECT c.uid, max(cum) FILTER (rn = event) AS at_event, max(cum) FILTER (rn = greatest(1, event - 5)) AS before FROM cums c JOIN peaks USING (uid) GROUP BY c.uid)""", "SELECT uid, round(CASE WHEN at_event >= 0.01 THEN before / at_event END, 6) AS preparation FROM two", recursive=True))
def preparation_ratio(spark, sf_dir):
    return state.preparation_ratio(state.universe_state(spark, sf_dir))


@query(o.sql(o.REVENUE, o.knee_sql("series", "x"), "SELECT uid, knee FROM knees"))
def knee_threshold(spark, sf_dir):
    return state.knee(panels.revenue_series(spark, sf_dir), "x")


def fold_sql(first: str, following: str) -> tuple[str, str]:
    return o.REVENUE, f"""folded(uid, rn, m) AS (SELECT uid, CAST(1 AS BIGINT), {first} FROM series WHERE rn = 1 UNION ALL SELECT f.uid, f.rn + 1, {following} FROM folded f JOIN series s ON s.uid = f.uid AND s.rn = f.rn + 1)"""


@query(o.sql(*fold_sql("x", "0.1::DOUBLE * x + 0.9::DOUBLE * m"), "SELECT uid, t, round(m, 4) AS smooth FROM series JOIN folded USING (uid, rn)", recursive=True))
def ema_smoothing(spark, sf_dir):
    return series.folded(panels.revenue_series(spark, sf_dir), ["x"], ["smooth"], lambda x: [series.smoothed(x, 0.1)]).withColumn("smooth", F.round("smooth", 4))


@query(o.sql(*fold_sql("0.08::DOUBLE * greatest(0.0::DOUBLE, x / 1e6::DOUBLE - 1)", "0.97::DOUBLE * m + 0.08::DOUBLE * greatest(0.0::DOUBLE, x / 1e6::DOUBLE - 1)"), "SELECT uid, t, round(m, 6) AS memory FROM series JOIN folded USING (uid, rn)", recursive=True))
def phi_memory_unfloored(spark, sf_dir):
    drive = panels.revenue_series(spark, sf_dir).withColumn("drive", 0.08 * F.greatest(F.lit(0.0), F.col("x") / 1e6 - 1))
    return series.folded(drive, ["drive"], ["memory"], lambda d: [series.plain_memory(d, 0.97)]).withColumn("memory", F.round("memory", 6))


SCALED = """scaled AS (SELECT uid, t, oh / (CASE WHEN s1 > 1e-12 THEN s1 ELSE 1 END) AS a, eta / (CASE WHEN s2 > 1e-12 THEN s2 ELSE 1 END) AS b, vol / (CASE WHEN s3 > 1e-12 THEN s3 ELSE 1 END) AS c FROM (
  SELECT *, stddev_pop(oh) OVER (PARTITION BY uid) AS s1, stddev_pop(eta) OVER (PARTITION BY uid) AS s2, stddev_pop(vol) OVER (PARTITION BY uid) AS s3 FROM ohs)
), moved AS (SELECT *, coalesce(a - lag(a) OVER w, 0) AS da, coalesce(b - lag(b) OVER w, 0) AS db, coalesce(c - lag(c) OVER w, 0) AS dc FROM scaled WINDOW w AS (PARTITION BY uid ORDER BY t))"""


@query(o.sql(*o.WINDOWS, SCALED, "SELECT uid, t, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs((a * da + b * db + c * dc) / ((sqrt(a * a + b * b + c * c) + 1e-12) * (sqrt(da * da + db * db + dc * dc) + 1e-12))))), 6) AS divergence FROM moved"))
def def_angular(spark, sf_dir):
    return series.phase_divergence(_oh_state(spark, sf_dir), ["oh", "eta", "vol"]).select("uid", "t", *r6("divergence"))


@query(o.sql(o.REVENUE, "v AS (SELECT *, CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2 END AS velocity FROM series WINDOW w AS (PARTITION BY uid ORDER BY t))", "SELECT uid, t, round(velocity, 6) AS velocity, round(abs(x - lag(x + velocity) OVER (PARTITION BY uid ORDER BY t)) / (abs(x) + 1e-12), 6) AS divergence FROM v"))
def def_euler_components(spark, sf_dir):
    return series.euler_divergence(panels.revenue_series(spark, sf_dir), "x").select("uid", "t", *r6("velocity", "divergence"))


def crossing_sql(x: str, threshold: str, persist: int, source: str) -> str:
    return f"(SELECT uid, min(t) FILTER (lo AND k = {persist}) AS crossing FROM (SELECT uid, t, bool_and({x} > {threshold}) OVER w AS lo, count(*) OVER w AS k FROM {source} WINDOW w AS (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND {persist - 1} FOLLOWING)) GROUP BY uid)"


@query(o.sql(*o.FULL, f"SELECT a.uid, a.crossing AS oh_one_2, b.crossing AS oh_one_5, c.crossing AS phi_2, d.crossing AS phi_3 FROM {crossing_sql('oh', '1.0', 2, 'state')} a JOIN {crossing_sql('oh', '1.0', 5, 'state')} b USING (uid) JOIN {crossing_sql('phi', 'phi_c', 2, 'state')} c USING (uid) JOIN {crossing_sql('phi', 'phi_c', 3, 'state')} d USING (uid)", recursive=True))
def persistent_crossings(spark, sf_dir):
    full = state.universe_state(spark, sf_dir)
    found = [series.first_crossing(full, "oh", 1.0, 2, "oh_one_2"), series.first_crossing(full, "oh", 1.0, 5, "oh_one_5"), series.first_crossing(full, "phi", F.col("phi_c"), 2, "phi_2"), series.first_crossing(full, "phi", F.col("phi_c"), 3, "phi_3")]
    out = found[0]
    for one in found[1:]:
        out = out.join(one, "uid")
    return out


@query(o.sql(*o.FULL, f"SELECT * FROM {crossing_sql('oh', 'least(1.0, o, 0.98)', 3, '(SELECT s.*, (SELECT o95 FROM limits l WHERE l.uid = s.uid) AS o FROM state s)')}", recursive=True))
def ensemble_crossing(spark, sf_dir):
    full = state.universe_state(spark, sf_dir)
    q95 = F.round(state.quantile_where(F.col("oh"), series.quiet(), 0.95, Window.partitionBy("uid")), 9)
    return series.first_crossing(full.withColumn("q95", q95), "oh", F.array_min(F.array(F.lit(1.0), F.col("q95"), F.lit(0.98))), 3)


#: Two tails of Student's t for a correlation r with df degrees, by gamma functions.
TAILS = """round(greatest(1 - CASE WHEN df % 2 = 0
  THEN r * coalesce(list_sum(list_transform(range(0, df // 2), lambda k: exp(lgamma(k + 0.5::DOUBLE) - lgamma(k + 1)) / sqrt(pi()) * pow(1 - r * r, k))), 0)
  ELSE 2 / pi() * (asin(r) + r * sqrt(1 - r * r) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5::DOUBLE)) * pow(1 - r * r, k))), 0)) END, 0), 6)"""


@query(o.sql(*o.FULL, f"""lims AS (SELECT uid, round(quantile_cont(oh, 0.90), 9) AS p90, round(quantile_cont(oh, 0.95), 9) AS p95 FROM state WHERE {o.CALM} GROUP BY uid
), years AS (SELECT s.*, p90, p95, year(t) AS year, row_number() OVER w AS i, lag(oh) OVER w AS before FROM state s JOIN lims USING (uid) WINDOW w AS (PARTITION BY s.uid, year(t) ORDER BY t)
), flagged AS (SELECT uid || '|' || year AS uid, t, oh > p90 AS flag FROM years)""", o.RUNS,
             "yearly AS (SELECT uid, CAST(year AS INTEGER) AS year, count(*) AS rows, round(252 * regr_slope(oh, i), 6) AS slope, count(*) - 2 AS df, CASE WHEN isfinite(corr(oh, i)) THEN least(abs(corr(oh, i)), 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS r, round(100 * avg(CAST(oh > p90 AS INTEGER)), 6) AS share_p90, round(100 * avg(CAST(oh > p95 AS INTEGER)), 6) AS share_p95, round(100 * avg(CAST(oh > 1 AS INTEGER)), 6) AS share_one, CASE WHEN isfinite(corr(oh, before)) THEN round(corr(oh, before), 6) END AS acf1, round(max(phi), 6) AS phi_max, coalesce((SELECT max(length) FROM runs r WHERE flag AND r.uid = years.uid || '|' || years.year), 0) AS longest FROM years GROUP BY uid, year HAVING count(*) >= 20)",
             f"SELECT * EXCLUDE (df, r), {TAILS} AS slope_p FROM yearly", recursive=True))
def warming_by_year(spark, sf_dir):
    return state.yearly_warming(state.universe_state(spark, sf_dir))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rigid, shifting and flowing weeks by order priority, with short windows for the smallest tables."""
    from dataclasses import replace

    return state.regime_summary(state.universe_state(spark, sf_dir, replace(STATE, window=6)))
