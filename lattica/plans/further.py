"""Queries on registries, rules, sliding baselines, recovery, streams and the rarer kernels."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica import streaming
from lattica.functions import kernels
from lattica.operators import attention, evaluate, events, rules, series, state, windows
from lattica.plans import oracle as o
from lattica.plans.catalog import all_returns, query, r6, trade_flows
from lattica.plans.evaluation import ATTENTION, labelled, matrices
from lattica.plans.monitoring import SPIKES, REPORT
from lattica.runtime import shared_dir, ship, table
from lattica.sources import panels

# Sliding baseline ------------------------------------------------------------------------------------------------

SLIDE = """slid AS (
  SELECT uid, t, rn, count(*) OVER w AS k, stddev_samp(x) OVER w / avg(x) OVER w AS cv, regr_slope(x, rn) OVER w AS slope, avg(x) OVER w AS m FROM series WINDOW w AS (PARTITION BY uid ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)
), scored AS (SELECT uid, t, round(cv, 9) AS cv, round(abs(slope) / m, 9) AS steepness, round(round(cv, 9) + round(abs(slope) / m, 9), 9) AS score FROM slid WHERE k = 60)"""


@query(o.sql(o.REVENUE, SLIDE, "SELECT uid, t, round(cv + 1e-11, 6) AS cv, round(steepness + 1e-11, 6) AS steepness, r AS rank, cv < 0.15 AND steepness < 0.01 AS valid FROM (SELECT *, CAST(row_number() OVER (PARTITION BY uid ORDER BY score, t) AS BIGINT) AS r FROM scored) WHERE r <= 20"))
def sliding_baselines(spark, sf_dir):
    found = rules.sliding_baselines(series.numbered(panels.revenue_series(spark, sf_dir)), "x", 60).where("rank <= 20")
    return found.select("uid", "t", *(F.round(F.col(c) + 1e-11, 6).alias(c) for c in ("cv", "steepness")), "rank", "valid")


@query(o.sql(o.REVENUE, """w30 AS (SELECT *, count(*) OVER w AS k, stddev_pop(x) OVER w AS s, regr_slope(x, rn) OVER w AS b FROM series WINDOW w AS (PARTITION BY uid ORDER BY t ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))""", "SELECT uid, t, round(CASE WHEN k = 30 THEN CASE WHEN s < 1e-15 THEN 0.0::DOUBLE ELSE b END END, 4) AS slope FROM w30"))
def memory_slope(spark, sf_dir):
    frame = rules.trailing_slope(series.numbered(panels.revenue_series(spark, sf_dir)), "x", 30)
    return frame.select("uid", "t", F.round("slope", 4).alias("slope"))


@query(o.sql(o.REVENUE, """q AS (SELECT uid, quantile_cont(x, 0.9) AS high FROM series GROUP BY uid
), ev AS (SELECT s.uid, min(rn) FILTER (x > high AND rn > 200) AS event FROM series s JOIN q USING (uid) GROUP BY s.uid)""",
             "SELECT s.uid, CASE WHEN rn - event < -30 THEN 'far' WHEN rn - event < 0 THEN 'near' ELSE 'after' END AS part, count(*) AS n, round(avg(x), 3) AS mean FROM series s JOIN ev USING (uid) WHERE rn - event >= -90 AND rn - event < 30 GROUP BY 1, 2"))
def dynamics_by_offset(spark, sf_dir):
    frame = series.numbered(panels.revenue_series(spark, sf_dir))
    high = F.percentile("x", F.lit(0.9)).over(Window.partitionBy("uid"))
    marked = frame.withColumn("high", high)
    event = marked.groupBy("uid").agg(F.min(F.when((F.col("x") > F.col("high")) & (F.col("rn") > 200), F.col("rn"))).alias("event"))
    return rules.by_offset(marked.join(event, "uid"), F.col("rn") - F.col("event"), "x", 3)


@query(o.sql(o.REVENUE, """m AS (SELECT uid, quantile_cont(x, 0.5) AS mid FROM series WHERE rn <= 300 GROUP BY uid
), f AS (SELECT s.uid, s.t, x > mid AS flag FROM series s JOIN m USING (uid)), flagged AS (SELECT * FROM f)""", o.RUNS, "SELECT uid, count(*) FILTER (flag) AS above_runs, max(length) FILTER (flag) AS longest, count(*) FILTER (NOT flag) AS recoveries, bool_or(flag AND \"start\" = (SELECT min(t) FROM series)) AS left_censored FROM runs GROUP BY uid"))
def left_censored_recovery(spark, sf_dir):
    frame = series.numbered(panels.revenue_series(spark, sf_dir))
    mid = F.percentile(F.when(F.col("rn") <= 300, F.col("x")), F.lit(0.5)).over(Window.partitionBy("uid"))
    return rules.recovery(frame.withColumn("mid", mid).withColumn("flag", F.col("x") > F.col("mid")))


# Registries and rules --------------------------------------------------------------------------------------------

REGISTRY = [("atlantic", "critical", ["AMERICA", "EUROPE"]), ("pacific", "high", ["AMERICA", "ASIA"]), ("south", "medium", ["AFRICA", "MIDDLE EAST"]), ("all", "low", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])]


@query(o.sql(o.WEEK_PANEL, "registry(name, level, assets) AS (VALUES " + ", ".join(f"('{n}', '{lv}', {a})" for n, lv, a in REGISTRY) + ")", "bridge AS (SELECT name, level, unnest(assets) AS asset FROM registry)", "SELECT name, level, count(DISTINCT asset) AS assets, count(*) AS cells, round(sum(x), 2) AS total FROM bridge JOIN panel USING (asset) GROUP BY name, level"))
def registry_universes(spark, sf_dir):
    registry = spark.createDataFrame(REGISTRY, "name string, level string, assets array<string>")
    return rules.registry_cells(panels.trade_panel(spark, sf_dir), registry).groupBy("name", "level").agg(F.countDistinct("asset").alias("assets"), F.count(F.lit(1)).alias("cells"), F.round(F.sum("x"), 2).alias("total"))


ROLES = [("AFRICA", "source"), ("AMERICA", "hub"), ("ASIA", "hub"), ("EUROPE", "hub"), ("MIDDLE EAST", "source")]
PAIR_CORR = o.EDGES.split("\n), edges AS")[0] + ")"


@query(o.sql(*o.ALL, PAIR_CORR, "roles(asset, role) AS (VALUES " + ", ".join(map(str, ROLES)) + ")", "c AS (SELECT uid, a, b, round(corr(ra, rb), 6) AS corr FROM pairs GROUP BY 1, 2, 3)",
             "SELECT uid, a, b, corr, CASE WHEN p.role = 'hub' AND q.role = 'hub' AND corr > 0.05 THEN 'hubs_lock' WHEN p.role = 'hub' AND q.role = 'hub' THEN 'hubs_apart' WHEN p.role <> q.role AND corr > 0.05 THEN 'transmission' WHEN p.role <> q.role AND corr < -0.05 THEN 'substitution' WHEN corr > 0.05 THEN 'sources_lock' ELSE 'independent' END AS rule FROM c JOIN roles p ON p.asset = a JOIN roles q ON q.asset = b"))
def pair_role_rules(spark, sf_dir):
    return rules.pair_rules(all_returns(spark, sf_dir), spark.createDataFrame(ROLES, "asset string, role string"))


@query(o.sql(*o.FULL, SPIKES, REPORT, """f AS (SELECT uid, unnest(['peak', 'frozen', 'loaded', 'calm']) AS insight, unnest([oh_max > 0.97, tau_max >= 10, phi_max > 0.5, n_spikes = 0 AND tau_max < 10]) AS holds FROM statuses)""", "SELECT uid, insight FROM f WHERE holds", recursive=True))
def insight_rules(spark, sf_dir):
    report = events.universe_report(state.universe_state(spark, sf_dir))
    return rules.insights(report, {"peak": F.col("oh_max") > 0.97, "frozen": F.col("tau_max") >= 10, "loaded": F.col("phi_max") > 0.5, "calm": (F.col("n_spikes") == 0) & (F.col("tau_max") < 10)})


WEIGHTS = [(k, round(0.1 * (k % 4), 1), round(0.1 * (k % 7), 1), round(0.1 * (k % 5), 1)) for k in range(12)]
LABELLED = """labelled AS (
  SELECT l.quality AS y, CAST(n_chars AS DOUBLE) / 1000 AS f1, round(CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) / greatest(length(text), 1), 9) AS f2, round(CAST(length(text) - length(replace(text, '!', '')) AS DOUBLE) / greatest(length(text), 1), 9) AS f3 FROM documents d JOIN labels l USING (doc_id)
), weights(k, w1, w2, w3) AS (VALUES """ + ", ".join(map(str, WEIGHTS)) + """)
, scored AS (SELECT k AS g, y, round(-w1::DOUBLE * f1 + w2::DOUBLE * f2 - 10 * w3::DOUBLE * f3, 9) AS score FROM labelled, weights
), th AS (SELECT g, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY g, score
), cum AS (SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY score DESC) AS tp, sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS n FROM th)"""


@query(o.sql(LABELLED, "SELECT CAST(g AS BIGINT) AS g, round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (any_value(p) * any_value(n)), 6) AS auc FROM cum GROUP BY g"))
def weight_search(spark, sf_dir):
    """Separation under each of a stated list of weights, which goes along with every row."""
    rows = labelled(spark, sf_dir).select(F.col("quality").alias("y"), (F.col("length") / 1000).alias("f1"), F.round("spaces", 9).alias("f2"), F.round("marks", 9).alias("f3"))
    stated = F.array(*[F.struct(F.lit(k).cast("long").alias("g"), F.lit(a).alias("w1"), F.lit(b).alias("w2"), F.lit(c).alias("w3")) for k, a, b, c in WEIGHTS])
    each = rows.withColumn("w", F.explode(stated))
    scored = each.select(F.col("w.g").alias("g"), "y", F.round(-F.col("w.w1") * F.col("f1") + F.col("w.w2") * F.col("f2") - 10 * F.col("w.w3") * F.col("f3"), 9).alias("score"))
    return evaluate.rank_auc(scored).select("g", "auc")


@query(o.sql(ATTENTION, "SELECT p.g AS a, q.g AS b, round(corr(p.a, q.a), 6) + 0.0::DOUBLE AS c FROM att p JOIN att q ON p.i = q.i AND p.j = q.j AND p.g < q.g WHERE p.g <> 'uniform' AND q.g <> 'uniform' GROUP BY 1, 2"))
def head_correlation(spark, sf_dir):
    heads = attention.synthetic_attention(spark, 12).where("g <> 'uniform'")
    return rules.head_correlation(heads).withColumn("c", F.col("c") + 0.0)


@query(o.sql(ATTENTION, "SELECT g, omega AS oh, eta, xi AS mean_corr, round(greatest(0.0::DOUBLE, 1 - gini), 6) AS divergence, CASE WHEN eta > 0.5 THEN 'rigid' WHEN eta > 0.2 THEN 'shift' ELSE 'flow' END AS regime FROM family"))
def attention_to_state(spark, sf_dir):
    f = attention.entropy_family(matrices(spark, sf_dir))
    regime = F.when(F.col("eta") > 0.5, "rigid").when(F.col("eta") > 0.2, "shift").otherwise("flow")
    return f.select("g", F.col("omega").alias("oh"), "eta", F.col("xi").alias("mean_corr"), F.round(F.greatest(F.lit(0.0), 1 - F.col("gini")), 6).alias("divergence"), regime.alias("regime"))


# Streams ---------------------------------------------------------------------------------------------------------


@query(o.sql("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR"))
def stream_hourly(spark, sf_dir):
    """Tumbling windows over the event stream: each is written once, when the watermark has passed its end.

    Windows that may still change when the stream ends are not among them.
    """
    ship(spark)
    place = f"{shared_dir(spark)}/lattica/stream-{uuid.uuid4().hex}"
    found = streaming.windowed(streaming.event_stream(spark, sf_dir, name="events.parquet"))
    running = found.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    start = F.date_trunc("hour", "start").cast("timestamp_ntz")
    return spark.read.schema(found.schema).parquet(f"{place}/out").select(start.alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query(o.sql("""g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events)""", "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)", "SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"))
def session_windows(spark, sf_dir):
    raw = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = raw.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


# Rarer kernels: no SQL ---------------------------------------------------------------------------------------------


@query()
def topological_shift(spark, sf_dir):
    """Wasserstein distance of each window's cycles from those of the quiet share's middle window."""
    return windows.topological_shift(all_returns(spark, sf_dir))


@query()
def cubical_lifetimes(spark, sf_dir):
    """Longest loop of each attention matrix as a height field."""

    def compute(rows: pa.Table) -> pa.Table:
        n = int(max(rows["i"].to_numpy().max(), rows["j"].to_numpy().max())) + 1
        a = np.zeros((n, n))
        a[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["a"].to_numpy()
        life = kernels.cubical_loops(1 - a / max(a.max(), 1e-12))
        longest = max(life, default=0.0)
        return pa.table({"g": [rows["g"][0].as_py()], "loops": [len(life)], "longest": [float(longest)], "r": [float(np.log1p(longest / (n + 1e-12)))]})

    return matrices(spark, sf_dir).groupBy("g").applyInArrow(compute, "g string, loops long, longest double, r double")


@query()
def communities(spark, sf_dir):
    """Groups of each order year's trade graph by greedy modularity, and edges inside and between them."""
    flows = trade_flows(spark, sf_dir, "CAST(year(o_orderdate) AS BIGINT) AS g")
    whole = Window.partitionBy("g")
    strong = flows.withColumn("strong", 100 * F.col("n") * F.count(F.lit(1)).over(whole) > 110 * F.sum("n").over(whole)).where("strong")

    def compute(rows: pa.Table) -> pa.Table:
        edges = sorted(zip(rows["u"].to_pylist(), rows["v"].to_pylist(), strict=True))
        names = sorted({x for e in edges for x in e})
        number = {x: k for k, x in enumerate(names)}
        group = kernels.modularity_groups(len(names), [(number[a], number[b]) for a, b in edges])
        inside = sum(group[number[a]] == group[number[b]] for a, b in edges)
        return pa.table({"g": [rows["g"][0].as_py()], "groups": [len(set(group.tolist()))], "intra": [int(inside)], "inter": [len(edges) - int(inside)]})

    # a graph has as many edges as pairs of nations at most
    return strong.select("g", "u", "v").groupBy("g").applyInArrow(compute, "g long, groups long, intra long, inter long")
