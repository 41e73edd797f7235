"""Queries on capacity, hazard, targets and monitoring, registered in the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.config import HAZARD, STATE
from lattica.operators import events, hazard, series, state, windows
from lattica.plans import oracle as o
from lattica.plans.catalog import _oh_state, query, r6
from lattica.runtime import remembered, table, written
from lattica.sources import panels

STAR = f"""{o.knee_sql('state', 'phi')}
, starred AS MATERIALIZED (
  SELECT s.*, knee < 1e-4::DOUBLE AS estimated, CASE WHEN knee >= 1e-4::DOUBLE THEN knee ELSE greatest(round(2 * max(phi) OVER (PARTITION BY s.uid), 9), 1e-4::DOUBLE) END AS phi_star FROM state s JOIN knees USING (uid))"""
CAPACITY = """spent AS MATERIALIZED (
  SELECT *, round(phi_star - phi, 9) AS capacity, round(round(phi_star - phi, 9) / phi_star, 9) AS capacity_share,
         round(greatest(0.0::DOUBLE, least(20.0::DOUBLE, ln(phi_star / greatest(round(phi_star - phi, 9), 1e-12)))), 9) AS fragility,
         round(greatest(oh - oh_pre - 0.97::DOUBLE * 0.08::DOUBLE, 0.0::DOUBLE) - 0.03::DOUBLE * coalesce(lag(phi) OVER (PARTITION BY uid ORDER BY t), 0.0::DOUBLE), 9) AS depletion FROM starred
), smooth(uid, rn, m) AS (
  SELECT uid, rn, depletion FROM spent WHERE rn = 1 UNION ALL SELECT f.uid, f.rn + 1, 0.1::DOUBLE * s.depletion + 0.9::DOUBLE * f.m FROM smooth f JOIN spent s ON s.uid = f.uid AND s.rn = f.rn + 1
), capacities AS MATERIALIZED (SELECT s.*, round(m, 9) AS depletion_mean FROM spent s JOIN smooth USING (uid, rn))"""
ETA = f"""etas(uid, rn, m) AS (
  SELECT uid, rn, eta FROM state WHERE rn = 1 UNION ALL SELECT f.uid, f.rn + 1, 0.1::DOUBLE * s.eta + 0.9::DOUBLE * f.m FROM etas f JOIN state s ON s.uid = f.uid AND s.rn = f.rn + 1
), normed AS MATERIALIZED (
  SELECT c.*, round(greatest(0.0::DOUBLE, least(5.0::DOUBLE, e.m / greatest(avg(e.m) FILTER ({o.CALM}) OVER (PARTITION BY c.uid), 1e-12))), 9) AS eta_norm FROM capacities c JOIN etas e USING (uid, rn))"""


def logit(b: tuple[float, ...]) -> str:
    return f"round(1 / (1 + exp(-greatest(-20.0::DOUBLE, least(20.0::DOUBLE, {b[0]}::DOUBLE + {b[1]}::DOUBLE * fragility + {b[2]}::DOUBLE * greatest(depletion_mean, 0.0::DOUBLE) + {b[3]}::DOUBLE * eta_norm + {b[4]}::DOUBLE * theta)))), 12)"


HAZARDS = f"""{o.recurrence_sql('state', 'mean_corr')}
, thetas AS (SELECT c.*, r.theta, r.geometry FROM normed c JOIN recurred r USING (uid, rn)
), hz AS (SELECT *, {logit(HAZARD.beta_90)} AS h90, {logit(HAZARD.beta_60)} AS h60 FROM thetas
), hazards AS MATERIALIZED (
  SELECT *, 1 - pow(1 - h90, 30) AS p30, 1 - pow(1 - h60, 60) AS p60, 1 - pow(1 - h90, 90) AS p90, greatest(0.0::DOUBLE, least(1e6::DOUBLE, ln(0.5::DOUBLE) / ln(1 - h90))) AS half_life_90 FROM hz)"""
SPENT = (*o.FULL, STAR, CAPACITY)
RISK = (*SPENT, ETA, HAZARDS)


def starred(spark, sf_dir):
    """The state with its capacity ``phi_star``: the knee of its memory, or an estimate where it has none."""
    return hazard.with_capacity_limit(state.universe_state(spark, sf_dir))


def hazards(spark, sf_dir):
    """The chain from state to hazard: capacity up to the memory's knee, strength of the attractor from recurrences.

    Recurrence is that of the mean coupling, which varies in quiet times too; the memory at its floor would say nothing.
    """

    def build():
        full = state.universe_state(spark, sf_dir)
        strength = windows.recurrence_series(full.select("uid", "t", F.col("mean_corr").alias("x"))).select("uid", "t", F.round("theta", 9).alias("theta"), "geometry")
        return hazard.with_hazard(hazard.normal_rigidity(written(hazard.capacity(hazard.with_capacity_limit(full)), "capacity")).join(strength, ["uid", "t"]))

    return remembered(spark, ("hazards", sf_dir, STATE, HAZARD), sf_dir, ("orders", "customer", "nation", "region"), build)


@query(o.sql(*SPENT, "SELECT uid, t, round(capacity, 6) + 0.0::DOUBLE AS capacity, round(capacity_share, 6) + 0.0::DOUBLE AS capacity_share, round(fragility, 6) AS fragility, round(depletion_mean, 6) + 0.0::DOUBLE AS depletion_mean FROM capacities", recursive=True))
def capacity_fragility(spark, sf_dir):
    found = hazard.capacity(starred(spark, sf_dir))
    return found.select("uid", "t", *((F.round(c, 6) + 0.0).alias(c) for c in ("capacity", "capacity_share")), *r6("fragility"), (F.round("depletion_mean", 6) + 0.0).alias("depletion_mean"))


@query(o.sql(*SPENT, """SELECT uid, t, oh < 1 AND capacity_share < 0.6 AND coalesce(max(CAST(regime = 'rigid' AS INTEGER)) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), 0) = 1 AS false_recovery FROM capacities""", recursive=True))
def false_recovery(spark, sf_dir):
    from dataclasses import replace

    return hazard.capacity(starred(spark, sf_dir), replace(HAZARD, recovery_share=0.6)).select("uid", "t", "false_recovery")


@query(o.sql(o.REVENUE, f"""lagged AS (SELECT *, lag(x) OVER w AS before FROM series WINDOW w AS (PARTITION BY uid ORDER BY t)
), ac AS (
  SELECT *, count(*) OVER outer_w = 40 AS whole, stddev_pop(x) OVER outer_w AS s, corr(x, before) OVER inner_w AS c FROM lagged
  WINDOW outer_w AS (PARTITION BY uid ORDER BY t ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), inner_w AS (PARTITION BY uid ORDER BY t ROWS BETWEEN 39 PRECEDING AND 1 PRECEDING)
), scored AS (SELECT uid, t, rn, n, CASE WHEN whole THEN coalesce(c, 0) END AS ar1, CASE WHEN whole THEN s END AS sigma FROM ac
), quiets AS (SELECT uid, avg(ar1) AS ma, stddev_pop(ar1) AS sa, avg(sigma) AS ms, stddev_pop(sigma) AS ss FROM scored WHERE {o.CALM} GROUP BY uid)""",
             "SELECT uid, t, round(ar1, 6) AS ar1, round(sigma, 3) AS sigma, round(coalesce((ar1 - ma) / greatest(sa, 1e-12) + (sigma - ms) / greatest(ss, 1e-12), 0.0::DOUBLE), 6) AS slowing FROM scored JOIN quiets USING (uid)"))
def csd_indicator(spark, sf_dir):
    frame = series.numbered(panels.revenue_series(spark, sf_dir))
    return series.slowing(frame, "x", HAZARD.slowing_window, series.quiet()).select("uid", "t", *r6("ar1"), F.round("sigma", 3).alias("sigma"), *r6("slowing"))


@query(o.sql(*RISK, "SELECT uid, t, round(eta_norm + 1e-11, 6) AS eta_norm, round(h90, 6) AS h90, round(h60, 6) AS h60, round(p30, 6) AS p30, round(p60, 6) AS p60, round(p90, 6) AS p90, round(half_life_90, 4) AS half_life_90 FROM hazards", recursive=True))
def hazard_dual_horizon(spark, sf_dir):
    return hazards(spark, sf_dir).select("uid", "t", F.round(F.col("eta_norm") + 1e-11, 6).alias("eta_norm"), *r6("h90", "h60", "p30", "p60", "p90"), F.round("half_life_90", 4).alias("half_life_90"))


ALERT = "CASE WHEN capacity_share < 0 OR (h90 >= 0.10 AND capacity_share < 0.5) THEN 'EMERGENCY' WHEN (h90 >= 0.02 AND capacity_share < 0.7) OR half_life_90 < 90 THEN 'WARNING' WHEN capacity_share < 0.5 OR fragility > 1.5 THEN 'WATCH' ELSE 'NOMINAL' END"


@query(o.sql(*RISK, f"SELECT uid, t, CASE WHEN estimated THEN 'BASELINE_INSUFFICIENT' ELSE {ALERT} END AS alert_level FROM hazards", recursive=True))
def alert_levels(spark, sf_dir):
    return hazards(spark, sf_dir).select("uid", "t", hazard.alert_level(F.col("estimated")).alias("alert_level"))


@query(o.sql(*RISK, """SELECT uid, t, round(CASE WHEN max(abs(theta)) OVER (PARTITION BY uid) > 1e-12 THEN least(greatest(fragility, 0.0::DOUBLE) / 2.0::DOUBLE, 1.0::DOUBLE) * greatest(least(theta, 1.0::DOUBLE), 0.0::DOUBLE) ELSE least(greatest(fragility, 0.0::DOUBLE) / 2.0::DOUBLE, 1.0::DOUBLE) END, 6) AS pressure FROM hazards""", recursive=True))
def pcs(spark, sf_dir):
    return hazard.combined_pressure(hazards(spark, sf_dir)).select("uid", "t", *r6("pressure"))


@query(o.sql(*RISK, "SELECT uid, t, round(CASE WHEN theta > 0 THEN theta * oh / (oh_pre + 0.08::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS sensitivity, CASE WHEN theta * oh / (oh_pre + 0.08::DOUBLE) > 1 THEN 'EXTREME' WHEN theta * oh / (oh_pre + 0.08::DOUBLE) > 0.5 THEN 'HIGH' WHEN theta * oh / (oh_pre + 0.08::DOUBLE) > 0.1 THEN 'MODERATE' ELSE 'LOW' END AS level, round(oh_pre + 0.08::DOUBLE - oh, 6) AS barrier_gap FROM hazards", recursive=True))
def impact_sensitivity(spark, sf_dir):
    barrier = F.col("oh_pre") + 0.08
    s = F.col("theta") * F.col("oh") / barrier
    level = F.when(s > 1, "EXTREME").when(s > 0.5, "HIGH").when(s > 0.1, "MODERATE").otherwise("LOW")
    return hazards(spark, sf_dir).select("uid", "t", F.round(F.when(F.col("theta") > 0, s).otherwise(0.0), 6).alias("sensitivity"), level.alias("level"), F.round(barrier - F.col("oh"), 6).alias("barrier_gap"))


# Targets ---------------------------------------------------------------------------------------------------------


@query(o.sql(*o.WINDOWS, "SELECT uid, t, max(CAST(oh > 0.9 AS INTEGER)) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS target FROM ohs"))
def forward_target_h(spark, sf_dir):
    return events.forward_target(_oh_state(spark, sf_dir), F.col("oh") > 0.9, 12).select("uid", "t", "target")


@query(o.sql(*o.WINDOWS, "firsts AS (SELECT uid, min(rn) FILTER (oh > 0.9) AS event FROM ohs GROUP BY uid)", "SELECT o.uid, o.t, coalesce(CAST(event - rn <= 12 AS INTEGER), 0) AS target FROM ohs o JOIN firsts f USING (uid) WHERE event IS NULL OR rn < event"))
def first_crossing_target(spark, sf_dir):
    return events.censored_target(_oh_state(spark, sf_dir), F.col("oh") > 0.9, 12).select("uid", "t", "target")


# Monitoring ------------------------------------------------------------------------------------------------------

SPIKES = """flagged AS (SELECT uid, t, oh, oh > 1.0 AS flag FROM state
), marked AS (SELECT *, sum(CASE WHEN flag IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY t) AS island FROM (SELECT *, lag(flag) OVER (PARTITION BY uid ORDER BY t) AS before FROM flagged)
), spikes AS (SELECT uid, min(t) AS "start", max(t) AS "end", count(*) AS length, round(max(oh), 6) AS peak FROM marked WHERE flag GROUP BY uid, island HAVING count(*) >= 3)"""
REPORT = """rigid_runs AS (
  SELECT uid, island, count(*) AS length FROM (SELECT *, sum(CASE WHEN regime IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY t) AS island FROM (SELECT *, lag(regime) OVER (PARTITION BY uid ORDER BY t) AS b FROM state)) WHERE regime = 'rigid' GROUP BY uid, island
), reports0 AS (
  SELECT uid, count(*) AS rows, round(max(oh), 6) AS oh_max, round(max(phi), 6) AS phi_max, arg_max(regime, t) AS regime, min(t) FILTER (phi > phi_c) AS phi_crossing FROM state GROUP BY uid
), reports AS (
  SELECT r.*, coalesce((SELECT max(length) FROM rigid_runs x WHERE x.uid = r.uid), 0) AS tau_max, coalesce((SELECT count(*) FROM spikes x WHERE x.uid = r.uid), 0) AS n_spikes FROM reports0 r
), statuses AS (SELECT *, CASE WHEN n_spikes > 0 THEN 'CRITICAL' WHEN tau_max > 60 THEN 'PRESSURIZED' WHEN phi_crossing IS NOT NULL THEN 'MONITORING' ELSE 'HEALTHY' END AS status FROM reports)"""


@query(o.sql(*o.FULL, SPIKES.replace("oh > 1.0", "oh > 0.97"), 'SELECT uid, "start", "end", length, peak FROM spikes', recursive=True))
def oh_spikes(spark, sf_dir):
    return events.spikes(state.universe_state(spark, sf_dir), threshold=0.97)


@query(o.sql(*o.FULL, SPIKES, REPORT, "SELECT uid, rows, oh_max, phi_max, regime, phi_crossing, CAST(tau_max AS BIGINT) AS tau_max, CAST(n_spikes AS BIGINT) AS n_spikes, status FROM statuses", recursive=True))
def universe_report_status(spark, sf_dir):
    return events.universe_report(state.universe_state(spark, sf_dir))


@query(o.sql(*o.FULL, SPIKES, REPORT, "SELECT round(least(100.0::DOUBLE, 25 * avg(oh_max * CASE status WHEN 'CRITICAL' THEN 3.0::DOUBLE WHEN 'PRESSURIZED' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)), 1) AS risk, count(*) AS universes, count(*) FILTER (oh_max > 1.0) AS over_one, count(*) FILTER (regime = 'rigid') AS rigid FROM statuses", recursive=True))
def global_risk_score(spark, sf_dir):
    return events.global_risk(events.universe_report(state.universe_state(spark, sf_dir)))


@query(o.sql(*o.WINDOWS, "SELECT uid, t, round(oh, 6) AS oh FROM ohs WHERE (rn - 1) % 5 = 0"))
def sparkline(spark, sf_dir):
    return events.sparkline(_oh_state(spark, sf_dir))


@query(o.sql(*o.WINDOWS, """ats AS (SELECT uid, max(oh) FILTER (rn = n) AS now, max(oh) FILTER (rn = n - 6) AS week, max(oh) FILTER (rn = n - 29) AS month FROM ohs GROUP BY uid
), ranks AS (SELECT o.uid, round(100 * avg(CAST(o.oh < a.now AS INTEGER)), 6) AS percentile FROM ohs o JOIN ats a USING (uid) GROUP BY o.uid)""",
             "SELECT uid, round(now, 6) AS current, round(now - week, 6) AS delta_7, round(now - month, 6) AS delta_30, CASE WHEN round(now - week, 6) > 0.05 THEN 'rising' WHEN round(now - week, 6) < -0.05 THEN 'falling' ELSE 'stable' END AS direction, percentile FROM ats JOIN ranks USING (uid)"))
def percentile_rank(spark, sf_dir):
    return events.recent_trend(_oh_state(spark, sf_dir))


@query(o.sql(*o.FULL, "flagged AS (SELECT uid, t, regime AS flag FROM state)", o.RUNS, """lasts AS (SELECT uid, arg_max(flag, "end") AS regime, arg_max(length, "end") AS duration FROM runs GROUP BY uid)""",
             "SELECT l.uid, l.regime, duration, round(avg(length), 6) AS mean_duration, max(length) AS max_duration, duration > round(avg(length), 6) AS above_average FROM lasts l JOIN runs r ON r.uid = l.uid AND r.flag = l.regime GROUP BY l.uid, l.regime, duration", recursive=True))
def regime_duration(spark, sf_dir):
    return events.regime_duration(state.universe_state(spark, sf_dir))


TIMELINE = """base AS (SELECT *, lag(regime) OVER w AS before, lag(oh) OVER w AS oh_before, max(t) OVER (PARTITION BY uid) AS last FROM state WINDOW w AS (PARTITION BY uid ORDER BY t)
), isl AS (SELECT *, sum(CASE WHEN regime IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY t) AS island FROM base
), tenth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid, island ORDER BY t) AS k FROM isl WHERE regime = 'rigid') WHERE k = 10
), modes AS (SELECT uid, q, regime FROM (SELECT uid, date_trunc('quarter', t) AS q, regime, row_number() OVER (PARTITION BY uid, date_trunc('quarter', t) ORDER BY count(*) DESC, regime) AS r FROM state GROUP BY 1, 2, 3) WHERE r = 1)"""
SEVERE = "CASE regime WHEN 'rigid' THEN 'critical' WHEN 'shift' THEN 'warning' ELSE '{calm}' END"


@query(o.sql(*o.FULL, TIMELINE, f"""SELECT uid, t, 'regime_change' AS type, before || '>' || regime AS detail, {SEVERE.format(calm="healthy")} AS severity FROM base WHERE before IS NOT NULL AND before <> regime
UNION ALL SELECT uid, t, 'oh_spike', '', 'critical' FROM base WHERE oh > 1 AND coalesce(oh_before, 0) <= 1
UNION ALL SELECT uid, min(t), 'phi_crossing', '', 'warning' FROM base WHERE phi > phi_c AND phi_c > 1e-5 GROUP BY uid
UNION ALL SELECT uid, min(t) - 9, 'sustained_rigidity', '', 'warning' FROM tenth GROUP BY uid, date_trunc('month', t)
UNION ALL SELECT s.uid, min(s.t), 'quarterly_snapshot', any_value(m.regime), 'info' FROM state s JOIN modes m ON m.uid = s.uid AND m.q = date_trunc('quarter', s.t) GROUP BY s.uid, m.q
UNION ALL SELECT uid, t, 'current_state', regime, {SEVERE.format(calm="info")} FROM base WHERE t = last""", recursive=True))
def timeline_events(spark, sf_dir):
    return events.timeline(state.universe_state(spark, sf_dir))


LINKS = [("1-URGENT", "2-HIGH"), ("2-HIGH", "3-MEDIUM"), ("3-MEDIUM", "4-NOT SPECIFIED"), ("4-NOT SPECIFIED", "5-LOW"), ("1-URGENT", "5-LOW")]


@query(o.sql(*o.FULL, SPIKES, REPORT, f"""links(source, target) AS (VALUES {', '.join(map(str, LINKS))})""",
             "SELECT source, target, a.status AS source_status, b.status AS target_status, CASE WHEN a.status IN ('CRITICAL', 'PRESSURIZED') AND b.status IN ('CRITICAL', 'PRESSURIZED') THEN 'CONTAGION' WHEN a.status IN ('CRITICAL', 'PRESSURIZED') OR b.status IN ('CRITICAL', 'PRESSURIZED') THEN 'CONTAINED' ELSE 'CALM' END AS rule FROM links JOIN statuses a ON a.uid = source JOIN statuses b ON b.uid = target", recursive=True))
def cross_universe_rules(spark, sf_dir):
    return events.contagion(events.universe_report(state.universe_state(spark, sf_dir)), spark.createDataFrame(LINKS, "source string, target string"))


def lasting_sql(x: str, threshold: str, persist: int, source: str, whole: bool = True) -> str:
    """``uid, crossing, event_rn``: the first row from which x stays above for ``persist`` rows (``whole``: up to the last)."""
    upto = "" if whole else f" AND rn <= n - {persist}"
    return f"SELECT uid, min(t) FILTER (lo AND k = {persist}{upto}) AS crossing, min(rn) FILTER (lo AND k = {persist}{upto}) AS event_rn FROM (SELECT uid, t, rn, n, bool_and({x} > {threshold}) OVER w AS lo, count(*) OVER w AS k FROM {source} WINDOW w AS (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND {persist - 1} FOLLOWING)) GROUP BY uid"


GEOMETRY = f"""strong AS ({lasting_sql('theta', '0.5::DOUBLE', 5, 'hazards', whole=False)}
), weak AS ({lasting_sql('theta', '0.1::DOUBLE', 5, 'hazards', whole=False)}
), geo AS (SELECT uid, coalesce(s.crossing, w.crossing) AS crossing, coalesce(s.event_rn, w.event_rn) AS event_rn, CASE WHEN s.crossing IS NOT NULL THEN 0.5::DOUBLE WHEN w.crossing IS NOT NULL THEN 0.1::DOUBLE END AS threshold FROM strong s JOIN weak w USING (uid)
), struc AS (SELECT uid, min(t) FILTER (capacity_share < 0.9::DOUBLE) AS crossing, min(rn) FILTER (capacity_share < 0.9::DOUBLE) AS event_rn FROM hazards GROUP BY uid)"""


def geometric_crossing(frame):
    """When the attractor's strength first stays up, at half or else at a tenth: ``uid, crossing, event_rn, threshold``."""
    return events.crossing_with_fallback(frame, "theta", (0.5, 0.1), 5)


@query(o.sql(*RISK, GEOMETRY, "SELECT uid, crossing, event_rn, threshold FROM geo", recursive=True))
def geometric_crossings(spark, sf_dir):
    return geometric_crossing(hazards(spark, sf_dir))


@query(o.sql(*RISK, GEOMETRY, """SELECT g.uid, g.crossing AS t_geometry, s.crossing AS t_structure, CAST(s.crossing - g.crossing AS BIGINT) AS lead_days,
  CASE WHEN s.crossing IS NULL AND g.crossing IS NULL THEN 'NO_SIGNAL' WHEN s.crossing IS NULL THEN 'GEOMETRY_ONLY' WHEN s.event_rn < 60 THEN 'LEFT_CENSORED' WHEN g.crossing IS NULL THEN 'STRUCTURE_ONLY' WHEN s.crossing - g.crossing > 0 THEN 'GEOMETRY_LEADS' WHEN s.crossing - g.crossing = 0 THEN 'SIMULTANEOUS' ELSE 'STRUCTURE_LEADS' END AS verdict FROM geo g JOIN struc s USING (uid)""", recursive=True))
def lead_times(spark, sf_dir):
    full = hazards(spark, sf_dir)
    worn = F.col("capacity_share") < 0.9
    structure = full.groupBy("uid").agg(F.min(F.when(worn, F.col("t"))).alias("crossing"), F.min(F.when(worn, F.col("rn"))).alias("event_rn"))
    return events.lead_times(geometric_crossing(full).select("uid", "crossing"), structure)


@query(o.sql(*RISK, "SELECT uid, t, CASE WHEN capacity_share < 0.9::DOUBLE THEN 'DAMAGED' WHEN theta >= 2 THEN 'CRYSTALLIZED' WHEN theta > 0.1::DOUBLE THEN 'CRYSTALLIZING' ELSE 'NOMINAL' END AS label FROM hazards", recursive=True))
def structural_labels(spark, sf_dir):
    return hazards(spark, sf_dir).select("uid", "t", hazard.structural_label(F.col("theta"), F.col("capacity_share")).alias("label"))


HOURS = """hours AS (SELECT *, hour(t) AS h FROM (SELECT date_trunc('hour', ts) AS t, round(avg(value), 6) AS oh, round(stddev_pop(value), 6) AS eta, count(DISTINCT user_id) AS xi, round(corr(value, user_id), 6) AS mean_corr FROM events GROUP BY 1))"""
DIRECTION = {"oh": 1, "eta": 1, "xi": -1}


@query(o.sql(HOURS, "long AS (SELECT h BETWEEN 9 AND 16 AS stress, unnest(['oh', 'eta', 'xi']) AS observable, unnest([oh, eta, CAST(xi AS DOUBLE)]) AS v FROM hours)", "means AS (SELECT observable, avg(v) FILTER (stress) AS s, avg(v) FILTER (NOT stress) AS c FROM long GROUP BY 1)",
             "SELECT observable, round(s, 6) AS stressed, round(c, 6) AS calm, round(s - c, 6) AS delta, round(s - c, 6) * CASE observable WHEN 'xi' THEN -1 ELSE 1 END > 0 AS confirmed FROM means"))
def direction_test(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    hours = source.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t")).agg(F.round(F.avg("value"), 6).alias("oh"), F.round(F.stddev_pop("value"), 6).alias("eta"), F.countDistinct("user_id").alias("xi"))
    return events.direction_test(hours, F.hour("t").between(9, 16), DIRECTION)


@query(o.sql("days AS (SELECT CAST(ts AS DATE) AS t, round(avg(value), 6) AS v FROM events GROUP BY 1)", "windows(name, low, high, during) AS (VALUES ('first', DATE '2024-01-05', DATE '2024-01-09', DATE '2024-01-15'), ('second', DATE '2024-01-12', DATE '2024-01-17', DATE '2024-01-24'))",
             "SELECT name, count(*) FILTER (t < high) AS n_before, count(*) FILTER (t >= high) AS n_during, round(avg(v) FILTER (t < high), 6) AS before, round(avg(v) FILTER (t >= high), 6) AS during FROM windows JOIN days ON t BETWEEN low AND during - 1 GROUP BY name HAVING count(*) FILTER (t < high) >= 4 AND count(*) FILTER (t >= high) >= 4"))
def event_window_compare(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("t")).agg(F.round(F.avg("value"), 6).alias("v"))
    rows = [("first", "2024-01-05", "2024-01-09", "2024-01-15"), ("second", "2024-01-12", "2024-01-17", "2024-01-24")]
    stated = spark.createDataFrame(rows, "name string, low string, high string, last string").select("name", *(F.to_date(c).alias(c) for c in ("low", "high", "last")))
    joined = days.join(F.broadcast(stated), (F.col("t") >= F.col("low")) & (F.col("t") < F.col("last")))
    before = F.col("t") < F.col("high")
    summed = joined.groupBy("name").agg(F.count_if(before).alias("n_before"), F.count_if(~before).alias("n_during"), F.round(F.avg(F.when(before, F.col("v"))), 6).alias("before"), F.round(F.avg(F.when(~before, F.col("v"))), 6).alias("during"))
    return summed.where("n_before >= 4 AND n_during >= 4")


BANDS = [(0.0, 10.0, "low", 1), (8.0, 40.0, "middle", 2), (35.0, 1e9, "high", 3), (90.0, 95.0, "artefact", 9)]


@query(o.sql(f"bands(low, high, label, priority) AS (VALUES {', '.join(map(str, BANDS))})", "SELECT event_id AS id, value AS x, coalesce(arg_max(label, priority), 'normal') AS label FROM events LEFT JOIN bands ON value BETWEEN low AND high GROUP BY event_id, value"))
def interval_labels(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"))
    return events.interval_labels(points, spark.createDataFrame(BANDS, "low double, high double, label string, priority int"))


EVENT_SERIES = "series AS (SELECT event_type AS uid, date_trunc('hour', ts) AS t, round(avg(value), 6) AS x FROM events GROUP BY 1, 2)"


@query(o.sql(EVENT_SERIES, "flagged AS (SELECT uid, t, x > 55 AS flag FROM series)", o.RUNS, "placed AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY t) AS rn FROM series)", "exc AS (SELECT uid, count(*) AS n_excursions, max(length) AS longest, count(*) FILTER (length >= 2) AS recurrent FROM runs WHERE flag GROUP BY uid)",
             "SELECT p.uid, count(*) AS rows, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, round(100 * avg(CAST(x > 55 AS INTEGER)), 6) AS share_over, round(covar_samp(rn, x) / var_pop(rn), 6) AS drift, coalesce(any_value(n_excursions), 0) AS n_excursions, coalesce(any_value(longest), 0) AS longest, coalesce(any_value(recurrent), 0) AS recurrent FROM placed p LEFT JOIN exc e USING (uid) GROUP BY p.uid"))
def excursion_metrics(spark, sf_dir):
    points = panels.event_panel(spark, sf_dir).select(F.col("asset").alias("uid"), "t", "x")
    return events.excursions(points, 55.0)


@query(o.sql("acts AS (SELECT user_id AS uid, CAST(ts AS DATE) AS t, count(*) AS n, round(avg(value), 6) AS x FROM events GROUP BY 1, 2)", "SELECT uid, count(*) AS days, max(n) AS n_max, round(avg(x) + 1e-9, 6) AS x_mean, round(max(x), 6) AS x_max, round(quantile_cont(x, 0.95), 6) AS x_p95, round(100 * avg(CAST(x > 60 AS INTEGER)), 6) AS share_over FROM acts GROUP BY uid"))
def subject_summary(spark, sf_dir):
    acts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("uid"), F.to_date("ts").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("x"))
    return acts.groupBy("uid").agg(F.count(F.lit(1)).alias("days"), F.max("n").alias("n_max"), F.round(F.avg("x") + 1e-9, 6).alias("x_mean"), F.round(F.max("x"), 6).alias("x_max"), F.round(F.percentile("x", F.lit(0.95)), 6).alias("x_p95"), F.round(100 * F.avg((F.col("x") > 60).cast("double")), 6).alias("share_over"))


@query(o.sql(EVENT_SERIES, "q AS (SELECT uid, quantile_cont(x, 0.25) AS low, quantile_cont(x, 0.75) AS high FROM series GROUP BY uid)", "SELECT s.uid, count(*) FILTER (x <= low) AS n_low, count(*) FILTER (x >= high) AS n_high, round(avg(x) FILTER (x <= low), 6) AS mean_low, round(avg(x) FILTER (x >= high), 6) AS mean_high FROM series s JOIN q USING (uid) GROUP BY s.uid"))
def quartile_contrast(spark, sf_dir):
    points = panels.event_panel(spark, sf_dir).select(F.col("asset").alias("uid"), "x")
    whole = Window.partitionBy("uid")
    limits = points.withColumn("low", F.percentile("x", F.lit(0.25)).over(whole)).withColumn("high", F.percentile("x", F.lit(0.75)).over(whole))
    low, high = F.col("x") <= F.col("low"), F.col("x") >= F.col("high")
    return limits.groupBy("uid").agg(F.count_if(low).alias("n_low"), F.count_if(high).alias("n_high"), F.round(F.avg(F.when(low, F.col("x"))), 6).alias("mean_low"), F.round(F.avg(F.when(high, F.col("x"))), 6).alias("mean_high"))


@query(o.sql("days AS (SELECT event_type AS uid, CAST(ts AS DATE) AS t, count(*) AS n FROM events GROUP BY 1, 2)", "snap AS (SELECT uid, t, CASE WHEN n > 70 THEN 'CRITICAL' WHEN n > 66 THEN 'WATCH' ELSE 'HEALTHY' END AS status FROM days)",
             "SELECT coalesce(a.uid, b.uid) AS uid, a.status AS before, b.status AS after, CASE WHEN a.status IS NULL THEN 'NEW' WHEN b.status IS NULL THEN 'GONE' WHEN a.status = b.status THEN 'SAME' ELSE 'CHANGED' END AS change FROM (SELECT * FROM snap WHERE t = DATE '2024-01-10') a FULL JOIN (SELECT * FROM snap WHERE t = DATE '2024-01-11') b ON a.uid = b.uid"))
def monitor_transitions(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("uid"), F.to_date("ts").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    snap = days.withColumn("status", F.when(F.col("n") > 70, "CRITICAL").when(F.col("n") > 66, "WATCH").otherwise("HEALTHY"))
    return events.state_changes(snap.where("t = DATE '2024-01-10'"), snap.where("t = DATE '2024-01-11'"))
