"""Queries on finished states and on reference graphs, registered in the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lattica.config import STATE
from lattica.operators import evaluate, events, hazard, series, state, studies, windows
from lattica.plans import oracle as o
from lattica.plans.catalog import BASE, CANDIDATES, SCALED, SCORES, SQL, _oh_state, _windows, all_returns, query, r6
from lattica.plans.evaluation import ATTENTION, activation_sql, matrices
from lattica.plans.monitoring import RISK, SPIKES, REPORT, hazards, lasting_sql
from lattica.runtime import shared_dir, table
from lattica.sources import formats, panels

# Attractor ---------------------------------------------------------------------------------------------------------

ASSETS = 5
RATED = f"rated AS MATERIALIZED (SELECT r.*, h.capacity_share, (1 + {ASSETS - 1} * h.mean_corr) / {ASSETS}.0::DOUBLE AS scr FROM recurred r JOIN hazards h USING (uid, rn))"
Z1 = " + ".join(f"{w}::DOUBLE * greatest(({c} - {m}::DOUBLE) / {s}::DOUBLE, 0.0::DOUBLE)" for c, w, m, s in (("det", 0.4, 0.85, 0.1), ("lam", 0.35, 0.9, 0.08), ("tt", 0.25, 5.0, 3.0)))
Z2 = " + ".join(f"{w}::DOUBLE * greatest(({c} - avg({c}) OVER b) / greatest(stddev_pop({c}) OVER b, 0.01::DOUBLE), 0.0::DOUBLE)" for c, w in (("det", 0.4), ("lam", 0.35), ("tt", 0.25)))
VARIANTS = f"""calm_scr AS (SELECT uid, quantile_cont(scr, 0.5) AS mid, greatest(stddev_pop(scr), 0.01::DOUBLE) AS dev FROM rated WHERE {o.CALM} GROUP BY uid
), lifted AS (
  SELECT r.uid, r.t, r.theta, CASE WHEN det IS NULL THEN 0.0::DOUBLE ELSE least({Z1}, 5.0::DOUBLE) END AS v1,
         CASE WHEN det IS NOT NULL AND rn > 120 AND count(det) OVER b >= 10 THEN least({Z2}, 5.0::DOUBLE) ELSE 0.0::DOUBLE END AS v2, greatest((scr - mid) / dev, 0.0::DOUBLE) AS z
  FROM rated r JOIN calm_scr USING (uid) WINDOW b AS (PARTITION BY r.uid ORDER BY rn ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING))"""


def rated(spark, sf_dir):
    """Recurrence and strength beside capacity and the leading share that the mean coupling stands for."""
    full = hazards(spark, sf_dir)
    found = windows.recurrence_series(full.select("uid", "t", F.col("mean_corr").alias("x"))).withColumn("theta", F.round("theta", 9))
    return found.join(full.select("uid", "t", "capacity_share", studies.concentration(F.col("mean_corr"), ASSETS).alias("scr")), ["uid", "t"])


@query(o.sql(*RISK, RATED, VARIANTS, "SELECT uid, t, round(theta + 1e-11, 6) AS v0, round(v1 + 1e-11, 6) AS v1, round(v2 + 1e-11, 6) AS v2, round(CASE WHEN theta < 0.1 AND z > 1 THEN least(0.5::DOUBLE * z, 5.0::DOUBLE) ELSE least(theta * (1 + 0.5::DOUBLE * z), 5.0::DOUBLE) END + 1e-11, 6) AS v3 FROM lifted", recursive=True))
def strength_variants(spark, sf_dir):
    return studies.strength_variants(rated(spark, sf_dir)).select("uid", "t", *(F.round(F.col(c) + 1e-11, 6).alias(c) for c in ("v0", "v1", "v2", "v3")))


@query(o.sql(*RISK, RATED, """limits2 AS (SELECT uid, quantile_cont(scr, 0.75) AS high, min(rn) FILTER (capacity_share < 0.9::DOUBLE) AS t_s, min(rn) FILTER (theta > 0.5::DOUBLE) AS t_g FROM rated GROUP BY uid
), audit AS (SELECT r.uid, count(*) AS rows, any_value(t_g) AS t_g, any_value(t_s) AS t_s, count(*) FILTER (scr > high AND theta < 0.1::DOUBLE) AS suppressed, count(*) FILTER (scr > high AND theta < 0.1::DOUBLE AND rn < t_s AND t_s - rn <= 90) AS before_damage FROM rated r JOIN limits2 USING (uid) GROUP BY r.uid)""",
             "SELECT *, round(suppressed / rows, 6) AS share, CASE WHEN suppressed / rows > 0.2::DOUBLE THEN 'SEVERE_SUPPRESSION' WHEN suppressed / rows > 0.05::DOUBLE THEN 'MODERATE_SUPPRESSION' ELSE 'MINIMAL' END AS verdict FROM audit", recursive=True))
def suppression_audit(spark, sf_dir):
    return studies.suppression_audit(rated(spark, sf_dir))


OBSERVED = "observed AS MATERIALIZED (SELECT uid || '|' || name AS uid, t, rn, n, v AS x FROM (SELECT uid, t, rn, n, unnest(['oh', 'eta', 'mean_corr']) AS name, unnest([oh, eta, mean_corr]) AS v FROM ohs))"


def observed(spark, sf_dir):
    values = F.create_map(*(x for c in ("oh", "eta", "mean_corr") for x in (F.lit(c), F.col(c))))
    long = _oh_state(spark, sf_dir).select("uid", "t", F.explode(values).alias("name", "x"))
    return long.select(F.concat_ws("|", "uid", "name").alias("uid"), "t", "x")


@query(o.sql(*o.WINDOWS, OBSERVED, o.recurrence_sql("observed", "x"), f"first AS ({lasting_sql('theta', '0.5::DOUBLE', 5, 'recurred')})", "SELECT split_part(r.uid, '|', 1) AS uid, split_part(r.uid, '|', 2) AS observable, any_value(geometry) AS geometry, round(max(theta), 6) AS theta_max, any_value(crossing) AS crossing FROM recurred r JOIN first USING (uid) GROUP BY r.uid"))
def circularity(spark, sf_dir):
    """Whether each observable's own recurrence activates: strength and first lasting crossing by observable."""
    found = windows.recurrence_series(observed(spark, sf_dir)).withColumn("theta", F.round("theta", 9))
    summed = found.groupBy("uid").agg(F.any_value("geometry").alias("geometry"), F.round(F.max("theta"), 6).alias("theta_max"))
    joined = summed.join(series.first_crossing(found, "theta", 0.5, 5), "uid")
    return joined.select(F.substring_index("uid", "|", 1).alias("uid"), F.substring_index("uid", "|", -1).alias("observable"), "geometry", "theta_max", "crossing")


# Monitoring --------------------------------------------------------------------------------------------------------

ALERTED = "SELECT uid, t, rn, n, capacity_share, theta, fragility, h90, half_life_90, estimated, CASE WHEN estimated THEN 'BASELINE_INSUFFICIENT' WHEN capacity_share < 0 OR (h90 >= 0.10 AND capacity_share < 0.5) THEN 'EMERGENCY' WHEN (h90 >= 0.02 AND capacity_share < 0.7) OR half_life_90 < 90 THEN 'WARNING' WHEN capacity_share < 0.5 OR fragility > 1.5 THEN 'WATCH' ELSE 'NOMINAL' END AS alert FROM hazards"
LATEST = f"latest AS (SELECT * FROM ({ALERTED}) WHERE rn = n)"


def latest(spark, sf_dir):
    placed = hazards(spark, sf_dir).withColumn("alert", hazard.alert_level(F.col("estimated")))
    return placed.where("rn = n")


@query(o.sql(*RISK, LATEST, activation_sql("recurred", "theta"), """SELECT count(*) AS universes, count(*) FILTER (alert = 'EMERGENCY') AS emergency, count(*) FILTER (alert = 'WARNING') AS warning, count(*) FILTER (alert = 'WATCH') AS watch, count(*) FILTER (alert = 'NOMINAL') AS nominal,
  count(*) FILTER (current_run >= 5) AS active, count(*) FILTER (duration > 90) AS lasting, count(*) FILTER (capacity_share < 0.5) AS half_spent, count(*) FILTER (capacity_share < 0) AS spent, round(avg(capacity_share), 6) AS capacity FROM latest JOIN activated USING (uid)""", recursive=True))
def global_metrics(spark, sf_dir):
    strength = hazards(spark, sf_dir).select("uid", "t", F.col("theta").alias("x"))
    both = latest(spark, sf_dir).join(series.activations(strength), "uid")
    level = lambda name: F.count_if(F.col("alert") == name).alias(name.lower())
    return both.agg(
        F.count(F.lit(1)).alias("universes"), level("EMERGENCY"), level("WARNING"), level("WATCH"), level("NOMINAL"), F.count_if(F.col("current_run") >= 5).alias("active"),
        F.count_if(F.col("duration") > 90).alias("lasting"), F.count_if(F.col("capacity_share") < 0.5).alias("half_spent"), F.count_if(F.col("capacity_share") < 0).alias("spent"), F.round(F.avg("capacity_share"), 6).alias("capacity"),
    )


@query(o.sql(*RISK, LATEST, """odd AS (SELECT uid, unnest(['damage_without_geometry', 'geometry_without_damage', 'spent_but_calm', 'loaded_but_quiet']) AS anomaly,
  unnest([capacity_share < 0.9 AND theta < 0.1, capacity_share >= 0.9 AND theta > 0.5, capacity_share < 0.5 AND alert = 'NOMINAL', fragility > 1.5 AND theta < 0.1]) AS holds FROM latest)""", "SELECT uid, anomaly FROM odd WHERE holds", recursive=True))
def anomalies(spark, sf_dir):
    share, theta = F.col("capacity_share"), F.col("theta")
    rules = {"damage_without_geometry": (share < 0.9) & (theta < 0.1), "geometry_without_damage": (share >= 0.9) & (theta > 0.5), "spent_but_calm": (share < 0.5) & (F.col("alert") == "NOMINAL"), "loaded_but_quiet": (F.col("fragility") > 1.5) & (theta < 0.1)}
    named = F.explode(F.filter(F.array(*[F.when(on, F.lit(name)) for name, on in rules.items()]), lambda x: x.isNotNull()))
    return latest(spark, sf_dir).select("uid", named.alias("anomaly"))


@query(o.sql(*RISK, LATEST, f"geo0 AS ({lasting_sql('theta', '0.1::DOUBLE', 5, 'hazards')})", """SELECT uid, CASE WHEN capacity_share >= 0.9 THEN CASE WHEN theta > 0.5 THEN 'GEOMETRIC_ACTIVE_NO_DAMAGE' ELSE 'QUIESCENT' END WHEN capacity_share >= 0.5 THEN 'STRUCTURAL_ACTIVATION_MILD' WHEN capacity_share >= 0 THEN 'STRUCTURAL_ACTIVATION_SEVERE' ELSE 'POST_IRREVERSIBILITY' END AS phase,
  CAST(l.t - crossing AS BIGINT) AS days_since, capacity_share < 0.9 AS damaged FROM latest l JOIN geo0 USING (uid)""", recursive=True))
def monitor_phase(spark, sf_dir):
    crossing = series.first_crossing(hazards(spark, sf_dir), "theta", 0.1, 5)
    both = latest(spark, sf_dir).join(crossing, "uid")
    return both.select("uid", studies.phase(F.col("theta"), F.col("capacity_share")).alias("phase"), F.datediff("t", "crossing").cast("long").alias("days_since"), (F.col("capacity_share") < 0.9).alias("damaged"))


@query(o.sql(*o.FULL, SPIKES, REPORT, "SELECT uid, 'Universe ' || uid || ' is ' || lower(status) || ': ' || n_spikes || ' spikes, longest rigid run ' || tau_max || ', now ' || regime AS summary FROM statuses", recursive=True))
def executive_summary(spark, sf_dir):
    report = events.universe_report(state.universe_state(spark, sf_dir))
    return report.select("uid", F.format_string("Universe %s is %s: %d spikes, longest rigid run %d, now %s", "uid", F.lower("status"), "n_spikes", "tau_max", "regime").alias("summary"))


def crossing_of(x: str, threshold: str, persist: int) -> str:
    return f"SELECT uid, crossing FROM ({lasting_sql(x, threshold, persist, 'state')}) WHERE crossing IS NOT NULL"


@query(o.sql(*o.FULL, f"sensed AS ({crossing_of('oh', '0.9', 2)} UNION ALL {crossing_of('phi', 'phi_c', 2)}), confirmed AS ({crossing_of('oh', '0.9', 5)} UNION ALL {crossing_of('phi', 'phi_c', 5)})", "ends AS (SELECT uid, max(t) AS t FROM state GROUP BY uid), f AS (SELECT uid, min(crossing) AS first FROM sensed GROUP BY uid), l AS (SELECT uid, max(crossing) AS last FROM confirmed GROUP BY uid), k AS (SELECT e.uid, t, first, coalesce(last, first) AS last FROM ends e LEFT JOIN f USING (uid) LEFT JOIN l USING (uid))",
             "SELECT uid, first AS first_sensed, last AS last_confirmed, CAST(t - first AS BIGINT) AS total_days, CAST(last - first AS BIGINT) AS cascade_days, CASE WHEN t - first > 0 THEN round((last - first) / (t - first), 6) WHEN first IS NOT NULL THEN 0.0::DOUBLE END AS sync_ratio FROM k", recursive=True))
def cascade_lead_times(spark, sf_dir):
    full = state.universe_state(spark, sf_dir)
    found = {p: series.first_crossing(full, "oh", 0.9, p).unionByName(series.first_crossing(full, "phi", F.col("phi_c"), p)).where("crossing IS NOT NULL") for p in (2, 5)}
    return studies.cascade(found[2], found[5], full.groupBy("uid").agg(F.max("t").alias("t")))


@query(f"WITH years AS ({SQL['warming_by_year']}), pairs AS (SELECT uid, year, slope, lag(slope) OVER w AS slope0, share_p90, lag(share_p90) OVER w AS share0, lag(year) OVER w AS year0 FROM years WINDOW w AS (PARTITION BY uid ORDER BY year)) SELECT uid, min(year) FILTER (slope0 < 0 AND slope > 0) AS inverted, min(year) FILTER (share_p90 > 1.5::DOUBLE * share0) AS more_often FROM pairs GROUP BY uid")
def warming_conclusions(spark, sf_dir):
    """First year in which the trend turns up, and first in which high pressure is half as frequent again."""
    w = Window.partitionBy("uid").orderBy("year")
    pairs = state.yearly_warming(state.universe_state(spark, sf_dir)).select("uid", "year", "slope", F.lag("slope").over(w).alias("slope0"), "share_p90", F.lag("share_p90").over(w).alias("share0"))
    return pairs.groupBy("uid").agg(F.min(F.when((F.col("slope0") < 0) & (F.col("slope") > 0), F.col("year"))).alias("inverted"), F.min(F.when(F.col("share_p90") > 1.5 * F.col("share0"), F.col("year"))).alias("more_often"))


# Cohorts and mappings ------------------------------------------------------------------------------------------------

COHORT = ", ".join([f"round(avg({c}), 6) AS mean_{c}" for c in ("oh", "eta", "mean_corr")] + [f"round(avg({c}) FILTER (rn > floor(0.75::DOUBLE * n)), 6) AS late_{c}" for c in ("oh", "eta", "mean_corr")])


@query(o.sql(*o.WINDOWS, f"SELECT uid, {COHORT}, round(avg(oh) FILTER (rn > n - ceil(n / 4)) - avg(oh) FILTER (rn <= floor(n / 4)), 6) AS drift FROM ohs GROUP BY uid"))
def cohort_drift(spark, sf_dir):
    return studies.cohort_drift(_oh_state(spark, sf_dir).select("uid", "t", "oh", "eta", "mean_corr"), ["oh", "eta", "mean_corr"], "oh")


DIVERGED = "diverged AS (SELECT m.uid, m.t, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - abs((a * da + b * db + c * dc) / ((sqrt(a * a + b * b + c * c) + 1e-12) * (sqrt(da * da + db * db + dc * dc) + 1e-12))))), 9) AS d, o.oh, o.eta, o.mean_corr FROM moved m JOIN ohs o ON o.uid = m.uid AND o.t = m.t)"
PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def diverged(spark, sf_dir):
    return series.phase_divergence(_oh_state(spark, sf_dir), ["oh", "eta", "vol"]).withColumn("d", F.round("divergence", 9))


@query(o.sql(*o.WINDOWS, SCALED, DIVERGED, "middle AS (SELECT uid, quantile_cont(d, 0.5) AS m FROM diverged GROUP BY uid)", "named AS (SELECT uid, CASE WHEN m > 0 THEN d / m ELSE d END AS r FROM diverged JOIN middle USING (uid))", "SELECT uid, CASE WHEN r < 0.5 THEN 'aligned' WHEN r < 1 THEN 'coherent' WHEN r < 1.5 THEN 'mild' WHEN r < 2.5 THEN 'moderate' WHEN r < 4 THEN 'high' ELSE 'critical' END AS bucket, count(*) AS rows FROM named GROUP BY 1, 2"))
def divergence_buckets(spark, sf_dir):
    middle = F.percentile("d", F.lit(0.5)).over(Window.partitionBy("uid"))
    named = diverged(spark, sf_dir).withColumn("middle", middle).select("uid", studies.divergence_bucket(F.col("d"), F.col("middle")).alias("bucket"))
    return named.groupBy("uid", "bucket").agg(F.count(F.lit(1)).alias("rows"))


@query(o.sql(*o.WINDOWS, SCALED, DIVERGED, "SELECT uid, round(corr(d, oh), 6) AS corr_oh, round(corr(d, eta), 6) AS corr_eta, round(avg(d) FILTER (oh <= 0.9), 6) AS mean_normal, round(avg(d) FILTER (oh > 0.9), 6) AS mean_critical, round(stddev_samp(d) FILTER (oh <= 0.9), 6) AS std_normal, round(stddev_samp(d) FILTER (oh > 0.9), 6) AS std_critical, round(avg(d) FILTER (oh > 0.9) / avg(d) FILTER (oh <= 0.9), 6) AS ratio, " + ", ".join(f"round(quantile_cont(d, {q}), 6) AS p{round(100 * q)}" for q in PERCENTILES) + " FROM diverged GROUP BY uid"))
def divergence_by_regime(spark, sf_dir):
    calm, high = F.when(F.col("oh") <= 0.9, F.col("d")), F.when(F.col("oh") > 0.9, F.col("d"))
    out = {"corr_oh": F.corr("d", "oh"), "corr_eta": F.corr("d", "eta"), "mean_normal": F.avg(calm), "mean_critical": F.avg(high), "std_normal": F.stddev_samp(calm), "std_critical": F.stddev_samp(high), "ratio": F.try_divide(F.avg(high), F.avg(calm))}
    out |= {f"p{round(100 * q)}": F.percentile("d", F.lit(q)) for q in PERCENTILES}
    return diverged(spark, sf_dir).groupBy("uid").agg(*(F.round(v, 6).alias(k) for k, v in out.items()))


KINDS = """kinds AS (SELECT CAST(ts AS DATE) AS t, event_type, count(*) AS c FROM events GROUP BY 1, 2
), shares AS (SELECT t, c / sum(c) OVER (PARTITION BY t) AS p, count(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY c DESC, event_type) AS r FROM kinds
), legacy AS (SELECT t, any_value(n) AS n, any_value(n) * max(p) AS oh, -sum(p * log2(p)) AS h, max(p) - coalesce(max(p) FILTER (r = 2), 0) AS dominance FROM shares GROUP BY t)"""


@query(o.sql(KINDS, "SELECT t, round(oh, 6) AS oh, round(1 - h / log2(n), 6) AS eta, round(dominance, 6) AS divergence, round(pow(2, h) / n, 6) AS xi, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (oh - 1) / (n - 1))), 6) AS mean_corr FROM legacy WHERE n > 1"))
def legacy_to_state(spark, sf_dir):
    """Five observables from a day's shares of event kinds: leading share, entropy and dominance as an older layout has them."""
    kinds = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("t"), "event_type").agg(F.count(F.lit(1)).alias("c"))
    day = Window.partitionBy("t")
    shares = kinds.select("t", (F.col("c") / F.sum("c").over(day)).alias("p"), F.count(F.lit(1)).over(day).alias("n"), F.row_number().over(day.orderBy(F.desc("c"), "event_type")).alias("r"))
    legacy = shares.groupBy("t").agg(F.max("n").alias("n"), F.max("p").alias("top"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"), (F.max("p") - F.coalesce(F.max(F.when(F.col("r") == 2, F.col("p"))), F.lit(0.0))).alias("dominance"))
    n, oh = F.col("n"), F.col("n") * F.col("top")
    rho = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (oh - 1) / (n - 1)))
    named = {"oh": oh, "eta": 1 - F.col("h") / F.log2("n"), "divergence": F.col("dominance"), "xi": F.pow(F.lit(2.0), "h") / n, "mean_corr": rho}
    return legacy.where("n > 1").select("t", *(F.round(v, 6).alias(k) for k, v in named.items()))


HOURLY = "hourly AS (SELECT event_type AS uid, date_trunc('hour', ts) AS t, round(avg(value), 6) AS x FROM events GROUP BY 1, 2)"


@query(o.sql(HOURLY, "raw AS (SELECT *, (x - lag(x) OVER w) / 2 AS s, CASE WHEN count(x) OVER v = 10 THEN stddev_samp(x) OVER v END AS d FROM hourly WINDOW w AS (PARTITION BY uid ORDER BY t), v AS (PARTITION BY uid ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))", "SELECT uid, t, round(first_value(s IGNORE NULLS) OVER f, 6) AS x_slope, round(first_value(d IGNORE NULLS) OVER f, 6) AS x_std FROM raw WINDOW f AS (PARTITION BY uid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
def moving_features(spark, sf_dir):
    points = panels.event_panel(spark, sf_dir).select(F.col("asset").alias("uid"), F.col("t").cast("timestamp_ntz").alias("t"), "x")
    return studies.moving_features(points, ["x"]).select("uid", "t", *r6("x_slope", "x_std"))


@query(o.sql(*BASE, CANDIDATES, SCORES, """inner_rows AS (SELECT s.uid, s.eta, s.vol, c.rank FROM state1 s JOIN tops c ON c.uid = s.uid AND s.t BETWEEN c."start" AND c."end"
), each AS (SELECT uid, rank, quantile_cont(vol, 0.95) AS x_c, quantile_cont(vol, 0.95) AS high, quantile_cont(eta, 0.05) AS phi_c FROM inner_rows GROUP BY uid, rank)""",
             "SELECT b.uid, round(b.x_c, 6) AS x_c, round(b.high / b.x_c, 6) AS theta, round((SELECT min(high) FROM each z WHERE z.uid = b.uid) / b.x_c, 6) AS theta_low, round(b.phi_c, 6) AS phi_c FROM each b WHERE rank = 1"))
def quiet_thresholds(spark, sf_dir):
    frame = _windows(spark, sf_dir)
    top = state.quiet_top(state.quiet_scores(frame, state.quiet_candidates(frame.select("uid", "t")).drop("rows"), STATE.window))
    return studies.quiet_thresholds(frame, top.select("uid", "start", "end", "rank"), "vol", "eta").select("uid", *r6("x_c", "theta", "theta_low", "phi_c"))


# Attention -----------------------------------------------------------------------------------------------------------


@query(o.sql(ATTENTION, "z AS (SELECT g, i, j, (a - avg(a) OVER r) / greatest(stddev_pop(a) OVER r, 1e-10) AS z, max(i) OVER (PARTITION BY g) + 1 AS n FROM matrices WINDOW r AS (PARTITION BY g, i))", "SELECT p.g, p.i, q.i AS k, round(CASE WHEN p.n < 3 THEN 0.0::DOUBLE ELSE greatest(least(sum(p.z * q.z) / p.n, 1.0::DOUBLE), -1.0::DOUBLE) END, 6) + 0.0::DOUBLE AS c FROM z p JOIN z q ON p.g = q.g AND p.j = q.j AND p.i < q.i GROUP BY p.g, p.i, q.i, p.n"))
def row_patterns(spark, sf_dir):
    return studies.row_patterns(matrices(spark, sf_dir)).select("g", "i", "k", (F.round("c", 6) + 0.0).alias("c"))


@query(o.sql(ATTENTION, "SELECT g, round(1 - xi + 0.3::DOUBLE * delta / (max(delta) OVER () + 1e-12) + 0.2::DOUBLE * eta / (max(eta) OVER () + 1e-12), 6) AS score FROM family"))
def composite_rscore(spark, sf_dir):
    from lattica.operators import attention

    f, whole = attention.entropy_family(matrices(spark, sf_dir)), Window.partitionBy()  # a row a matrix
    part = lambda c: F.col(c) / (F.max(c).over(whole) + 1e-12)
    return f.select("g", F.round(1 - F.col("xi") + 0.3 * part("delta") + 0.2 * part("eta"), 6).alias("score"))


# Evaluation ----------------------------------------------------------------------------------------------------------

SWEEP = (1, 4, 12, 26)
LABELLED_STATE = "goal AS (SELECT uid, t, rn, n, mean_corr, max(CAST(oh > 0.9 AS INTEGER)) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS y FROM ohs)"
RANKED = """th AS (SELECT g, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY g, score
), cum AS (SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY score DESC) AS tp, sum(pos) OVER (PARTITION BY g) AS p, sum(neg) OVER (PARTITION BY g) AS nn FROM th)"""
RANKED_AUC = "round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / nullif(any_value(p) * any_value(nn), 0), 6) AS auc"


def labelled_state(spark, sf_dir):
    frame = _oh_state(spark, sf_dir)
    return events.forward_target(frame, F.col("oh") > 0.9, 12, "y")


@query(o.sql(*o.WINDOWS, LABELLED_STATE, "scored AS (" + " UNION ALL ".join(f"SELECT '{w}' AS g, round(m, 9) AS score, y FROM (SELECT y, avg(mean_corr) OVER q AS m, count(*) OVER q AS k FROM goal WINDOW q AS (PARTITION BY uid ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)) WHERE k = {w} AND y IS NOT NULL" for w in SWEEP) + ")", RANKED, f"SELECT CAST(g AS INTEGER) AS rows, {RANKED_AUC} FROM cum GROUP BY g"))
def window_sweep(spark, sf_dir):
    """Separation of the target by the coupling smoothed over more and more rows."""
    frame, out = labelled_state(spark, sf_dir), None
    for rows in SWEEP:
        w = Window.partitionBy("uid").orderBy("t").rowsBetween(1 - rows, 0)
        own = frame.select(F.lit(str(rows)).alias("g"), F.round(F.avg("mean_corr").over(w), 9).alias("score"), "y", F.count(F.lit(1)).over(w).alias("k")).where(F.col("k") == rows).where("y IS NOT NULL").drop("k")
        out = own if out is None else out.unionByName(own)
    return evaluate.rank_auc(out).select(F.col("g").cast("int").alias("rows"), "auc")


METRICS, SMALL = ["mean_corr", "eta", "vol"], [1, 2, 3, 5, 7, 10, 20]
COMPARED = f"""marked AS (SELECT uid, t, mean_corr, eta, vol, max(CAST(oh > 0.9 AS INTEGER)) OVER f AS quiet_based, max(CAST(vol > high AS INTEGER)) OVER f AS quiet_free
  FROM (SELECT *, quantile_cont(vol, 0.75) OVER (PARTITION BY uid) AS high FROM ohs) WINDOW f AS (PARTITION BY uid ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)
), means AS ({" UNION ALL ".join(f"SELECT uid, '{m}' AS metric, {k} AS rows, CASE WHEN count({m}) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = {k} THEN round(avg({m}) OVER (PARTITION BY uid ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) + {studies.OFF_TIES}::DOUBLE, 9) END AS score, quiet_based, quiet_free FROM marked" for m in METRICS for k in SMALL)}
), long AS (SELECT uid, metric, rows, 'quiet_based' AS target, score, quiet_based AS y FROM means UNION ALL SELECT uid, metric, rows, 'quiet_free', score, quiet_free FROM means
), scored AS (
  SELECT 'all' AS u, metric, rows, target, score, y FROM long WHERE score IS NOT NULL AND y IS NOT NULL UNION ALL SELECT uid, metric, rows, target, score, y FROM long WHERE score IS NOT NULL AND y IS NOT NULL
), counted AS (SELECT u, metric, rows, target, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL
), up AS (SELECT *, sum(pos) OVER (PARTITION BY u, metric, rows, target ORDER BY score DESC) AS tp FROM counted
), aucs AS (SELECT u, metric, rows, target, round(sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM up GROUP BY ALL
), folded AS (SELECT u, metric, rows, target, greatest(auc, round(1 - auc, 6)) AS auc FROM aucs)"""


# windows of the means CTE clash with the state's, so it goes by another name
@query(o.sql(*o.WINDOWS, COMPARED.replace("means AS", "smooth AS").replace("FROM means", "FROM smooth"), "SELECT metric, CAST(rows AS INTEGER) AS rows, target, max(auc) FILTER (u = 'all') AS auc, round(avg(auc) FILTER (u <> 'all'), 6) AS mean_auc, count(auc) FILTER (u <> 'all') AS universes FROM folded GROUP BY metric, rows, target"))
def window_comparison(spark, sf_dir):
    """From how few rows the state's metrics tell what comes, against a target that leans on the quiet share and one that
    does not: separation over all rows, and its mean over universes."""
    frame = _oh_state(spark, sf_dir)
    high = F.percentile("vol", F.lit(0.75)).over(Window.partitionBy("uid"))
    marked = events.forward_target(events.forward_target(frame, F.col("oh") > 0.9, 12, "quiet_based").withColumn("high", high), F.col("vol") > F.col("high"), 12, "quiet_free")
    long = studies.smoothed_scores(marked, METRICS, SMALL, ["quiet_based", "quiet_free"])
    both = long.withColumn("u", F.explode(F.array(F.lit("all"), F.col("uid"))))
    ranked = evaluate.folded_auc(both.select(F.struct("u", "metric", "rows", "target").alias("g"), "score", "y")).select("g.*", "auc")
    alone = F.when(F.col("u") != "all", F.col("auc"))
    return ranked.groupBy("metric", "rows", "target").agg(F.max(F.when(F.col("u") == "all", F.col("auc"))).alias("auc"), F.round(F.avg(alone), 6).alias("mean_auc"), F.count(alone).alias("universes"))


PARTS = ["oh", "eta", "phi", "vol"]
VELOCITY = {"centred": "coalesce((lead({c}) OVER w - lag({c}) OVER w) / 2, lead({c}) OVER w - {c}, {c} - lag({c}) OVER w)", "forward": "coalesce(lead({c}) OVER w - {c}, {c} - lag({c}) OVER w)", "backward": "coalesce({c} - lag({c}) OVER w, lead({c}) OVER w - {c})"}


@query(o.sql(*o.FULL, "moved AS (" + " UNION ALL ".join(f"SELECT uid, t, '{how}' AS how, sqrt({' + '.join(f'{c} * {c}' for c in PARTS)}) AS size, " + ", ".join(f"abs(coalesce({v.format(c=c)}, 0)) AS part_{c}" for c in PARTS) + " FROM state WINDOW w AS (PARTITION BY uid ORDER BY t)" for how, v in VELOCITY.items()) + ")",
             f"summed AS (SELECT *, sqrt({' + '.join(f'part_{c} * part_{c}' for c in PARTS)}) AS total FROM moved)", "scaled AS (SELECT *, total / greatest(size, 1e-10) AS relative FROM summed)",
             f"SELECT uid, t, how, {', '.join(f'round(part_{c}, 6) AS part_{c}' for c in PARTS)}, round(total, 6) AS total, round(relative, 6) AS relative, round(relative - lag(relative) OVER (PARTITION BY uid, how ORDER BY t), 6) + 0.0::DOUBLE AS gradient FROM scaled", recursive=True))
def divergence_parts(spark, sf_dir):
    """Which observable departs from where its velocity carries it, by three ways to take velocities, and how that changes."""
    frame, out = state.universe_state(spark, sf_dir).select("uid", "t", *PARTS), None
    for how in VELOCITY:
        own = series.divergence_parts(frame, PARTS, how).withColumn("how", F.lit(how))
        out = own if out is None else out.unionByName(own)
    return out.select("uid", "t", "how", *r6(*(f"part_{c}" for c in PARTS), "total", "relative"), (F.round("gradient", 6) + 0.0).alias("gradient"))


@query(o.sql(*o.WINDOWS, LABELLED_STATE, "scored AS (SELECT CASE WHEN rn <= floor(0.6::DOUBLE * n) THEN 'early' ELSE 'late' END AS g, mean_corr AS score, y FROM goal WHERE y IS NOT NULL)", RANKED, f"SELECT g, {RANKED_AUC} FROM cum GROUP BY g"))
def temporal_split(spark, sf_dir):
    """Whether what separates early rows separates late ones."""
    frame = labelled_state(spark, sf_dir).where("y IS NOT NULL")
    side = F.when(F.col("rn") <= F.floor(0.6 * F.col("n")), "early").otherwise("late")
    return evaluate.rank_auc(frame.select(side.alias("g"), F.col("mean_corr").alias("score"), "y")).select("g", "auc")


@query(o.sql(*o.WINDOWS, LABELLED_STATE, "scored AS (SELECT a.uid || '>' || g.uid AS g, CASE WHEN a.up THEN mean_corr ELSE -mean_corr END AS score, y FROM goal g JOIN (SELECT uid, avg(mean_corr) FILTER (y = 1) >= avg(mean_corr) FILTER (y = 0) AS up FROM goal WHERE y IS NOT NULL GROUP BY uid HAVING min(y) < max(y)) a ON a.uid <> g.uid WHERE y IS NOT NULL)", RANKED, f"SELECT g, {RANKED_AUC} FROM cum GROUP BY g HAVING any_value(p) * any_value(nn) > 0"))
def transfer(spark, sf_dir):
    """The direction learnt on one universe, tried on each other one."""
    frame = labelled_state(spark, sf_dir).where("y IS NOT NULL").select("uid", "mean_corr", "y")
    mean = lambda k: F.avg(F.when(F.col("y") == k, F.col("mean_corr")))
    learnt = frame.groupBy("uid").agg((mean(1) >= mean(0)).alias("up"), F.min("y").alias("low"), F.max("y").alias("high")).where("low < high").select(F.col("uid").alias("source"), "up")
    # a row a universe: a stated few
    tried = frame.join(F.broadcast(learnt), F.col("source") != F.col("uid"))
    score = F.when(F.col("up"), F.col("mean_corr")).otherwise(-F.col("mean_corr"))
    return evaluate.rank_auc(tried.select(F.concat_ws(">", "source", "uid").alias("g"), score.alias("score"), "y")).where("positives > 0 AND negatives > 0").select("g", "auc")


@query()
def forest_cv(spark, sf_dir, folds: int = 5):
    """A forest's accuracy and separation by fold, on the state's regime; folds by a hash of the row."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    names = ["mean_corr", "eta", "vol", "oh"]
    frame = state.universe_state(spark, sf_dir).select(*names, (F.col("regime") == "rigid").cast("double").alias("label"), F.pmod(F.xxhash64("uid", "t"), F.lit(folds)).alias("fold"))
    rows, out = VectorAssembler(inputCols=names, outputCol="features").transform(frame), None
    for k in range(folds):
        model = RandomForestClassifier(numTrees=20, maxDepth=4, seed=1).fit(rows.where(F.col("fold") != k))
        told = model.transform(rows.where(F.col("fold") == k))
        own = told.agg(F.lit(k).alias("fold"), F.count(F.lit(1)).alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        out = own if out is None else out.unionByName(own)
    return out


# Signature and domains -----------------------------------------------------------------------------------------------


def with_cycles(spark, sf_dir):
    """The state with cycles of the full windows, their ratio to quiet ones, and the phase divergence."""
    cycles = windows.by_window(all_returns(spark, sf_dir), STATE.window, windows.full_state, windows.STATE_COLUMNS).select("uid", "t", "h1_count")
    joined = state.universe_state(spark, sf_dir).join(cycles, ["uid", "t"])
    return studies.cycle_ratio(series.phase_divergence(joined, ["oh", "eta", "vol"]))


@query()
def pressure_signature(spark, sf_dir):
    """How often pressure, memory, its growth, rigidity, poverty of cycles and coherence hold at once, and the viscosity."""
    full = with_cycles(spark, sf_dir)
    critical = full.groupBy("uid").agg(F.round(F.max("xi_c"), 6).alias("xi_c"))
    return state.pressure_signature(full).join(studies.viscosity(full).select("uid", F.round("viscosity", 6).alias("viscosity")), "uid").join(critical, "uid")


DOMAINS = """hourly AS (SELECT date_trunc('hour', ts) AS t, count(*) AS c, count(DISTINCT event_type) AS k, count(DISTINCT user_id) AS u, avg(value) AS v FROM events GROUP BY 1
), calls AS (SELECT 'events' AS domain, hour(t) BETWEEN 9 AND 16 AS stressed, v / 100 AS oh, 0.5::DOUBLE AS divergence, CAST(u AS DOUBLE) / c AS xi, CAST(k AS DOUBLE) / 5 AS mean_corr FROM hourly
), trade AS (SELECT 'trade' AS domain, regime = 'rigid' AS stressed, oh, vol AS divergence, eta AS xi, mean_corr FROM state
), both_domains AS (SELECT *, (oh + divergence) / 2 - (xi + (1 - mean_corr)) / 2 AS oc FROM calls UNION ALL SELECT *, (oh + divergence) / 2 - (xi + (1 - mean_corr)) / 2 FROM trade
), pivot_domains AS (SELECT domain, avg(oc) FILTER (stressed) AS s, avg(oc) FILTER (NOT stressed) AS c, """ + ", ".join(f"CAST(avg({x}) FILTER (stressed) {'<' if x == 'xi' else '>'} avg({x}) FILTER (NOT stressed) AS INTEGER) AS d_{x}" for x in ("oh", "divergence", "xi", "mean_corr")) + " FROM both_domains GROUP BY domain)"


@query(o.sql(*o.FULL, DOMAINS, "SELECT domain, round(c, 6) AS oc_nominal, round(s, 6) AS oc_stressed, round(s - c, 6) AS oc_delta, CAST(d_oh + d_divergence + d_xi + d_mean_corr AS BIGINT) AS coherent, d_oh + d_divergence + d_xi + d_mean_corr >= 3 AS confirmed FROM pivot_domains", recursive=True))
def domain_table(spark, sf_dir):
    """Domains side by side: how far order exceeds disorder when stressed and when not, and in how many directions."""
    hourly = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("t")).agg(F.count(F.lit(1)).alias("c"), F.countDistinct("event_type").alias("k"), F.countDistinct("user_id").alias("u"), F.avg("value").alias("v"))
    calls = hourly.select(F.lit("events").alias("domain"), F.hour("t").between(9, 16).alias("stressed"), (F.col("v") / 100).alias("oh"), F.lit(0.5).alias("divergence"), (F.col("u") / F.col("c")).alias("xi"), (F.col("k") / 5).alias("mean_corr"))
    trade = state.universe_state(spark, sf_dir).select(F.lit("trade").alias("domain"), (F.col("regime") == "rigid").alias("stressed"), "oh", F.col("vol").alias("divergence"), F.col("eta").alias("xi"), "mean_corr")
    both = calls.unionByName(trade).withColumn("oc", studies.coherence(*(F.col(c) for c in ("oh", "divergence", "xi", "mean_corr"))))
    on, off = (lambda c: F.avg(F.when(F.col("stressed"), F.col(c)))), (lambda c: F.avg(F.when(~F.col("stressed"), F.col(c))))
    agree = sum(((on(c) < off(c)) if c == "xi" else (on(c) > off(c))).cast("long") for c in ("oh", "divergence", "xi", "mean_corr"))
    summed = both.groupBy("domain").agg(off("oc").alias("c"), on("oc").alias("s"), agree.alias("coherent"))
    return summed.select("domain", F.round("c", 6).alias("oc_nominal"), F.round("s", 6).alias("oc_stressed"), F.round(F.col("s") - F.col("c"), 6).alias("oc_delta"), "coherent", (F.col("coherent") >= 3).alias("confirmed"))


# Reference graphs ------------------------------------------------------------------------------------------------------

DRAW = "({a} * 7919 + {b} * 104729 + 1299709) % 1000003"
REFERENCE = f"""ring AS (SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v FROM (SELECT a, CASE WHEN {DRAW.format(a='a', b='s')} % 100 < 10 THEN (a + 1 + {DRAW.format(a='a', b='s')} % 199) % 200 ELSE (a + s) % 200 END AS b FROM range(200) x(a), range(1, 4) y(s))
), loose AS (SELECT u, v FROM range(200) x(u), range(200) y(v) WHERE u < v AND {DRAW.format(a='u', b='v')} % 1000 < 30
), graphs AS (SELECT 'ring' AS g, u, v FROM ring UNION ALL SELECT 'random', u, v FROM loose
), degrees AS (SELECT g, i, count(*) AS d FROM (SELECT g, u AS i FROM graphs UNION ALL SELECT g, v FROM graphs) GROUP BY g, i)"""


@query(o.sql(REFERENCE, "SELECT g, count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, max(d) AS degree_max, round(avg(d), 6) AS degree_mean FROM degrees GROUP BY g"))
def reference_graphs(spark, sf_dir):
    """Degrees of a rewired ring and of a random graph of stated sizes."""
    graphs = studies.ring_graph(spark, 200, 3, 10).withColumn("g", F.lit("ring")).unionByName(studies.random_graph(spark, 200, 30).withColumn("g", F.lit("random")))
    degrees = graphs.select("g", F.explode(F.array("u", "v")).alias("i")).groupBy("g", "i").agg(F.count(F.lit(1)).alias("d"))
    return degrees.groupBy("g").agg(F.count(F.lit(1)).alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.max("d").alias("degree_max"), F.round(F.avg("d"), 6).alias("degree_mean"))


@query()
def growing_graph(spark, sf_dir):
    """Degrees of a tree that grows by preference."""
    degrees = studies.growing_graph(spark, 500).select(F.explode(F.array("u", "v")).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("degree"))
    return degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


# Sources and sinks -----------------------------------------------------------------------------------------------------


@query(o.sql(o.MONTH_NATION, "SELECT uid, t, asset, x FROM panel"))
def panel_incremental(spark, sf_dir):
    """The monthly panel kept in two runs: the first years, then what is new in all."""
    panel = panels.trade_panel(spark, sf_dir, "month", asset="n_name").select("uid", "t", "asset", "x")
    place = f"{shared_dir(spark)}/lattica/panel-{uuid.uuid4().hex}"
    formats.append_new(panel.where("t < DATE '1997-01-01'"), place)
    return formats.append_new(panel, place)


@query(o.sql(*o.WINDOWS, "SELECT uid, t, round(oh, 6) AS oh, 0.0::DOUBLE AS scr, CAST(NULL AS VARCHAR) AS label FROM ohs"))
def bundle_filled(spark, sf_dir):
    """A bundle by universe, read in a schema with a number and a label that it was written without."""
    place = f"{shared_dir(spark)}/lattica/bundle-{uuid.uuid4().hex}"
    formats.write_bundle(_oh_state(spark, sf_dir).select("uid", "t", *r6("oh")), place)
    return formats.read_bundle(spark, place, "uid string, t date, oh double, scr double, label string")


@query(o.sql("SELECT event_id, CASE WHEN event_type = 'view' THEN 0.0::DOUBLE ELSE value END AS value, 0.0::DOUBLE AS word FROM events"))
def coerced_numbers(spark, sf_dir):
    odd = F.when(F.col("event_type") == "view", F.lit(float("inf"))).otherwise(F.col("value"))
    return formats.coerced(table(spark, sf_dir, "events").select("event_id", odd.alias("value"), F.col("event_type").alias("word")), ["value", "word"])
