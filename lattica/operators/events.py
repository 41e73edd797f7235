"""Monitoring: spikes, timelines, reports, lead times, interval labels, contrasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import RIGID, SHIFT
from lattica.operators import coupling, series
from lattica.sources.panels import by


def spikes(state: DataFrame, x: str = "oh", threshold: float = 1.0, least: int = 3) -> DataFrame:
    """Runs above the threshold of at least ``least`` rows: ``uid, start, end, length, peak``."""
    w = by("uid")
    marked = state.select("uid", "t", F.col(x).alias("x"), (F.col(x) > threshold).alias("flag"))
    island = marked.withColumn("island", F.sum(F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1))).over(w))
    found = island.where("flag").groupBy("uid", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("length"), F.round(F.max("x"), 6).alias("peak"))
    return found.where(F.col("length") >= least).drop("island")


def severity(regime: Column, calm: str) -> Column:
    return F.when(regime == RIGID, "critical").when(regime == SHIFT, "warning").otherwise(calm)


def timeline(state: DataFrame) -> DataFrame:
    """``uid, t, type, detail, severity``: regime changes, spikes' first rows, the first crossing of the memory's ceiling,
    ten rigid rows on end (once a month), quarters' snapshots and the current state."""
    w, whole = by("uid"), Window.partitionBy("uid")
    base = state.withColumns({"_before": F.lag("regime").over(w), "_oh_before": F.lag("oh").over(w), "_last": F.max("t").over(whole)})
    row = lambda kind, detail, level: (F.col("uid"), F.col("t"), F.lit(kind).alias("type"), detail.alias("detail"), level.alias("severity"))
    changes = base.where("_before IS NOT NULL AND _before <> regime").select(*row("regime_change", F.concat_ws(">", "_before", "regime"), severity(F.col("regime"), "healthy")))
    starts = base.where("oh > 1 AND coalesce(_oh_before, 0) <= 1").select(*row("oh_spike", F.lit(""), F.lit("critical")))
    over = base.where("phi > phi_c AND phi_c > 1e-5").groupBy("uid").agg(F.min("t").alias("t")).select(*row("phi_crossing", F.lit(""), F.lit("warning")))
    island = base.withColumn("_island", F.sum(F.coalesce((F.col("regime") != F.col("_before")).cast("int"), F.lit(1))).over(w))
    tenth = island.where(F.col("regime") == RIGID).withColumn("_k", F.row_number().over(Window.partitionBy("uid", "_island").orderBy("t"))).where("_k = 10")
    monthly = tenth.groupBy("uid", F.trunc("t", "month").alias("_month")).agg(F.min("t").alias("t"))
    sustained = monthly.select("uid", F.date_sub("t", 9).alias("t")).select(*row("sustained_rigidity", F.lit(""), F.lit("warning")))
    counts = base.groupBy("uid", F.trunc("t", "quarter").alias("_q"), "regime").agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.withColumn("_r", F.row_number().over(Window.partitionBy("uid", "_q").orderBy(F.desc("_n"), "regime"))).where("_r = 1").select("uid", "_q", F.col("regime").alias("_mode"))
    quarter = base.groupBy("uid", F.trunc("t", "quarter").alias("_q")).agg(F.min("t").alias("t")).join(mode, ["uid", "_q"]).select(*row("quarterly_snapshot", F.col("_mode"), F.lit("info")))
    current = base.where("t = _last").select(*row("current_state", F.col("regime"), severity(F.col("regime"), "info")))
    out = changes
    for part in (starts, over, sustained, quarter, current):
        out = out.unionByName(part)
    return out


def universe_report(state: DataFrame) -> DataFrame:
    """One row per universe: current values, extremes, alerts, status."""
    whole = Window.partitionBy("uid")
    rigid = series.runs(state, F.col("regime")).where(F.col("flag") == RIGID).groupBy("uid").agg(F.max("length").alias("tau_max"))
    spiking = spikes(state).groupBy("uid").agg(F.count(F.lit(1)).alias("n_spikes"))
    summed = state.withColumn("_last", F.max("t").over(whole)).groupBy("uid").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.max("oh"), 6).alias("oh_max"), F.round(F.max("phi"), 6).alias("phi_max"),
        F.max(F.when(F.col("t") == F.col("_last"), F.col("regime"))).alias("regime"),
        F.min(F.when(F.col("phi") > F.col("phi_c"), F.col("t"))).alias("phi_crossing"),
    )
    full = summed.join(rigid, "uid", "left").join(spiking, "uid", "left")
    full = full.withColumn("tau_max", F.coalesce("tau_max", F.lit(0)).cast("long")).withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)).cast("long"))
    status = F.when(F.col("n_spikes") > 0, "CRITICAL").when(F.col("tau_max") > 60, "PRESSURIZED").when(F.col("phi_crossing").isNotNull(), "MONITORING").otherwise("HEALTHY")
    return full.withColumn("status", status)


def global_risk(reports: DataFrame) -> DataFrame:
    """One number of 0 to 100 over all reports, and counts."""
    weight = F.when(F.col("status") == "CRITICAL", 3.0).when(F.col("status") == "PRESSURIZED", 2.0).otherwise(1.0)
    return reports.agg(
        F.round(F.least(F.lit(100.0), 25 * F.avg(F.col("oh_max") * weight)), 1).alias("risk"), F.count(F.lit(1)).alias("universes"),
        F.count_if(F.col("oh_max") > 1.0).alias("over_one"), F.count_if(F.col("regime") == RIGID).alias("rigid"),
    )


def global_trend(reports: DataFrame, trends: DataFrame) -> DataFrame:
    """One row: universes that rise and fall, what that means where one side has more than two over the other, and whether
    alarms are global (half of all universes critical), regional or none. ``trends`` has ``uid, direction``."""
    both = reports.select("uid", "status").join(trends.select("uid", "direction"), "uid", "left")
    hot = F.col("status").isin("CRITICAL", "PRESSURIZED")
    counts = both.agg(
        F.count_if(F.col("direction") == "rising").alias("rising"), F.count_if(F.col("direction") == "falling").alias("falling"),
        F.count_if(F.col("status") == "CRITICAL").alias("critical"), F.count_if(hot).alias("alarmed"), F.count(F.lit(1)).alias("universes"),
    ).where("universes > 0")
    trend = F.when(F.col("rising") > F.col("falling") + 2, "deteriorating").when(F.col("falling") > F.col("rising") + 2, "improving").otherwise("mixed")
    reach = F.when((F.col("alarmed") > 0) & (2 * F.col("critical") >= F.col("universes")), "global").when(F.col("alarmed") > 0, "regional").otherwise("none")
    return counts.withColumn("trend", trend).withColumn("contagion", reach)


def with_errors(reports: DataFrame, universes: DataFrame) -> DataFrame:
    """A report for each of ``universes`` (``uid``): those without one have the status ``ERROR``."""
    return universes.select("uid").distinct().join(reports, "uid", "left").withColumn("status", F.coalesce("status", F.lit("ERROR")))


def semi_anti(series_: DataFrame, periods: DataFrame, columns: list[str]) -> DataFrame:
    """Means of rows in any of the ``periods`` (``low, high`` inclusive, a stated few) and in none, and their difference.

    Overlapping periods count a row once: it is in or out by a semi-join."""
    own = F.broadcast(periods.select("low", "high"))
    inside = (F.col("t") >= F.col("low")) & (F.col("t") <= F.col("high"))
    parts = series_.join(own, inside, "left_semi").withColumn("extreme", F.lit(True)).unionByName(series_.join(own, inside, "left_anti").withColumn("extreme", F.lit(False)))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("observable"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = parts.select("extreme", values.alias("x")).select("extreme", "x.*")
    mean = lambda flag: F.avg(F.when(F.col("extreme") == flag, F.col("v")))
    return long.groupBy("observable").agg(
        F.count_if(~F.col("extreme")).alias("n_normal"), F.count_if("extreme").alias("n_extreme"), F.round(mean(False), 6).alias("normal"), F.round(mean(True), 6).alias("extreme"),
        F.round(mean(True) - mean(False), 6).alias("delta"),
    )


def recent_trend(state: DataFrame) -> DataFrame:
    """Change of oh against 6 and 29 rows before the last, its direction, and the last value's percentile rank."""
    placed = series.numbered(state).withColumn("_back", F.col("n") - F.col("rn"))
    at = lambda k: F.max(F.when(F.col("_back") == k, F.col("oh")))
    summed = placed.groupBy("uid").agg(at(0).alias("now"), at(6).alias("week"), at(29).alias("month"), F.max("n").alias("n"))
    joined = placed.join(summed.select("uid", "now"), "uid").groupBy("uid").agg(F.round(100 * F.avg((F.col("oh") < F.col("now")).cast("double")), 6).alias("percentile"))
    delta = F.round(F.col("now") - F.col("week"), 6)
    out = summed.select("uid", F.round("now", 6).alias("current"), delta.alias("delta_7"), F.round(F.col("now") - F.col("month"), 6).alias("delta_30"))
    return out.withColumn("direction", F.when(F.col("delta_7") > 0.05, "rising").when(F.col("delta_7") < -0.05, "falling").otherwise("stable")).join(joined, "uid")


def regime_duration(state: DataFrame) -> DataFrame:
    """How long the current regime has lasted, and how long its runs last otherwise."""
    all_runs = series.runs(state, F.col("regime"))
    last = all_runs.withColumn("_r", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("end")))).where("_r = 1").select("uid", F.col("flag").alias("regime"), F.col("length").alias("duration"))
    other = all_runs.select("uid", F.col("flag").alias("regime"), "length").join(last, ["uid", "regime"]).groupBy("uid", "regime", "duration").agg(F.round(F.avg("length"), 6).alias("mean_duration"), F.max("length").alias("max_duration"))
    return other.withColumn("above_average", F.col("duration") > F.col("mean_duration"))


def sparkline(state: DataFrame, every: int = 5) -> DataFrame:
    return series.numbered(state).where((F.col("rn") - 1) % every == 0).select("uid", "t", F.round("oh", 6).alias("oh"))


def forward_target(state: DataFrame, condition: Column, horizon: int, name: str = "target") -> DataFrame:
    """Whether the condition holds in any of the next ``horizon`` rows (null after the last row that has any)."""
    return state.withColumn(name, F.max(condition.cast("int")).over(by("uid").rowsBetween(1, horizon)))


def censored_target(state: DataFrame, condition: Column, horizon: int) -> DataFrame:
    """Rows before the first event, with 1 within ``horizon`` rows of it."""
    placed = series.numbered(state)
    event = placed.groupBy("uid").agg(F.min(F.when(condition, F.col("rn"))).alias("event"))
    joined = placed.join(event, "uid").where("event IS NULL OR rn < event")
    return joined.withColumn("target", F.coalesce((F.col("event") - F.col("rn") <= horizon).cast("int"), F.lit(0)))


def crossing_with_fallback(frame: DataFrame, x: str, thresholds: tuple[float, ...], persist: int) -> DataFrame:
    """``uid, crossing, event_rn, threshold``: where x first stays above the first of the thresholds that it does stay above.

    The run of ``persist`` rows ends before the series' last row: what has just begun does not count yet.
    """
    placed = series.numbered(frame.select("uid", "t", x)).withColumn("_open", F.col("n") - F.col("rn") >= persist)
    found = []
    for k, limit in enumerate(thresholds):
        on = F.when(F.col("_open") & F.col(f"_on{k}"), F.struct("t", "rn", F.lit(limit).alias("threshold")))
        placed = placed.withColumn(f"_on{k}", series.over_threshold_for(x, limit, persist))
        found.append(F.min(on))
    first = placed.groupBy("uid").agg(F.coalesce(*found).alias("_f"))
    return first.select("uid", F.col("_f.t").alias("crossing"), F.col("_f.rn").cast("long").alias("event_rn"), F.col("_f.threshold").alias("threshold"))


def lead_times(first: DataFrame, second: DataFrame, left_censored_rows: int = 60) -> DataFrame:
    """Days from one crossing to another and what they say. Both have ``uid, crossing``; the second also ``event_rn``."""
    joined = first.select("uid", F.col("crossing").alias("t_geometry")).join(second.select("uid", F.col("crossing").alias("t_structure"), "event_rn"), "uid", "full")
    lead = F.datediff("t_structure", "t_geometry")
    verdict = (
        F.when(F.col("t_structure").isNull() & F.col("t_geometry").isNull(), "NO_SIGNAL")
        .when(F.col("t_structure").isNull(), "GEOMETRY_ONLY")
        .when(F.col("event_rn") < left_censored_rows, "LEFT_CENSORED")
        .when(F.col("t_geometry").isNull(), "STRUCTURE_ONLY")
        .when(lead > 0, "GEOMETRY_LEADS").when(lead == 0, "SIMULTANEOUS").otherwise("STRUCTURE_LEADS")
    )
    return joined.select("uid", "t_geometry", "t_structure", lead.cast("long").alias("lead_days"), verdict.alias("verdict"))


def interval_labels(points: DataFrame, intervals: DataFrame, default: str = "normal") -> DataFrame:
    """Each point's label: that of the interval with the greatest priority that holds it. ``intervals`` has ``low, high,
    label, priority`` and is a stated small table."""
    joined = points.join(F.broadcast(intervals), F.col("x").between(F.col("low"), F.col("high")), "left")
    best = F.max(F.struct("priority", "label"))
    return joined.groupBy("id", "x").agg(best.alias("b")).select("id", "x", F.coalesce("b.label", F.lit(default)).alias("label"))


def excursions(points: DataFrame, threshold: float) -> DataFrame:
    """Per series: excursions above the threshold, their longest run, the distribution's high quantiles, drift."""
    found = series.runs(points, F.col("x") > threshold).where("flag").groupBy("uid").agg(F.count(F.lit(1)).alias("n_excursions"), F.max("length").alias("longest"), F.count_if(F.col("length") >= 2).alias("recurrent"))
    placed = series.numbered(points).withColumn("rn", F.col("rn").cast("double"))
    summed = placed.groupBy("uid").agg(
        F.count(F.lit(1)).alias("rows"), *(F.round(F.percentile("x", F.lit(q)), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)),
        F.round(100 * F.avg((F.col("x") > threshold).cast("double")), 6).alias("share_over"),
        # covariance over n - 1, variance over n
        F.round(F.try_divide(F.covar_samp("rn", "x"), F.var_pop("rn")), 6).alias("drift"),
    )
    joined = summed.join(found, "uid", "left")
    return joined.select("uid", "rows", "p50", "p95", "p99", "share_over", "drift", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_excursions", "longest", "recurrent")))


#: What stress is expected to do to each observable: up, or down.
DIRECTIONS = {"oh": 1, "eta": 1, "divergence": 1, "xi": -1, "mean_corr": 1}


def direction_test(frame: DataFrame, condition: Column, directions: dict[str, int]) -> DataFrame:
    """Means in stress and otherwise per observable, and whether the difference goes the expected way."""
    marked = frame.withColumn("_stress", condition)
    long = marked.select("_stress", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in directions]), F.array(*[F.col(k).cast("double") for k in directions]))).alias("observable", "value"))
    means = long.groupBy("observable").agg(F.avg(F.when(F.col("_stress"), F.col("value"))).alias("s"), F.avg(F.when(~F.col("_stress"), F.col("value"))).alias("c"))
    sign = F.element_at(F.create_map(*[F.lit(x) for kv in directions.items() for x in kv]), F.col("observable"))
    delta = F.round(F.col("s") - F.col("c"), 6)
    return means.select("observable", F.round("s", 6).alias("stressed"), F.round("c", 6).alias("calm"), delta.alias("delta"), (delta * sign > 0).alias("confirmed"))


def shifted_pairs(returns: DataFrame, threshold: float = 0.3, recent: int = 22, quiet: int = 252) -> DataFrame:
    """Pairs whose correlation moved by the threshold at least, largest first."""
    moved = coupling.pair_shifts(returns, recent, quiet).where(F.abs("delta") >= threshold)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc(F.abs("delta")), "a", "b"))
    return moved.withColumn("rank", rank).withColumn("kind", F.when(F.col("delta") > 0, "coupling").otherwise("decoupling"))


def pair_summary(moved: DataFrame) -> DataFrame:
    return moved.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "coupling").alias("coupling"), F.count_if(F.col("kind") == "decoupling").alias("decoupling"), F.round(F.avg(F.abs("delta")) + 1e-9, 6).alias("mean_shift"))


def state_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """What changed between two snapshots of ``uid, status``."""
    both = previous.select("uid", F.col("status").alias("before")).join(current.select("uid", F.col("status").alias("after")), "uid", "full")
    change = F.when(F.col("before").isNull(), "NEW").when(F.col("after").isNull(), "GONE").when(F.col("before") == F.col("after"), "SAME").otherwise("CHANGED")
    return both.withColumn("change", change)


def contagion(reports: DataFrame, links: DataFrame) -> DataFrame:
    """For stated pairs of universes: both critical spreads, one contains, none is calm."""
    side = lambda name: reports.select(F.col("uid").alias(name), F.col("status").alias(f"{name}_status"))
    joined = links.join(side("source"), "source").join(side("target"), "target")
    hot = lambda name: F.col(f"{name}_status").isin("CRITICAL", "PRESSURIZED")
    rule = F.when(hot("source") & hot("target"), "CONTAGION").when(hot("source") | hot("target"), "CONTAINED").otherwise("CALM")
    return joined.withColumn("rule", rule)
