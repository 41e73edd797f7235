"""From a panel to structural state: rigidity number, memory, regimes, quiet windows, viscosity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.config import EPS, FLOW, RIGID, SHIFT, STATE, StateConfig
from lattica.operators import coupling, network, series
from lattica.runtime import remembered, written
from lattica.sources.panels import by, returns, weekly_universes


def window_state(rets: DataFrame, cfg: StateConfig = STATE) -> DataFrame:
    """``uid, t, mean_corr, curvature, eta, vol`` per full window, in DataFrame functions only."""
    edges = coupling.shrunk(coupling.rolling_pearson(rets, cfg.window), cfg.shrink)
    distances = edges.withColumn("d", F.round(coupling.angular_distance(F.col("c"), cfg.distance_power), 9))
    keys = ["uid", "t"]
    graph = network.nearest_neighbours(distances, keys, cfg.neighbours)
    rigid = network.rigidity(network.forman_ricci(graph, keys), keys, floor=cfg.rigidity_floor)
    mean = coupling.mean_coupling(edges).select("uid", "t", "mean_corr")
    return mean.join(rigid, keys).join(coupling.realized_volatility(rets, cfg.window), keys)


def quantile_where(x: Column, condition: Column, q: float, window: Window) -> Column:
    return F.percentile(F.when(condition, x), F.lit(q)).over(window)


def rigidity_number(state: DataFrame, cfg: StateConfig = STATE) -> DataFrame:
    """Adds ``rn, n, oh`` and the calibration: eta's low quantile over eta, relative to its quiet ceiling."""
    whole, calm = Window.partitionBy("uid"), series.quiet(cfg.quiet_share)
    placed = series.numbered(state)
    ref = placed.withColumn("eta_ref", F.greatest(quantile_where(F.col("eta"), calm, 0.05, whole), F.lit(EPS)))
    index = ref.withColumn("_lambda", F.col("eta_ref") / (F.col("eta") + EPS))
    limit = index.withColumn("lambda_c", F.greatest(quantile_where(F.col("_lambda"), calm, 0.99, whole) * 1.02, F.lit(EPS)))
    return limit.withColumn("oh", F.round(F.col("_lambda") / F.col("lambda_c"), 9)).drop("_lambda")


def with_memory(state: DataFrame, cfg: StateConfig = STATE) -> DataFrame:
    """Adds ``oh_pre``, the leaky memory ``phi`` with its floor, and its ceiling ``phi_c``."""
    whole, calm = Window.partitionBy("uid"), series.quiet(cfg.quiet_share)
    pre = state.withColumn("oh_pre", F.round(quantile_where(F.col("oh"), calm, cfg.pre_quantile, whole), 9))
    driven = pre.withColumn("drive", F.greatest(F.round(F.col("oh") - (F.col("oh_pre") + cfg.margin), 9), F.lit(0.0)))
    memory = series.folded(driven, ["drive"], ["phi"], lambda d: [series.leaky_memory(d, cfg.decay, cfg.memory_floor)])
    joined = driven.join(memory, ["uid", "t"]).withColumn("phi", F.round("phi", 9))
    return joined.withColumn("phi_c", F.round(quantile_where(F.col("phi"), calm, cfg.memory_quantile, whole), 9))


def with_regime(state: DataFrame, cfg: StateConfig = STATE) -> DataFrame:
    """Adds ``regime``: rigid above the quiet 95 % of oh or twice that of phi, shifting above either's 75 %."""
    whole, calm = Window.partitionBy("uid"), series.quiet(cfg.quiet_share)
    q = lambda c, p: F.round(quantile_where(F.col(c), calm, p, whole), 9)
    limits = state.withColumns({"_o75": q("oh", 0.75), "_o95": q("oh", 0.95), "_p75": q("phi", 0.75), "_p95": q("phi", 0.95)})
    rigid = (F.col("oh") >= F.col("_o95")) | (F.col("phi") >= 2 * F.col("_p95"))
    shifting = (F.col("oh") >= F.col("_o75")) | (F.col("phi") >= F.col("_p75"))
    return limits.withColumn("regime", F.when(rigid, RIGID).when(shifting, SHIFT).otherwise(FLOW)).drop("_o75", "_o95", "_p75", "_p95")


SOURCES = ("orders", "customer", "nation", "region")


def universe_windows(spark: SparkSession, sf_dir: str, cfg: StateConfig = STATE) -> DataFrame:
    """Windows of the weekly universes with their place and the rigidity number, written once per session and input."""

    def build() -> DataFrame:
        return rigidity_number(written(window_state(returns(weekly_universes(spark, sf_dir)), cfg), "windows"), cfg)

    return remembered(spark, ("rigidity", sf_dir, cfg), sf_dir, SOURCES, build)


def universe_state(spark: SparkSession, sf_dir: str, cfg: StateConfig = STATE) -> DataFrame:
    """The whole chain over the weekly universes, written once per session and input: many readers need it."""
    return remembered(spark, ("state", sf_dir, cfg), sf_dir, SOURCES, lambda: with_regime(with_memory(universe_windows(spark, sf_dir, cfg), cfg), cfg))


def quiet_candidates(dates: DataFrame, cfg: StateConfig = STATE) -> DataFrame:
    """``uid, k, start, end, rows``: windows of ``quiet_days`` that end every ``quiet_step`` days back from the quiet
    share's date, snapped to dates that exist; those with too few rows go."""
    placed = series.numbered(dates)
    span = placed.groupBy("uid").agg(
        F.min("t").alias("first"),
        F.min(F.when(F.col("rn") == F.floor(F.col("n") * cfg.quiet_share) + 1, F.col("t"))).alias("search_to"),
    )
    steps = F.floor((F.datediff("search_to", "first") - 1) / cfg.quiet_step).cast("int")
    ends = span.where("search_to > first").select("uid", "first", "search_to", F.explode(F.sequence(F.lit(0), steps)).alias("k"))
    raw = ends.select("uid", "k", F.date_sub("search_to", F.col("k") * cfg.quiet_step).alias("raw_end"), "first")
    raw = raw.withColumn("raw_start", F.greatest(F.date_sub("raw_end", cfg.quiet_days), "first"))
    inside = raw.join(placed.select("uid", "t"), "uid").where("t BETWEEN raw_start AND raw_end")
    rows = inside.groupBy("uid", "k").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("rows"))
    return rows


def quiet_scores(state: DataFrame, candidates: DataFrame, least_rows: int) -> DataFrame:
    """Roughness of eta and coupling inside each candidate: deviations, mean absolute steps, a quarter of volatility."""
    joined = state.join(candidates, "uid").where("t BETWEEN start AND end")
    w = Window.partitionBy("uid", "k").orderBy("t")
    stepped = joined.withColumn("_de", F.abs(F.col("eta") - F.lag("eta").over(w))).withColumn("_dm", F.abs(F.col("mean_corr") - F.lag("mean_corr").over(w)))
    score = F.stddev_pop("eta") + F.stddev_pop("mean_corr") + F.avg("_de") + F.avg("_dm") + 0.25 * F.avg("vol")
    return stepped.groupBy("uid", "k", "start", "end").agg(F.count(F.lit(1)).alias("rows"), F.round(score, 6).alias("score")).where(F.col("rows") >= least_rows)


def rise_at_end(eta: np.ndarray, cfg: StateConfig = STATE) -> tuple[float, float]:
    """How far a memory that starts empty in a quiet window rises at its end: its steps there over those before, beyond
    the tolerated ratio, and its yearly slope; zeros for short windows."""
    if len(eta) < cfg.rise_rows:
        return 0.0, 0.0
    pressure = np.round(max(float(np.quantile(eta, 0.05)), EPS) / (eta + EPS), 9)
    drive = np.maximum(np.round(pressure - (np.quantile(pressure, cfg.pre_quantile) + cfg.margin), 9), 0.0)
    memory = series.leaky_memory(drive, cfg.decay, cfg.memory_floor)
    end = int((1 - cfg.rise_share) * len(eta))
    steps = np.maximum(np.round(np.diff(memory), 9), 0.0)
    ratio = float(np.median(steps[max(0, end - 1) :]) / (np.median(steps[: max(3, end - 1)]) + EPS))
    tail = memory[end:]
    x = np.arange(len(tail)) - (len(tail) - 1) / 2
    slope = 252 * float((x * tail).sum() / (x * x).sum()) if len(tail) >= 8 else 0.0
    return max(0.0, ratio - cfg.rise_ratio), max(0.0, slope - cfg.rise_slope) / (abs(cfg.rise_slope) + 1.0)


def quiet_rises(state: DataFrame, candidates: DataFrame, cfg: StateConfig = STATE) -> DataFrame:
    """``uid, k, rise_ratio, rise_slope, penalty``: one fold a candidate window over the rows that the window holds."""
    types = dict(state.dtypes)

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        ratio, slope = rise_at_end(table["eta"].to_numpy(), cfg)
        return pa.table([table["uid"][:1], table["k"][:1], pa.array([ratio]), pa.array([slope])], names=["uid", "k", "rise_ratio", "rise_slope"])

    inside = state.join(candidates.select("uid", "k", "start", "end"), "uid").where("t BETWEEN start AND end").select("uid", "k", "t", "eta")
    found = inside.groupBy("uid", "k").applyInArrow(fold, f"uid {types['uid']}, k int, rise_ratio double, rise_slope double")
    penalty = cfg.rise_weight * ((1 - cfg.rise_mix) * F.col("rise_ratio") + cfg.rise_mix * F.col("rise_slope"))
    return found.withColumn("penalty", F.round(penalty, 6))


def quiet_penalised(scores: DataFrame, rises: DataFrame) -> DataFrame:
    """Scores of candidates with the penalty of what builds up at their end added."""
    return scores.join(rises, ["uid", "k"]).withColumn("score", F.round(F.col("score") + F.col("penalty"), 6))


def quiet_required(universes: DataFrame, top: DataFrame) -> DataFrame:
    """``top`` as it is; reading it fails where one of ``universes`` (``uid``) has no quiet window."""
    found = universes.select("uid").distinct().join(top, "uid", "left")
    told = F.concat(F.lit("no quiet window in universe "), F.col("uid").cast("string"), F.lit(": take a longer history, shorter windows or a later last date"))
    return found.where(F.when(F.col("rank").isNull(), F.raise_error(told).cast("boolean")).otherwise(F.lit(True)))


def quiet_top(scores: DataFrame, top: int = STATE.quiet_top) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("uid").orderBy("score", "start", "k"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= top)


def quiet_ensemble(state: DataFrame, top: DataFrame, cfg: StateConfig = STATE) -> DataFrame:
    """Median over the top candidates of their calibrations: ``uid, candidates, eta_ref, lambda_c, oh_pre``."""
    inside = state.join(top.select("uid", "k", "start", "end"), "uid").where("t BETWEEN start AND end")
    ref = inside.groupBy("uid", "k").agg(F.greatest(F.percentile("eta", F.lit(0.05)), F.lit(EPS)).alias("eta_ref"))
    index = inside.join(ref, ["uid", "k"]).withColumn("_lambda", F.col("eta_ref") / (F.col("eta") + EPS))
    limit = index.groupBy("uid", "k").agg(
        F.first("eta_ref").alias("eta_ref"), (F.percentile("_lambda", F.lit(0.99)) * 1.02).alias("lambda_c"), F.percentile("_lambda", F.lit(cfg.pre_quantile)).alias("pre")
    )
    own = limit.withColumn("oh_pre", F.col("pre") / F.col("lambda_c"))
    return own.groupBy("uid").agg(F.count(F.lit(1)).alias("candidates"), *(F.round(F.median(c), 6).alias(c) for c in ("eta_ref", "lambda_c", "oh_pre")))


def regime_summary(state: DataFrame) -> DataFrame:
    """Shares of regimes, memory in total, longest and mean rigid run, rigidity while rigid."""
    rigid = series.runs(state, F.col("regime")).where(F.col("flag") == RIGID)
    lengths = rigid.groupBy("uid").agg(F.max("length").alias("tau_max"), F.round(F.avg("length"), 6).alias("tau_mean"))
    share = lambda r: F.round(F.avg((F.col("regime") == r).cast("double")), 6)
    whole = state.groupBy("uid").agg(
        share(FLOW).alias("share_flow"), share(SHIFT).alias("share_shift"), share(RIGID).alias("share_rigid"),
        F.round(F.sum("phi"), 6).alias("phi_integral"), F.round(F.max("phi"), 6).alias("phi_max"),
        F.round(F.avg(F.when(F.col("regime") == RIGID, F.col("eta"))), 6).alias("eta_rigid"),
    )
    return whole.join(lengths, "uid", "left").withColumn("tau_max", F.coalesce("tau_max", F.lit(0)).cast("long")).withColumn("tau_mean", F.coalesce("tau_mean", F.lit(0.0)))


def pressure_signature(state: DataFrame, cfg: StateConfig = STATE) -> DataFrame:
    """Share, onset and longest run of rows where pressure, memory, its growth, rigidity, poverty of cycles and
    coherence hold together. ``state`` has ``oh, phi, eta, xi, divergence, oh_pre, phi_c``."""
    whole, calm, w = Window.partitionBy("uid"), series.quiet(cfg.quiet_share), by("uid")
    limits = state.withColumns({"_e75": quantile_where(F.col("eta"), calm, 0.75, whole), "_d75": quantile_where(F.col("divergence"), calm, 0.75, whole), "_dphi": F.coalesce(F.col("phi") - F.lag("phi").over(w), F.lit(0.0))})
    conditions = {
        "c1": F.col("oh") > F.col("oh_pre"), "c2": F.col("phi") > F.col("phi_c"), "c3": F.col("_dphi") > 0,
        "c4": F.col("eta") > F.col("_e75"), "c5": F.col("xi") < 1.0, "c6": F.col("divergence") < F.col("_d75"),
    }
    marked = limits.withColumns(conditions).withColumn("all6", F.expr("c1 AND c2 AND c3 AND c4 AND c5 AND c6"))
    longest = series.runs(marked, F.col("all6")).where("flag").groupBy("uid").agg(F.max("length").alias("longest"))
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    summed = marked.groupBy("uid").agg(share("all6").alias("tau"), F.min(F.when(F.col("all6"), F.col("t"))).alias("onset"), *(share(c).alias(c) for c in conditions))
    return summed.join(longest, "uid", "left").withColumn("longest", F.coalesce("longest", F.lit(0)).cast("long"))


def preparation_ratio(state: DataFrame, lookback: int = 5) -> DataFrame:
    """Cumulative memory ``lookback`` rows before its peak over that at the peak; null under 0.01."""
    total = state.withColumn("cum", F.sum("phi").over(by("uid").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_peak", F.max("phi").over(Window.partitionBy("uid")))
    peak = total.groupBy("uid").agg(F.min(F.when(F.col("phi") == F.col("_peak"), F.col("rn"))).alias("event"))
    at = total.join(peak, "uid")
    sums = at.groupBy("uid").agg(F.max(F.when(F.col("rn") == F.col("event"), F.col("cum"))).alias("at_event"), F.max(F.when(F.col("rn") == F.greatest(F.lit(1), F.col("event") - lookback), F.col("cum"))).alias("before"))
    return sums.select("uid", F.round(F.when(F.col("at_event") >= 0.01, F.col("before") / F.col("at_event")), 6).alias("preparation"))


def knee(series_: DataFrame, x: str) -> DataFrame:
    """The sorted values above their mean at their greatest curvature (zero with ten or fewer)."""
    above = series_.withColumn("_m", F.avg(x).over(Window.partitionBy("uid"))).where(F.col(x) > F.col("_m"))
    w = Window.partitionBy("uid").orderBy(x, "t")
    size = F.count(F.lit(1)).over(Window.partitionBy("uid"))
    placed = above.select("uid", "t", F.col(x).alias("x"), F.row_number().over(w).alias("i"), size.alias("m"))
    o = Window.partitionBy("uid").orderBy("i")

    def gradient(c: str) -> Column:
        before, after, step = F.lag(c).over(o), F.lead(c).over(o), 1.0 / (F.col("m") - 1)
        return F.when(before.isNull(), (after - F.col(c)) / step).when(after.isNull(), (F.col(c) - before) / step).otherwise((after - before) / (2 * step))

    curved = placed.where("m > 10").withColumn("d1", gradient("x")).withColumn("d2", gradient("d1"))
    scored = curved.withColumn("k", F.round(F.abs("d2") / F.pow(1 + F.col("d1") * F.col("d1"), F.lit(1.5)), 12))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("k"), "i"))).where("r = 1").select("uid", F.round("x", 6).alias("knee"))
    return series_.select("uid").distinct().join(best, "uid", "left").select("uid", F.coalesce("knee", F.lit(0.0)).alias("knee"))


def correlation_p(r: Column, n: Column) -> Column:
    """Chance that a correlation of n pairs is as large by accident: two tails of Student's t with n - 2 degrees, as the
    finite series that it has for whole degrees. Null under three pairs."""
    degrees = (n - 2).cast("int")
    size = F.least(F.abs(r), F.lit(1.0))
    square = 1 - size * size
    even = degrees % 2 == 0
    terms = F.when(even, degrees / 2).otherwise((degrees - 1) / 2).cast("int")
    step = lambda k: F.when(even, (2 * k - 1) / (2 * k)).otherwise(2 * k / (2 * k + 1))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * step(k) * square
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    places = F.when(terms > 1, F.sequence(F.lit(1), F.greatest(terms - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.when(terms > 0, F.aggregate(places, one, add, lambda s: s["total"])).otherwise(0.0)
    inside = F.when(even, size * total).otherwise(2 / math.pi * (F.asin(size) + size * F.sqrt(square) * total))
    return F.when(degrees >= 1, F.greatest(1 - inside, F.lit(0.0)))


def yearly_warming(state: DataFrame, cfg: StateConfig = STATE) -> DataFrame:
    """Per year of 20 rows and more: slope and the chance of one as steep, shares above quiet limits and one, lag-one correlation, longest run."""
    whole, calm = Window.partitionBy("uid"), series.quiet(cfg.quiet_share)
    limits = state.withColumns({"_p90": F.round(quantile_where(F.col("oh"), calm, 0.90, whole), 9), "_p95": F.round(quantile_where(F.col("oh"), calm, 0.95, whole), 9), "year": F.year("t")})
    w = Window.partitionBy("uid", "year").orderBy("t")
    year = limits.withColumns({"i": F.row_number().over(w).cast("double"), "_lag": F.lag("oh").over(w), "_above": F.col("oh") > F.col("_p90")})
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 6)
    paired = F.col("_lag").isNotNull()
    tie = F.try_divide(F.covar_pop("oh", "i"), F.stddev_pop("oh") * F.stddev_pop("i"))
    acf = F.try_divide(F.covar_pop("oh", "_lag"), F.stddev_pop(F.when(paired, F.col("oh"))) * F.stddev_pop("_lag"))
    summed = year.groupBy("uid", "year").agg(
        F.count(F.lit(1)).alias("rows"), F.round(252 * F.regr_slope("oh", "i"), 6).alias("slope"), F.round(correlation_p(F.coalesce(tie, F.lit(0.0)), F.count(F.lit(1))), 6).alias("slope_p"), share(F.col("_above")).alias("share_p90"),
        share(F.col("oh") > F.col("_p95")).alias("share_p95"), share(F.col("oh") > 1.0).alias("share_one"), F.round(acf, 6).alias("acf1"), F.round(F.max("phi"), 6).alias("phi_max"),
    ).where("rows >= 20")
    islands = series.runs(year.withColumn("uid", F.concat_ws("|", "uid", "year")), F.col("_above")).where("flag")
    longest = islands.groupBy(F.substring_index("uid", "|", 1).alias("uid"), F.substring_index("uid", "|", -1).cast("int").alias("year")).agg(F.max("length").alias("longest"))
    return summed.join(longest, ["uid", "year"], "left").withColumn("longest", F.coalesce("longest", F.lit(0)).cast("long"))
