"""Capacity, hazard at two horizons, probabilities, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import EPS, HAZARD, RIGID, STATE, HazardConfig
from lattica.operators import series
from lattica.operators.state import knee
from lattica.sources.panels import by


def with_capacity_limit(full: DataFrame, cfg: HazardConfig = HAZARD) -> DataFrame:
    """Adds ``phi_star``, the knee of a series' memory, and ``estimated``: whether it has none and twice its peak stands in."""
    peak = F.round(2 * F.max("phi").over(Window.partitionBy("uid")), 9)
    known = full.join(knee(full, "phi"), "uid")
    estimated = F.col("knee") < cfg.capacity_least
    return known.withColumn("estimated", estimated).withColumn("phi_star", F.when(estimated, F.greatest(peak, F.lit(cfg.capacity_least))).otherwise(F.col("knee"))).drop("knee")


def structural_label(theta: Column, capacity_share: Column) -> Column:
    """What a row is called: damage outweighs an attractor's strength."""
    return F.when(capacity_share < 0.9, "DAMAGED").when(theta >= 2.0, "CRYSTALLIZED").when(theta > 0.1, "CRYSTALLIZING").otherwise("NOMINAL")


def capacity(state: DataFrame, cfg: HazardConfig = HAZARD) -> DataFrame:
    """Adds what is left of ``phi_star``: ``capacity, capacity_share, fragility, depletion, depletion_mean, exhaustion``
    and ``false_recovery``. ``state`` has ``oh, oh_pre, phi, phi_star, regime``."""
    w = by("uid")
    left = state.withColumn("capacity", F.round(F.col("phi_star") - F.col("phi"), 9)).withColumn("capacity_share", F.round(F.col("capacity") / F.col("phi_star"), 9))
    fragility = F.greatest(F.lit(0.0), F.least(F.lit(cfg.fragility_cap), F.log(F.col("phi_star") / F.greatest("capacity", F.lit(EPS)))))
    # the margin here is the decay's share of the state's margin
    drive = F.greatest(F.col("oh") - F.col("oh_pre") - cfg.decay * STATE.margin, F.lit(0.0))
    spent = left.withColumn("fragility", F.round(fragility, 9)).withColumn("depletion", F.round(drive - (1 - cfg.decay) * F.coalesce(F.lag("phi").over(w), F.lit(0.0)), 9))
    mean = series.folded(spent, ["depletion"], ["depletion_mean"], lambda x: [series.smoothed(x, cfg.smoothing)])
    joined = spent.join(mean, ["uid", "t"]).withColumn("depletion_mean", F.round("depletion_mean", 9))
    exhaustion = F.when(F.col("depletion_mean") > EPS, F.greatest("capacity", F.lit(EPS)) / F.col("depletion_mean"))
    was_rigid = F.max((F.col("regime") == RIGID).cast("int")).over(w.rowsBetween(-cfg.recovery_rows, -1))
    false = (F.col("oh") < 1.0) & (F.col("capacity_share") < cfg.recovery_share) & (F.coalesce(was_rigid, F.lit(0)) == 1)
    return joined.withColumn("exhaustion", exhaustion).withColumn("false_recovery", false)


def logistic_hazard(beta: tuple[float, ...], *covariates: Column) -> Column:
    line = F.lit(beta[0]) + sum((b * c for b, c in zip(beta[1:], covariates, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), line))))


def collapse_probability(hazard: Column, steps: int) -> Column:
    return 1 - F.pow(F.greatest(1 - hazard, F.lit(EPS)), F.lit(steps))


def half_life(hazard: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1e6), F.lit(-0.6931471805599453) / F.log(F.greatest(1 - F.greatest(hazard, F.lit(EPS)), F.lit(EPS)))))


def normal_rigidity(state: DataFrame, cfg: HazardConfig = HAZARD) -> DataFrame:
    """Adds ``eta_norm``: smoothed eta over its quiet mean, capped."""
    smooth = series.folded(state, ["eta"], ["eta_smooth"], lambda x: [series.smoothed(x, cfg.smoothing)])
    joined = state.join(smooth, ["uid", "t"])
    mean = F.avg(F.when(series.quiet(), F.col("eta_smooth"))).over(Window.partitionBy("uid"))
    return joined.withColumn("eta_norm", F.round(F.greatest(F.lit(0.0), F.least(F.lit(cfg.rigidity_cap), F.col("eta_smooth") / F.greatest(mean, F.lit(EPS)))), 9)).drop("eta_smooth")


def with_hazard(frame: DataFrame, cfg: HazardConfig = HAZARD) -> DataFrame:
    """Adds hazards, probabilities and half-lives from ``fragility, depletion_mean, eta_norm, theta``."""
    covariates = (F.col("fragility"), F.greatest("depletion_mean", F.lit(0.0)), F.col("eta_norm"), F.col("theta"))
    both = frame.withColumn("h90", logistic_hazard(cfg.beta_90, *covariates)).withColumn("h60", logistic_hazard(cfg.beta_60, *covariates))
    return both.withColumns({
        "p30": collapse_probability(F.col("h90"), 30), "p60": collapse_probability(F.col("h60"), 60), "p90": collapse_probability(F.col("h90"), 90),
        "half_life_90": half_life(F.col("h90")), "half_life_60": half_life(F.col("h60")),
    })


def combined_pressure(frame: DataFrame, cfg: HazardConfig = HAZARD) -> DataFrame:
    """Adds ``pressure``: scaled fragility, times scaled attractor strength unless that is zero throughout."""
    seen = F.max(F.abs("theta")).over(Window.partitionBy("uid")) > EPS
    k = F.least(F.greatest("fragility", F.lit(0.0)) / cfg.fragility_scale, F.lit(1.0))
    a = F.greatest(F.least(F.col("theta") / cfg.attractor_scale, F.lit(1.0)), F.lit(0.0))
    return frame.withColumn("pressure", F.when(seen, k * a).otherwise(k))


def alert_level(estimated: Column, cfg: HazardConfig = HAZARD) -> Column:
    """The gravest rule that holds; none without a baseline."""
    share, h = F.col("capacity_share"), F.col("h90")
    return (
        F.when(estimated, "BASELINE_INSUFFICIENT")
        .when((share < 0) | ((h >= cfg.hazard_emergency) & (share < 0.5)), "EMERGENCY")
        .when(((h >= cfg.hazard_warn) & (share < 0.7)) | (F.col("half_life_90") < cfg.half_life_warn), "WARNING")
        .when((share < 0.5) | (F.col("fragility") > cfg.fragility_warn), "WATCH")
        .otherwise("NOMINAL")
    )
