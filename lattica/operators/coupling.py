"""Coupling of a panel's members: windows of correlations, distances, symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import STATE
from lattica.sources.panels import by


def safe_corr(x: str, y: str, window: Window | None = None) -> Column:
    """Pearson correlation; zero where a side is constant, which ``corr`` would raise on."""
    over = (lambda c: c.over(window)) if window is not None else (lambda c: c)
    value = F.try_divide(over(F.covar_pop(x, y)), over(F.stddev_pop(x)) * over(F.stddev_pop(y)))
    known = F.coalesce(value, F.lit(0.0))  # first: least and greatest would pass over a null
    return F.greatest(F.least(known, F.lit(1.0)), F.lit(-1.0))


def pairs(returns: DataFrame) -> DataFrame:
    """``uid, t, a, b, ra, rb`` for every two assets of a date, once."""
    left = returns.select("uid", "t", F.col("asset").alias("a"), F.col("r").alias("ra"))
    right = returns.select("uid", "t", F.col("asset").alias("b"), F.col("r").alias("rb"))
    return left.join(right, ["uid", "t"]).where("a < b")


def rolling_pearson(returns: DataFrame, window: int = STATE.window) -> DataFrame:
    """``uid, t, a, b, c`` over the full inclusive windows."""
    frame = by("uid", "a", "b").rowsBetween(1 - window, 0)
    rolled = pairs(returns).select("uid", "t", "a", "b", F.round(safe_corr("ra", "rb", frame), 9).alias("c"), F.count(F.lit(1)).over(frame).alias("rows"))
    return rolled.where(F.col("rows") == window).drop("rows")


def exploded_windows(returns: DataFrame, window: int) -> DataFrame:
    """Each row in every full window that holds it: ``uid, t`` (the window's end), ``s, asset, r``."""
    place = returns.withColumn("i", F.row_number().over(by("uid", "asset")))
    ends = place.select("uid", "asset", F.col("i").alias("end"), F.col("t").alias("t")).where(F.col("end") >= window)
    spread = place.select("uid", "asset", F.col("t").alias("s"), "r", F.explode(F.sequence("i", F.col("i") + window - 1)).alias("end"))
    return spread.join(ends, ["uid", "asset", "end"]).select("uid", "t", "s", "asset", "r")


def rolling_spearman(returns: DataFrame, window: int = STATE.window) -> DataFrame:
    """Spearman correlation with average ranks inside each window."""
    inside = Window.partitionBy("uid", "t", "asset")
    ties = F.count(F.lit(1)).over(Window.partitionBy("uid", "t", "asset", "r"))
    ranked = exploded_windows(returns, window).withColumn("rank", F.rank().over(inside.orderBy("r")) + (ties - 1) / 2.0)
    left = ranked.select("uid", "t", "s", F.col("asset").alias("a"), F.col("rank").alias("ra"))
    right = ranked.select("uid", "t", "s", F.col("asset").alias("b"), F.col("rank").alias("rb"))
    return left.join(right, ["uid", "t", "s"]).where("a < b").groupBy("uid", "t", "a", "b").agg(F.round(safe_corr("ra", "rb"), 9).alias("c"))


def shrunk(edges: DataFrame, weight: float = STATE.shrink) -> DataFrame:
    return edges.withColumn("c", F.round((1 - weight) * F.col("c"), 9))


def angular_distance(c: Column, power: float = STATE.distance_power) -> Column:
    return F.pow(F.sqrt(F.greatest(2 * (1 - c), F.lit(0.0))), F.lit(power))


def plain_distance(c: Column, power: float = STATE.distance_power) -> Column:
    """The lineage variant: one minus correlation, between 0 and 2."""
    return F.pow(F.greatest(F.least(1 - c, F.lit(2.0)), F.lit(0.0)), F.lit(power))


def mean_coupling(edges: DataFrame) -> DataFrame:
    """Mean of the signed and of the absolute correlations by window."""
    return edges.groupBy("uid", "t").agg(F.round(F.avg("c"), 9).alias("mean_corr"), F.round(F.avg(F.abs("c")), 9).alias("mean_abs_corr"))


def realized_volatility(returns: DataFrame, window: int = STATE.window) -> DataFrame:
    """Mean over assets of the window's standard deviation."""
    frame = by("uid", "asset").rowsBetween(1 - window, 0)
    rolled = returns.select("uid", "t", F.stddev_pop("r").over(frame).alias("s"), F.count(F.lit(1)).over(frame).alias("rows"))
    return rolled.where(F.col("rows") == window).groupBy("uid", "t").agg(F.round(F.avg("s"), 9).alias("vol"))


def pair_shifts(returns: DataFrame, recent: int = STATE.window, quiet: int = 252) -> DataFrame:
    """Correlation of the last rows against that of the quiet first rows, per pair."""
    both = pairs(returns).withColumn("i", F.row_number().over(by("uid", "a", "b"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("uid", "a", "b")))
    new, old = F.col("i") > F.col("n") - recent, F.col("i") <= quiet
    marked = both.select("uid", "a", "b", *(F.when(cond, F.col(c)).alias(f"{k}{c}") for k, cond in (("new_", new), ("old_", old)) for c in ("ra", "rb")))
    shifted = marked.groupBy("uid", "a", "b").agg(F.round(safe_corr("new_ra", "new_rb"), 6).alias("corr_now"), F.round(safe_corr("old_ra", "old_rb"), 6).alias("corr_quiet"))
    return shifted.withColumn("delta", F.round(F.col("corr_now") - F.col("corr_quiet"), 6))


def symbols(edges: DataFrame, quiet_share: float = STATE.quiet_share) -> DataFrame:
    """A bit per pair and window: correlation under the pair's median in the quiet first share of windows."""
    placed = edges.withColumn("i", F.row_number().over(by("uid", "a", "b"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("uid", "a", "b")))
    quiet = F.when(F.col("i") <= F.floor(F.col("n") * quiet_share), F.col("c"))
    median = placed.withColumn("median", F.percentile(quiet, F.lit(0.5)).over(Window.partitionBy("uid", "a", "b")))
    return median.select("uid", "t", "a", "b", "i", (F.col("c") < F.round("median", 9)).cast("int").alias("bit"))


def run_complexity(bits: DataFrame, windows: int = 15) -> DataFrame:
    """Runs in the string of a window's bits by pair, over the last ``windows`` windows one after the other.

    Normalised by ``L / log2(L + 1)``; under three windows it is one.
    """
    across = Window.partitionBy("uid", "t").orderBy("a", "b")
    edged = bits.select(
        "uid", "t", "i", "bit",
        F.sum((F.col("bit") != F.lag("bit").over(across)).cast("int")).over(Window.partitionBy("uid", "t")).alias("inner_changes"),
        F.count(F.lit(1)).over(Window.partitionBy("uid", "t")).alias("size"),
        F.first("bit").over(across).alias("first_bit"),
        F.last("bit").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_bit"),
    ).select("uid", "t", "i", F.coalesce("inner_changes", F.lit(0)).alias("inner_changes"), "size", "first_bit", "last_bit").distinct()
    order = by("uid")
    frame = order.rowsBetween(1 - windows, 0)
    joint = (F.col("first_bit") != F.lag("last_bit").over(order)).cast("int")
    with_joint = edged.withColumn("joint", F.coalesce(joint, F.lit(0)))
    first_joint = F.first("joint").over(frame)  # the joint before the oldest window is not part of the string
    runs = 1 + F.sum(F.col("inner_changes") + F.col("joint")).over(frame) - first_joint
    length = F.sum("size").over(frame)
    have = F.count(F.lit(1)).over(frame)
    value = F.when(have < 3, 1.0).otherwise(runs / (length / F.log2(length + 1.0)))
    return with_joint.select("uid", "t", F.round(value, 9).alias("complexity"))


def depletion_rate(complexity: DataFrame, window: int = 10) -> DataFrame:
    """Minus the slope of the last ``window`` complexities; zero before that many."""
    placed = complexity.withColumn("i", F.row_number().over(by("uid")).cast("double"))
    frame = by("uid").rowsBetween(1 - window, 0)
    slope = F.when(F.count(F.lit(1)).over(frame) == window, -F.regr_slope("complexity", "i").over(frame)).otherwise(0.0)
    return placed.select("uid", "t", "complexity", F.round(slope, 6).alias("depletion"))
