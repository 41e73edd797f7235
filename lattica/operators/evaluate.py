"""Evaluation of scores against labels: exact, by ranks and cumulative counts, grouped by ``g``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _thresholds(scored: DataFrame) -> DataFrame:
    """Counts by distinct score with the positives and negatives at or above it: one row per score, not per label."""
    counted = scored.groupBy("g", "score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    down = Window.partitionBy("g").orderBy(F.desc("score"))
    whole = Window.partitionBy("g")
    return counted.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "p": F.sum("pos").over(whole), "n": F.sum("neg").over(whole)})


def rank_auc(scored: DataFrame) -> DataFrame:
    """Chance that a positive scores above a negative, ties half; null with one class."""
    rows = _thresholds(scored)
    above = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
    return rows.groupBy("g").agg(F.first("p").alias("positives"), F.first("n").alias("negatives"), F.round(F.try_divide(above, F.first("p") * F.first("n")), 6).alias("auc"))


def folded_auc(scored: DataFrame) -> DataFrame:
    return rank_auc(scored).withColumn("auc", F.greatest(F.col("auc"), F.round(1 - F.col("auc"), 6)))


def average_precision(scored: DataFrame) -> DataFrame:
    rows = _thresholds(scored)
    return rows.groupBy("g").agg(F.round(F.sum(F.try_divide(F.col("pos"), F.col("p")) * F.col("tp") / (F.col("tp") + F.col("fp"))), 6).alias("ap"))


def youden(scored: DataFrame) -> DataFrame:
    """The greatest threshold with the largest ``tpr - fpr``."""
    rows = _thresholds(scored).withColumn("j", F.round(F.try_divide("tp", "p") - F.try_divide("fp", "n"), 9))
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("j"), F.desc("score")))).where("r = 1")
    return best.select("g", F.round("score", 6).alias("threshold"), F.round("j", 6).alias("j"))


def confusion(scored: DataFrame, threshold: Column) -> DataFrame:
    """Counts and ratios of ``score > threshold``."""
    hit = F.col("score") > threshold
    c = scored.groupBy("g").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, log loss and the unweighted mean gap over non-empty bins of a probability."""
    clipped = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("score")))
    loss = -(F.col("y") * F.log(clipped) + (1 - F.col("y")) * F.log(1 - clipped))
    whole = scored.groupBy("g").agg(F.round(F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))), 6).alias("brier"), F.round(F.avg(loss), 6).alias("log_loss"))
    binned = scored.groupBy("g", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")).agg(F.abs(F.avg("y") - F.avg("score")).alias("gap"))
    return whole.join(binned.groupBy("g").agg(F.round(F.avg("gap"), 6).alias("ece"), F.count(F.lit(1)).alias("bins")), "g")


def threshold_at_rate(scored: DataFrame, rate: float) -> DataFrame:
    """The score that a share of negatives exceeds."""
    return scored.where("y = 0").groupBy("g").agg(F.round(F.percentile("score", F.lit(1 - rate)), 6).alias("threshold"))


def unpivoted(frame: DataFrame, features: list[str], y: str) -> DataFrame:
    """``g`` (the feature's name), ``score``, ``y``."""
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features]))
    return frame.select(F.col(y).alias("y"), F.explode(values).alias("g", "score"))


def paired_t(pairs: DataFrame) -> DataFrame:
    """Mean difference of ``x - y`` and its t statistic by ``g``."""
    d = F.col("x") - F.col("y")
    s = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return s.select("g", "n", F.round("m", 6).alias("mean_diff"), F.round(F.try_divide(F.col("m"), F.col("s") / F.sqrt("n")), 6).alias("t"))


def stratified_folds(rows: DataFrame, label: str, order: Column, folds: int) -> DataFrame:
    """Adds ``fold``: of every class the rows by ``order`` (hex digits) go round the folds, so counts differ by one at most.

    A row's place in its class is its place among those with the same three first digits plus the count of those before,
    so a class spreads over 4 096 groups.
    """
    marked = rows.withColumns({"_order": order, "_part": F.substring(order, 1, 3)})
    parts = marked.groupBy(label, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col(label).alias("_label"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_order"))
    placed = marked.withColumn("_own", own).join(before, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_of")))
    return placed.withColumn("fold", ((F.col("_own") + F.col("_before") - 1) % folds).cast("int")).select(*rows.columns, "fold")
