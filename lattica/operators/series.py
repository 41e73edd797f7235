"""Operators over ordered rows of a series ``(uid, t, ...)``: memory folds, crossings, runs, lags, slopes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import ACTIVATION, EPS, ActivationConfig
from lattica.sources.panels import by


def folded(series: DataFrame, columns: list[str], outputs: list[str], fold: Callable[..., list[np.ndarray]], key: str = "uid", order: str = "t") -> DataFrame:
    """Sequential recursions, one series per group: ``fold`` takes the ordered columns and returns the outputs.

    What comes out is ``key, order`` and the outputs. A series meets in one task; series spread over all.
    """
    types = dict(series.dtypes)

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        results = fold(*(table[c].to_numpy().astype(float) for c in columns))
        return pa.table([table[key], table[order], *(pa.array(np.asarray(r, float)) for r in results)], names=[key, order, *outputs])

    schema = ", ".join([f"{key} {types[key]}", f"{order} {types[order]}", *(f"{o} double" for o in outputs)])
    return series.select(key, order, *columns).groupBy(key).applyInArrow(task, schema)


def leaky_memory(drive: np.ndarray, decay: float, floor: float) -> np.ndarray:
    """``m = max(decay * m_before + drive, floor)``, from zero."""
    out, m = np.empty(len(drive)), 0.0
    for i, d in enumerate(drive):
        out[i] = m = max(decay * m + d, floor)
    return out


def plain_memory(drive: np.ndarray, decay: float) -> np.ndarray:
    out, m = np.empty(len(drive)), 0.0
    for i, d in enumerate(drive):
        out[i] = m = decay * m + d
    return out


def smoothed(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential mean that starts at the first value."""
    out = np.empty(len(x))
    m = x[0] if len(x) else 0.0
    for i, v in enumerate(x):
        m = v if i == 0 else alpha * v + (1 - alpha) * m
        out[i] = m
    return out


def numbered(series: DataFrame, key: str = "uid", order: str = "t") -> DataFrame:
    """Adds the row's place ``rn`` from one and the series' length ``n``."""
    return series.withColumn("rn", F.row_number().over(by(key, order=order))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))


def quiet(share: float = 0.4) -> Column:
    """Whether a numbered row lies in the quiet first share."""
    return F.col("rn") <= F.floor(F.col("n") * share)


def over_threshold_for(x: str, threshold: Column | float, persist: int, key: str = "uid", order: str = "t") -> Column:
    """Whether this row and the following ``persist - 1`` all lie above the threshold."""
    frame = by(key, order=order).rowsBetween(0, persist - 1)
    above = (F.col(x) > threshold).cast("int")
    return (F.min(above).over(frame) == 1) & (F.count(F.lit(1)).over(frame) == persist)


def first_crossing(series: DataFrame, x: str, threshold: Column | float, persist: int, name: str = "crossing") -> DataFrame:
    """``uid`` and the first date from which x stays above for ``persist`` rows (null: never)."""
    marked = series.withColumn("_on", over_threshold_for(x, threshold, persist))
    return marked.groupBy("uid").agg(F.min(F.when(F.col("_on"), F.col("t"))).alias(name))


def runs(series: DataFrame, flag: Column, key: str = "uid", order: str = "t") -> DataFrame:
    """Runs of equal flags: ``uid, flag, start, end, length``."""
    w = by(key, order=order)
    marked = series.select(key, order, flag.alias("flag"))
    changed = marked.withColumn("new", F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1)))
    island = changed.withColumn("island", F.sum("new").over(w))
    return island.groupBy(key, "island", "flag").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length")).drop("island")


def activations(series: DataFrame, cfg: ActivationConfig = ACTIVATION) -> DataFrame:
    """One row per series of ``uid, t, x``: the kind of its first lasting activation and where it stands now.

    An activation is the first run above ``threshold`` of ``persist`` rows and more. Its kind is RAMP where that run or
    the one that still goes on has ``long`` rows, else SPIKE where values fall under ``quiet`` within ``revert`` rows,
    else BUILDING; NONE without one. ``growth`` counts the rows before it, ``reach`` at most, that rise or lie above
    ``stirring``. Places count from zero; ``effective_start`` is that of the run that still goes on, if it lasts.
    """
    w = by("uid")
    placed = numbered(series.select("uid", "t", "x")).withColumn("rn", F.col("rn") - 1)
    lengths = runs(placed.select("uid", F.col("rn").alias("t"), "x"), F.col("x") > cfg.threshold).where("flag")
    lasting = lengths.where(F.col("length") >= cfg.persist)
    first = lasting.groupBy("uid").agg(F.min("start").alias("start"), F.min_by("length", "start").alias("lasting"))
    known = placed.withColumn("stirs", (F.col("x") < F.lead("x").over(w)) | (F.col("x") > cfg.stirring)).join(first, "uid", "left")
    before = (F.col("rn") < F.col("start")) & (F.col("rn") >= F.col("start") - cfg.reach)
    summed = known.groupBy("uid").agg(
        F.max("n").alias("n"), F.max("start").alias("start"), F.max("lasting").alias("lasting"),
        F.min(F.when((F.col("rn") >= F.col("start") + cfg.persist) & (F.col("x") < cfg.quiet), F.col("rn"))).alias("low"),
        F.coalesce(F.max(F.when(before & ~F.col("stirs"), F.col("rn"))), F.greatest(F.max("start") - cfg.reach, F.lit(0)) - 1).alias("still"),
    )
    last = lengths.groupBy("uid").agg(F.max_by(F.struct("end", "length"), "end").alias("last"))
    now = F.coalesce(F.when(F.col("last.end") == F.col("n") - 1, F.col("last.length")), F.lit(0))
    found = summed.join(last, "uid", "left").withColumn("now", now)
    goes_on, reverted = F.col("now") >= cfg.persist, F.coalesce(F.col("low") < F.col("start") + cfg.revert, F.lit(False))
    ramp = F.greatest("lasting", "now") >= cfg.long
    kind = F.when(F.col("start").isNull(), "NONE").when(ramp, "RAMP").when(reverted, "SPIKE").otherwise("BUILDING")
    some = lambda c, empty=0: F.when(F.col("start").isNull(), empty).otherwise(c).cast("long")
    return found.select(
        "uid", kind.alias("kind"), some(F.col("start"), -1).alias("start"), some(F.when(goes_on, F.col("n") - F.col("now")).otherwise(F.col("start")), -1).alias("effective_start"),
        some(F.col("now")).alias("current_run"), some(F.col("start") - 1 - F.col("still")).alias("growth"),
        some(F.when(ramp & (F.col("lasting") < cfg.long), F.col("now")).otherwise(F.col("lasting"))).alias("persistence"),
        some(F.when(goes_on, F.col("now")).otherwise(F.coalesce("low", "n") - F.col("start"))).alias("duration"),
    )


def phase_divergence(state: DataFrame, columns: list[str]) -> DataFrame:
    """``1 - |cos|`` between the scaled state and its change; the first change is zero."""
    whole, w = Window.partitionBy("uid"), by("uid")
    scaled = state
    for c in columns:
        deviation = F.stddev_pop(c).over(whole)
        scaled = scaled.withColumn(f"_s_{c}", F.col(c) / F.when(deviation > EPS, deviation).otherwise(1.0))
    for c in columns:
        scaled = scaled.withColumn(f"_d_{c}", F.coalesce(F.col(f"_s_{c}") - F.lag(f"_s_{c}").over(w), F.lit(0.0)))
    square = lambda p: sum((F.col(f"_{p}_{c}") * F.col(f"_{p}_{c}") for c in columns), F.lit(0.0))
    dot = sum((F.col(f"_s_{c}") * F.col(f"_d_{c}") for c in columns), F.lit(0.0))
    cosine = dot / ((F.sqrt(square("s")) + EPS) * (F.sqrt(square("d")) + EPS))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(cosine)))
    return scaled.withColumn("divergence", value).drop(*(f"_{p}_{c}" for p in "sd" for c in columns))


def euler_divergence(series: DataFrame, x: str, horizon: float = 1.0) -> DataFrame:
    """Distance of each value from the one before it carried forward by the centred velocity, relative to the value."""
    w = by("uid")
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    velocity = F.when(before.isNull(), after - F.col(x)).when(after.isNull(), F.col(x) - before).otherwise((after - before) / 2)
    moved = series.withColumn("velocity", velocity)
    projected = F.lag(F.col(x) + horizon * F.col("velocity")).over(w)
    return moved.withColumn("divergence", F.try_divide(F.abs(F.col(x) - projected), F.abs(F.col(x)) + EPS))


def phase_velocity(x: str, how: str = "centred") -> Column:
    """Change of a series a row: ``centred`` (one-sided at both ends), ``forward`` (the last as the one before it) or
    ``backward`` (the first as the one after it); zero for a single row."""
    w = by("uid")
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    back, on = F.col(x) - before, after - F.col(x)
    found = {
        "centred": F.coalesce((after - before) / 2, on, back),
        "forward": F.coalesce(on, back),
        "backward": F.coalesce(back, on),
    }
    return F.coalesce(found[how], F.lit(0.0))


def divergence_parts(state: DataFrame, columns: list[str], how: str = "centred", horizon: float = 1.0) -> DataFrame:
    """Adds ``part_c`` for every column (its distance from where its velocity carries it), their norm ``total``,
    ``relative`` to the state's norm, and the change of that (``gradient``)."""
    norm = lambda values: F.sqrt(sum((v * v for v in values), F.lit(0.0)))
    parts = {f"part_{c}": F.abs(phase_velocity(c, how) * horizon) for c in columns}
    made = state.withColumns(parts).withColumn("total", norm([F.col(c) for c in parts]))
    made = made.withColumn("relative", F.col("total") / F.greatest(norm([F.col(c) for c in columns]), F.lit(1e-10)))
    return made.withColumn("gradient", F.col("relative") - F.lag("relative").over(by("uid")))


def slowing(series: DataFrame, x: str, window: int, quiet_rows: Column) -> DataFrame:
    """Critical slowing: lag-one correlation and deviation of the ``window`` rows before, scored against quiet rows."""
    w, whole = by("uid"), Window.partitionBy("uid")
    lagged = series.withColumn("_lag", F.lag(x).over(w))
    # the window's rows end one before this one; pairs inside it leave its first row out
    inner, outer = w.rowsBetween(1 - window, -1), w.rowsBetween(-window, -1)
    deviation = F.stddev_pop(x).over(outer)
    own = F.try_divide(F.covar_pop(x, "_lag").over(inner), F.stddev_pop(x).over(inner) * F.stddev_pop("_lag").over(inner))
    full = F.count(F.lit(1)).over(outer) == window
    scored = lagged.withColumn("ar1", F.when(full, F.when(deviation < EPS, 0.0).otherwise(F.coalesce(own, F.lit(0.0))))).withColumn("sigma", F.when(full, F.when(deviation < EPS, 0.0).otherwise(deviation)))
    z = lambda c: (F.col(c) - F.avg(F.when(quiet_rows, F.col(c))).over(whole)) / F.greatest(F.stddev_pop(F.when(quiet_rows, F.col(c))).over(whole), F.lit(EPS))
    enough = F.count(F.when(quiet_rows, F.col("ar1"))).over(whole) > 5
    return scored.withColumn("slowing", F.when(enough, F.coalesce(z("ar1") + z("sigma"), F.lit(0.0))).otherwise(0.0)).drop("_lag")
