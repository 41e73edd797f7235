"""Grouped kernels: windows of a panel or a series as Arrow groups, one task's numpy work each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.config import HAZARD, STATE, HazardConfig, StateConfig
from lattica.functions import kernels
from lattica.operators.series import numbered
from lattica.runtime import written

#: Windows of one group of the exploded panel: enough that the overlap between groups is small.
BLOCK = 64


def by_window(returns: DataFrame, window: int, compute, columns: list[str], block: int = BLOCK, kind: str = "double") -> DataFrame:
    """``uid, t`` and the columns: ``compute`` takes each full window's matrix (rows by time, columns by asset name).

    Groups are blocks of consecutive windows of a universe, so a long panel spreads over tasks; a block's first rows
    are shared with the block before. Dates on which an asset is missing must have been dropped.
    """
    placed = returns.withColumn("i", F.dense_rank().over(Window.partitionBy("uid").orderBy("t")) - 1)
    # window ending at row e lies in block e // block; row i is in windows ending at i .. i + window - 1
    first, last = F.floor(F.col("i") / block), F.floor((F.col("i") + window - 1) / block)
    dealt = placed.withColumn("block", F.explode(F.sequence(first, last)))
    schema = ", ".join(["uid string", "t date", *(f"{c} {kind}" for c in columns)])
    own = pa.float64() if kind == "double" else pa.list_(pa.float64())

    def task(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("i", "ascending"), ("asset", "ascending")])
        i = np.unique(rows["i"].to_numpy())
        matrix = rows["r"].to_numpy().reshape(len(i), -1)
        dates = rows["t"].to_numpy()[:: matrix.shape[1]]
        number = rows["block"][0].as_py()
        ends = [k for k in range(window - 1, len(i)) if i[k] // block == number and i[k] - i[k - window + 1] == window - 1]
        values = [compute(matrix[k - window + 1 : k + 1]) for k in ends]
        out = {"uid": pa.array([rows["uid"][0].as_py()] * len(ends), pa.string()), "t": pa.array(dates[ends] if ends else [], pa.date32())}
        return pa.table(out | {c: pa.array([v[c] if kind != "double" else float(v[c]) for v in values], own) for c in columns})

    return dealt.groupBy("uid", "block").applyInArrow(task, schema)


STATE_COLUMNS = ["mean_corr", "curvature", "eta", "entropy", "dominance", "h1_count", "v_raw"]


def graph_curvature(distance: np.ndarray, k: int) -> float:
    """Median Forman-Ricci curvature of the nearest-neighbour graph; ties go to the smaller number."""
    n = len(distance)
    near = max(1, min(k, max(2, (n - 1) // 2)))
    linked = np.zeros((n, n), bool)
    for i in range(n):
        others = sorted((x for x in range(n) if x != i), key=lambda x: (round(distance[i, x], 9), x))[:near]
        linked[i, others] = linked[others, i] = True
    degree, shared = linked.sum(1), linked.astype(int) @ linked
    i, j = np.nonzero(np.triu(linked, 1))
    return float(np.median(4 - degree[i] - degree[j] + 3 * shared[i, j])) if len(i) else 0.0


def full_state(x: np.ndarray, cfg: StateConfig = STATE) -> dict[str, float]:
    """One window's state with ranks, shrinkage, graph curvature and cycles."""
    c = kernels.shrunk(kernels.spearman(x), cfg.shrink)
    d = np.sqrt(np.maximum(2 * (1 - c), 0)) ** cfg.distance_power
    np.fill_diagonal(d, 0)
    curvature = graph_curvature(d, cfg.neighbours)
    cycles = kernels.cycle_summary(d)
    off = c[np.triu_indices(len(c), 1)]
    v = max(cycles["entropy"], 0) * max(1 - cycles["dominance"], 0)
    return {"mean_corr": off.mean() if len(off) else 0.0, "curvature": curvature, "eta": 1 / (abs(curvature) + cfg.rigidity_floor), **cycles, "v_raw": v}


SPECTRAL_COLUMNS = ["oh", "eta", "mean_corr", "gap", "xi", "share", "participation", "divergence", "excess"]


def spectral_state(x: np.ndarray) -> dict[str, float]:
    c = kernels.correlation(x)
    return kernels.spectral_five(c) | {k: v for k, v in kernels.noise_divergence(kernels.spectrum(c), x.shape[1] / x.shape[0]).items() if k in ("divergence", "excess")}


def engagement_state(x: np.ndarray, shrink: float = 0.1) -> dict[str, float]:
    """Spectral state of the channels that vary, by ranks with shrinkage; fewer than three give zeros."""
    active = x[:, x.var(0) > 1e-10]
    if active.shape[1] < 3:
        return dict.fromkeys(("oh", "eta", "mean_corr", "gap", "xi"), 0.0) | {"active": active.shape[1]}
    found = kernels.spectral_five(kernels.shrunk(kernels.spearman(active), shrink))
    return {k: found[k] for k in ("oh", "eta", "mean_corr", "gap", "xi")} | {"active": active.shape[1]}


def distance_of(x: np.ndarray) -> np.ndarray:
    """Angular distance by ranks, without shrinkage."""
    d = np.sqrt(np.maximum(2 * (1 - kernels.spearman(x)), 0))
    np.fill_diagonal(d, 0)
    return d


def barcode_state(x: np.ndarray) -> dict[str, float]:
    d = distance_of(x)
    zero, one = kernels.barcodes(d)
    return {"h0_total": zero[:, 1].sum() if len(zero) else 0.0, "h1_bars": len(one), "persistence_entropy": kernels.persistence_entropy(one)}


def topological_shift(returns: DataFrame, window: int = STATE.window) -> DataFrame:
    """``uid, t, shift``: distance of each window's cycles from those of the window in the middle of the quiet share."""

    def bars(x: np.ndarray) -> dict[str, list[float]]:
        return {"bars": kernels.barcodes(distance_of(x))[1].ravel().tolist()}

    found = written(by_window(returns, window, bars, ["bars"], kind="array<double>"), "barcodes")
    placed = numbered(found)
    middle = F.floor(F.floor(F.col("n") * STATE.quiet_share) / 2) + 1
    joined = found.join(placed.where(F.col("rn") == middle).select("uid", F.col("bars").alias("middle")), "uid")

    def distances(batches):
        for batch in batches:
            pairs = zip(batch.column("bars").to_pylist(), batch.column("middle").to_pylist(), strict=True)
            shift = [kernels.wasserstein(np.array(a).reshape(-1, 2), np.array(b).reshape(-1, 2)) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("t"), pa.array(shift, pa.float64())], names=["uid", "t", "shift"])

    return joined.select("uid", "t", "bars", "middle").mapInArrow(distances, "uid string, t date, shift double")


def by_rows_before(series: DataFrame, window: int, compute, columns: list[str], extra: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """``uid, t, x``, the extra columns and what ``compute`` makes of the ``window`` values before each row (null: fewer).

    As with ``by_window``, groups are blocks of consecutive rows of a series: one long series spreads over tasks.
    ``compute`` takes the values and the row's extra columns, which are the same in all rows of a series.
    """
    extra = extra or []
    placed = series.withColumn("i", F.row_number().over(Window.partitionBy("uid").orderBy("t")) - 1)
    # row i is asked about in its own block and read by windows of rows up to i + window
    dealt = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / block), F.floor((F.col("i") + window) / block))))
    types = dict(series.dtypes)
    schema = ", ".join([f"uid {types['uid']}", f"t {types['t']}", "x double", *(f"{c} {types[c]}" for c in extra), *(f"{c} double" for c in columns)])

    def task(table: pa.Table) -> pa.Table:
        rows = table.sort_by("i")
        i, x = rows["i"].to_numpy(), rows["x"].to_numpy().astype(float)
        number = rows["block"][0].as_py()
        own = np.flatnonzero(i // block == number)
        fixed = [rows[c][0].as_py() for c in extra]
        found = [compute(x[k - window : k], *fixed) if i[k] >= window else [None] * len(columns) for k in own]
        values = [pa.array([None if f[c] is None or not np.isfinite(f[c]) else float(f[c]) for f in found], pa.float64()) for c in range(len(columns))]
        picked = rows.take(pa.array(own))
        return pa.table([picked["uid"], picked["t"], picked["x"].cast(pa.float64()), *(picked[c] for c in extra), *values], names=["uid", "t", "x", *extra, *columns])

    return dealt.groupBy("uid", "block").applyInArrow(task, schema)


def lags(series: DataFrame, most: int = kernels.LAGS) -> DataFrame:
    """``uid, lag``: the smallest lag at which a series and itself moved on do not go together, in window functions only."""
    w = Window.partitionBy("uid").orderBy("t")
    moved = series.select("uid", "x", *(F.lag("x", k).over(w).alias(f"l{k}") for k in range(1, most)))
    own = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.col("x"))
    fits = [
        F.when((F.floor(F.count("x") / 2) > k) & (F.covar_pop("x", f"l{k}") <= 0) & (F.stddev_pop(own(k)) > 0) & (F.stddev_pop(f"l{k}") > 0), F.lit(k))
        for k in range(1, most)
    ]
    bounded = F.least(F.greatest(F.floor(F.count("x") / 4), F.lit(1)), F.lit(most))
    return moved.groupBy("uid").agg(F.coalesce(F.least(*fits), bounded).cast("int").alias("lag"))


def recurrence_series(series: DataFrame, cfg: HazardConfig = HAZARD) -> DataFrame:
    """``uid, t, rr, det, lam, tt, theta, geometry`` over the rows before each.

    Recurrence is a kernel over blocks of windows; what follows from it are window functions: scores against the quiet
    share, where those vary at all, and their weighted sum.
    """
    names = ["rr", "det", "lam", "tt"]

    def compute(x: np.ndarray, lag: int) -> list[float]:
        return list(kernels.recurrence(kernels.embedded(x, lag), cfg.recurrence_quantile, cfg.least_line).values())

    known = series.select("uid", "t", F.col("x").cast("double").alias("x"))
    found = by_rows_before(known.join(lags(known), "uid"), cfg.recurrence_window, compute, names, ["lag"])
    return attractor(found, cfg).select("uid", "t", *names, "theta", "geometry")


def attractor(found: DataFrame, cfg: HazardConfig = HAZARD, weights: tuple[float, ...] = (0.40, 0.35, 0.25)) -> DataFrame:
    """Adds ``theta`` and ``geometry`` to ``uid, t, det, lam, tt``: positive scores against quiet rows, weighted.

    A series too short is ``NOT_APPLIED``; one whose quiet rows hardly vary in ``det`` or ``lam`` is ``SATURATED``.
    """
    whole = Window.partitionBy("uid")
    placed = found.withColumn("_rn", F.row_number().over(Window.partitionBy("uid").orderBy("t"))).withColumn("_n", F.count(F.lit(1)).over(whole))
    total, saturated = F.lit(0.0), F.lit(False)
    for weight, c in zip(weights, ("det", "lam", "tt"), strict=True):
        calm = F.when(F.col("_rn") <= F.floor(F.col("_n") * STATE.quiet_share), F.col(c))
        known, deviation = F.count(calm).over(whole) > 5, F.stddev_pop(calm).over(whole)
        score = (F.col(c) - F.avg(calm).over(whole)) / F.greatest(deviation, F.lit(kernels.DEVIATION_FLOOR))
        total = total + weight * F.when(known, F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
        if c != "tt":
            saturated = saturated | F.coalesce(known & (deviation < kernels.SATURATED), F.lit(False))
    short = F.col("_n") < cfg.least_rows
    scored = placed.withColumns({"_total": F.least(total, F.lit(cfg.attractor_cap)), "_flat": saturated})
    return scored.withColumns({
        "theta": F.when(short | F.col("_flat"), F.lit(0.0)).otherwise(F.col("_total")),
        "geometry": F.when(short, "NOT_APPLIED").when(F.col("_flat"), "SATURATED").otherwise("HIGH"),
    }).drop("_rn", "_n", "_total", "_flat")


def spot_check(series: DataFrame, cfg: HazardConfig = HAZARD, active: float = 0.5) -> DataFrame:
    """``uid, observable, theta, geometry, consensus``: the last window's strength against the quiet share's, by observable.

    ``series`` has ``uid, observable, t, x``. Series too short or constant say nothing (``N/A``), those whose quiet
    windows are few or hardly vary little (``LOW``).
    """
    names = ["rr", "det", "lam", "tt"]
    keyed = series.select(F.to_json(F.struct("uid", "observable")).alias("uid"), "t", F.col("x").cast("double").alias("x"))
    span = keyed.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("deviation"), F.max("t").alias("last"))
    # the last window ends before a row of its own
    ended = keyed.join(lags(keyed), "uid").unionByName(span.select("uid", F.date_add("last", 1).alias("t"), F.lit(0.0).alias("x")).join(lags(keyed), "uid"))

    def compute(x: np.ndarray, lag: int) -> list[float]:
        return list(kernels.recurrence(kernels.embedded(x, lag), cfg.recurrence_quantile).values())

    found = numbered(by_rows_before(ended, cfg.recurrence_window, compute, names, ["lag"]))
    n = F.col("n") - 1
    calm = (F.col("rn") <= F.floor(n * STATE.quiet_share)) & F.col("det").isNotNull()
    known = found.groupBy("uid").agg(
        F.count_if(calm).alias("calm"),
        *(f(F.when(calm, F.col(c))).alias(f"{p}_{c}") for c in names[1:] for p, f in (("m", F.avg), ("s", F.stddev_pop))),
        *(F.max(F.when(F.col("rn") == F.col("n"), F.col(c))).alias(c) for c in names[1:]),
    ).join(span, "uid")
    score = lambda c: F.greatest((F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(kernels.DEVIATION_FLOOR)), F.lit(0.0))
    total = F.least(0.40 * score("det") + 0.35 * score("lam") + 0.25 * score("tt"), F.lit(cfg.attractor_cap))
    silent = (F.col("n") < cfg.recurrence_window + 10) | (F.col("deviation") < 1e-15)
    low = (F.col("calm") < 5) | (F.col("s_det") < kernels.SATURATED) | (F.col("s_lam") < kernels.SATURATED)
    geometry = F.when(silent, "N/A").when(F.coalesce(low, F.lit(True)), "LOW").otherwise("HIGH")
    named = known.withColumn("_k", F.from_json("uid", "uid string, observable string"))
    split = named.select("_k.uid", "_k.observable", F.when(geometry == "HIGH", total).otherwise(0.0).alias("theta"), geometry.alias("geometry"))
    whole = Window.partitionBy("uid")
    on, valid = F.count_if(F.col("theta") > active).over(whole), F.count_if(F.col("geometry") != "N/A").over(whole)
    return split.withColumn("consensus", F.when((on == valid) & (valid > 0), "ALIGNED").when(on > 0, "PARTIAL").otherwise("NONE"))
