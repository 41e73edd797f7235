"""Attention matrices ``(g, i, j, a)``: normalisation, entropy family, composite scores, regimes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST = 1e-10


def synthetic_attention(spark: SparkSession, n: int) -> DataFrame:
    """Four stated regimes: uniform, diagonal, concentrated on the first column, causal."""
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    regimes = {
        "uniform": F.lit(1.0 / n), "diagonal": F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0),
        "concentrated": F.when(F.col("j") == 0, 0.9).otherwise(0.1 / (n - 1)), "causal": F.when(F.col("j") <= F.col("i"), 1.0 / (F.col("i") + 1)).otherwise(0.0),
    }
    out = None
    for name, value in regimes.items():
        part = cells.select(F.lit(name).alias("g"), "i", "j", value.cast("double").alias("a"))
        out = part if out is None else out.unionByName(part)
    return out


def normalised(attention: DataFrame, how: str = "row") -> DataFrame:
    """By the sum of all, of the row, by the maximum, or not at all (``none``); what is negative counts as zero."""
    attention = attention.withColumn("a", F.greatest("a", F.lit(0.0)))
    if how == "none":
        return attention
    whole, row = Window.partitionBy("g"), Window.partitionBy("g", "i")
    by = {"sum": F.sum("a").over(whole), "row": F.sum("a").over(row), "max": F.max("a").over(whole)}[how]
    return attention.withColumn("a", F.coalesce(F.try_divide("a", by), F.lit(0.0)))


def mean_of_heads(attention: DataFrame) -> DataFrame:
    """``g, i, j, a``: cells of several heads ``g, head, i, j, a`` as their mean; a head that lacks a cell has zero there."""
    heads = attention.groupBy("g").agg(F.countDistinct("head").alias("_heads"))
    summed = attention.groupBy("g", "i", "j").agg(F.sum("a").alias("a"))
    return summed.join(heads, "g").select("g", "i", "j", (F.col("a") / F.col("_heads")).alias("a"))


def contrasted(attention: DataFrame) -> DataFrame:
    """Square roots, stretched to 0 to 1."""
    root, whole = F.sqrt("a"), Window.partitionBy("g")
    low, high = F.min(root).over(whole), F.max(root).over(whole)
    return attention.withColumn("a", F.coalesce(F.try_divide(root - low, high - low), F.lit(0.0)))


def entropy_family(attention: DataFrame) -> DataFrame:
    """``g, omega, eta, gini, xi, delta``: entropy share, its complement, Gini, participation, divergence from uniform."""
    total = F.sum("a").over(Window.partitionBy("g"))
    p = attention.withColumn("p", F.try_divide("a", total)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    ranked = p.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("a", "i", "j")))
    large = F.when(F.col("p") > LEAST, F.col("p"))
    bits = -F.sum(large * F.log2(large))
    m = F.max("n")
    s = ranked.groupBy("g").agg(
        F.coalesce(bits, F.lit(0.0)).alias("bits"), m.cast("double").alias("m"), F.sum(F.col("p") * F.col("p")).alias("square"),
        F.sum(F.col("p") * (2 * F.col("r") - F.col("n") - 1)).alias("spread"),
    )
    clip = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)
    omega = F.coalesce(F.try_divide("bits", F.log2("m")), F.lit(0.0))
    return s.select("g", clip(omega).alias("omega"), clip(1 - omega).alias("eta"), clip(F.coalesce(F.try_divide("spread", "m"), F.lit(0.0))).alias("gini"), clip(F.coalesce(F.try_divide(F.lit(1.0), F.col("square") * F.col("m")), F.lit(0.0))).alias("xi"), clip(F.log2("m") - F.col("bits")).alias("delta"))


#: Weights of the composite score, by feature; diversity counts by its complement and entropy against.
WEIGHTS = {"rscore": 0.30, "eta": 0.25, "xi": 0.20, "delta": 0.15, "omega": 0.10}


#: Other weightings of the same features, each to be divided by its sum.
PRESETS: dict[str, dict[str, float]] = {
    "balanced": {"rscore": 0.25, "eta": 0.25, "xi": 0.20, "delta": 0.15, "omega": 0.15},
    "score_focused": {"rscore": 0.50, "eta": 0.15, "xi": 0.15, "delta": 0.10, "omega": 0.10},
    "regime_focused": {"rscore": 0.15, "eta": 0.30, "xi": 0.30, "delta": 0.15, "omega": 0.10},
}


def preset_scores(frame: DataFrame, presets: dict[str, dict[str, float]] = PRESETS) -> DataFrame:
    """``g, preset, score`` and each feature's part, for every preset: the weights go along with each row."""
    value = {"xi": 1 - F.col("xi"), "omega": -F.col("omega")}
    scaled = {p: {k: w / sum(map(abs, ws.values())) for k, w in ws.items()} for p, ws in presets.items()}
    parts = lambda ws: [(value.get(k, F.col(k)) * w).alias(f"part_{k}") for k, w in ws.items()]
    total = lambda ws: sum((value.get(k, F.col(k)) * w for k, w in ws.items()), F.lit(0.0)).alias("score")
    each = F.array(*[F.struct(F.lit(p).alias("preset"), total(ws), *parts(ws)) for p, ws in scaled.items()])
    return frame.select("g", F.explode(each).alias("e")).select("g", "e.*")


def composite(frame: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Adds ``score``: the weighted sum over the sum of the weights' sizes, and each feature's part."""
    size = sum(abs(w) for w in weights.values())
    value = {"xi": lambda c: 1 - c, "omega": lambda c: -c}
    parts = {f"part_{k}": F.round(value.get(k, lambda c: c)(F.col(k)) * (w / size), 6) for k, w in weights.items()}
    score: Column = sum((value.get(k, lambda c: c)(F.col(k)) * (w / size) for k, w in weights.items()), F.lit(0.0))
    return frame.withColumn("score", F.round(score, 6)).withColumns(parts)


def detected(frame: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds whether the score exceeds the threshold and how surely."""
    confidence = F.least(F.lit(1.0), F.abs(F.col("score") - threshold) / max(threshold, 1 - threshold))
    return frame.withColumn("detected", F.col("score") > threshold).withColumn("confidence", F.round(confidence, 6))


#: Centres of the loose, critical and rigid regimes in (omega, eta, xi, delta, gini).
CENTRES = {"flow": (0.85, 0.15, 0.7, 0.15, 0.25), "shift": (0.55, 0.45, 0.4, 0.45, 0.55), "rigid": (0.2, 0.8, 0.1, 0.8, 0.85)}


def nearest_regime(frame: DataFrame, columns: tuple[str, ...] = ("omega", "eta", "xi", "delta", "gini"), centres: dict = CENTRES) -> DataFrame:
    """Adds the distance to each centre, the nearest one and soft memberships."""
    square = lambda point: sum(((F.col(c) - x) * (F.col(c) - x) for c, x in zip(columns, point, strict=True)), F.lit(0.0))
    placed = frame.withColumns({f"d_{k}": F.round(F.sqrt(square(v)), 6) for k, v in centres.items()})
    names = list(centres)
    nearest = F.least(*[F.struct(F.col(f"d_{k}").alias("d"), F.lit(k).alias("k")) for k in names])
    total = sum((F.exp(-F.col(f"d_{k}")) for k in names), F.lit(0.0))
    return placed.withColumn("regime", nearest["k"]).withColumns({f"m_{k}": F.round(F.exp(-F.col(f"d_{k}")) / total, 6) for k in names})


# Matrices of texts: how often a kind of character follows another ---------------------------------------------------

#: Kinds of characters and what they are called inside an expression; what fits none is ``O``, marks are ASCII ones.
KINDS = {"V": "[aeiou]", "C": "[a-z]", "D": "[0-9]", "B": r"[\x20\x09-\x0D]", "M": r"[!-/:-@\[-`{-~]"}
LETTERS = "VCDBMO"
#: Heads that the turns of a conversation are dealt over.
HEADS = 8


def kinds_of(text: Column) -> Column:
    """The text with a capital for each character's kind."""
    out = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for letter, pattern in KINDS.items():
        out = F.regexp_replace(out, pattern, letter)
    return F.regexp_replace(out, "[^VCDBM]", "O")


def transition_counts(kinds: Column) -> list[Column]:
    """Per pair of kinds, row by row, how often the second follows the first: by lengths, without taking texts apart."""
    size = F.char_length(kinds)
    found: dict[str, Column] = {}
    for a in LETTERS:
        for b in LETTERS:
            if a != b:
                found[a + b] = ((size - F.char_length(F.replace(kinds, F.lit(a + b), F.lit("")))) / 2).cast("long")
    for a in LETTERS:  # of those of a kind, all but the first of each run follow their like
        every = size - F.char_length(F.replace(kinds, F.lit(a), F.lit("")))
        begun = sum((found[b + a] for b in LETTERS if b != a), F.when(F.substring(kinds, 1, 1) == a, 1).otherwise(0))
        found[a + a] = (every - begun).cast("long")
    return [found[a + b] for a in LETTERS for b in LETTERS]


def text_matrices(turns: DataFrame, key: str = "conv_id", turn: str = "turn", text: str = "text", heads: int = 1) -> DataFrame:
    """``g, head, cells``: the counts of a conversation's turns, dealt over heads by their number; 36 sums a group, combined
    before the exchange, so a conversation of any length is no task's burden."""
    counted = turns.select(F.col(key).alias("g"), F.pmod(F.coalesce(F.col(turn), F.lit(0)).cast("long"), F.lit(heads)).alias("head"), kinds_of(F.col(text)).alias("kinds"))
    names = [f"c{i}" for i in range(len(LETTERS) ** 2)]
    each = counted.select("g", "head", *(c.alias(n) for c, n in zip(transition_counts(F.col("kinds")), names, strict=True)))
    return each.groupBy("g", "head").agg(*(F.sum(n).alias(n) for n in names)).select("g", "head", F.array(*names).alias("cells"))


def as_cells(matrices: DataFrame) -> DataFrame:
    """``g, i, j, a`` of ``g, cells``, and ``head`` if there is one."""
    n, keys = len(LETTERS), [c for c in ("g", "head") if c in matrices.columns]
    return matrices.select(*keys, F.posexplode("cells").alias("at", "a")).select(*keys, F.floor(F.col("at") / n).alias("i"), (F.col("at") % n).cast("long").alias("j"), F.col("a").cast("double").alias("a"))


def heads_spectrum(x: np.ndarray) -> dict[str, float]:
    """What the eigenvalues of the heads' correlation say, for heads by flattened cells: the five, the share of values
    beyond the random edge, and the score of both."""
    n = len(x)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.atleast_2d(np.corrcoef(x)) if n > 1 else np.ones((1, 1)))
    np.fill_diagonal(c, 1.0)
    values = np.sort(np.abs(np.linalg.eigvalsh(c)))[::-1]
    share = values / (values.sum() + LEAST)
    p = share[share > 1e-12]
    nats = float(-(p * np.log(p)).sum())
    oh = float(share[0]) * n
    eta = 1 - nats / np.log(n) if n > 1 else 1.0
    coupling = float(np.abs(c[~np.eye(n, dtype=bool)]).mean()) if n > 1 else 0.0
    gap = float((values[0] - values[1]) / (values[0] + LEAST)) if n > 1 else 0.0
    xi = float(np.exp(nats)) / n
    edge = (1 + np.sqrt(n / x.shape[1])) ** 2
    beyond = int((values / (values.sum() + LEAST) * n > edge).sum())
    return {"oh": oh, "eta": eta, "mean_corr": coupling, "gap": gap, "xi": xi, "escaped": beyond, "escape": beyond / n, "score": (oh / n + eta + gap) / 3 - (xi + 1 - coupling) / 2}


def spectral_gap(a: np.ndarray) -> float:
    """Gap of the two largest eigenvalues of a matrix as its lower triangle has it, relative to the largest."""
    values = np.sort(np.abs(np.linalg.eigvalsh(a)))[::-1]
    return float(np.clip((values[0] - values[1]) / (values[0] + LEAST), 0, 1)) if len(values) > 1 else 0.0


SPECTRUM = ["oh", "eta", "mean_corr", "gap", "xi", "escape", "score"]


def spectra(matrices: DataFrame) -> DataFrame:
    """``g, heads, escaped, phi`` and the rest of each conversation's spectrum, from ``g, head, cells``: many small matrices
    a batch. ``phi`` is the gap of the whole conversation's matrix, its sum being one."""
    kind = dict(matrices.dtypes)["g"]
    gathered = matrices.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("head", "cells"))).alias("heads"))  # HEADS at most

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(LETTERS)
        for batch in batches:
            rows = [np.array([h["cells"] for h in heads], float) for heads in batch.column("heads").to_pylist()]
            found = [heads_spectrum(x) for x in rows]
            phi = [spectral_gap((x.sum(0) / max(x.sum(), LEAST)).reshape(n, n)) for x in rows]
            out = {"g": batch.column("g"), "heads": pa.array([len(x) for x in rows], pa.int32()), "escaped": pa.array([f["escaped"] for f in found], pa.int32()), "phi": pa.array(phi, pa.float64())}
            yield pa.RecordBatch.from_pydict(out | {c: pa.array([float(f[c]) for f in found], pa.float64()) for c in SPECTRUM})

    return gathered.mapInArrow(task, f"g {kind}, heads int, escaped int, phi double, " + ", ".join(f"{c} double" for c in SPECTRUM))
