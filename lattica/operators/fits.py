"""Logistic fits by sums over rows: no row leaves its task, whatever their number, and many models share each pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gives the weights of a batch's rows in each model, rows by models; so may a target, if models differ in it.
Weigh = Callable[[pa.RecordBatch], np.ndarray]
Target = str | Weigh


def _labels(batch: pa.RecordBatch, target: Target) -> np.ndarray:
    """Rows by models, or by one if all models have the same target."""
    return target(batch).astype(float) if callable(target) else batch.column(target).to_numpy(zero_copy_only=False).astype(float)[:, None]


def _summed(rows: DataFrame, sums: Callable[[pa.RecordBatch], np.ndarray], models: int, width: int) -> np.ndarray:
    """``models`` by ``width`` numbers, added up over all batches: one row a task and model, combined before the exchange."""
    names = [f"s{k}" for k in range(width)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, width))
        for batch in batches:
            if batch.num_rows:
                total += sums(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(models)), *map(pa.array, total.T.copy())], names=["model", *names])

    parts = rows.mapInArrow(task, ", ".join(["model long", *(f"{n} double" for n in names)]))
    out = np.zeros((models, width))
    for r in parts.groupBy("model").agg(*(F.sum(n).alias(n) for n in names)).collect():
        out[r["model"]] = r[1:]
    return out


def design(batch: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.column_stack([np.ones(batch.num_rows), *(batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features)])


def logistic_models(rows: DataFrame, features: list[str], models: int, weigh: Weigh, target: Target = "y", masks: np.ndarray | None = None, c: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Weights of many logistic models, one pass over the rows for all of them a round.

    Model m counts a row as often as ``weigh`` says and uses the features that its row of ``masks`` marks. Returns the
    weights of scaled features and those of the features as they are, each ``models`` by one (the constant) and the
    features; not a number where a model sees one class only. Ridge ``1 / (2 c)`` on all weights but the constant.
    """
    d = len(features)
    masks = np.ones((models, d), bool) if masks is None else masks

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, w, y = design(batch, features), weigh(batch), _labels(batch, target)
        return np.column_stack([w.T @ x, w.T @ x[:, 1:] ** 2, (w * y).sum(0)])

    found = _summed(rows, moments, models, 2 * d + 2)
    size, ones = found[:, 0], found[:, -1]
    mean = found[:, 1 : d + 1] / np.maximum(size, 1)[:, None]
    deviation = np.sqrt(np.maximum(found[:, d + 1 : 2 * d + 1] / np.maximum(size, 1)[:, None] - mean**2, 0))
    deviation[deviation <= 1e-12] = 1.0
    # scaled rows are turn @ rows
    turn = np.zeros((models, d + 1, d + 1))
    turn[:, 0, 0] = 1
    for k in range(d):
        turn[:, k + 1, k + 1] = masks[:, k] / deviation[:, k]
        turn[:, k + 1, 0] = -(masks[:, k] * mean[:, k]) / deviation[:, k]
    ridge = np.eye(d + 1) / c
    ridge[0, 0] = 0
    # features that a model leaves out keep a weight of zero
    unused = np.zeros((models, d + 1, d + 1))
    unused[:, np.arange(1, d + 1), np.arange(1, d + 1)] = ~masks
    weights = np.zeros((models, d + 1))
    for _ in range(rounds):
        plain = np.einsum("mi,mij->mj", weights, turn)

        def newton(batch: pa.RecordBatch, plain=plain) -> np.ndarray:
            x, w, y = design(batch, features), weigh(batch), _labels(batch, target)
            p = 1 / (1 + np.exp(-np.clip(x @ plain.T, -30, 30)))
            squares = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
            return np.column_stack([(w * (p - y)).T @ x, (w * p * (1 - p)).T @ squares])

        sums = _summed(rows, newton, models, (d + 1) * (d + 2))
        gradient = np.einsum("mij,mj->mi", turn, sums[:, : d + 1]) + weights @ ridge
        hessian = np.einsum("mij,mjk,mlk->mil", turn, sums[:, d + 1 :].reshape(models, d + 1, d + 1), turn) + ridge + unused + 1e-12 * np.eye(d + 1)
        step = np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        weights = weights - step
        if np.abs(step).max(initial=0.0) < 1e-9:
            break
    weights[(ones <= 0) | (ones >= size)] = np.nan
    return weights, np.einsum("mi,mij->mj", weights, turn)


def scores(rows: DataFrame, features: list[str], plain: np.ndarray, which: Callable[[pa.RecordBatch], np.ndarray], keep: list[str]) -> DataFrame:
    """``model, score`` and the kept columns: each row's score in each model that ``which`` (rows by models) asks for."""
    types = dict(rows.dtypes)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, model = np.nonzero(which(batch))
            value = 1 / (1 + np.exp(-np.clip((design(batch, features)[row] * plain[model]).sum(1), -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int64)), pa.array(value), *(batch.column(k).take(pa.array(row)) for k in keep)], names=["model", "score", *keep])

    return rows.mapInArrow(task, ", ".join(["model long", "score double", *(f"{k} {types[k]}" for k in keep)]))


def hashed(row: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """64 bits for each row (by its 64-bit hash) and draw, rows by draws; of one draw no two rows have the same."""
    z = row.astype(np.int64).view(np.uint64)[:, None] ^ (np.asarray(draw, np.uint64)[None] * np.array([[0x9E3779B97F4A7C15]], np.uint64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def mixed(row: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row and draw."""
    return (hashed(row, draw) >> np.uint64(11)).astype(float) / 2.0**53


#: Bits that a pass of ``permutation_limits`` settles.
PASS_BITS = 6


def permutation_limits(rows: DataFrame, chosen: int, draws: np.ndarray, row: str = "row") -> np.ndarray:
    """For every draw the largest hash that belongs to its ``chosen`` smallest ones: rows up to it are the draw's ones.

    Each pass counts, for all draws at once, the rows in 64 parts of the range in which a limit lies, and goes on in the
    part that holds it, until the parts below are as many as chosen; so some log64(rows) passes of sums, and no row
    moves. Rows need distinct 64-bit numbers.
    """
    size, width = len(draws), 1 << PASS_BITS
    if not chosen:
        raise ValueError("no row is chosen")
    low, left, limit, open_ = np.zeros(size, np.uint64), np.full(size, chosen), np.zeros(size, np.uint64), np.ones(size, bool)
    shift = 64
    while open_.any():
        if shift == 0:
            raise ValueError("rows need distinct numbers")
        bits = min(PASS_BITS, shift)
        above, shift = shift, shift - bits

        def counts(batch: pa.RecordBatch, above=above, shift=shift, low=low) -> np.ndarray:
            h = hashed(batch.column(row).to_numpy(), draws)
            same = np.ones(h.shape, bool) if above == 64 else (h >> np.uint64(above)) == (low >> np.uint64(above))
            part = ((h >> np.uint64(shift)) & np.uint64(width - 1)).astype(np.int64)
            i, d = np.nonzero(same)
            return np.bincount(d * width + part[i, d], minlength=size * width).reshape(size, width).astype(float)

        until = np.cumsum(_summed(rows.select(row), counts, size, width), axis=1)
        at = (until < left[:, None]).sum(1)
        if open_.any() and (at >= width)[open_].any():
            raise ValueError("more rows chosen than there are")
        at = np.minimum(at, width - 1)
        reached = until[np.arange(size), at]
        before = np.where(at > 0, until[np.arange(size), np.maximum(at - 1, 0)], 0)
        low = np.where(open_, low | (at.astype(np.uint64) << np.uint64(shift)), low)
        ended = open_ & (reached == left)
        limit = np.where(ended, low | np.uint64((1 << shift) - 1), limit)
        left = np.where(open_, left - before, left).astype(np.int64)
        open_ = open_ & ~ended
    return limit


#: Chances of zero, one and more draws of a row where as many are drawn as there are.
_DRAWN = np.exp(-1) * np.cumsum(1 / np.cumprod(np.r_[1.0, np.arange(1, 12)]))


def resampled(row: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """How often a bootstrap draw takes each row: Poisson numbers of mean one, which need no count of all rows."""
    return np.searchsorted(_DRAWN, mixed(row, draw), side="right").astype(float)
