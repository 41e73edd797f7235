"""Leading eigenvalues of large graphs by block Lanczos, and what they say about coupling.

A product of the adjacency with a block of vectors is a join of edge rows with the vectors' rows and a sum by node; the
vectors stay in tables with a row per node. The driver sees products of vectors with vectors only: matrices of at most
``STEPS * width`` rows, whatever the graph. Every step's tables are written, so a lost executor costs a re-read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import network
from lattica.runtime import drop_written, written

#: Eigenvalues asked for; vectors beside them that make the last ones converge; blocks of vectors that are kept at most.
LEADING, BESIDE, STEPS = 50, 14, 16
#: Norm of ``A x - value x`` over the largest value, under which a value counts as found; its error is about the square.
TOLERANCE = 1e-4


def giant_component(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` of the component with most nodes (the one with the smallest id among equals)."""
    labels = network.components(edges)
    size = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    chosen = size.agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("best")).select((-F.col("best.c")).alias("component"))
    inside = labels.join(F.broadcast(chosen), "component").select(F.col("id").alias("u"))  # chosen is one row
    return edges.join(inside, "u", "left_semi").select("u", "v")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1)), pa.int32()), pa.array(x.ravel()))


def _sums(columns: list[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def _gram(table: DataFrame, known: int, width: int, taken: np.ndarray | None = None) -> np.ndarray:
    """``[q w]' w`` over all rows of ``id, q, w``, after ``w`` has lost ``q taken``: (known + width) x width numbers."""
    names = [f"c{i}" for i in range(width)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((known + width, width))
        for batch in batches:
            q, w = _matrix(batch.column("q"), batch.num_rows), _matrix(batch.column("w"), batch.num_rows)
            w = w if taken is None else w - q @ taken
            total += np.hstack([q, w]).T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *map(pa.array, total.T)], names=["i", *names])

    ddl = ", ".join(["i long", *(f"{n} double" for n in names)])
    rows = table.select("q", "w").mapInArrow(part, ddl).groupBy("i").agg(*_sums(names)).collect()
    return np.array([[r[n] for n in names] for r in sorted(rows)])


def leading_eigenvalues(edges: DataFrame, k: int = LEADING, beside: int = BESIDE, steps: int = STEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The k eigenvalues largest in size of the graph ``u, v`` (each edge once), signed, largest first; fewer if it has
    fewer nodes. Raises if they have not converged after ``steps`` blocks."""
    both = edges.select(F.col("u").alias("i"), F.col("v").alias("j")).unionByName(edges.select(F.col("v").alias("i"), F.col("u").alias("j")))
    both = written(both, "spectrum-edges")
    nodes = both.select(F.col("i").alias("id")).distinct()
    n = nodes.count()
    width = min(k + beside, n)
    draw = lambda x: F.pmod(F.xxhash64("id", x), F.lit(1 << 31)) / float(1 << 30) - 1.0
    drawn = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), draw)
    table = written(nodes.select("id", F.array().cast("array<double>").alias("q"), drawn.alias("w")), "spectrum-start")
    known, projected, scale = 0, np.zeros((0, 0)), 0.0
    while True:
        # w loses what it has of q, twice, and what is left of it becomes the next block; dependent directions go
        taken = _gram(table, known, width)[:known]
        again = _gram(table, known, width, taken)
        rest = again[known:] - again[:known].T @ again[:known]
        size, turn = np.linalg.eigh((rest + rest.T) / 2)
        scale = max(scale, float(size[-1]))
        kept = size > 1e-13 * scale
        beta = np.sqrt(size[kept])[:, None] * turn[:, kept].T
        if known:
            column = np.zeros((known, width))
            column[:] = taken
            last = projected.shape[0]
            grown = np.zeros((known, known))
            grown[:last, :last] = projected
            grown[:, known - width :] = column
            grown[known - width :, :] = column.T
            projected = grown
            values, vectors = np.linalg.eigh((projected + projected.T) / 2)
            order = np.argsort(-np.abs(values), kind="stable")[:k]
            residual = np.linalg.norm(beta @ vectors[known - width :, order], axis=0) if kept.any() else np.zeros(len(order))
            if len(order) == min(k, n) and residual.max(initial=0) <= tolerance * np.abs(values).max():
                drop_written(table, both)
                return values[order]
            if not kept.any():
                raise ValueError("the start vectors miss some of the graph's directions")
        if known >= steps * (k + beside):
            raise ValueError(f"not converged after {steps} blocks: residual {residual.max():.3g}")
        away, into = taken + again[:known], turn[:, kept] / np.sqrt(size[kept])

        def extend(batches: Iterator[pa.RecordBatch], away=away, into=into) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, w = _matrix(batch.column("q"), batch.num_rows), _matrix(batch.column("w"), batch.num_rows)
                new = (w - q @ away) @ into
                yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(np.hstack([q, new])), _lists(new)], names=["id", "q", "x"])

        basis = written(table.mapInArrow(extend, "id long, q array<double>, x array<double>"), "spectrum-basis")
        drop_written(table)
        width = int(kept.sum())
        known += width
        names = [f"x{i}" for i in range(width)]
        spread = basis.select(F.col("id").alias("j"), *(F.col("x")[i].alias(c) for i, c in enumerate(names)))
        product = both.join(spread, "j").groupBy("i").agg(*_sums(names)).select(F.col("i").alias("id"), F.array(*names).alias("w"))
        table = written(basis.select("id", "q").join(product, "id"), "spectrum-step")
        drop_written(basis)


def five_of(values: Column, nodes: Column, edges: Column) -> dict[str, Column]:
    """Concentration, rigidity, density, gap and diversity of eigenvalues (an array, largest size first)."""
    sizes = F.transform(values, lambda x: F.greatest(F.abs(x), F.lit(1e-12)))
    total = F.aggregate(sizes, F.lit(0.0), lambda s, x: s + x)
    share = F.filter(F.transform(sizes, lambda x: x / total), lambda p: p > 1e-12)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log(p))
    count = F.size(share)
    return {
        "oh": sizes[0] * F.size(sizes) / total,
        "oh_nodes": sizes[0] * nodes / total,
        "eta": F.when(count > 1, 1 - entropy / F.log(count)).otherwise(0.0),
        "density": 2 * edges / (nodes * (nodes - 1)),
        "gap": F.when(F.size(sizes) > 1, (sizes[0] - F.try_element_at(sizes, F.lit(2))) / (sizes[0] + 1e-10)).otherwise(0.0),
        "xi": F.exp(entropy) / count,
        "lambda_1": sizes[0],
    }


def graph_five(edges: DataFrame, k: int = LEADING) -> DataFrame:
    """One row for the giant component of ``u, v``: ``nodes, edges, values`` and the five of its leading eigenvalues."""
    giant = written(giant_component(edges), "giant")
    counted = giant.agg(F.count(F.lit(1)).alias("edges")).crossJoin(giant.select(F.explode(F.array("u", "v")).alias("id")).agg(F.countDistinct("id").alias("nodes")))  # one row each
    values = F.array(*[F.lit(float(x)) for x in leading_eigenvalues(giant, k)])
    found = counted.withColumn("values", values)
    return found.select("nodes", "edges", "values", *(c.alias(n) for n, c in five_of(F.col("values"), F.col("nodes"), F.col("edges")).items()))
