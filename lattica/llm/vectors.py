"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors become one row with a count. Vectors are rotated to principal axes, largest variance first; the first
two coordinates deal them into square cells as wide as two linked vectors can lie apart, so that only neighbouring
cells are compared. Cells are cut into blocks, and every pair of blocks that can hold a link is a tile, one task's
work. A tile accumulates products over leading coordinates, adds the product of the norms of what is left, and
leaves pairs whose bound stays under the threshold; those that are left are decided by their cosine in double
precision. A tile gives, per vector, how many it links and the smallest vector that it reaches within the tile:
never the links one by one.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors
of different lengths do not link; equal rows link with each other and each counts; a row without an id keeps a null
component; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.components import connected_components
from lattica.runtime import written

THRESHOLD = 0.9
#: Vectors that the axes are fitted on; they order the work and decide nothing.
SAMPLE = 8_192
#: Rows of a block, between these; in between, so many blocks that their pairs keep a cluster busy.
LEAST_ROWS, MOST_ROWS, BLOCKS = 1_024, 8_192, 24
#: Below the threshold by this much, rounding could hide a link from the bound.
SLACK = 1e-9


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, keys = [], []
        for v in batch.column("v").to_pylist():
            x = np.array(v if v and None not in v else [0.0], np.float64)
            good = np.isfinite(x).all() and x.any()
            data.append((x + 0.0).tobytes() if good else None)  # + 0.0: negative zeros are zeros
            keys.append(hashlib.blake2b(data[-1], digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "key", "v"])


def _unit(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length scaled to a largest component of one, which keeps their squares finite, and their norms."""
    x = np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(1))


def principal_axes(data: list[bytes]) -> dict[int, np.ndarray]:
    """Axes by vector length, largest second moment first."""
    axes = {}
    for size in {len(d) for d in data}:
        x, norm = _unit([d for d in data if len(d) == size])
        u = x / norm[:, None]
        axes[size] = np.linalg.eigh(u.T @ u)[1][:, ::-1].copy()
    return axes


def _rotated(x: np.ndarray, norm: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    u = x / norm[:, None]
    turn = axes.get(8 * x.shape[1])
    return u if turn is None else u @ turn


def _by_size(data: list[bytes]) -> Iterator[np.ndarray]:
    sizes = np.array([len(d) for d in data])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def linked_pairs(a: np.ndarray, a_norm: np.ndarray, b: np.ndarray, b_norm: np.ndarray, axes: dict[int, np.ndarray], threshold: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs at or over the threshold; ``upper``: a is b, and only i < j are asked for."""
    width = a.shape[1]
    cuts = sorted({max(1, width // 4), max(1, width // 2), width})
    ya, yb = _rotated(a, a_norm, axes), _rotated(b, b_norm, axes)
    rest = lambda y, k: np.sqrt(np.maximum((y[:, k:] ** 2).sum(1), 0))
    rest_a, rest_b = {k: rest(ya, k) for k in cuts}, {k: rest(yb, k) for k in cuts}
    found_i, found_j = [], []
    step = 512
    for i0 in range(0, len(a), step):
        for j0 in range(i0 if upper else 0, len(b), step):
            k = cuts[0]
            rows, columns = slice(i0, i0 + step), slice(j0, j0 + step)
            partial = ya[rows, :k] @ yb[columns, :k].T
            i, j = np.nonzero(partial + np.outer(rest_a[k][rows], rest_b[k][columns]) >= threshold - SLACK)
            partial = partial[i, j]
            i, j = i + i0, j + j0
            if upper:
                keep = i < j
                i, j, partial = i[keep], j[keep], partial[keep]
            for before, k in zip(cuts, cuts[1:], strict=False):
                partial = partial + np.einsum("ij,ij->i", ya[i, before:k], yb[j, before:k])
                keep = partial + rest_a[k][i] * rest_b[k][j] >= threshold - SLACK
                i, j, partial = i[keep], j[keep], partial[keep]
            exact = np.einsum("ij,ij->i", a[i], b[j]) / (a_norm[i] * b_norm[j]) >= threshold
            found_i.append(i[exact])
            found_j.append(j[exact])
    none = np.zeros(0, np.int64)
    return np.concatenate([*found_i, none]), np.concatenate([*found_j, none])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


TILE_DDL = "rep long, n_links long, reached long"


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    context = spark.sparkContext
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    clean = source.mapInArrow(_clean, "vec_id long, key binary, v binary")
    good = clean.where("key IS NOT NULL AND vec_id IS NOT NULL")
    # equal vectors meet in the map-side combine already; one row per key and task is exchanged
    reps = written(good.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")), "vectors")
    sample = reps.orderBy(F.xxhash64("key"), "rep").limit(SAMPLE).select("v").toArrow()["v"].to_pylist()
    axes = context.broadcast(principal_axes(sample))  # a square matrix per vector length
    width = float(np.sqrt(max(2 - 2 * threshold, 0.0))) + 1e-6

    def cells(data: list[bytes]) -> np.ndarray:
        """Vector size and the cell by the first two coordinates."""
        out = np.zeros((len(data), 3), np.int64)
        for rows in _by_size(data):
            x, norm = _unit([data[r] for r in rows])
            y = _rotated(x, norm, axes.value)
            out[rows, 0] = x.shape[1]
            out[rows, 1 : 1 + min(2, y.shape[1])] = np.floor(y[:, :2] / width)
        return out

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, counts = np.unique(cells(batch.column("v").to_pylist()), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, kinds.T), pa.array(counts)], names=["size", "x", "y", "n"])

    # coordinates lie within one, so a vector length has few cells, whatever the number of vectors
    counted = reps.select("v").mapInArrow(count_cells, "size long, x long, y long, n long").groupBy("size", "x", "y").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in counted)
    rows_of_block = min(MOST_ROWS, max(LEAST_ROWS, total // BLOCKS))
    first, blocks = {}, 0
    for r in sorted(counted):
        first[r["size"], r["x"], r["y"]] = (blocks, -(-r["n"] // rows_of_block))
        blocks += first[r["size"], r["x"], r["y"]][1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector goes to every tile of its block."""
        partners: dict[tuple, np.ndarray] = {}
        for batch in batches:
            data = batch.column("v").to_pylist()
            where = cells(data)
            numbers = [int.from_bytes(k[:8], "little") for k in batch.column("key").to_pylist()]
            row, low, high, side = [], [], [], []
            for i, (cell, number) in enumerate(zip(map(tuple, where.tolist()), numbers, strict=True)):
                start, n = first[cell]
                own = start + number % n
                if cell not in partners:
                    size, x, y = cell
                    near = [first[size, x + dx, y + dy] for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (size, x + dx, y + dy) in first]
                    partners[cell] = np.concatenate([np.arange(s, s + m) for s, m in near])
                other = partners[cell]
                row.append(np.full(len(other), i))
                low.append(np.minimum(own, other))
                high.append(np.maximum(own, other))
                side.append((other < own).astype(np.int32))
            if row:
                row = np.concatenate(row)
                out = [np.concatenate(low), np.concatenate(high), np.concatenate(side)]
                for at in range(0, len(row), 20_000):
                    taken = batch.take(pa.array(row[at : at + 20_000]))
                    yield pa.RecordBatch.from_arrays([*(pa.array(o[at : at + 20_000]) for o in out), taken.column("rep"), taken.column("copies"), taken.column("v")], names=["low", "high", "side", "rep", "copies", "v"])

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.sort_by([("side", "ascending"), ("rep", "ascending")])
        rep, copies, side = (tile[c].to_numpy() for c in ("rep", "copies", "side"))
        split = int((side == 0).sum())
        x, norm = _unit(tile["v"].to_pylist())
        if tile["low"][0] == tile["high"][0]:
            i, j = linked_pairs(x, norm, x, norm, axes.value, threshold, True)
        else:
            i, j = linked_pairs(x[:split], norm[:split], x[split:], norm[split:], axes.value, threshold, False)
            j = j + split
        by_rep = np.argsort(rep, kind="stable")
        place = np.empty(len(rep), np.int64)
        place[by_rep] = np.arange(len(rep))
        i, j = place[i], place[j]
        rep, copies = rep[by_rep], copies[by_rep]
        links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
        reached = rep[_roots(len(rep), i, j)]
        some = links > 0
        return pa.table({"rep": rep[some], "n_links": links[some].astype(np.int64), "reached": reached[some]})

    tiles = reps.select("key", "rep", "copies", "v").mapInArrow(deal, "low long, high long, side int, rep long, copies long, v binary")
    found = written(tiles.groupBy("low", "high").applyInArrow(compare, TILE_DDL), "vector-links")
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("reached").alias("b")))
    links = found.groupBy("rep").agg(F.sum("n_links").alias("others"))
    known = (
        reps.select("key", "rep", "copies")
        .join(links, "rep", "left")
        .join(components.withColumnRenamed("id", "rep"), "rep", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    member = F.when(F.col("vec_id").isNotNull(), F.col("key"))
    return (
        clean.select("vec_id", member.alias("key"))
        .join(known, "key", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
