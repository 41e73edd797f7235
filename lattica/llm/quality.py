"""Quality classifier: histogram gradient-boosted trees over statistics of a whole text.

Trees are grown on the driver from the statistics (not the texts) of at most ``TRAIN_ROWS`` labelled rows, and
flattened into arrays of one complete tree each, so that a batch of texts descends all trees by numpy indexing.

Defined cases: a null or empty text has the statistics of an empty one and gets a score as any other; repeated rows
get equal scores; without labels, or with one class, every score is the labels' smoothed rate; an empty table gives
no rows; other columns are ignored, whatever their names, and are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.folds import fold, labelled_sample

#: Bound of the labelled rows that trees are grown from.
TRAIN_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_CLASSES = np.stack(
    [
        np.array([65 <= b <= 90 for b in range(256)]),
        _LETTER,
        np.array([b >= 128 for b in range(256)]),
        np.array([48 <= b <= 57 for b in range(256)]),
        np.array([b in b" " for b in range(256)]),
        np.array([b in b"\n" for b in range(256)]),
        np.array([b in b".,;:?'\"()" for b in range(256)]),
        np.array([b in b"!" for b in range(256)]),
        np.array([b in b"|" for b in range(256)]),
        np.array([b in b"#$%&*@^~<>={}[]\\/_+" for b in range(256)]),
        np.array([b < 32 and b not in b"\n\t\r" for b in range(256)]),
    ],
    axis=1,
).astype(float)
FEATURES = 11 + 12


def statistics(text: bytes) -> list[float]:
    """Shares of byte classes, and how long, varied and repetitive words and lines are."""
    n = len(text)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = histogram @ _CLASSES / max(n, 1)
    p = histogram[histogram > 0] / max(n, 1)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line]
    distinct = set(words)
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    repeats = sum(map(eq, words, words[1:]))
    bare = sum(w.isalpha() for w in distinct)
    return [
        *shares,
        np.log1p(n),
        np.log1p(len(words)),
        float(lengths.mean()) if len(words) else 0.0,
        float(lengths.std()) if len(words) else 0.0,
        float(lengths.max()) if len(words) else 0.0,
        len(distinct) / k,
        repeats / k,
        bare / max(len(distinct), 1),
        np.log1p(len(lines)),
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        float(-(p * np.log2(p)).sum()),
    ]


def statistics_matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(len(texts), FEATURES)


@dataclass(frozen=True)
class Trees:
    """Complete trees as arrays: tree t's node k has children 2k+1 and 2k+2; leaves follow the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:  # all rows go down one level at a time
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            total += self.leaf[t, node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Second-order boosting of the logistic loss over quantile bins."""
    inner = 2**depth - 1
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(width) * bins
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (here, width, bins)
            gs = np.bincount(place, np.repeat(g, width), here * width * bins).reshape(shape).cumsum(2)
            hs = np.bincount(place, np.repeat(h, width), here * width * bins).reshape(shape).cumsum(2)
            g_all, h_all = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + ridge) + (g_all - gs) ** 2 / (h_all - hs + ridge) - g_all**2 / (h_all + ridge)
            gain[(hs < least) | (h_all - hs < least)] = 0
            best = gain.reshape(here, -1).argmax(1)
            for k in range(here):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        place = node - inner
        sums, weights = np.bincount(place, g, inner + 1), np.bincount(place, h, inner + 1)
        leaf[t] = rate * sums / (weights + ridge)
        total += leaf[t][place]
    return Trees(feature, threshold, leaf, base)


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled rows outside the held-out fold."""
    sample = labelled_sample(documents, labels, target, folds, held_out, rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics_matrix(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column("target")], names=["x", "target"])

    found = sample.mapInArrow(task, "x array<double>, target int").toArrow()
    x = np.array(found["x"].to_pylist(), float).reshape(-1, FEATURES)
    y = (found["target"].to_numpy() > 0).astype(float)
    order = np.lexsort((*x.T, y))  # the same trees whatever the order in which rows arrive
    return grow(x[order], y[order])


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_quality(documents: DataFrame, trees: Trees, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document, row by row."""
    shared = documents.sparkSession.sparkContext.broadcast(trees)  # fixed number of trees

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(statistics_matrix(batch.column("text").cast(pa.binary()).to_pylist()))
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), predicted], schema=SCHEMA)

    source = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(fold(F.col(doc_id), folds) == held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return source.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")
