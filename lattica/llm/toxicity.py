"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

A text's sentences are seen through short windows: words, freed of punctuation and of digits that stand for
letters, long ones in overlapping pieces, and single characters that spaces hold apart joined to one. The kernel of
two windows sums, over all subsequences of three and four characters within a short span, ``DECAY`` to the power of
the spans, divided by what windows of their lengths have at most: gaps and inserted characters lower it, they do not
break it. A sentence's margin is that of its strongest window.

Training is by labelled sentences of at most ``TRAIN_ROWS`` labelled texts: all windows of clean texts are negative;
of a toxic text, the windows that bear its label are found in turns with the machine, and variants
of the most telling ones with a letter inserted are positive too. Landmarks are windows that
tell the classes apart and common ones. The linear machine in the landmarks' feature space is exact algebra in the
kernel, so it collapses to one weight per subsequence, and scoring gathers weights. A logistic fit over a text's
three strongest windows, the sum of its positive margins and its number of words gives its score.

Defined cases: a null or empty text has no window and gets the score of a text without any; repeated rows get equal
scores; without labels, or with one class, every score is the labels' smoothed rate; an empty table gives no rows;
other columns are ignored, whatever their names, and are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.folds import fold, labelled_sample
from lattica.runtime import give_back, release, tidied

#: Bound of the labelled rows that the machine learns from.
TRAIN_ROWS = 5_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
LANDMARKS = 256
DECAY = 0.6
#: Windows of a word longer than PIECE, each STEP on.
PIECE, STEP = 24, 12
#: Windows whose margins a task remembers.
REMEMBERED = 1 << 16
#: Texts whose words are held at once, and windows that are scored at once.
AT_ONCE = 256
AT_ONCE_WINDOWS = 5_000
SLOTS = 3

# Letters with a code of their own, and digits that stand for letters.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëçñáíóúàâîïôûùœ"
DIGIT_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
_START, _END, _OTHER = len(LETTERS) + 1, len(LETTERS) + 2, len(LETTERS) + 3
ALPHABET = len(LETTERS) + 4
_CODES = np.full(0x250, _OTHER, np.int32)
_CODES[0] = 0
for _k, _c in enumerate(LETTERS, 1):
    _CODES[ord(_c)] = _k
_CODES[1], _CODES[2] = _START, _END
#: Offsets of the later characters of a subsequence, by number of characters.
OFFSETS = [(0, *o) for o in combinations(range(1, 5), 2)] + [(0, *o) for o in combinations(range(1, 6), 3)]
TABLE = ALPHABET**3 + ALPHABET**4

_DROP = re.compile(r"[\W_]+")
_DIGITS = str.maketrans(DIGIT_LETTERS)
_SPACED = re.compile(r"(?<!\S)\w(?:[ .*_-]+\w){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?]\s+|\n+")


def windows_of_word(word: str) -> list[str]:
    bare = _DROP.sub("", word).translate(_DIGITS)
    if len(bare) <= PIECE:
        return [bare] if bare else []
    return [bare[i : i + PIECE] for i in range(0, len(bare) - PIECE + STEP, STEP)]


def tokens(text: str) -> set[str]:
    """Distinct raw words of a text and joined runs of single characters."""
    lower = text.lower()
    found = set(lower.split())
    for m in _SPACED.finditer(lower):
        found.add(_DROP.sub("", m[0]))
    return found


def codes(windows: list[str]) -> np.ndarray:
    """Character codes with the start and end marks, zero behind."""
    width = max(map(len, windows), default=0) + 2
    marked = np.array(["\x01" + w + "\x02" for w in windows], dtype=f"U{width}")
    points = marked.view(np.uint32).reshape(len(windows), width)
    return _CODES[np.where(points < len(_CODES), points, 3)]


def subsequences(window_codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each choice of offsets: the subsequences' numbers by place (-1 where past the end), and their weight."""
    wide = np.pad(window_codes, ((0, 0), (0, 5))).astype(np.int64)
    n = window_codes.shape[1]
    for offsets in OFFSETS:
        number = np.zeros(window_codes.shape, np.int64)
        for o in offsets:
            number = number * ALPHABET + wide[:, o : o + n]
        last = wide[:, offsets[-1] : offsets[-1] + n]
        number += ALPHABET**3 if len(offsets) == 4 else 0
        yield np.where(last > 0, number, -1), DECAY ** (offsets[-1] + 1)


def sizes(window_codes: np.ndarray) -> np.ndarray:
    """The norm that windows of these lengths are divided by."""
    length = (window_codes > 0).sum(1)
    squared = sum(DECAY ** (2 * (o[-1] + 1)) * np.maximum(length - o[-1], 0) for o in OFFSETS)
    return np.sqrt(np.maximum(squared, 1e-12))


@dataclass
class Machine:
    """Weights by subsequence, and the logistic fit over the strongest windows' margins."""

    numbers: np.ndarray
    weights: np.ndarray
    bias: float
    logistic: np.ndarray
    _table: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def margins(self, windows: list[str]) -> np.ndarray:
        if self._table is None:
            self._table = np.zeros(TABLE + 1, np.float32)  # the last entry is for places past the end
            self._table[self.numbers] = self.weights
        out = np.empty(len(windows))
        for i in range(0, len(windows), AT_ONCE_WINDOWS):
            c = codes(windows[i : i + AT_ONCE_WINDOWS])
            total = np.zeros(len(c))
            for number, weight in subsequences(c):
                total += weight * self._table[number].sum(1)
            out[i : i + AT_ONCE_WINDOWS] = total / sizes(c) + self.bias
        return out

    def scores(self, strongest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_features(strongest) @ self.logistic, -30, 30)))


def _features(seen: np.ndarray) -> np.ndarray:
    """Strongest margins; the logarithms of the sum of positive margins and of the number of words; one."""
    margins, positive, n = np.clip(seen[:, :SLOTS], -2.0, 2.0), seen[:, SLOTS], seen[:, SLOTS + 1]
    return np.column_stack([margins, np.log(positive + 0.05), np.log(n + 20), np.ones(len(seen))])


class Scorer:
    """Margins of raw words, remembered up to a bound."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.known: dict[str, float] = {}

    def strongest(self, texts: list[str]) -> np.ndarray:
        """Per text: its strongest margins, the sum of its positive ones, the number of its distinct words."""
        found = [tokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*found).difference(self.known)) if found else []
        pieces = [windows_of_word(t) for t in new]
        flat = [w for p in pieces for w in p]
        margins = self.machine.margins(flat).tolist() if flat else []
        at = 0
        for token, p in zip(new, pieces, strict=True):
            self.known[token] = max(margins[at : at + len(p)], default=-2.0)
            at += len(p)
        out = np.full((len(texts), SLOTS + 2), -2.0)
        for i, ts in enumerate(found):
            margins = np.fromiter(map(self.known.__getitem__, ts), float, len(ts))
            top = np.sort(margins)[::-1][:SLOTS]
            out[i, : len(top)] = top
            out[i, SLOTS:] = margins[margins > 0].sum(), len(ts)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        parts = [self.machine.scores(self.strongest(texts[i : i + AT_ONCE])) for i in range(0, len(texts), AT_ONCE)]
        return np.concatenate([np.zeros(0), *parts])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Primal squared-hinge machine by Newton steps over the rows inside the margin, a stretch of rows at a time."""
    w = np.zeros(z.shape[1])
    for _ in range(30):
        left, right = np.eye(len(w)), np.zeros(len(w))
        for i in range(0, len(z), AT_ONCE_WINDOWS):
            part, signs = z[i : i + AT_ONCE_WINDOWS].astype(float), y[i : i + AT_ONCE_WINDOWS]
            inside = signs * (part @ w) < 1
            part, signs, c = part[inside], signs[inside], cost[i : i + AT_ONCE_WINDOWS][inside]
            left += (part * c[:, None]).T @ part
            right += part.T @ (c * signs)
        new = np.linalg.solve(left, right)
        done = np.abs(new - w).max() < 1e-8
        w = new
        if done:
            break
    return w


class _Landmarks:
    """Kernel rows against fixed windows, and their feature map."""

    def __init__(self, windows: list[str]):
        c = codes(windows)
        rows, numbers, values = [], [], []
        for number, weight in subsequences(c):
            r, k = np.nonzero(number >= 0)
            rows.append(r)
            numbers.append(number[r, k])
            values.append(np.full(len(r), weight))
        rows, numbers, values = map(np.concatenate, (rows, numbers, values))
        self.numbers, place = np.unique(numbers, return_inverse=True)
        self.matrix = np.zeros((len(self.numbers) + 1, len(windows)))
        np.add.at(self.matrix, (place, rows), values / sizes(c)[rows])
        self._place = np.full(TABLE + 1, len(self.numbers), np.int32)
        self._place[self.numbers] = np.arange(len(self.numbers))
        values, vectors = np.linalg.eigh(self.kernel(windows))
        keep = values > 1e-6 * values.max()
        self.map = vectors[:, keep] / np.sqrt(values[keep])

    def kernel(self, windows: list[str]) -> np.ndarray:
        out = np.zeros((len(windows), self.matrix.shape[1]))
        for i in range(0, len(windows), 1_000):
            c = codes(windows[i : i + 1_000])
            part = out[i : i + 1_000]
            for number, weight in subsequences(c):
                place = self._place[number]
                r, k = np.nonzero(place < len(self.numbers))
                if len(r):  # places come row by row, so each row's sum is a stretch
                    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    part[r[first]] += weight * np.add.reduceat(self.matrix[place[r, k]], first)
            part /= sizes(c)[:, None]
        return out


def _feature_rows(space: _Landmarks, windows: list[str]) -> np.ndarray:
    """Features of windows with a one behind, in single precision."""
    out = np.ones((len(windows), space.map.shape[1] + 1), np.float32)
    for i in range(0, len(windows), 1_000):
        out[i : i + 1_000, :-1] = space.kernel(windows[i : i + 1_000]) @ space.map
    return out


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, turns: int = 3) -> Machine:
    """Learns from whole texts and their labels; the same for any order of the rows."""
    order = sorted(range(len(texts)), key=lambda i: (texts[i], labels[i]))
    texts, y = [texts[i] for i in order], np.array([float(labels[i] > 0) for i in order])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    constant = np.array([0.0] * (SLOTS + 2) + [np.log(rate / (1 - rate))])
    if len(y) == 0 or y.min() == y.max():
        return Machine(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, constant)
    fitted = np.arange(len(y)) % 3 != 2  # the rest is for the logistic fit
    same: dict[str, str] = {}  # one object for equal windows
    one = same.setdefault
    split = lambda text: {one(w, w) for t in tokens(text) for w in windows_of_word(t)}
    toxic, clean = Counter(), Counter()
    sentences = []
    for i in np.flatnonzero(fitted):
        if y[i]:
            bag = [split(s) for s in _SENTENCE.split(texts[i])]
            sentences += bag
            toxic.update(set().union(*bag))
        else:
            clean.update(split(texts[i]))
    del same, one
    n_toxic, n_clean = max(1, int(y[fitted].sum())), max(1, int((1 - y[fitted]).sum()))
    odds = {w: float(np.log((toxic[w] + 0.2) / (n_toxic + 0.4) * (n_clean + 0.4) / (clean[w] + 0.2))) for w in toxic}
    telling = sorted((w for w in toxic if toxic[w] >= 2 and odds[w] > 1.0), key=lambda w: (-odds[w] * np.sqrt(toxic[w]), w))
    common = sorted(clean, key=lambda w: (-clean[w], w))
    spread = sorted(clean, key=lambda w: (hash_of(w), w))
    half = landmarks // 2
    chosen = list(dict.fromkeys(telling[:half] + common[: half // 2] + spread))[:landmarks]
    if not chosen:
        return Machine(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, constant)
    space = _Landmarks(chosen)
    positive = [w for w in telling if odds[w] > 1.8]
    negative = list(dict.fromkeys(common[:5_000] + spread[:15_000]))
    clean_windows = sorted(clean)
    machine = Machine(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, constant)
    inserted = [v for w in telling[:half] for v in with_insertions(w) if v not in clean]
    for turn in range(turns):
        positive = list(dict.fromkeys(positive + inserted))
        known = set(positive)
        rows = positive + [w for w in negative if w not in known]
        target = np.array([1.0] * len(positive) + [-1.0] * (len(rows) - len(positive)))
        seen = np.array([toxic[w] if t > 0 else clean[w] for w, t in zip(rows, target, strict=True)], float)
        cost = np.sqrt(np.maximum(seen, 1)) * np.where(target > 0, 4.0, 1.0)
        w = _squared_hinge(_feature_rows(space, rows), target, cost)
        alpha = space.map @ w[:-1]
        machine = Machine(space.numbers, (space.matrix[:-1] @ alpha).astype(np.float32), float(w[-1]), constant)
        if turn + 1 == turns:
            break
        of_toxic = list(toxic)
        margin = dict(zip(of_toxic, machine.margins(of_toxic).tolist(), strict=True))
        found = set()
        for sentence in sentences:
            # the sentences that bear the label, by their strongest windows
            best = max(sentence, key=lambda w: (margin[w], w), default=None)
            if best is not None and margin[best] > 0 and odds[best] > 0.5:
                found.add(best)
        positive = sorted(found | set(telling[:half]))
        hard = [clean_windows[k] for k in np.argsort(-machine.margins(clean_windows), kind="stable")[:10_000]]
        negative = list(dict.fromkeys(hard + common[:5_000] + spread[:10_000]))
    rest = np.flatnonzero(~fitted)
    strongest = Scorer(machine).strongest([texts[i] for i in rest])
    machine.logistic = _logistic(_features(strongest), y[rest])
    return machine


def with_insertions(window: str) -> list[str]:
    """Three variants with a letter inserted, each between two characters that the window's hash chooses."""
    out = []
    for k in range(3 if len(window) > 3 else 0):
        h = hash_of(f"{k}{window}")
        at = 1 + h % (len(window) - 1)
        out.append(window[:at] + LETTERS[h // 97 % 26] + window[at:])
    return out


def hash_of(window: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(window)


def train(documents: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = TRAIN_ROWS) -> Machine:
    """A machine from at most ``rows`` labelled rows outside the held-out fold."""
    found = labelled_sample(documents, labels, target, folds, held_out, rows).toArrow()
    texts, targets = found["text"].to_pylist(), found["target"].to_pylist()
    del found
    release(documents.sparkSession)  # the fit takes the driver's memory
    machine = fit(texts, targets)
    give_back()
    return machine


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_toxicity(documents: DataFrame, machine: Machine, folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document, row by row."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)  # as large as its landmarks

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.scores(batch.column("text").to_pylist())
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), predicted], schema=SCHEMA)

    source = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(fold(F.col(doc_id), folds) == held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return source.mapInArrow(tidied(task), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(documents: DataFrame, machine: Machine, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows whose score is under the threshold, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    place = documents.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.scores([t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(scores < threshold))

    return documents.mapInArrow(tidied(task), documents.schema)
