"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton is built over the items' words. Training words stream through it: at each word it tells how long the
longest match that ends there is, and which items hold it. Every stretch of ``WINDOW`` matched words is a hit, as is
a whole shorter item. Words are mapped to the items' vocabulary first, and only runs of known words that are long
enough for a hit enter the automaton.

An automaton is made on the driver of at most ``SHARD_CHARS`` characters of items and broadcast; a larger test set
is cut into shards of that size. All are asked in one pass over the documents, one at a time, and their hits are merged
per document.

Defined cases: a null or empty text or item has no words; an item without words is never found; repeated items count
each by its id; a repeated document row gets its answer each time; empty tables give no rows or no hits; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SHARD_CHARS = 2_000_000
#: Bytes of texts that a task asks all shards about at once, where there are several.
HELD_CHARS = 16 << 20
#: A document is contaminated if it has a hit and ``COVERAGE`` times its hit words are no fewer than its words.
COVERAGE = 20

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str) -> list[bytes]:
    """Words after lower-casing A-Z: runs of ASCII letters, digits and anything outside ASCII."""
    return text.encode("utf-8").translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over word numbers; once built, flat arrays, with a table for states that branch."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self._following: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        texts = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in items if ws]
        for _, text in texts:
            last = 0
            for word in text:
                last = self._extend(last, word)
        #: Shortest stretch that can be a hit.
        self.least = min([window, *(len(t) for _, t in texts)])
        self._windows(texts)
        self._flatten()

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self._length.append(length)
        self._link.append(link)
        self._following.append(following)
        return len(self._length) - 1

    def _split(self, start: int, word: int, target: int) -> int:
        """The part of ``target`` that begins behind ``start``, made a state of its own."""
        copy = self._state(self._length[start] + 1, self._link[target], dict(self._following[target]))
        while start >= 0 and self._following[start].get(word) == target:
            self._following[start][word] = copy
            start = self._link[start]
        self._link[target] = copy
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self._following[last].get(word)
        if target is not None:  # an earlier item has this prefix
            return target if self._length[target] == self._length[last] + 1 else self._split(last, word, target)
        new = self._state(self._length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self._following[at]:
            self._following[at][word] = new
            at = self._link[at]
        if at >= 0:
            target = self._following[at][word]
            self._link[new] = target if self._length[target] == self._length[at] + 1 else self._split(at, word, target)
        return new

    def _windows(self, texts: list[tuple[str, list[int]]]) -> None:
        """Items by the state of their windows, and the nearest state on each state's way down that ends shorter items."""
        order = sorted(range(1, len(self._length)), key=self._length.__getitem__)
        window_state = [-1] * len(self._length)
        for s in order:
            if self._length[s] >= self.window:
                window_state[s] = s if self._length[self._link[s]] < self.window else window_state[self._link[s]]
        self.items: dict[int, set[str]] = {}
        whole: dict[int, dict[int, list[str]]] = {}
        for item, text in texts:
            state = 0
            for k, word in enumerate(text, 1):
                state = self._following[state][word]
                if k >= self.window:
                    self.items.setdefault(window_state[state], set()).add(item)
            if len(text) < self.window:
                whole.setdefault(state, {}).setdefault(len(text), []).append(item)
        #: Shorter items by the state that they end in and their length, shortest first.
        self.whole = {s: sorted(found.items()) for s, found in whole.items()}
        ends = [0] * len(self._length)
        for s in order:
            ends[s] = s if s in self.whole else ends[self._link[s]]
        self._at_window, self._ends = window_state, ends

    def _flatten(self) -> None:
        """Most states go on with one word: two arrays hold it, a table the words of the others."""
        one = [next(iter(f.items())) if len(f) == 1 else (-1, -1) for f in self._following]
        self.branches = {s: f for s, f in enumerate(self._following) if len(f) > 1}
        columns = (self._link, self._length, self._at_window, self._ends, [w for w, _ in one], [t for _, t in one])
        self.arrays = [np.array(c, np.int32) for c in columns]
        del self._following, self._link, self._length, self._at_window, self._ends

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lists"}

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches of words, merged, and the items whose windows occur."""
        if not hasattr(self, "_lists"):
            self._lists = [a.tolist() for a in self.arrays]  # plain numbers are quicker one by one
        link, length, at_window, ends, only_word, only_next = self._lists
        branches, whole, window = self.branches, self.whole, self.window
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        met: set = set()  # windows and shorter items that the text has had
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin < self.least:
                continue
            state = size = 0
            for at, word in enumerate(ids[begin:end].tolist(), begin + 1):
                while True:
                    target = only_next[state] if only_word[state] == word else branches[state].get(word) if state in branches else None
                    if target is not None:
                        state = target
                        size += 1
                        break
                    if not state:
                        break
                    state = link[state]
                    size = length[state]
                reach = 0
                if size >= window:
                    reach = window
                    s = at_window[state]
                    if s not in met:
                        met.add(s)
                        items |= self.items[s]
                s = ends[state]
                while s:
                    for width, names in whole[s]:
                        if width <= size:
                            reach = max(reach, width)
                            if (s, width) not in met:
                                met.add((s, width))
                                items.update(names)
                    s = ends[link[s]]
                    if -s in met:  # so is all that lies below
                        reach = max(reach, whole[s][-1][0]) if s else reach
                        break
                    if s:
                        met.add(-s)
                if reach:
                    start = at - reach
                    while hits and hits[-1][1] >= start:
                        start = min(start, hits.pop()[0])
                    hits.append((start, at))
        return hits, items


HITS_TYPE = "array<struct<start:bigint,end:bigint>>"


def _shards(benchmark: DataFrame, item_id: str, text: str, shard_chars: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in lists of at most ``shard_chars`` characters (or one longer item); at least one list."""
    shard, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("string"), F.coalesce(F.col(text), F.lit("")))
    for item, value in rows.toLocalIterator():
        if shard and size + len(value) > shard_chars:
            yield shard
            shard, size = [], 0
        shard.append((item or "", words(value)))
        size += len(value)
    yield shard


def _joined(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(hits):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def mark_hits(documents: DataFrame, benchmark: DataFrame, text: Column, window: int = WINDOW, shard_chars: int = SHARD_CHARS, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc`` (each row as a struct), ``body`` (its text), ``n_words``, ``hits`` (merged half-open word ranges), ``items`` (sorted).

    One pass over the rows, whatever the number of shards: a task holds a stretch of texts of ``HELD_CHARS`` characters,
    or one longer text, and asks one shard after the other about it.
    """
    context = documents.sparkSession.sparkContext
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("doc"),
        F.coalesce(text, F.lit("")).alias("body"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(HITS_TYPE).alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    # each of at most shard_chars characters; executors keep them on disk
    shards = [context.broadcast(Automaton(shard, window)) for shard in _shards(benchmark, item_id, item_text, shard_chars)]

    def marked(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[([], set()) for _ in range(b.num_rows)] for b in batches]
        split = [[words(t.as_py()) for t in b.column("body")] for b in batches]
        for shard in shards:
            automaton = shard.value
            for ws, own in zip(split, found, strict=True):
                for w, (hits, names) in zip(ws, own, strict=True):
                    new, items = automaton.scan(w)
                    hits += new
                    names |= items
            if len(shards) > 1:
                del automaton
                del shard._value  # the next access reads it again: one automaton is held at a time
        for batch, ws, own in zip(batches, split, found, strict=True):
            types = batch.schema
            hits = [[{"start": s, "end": e} for s, e in _joined(h)] for h, _ in own]
            columns = [batch.column("doc"), batch.column("body"), pa.array(list(map(len, ws)), pa.int64()), pa.array(hits, types.field("hits").type), pa.array([sorted(n) for _, n in own], types.field("items").type)]
            yield pa.RecordBatch.from_arrays(columns, names=types.names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("body").nbytes
            if size >= HELD_CHARS or len(shards) == 1:
                yield from marked(held)
                held, size = [], 0
        if held:
            yield from marked(held)

    return rows.mapInArrow(task, rows.schema)


N_HIT = "aggregate(hits, 0L, (total, h) -> total + h.end - h.start)"


def contaminated(coverage: int = COVERAGE) -> Column:
    return (F.expr(N_HIT) > 0) & (coverage * F.expr(N_HIT) >= F.col("n_words"))


def find_contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document row: ``doc_id, n_words, hits`` (merged half-open word ranges) and ``items`` found, sorted."""
    slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = mark_hits(slim, benchmark, F.col("text"), **options)
    return marked.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "hits", "items")


def contamination_report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document row."""
    found = find_contamination(documents, benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        F.expr(N_HIT).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def cut_hits(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without the stretches from each hit's first word to its last."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in hits:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return "".join(out) + text[at:]


def decontaminate(documents: DataFrame, benchmark: DataFrame, max_hit_words: int | None = None, coverage: int = COVERAGE, text: str = "text", **options) -> DataFrame:
    """``documents`` without those whose hits reach the coverage limit (one in ``coverage`` words).

    From what stays, hit stretches longer than ``max_hit_words`` are cut (None: none are). All columns stay.
    """
    marked = mark_hits(documents, benchmark, F.col(text), **options).where(~contaminated(coverage))
    if max_hit_words is None:
        return marked.select("doc.*")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longer = [[(h["start"], h["end"]) for h in hits if h["end"] - h["start"] > max_hit_words] for hits in batch.column("hits").to_pylist()]
            texts = [cut_hits(t, hits) for t, hits in zip(batch.column("body").to_pylist(), longer, strict=True)]
            yield batch.set_column(batch.schema.get_field_index("body"), "body", pa.array(texts, batch.schema.field("body").type))

    cut = marked.mapInArrow(task, marked.schema)
    kept = [F.when(F.col(f"doc.`{c}`").isNull(), None).otherwise(F.col("body")).alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in documents.columns]
    return cut.select(*kept)
