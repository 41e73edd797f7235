"""Language-model scoring with an Elias-Fano n-gram trie in shards.

Tokens are the words of the lower-cased text and one end. The trie holds every word of the training part and every
n-gram that occurs ``LEAST_COUNT`` times, whatever the corpus' size. Probabilities are interpolated with an absolute
discount; what a context's kept followers leave goes to the next shorter context, and in the end to words that
training never saw, so that each context's probabilities sum to one.

A level of the trie is a sequence of nodes by parent and word. It is cut into shards between parents, of about
``SHARD`` nodes each, so that their number grows with the corpus and their size does not; words are cut by hash. Tasks
make the shards from sorted ranges of the counts and leave them in the shared folder; the driver knows only where each
begins. Workers map the files, so that pages are shared and can be dropped; a portion's questions are sorted and
asked shard by shard. Nothing of the trie is broadcast or collected.

In a shard the places where parents' children begin (pointers) and the word numbers, made monotone by their parent's
number times the vocabulary, are Elias-Fano sequences; discounted shares and back-offs are numbers into the shard's
books of 256. It is asked by successor search relative to the context, whose number times the vocabulary is where its
words begin.

Defined cases: a null or empty text is its end alone; a row without an id is scored and not learned from; repeated
rows count each; without training rows all counts are zero; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import mmap
import pickle
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.folds import fold
from lattica.runtime import drop_written, shared_dir, written

FOLDS, HELD_OUT = 7, 2
ORDER = 3
#: Words or n-grams of a shard, about.
SHARD = 1 << 21
#: n-grams of two words and more are kept from this count on.
LEAST_COUNT = 2
DISCOUNT = 0.75
BOOK = 256
#: Tokens that are counted, or numbered and scored, at once.
COUNTED, SCORED = 1 << 20, 1 << 18
#: The end's number among word hashes.
END = 1


def tokens(text: str | None) -> np.ndarray:
    """Numbers of a text's tokens: 63-bit hashes of words, and END."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z, and ASCII white space without \x1c-\x1f
    # to hash a word takes less than to look it up among many
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    # the top bit goes, so that numbers fit long columns; 0 and END are no word's
    return np.append(np.maximum((hashes >> np.uint64(1)).astype(np.int64), 2), END)


# Elias-Fano -----------------------------------------------------------------------------------------------------


def _packed(flags: np.ndarray) -> np.ndarray:
    data = np.packbits(flags, bitorder="little")
    return np.pad(data, (0, -len(data) % 8 + 8)).view(np.uint64)


def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one with ``rank`` ones before it, in each word."""
    place, rank = np.zeros(len(word), np.uint64), rank.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        mask = np.uint64((1 << width) - 1)
        below = np.bitwise_count((word >> place) & mask).astype(np.int64)
        on = rank >= below
        rank -= np.where(on, below, 0)
        place += np.where(on, np.uint64(width), np.uint64(0))
    return place.astype(np.int64)


@dataclass
class EliasFano:
    """A monotone sequence in about ``2 + log2(universe / n)`` bits a number, asked by whole arrays."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(math.log2(max(universe, 1) / n))) if n and universe > n else 0
        values = values.astype(np.uint64)
        flags = np.zeros(n + (universe >> low_bits) + 2, bool)
        flags[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = True
        high = _packed(flags)
        bits = np.zeros(n * low_bits, bool)
        for k in range(low_bits):
            bits[k::low_bits] = (values >> np.uint64(k)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high))]).astype(np.uint32 if n < 1 << 32 else np.uint64)
        return cls(n, low_bits, _packed(bits), high, ones)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        value = self.low[word] >> shift
        # a shift by 64 is none in numpy, so the next word comes in two steps
        value |= (self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
        return value & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Numbers at places ``0 <= i < n``."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def _zeros_before(self) -> np.ndarray:
        return np.arange(len(self.ones)) * 64 - self.ones.astype(np.int64)

    def successor(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First place in ``[begin, end)`` whose number is at least x (``end`` if none), and whether it is x."""
        end = np.broadcast_to(self.n if end is None else end, x.shape)
        if not self.n:
            return end, np.zeros(len(x), bool)
        if not hasattr(self, "_zeros"):
            self._zeros = self._zeros_before()
        part = (x >> np.uint64(self.low_bits)).astype(np.int64)
        # numbers with a smaller high part end at the part-th zero; those with this one follow it as ones
        k = np.maximum(part - 1, 0)
        word = np.searchsorted(self._zeros, k, side="right") - 1
        zero = np.where(part > 0, word * 64 + _in_word(~self.high[word], k - self._zeros[word]), -1)
        start = zero + 1
        word, shift = start >> 6, (start & 63).astype(np.uint64)
        ahead = (self.high[word] >> shift) | ((self.high[word + 1] << np.uint64(1)) << (np.uint64(63) - shift))
        ones = np.bitwise_count(ahead & ~(ahead + np.uint64(1))).astype(np.int64)  # ones before the first zero
        first = zero + 1 - part
        last = first + ones
        if (full := np.flatnonzero(ones == 64)).size:  # a long stretch of ones: its end is the next zero
            k = part[full]
            word = np.searchsorted(self._zeros, k, side="right") - 1
            last[full] = word * 64 + _in_word(~self.high[word], k - self._zeros[word]) - k
        lo, stop = np.maximum(first, begin), np.minimum(last, end)
        want = x & np.uint64((1 << self.low_bits) - 1)
        active = np.flatnonzero(lo < stop)
        low, high, sought = lo[active], stop[active], want[active]
        while active.size:
            middle = (low + high) >> 1
            less = self._low(middle) < sought
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            on = low < high
            lo[active] = low
            active, low, high, sought = active[on], low[on], high[on], sought[on]
        hit = lo < stop
        inside = np.flatnonzero(hit)
        hit[inside] = self._low(lo[inside]) == want[inside]
        return np.minimum(lo, end), hit


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers into a book of at most BOOK values, the means of equally filled bins."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    order = np.argsort(values, kind="stable")
    bins = np.array_split(values[order], min(BOOK, len(values)))
    book = np.array([b.mean() for b in bins])
    code = np.empty(len(values), np.uint8)
    code[order] = np.repeat(np.arange(len(bins)), list(map(len, bins)))
    return code, book


@dataclass
class Level:
    """Nodes of one n-gram length by (parent, word): pointers, words, and books of probabilities and back-offs."""

    pointers: EliasFano
    words: EliasFano
    probability: np.ndarray
    book: np.ndarray
    backoff: np.ndarray
    backoff_book: np.ndarray

    def find(self, parent: np.ndarray, word: np.ndarray, vocabulary: int) -> np.ndarray:
        """Node numbers, -1 where there is none."""
        if not len(parent):
            return np.zeros(0, np.int64)
        # each question once, in order
        keys, back = np.unique(parent * vocabulary + word, return_inverse=True)
        place, hit = self.words.successor(keys.astype(np.uint64))
        return np.where(hit, place, -1)[back]

    def children(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of parents begin and end."""
        return self.pointers.get(parent).astype(np.int64), self.pointers.get(parent + 1).astype(np.int64)


class Trie:
    """A whole trie in memory, of one shard a level, with smoothed probabilities in place of shares: no query makes one."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.distinct = total, distinct
        inside = int(self.counts.sum())
        # half a token for words that training never saw
        self.probabilities = self.counts / (total + 0.5) if total else np.zeros(0)
        others = max(distinct - len(self.hashes), 0) + 1
        self.outside = math.log10((total - inside + 0.5) / (total + 0.5) / others)
        self.levels: list[Level] = []
        code, self.book = quantised(np.log10(self.probabilities)) if total else quantised(np.zeros(0))
        self.code = code
        # while the trie is made: the last level's counts and keys
        self._node_counts = self.counts.astype(float)
        self._keys: list[np.ndarray] = []

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 outside the trie."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[place] == hashes, place, -1)

    def add_level(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """``keys`` are parent * vocabulary + word, ascending; ``counts`` theirs in training."""
        v, parents = max(len(self.hashes), 1), len(self._node_counts)
        parent, word = keys // v, keys % v
        begins = np.searchsorted(parent, np.arange(parents + 1))
        context = self._node_counts
        kept = np.maximum(counts - DISCOUNT, 0) / context[parent]
        left = np.maximum(1 - np.bincount(parent, kept, parents), 1e-9)
        lower = self._lower(parent, word)
        smoothed = kept + left[parent] * lower
        backoff, backoff_book = quantised(np.log10(left))
        code, book = quantised(np.log10(np.minimum(smoothed, 1.0)))
        self.levels.append(Level(EliasFano.encode(begins, len(keys) + 1), EliasFano.encode(keys, parents * v + 1), code, book, backoff, backoff_book))
        self._keys.append(keys)
        self._node_counts = counts.astype(float)

    def _lower(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of the word after the parent without its first word."""
        if not self.levels:
            return self.probabilities[word]
        return 10.0 ** self._score_after(self._suffix(parent), word)

    def _suffix(self, node: np.ndarray) -> np.ndarray:
        """Last word of two-word nodes: the one context that a third level falls back to."""
        return self._keys[-1][node] % max(len(self.hashes), 1)

    def _score_after(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        level = self.levels[0]
        node = level.find(context, word, len(self.hashes))
        shorter = self.book[self.code[word]] + level.backoff_book[level.backoff[context]]
        return np.where(node >= 0, level.book[level.probability[np.maximum(node, 0)]] if len(level.probability) else 0.0, shorter)

    def finished(self) -> Trie:
        self._node_counts = None
        self._keys = []
        return self

    def nodes(self, ids: np.ndarray, fresh: np.ndarray, length: int) -> np.ndarray:
        """Node of the ``length`` words up to each token, -1 if there is none; ``fresh`` marks texts' first tokens."""
        node = ids
        since = _since(fresh)
        for k in range(2, length + 1):
            level = self.levels[k - 2]
            before = np.r_[-1, node[:-1]]
            ask = np.flatnonzero((before >= 0) & (ids >= 0) & (since >= k - 1))
            node = np.full(len(ids), -1)
            node[ask] = level.find(before[ask], ids[ask], len(self.hashes))
        return node

    def scores(self, ids: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """log10 probability of each token after those before it in its text."""
        inside = ids >= 0  # all others are outside the trie
        score = np.full(len(ids), self.outside)
        score[inside] = self.book[self.code[ids[inside]]]
        since = _since(fresh)
        node = ids
        for k, level in enumerate(self.levels, 2):
            # the context of k - 1 words ends at the token before
            context = np.where(since >= k - 1, np.r_[-1, node[:-1]], -1)
            known = context >= 0
            score[known] += level.backoff_book[level.backoff[context[known]]]
            node = np.full(len(ids), -1)
            ask = np.flatnonzero(known & inside)
            node[ask] = level.find(context[ask], ids[ask], len(self.hashes))
            hit = node >= 0
            score[hit] = level.book[level.probability[node[hit]]]
        return score


def _since(fresh: np.ndarray) -> np.ndarray:
    """Tokens of the same text before each token."""
    at = np.arange(len(fresh))
    return at - np.maximum.accumulate(np.where(fresh, at, 0))


# Shards ---------------------------------------------------------------------------------------------------------


def _place(uri: str):
    """The file system of a folder and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", uri))


def save(part: object, uri: str) -> None:
    """A file of the object's structure and its arrays' bytes; it has its name once it is whole."""
    buffers: list[pickle.PickleBuffer] = []
    head = pickle.dumps(part, protocol=5, buffer_callback=buffers.append)
    raws, places, at = [b.raw() for b in buffers], [], 0
    for raw in raws:
        places.append((at, raw.nbytes))
        at += raw.nbytes + -raw.nbytes % 16
    lead = pickle.dumps((head, places))
    files, path = _place(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(len(lead).to_bytes(16, "little") + lead + bytes(-len(lead) % 16))
        for raw in raws:
            out.write(raw)
            out.write(bytes(-raw.nbytes % 16))
    files.move(own, path)


_opened: dict[str, object] = {}


def opened(uri: str):
    """The object in a file, its arrays mapped; where the folder is no mounted one, from an unlinked copy."""
    if uri not in _opened:
        if _opened and next(iter(_opened)).rsplit("/", 1)[0] != uri.rsplit("/", 1)[0]:
            _opened.clear()  # another trie's
        from pyarrow import fs

        files, path = _place(uri)
        with open(path, "rb") if isinstance(files, fs.LocalFileSystem) else tempfile.TemporaryFile() as f:
            if not isinstance(files, fs.LocalFileSystem):
                with files.open_input_stream(path) as source:
                    shutil.copyfileobj(source, f)
                f.flush()
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        size = int.from_bytes(view[:16], "little")
        head, places = pickle.loads(view[16 : 16 + size])
        body = view[16 + size + -size % 16 :]
        _opened[uri] = pickle.loads(head, buffers=[body[at : at + n] for at, n in places])
    return _opened[uri]


@dataclass
class Cut:
    """Where a level's shards lie: their files, first hashes or parents, and numbers of their first nodes and the end."""

    files: list[str]
    firsts: np.ndarray
    begins: np.ndarray

    def runs(self, ascending: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Shards and the stretches of ascending questions that are theirs, ``of`` being what begins each shard."""
        edges = [0, *np.searchsorted(ascending, of[1 : len(self.files)]).tolist(), len(ascending)]
        return ((k, edges[k], edges[k + 1]) for k in range(len(self.files)) if edges[k] < edges[k + 1])


@dataclass
class Words:
    hashes: np.ndarray
    counts: np.ndarray


@dataclass
class Nodes:
    """One shard of a level: nodes whose parents are ``first`` to ``last``, with counts where a level follows."""

    first: int
    last: int
    level: Level
    counts: np.ndarray


class Shards:
    """The trie: words by hash, and the levels above, in mapped shards."""

    def __init__(self, folder: str, total: int, distinct: int):
        if distinct >= 1 << 31:
            raise ValueError("word numbers have 31 bits")
        self.folder, self.total, self.distinct = folder, total, distinct
        self.words, self.levels = Cut([], np.zeros(0, np.int64), np.zeros(1, np.int64)), []

    def _each(self, questions: np.ndarray, cut: Cut, of: np.ndarray, answer: Callable, *blank: np.ndarray) -> list[np.ndarray]:
        """Answers to each question once, shard by shard; ``blank`` where a shard has none."""
        asked, back = np.unique(questions, return_inverse=True)
        out = [np.full(len(asked), b) for b in blank]
        for k, low, high in cut.runs(asked, of):
            for o, a in zip(out, answer(opened(cut.files[k]), asked[low:high], int(cut.begins[k])), strict=True):
                o[low:high] = a
        return [o[back] for o in out]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers, -1 for words that training never saw, and log10 of the words' counts and one."""

        def answer(part: Words, asked: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
            place = np.minimum(np.searchsorted(part.hashes, asked), len(part.hashes) - 1)
            hit = part.hashes[place] == asked
            return np.where(hit, begin + place, -1), np.where(hit, np.log10(part.counts[place] + 1), 0.0)

        return tuple(self._each(hashes, self.words, self.words.firsts, answer, np.int64(-1), 0.0))

    def counts(self, nodes: np.ndarray, length: int = 1) -> np.ndarray:
        """Counts of nodes of ``length`` words."""
        cut = self.words if length == 1 else self.levels[length - 2]
        if len(cut.files) == 1:  # nothing to deal
            return opened(cut.files[0]).counts[nodes].astype(np.int64)
        return self._each(nodes, cut, cut.begins, lambda part, asked, begin: (part.counts[asked - begin],), np.int64(0))[0]

    def after(self, length: int, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words after their context's node: their own node (-1 for none), their share, and what the context leaves."""
        v, cut = self.distinct, self.levels[length - 2]

        def answer(part: Nodes, asked: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            node, share, left = np.full(len(asked), -1), np.zeros(len(asked)), np.ones(len(asked))
            parents = asked // v
            inside = np.flatnonzero((parents >= part.first) & (parents <= part.last))
            place, hit = part.level.words.successor((asked[inside] - part.first * v).astype(np.uint64))
            left[inside] = (10.0**part.level.backoff_book)[part.level.backoff[parents[inside] - part.first]]
            node[inside[hit]] = begin + place[hit]
            share[inside[hit]] = (10.0**part.level.book)[part.level.probability[place[hit]]]
            return node, share, left

        node, share, left = self._each(parent * v + np.maximum(word, 0), cut, cut.firsts * v, answer, np.int64(-1), 0.0, 1.0)
        return np.where(word < 0, -1, node), np.where(word < 0, 0.0, share), left

    def nodes(self, ids: np.ndarray, fresh: np.ndarray, length: int) -> np.ndarray:
        """Node of the ``length`` words up to each token, -1 if there is none; ``fresh`` marks texts' first tokens."""
        node, since = ids, _since(fresh)
        for k in range(2, length + 1):
            before = np.r_[-1, node[:-1]]
            ask = np.flatnonzero((before >= 0) & (ids >= 0) & (since >= k - 1))
            node = np.full(len(ids), -1)
            node[ask] = self.after(k, before[ask], ids[ask])[0]
        return node

    def scores(self, ids: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """log10 probability of each token after those before it in its text."""
        # half a token for words that training never saw
        probability = np.full(len(ids), 0.5 / (self.total + 0.5))
        inside = np.flatnonzero(ids >= 0)
        probability[inside] = self.counts(ids[inside]) / (self.total + 0.5)
        node, since = ids, _since(fresh)
        for k in range(2, len(self.levels) + 2):
            before = np.r_[-1, node[:-1]]
            known = np.flatnonzero((before >= 0) & (since >= k - 1))
            node = np.full(len(ids), -1)
            node[known], share, left = self.after(k, before[known], ids[known])
            probability[known] = share + left * probability[known]
        return np.log10(probability)

    def _kept(self, ranges: DataFrame, name: str, make: Callable) -> Cut:
        """Shards of sorted ranges of ``key, n``, and where they lie: one row a shard reaches the driver."""
        folder = self.folder

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                keys, counts = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "n"))
                first, part = make(keys, counts)
                file = f"{folder}/{name}-{first}"
                save(part, file)
                yield pa.RecordBatch.from_pylist([{"first": first, "n": len(keys), "file": file}])

        rows = sorted((r["first"], r["n"], r["file"]) for r in ranges.sortWithinPartitions("key").select("key", "n").mapInArrow(task, "first long, n long, file string").collect())
        first, n, files = zip(*rows, strict=True) if rows else ((), (), ())
        return Cut(list(files), np.array(first, np.int64), np.cumsum([0, *n]))

    def add_words(self, counts: DataFrame, shard: int) -> None:
        """``counts``: key (hash) and n of every word."""
        ranges = counts.repartitionByRange(-(-self.distinct // shard) or 1, "key")
        self.words = self._kept(ranges, "words", lambda keys, n: (int(keys[0]), Words(keys, n)))

    def add_level(self, grams: DataFrame, shard: int, last: bool) -> None:
        """``grams``: key (parent * vocabulary + word) and n of every kept n-gram, written."""
        v, length, n_nodes = max(self.distinct, 1), len(self.levels) + 2, grams.count()
        known, grown = self, (self.levels[-1] if self.levels else self.words).begins[-1]
        if int(grown) * v >= 1 << 62:
            raise ValueError("keys of parents and words have 62 bits")

        def make(keys: np.ndarray, counts: np.ndarray) -> tuple[int, Nodes]:
            parent = keys // v
            first, final = int(parent[0]), int(parent[-1])
            own = known.counts(parent, length - 1)
            kept = np.maximum(counts - DISCOUNT, 0) / own
            size = final - first + 1
            left = np.maximum(1 - np.bincount(parent - first, kept, size), 1e-9)
            code, book = quantised(np.log10(kept))
            backoff, backoff_book = quantised(np.log10(left))
            begins = np.searchsorted(parent, np.arange(first, final + 2))
            words = EliasFano.encode(keys - first * v, size * v + 1)
            words._zeros = words._zeros_before()  # into the file
            level = Level(EliasFano.encode(begins, len(keys) + 1), words, code, book, backoff, backoff_book)
            small = counts[:0] if last else counts.astype(np.min_scalar_type(int(counts.max())))
            return first, Nodes(first, final, level, small)

        # parents stay whole
        ranges = grams.withColumn("parent", F.expr(f"key div {v}")).repartitionByRange(-(-n_nodes // shard) or 1, "parent")
        self.levels.append(self._kept(ranges, f"level{length}", make))


# Counting and scoring --------------------------------------------------------------------------------------------


def _joined(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts' tokens one after the other, and which are texts' first."""
    fresh = np.zeros(sum(map(len, held)), bool)
    fresh[np.cumsum([0, *map(len, held[:-1])])] = True
    return np.concatenate(held), fresh


def _portions(held: Iterator[np.ndarray], limit: int) -> Iterator[list[np.ndarray]]:
    """Texts in lists of about ``limit`` tokens."""
    portion, size = [], 0
    for one in held:
        portion.append(one)
        size += len(one)
        if size >= limit:
            yield portion
            portion, size = [], 0
    if portion:
        yield portion


def _counted(keys: np.ndarray) -> pa.RecordBatch:
    values, counts = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])


def _summed(counted: DataFrame) -> DataFrame:
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


def count_words(texts: DataFrame) -> DataFrame:
    """``key, n``: every word's hash and count."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _portions((tokens(t) for b in batches for t in b.column("text").to_pylist()), COUNTED):
            yield _counted(np.concatenate(held))

    return _summed(texts.mapInArrow(task, "key long, n long"))


NUMBERED = "doc_id long, held_out boolean, learned boolean, n_tokens long, n_known long, logs double, ids binary"


def number_texts(documents: DataFrame, trie: Shards, folds: int = FOLDS, held_out: int = HELD_OUT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its word numbers (-1 for words that training never saw) and what words add to the base score."""

    def rows(part: pa.RecordBatch, held: list[np.ndarray]) -> pa.RecordBatch:
        hashes, fresh = _joined(held)
        # a portion's words are looked up at once, each once
        ids, logs = trie.ids(hashes)
        of, inside = np.cumsum(fresh) - 1, ids >= 0
        logs = np.bincount(of, logs, len(held))
        known = np.bincount(of[inside], minlength=len(held))
        small = [h.tobytes() for h in np.split(ids.astype("<i4"), np.flatnonzero(fresh)[1:])]
        own = [part.column(k) for k in ("doc_id", "held_out", "learned")]
        columns = [*own, pa.array([len(h) for h in held], pa.int64()), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(small, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in NUMBERED.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for held in _portions(map(tokens, batch.column("text").to_pylist()), SCORED):
                yield rows(batch.slice(first, len(held)), held)
                first += len(held)

    remainder = fold(F.col(doc_id), folds)
    source = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(remainder == held_out, F.lit(False)).alias("held_out"),
        F.coalesce(remainder != held_out, F.lit(False)).alias("learned"),
        F.col(text).alias("text"),
    )
    return source.mapInArrow(task, NUMBERED)


def _numbers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(b, "<i4").astype(np.int64) for b in batch.column("ids").to_pylist())


def count_level(numbered: DataFrame, trie: Shards, length: int, least: int = LEAST_COUNT) -> DataFrame:
    """``key, n`` of the n-grams of ``length`` words with a count of ``least``, whose shorter parts have it too."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _portions((ids for b in batches for ids in _numbers(b)), COUNTED):
            ids, fresh = _joined(held)
            node = trie.nodes(ids, fresh, length - 1)
            keep = np.r_[False, (node[:-1] >= 0) & (ids[1:] >= 0) & ~fresh[1:]]
            if length > 2:
                keep &= node >= 0  # the last words' own n-gram
            at = np.flatnonzero(keep)
            yield _counted(node[at - 1] * trie.distinct + ids[at])

    return _summed(numbered.select("ids").mapInArrow(task, "key long, n long")).where(F.col("n") >= least)


def train(documents: DataFrame, order: int = ORDER, folds: int = FOLDS, held_out: int = HELD_OUT, doc_id: str = "doc_id", text: str = "text", shard: int = SHARD) -> tuple[Shards, DataFrame]:
    """The trie and the written numbers of all rows' words."""
    if order not in (1, 2, 3):
        raise ValueError("orders are 1 to 3")
    learned = F.coalesce(fold(F.col(doc_id), folds) != held_out, F.lit(False))
    counts = written(count_words(documents.where(learned).select(F.col(text).alias("text"))), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    trie = Shards(f"{shared_dir(documents.sparkSession)}/lattica/lm-trie-{uuid.uuid4().hex}", total, distinct)
    trie.add_words(counts, shard)
    drop_written(counts)
    numbered = written(number_texts(documents, trie, folds, held_out, doc_id, text), "lm-numbers")
    for length in range(2, order + 1):
        grams = written(count_level(numbered.where("learned"), trie, length), "lm-grams")
        trie.add_level(grams, shard, length == order)
        drop_written(grams)
    return trie, numbered


def score_numbered(numbered: DataFrame, trie: Shards) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of a written ``number_texts``."""
    own = ["doc_id", "held_out", "n_tokens", "n_known", "logs"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for held in _portions(_numbers(batch), SCORED):
                ids, fresh = _joined(held)
                score = np.bincount(np.cumsum(fresh) - 1, trie.scores(ids, fresh), len(held))
                part = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(score)], names=[*own, "score"])
                first += len(held)

    base = math.log10(trie.total + trie.distinct + 1)
    scored = numbered.select(*own, "ids").mapInArrow(task, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trie.total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * base).alias("base_score"), "score")


def score_documents(documents: DataFrame, order: int = ORDER, **options) -> DataFrame:
    """Learns from the training part of ``documents`` and scores all of them."""
    trie, numbered = train(documents, order, **options)
    return score_numbered(numbered, trie)


def score_texts(documents: DataFrame, trie: Shards, **options) -> DataFrame:
    """Scores other documents with a trained trie."""
    return score_numbered(written(number_texts(documents, trie, **options), "lm-numbers"), trie)
