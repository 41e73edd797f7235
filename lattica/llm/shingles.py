"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly and without missing a link.

A document's set holds the 64-bit hashes of its distinct runs of ``SHINGLE`` words. Two sets link where
``100 * |x & y| >= percent * |x | y|``. The join goes by tiles:

* The elements of a sorted set, with a mark before and behind, make pairs of neighbours. An element that only one of
  two sets has breaks two pairs of its own set and one of the other, so linked sets have all but ``lost`` of their
  pairs in common, whatever their sizes. By the order of the pairs' names, linked sets then share at least L of their
  first ``lost + L`` pairs. Sizes are cut into bands, and a tile is a band and such a pair; a set enters its own
  band's tiles and, where larger partners reach it, the next band's. Two shingles name a tile, so passages that many
  documents share seldom gather their documents.
* Within a stretch of rows and then over all, each member of a tile is paired with a smallest one, so that a large
  group sends one member a stretch through the exchange. Pairs are bounded by their hashed bitmap signatures:
  differing bits are at most differing elements, so bit counts bound the overlap from above. What survives is decided
  by exact intersection of sorted arrays.
* Linked sets are joined to components. Tiles whose members all lie in one component are done. In the others, pairs
  of members from different components go through the same bound and the same exact intersection, so that no link
  between components is missed, while a large group of near copies costs its number of members, not of pairs.
* Tiles with over ``POPULAR`` members besides their largest component are not compared that way: linked sets share L
  tiles, so a pair is met elsewhere unless both of its sets have L popular tiles. Such sets are compared by single
  shingles: the rarest of them that linked sets cannot all differ in, by exact counts over these sets. Before that,
  the members of each such tile meet its hub, the one whose shingles most others have: near copies differ less from
  the least changed of them than from one another, so what links there joins most of a group to one component, at
  the cost of its number of members. Which set is the hub decides nothing; all pairs across components follow.

Equal sets are joined to their smallest document first, and that one alone enters tiles.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing; with fewer words
than a shingle has, the whole sequence is the one shingle; a repeated row is a copy; a row without an id gets a null
component; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.components import connected_components
from lattica.runtime import drop_written, tidied, written

SHINGLE, PERCENT = 4, 85
#: Ratio of a band's largest to its smallest set.
BAND = 2.0
#: Percent from which pairs of neighbours name tiles; below, linked sets may have none in common, and single elements do.
PAIRS_FROM = 60
#: Tiles that linked sets share at least: one, and one more for each so many elements.
SPARE = 32
#: Members besides the largest component's from which a tile counts as popular.
POPULAR = 64
#: Tile entries that are paired at once before the exchange.
STRETCH = 1 << 19
#: Rows of a batch of plain numbers that a task puts out.
OUT_ROWS = 1 << 14
#: 64-bit words of a bitmap signature.
WORDS = 32
#: Documents whose ids are broadcast to pick their texts; more than these go by exchange.
BROADCAST_IDS = 1 << 21
#: Shingles that are broadcast with their counts; more than these go by exchange.
BROADCAST_SHINGLES = 1 << 20
#: Rarest shingles that a set's rows carry, so that a pair is met once; rows of larger sets would grow with the square.
LISTED = 256
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 18

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# Arrays of one, since numpy warns where products of plain numbers wrap around.
_ODD = [np.array([x], np.uint64) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts, with remembered word hashes."""

    def __init__(self, size: int):
        import xxhash

        self.size, self._hash = size, xxhash.xxh3_64_intdigest
        self._known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        h = self._known[word] = self._hash(word)
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z, and ASCII white space without \x1c-\x1f
        if not words:
            return np.zeros(0, np.uint64)
        get, make = self._known.get, self._word
        h = np.fromiter((get(w) or make(w) for w in words), np.uint64, len(words))
        n = len(h)
        if n < self.size:
            total = np.array([n], np.uint64)
            for k in range(n):  # the order counts
                total = mixed((total + h[k : k + 1]) * _ODD[4])
            return total
        total = np.zeros(n - self.size + 1, np.uint64)
        for k in range(self.size):
            total = mixed(total * _ODD[0] + h[k : n - self.size + 1 + k] * _ODD[1])
        return np.unique(total)


def set_key(a: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(a.tobytes())


@lru_cache(1 << 14)
def lost(n: int, percent: int, larger: bool) -> int:
    """How many of its names a set of n elements may not share with a linked one (``larger``: of n elements or more)."""
    own = np.arange(n + 1)  # elements that the other set lacks
    others = (n - own) * (100 - percent) // percent - own  # at most so many that only the other has
    fits = others >= (own if larger else 0)
    broken = 2 * own + others if percent >= PAIRS_FROM else own
    return int(broken[fits].max(initial=0))


def shared(n: int) -> int:
    """Tiles that a set of n elements has in common with a linked one, at least."""
    return 1 + n // SPARE


def band_of(n: int) -> int:
    return int(np.log(n) / np.log(BAND) + 1e-9)


def bands_of(n: int, percent: int) -> list[int]:
    """A set's own band and those in which larger partners may be."""
    return list(range(band_of(n), band_of(max(n, 100 * n // percent)) + 1))


def tile_names(a: np.ndarray, percent: int) -> np.ndarray:
    """The tiles that a set enters, as 64-bit names."""
    n = len(a)
    if 100 * n < percent * (n + 1):  # only an equal set is alike enough
        return np.zeros(0, np.uint64)
    names = mixed(a * _ODD[0])
    if percent >= PAIRS_FROM:
        names = mixed(np.concatenate(([np.uint64(1)], names)) + np.concatenate((a, [np.uint64(2)])))
    out = []
    for k, band in enumerate(bands_of(n, percent)):
        most = min(len(names), lost(n, percent, k > 0) + shared(n))
        out.append(mixed(np.partition(names, most - 1)[:most] + np.array([band + 1], np.uint64) * _ODD[3]))
    return np.concatenate(out)


def bitmap(a: np.ndarray) -> np.ndarray:
    bits = np.zeros(WORDS, np.uint64)
    place = mixed(a + _ODD[3])
    np.bitwise_or.at(bits, (place >> np.uint64(6)) % np.uint64(WORDS), np.uint64(1) << (place & np.uint64(63)))
    return bits


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact: both arrays are sorted and distinct."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _source(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


BITS = [f"b{k}" for k in range(WORDS)]


def shingle_sets(documents: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """``doc_id, task, n, key, met, b0.., tiles``: a set that the task has met before has that document's id, no bitmap and no tiles."""
    names = ["doc_id", "task", "n", "key", "met", *BITS, "tiles"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(size), {}
        number = TaskContext.get().partitionId()
        for batch in batches:
            n, keys, tiles, met, bits = [], [], [], [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a = shingler.shingles(t.as_py())
                n.append(len(a))
                key = set_key(a) if len(a) and doc is not None else None
                keys.append(key)
                first = seen.get(key)
                met.append(first)
                new = key is not None and first is None
                tiles.append(_signed(tile_names(a, percent)) if new else None)
                bits.append(bitmap(a) if new else np.zeros(WORDS, np.uint64))
                if new:
                    seen[key] = doc
            columns = np.array(bits, np.uint64).reshape(len(n), WORDS).T
            own = [batch.column(0), pa.array([number] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(met, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(_signed(np.ascontiguousarray(c))) for c in columns), pa.array(tiles, pa.list_(pa.int64()))], names=names)

    bits = ", ".join(f"{b} long" for b in BITS)
    return _source(documents, doc_id, text).mapInArrow(tidied(task), f"doc_id long, task int, n long, key binary, met long, {bits}, tiles array<long>")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows ``doc_id, tiles``, a stretch of entries at a time: tiles, documents by tile, and whether a tile begins there."""

    def ordered(docs: list, tiles: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tile = np.concatenate(tiles)
        doc = np.repeat(np.array(docs, np.int64), [len(t) for t in tiles])
        order = np.lexsort((doc, tile))
        tile, doc = tile[order], doc[order]
        return tile, doc, np.r_[True, tile[1:] != tile[:-1]]

    docs, tiles, held = [], [], 0
    for batch in batches:
        for doc, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            docs.append(doc)
            tiles.append(own.values.to_numpy())
            held += len(tiles[-1])
            if held >= STRETCH:
                yield ordered(docs, tiles)
                docs, tiles, held = [], [], 0
    if held:
        yield ordered(docs, tiles)


def _by_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tile, doc, center``: of each stretch, a tile's smallest document without a center, the others with it."""
    for tile, doc, start in _stretches(batches):
        center = doc[start][np.cumsum(start) - 1]
        for at in range(0, len(tile), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(tile[part]), pa.array(doc[part]), pa.array(center[part], mask=start[part])], names=["tile", "doc", "center"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by tile and document: those of tiles with several documents, with the smallest one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    open_tile = open_center = None  # the tile that the last batch ended in, and its smallest document
    pending = False  # whether that tile has had one row only, which is not out yet

    for batch in batches:
        tile, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(tile):
            continue
        start = np.r_[True, tile[1:] != tile[:-1]]
        joins = open_tile is not None and tile[0] == open_tile
        first = np.flatnonzero(start)
        center = doc[first][np.cumsum(start) - 1]
        count = np.diff(np.r_[first, len(tile)])
        several = np.repeat(count > 1, count)
        if joins:
            center[: count[0]] = open_center
            several[: count[0]] = True
            if pending:
                held.append((np.array([open_tile]), np.array([open_center])))
        last_alone = count[-1] == 1 and not (joins and len(count) == 1)
        for t, d in held:
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(d), pa.array(d)], names=["tile", "doc", "center"])
        held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(tile[several]), pa.array(doc[several]), pa.array(center[several])], names=["tile", "doc", "center"])
        open_tile, open_center, pending = tile[-1], center[-1], bool(last_alone)


def _arrays(documents: DataFrame, wanted: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """``doc, a``: sorted arrays of the wanted documents, whose distinct ids ``wanted`` has as ``doc``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            arrays = [shingler.shingles(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(arrays, pa.binary())], names=["doc", "a"])

    return _chosen(documents, wanted, doc_id, text).mapInArrow(tidied(task), "doc long, a binary")


def _chosen(documents: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, text`` of the documents whose ids ``wanted`` has as ``doc``."""
    return _source(documents, doc_id, text).join(_small(wanted.select(F.col("doc").alias("doc_id"))), "doc_id", "left_semi")


def _small(ids: DataFrame) -> DataFrame:
    """Ids to be broadcast if they are counted to be few; else they go by exchange."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _bounded(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Of ``x, y``: the pairs that sizes and bitmap bits let link."""

    def side(name: str) -> DataFrame:
        return signatures.select(F.col("doc").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("n", *BITS)))

    both = pairs.join(side("x"), "x").join(side("y"), "y")
    return both.where(_may_link("x", "y", percent)).select("x", "y")


def _may_link(x: str, y: str, percent: int) -> Column:
    apart = sum((F.bit_count(F.col(f"{x}_{b}").bitwiseXOR(F.col(f"{y}_{b}"))) for b in BITS), F.lit(0))
    n_x, n_y = F.col(f"{x}_n"), F.col(f"{y}_n")
    total = n_x + n_y
    # apart bits are apart elements at least: overlap <= (total - apart) / 2
    return (100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)) & ((100 + percent) * (total - apart) >= 2 * percent * total)


def _linked(pairs: DataFrame, documents: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The written ``a, b`` of the pairs ``x, y`` that link, by exact intersection; ``pairs`` is written."""
    wanted = pairs.select(F.col("x").alias("doc")).unionByName(pairs.select(F.col("y").alias("doc"))).distinct()
    arrays = written(_arrays(documents, wanted, size, doc_id, text), "shingle-arrays")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # long arrays stay where they came in
            view = lambda scalar: np.frombuffer(scalar.as_buffer(), np.uint64)
            keep = [links(view(a), view(b), percent) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])

    both = pairs.join(arrays.select(F.col("doc").alias("x"), F.col("a").alias("ax")), "x").join(arrays.select(F.col("doc").alias("y"), F.col("a").alias("ay")), "y")
    found = written(both.select("x", "y", "ax", "ay").mapInArrow(tidied(task), "a long, b long"), "links")
    drop_written(arrays)
    return found


def _across(members: DataFrame, tile: str, signatures: DataFrame, percent: int) -> DataFrame:
    """Distinct ``x, y`` of a tile's members in different components that sizes and bitmap bits let link.

    Members may have ``tiles``, all that they enter of their first elements in one order for all. Then a pair is met in
    the first tile that both enter, and in no other. What two sets have in common lies among both's first elements or
    behind those of the one whose end sooner, so the number of tiles that they share bounds their overlap as well.
    """
    signed = members.join(signatures, "doc")
    more = ["tiles"] if "tiles" in members.columns else []
    x, y = (signed.select(tile, *(F.col(c).alias(f"{name}_{c}") for c in ("doc", "component", "n", *BITS, *more))) for name in "xy")
    wanted = (F.col("x_component") < F.col("y_component")) & _may_link("x", "y", percent)
    if more:
        behind = ", ".join(f"({percent} * {name}_n + 99) div 100 - 1" for name in "xy")
        first = f"element_at(array_intersect(x_tiles, y_tiles), 1) = {tile}"
        enough = f"{100 + percent} * (size(array_intersect(x_tiles, y_tiles)) + greatest({behind})) >= {percent} * (x_n + y_n)"
        wanted = wanted & F.expr(f"x_tiles IS NULL OR y_tiles IS NULL OR ({first} AND {enough})")
    return x.join(y, tile).where(wanted).select(F.col("x_doc").alias("x"), F.col("y_doc").alias("y")).distinct()


def _prefix(n: int, percent: int) -> int:
    """Of a set's elements in any one order, how many first ones hold one of each linked set's as many first ones."""
    return n - -(-percent * n // 100) + 1


def _counted(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``shingle, times`` of rows ``text``: how many rows of a stretch have it, so that alike rows of a task put out little."""
    shingler, held, entries = Shingler(size), [], 0

    def tally() -> Iterator[pa.RecordBatch]:
        own, times = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(own), OUT_ROWS):
            part = slice(at, at + OUT_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(own[part]), pa.array(times[part])], names=["shingle", "times"])

    for batch in batches:
        for t in batch.column(0):
            held.append(_signed(shingler.shingles(t.as_py())))
            entries += len(held[-1])
            if entries >= STRETCH:
                yield from tally()
                held, entries = [], 0
    if held:
        yield from tally()


def _by_rarest(documents: DataFrame, unsafe: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """The written ``shingle, doc, common, tiles`` of the sets' rarest shingles: as many as linked sets cannot all differ in.

    Shingles are counted over these sets' rows; a repeated row counts again, as any one order for all sets will do. Those
    that several have are broadcast if they are counted to be few; else
    they meet the sets by exchange. ``common`` is the mean logarithm of the counts of a set's shingles.
    """
    chosen = _chosen(documents, unsafe, doc_id, text)

    counts = chosen.select("text").mapInArrow(tidied(partial(_counted, size)), "shingle long, times long")
    counts = written(counts.groupBy("shingle").agg(F.sum("times").alias("times")).where("times > 1"), "popular-counts")
    if counts.count() <= BROADCAST_SHINGLES:
        known = counts.toArrow()  # of at most BROADCAST_SHINGLES rows
        order = np.argsort(known["shingle"].to_numpy())
        shared_counts = documents.sparkSession.sparkContext.broadcast((known["shingle"].to_numpy()[order], known["times"].to_numpy()[order]))

        def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler, (popular, times) = Shingler(size), shared_counts.value
            for batch in batches:
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    a = _signed(shingler.shingles(t.as_py()))
                    place = np.minimum(np.searchsorted(popular, a), max(len(popular) - 1, 0))
                    common = popular[place] == a if len(popular) else np.zeros(len(a), bool)
                    # the shingles of one set alone come before all others and make no tile
                    left = _prefix(len(a), percent) - (len(a) - int(common.sum()))
                    if left > 0:
                        own = a[common]
                        own = own[np.lexsort((own, times[place[common]]))][:left]
                        tiles = pa.array([own if len(own) <= LISTED else None] * len(own), pa.list_(pa.int64()))
                        often = np.full(len(own), np.log(times[place[common]]).sum() / len(a))
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), doc)), pa.array(often), tiles], names=["shingle", "doc", "common", "tiles"])

        first = chosen.mapInArrow(tidied(rarest), "shingle long, doc long, common double, tiles array<long>").dropDuplicates(["shingle", "doc"])
    else:

        def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shingler = Shingler(size)
            for batch in batches:
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    a = _signed(shingler.shingles(t.as_py()))
                    for at in range(0, len(a), OUT_ROWS):
                        part = a[at : at + OUT_ROWS]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), doc)), pa.array(np.full(len(part), len(a))), pa.array(part)], names=["doc", "n", "shingle"])

        rows = chosen.mapInArrow(tidied(every), "doc long, n long, shingle long")
        whole = Window.partitionBy("doc")
        ranked = rows.distinct().join(counts, "shingle").select(
            "doc", "n", "shingle", F.row_number().over(whole.orderBy("times", "shingle")).alias("rank"), F.count(F.lit(1)).over(whole).alias("known"), F.sum(F.log("times")).over(whole).alias("logs")
        )
        most = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("long") + 1
        first = ranked.where(F.col("rank") <= most - (F.col("n") - F.col("known"))).select("shingle", "doc", (F.col("logs") / F.col("n")).alias("common"))
    first = written(first, "rarest-shingles")
    drop_written(counts)
    return first


def _to_hubs(first: DataFrame, unsafe: DataFrame) -> DataFrame:
    """Distinct ``x, y`` of the sets ``doc, component`` and the hubs of their tiles, where those lie in other components."""
    members = first.select("shingle", "doc", "common").join(unsafe, "doc")
    hubs = members.groupBy("shingle").agg(F.max(F.struct("common", "doc", "component")).alias("hub"))
    met = members.join(hubs, "shingle").where("component <> hub.component")
    return met.select(F.least("doc", "hub.doc").alias("x"), F.greatest("doc", "hub.doc").alias("y")).distinct()




def join_shingles(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: ``doc_id, n_shingles, component_id`` (smallest document that links reach)."""
    dealt = written(shingle_sets(documents, size, percent, doc_id, text), "shingle-sets")
    counts = written(dealt.select("doc_id", "n"), "shingle-counts")
    # copies within a task are known there; what is left of a set is one document per task
    firsts = dealt.where("key IS NOT NULL AND met IS NULL").select("key", F.struct("doc_id", "task").alias("place"))
    smallest = firsts.groupBy("key").agg(F.min("place").alias("rep"), F.count(F.lit(1)).alias("times")).where("times > 1")
    again = written(firsts.join(smallest, "key").where("place <> rep").select("place.doc_id", "place.task", F.col("rep.doc_id").alias("rep")), "copies")
    copies = dealt.where("met IS NOT NULL").select(F.col("doc_id").alias("a"), F.col("met").alias("b")).unionByName(
        again.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    )
    copies = written(copies, "copy-links")
    entered = dealt.where("tiles IS NOT NULL").join(_small(again.select("doc_id", "task")), ["doc_id", "task"], "left_anti")
    signatures = written(entered.select(F.col("doc_id").alias("doc"), "n", *BITS), "signatures")
    entered = entered.select("doc_id", "tiles")
    entries = written(entered.mapInArrow(tidied(_by_stretch), "tile long, doc long, center long"), "tile-entries")
    drop_written(dealt, again)
    smallest_of = entries.where("center IS NULL").select("tile", "doc").repartition("tile").sortWithinPartitions("tile", "doc")
    stars = smallest_of.mapInArrow(tidied(_met), "tile long, doc long, center long").unionByName(entries.where("center IS NOT NULL"))
    tiles = written(stars.where("doc <> center"), "tiles")
    drop_written(entries)

    bounded = written(_bounded(tiles.select(F.col("doc").alias("x"), F.col("center").alias("y")).distinct(), signatures, percent), "star-pairs")
    starred = _linked(bounded, documents, size, percent, doc_id, text)
    found = written(starred.unionByName(copies), "links")
    components = written(connected_components(found), "components")
    drop_written(bounded, starred, copies)

    # a tile of two is decided; in larger ones, how many members lie in how many components
    larger = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("others"), F.min("center").alias("doc")).where("others > 1").select("tile", "doc")
    larger = written(larger, "larger-tiles")
    members = larger.unionByName(tiles.join(larger.select("tile"), "tile", "left_semi").select("tile", "doc"))
    placed = members.join(components.withColumnRenamed("id", "doc"), "doc", "left").select("tile", "doc", F.coalesce("component", "doc").alias("component"))
    placed = written(placed, "placed")
    drop_written(larger, tiles)
    membership = (F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("doc")).alias("mark"), F.sum(F.col("doc") % 1_000_003).alias("rest"))
    by_component = placed.groupBy("tile", "component").agg(*membership)
    sums = (F.sum("size").alias("size"), F.max("size").alias("main"), F.bit_xor("mark").alias("mark"), F.sum("rest").alias("rest"))
    torn = written(by_component.groupBy("tile").agg(*sums).where("main < size"), "torn-tiles")
    popular = torn.where(F.col("size") - F.col("main") > POPULAR).select("tile")
    # one tile of each membership
    quiet = torn.where(F.col("size") - F.col("main") <= POPULAR).groupBy("size", "mark", "rest").agg(F.min("tile").alias("tile")).select("tile")
    pairs = written(_across(placed.join(quiet, "tile"), "tile", signatures, percent), "cross-pairs")
    often = placed.join(popular, "tile").groupBy("doc", "component").agg(F.count(F.lit(1)).alias("popular"))
    unsafe = often.join(signatures.select("doc", "n"), "doc").where(F.col("popular") >= 1 + F.floor(F.col("n") / SPARE)).select("doc", "component")
    unsafe = written(unsafe, "unsafe-sets")
    drop_written(placed, torn)
    if unsafe.head(1):
        first = _by_rarest(documents, unsafe, size, percent, doc_id, text)
        near = written(_bounded(_to_hubs(first, unsafe), signatures, percent), "hub-pairs")
        merged = _linked(near, documents, size, percent, doc_id, text)
        if merged.head(1):
            both = written(found.unionByName(merged), "links")
            drop_written(found, components)
            found, components = both, written(connected_components(both), "components")
            placed = unsafe.select("doc").join(components.withColumnRenamed("id", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("component"))
            placed = written(placed, "unsafe-sets")
            drop_written(unsafe)
            unsafe = placed
        more = written(_across(first.join(unsafe, "doc"), "shingle", signatures, percent), "popular-pairs")
        drop_written(first, near, merged)
        both = written(pairs.unionByName(more).distinct(), "pairs")
        drop_written(pairs, more)
        pairs = both
    across = _linked(pairs, documents, size, percent, doc_id, text)
    if across.head(1):
        components = written(connected_components(found.unionByName(across)), "components")
    drop_written(pairs, unsafe, signatures, found, across)
    known = counts.where("doc_id IS NOT NULL").join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    # rows without an id would all go to one task of the join
    return known.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")).unionByName(
        counts.where("doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    )


def keep_one(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of each component's smallest document, with all columns; rows without an id stay."""
    joined = join_shingles(documents, size, percent, doc_id, text)
    gone = joined.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return documents.join(gone, documents[doc_id] == gone["gone_id"], "left_anti")
