"""Byte-level BPE: encoding by ranks, decoding to bytes.

A text is cut into chunks that overlap. Each chunk is pre-tokenised by itself, in whatever task it lands; where
the boundaries of two neighbours meet in their overlap, both continue alike (the pattern looks one character ahead
and never behind), so the chunks are stitched there, and the pieces between are what the whole text would give.
Where neighbours share no boundary in the overlap (a pre-token longer than it), the pieces are taken from the last
certain boundary on, over as many chunks as it takes, joined. Pieces are encoded by the ranks; decoding looks each id up and
concatenates raw bytes.

Texts stay in their row, where chunks of ``ROW_CHUNK`` code points are stitched. Only those longer than ``CHUNK`` are
exploded into chunks of that size, dealt out by (text, chunk) so that tasks share a long text, and gathered again per
text, as identifiers with their boundaries.

Defined cases: a null text is empty, an empty one has no tokens; strings that look like special tokens are
ordinary text; repeated rows get the same answer; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: The same within a row: a text of one chunk of the above is chunked and stitched where it is.
ROW_CHUNK, ROW_OVERLAP = 1 << 11, 1 << 7
#: Pieces whose identifiers a task remembers.
REMEMBERED = 1 << 19
#: A rank file is broadcast; one over this many bytes is refused.
RANKS_BYTES = 64 << 20


@dataclass(frozen=True)
class Ranks:
    """A tokenizer's pattern and the bytes of its rank file."""

    pattern: str
    data: bytes

    @classmethod
    def read(cls, path: str, pattern: str) -> Ranks:
        with open(path, "rb") as f:
            data = f.read(RANKS_BYTES + 1)
        if len(data) > RANKS_BYTES:
            raise ValueError(f"{path} has over {RANKS_BYTES} bytes")
        return cls(pattern, data)


class Codec:
    """Encodes pieces and decodes identifiers; identifiers travel as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks: Ranks):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.data.splitlines())}
        self.pieces = regex.compile(ranks.pattern).findall
        self.matches = regex.compile(ranks.pattern).finditer
        self._merge = tiktoken.Encoding("ranks", pat_str=ranks.pattern, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        self._bytes: list[bytes] = [b""] * (max(table.values(), default=-1) + 1)
        for token, rank in table.items():
            self._bytes[rank] = token
        self._known: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = np.array(self._merge(piece.encode("utf-8")), "<u4").tobytes()
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        if len(piece) <= 64:
            self._known[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> list[bytes]:
        get, make = self._known.get, self.piece
        return [get(p) or make(p) for p in pieces]

    def decode(self, ids: bytes) -> bytes:
        table = self._bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(2)
def codec(ranks: Ranks) -> Codec:
    """A worker's codec, made once."""
    return Codec(ranks)


def pretokenise(c: Codec, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Ends of a chunk's pieces, how many identifiers come up to each end, and the identifiers."""
    pieces = c.pieces(text)
    coded = c.encode(pieces)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    counts = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4)
    return ends, counts, b"".join(coded)


#: The pattern's longest look ahead of a piece's end: a contraction's letters.
LOOKAHEAD = 3


def encode_text(c: Codec, text: str, chunk: int, overlap: int) -> bytes:
    """A text's identifiers, by overlapping chunks if it is longer than one."""
    if len(text) <= chunk + overlap:
        return b"".join(c.encode(c.pieces(text)))
    return stitch(c, *overlapping(text, chunk, overlap))


def overlapping(text: str, chunk: int, overlap: int) -> tuple[list[int], list[str]]:
    """Places of the chunks of a text, and the chunks."""
    starts = [k * chunk for k in range(max(1, -(-(len(text) - overlap) // chunk)))]
    return starts, [text[s : s + chunk + overlap] for s in starts]


def stitch(c: Codec, starts: list[int], texts: list[str]) -> bytes:
    """Identifiers of the text that overlapping chunks cover; ``starts`` are the chunks' places in it."""
    parts = [pretokenise(c, t) for t in texts]
    return stitch_parts(c, starts, texts, parts)


def _meeting(begin: int, text: str, ends: np.ndarray, certain: int, start: int, following: str, part: tuple[np.ndarray, np.ndarray, bytes]) -> int:
    """The first place where both texts have a boundary for certain, -1 if there is none."""
    stop = begin + len(text)
    sure = ends[: np.searchsorted(ends, len(text) - LOOKAHEAD, side="right")][: max(0, len(ends) - 1)] + begin
    sure = sure[np.searchsorted(sure, max(certain, start)) :]
    theirs = (part[0][:-1] if start + len(following) > stop else part[0]) + start
    if len(sure) and sure[0] == start:
        return start
    place = np.searchsorted(theirs, sure)
    place[place == len(theirs)] = 0
    met = np.flatnonzero(theirs[place] == sure) if len(theirs) else place[:0]
    return int(sure[met[0]]) if len(met) else -1


def stitch_parts(c: Codec, starts: list[int], texts: list[str], parts: list[tuple[np.ndarray, np.ndarray, bytes]]) -> bytes:
    """Where neighbours share no boundary, chunks are gathered until they double what is at hand, and tokenised once
    more together: a run of any length costs time in proportion to it."""
    out = []
    if not texts:
        return b""
    begin, text, (ends, counts, ids) = starts[0], texts[0], parts[0]
    certain = 0  # what lies before this place of the whole text is in out
    gathered, held, stop = [], 0, begin + len(text)  # what follows the text at hand, not tokenised with it yet

    def take(upto: int) -> None:
        """Appends the pieces of the text at hand between the certain place and ``upto``, both boundaries."""
        i, j = np.searchsorted(ends, [certain - begin, upto - begin], side="right")
        low = counts[i - 1] if i else 0
        high = counts[j - 1] if j else 0
        out.append(ids[4 * low : 4 * high])

    for k in range(1, len(texts)):
        start, following, part = starts[k], texts[k], parts[k]
        if not gathered:
            place = _meeting(begin, text, ends, certain, start, following, part)
            if place < 0:
                # no common boundary: go on from the last sure one
                sure = ends[: np.searchsorted(ends, len(text) - LOOKAHEAD, side="right")][: max(0, len(ends) - 1)] + begin
                last = int(sure[-1]) if len(sure) and sure[-1] > certain else certain
                take(last)
                certain, text, begin = last, text[last - begin :], last
        if gathered or place < 0:
            gathered.append(following[max(0, stop - start) :])
            held += len(gathered[-1])
            stop = max(stop, start + len(following))
            if held < len(text) and k < len(texts) - 1:
                continue
            text += "".join(gathered)
            gathered, held = [], 0
            ends, counts, ids = pretokenise(c, text)
            place = _meeting(begin, text, ends, certain, start, following, part)
        if place >= 0:
            take(place)
            certain = place
            begin, text, (ends, counts, ids) = start, following, part
            stop = max(stop, start + len(following))
    take(begin + len(text))
    return b"".join(out)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
IDS_DDL = "doc_id long, n_tokens long, ids binary"


def _rows(c: Codec, doc_ids: list, ids: list[bytes], digests: bool) -> pa.RecordBatch:
    n = pa.array([len(x) // 4 for x in ids], pa.int64())
    docs = pa.array(doc_ids, pa.int64())
    if not digests:
        return pa.RecordBatch.from_arrays([docs, n, pa.array(ids, pa.binary())], schema=IDS_SCHEMA)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return pa.RecordBatch.from_arrays([docs, n, pa.array(map(sha, ids), pa.string()), pa.array([sha(c.decode(x)) for x in ids], pa.string())], schema=SCHEMA)


def encode(documents: DataFrame, ranks: Ranks, doc_id: str = "doc_id", text: str = "text", digests: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP, row_chunk: int = ROW_CHUNK, row_overlap: int = ROW_OVERLAP) -> DataFrame:
    """Per document ``doc_id, n_tokens, ids`` (bytes), or the digests of the identifiers and of what they decode to."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks)  # at most RANKS_BYTES
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.char_length("text")
    ddl, schema = (DDL, SCHEMA) if digests else (IDS_DDL, IDS_SCHEMA)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            ids = [encode_text(c, t, row_chunk, row_overlap) for t in batch.column(1).to_pylist()]
            yield _rows(c, batch.column(0).to_pylist(), ids, digests)

    def by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                ends, counts, ids = pretokenise(c, row["text"])
                row |= {"ends": ends.tobytes(), "counts": counts.tobytes(), "ids": ids}
                yield pa.RecordBatch.from_pylist([row], schema=chunks)

    def joined(table: pa.Table) -> pa.Table:
        c = codec(shared.value)
        table = table.sort_by("k")
        texts, starts = table["text"].to_pylist(), [k * chunk for k in table["k"].to_pylist()]
        columns = (table[name].to_pylist() for name in ("ends", "counts", "ids"))
        parts = [(np.frombuffer(e, np.int64), np.frombuffer(n, np.int64), i) for e, n, i in zip(*columns, strict=True)]
        return pa.Table.from_batches([_rows(c, table["doc_id"].to_pylist()[:1], [stitch_parts(c, starts, texts, parts)], digests)], schema)

    short = source.where(size <= chunk + overlap).mapInArrow(whole, ddl)
    chunks = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("text", pa.string()), ("ends", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
    last = F.greatest(F.ceil((size - overlap) / chunk), F.lit(1)) - 1
    long = (
        source.where(size > chunk + overlap)
        .withColumn("row", F.monotonically_increasing_id())  # before the explosion: one number for all of a text's chunks
        .select("row", "doc_id", "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("k"))
        .select("row", "doc_id", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"))
        .repartition("row", "k")
        .mapInArrow(by_chunk, "row long, doc_id long, k int, text string, ends binary, counts binary, ids binary")
        .groupBy("row")
        .applyInArrow(joined, ddl)
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """Per row of ``doc_id, ids``: ``doc_id, bytes``, the raw bytes of the identifiers one after the other."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            data = [c.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, bytes binary")
