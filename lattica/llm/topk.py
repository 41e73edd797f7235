"""Exact top-k search by inner product over document-range blocks with term maxima.

Components become integers, each a term's weight. Equal vectors become one with the ``k + 1`` smallest ids of its rows,
which is all that a result can hold of them. A tree of cuts, fitted on a bounded sample, puts alike vectors next to each
other; its leaves are the ranges of documents that make blocks, large ones cut further. A block's row is its forward
index; its summary has, per term, the largest and the smallest weight. Blocks are so few that all summaries together
hold ``SUMMARY`` numbers at most, and those are broadcast, whatever the number of vectors.

Queries travel in batches of neighbours. Every query orders the blocks by the sum of its weights times the maxima (the
minima where its weight is negative), which no document of the block exceeds. In rounds that take ever more blocks of
this order, batches ask blocks for what can still enter the first k: an ask is a row of (block, batch), blocks asked by
many are dealt to several tasks, and a block looks at its parts' own maxima before it scores them. A query asks no block
whose bound is under its k-th score; when none is left, its result is exact. Copies of vectors make no work, pairs of
queries and documents are never rows.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
missing components count as zero, so vectors of different lengths meet and an empty one scores 0; components over
2^62 / 64 in size count as that, scores beyond a long as its ends; rows equal in id and vector count once, others of one
id each; ties go to the smaller id; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.runtime import drop_written, written

SCALE = 64
LARGEST = float(1 << 62)
#: Vectors that the cuts are fitted on; they order the work and decide nothing.
SAMPLE = 16_384
#: Documents of a block at least, of one of its parts, and numbers that all blocks' summaries hold at most.
BLOCK_ROWS, PART_ROWS, SUMMARY = 1_024, 64, 1 << 20
#: Queries of a batch, between these; asks that one copy of a block answers.
LEAST_BATCH, MOST_BATCH, ASKS = 16, 512, 16
#: Blocks of its order that a query has asked after each round; the last round takes all.
ROUNDS = (4, 32, 256)
#: Scores that are made at a time.
STEP = 1 << 20
NONE = np.iinfo(np.int64).min


# Vectors and matrices as bytes


def _kind(largest: float) -> str:
    return "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"


def pack_vector(x: np.ndarray) -> bytes:
    """Without zeros at the end, in the smallest width; equal vectors have equal bytes."""
    x = x[: np.flatnonzero(x)[-1] + 1] if x.any() else x[:0]
    kind = _kind(np.abs(x).max(initial=0))
    return kind[1:].encode() + x.astype(kind).tobytes()


def unpack_vectors(data: list[bytes]) -> np.ndarray:
    """A matrix with zeros where vectors are short."""
    rows = [np.frombuffer(d[2:], "<" + d[:2].decode()) for d in data]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def pack_matrix(x: np.ndarray) -> bytes:
    kind = _kind(np.abs(x).max(initial=0))
    return kind[1:].encode() + np.array(x.shape, "<i4").tobytes() + np.ascontiguousarray(x, kind).tobytes()


def unpack_matrix(data: bytes) -> np.ndarray:
    shape = np.frombuffer(data, "<i4", 2, 2)
    return np.frombuffer(data, "<" + data[:2].decode(), int(np.prod(shape)), 10).reshape(shape).astype(np.int64)


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x[:, :width]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products, saturated at the ends of a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object) if width else np.zeros((len(a), len(b)), object)
    return np.minimum(np.maximum(exact, NONE + 1), np.iinfo(np.int64).max).astype(np.int64)


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """What no document of a block exceeds, a row a query and a column a block; rounding is made up for."""
    width = min(queries.shape[1], most.shape[1])
    q, most, least = (x[:, :width].astype(np.float64) for x in (queries, most, least))
    slack = 1e-9 * np.outer(np.abs(q).sum(1), np.maximum(np.abs(most), np.abs(least)).max(axis=1, initial=0))
    return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T + slack


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for v in batch.column("v").to_pylist():
            x = np.array(v if v is not None and None not in v else [np.nan], np.float64)
            with np.errstate(over="ignore"):
                out.append(pack_vector(np.floor(np.clip(SCALE * x, -LARGEST, LARGEST)).astype(np.int64)) if np.isfinite(x).all() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "v"])


# Ranges


def fit_cuts(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, each cell's term and cut; a cell is cut at the median of the term that varies most."""
    cells, levels = [sample], []
    for _ in range(depth):
        terms, cuts, following = [], [], []
        for x in cells:
            term = int(x.var(axis=0).argmax()) if len(x) > 1 and x.shape[1] else 0
            values = x[:, term] if x.shape[1] else np.zeros(len(x))
            cut = float(np.floor(np.median(values))) if len(x) else 0.0
            terms.append(term)
            cuts.append(cut)
            following += [x[values <= cut], x[values > cut]]
        levels.append((np.array(terms), np.array(cuts)))
        cells = following
    return levels


def leaf_of(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    x = _widened(x, max(x.shape[1], 1 + max((int(t.max()) for t, _ in levels), default=0)))
    for terms, cuts in levels:
        at = 2 * at + (x[np.arange(len(x)), terms[at]] > cuts[at])
    return at


# Results of a batch: for every query its best scores and ids, filled up with NONE


def merged(scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores), axis=-1)[:, :keep]  # ~ turns the order round without overflow
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _survivors(scores: np.ndarray, kth: np.ndarray, columns: np.ndarray, first: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the best ``keep`` per row among those that reach its k-th."""
    i, j = np.nonzero(scores >= kth[:, None])
    s = scores[i, j]
    order = np.lexsort((first[columns[j]], ~s, i))
    i, j, s = i[order], j[order], s[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < keep], columns[j[rank < keep]], s[rank < keep]


def score_block(queries: np.ndarray, kth: np.ndarray, block: dict, keep: int, part_rows: int = PART_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Best scores and ids of a block for queries that already have others of at least ``kth``."""
    best = np.full((len(queries), keep), NONE), np.full((len(queries), keep), np.iinfo(np.int64).max)
    kth = kth.copy()
    reach = bounds(queries, block["most"], block["least"])
    parts = np.argsort(-reach.max(axis=0), kind="stable")
    step = max(1, STEP // (part_rows * max(len(queries), 1)))
    starts, size = block["starts"], len(block["x"])
    at, width = 0, 1
    while at < len(parts):  # the first parts alone, to have a k-th score soon
        taken = parts[at : at + width]
        taken = taken[(reach[:, taken] >= kth[:, None]).any(axis=0)]
        at, width = at + width, min(2 * width, step)
        if not len(taken):
            continue
        columns = np.concatenate([np.arange(p * part_rows, min((p + 1) * part_rows, size)) for p in taken])
        i, j, s = _survivors(products(queries, block["x"][columns]), kth, columns, block["ids"][starts[:-1]], keep)
        if not len(i):
            continue
        n = np.minimum(starts[j + 1] - starts[j], keep)  # rows that share the vector
        ids = block["ids"][np.repeat(starts[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        i, s = np.repeat(i, n), np.repeat(s, n)
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        found_s = np.full((len(queries), int(rank.max()) + 1), NONE)
        found_i = np.full(found_s.shape, np.iinfo(np.int64).max)
        found_s[i, rank], found_i[i, rank] = s, ids
        best = merged(np.hstack([best[0], found_s]), np.hstack([best[1], found_i]), keep)
        kth = np.maximum(kth, best[0][:, -1])
    return best


STATE_DDL = "batch long, kind int, reps binary, queries binary, scores binary, ids binary"
ASK_DDL = "block int, batch long, kind int, members binary, queries binary, kth binary"
BLOCK_DDL = "block int, x binary, starts binary, ids binary, most binary, least binary"


def _ints(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").tobytes()


def _row(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):  # one at a time: rows hold matrices
            yield batch.slice(i, 1).to_pylist()[0]


def top_k(vectors: DataFrame, k: int = 20, asked: Column | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``asked`` (over ``vec_id``) picks, the k best others."""
    spark = vectors.sparkSession
    context = spark.sparkContext
    asked = F.col("vec_id") % 20 == 0 if asked is None else asked
    keep, part_rows = k + 1, PART_ROWS
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where("vec_id IS NOT NULL")
    rows = source.mapInArrow(_clean, "vec_id long, v binary").where("v IS NOT NULL").distinct()
    rows = written(rows, "topk-rows")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    firsts = rows.withColumn("nth", nth).where(F.col("nth") <= keep).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    reps = written(firsts.withColumn("rep", F.monotonically_increasing_id()), "topk-vectors")
    queries = written(rows.where(asked).join(reps, "v").select(F.col("vec_id").alias("query_id"), "rep"), "topk-queries")

    total, longest = reps.agg(F.count(F.lit(1)), F.max(F.octet_length("v"))).first()
    n_asked = queries.select("rep").distinct().count()
    sample = unpack_vectors(reps.orderBy(F.xxhash64("v"), "rep").limit(min(SAMPLE, max(64, (64 << 20) // max(longest or 1, 1)))).select("v").toArrow()["v"].to_pylist())
    most_blocks = max(1, SUMMARY // (4 * max((longest or 0) // 2, 1)))  # two numbers a term, and at most half as many blocks again as leaves
    block_rows = max(BLOCK_ROWS, -(-total // most_blocks))
    fine = min(int(np.ceil(np.log2(max(total / part_rows, 1)))), int(np.log2(max(len(sample) / 4, 1))))
    coarse = min(fine, int(np.log2(max(total / block_rows, 1))))
    levels = context.broadcast(fit_cuts(sample, fine))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = leaf_of(unpack_vectors(batch.column("v").to_pylist()), levels.value)
            yield pa.RecordBatch.from_arrays([pa.array(leaf >> (fine - coarse), pa.int64()), pa.array(leaf), *batch.columns], names=["range", "leaf", *batch.schema.names])

    ranged = written(reps.select("rep", "v", "ids").mapInArrow(place, "range long, leaf long, rep long, v binary, ids array<long>"), "topk-ranged")
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as leaves at most
    pieces, blocks = [], 0
    for leaf in sorted(sizes):
        n = -(-sizes[leaf] // (2 * block_rows))
        pieces.append((leaf, blocks, n))
        blocks += n
    first = F.broadcast(spark.createDataFrame(pieces, "range long, start int, pieces int"))
    numbered = ranged.join(first, "range").withColumn("block", F.col("start") + F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by([("leaf", "ascending"), ("rep", "ascending")])
        x = unpack_vectors(group["v"].to_pylist())
        ids = group["ids"].to_pylist()
        cuts = np.arange(0, len(x), part_rows)
        most, least = (f.reduceat(x, cuts, axis=0) for f in (np.maximum, np.minimum))
        starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        row = (group["block"][0].as_py(), pack_matrix(x), _ints(starts), _ints(np.concatenate(ids)), pack_matrix(most), pack_matrix(least))
        return pa.Table.from_batches([_row(BLOCK_DDL, [row])])

    index = written(numbered.select("block", "leaf", "rep", "v", "ids").groupBy("block").applyInArrow(build, BLOCK_DDL), "topk-index")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            most, least = unpack_matrix(r["most"]).max(axis=0), unpack_matrix(r["least"]).min(axis=0)
            yield _row("block int, most binary, least binary", [(r["block"], _ints(most), _ints(least))])

    found = sorted(index.select("block", "most", "least").mapInArrow(summarise, "block int, most binary, least binary").collect())
    width = max((len(r["most"]) // 8 for r in found), default=0)
    most, least = (np.zeros((len(found), width), np.int64) for _ in range(2))
    for i, r in enumerate(found):
        for out, data in ((most, r["most"]), (least, r["least"])):
            values = np.frombuffer(data, "<i8")
            out[i, : len(values)] = values
    summaries = context.broadcast((np.array([r["block"] for r in found], np.int64), most, least))

    in_batch = min(MOST_BATCH, max(LEAST_BATCH, n_asked // 96))

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring queries in one row, with no results yet."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, in_batch):
                some = batch.slice(at, in_batch)
                q = unpack_vectors(some.column("v").to_pylist())
                nothing = np.full((len(q), keep), NONE)
                yield _row(STATE_DDL, [(number, 0, _ints(some.column("rep").to_numpy()), pack_matrix(q), _ints(nothing), _ints(nothing))])
                number += 1

    neighbours = ranged.join(queries.select("rep").distinct(), "rep", "left_semi").repartitionByRange("leaf", "rep").sortWithinPartitions("leaf", "rep")
    states = written(neighbours.select("rep", "v").mapInArrow(batched, STATE_DDL), "topk-states")

    def asking(low: int, high: int):  # noqa: ANN202
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Blocks in the order of bounds from ``low`` to ``high`` that can still hold one of a query's best."""
            names, most, least = summaries.value
            for r in _rows(batches):
                q = unpack_matrix(r["queries"])
                kth = np.frombuffer(r["scores"], "<i8").reshape(len(q), keep)[:, -1]
                reach = bounds(q, most, least)
                order = np.argsort(-reach, axis=1, kind="stable")[:, low:high]
                wanted = np.take_along_axis(reach, order, 1) >= kth[:, None]
                member, block = np.nonzero(wanted)[0], order[wanted]
                for b in np.unique(block):
                    m = member[block == b]
                    yield _row(ASK_DDL, [(int(names[b]), r["batch"], 1, _ints(m), pack_matrix(q[m]), _ints(kth[m]))])

        return ask

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Asks of a block, which comes first."""
        block: dict = {}
        for r in _rows(batches):
            if r["kind"] == 0:
                block = {c: unpack_matrix(r[c]) for c in ("x", "most", "least")} | {c: np.frombuffer(r[c], "<i8") for c in ("starts", "ids")}
                continue
            scores, ids = score_block(unpack_matrix(r["queries"]), np.frombuffer(r["kth"], "<i8"), block, keep, part_rows)
            some = scores[:, 0] > NONE
            if some.any():
                members = np.frombuffer(r["members"], "<i8")[some]
                yield _row(STATE_DDL, [(r["batch"], 1, _ints(members), None, _ints(scores[some]), _ints(ids[some]))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's state, which comes first, with what blocks answered."""
        state: dict | None = None
        for r in _rows(batches):
            scores, ids = (np.frombuffer(r[c], "<i8").reshape(-1, keep) for c in ("scores", "ids"))
            if r["kind"] == 0:
                if state:
                    yield _row(STATE_DDL, [tuple(_ints(x) if isinstance(x, np.ndarray) else x for x in state.values())])
                state = r | {"scores": scores.copy(), "ids": ids.copy()}
                continue
            at = np.frombuffer(r["reps"], "<i8")
            state["scores"][at], state["ids"][at] = merged(np.hstack([state["scores"][at], scores]), np.hstack([state["ids"][at], ids]), keep)
        if state:
            yield _row(STATE_DDL, [tuple(_ints(x) if isinstance(x, np.ndarray) else x for x in state.values())])

    none = lambda kind: F.lit(None).cast(kind)
    low = 0
    for high in (*(r for r in ROUNDS if r < blocks), blocks):
        asks = written(states.mapInArrow(asking(low, high), ASK_DDL), "topk-asks")
        counts = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("copies"))  # a row a block
        copied = index.join(F.broadcast(counts), "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        copied = copied.select("block", "copy", F.lit(0).alias("kind"), none("long").alias("batch"), "x", "starts", "ids", "most", "least", *(none("binary").alias(c) for c in ("members", "queries", "kth")))
        asks = asks.join(F.broadcast(counts), "block").withColumn("copy", F.pmod(F.xxhash64("batch"), F.col("copies")).cast("int"))
        asks = asks.select("block", "copy", "kind", "batch", *(none("binary").alias(c) for c in ("x", "starts", "ids", "most", "least")), "members", "queries", "kth")
        met = copied.unionByName(asks).repartition("block", "copy").sortWithinPartitions("block", "copy", "kind")
        answers = met.mapInArrow(answer, STATE_DDL)
        both = states.unionByName(answers).repartition("batch").sortWithinPartitions("batch", "kind")
        following = written(both.mapInArrow(gather, STATE_DDL), "topk-states")
        drop_written(states, asks)
        states, low = following, high

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            reps, q = np.frombuffer(r["reps"], "<i8"), unpack_matrix(r["queries"])
            scores, ids = (np.frombuffer(r[c], "<i8").reshape(len(q), keep) for c in ("scores", "ids"))
            own = [int(products(x[None], x[None])[0, 0]) for x in q]
            top = [[{"score": int(a), "vec_id": int(b)} for a, b in zip(s, i, strict=True) if a > NONE] for s, i in zip(scores, ids, strict=True)]
            kind = pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(own, pa.int64()), pa.array(top, kind)], names=["rep", "own", "top"])

    best = states.mapInArrow(results, "rep long, own long, top array<struct<score:bigint,vec_id:bigint>>")
    itself = F.array_position("top", F.struct(F.col("own").alias("score"), F.col("query_id").alias("vec_id")))
    others = F.slice(F.filter("top", lambda x, i: i + 1 != F.col("itself")), 1, k)
    ranked = queries.join(best, "rep").withColumn("itself", itself).select("query_id", F.posexplode(others).alias("at", "t"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
