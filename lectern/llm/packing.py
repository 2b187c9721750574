"""Hierarchical residual packing of documents into sequences (operator 5).

Every partition cuts its documents into pieces and packs them best-fit by falling length. Sequences that
are nearly full are done. All others, however many, are bins that go up a tree: a node takes the bins of
`fan_in` children as items, packs them best-fit, calls the nearly full results done and hands the rest to
its parent. Bins of equal size are alike, and there are no more sizes than the capacity, so what a node
takes and hands up is a number of bins for each size, and no task holds the bins of others. Once the tree
stands, every piece finds its way by the size and rank of its bin, one join a level.

What even the root leaves underfull is opened, as bins of two 700s and bins of one 1,300 never meet again
as bins: its pieces are packed best-fit once more, by the numbers of each length.

Nulls and edge cases: a null or empty text is one piece with the end id alone; a null doc_id is kept;
repeated rows are packed as often as they occur; other columns are ignored; an empty table packs into
nothing.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import encoder
from .words import slices

_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Pieces, and for those in an underfull bin its node, its size and its rank among the node's bins of that size.
_BINS = PACKED + ", node long, size long, rank long"
_SCHEMA = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in _BINS.split(", ")])
_MOVES = "node long, size long, start long, upto long, each long, place long, total long, done boolean, to long, fresh long"
#: Pieces that a task packs at a time, which make no more sequences than that.
FLUSH = 100_000


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit by falling size: each item goes to the fullest bin that has room for it. Room is looked
    up among the capacity + 1 possible residuals, so an item costs a binary search."""
    bins: list[list[int]] = []
    waiting: dict[int, list[int]] = {}  # residual -> bins that have it
    residuals: list[int] = []  # sorted, without repeats
    for item in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = int(sizes[item])
        at = bisect.bisect_left(residuals, size)
        if at == len(residuals):
            k, rest = len(bins), capacity - size
            bins.append([item])
        else:
            rest = residuals[at]
            k = waiting[rest].pop()
            if not waiting[rest]:
                del waiting[rest], residuals[at]
            bins[k].append(item)
            rest -= size
        if rest > 0:
            if rest not in waiting:
                waiting[rest] = []
                bisect.insort(residuals, rest)
            waiting[rest].append(k)
    return bins


def best_fit_counts(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The same for `sizes[size]` items of each size. Bins of equal contents are one class, so the work grows
    with the sizes, not the items. Returns rows size, rank, bins, each, bin, offset: the items of that size
    from that rank on fill as many bins, from that bin on, with `each` items at that offset."""
    open_at: dict[int, list[tuple[int, int]]] = {}  # residual -> classes: first bin, bins
    residuals: list[int] = []  # sorted, without repeats
    out: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(rest: int, first: int, bins: int) -> None:
        if rest and bins:
            if rest not in open_at:
                open_at[rest] = []
                bisect.insort(residuals, rest)
            open_at[rest].append((first, bins))

    for size in sorted(sizes, reverse=True):
        rank, left = 0, sizes[size]
        while left:
            at = bisect.bisect_left(residuals, size)
            if at < len(residuals):
                rest = residuals[at]
                first, bins = open_at[rest].pop()
                if not open_at[rest]:
                    del open_at[rest], residuals[at]
            else:
                rest, first = capacity, made
                bins = -(-left // (capacity // size))
                made += bins
            most = rest // size
            filled = min(bins, left // most)
            for number, each in ((filled, most), (1, left % most if filled < bins else 0)):
                if number and each:
                    out.append((size, rank, number, each, first, capacity - rest))
                    put(rest - each * size, first, number)
                    rank, left, first, bins = rank + number * each, left - number * each, first + number, bins - number
            put(rest, first, bins)
    return out


def merge_bins(sizes: dict[int, int], capacity: int, least: float) -> list[tuple]:
    """One best-fit round over `sizes[size]` bins of each size. Returns rows size, start, upto, each, place,
    total, done, to, fresh: the bins of that size with ranks from start up to upto go, `each` together from
    `place` on, into new bins of `total` tokens. Those are done from `least` tokens on. The first is number `to`
    of the node if done, else the one of that rank among those of equal total; fresh counts new bins once."""
    rows = np.array(best_fit_counts(sizes, capacity), np.int64).reshape(-1, 6)
    edges = np.unique(np.concatenate([rows[:, 4], rows[:, 4] + rows[:, 2]]))
    begins, ends = np.searchsorted(edges, rows[:, 4]), np.searchsorted(edges, rows[:, 4] + rows[:, 2])
    total = np.zeros(max(len(edges) - 1, 0), np.int64)
    for (size, _, _, each, _, _), a, b in zip(rows, begins, ends, strict=True):
        total[a:b] += size * each
    to, met = edges[:-1].copy(), Counter()
    for k in np.flatnonzero(total < least).tolist():
        to[k] = met[total[k]]
        met[total[k]] += int(edges[k + 1] - edges[k])
    out = []
    for (size, rank, _, each, first, place), a, b in zip(rows.tolist(), begins, ends, strict=True):
        for k in range(a, b):
            start, upto = (rank + each * int(e - first) for e in (edges[k], edges[k + 1]))
            fresh = 0 if place else int(edges[k + 1] - edges[k])
            out.append((size, start, upto, each, place, int(total[k]), bool(total[k] >= least), int(to[k]), fresh))
    return out


def tree(bins: DataFrame, parts: int, flushed: bool, capacity: int, least: float, fan_in: int) -> list[tuple[int, DataFrame]]:
    """bins: node, size, n. Returns for each level how many parts a node spans and a table node, size, parent,
    before, moves."""

    def node(key: tuple, sizes: pd.DataFrame) -> pd.DataFrame:
        rows = merge_bins(dict(zip(sizes["size"].tolist(), sizes["n"].tolist(), strict=True)), capacity, least)
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[c.split()[0] for c in _MOVES.split(", ")])

    # A part is one table of bins unless it was flushed: then its own come together first.
    levels, divisor, span = [], *((1 << 30, 1) if flushed else (fan_in << 30, fan_in))
    while True:
        earlier = F.sum("n").over(Window.partitionBy("parent", "size").orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("parent", F.expr(f"node div {divisor}")).withColumn("before", F.coalesce(earlier, F.lit(0)))
        joint = bins.groupBy(F.col("parent").alias("node"), "size").agg(F.sum("n").alias("n"))
        moves = materialize(joint.groupBy("node").applyInPandas(node, _MOVES), "moves")
        ways = moves.groupBy(F.col("node").alias("parent"), "size").agg(F.collect_list(F.struct("start", "upto", "each", "place", "total", "done", "to")).alias("moves"))
        levels.append((span, materialize(bins.drop("n").join(ways, ["parent", "size"]), "level")))
        if span >= parts:
            return levels
        bins = moves.filter("NOT done").groupBy("node", F.col("total").alias("size")).agg(F.sum("fresh").alias("n"))
        divisor, span = fan_in, span * fan_in


def climb(pieces: DataFrame, level: int, span: int, table: DataFrame, broadcast_rows: int) -> DataFrame:
    """Pieces with the bins that theirs became part of at this level; those that are done stay."""
    size = table.agg(F.sum(F.size("moves")).alias("n")).first()["n"] or 0
    table = F.broadcast(table) if size <= broadcast_rows else table
    # Pieces that are done meet no node, spread over many keys.
    key = F.coalesce("node", -1 - F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4096)))
    met = pieces.withColumn("node", key).join(table, ["node", "size"], "left").withColumn("rank", F.col("rank") + F.col("before"))
    met = met.withColumn("move", F.filter("moves", lambda m: (m["start"] <= F.col("rank")) & (F.col("rank") < m["upto"]))[0])
    ahead = F.col("rank") - F.col("move.start")
    number = F.col("move.to") + F.floor(ahead / F.col("move.each"))
    moved, done = F.col("move").isNotNull(), F.col("move.done")
    first = F.lit(level << 58) + F.col("parent") * (span << 30)
    return met.select(
        *_COLUMNS[:5],
        F.when(moved & done, first + number).otherwise(F.col("sequence_id")).alias("sequence_id"),
        F.when(moved, F.col("offset") + F.col("move.place") + ahead % F.col("move.each") * F.col("size")).otherwise(F.col("offset")).alias("offset"),
        F.when(moved & ~done, F.col("parent")).alias("node"),
        F.when(moved & ~done, F.col("move.total")).alias("size"),
        F.when(moved & ~done, number).alias("rank"),
    )


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, full: float = 0.98, fan_in: int = 32, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    full: share of the capacity from which a sequence is nearly full. fan_in: children of a node of the tree.
    broadcast_rows: moves of a level, or numbers of pieces by part and length, that are broadcast, and joined by a
    shuffle beyond that."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer_path, True), TaskContext.get().partitionId()
        step = capacity
        pieces: list[tuple] = []
        unit = part << 30
        try:
            for rows in slices(batches, 4096, 4 << 20):
                flat, counts = own.encode(rows.column("text"), end_id)
                packed, begin = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B"), 0
                for doc, n in zip(rows.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    for k, a in enumerate(range(0, n, step)):
                        length = min(step, n - a)
                        at = 4 * (begin + a)
                        pieces.append((doc, k, a, length, zlib.crc32(packed[at : at + 4 * length])))
                        if len(pieces) == FLUSH:  # memory of a task stays bounded however large its split or a text is
                            yield fit(pieces, unit)
                            pieces, unit = [], unit + FLUSH
                    begin += n
            if pieces:
                yield fit(pieces, unit)
        finally:
            own.clear()

    def fit(pieces: list[tuple], unit: int) -> pa.RecordBatch:
        """unit: number of the first sequence, which also tells these bins from others."""
        sizes = np.array([p[3] for p in pieces], dtype=np.int64)
        places: list[tuple] = [()] * len(pieces)
        met: Counter = Counter()
        for number, members in enumerate(best_fit(sizes, capacity)):
            lengths = sizes[members].tolist()
            total, at = sum(lengths), 0
            for i, length in zip(members, lengths, strict=True):
                places[i] = (unit + number, at, None, None, None) if total >= least else (None, at, unit, total, met[total])
                at += length
            met[total] += 1
        columns = [*zip(*pieces, strict=True), *zip(*places, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    least = full * capacity
    pieces = materialize(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _BINS), "pieces")
    bins = materialize(pieces.filter("node IS NOT NULL").groupBy("node", "size").agg((F.max("rank") + 1).alias("n")), "bins")
    spread = bins.agg(F.max(F.shiftright("node", 30)).alias("part"), F.max(F.col("node").bitwiseAND((1 << 30) - 1)).alias("flush")).first()
    if spread["part"] is None:
        return pieces.select(*_COLUMNS)
    levels = tree(bins, spread["part"] + 1, spread["flush"] > 0, capacity, least, fan_in)
    for level, (span, table) in enumerate(levels, 1):
        pieces = climb(pieces, level, span, table, broadcast_rows)
    opened = open_bins(pieces.filter("sequence_id IS NULL"), len(levels) + 1, capacity, broadcast_rows)
    return pieces.filter("sequence_id IS NOT NULL").select(*_COLUMNS).unionByName(opened)


def open_bins(pieces: DataFrame, level: int, capacity: int, broadcast_rows: int) -> DataFrame:
    """Pieces of bins that stayed underfull, packed best-fit by the numbers of each length."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece's rank among those of its length that this task reads."""
        part, met = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            nth = []
            for length in batch.column("length").to_pylist():
                nth.append(met[length])
                met[length] += 1
            columns = [*(batch.column(c) for c in _COLUMNS[:5]), pa.array([part] * len(nth), pa.int64()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*_COLUMNS[:5], "part", "nth"])

    left = materialize(pieces.select(*_COLUMNS[:5]).mapInArrow(number, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"), "underfull")
    counts = left.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.withColumn("before", F.coalesce(earlier, F.lit(0))), "lengths")
    # At most as many rows as the capacity.
    sizes = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    classes = np.array(sorted(best_fit_counts(sizes, capacity)), np.int64).reshape(-1, 6)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.append(np.flatnonzero(np.diff(classes[:, 0], prepend=-1)), len(classes))
        begins = {int(classes[a, 0]): (a, classes[a:b, 1]) for a, b in zip(top[:-1], top[1:], strict=True)}
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            own = np.empty(len(length), np.int64)
            for size in np.unique(length).tolist():
                here = length == size
                first, ranks = begins[size]
                own[here] = first + np.searchsorted(ranks, rank[here], side="right") - 1
            _, begin, _, each, number, offset = classes[own].T
            which, place = np.divmod(rank - begin, each)
            found = [pa.array((level << 58) + number + which), pa.array(offset + place * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _COLUMNS[:5]), *found], _COLUMNS)

    side = counts.select("part", "length", "before")
    side = F.broadcast(side) if counts.count() <= broadcast_rows else side
    ranked = left.join(side, ["part", "length"]).select(*_COLUMNS[:5], (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)
