"""Removal of repeated passages by recompression (operator 7).

A text is a sequence of word symbols. A round names runs of one symbol, then pairs of neighbours whose
symbols fall to the left and to the right half of the alphabet; a name is a hash of what it stands for,
so the names are global: every task gives equal strings equal symbols. Whether two symbols join depends
on them alone, so the parse of the inside of a window depends on the window alone; only symbols at its
ends may join outside ones, and are not counted to its inside. After two rounds a window of 20 words
keeps at least one inner symbol, unless long runs fill it, for which lower rounds serve.

0. A document whose whole text an earlier one has is all repeats, and takes no further part.
1. Each window names as its anchor the least-hashed inner symbol of its highest round. Anchors are far
   fewer than windows; those met at least twice in the corpus are set in a bit table of bounded size.
   Where they are too many for it, documents meet them by a join.
2. Windows whose anchor is shared are verified: 96 bits of all their words are looked up for their first
   place (smallest doc_id, then start). All windows that are not at their first place are repeats. Windows
   with very many places are looked up in a broadcast of bounded size.
3. Words that a repeat covers are removed.

A window of a text that occurs once never leaves its task (but for the few that the table takes for
repeated), and no step gathers the occurrences of a window.

Nulls and edge cases: a null text has no words; a text shorter than a window loses nothing; rows of one
doc_id with different texts are ordered by a hash of the text, and equal rows are one document (each row
has its result); a null doc_id sorts first; other columns are ignored or, in `cut`, kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shared import repeated
from .words import Bits, combine, hashes, mix, slices

_ROUNDS = 2
_CONTEXT = 8
_INDEX = np.uint64((1 << 26) - 1)


def _runs(symbols: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A name for each run, which symbols begin one, and the run of each symbol."""
    first = np.concatenate([[True], symbols[1:] != symbols[:-1]])
    number = np.cumsum(first) - 1
    length = np.bincount(number).astype(np.uint64)
    names = symbols[first].copy()
    long = length > 1
    names[long] = mix(names[long] * np.uint64(2 * level + 3) + length[long] * np.uint64(0xA0761D6478BD642F))
    return names, first, number


def _pairs(symbols: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A name for each pair or single symbol, which symbols are second in a pair, and which are right ones."""
    right = (mix(symbols + np.uint64(0x9E37 * (level + 1))) >> np.uint64(63)).astype(bool)
    second = np.concatenate([[False], right[1:] & ~right[:-1]])
    number = np.cumsum(~second) - 1
    names = symbols[~second].copy()
    heads = np.flatnonzero(second) - 1
    names[number[heads]] = mix(symbols[heads] * np.uint64(0xE7037ED1A0B428DB) + symbols[heads + 1] + np.uint64(level))
    return names, second, right


def anchors(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` words: its anchor's name, and the word where the anchor begins.
    The name takes in the words from there on, as short symbols are met everywhere by chance; these words
    lie within the window, so equal windows still have equal names."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low, high = np.arange(n), np.arange(width - 1, width - 1 + n)  # inside, as places in the symbols
    levels = [(words, np.arange(len(words)), low, low)]
    symbols, begin = words, np.arange(len(words))
    for level in range(_ROUNDS):
        symbols, first, number = _runs(symbols, level)
        begin = begin[first]
        low, high = number[low] + 1, number[high] - 1
        levels.append((symbols, begin, low, high))
        paired, second, right = _pairs(symbols, level)
        number = np.cumsum(~second) - 1
        some = low <= high
        low = np.where(some & right[np.minimum(low, len(symbols) - 1)], low + 1, low)
        high = np.where(some & ~right[np.maximum(high, 0)], high - 1, high)
        some = low <= high
        # (0, 0) is empty after the next runs, (1, 0) at once
        empty = 0 if level < _ROUNDS - 1 else 1
        low, high = np.where(some, number[np.minimum(low, len(symbols) - 1)], empty), np.where(some, number[np.maximum(high, 0)], 0)
        symbols, begin = paired, begin[~second]
    levels.append((symbols, begin, low, high))
    context = min(_CONTEXT, width)
    name, start = np.empty(n, np.uint64), np.empty(n, np.int64)
    todo = np.arange(n)
    for level in range(len(levels) - 1, -1, -1):
        symbols, begin, low, high = levels[level]
        # the words that name it have to end within the window
        high = np.minimum(high, np.searchsorted(begin, np.arange(n) + (width - context), side="right") - 1)
        own = todo[low[todo] <= high[todo]]
        if len(own):
            at = _least(symbols, low[own], high[own], level)
            name[own], start[own] = symbols[at] + np.uint64(level), begin[at]
            todo = todo[low[todo] > high[todo]]
        if not len(todo):
            break
    return mix(name ^ combine(words, context)[start]), start


def _least(symbols: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """The place of the least-hashed symbol from low to high, the first of equal ones."""
    keys = mix(symbols ^ np.uint64(level)) & ~_INDEX | np.arange(len(symbols), dtype=np.uint64) & _INDEX
    size = high - low + 1
    least = np.empty(len(low), np.uint64)
    power, table, top = 0, keys, int(size.max())
    while True:
        own = size >> power == 1
        if own.any():
            least[own] = np.minimum(table[low[own]], table[high[own] - (1 << power) + 1])
        power += 1
        if 1 << power > top:
            break
        half = 1 << (power - 1)
        table = np.minimum(table[:-half], table[half:])
    return (least & _INDEX).astype(np.int64)


def _keyed(df: DataFrame, broadcast_rows: int) -> DataFrame:
    """Adds text_key, which tells rows of one doc_id apart: 0 where the doc_id is not repeated."""
    twice = materialize(df.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("again")), "again")
    n = twice.count()
    if not n:
        return df.withColumn("text_key", F.lit(0).cast("long"))
    side = F.broadcast(twice) if n <= broadcast_rows else twice
    marked = df.join(side.withColumn("is_again", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("again")), "left")
    return marked.withColumn("text_key", F.when(F.col("is_again"), F.xxhash64("text")).otherwise(F.lit(0))).drop("again", "is_again")


def _inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Which windows of texts laid end to end lie within one text."""
    n = int(counts.sum()) - width + 1
    inside = np.ones(max(n, 0), bool)
    for end in np.cumsum(counts)[:-1]:
        inside[max(0, end - width + 1) : end] = False
    return inside


def _counted(df: DataFrame, width: int) -> DataFrame:
    """Anchors of every text, each name once at each start, added up where a task meets them again. As an anchor
    depends on its window alone, texts are laid end to end and windows across their ends left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, counts = hashes(part.column("text").to_pylist(), False)
            names, start = anchors(words, width)
            inside = _inside(counts, width)
            # Windows of one start may differ in the anchor's level, and so in its name.
            own, at = names[inside], start[inside]
            order = np.lexsort((own, at))
            own, at = own[order], at[order]
            first = np.ones(len(own), bool)
            first[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1])
            once, n = np.unique(own[first], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(n.astype(np.int32))], ["anchor", "n"])

    return df.select("text").mapInArrow(run, "anchor long, n int")


_RUNS = "doc_id long, text_key long, start int, windows array<long>, checks array<int>"
_RUNS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("windows", pa.list_(pa.int64())), ("checks", pa.list_(pa.int32()))])


def _runs_of_windows(part: pa.RecordBatch, words: np.ndarray, counts: np.ndarray, hit: np.ndarray, width: int) -> pa.RecordBatch | None:
    """The windows that are hit, as runs of starts with 96 bits for the words of each."""
    edge = np.flatnonzero(np.diff(hit, prepend=False, append=False))
    if not len(edge):
        return None
    first, last = edge[::2], edge[1::2]
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, first, side="right")
    offsets = pa.array(np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32))
    windows = combine(words, width).view(np.int64)[hit]
    checks = (combine(mix(words ^ np.uint64(0x2545F4914F6CDD1D)), width) >> np.uint64(32)).astype(np.uint32).view(np.int32)[hit]
    columns = [part.column(c).take(pa.array(doc)) for c in ("doc_id", "text_key")]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (windows, checks)]
    return pa.RecordBatch.from_arrays([*columns, pa.array((first - (ends - counts)[doc]).astype(np.int32)), *lists], schema=_RUNS_SCHEMA)


def _candidates(df: DataFrame, width: int, bits: Bits) -> DataFrame:
    """Windows whose anchor may be repeated: doc_id, text_key, and runs of starts with their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words, counts = hashes(part.column("text").to_pylist(), False)
            hit = bits.has(anchors(words, width)[0]) & _inside(counts, width)
            if (found := _runs_of_windows(part, words, counts, hit, width)) is not None:
                yield found

    return df.mapInArrow(run, _RUNS)


def _candidates_by_join(df: DataFrame, width: int, common: DataFrame) -> DataFrame:
    """The same where the anchors met twice (common) are too many for a bit table: each document's anchors meet
    them by a join, and those that are found come back to it."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=1):
            words, _ = hashes(part.column("text").to_pylist(), False)
            own = np.unique(anchors(words, width)[0]).view(np.int64)
            columns = [part.column(c).take(pa.array(np.zeros(len(own), np.int64))) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([pa.array(own), *columns], ["anchor", "doc_id", "text_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=1):
            words, counts = hashes(part.column("text").to_pylist(), False)
            met = part.column("met").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.isin(anchors(words, width)[0], met)
            if (found := _runs_of_windows(part, words, counts, hit, width)) is not None:
                yield found

    docs = df.select("doc_id", "text_key", "text").dropDuplicates(["doc_id", "text_key"])
    named = docs.mapInArrow(name, "anchor long, doc_id long, text_key long")
    met = named.join(common, "anchor", "left_semi").groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_list("anchor").alias("met"))
    found = docs.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).select("doc_id", "text_key", "text", "met")
    return found.mapInArrow(run, _RUNS)


def repeats(df: DataFrame, width: int = 20, hot: int = 20_000) -> DataFrame:
    """doc_id, text_key, starts: the windows of each document (doc_id, text, text_key) that also start
    earlier. Windows that are met in more than one of `hot` places, of which there are `hot` at most, are
    broadcast, so that no task gathers the places of a frequent one; the others are joined."""
    bits, common = repeated(_counted(df, width), "anchor", "n")
    runs = materialize(_candidates(df, width, bits) if bits else _candidates_by_join(df, width, common), "windows")
    place = F.struct("doc_id", "text_key", (F.col("start") + F.col("x.pos")).alias("start"))
    windows = runs.select("doc_id", "text_key", "start", F.explode(F.transform(F.arrays_zip("windows", "checks"), lambda x, i: F.struct(i.alias("pos"), x["windows"].alias("window"), x["checks"].alias("check")))).alias("x"))
    windows = windows.select(F.col("x.window").alias("window"), F.col("x.check").alias("check"), place.alias("place"))
    firsts = windows.groupBy("window", "check").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = materialize(firsts, "firsts")
    total = runs.agg(F.coalesce(F.sum(F.size("windows")), F.lit(0))).first()[0]
    bound = max(1_000, total // hot)
    often = F.broadcast(firsts.filter(F.col("n") > bound).select("window", "check", "first"))
    marked = windows.join(often, ["window", "check"], "left")
    seldom = marked.filter("first IS NULL").drop("first").join(firsts.filter(F.col("n") <= bound).select("window", "check", "first"), ["window", "check"])
    later = marked.filter("first IS NOT NULL").unionByName(seldom).filter(~F.col("place").eqNullSafe(F.col("first")))
    return later.groupBy("place.doc_id", "place.text_key").agg(F.collect_list("place.start").alias("starts"))


def _copies(docs: DataFrame, width: int, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Ids and text_keys of the documents whose whole text a document of smaller doc_id has (all their windows
    start earlier there), and the others. They are broadcast up to broadcast_rows, and joined by a shuffle
    beyond that. Texts too short for a window, empty ones above all, are not looked up."""
    keyed = docs.filter(F.length("text") >= 2 * width - 1).select("doc_id", "text_key", F.md5("text").alias("whole"))
    firsts = keyed.groupBy("whole").agg(F.min(F.struct("doc_id")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("whole", F.col("first.doc_id").alias("first"))
    later = keyed.join(firsts, "whole").filter(~F.col("doc_id").eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("copy_id"), F.col("text_key").alias("copy_key")).distinct()
    later = materialize(later, "copies")
    side = F.broadcast(later) if later.count() <= broadcast_rows else later
    return side, docs.join(side, F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("text_key") == F.col("copy_key")), "left_anti")


def _with_repeats(docs: DataFrame, width: int, broadcast_rows: int = 1_000_000) -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names are given: the windows to go, and whether all of a text is a copy.
    All own columns have a name that docs does not have."""
    tag = uuid.uuid4().hex
    own_key, starts, copy, d, k = (f"{c}_{tag}" for c in ("key", "starts", "copy", "d", "k"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = _keyed(docs.select(F.col("doc_id").cast("long"), text.alias("text")), broadcast_rows)
    repeated_ids = bool(plain.filter("text_key <> 0").limit(1).count())
    side, others = _copies(plain, width, broadcast_rows)
    found = repeats(others, width)
    doc_id = F.col("doc_id").cast("long")
    # A row with its own id has the key 0, any other the hash of its text; a key of one kind is not that of the other.
    docs = docs.withColumn(own_key, F.xxhash64(text)) if repeated_ids else docs
    same = (lambda key: key.isin(0) | (key == F.col(own_key))) if repeated_ids else (lambda key: F.lit(True))
    found = found.select(F.col("doc_id").alias(d), F.col("text_key").alias(k), F.col("starts").alias(starts))
    out = docs.join(found, doc_id.eqNullSafe(F.col(d)) & same(F.col(k)), "left").drop(d, k)
    side = side.select(F.col("copy_id").alias(d), F.col("copy_key").alias(k), F.lit(True).alias(copy))
    out = out.join(side, doc_id.eqNullSafe(F.col(d)) & same(F.col(k)), "left").drop(d, k)
    return out.withColumn(copy, F.coalesce(copy, F.lit(False))).drop(own_key), starts, copy


def _kept(text: str | None, starts: list[int] | None, copy: bool, width: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if copy and len(words) >= width:
        return [], len(words)
    if not starts:
        return words, len(words)
    change = np.zeros(len(words) + 1, np.int32)
    starts = np.asarray(starts)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    stays = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(stays)], len(words)


def digest(df: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: dict[str, list] = {"doc_id": part.column("doc_id").to_pylist(), "n_words": [], "n_removed": [], "kept_sha256": []}
            for text, starts, copy in zip(*(part.column(c).to_pylist() for c in ("text", starts_name, copy_name)), strict=True):
                kept, n = _kept(text, starts, copy, width)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    marked, starts_name, copy_name = _with_repeats(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), width)
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut(df: DataFrame, width: int = 20) -> DataFrame:
    """The table with repeated words removed from its texts: a text that loses words keeps the others,
    joined by one space, and a new n_chars if there is such a column; all else stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column("text").to_pylist()
            changed = [False] * len(texts)
            for i, (starts, copy) in enumerate(zip(part.column(starts_name).to_pylist(), part.column(copy_name).to_pylist(), strict=True)):
                kept, n = _kept(texts[i], starts, copy, width) if starts or copy else ([], 0)
                if len(kept) < n:
                    changed[i] = True
                    texts[i] = b" ".join(kept).decode("utf-8", "surrogatepass")
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in part.schema.names:
                lengths = pc.utf8_length(new["text"]).cast(part.schema.field("n_chars").type)
                new["n_chars"] = pc.if_else(pa.array(changed, pa.bool_()), lengths, part.column("n_chars"))
            for c, values in new.items():
                part = part.set_column(part.schema.get_field_index(c), c, values)
            yield part.select([c for c in part.schema.names if c not in (starts_name, copy_name)])

    marked, starts_name, copy_name = _with_repeats(df.withColumn("text", F.col("text").cast("string")), width)
    return marked.mapInArrow(run, marked.drop(starts_name, copy_name).schema)
