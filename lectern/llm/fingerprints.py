"""Context-triggered piecewise hashing of documents (operator 9).

A hash rolls over the last seven bytes of the UTF-8 text; where it meets a condition that one byte in
block-size does, a chunk ends. Each chunk gives one character of a signature, so an edit changes only
the characters of the chunks that it touches. The block size is the least 3 * 2^k for which the text
makes about 64 chunks; a fingerprint holds the signatures for it, its double and its fourfold:

    block_size:signature:signature at twice:signature at four times

Two fingerprints are compared at the least block size that both have; if there is none their likeness
is 0. Likeness is 1 - d / (sum of the lengths), d being the edit distance with insertions and deletions
(a substitution is one of each). As unrelated signatures share a few scattered characters, signatures
without a common run (seven characters, fewer if they are short) have likeness 0.

Nulls and edge cases: a null text is empty; the fingerprint of an empty text is "3:::", alike only to
itself (1.0). Texts of any length are read whole; a chunk has a quarter of the block size at least, so
four times it at most, so repetitive
texts have signatures of bounded length as well. A null doc_id sorts first; rows that repeat a doc_id
follow each other in the order of their texts. In a table of one document it is its own next one. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

#: Characters of a signature.
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_WINDOW, _LEAST, _CHUNKS, _RUN = 7, 3, 64, 7
_FACTORS = [pow(0x9E3779B1, j + 1, 1 << 32) | 1 for j in range(_WINDOW)]


def block_size(n_bytes: int) -> int:
    size = _LEAST
    while size * _CHUNKS < n_bytes:
        size *= 2
    return size


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    n, size = len(data), block_size(len(data))
    if not n:
        return f"{size}:::"
    rolled = data * np.uint32(_FACTORS[0])
    for j in range(1, min(_WINDOW, n)):
        rolled[j:] += data[:-j] * np.uint32(_FACTORS[j])
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x2C1B3C6D)
    rolled ^= rolled >> np.uint32(13)
    sums = np.cumsum(rolled, dtype=np.uint64)
    ends = np.flatnonzero(rolled % np.uint32(size) == size - 1)
    parts = [str(size), _signature(sums, ends, size)]
    for factor in (2, 4):
        ends = ends[rolled[ends] % np.uint32(size * factor) == size * factor - 1]
        parts.append(_signature(sums, ends, size * factor))
    return ":".join(parts)


def _signature(sums: np.ndarray, ends: np.ndarray, size: int) -> str:
    """One character for each chunk; the rest behind the last end is a chunk too."""
    least, most, last, kept = max(1, size // 4), 4 * size, -1, []
    while (k := int(np.searchsorted(ends, last + least))) < len(ends):
        kept.append(int(ends[k]))
        last = kept[-1]
    if not kept or last < len(sums) - 1:
        kept.append(len(sums) - 1)
    if max(np.diff(kept, prepend=-1)) > most:  # text without any trigger, such as one word over and over
        kept = [x for a, b in zip([-1, *kept], kept) for x in (*range(a + most, b, most), b)]
    chunk = np.diff(sums[np.asarray(kept, np.int64)], prepend=np.uint64(0))
    return _LETTERS[(chunk * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)].tobytes().decode()


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the columns of the table as bits of one number."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        if c in where:
            hit = row & where[c]
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (size_a, *own), (size_b, *others) = a.split(":"), b.split(":")
    x, y = ({int(s) << k: sig for k, sig in enumerate(sigs)} for s, sigs in ((size_a, own), (size_b, others)))
    shared = sorted(x.keys() & y.keys())
    if not shared or not x[shared[0]] or not y[shared[0]]:
        return 0.0
    p, q = x[shared[0]], y[shared[0]]
    run = max(1, min(_RUN, min(len(p), len(q)) // 3))
    if {p[i : i + run] for i in range(len(p) - run + 1)}.isdisjoint(q[i : i + run] for i in range(len(q) - run + 1)):
        return 0.0
    return 2 * common_length(p, q) / (len(p) + len(q))


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(fingerprint, batch.column("text").to_pylist())), pa.string())], ["doc_id", "fingerprint"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _in_order(df: DataFrame) -> DataFrame:
    """Texts dealt to ranges of doc_id, each range in order and followed by the first document of the
    next range (`ahead`), the last range by the very first document."""
    docs = df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    width = shuffle_width(df.sparkSession)
    ids = docs.select("doc_id", place.alias("place"))
    inner = [p for p in ids.approxQuantile("place", [k / width for k in range(1, width)], 0.1 / width) if p > float("-inf")]
    deal = Bucketizer(splits=[float("-inf"), *sorted({*inner} or {0.0}), float("inf")], inputCol="place", outputCol="bucket")
    # one row for each range: as many as the shuffle has partitions
    firsts = sorted((int(r["bucket"]), r["first"]) for r in deal.transform(ids).groupBy("bucket").agg(F.expr("min(struct(doc_id)).doc_id").alias("first")).collect())
    docs = deal.transform(docs.withColumn("place", place)).withColumn("bucket", F.col("bucket").cast("int"))
    heads = df.sparkSession.createDataFrame([(bucket, first, firsts[k - 1][0]) for k, (bucket, first) in enumerate(firsts)], "bucket int, first long, to int")
    is_first = (docs["bucket"] == heads["bucket"]) & docs["doc_id"].eqNullSafe(heads["first"])
    docs = docs.join(F.broadcast(heads), is_first, "left").select("doc_id", "text", docs["bucket"], "to")
    places = F.array_compact(F.array(F.struct(F.col("bucket").alias("at"), F.lit(False).alias("ahead")), F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("at"), F.lit(True).alias("ahead")))))
    dealt = docs.select("doc_id", "text", F.explode(places).alias("p")).select("p.at", "p.ahead", "doc_id", "text")
    return dealt.repartitionById(width, F.col("at")).sortWithinPartitions("at", "ahead", "doc_id", "text")


def compare_with_next(df: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: each
    document against itself with its last half replaced by the start of the next document, and against
    that next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # range, doc_id, text, fingerprint
        for batch in batches:
            rows = []
            for at, ahead, doc, text in zip(*(batch.column(c).to_pylist() for c in ("at", "ahead", "doc_id", "text")), strict=True):
                if held and held[0] == at:
                    own = fingerprint(text)
                    rows.append(compare(*held[1:], text, own))
                    held = None if ahead else (at, doc, text, own)
                elif not ahead:
                    held = (at, doc, text, fingerprint(text))
            yield pa.RecordBatch.from_pylist(rows, schema)

    def compare(doc: int, text: str, own: str, following: str, its: str) -> dict:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = fingerprint(edited)
        return {"doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": own, "edited_fingerprint": changed, "near_edited": likeness(own, changed), "near_next": likeness(own, its)}

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return _in_order(df).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
