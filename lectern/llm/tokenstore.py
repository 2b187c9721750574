"""Token-id output in fixed-width bit packing (operator 8).

A store is a folder of Parquet files; a row is one block: the documents of a range of doc_ids in
ascending order, every id in the fewest bits that the vocabulary needs. The payload of a block is

    magic "TKB1" | bits uint32 | documents uint32 | ids uint64 | doc_id int64[] | end offset uint64[] | bits

so a reader finds a document by its offset and unpacks any slice of ids with numpy alone. Columns
beside the payload (part, block, first_doc, last_doc, n_tokens, start_in_part) let Spark skip files
and row groups, and give the place of every id in the whole store.

Nulls and edge cases: a null or empty text is one end id; null doc_ids sort first and are kept; rows
that repeat a doc_id follow one another, in the order of their texts; an empty table gives an empty
store; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_dir, shuffle_width
from .tokens import encoder
from .words import slices

_HEAD = struct.Struct("<4sIIQ")
_NULL_ID = -(1 << 63)
STORE = "part int, block int, first_doc long, last_doc long, n_docs int, n_tokens long, start_in_part long, payload binary"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another, least bit first. An id that needs more bits is an error."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of 8 ids ends at a whole byte
        part = ids[at : at + (1 << 16)].astype("<u4")
        own = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=bits)
        out.append(np.packbits(own.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(packed: bytes | memoryview, bits: int, start: int, count: int) -> np.ndarray:
    """Ids start .. start + count - 1, reading only their own bytes."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(packed, dtype=f"<u{width}", count=count, offset=start * width).astype(np.uint32)
    at = (start + np.arange(count, dtype=np.int64)) * bits
    low = start * bits // 8
    own = np.frombuffer(packed, dtype=np.uint8)[low : (start + count) * bits // 8 + 9]
    own = np.concatenate([own, np.zeros(9, np.uint8)])
    byte, off = at // 8 - low, (at % 8).astype(np.uint64)
    value = np.zeros(count, dtype=np.uint64)
    for k in range((bits + 7) // 8 + 1):
        value |= own[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> off) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def block_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    head = _HEAD.pack(b"TKB1", bits, len(doc_ids), len(ids))
    return head + doc_ids.astype("<i8").tobytes() + np.cumsum(lengths).astype("<u8").tobytes() + pack(ids, bits)


class Block:
    """A reader of one payload."""

    def __init__(self, payload: bytes):
        magic, self.bits, n, self.n_tokens = _HEAD.unpack_from(payload)
        if magic != b"TKB1":
            raise ValueError("not a block of token ids")
        self.doc_ids = np.frombuffer(payload, "<i8", n, _HEAD.size)
        self.ends = np.frombuffer(payload, "<u8", n, _HEAD.size + 8 * n).astype(np.int64)
        self.packed = memoryview(payload)[_HEAD.size + 16 * n :]

    def document(self, k: int) -> np.ndarray:
        start = int(self.ends[k - 1]) if k else 0
        return unpack(self.packed, self.bits, start, int(self.ends[k]) - start)


def write_store(df: DataFrame, path: str, tokenizer_path: str, vocabulary: int | None = None, end_id: int = 0, block_tokens: int = 1 << 20, partitions: int | None = None) -> None:
    """Encode every text of df (doc_id, text) and write the store in ascending doc_id order. Texts move
    once, to ranges of doc_id; their ids never do. A block closes at block_tokens ids. vocabulary: how many
    ids there are; the tokenizer's own number if none is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, block, start, size = encoder(tokenizer_path, False), TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # doc_ids, numbers of ids, ids
        bits = bits_for(max(vocabulary or own.vocabulary, end_id + 1))

        def close() -> pa.RecordBatch:
            docs, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            payload = block_bytes(docs, counts, ids, bits)
            first, last = (None if x == _NULL_ID else int(x) for x in (docs[0], docs[-1]))
            row = {"part": part, "block": block, "first_doc": first, "last_doc": last, "n_docs": len(docs), "n_tokens": len(ids), "start_in_part": start, "payload": payload}
            return pa.RecordBatch.from_pylist([row], schema)

        try:
            for piece in slices(batches, 4096, 4 << 20):
                ids, counts = own.encode(piece.column("text"), end_id)
                ends = np.cumsum(counts)
                doc_ids = pc.fill_null(piece.column("doc_id"), _NULL_ID).to_numpy(zero_copy_only=False)
                at = 0
                while at < len(doc_ids):  # documents up to the one that fills the block
                    base = int(ends[at - 1]) if at else 0
                    upto = min(len(doc_ids), 1 + int(np.searchsorted(ends, base + block_tokens - size)))
                    held.append((doc_ids[at:upto], counts[at:upto], ids[base : ends[upto - 1]].astype("<u4")))
                    size += int(ends[upto - 1]) - base
                    at = upto
                    if size >= block_tokens:
                        yield close()
                        held, block, start, size = [], block + 1, start + size, 0
            if held:
                yield close()
        finally:
            own.clear()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("start_in_part", pa.int64()), ("payload", pa.binary())])
    n = partitions or shuffle_width(df.sparkSession)
    ordered = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, STORE).write.option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: doc_id, start (ids of all documents before it), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, payload = (batch.column(c)[row].as_py() for c in ("part", "start_in_part", "payload"))
                block = Block(payload)
                ids = unpack(block.packed, block.bits, 0, block.n_tokens)
                offsets = np.concatenate([[0], block.ends])
                n = len(block.doc_ids)
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(block.doc_ids, mask=block.doc_ids == _NULL_ID), pa.array(offsets[:-1] + start), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "start", "ids"])

    store = spark.read.schema(T._parse_datatype_string(STORE)).parquet(path)
    # as many rows as the store has parts, which its writer chose
    ends = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    bases = ends.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    docs = store.select("part", "start_in_part", "payload").mapInArrow(run, "part int, doc_id long, start long, ids array<int>")
    return docs.join(F.broadcast(bases), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "ids")


def digest(docs: DataFrame) -> DataFrame:
    """n_tokens and the checksum of each document's ids as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<i4").tobytes())
            ends = 4 * np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array((ends - starts) // 4), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return docs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lectern-tokens-{uuid.uuid4().hex}"
