"""Which 64-bit hashes occur at least twice: a bit table of bounded size, or rows beyond that."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import Bits, places

_PARTS = 6  # log2 of the parts that a table is built in


#: log2 of the bits of the largest table (64 MB).
LARGEST = 29


def repeated(df: DataFrame, column: str, count: str, largest: int | None = None, sparse: int = 16) -> tuple[Bits | None, DataFrame]:
    """df: hashes with how often each was met. Those met twice or more in all, as a table of at most 2^largest
    bits, else of `sparse` bits for each, and as rows (column). A table that would be fuller than one bit in
    three is not made: beyond that size, callers look the hashes up by a join on the rows."""
    largest = largest or LARGEST
    sums = df.groupBy(column).agg(F.sum(count).alias("n")).filter("n > 1").select(column)
    sums = materialize(sums, "repeated")
    n = sums.count()
    log2 = min(largest, max(16, (sparse * max(1, n) - 1).bit_length()))
    if 2 * n > 2**log2 // 3:
        return None, sums

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.unique(np.concatenate(places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), log2)))
            part = (spots >> np.uint64(log2 - _PARTS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array((spots & np.uint64(2 ** (log2 - _PARTS) - 1)).astype(np.int64))], ["part", "spot"])

    def build(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(2 ** (log2 - _PARTS), np.uint8)
        for t in tables:
            bits[t.column("spot").to_numpy(zero_copy_only=False)] = 1
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    made = sums.mapInArrow(spread, "part int, spot long").groupBy("part").applyInArrow(build, "part int, bits binary")
    table = np.zeros(2**log2 // 8, np.uint8)
    width = len(table) >> _PARTS
    for row in made.collect():  # 64 parts of 1 MB at most
        table[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return Bits(table, log2), sums
