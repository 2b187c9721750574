"""Byte-level BPE encoding and decoding with a segment tree (operator 6).

Each pre-token is merged on a segment tree over its byte positions. A leaf holds the rank of the pair
that starts at this position, joined with the position itself, so the root is the leftmost pair of
least rank. A merge changes at most three leaves (the merged part, its live left neighbour, the part
that died), each a logarithmic point update: a pre-token of n bytes takes O(n log n), however long.

Nulls and edge cases: a null or empty text has no ids and decodes to no bytes; a null doc_id is kept;
repeated rows give repeated results; other columns of the input are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, Pieces
from .words import slices

_NONE = 1 << 62


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the leftmost pair of least rank until no pair has a rank."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    if n < 2:
        return [ranks[piece]] if n else []
    shift = n.bit_length()
    mask = (1 << shift) - 1
    size = 1 << (n - 1).bit_length()
    after = list(range(1, n + 1))  # where the live part that starts here ends, and the next one starts
    before = list(range(-1, n - 1))
    get = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << shift | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    while (top := tree[1]) != _NONE:
        i = top & mask
        dead = after[i]
        end = after[i] = after[dead]
        left, joined, before_joined = before[i], _NONE, _NONE
        if end < n:
            before[end] = i
            if (r := get(piece[i : after[end]])) is not None:
                joined = r << shift | i
        if left >= 0 and (r := get(piece[left:end])) is not None:
            before_joined = r << shift | left
        for leaf, value in ((dead, _NONE), (i, joined), (left, before_joined)):
            if leaf < 0:
                continue
            k = size + leaf
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:  # the least of both children, up to where nothing changes
                other = tree[k ^ 1]
                k >>= 1
                if other < value:
                    value = other
                if tree[k] == value:
                    break
                tree[k] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class BytePairCodec(ChunkEncoder):
    """A rank file (base64 of the bytes, then the rank, in each line) and the pattern that splits texts."""

    def __init__(self, rank_path: str, pattern: str):
        with open(rank_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        super().__init__(Pieces(regex.compile(pattern).findall, self._piece, limit=32 << 20), drops_white_space=False)

    def _piece(self, piece: str) -> list[int]:
        return merge_ranks(piece.encode("utf-8", "surrogatepass"), self.ranks)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def codec(rank_path: str, pattern: str) -> BytePairCodec:
    """One for each worker process."""
    return BytePairCodec(rank_path, pattern)


def encode(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        try:
            for part in slices(batches, 4096, 4 << 20):
                ids, counts = own.encode(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))], ["doc_id", "ids"])
        finally:
            own.known.clear()  # merged pieces stay for the next task, within their bound

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                decoded = [own.decode(flat[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """Digest columns of encoded and decoded documents."""
    listed = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
