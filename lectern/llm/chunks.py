"""Tokenization of whole texts, chunk by chunk, in columns.

A subword tokenizer that first splits a text into words gives the ids of a text as the ids of its
chunks one after another, if chunks only break where the tokenizer breaks as well. Texts repeat their
words: the chunks of a slice of texts are numbered, only distinct ones are encoded, and the ids of the
texts are gathered by number. Chunks met before are remembered, as columns within a bound in bytes; long
ones, which hardly come again, are not. `clear` gives the memory back at the end of a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of any kind, for RE2 and for Python.
_ANY_WHITE = r"[\s\pZ\x0b\x1c-\x1f\x{85}]"
#: A space between two others: no break of the byte-level split pattern.
_INNER_SPACE = f"{_ANY_WHITE} {_ANY_WHITE}"
#: A space between two that are not white space always is one.
_SURE_BREAK = re.compile(r"(?<=\S)(?= \S)")
_LONG = 64


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches values[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class Remembered:
    """Ids of strings. Those that are new come from encode_many (flat ids, and how many each has) and are
    remembered. Beyond `limit` bytes only the half that was met last is kept."""

    def __init__(self, encode_many: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 32 << 20):
        self.encode_many, self.limit = encode_many, limit
        self.clear()

    def clear(self) -> None:
        self.strings = pa.array([], pa.string())
        self.flat = np.empty(0, np.uint32)
        self.sizes = np.empty(0, np.int64)
        self.last = np.empty(0, np.int64)  # the call that met it last
        self.calls = 0

    def ids(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """strings: without repeats. Some ids, and where those of each string begin and how many they are."""
        self.calls += 1
        at = pc.index_in(strings, value_set=self.strings)
        new = strings.filter(at.is_null())
        found, n = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64), len(self.strings)
        self.last[found[at.is_valid().to_numpy(zero_copy_only=False)]] = self.calls
        if len(new):
            found[at.is_null().to_numpy(zero_copy_only=False)] = n + np.arange(len(new))
            flat, sizes = self.encode_many(new.to_pylist())
            self.strings = pa.concat_arrays([self.strings, new])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            self.last = np.concatenate([self.last, np.full(len(new), self.calls)])
        ids, starts, own = self.flat, (np.cumsum(self.sizes) - self.sizes)[found], self.sizes[found]
        self._trim(n)
        return ids, starts, own

    def _trim(self, n: int) -> None:
        """n: how many of the strings are not new."""
        keep = np.ones(len(self.strings), bool)
        keep[n:] = pc.binary_length(self.strings[n:]).to_numpy(zero_copy_only=False) <= _LONG
        if self.strings.nbytes + 4 * len(self.flat) + 16 * len(self.sizes) > self.limit:
            order = np.argsort(-self.last, kind="stable")
            keep[order[len(order) // 2 :]] = False
        if not keep.all():
            self.flat = gather(self.flat, (np.cumsum(self.sizes) - self.sizes)[keep], self.sizes[keep])
            self.strings, self.sizes, self.last = self.strings.filter(pa.array(keep)), self.sizes[keep], self.last[keep]


class Pieces:
    """Ids of chunks that are cut into pieces by `cut`, of which piece_ids gives the ids. Chunks for which cut
    gives None go to `whole`, all at once."""

    def __init__(self, cut: Callable[[str], list[str] | None], piece_ids: Callable[[str], list[int]], whole: Callable[[list[str]], list[list[int]]] | None = None, limit: int = 16 << 20):
        self.cut, self.piece_ids, self.whole = cut, piece_ids, whole
        self.known = Remembered(self._encode, limit)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat(list(map(self.piece_ids, pieces)))

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = list(map(self.cut, chunks))
        odd = [k for k, x in enumerate(lists) if x is None]
        found = _dictionary(pa.array([x or [] for x in lists], pa.list_(pa.string())))
        flat, sizes = joined(*self.known.ids(found[0]), *found[1:])
        if odd:
            more, lengths = _flat(self.whole([chunks[k] for k in odd]))
            starts = np.cumsum(sizes) - sizes
            starts[odd], sizes[odd] = len(flat) + np.cumsum(lengths) - lengths, lengths
            flat = gather(np.concatenate([flat, more]), starts, sizes)
        return flat, sizes


class ChunkEncoder:
    """Ids of whole texts. drops_white_space: whether white space only separates words; otherwise a chunk
    begins at each space, as the byte-level pattern ` ?\\p{L}+| ?\\p{N}+|...|\\s+(?!\\S)|\\s+` breaks there too.
    Texts with white-space runs for which that does not hold break only at spaces between two other characters."""

    def __init__(self, pieces: Pieces, drops_white_space: bool):
        self.pieces, self.drops_white_space = pieces, drops_white_space
        self.known = Remembered(pieces, limit=32 << 20)

    def clear(self) -> None:
        self.known.clear()
        self.pieces.known.clear()

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; a null text is empty. end_id: comes
        after each text."""
        chunks, numbers, counts = self._numbered(pc.fill_null(texts, ""))
        ids, starts, sizes = self.known.ids(chunks)
        if end_id is not None:
            numbers = np.insert(numbers, np.cumsum(counts), len(chunks))
            starts, sizes, counts = np.append(starts, len(ids)), np.append(sizes, 1), counts + 1
            ids = np.append(ids, np.uint32(end_id))
        return joined(ids, starts, sizes, numbers, counts)

    def _numbered(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks, the numbers of all chunks of all texts, and how many each text has."""
        if self.drops_white_space:
            return _dictionary(pc.ascii_split_whitespace(texts))
        odd = pc.match_substring_regex(texts, _INNER_SPACE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        first = lists.offsets.to_numpy(zero_copy_only=False)[:-1]
        # every piece but the first of a text has its space
        spaced = np.ones(len(lists.flatten()), bool)
        spaced[first - (first[0] if len(first) else 0)] = False
        pieces = pc.binary_join_element_wise(pc.if_else(pa.array(spaced), " ", ""), lists.flatten(), "")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)), pieces)
        if not odd.any():
            return _dictionary(lists)
        others = pa.array([_SURE_BREAK.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        order = np.argsort(np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), kind="stable")
        return _dictionary(pa.concat_arrays([lists, others]).take(pa.array(order)))


def joined(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lists of numbered strings one after another, and how many each list of `counts` strings has."""
    own = sizes[numbers]
    sums, ends = np.concatenate([[0], np.cumsum(own)]), np.cumsum(counts)
    return gather(ids, starts[numbers], own), sums[ends] - sums[ends - counts]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array(list(chain.from_iterable(lists)), np.uint32), np.array(list(map(len, lists)), np.int64)


def _dictionary(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct values, the number of each value, and the lists' lengths."""
    counts = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts
