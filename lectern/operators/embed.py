"""Vectors of texts of any length: windows of tokens, each embedded and normalised, averaged by their tokens and
normalised again, so that nothing is cut off."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Fixed value: the tokens of a window, at most.
WINDOW = 480
#: Windows that a model is given at once, and about as many words as the built-in embedder counts at once.
AT_ONCE, WORDS = 16, 500_000


class Hashed:
    """The built-in embedder: words are dealt to dimensions by the first eight hex digits of their MD5 and counted.
    Remembers the words it has met, up to a bound in characters."""

    def __init__(self, dimensions: int, room: int = 8 << 20):
        self.dimensions, self.room, self.left = dimensions, room, room
        self.known: dict[str, int] = {}

    def places(self, words: list[str]) -> list[int]:
        known, found = self.known, []
        for w in words:
            if (place := known.get(w)) is None:
                place = self._place(w)
                self.left -= len(w) + 64
                if self.left < 0:
                    known.clear()
                    self.left = self.room
                known[w] = place
            found.append(place)
        return found

    def _place(self, word: str) -> int:
        return int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:4]) % self.dimensions

    def pooled(self, words: pa.Array, sizes: np.ndarray, window: int) -> np.ndarray:
        """The vectors of rows of so many words each, one at least; all windows are counted at once, and every word is
        looked up once."""
        windows = -(-sizes // window)
        starts = np.cumsum(windows) - windows
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(starts, sizes) + within // window
        coded = words.dictionary_encode()
        places = np.array(self.places(coded.dictionary.to_pylist()))[coded.indices.to_numpy(zero_copy_only=False)]
        counts = np.bincount(at * self.dimensions + places, minlength=windows.sum() * self.dimensions).reshape(-1, self.dimensions).astype(float)
        return _unit(np.add.reduceat(_unit(counts) * counts.sum(1)[:, None], starts))


def embed_words(rows: DataFrame, key: str | list[str], words: Column, dimensions: int, window: int = WINDOW) -> DataFrame:
    """The key columns, and embedding (array<double>, unit length), of every row with words, by the built-in
    embedder. words: a text of words with one space between them. Rows stay where they are."""
    own = rows.select(*([key] if isinstance(key, str) else key), words.alias("_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Hashed(dimensions)
        for batch in batches:
            texts = batch.column("_words")
            parts, kept, begin = [np.zeros((0, dimensions))], [np.zeros(0, np.int64)], 0
            sums = np.cumsum(pc.add(pc.fill_null(pc.count_substring(texts, " "), 0), 1).to_numpy(zero_copy_only=False).astype(np.int64))
            while begin < len(texts):  # about WORDS words at a time
                end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + WORDS, "right")))
                lists = pc.split_pattern(pc.fill_null(texts.slice(begin, end - begin), ""), " ")
                words, owners = lists.flatten(), pc.list_parent_indices(lists)
                full = pc.not_equal(words, "")
                sizes = np.bincount(owners.filter(full).to_numpy(zero_copy_only=False), minlength=end - begin)
                if sizes.any():
                    parts.append(model.pooled(words.filter(full), sizes[sizes > 0], window))
                    kept.append(begin + np.flatnonzero(sizes))
                begin = end
            found = np.concatenate(parts)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * dimensions, pa.int32()), pa.array(found.ravel()))
            rows = batch.drop_columns("_words").take(pa.array(np.concatenate(kept)))
            yield pa.RecordBatch.from_arrays([*rows.columns, vectors], [*rows.schema.names, "embedding"])

    return own.mapInArrow(run, StructType([*own.drop("_words").schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


Tokenizer = Callable[[str], list[tuple[int, int]]]
Encoder = Callable[[list[str]], np.ndarray]


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled by their largest component first. A row that has none is an error."""
    top = np.abs(v).max(axis=-1, keepdims=True)
    if not np.isfinite(v).all() or (top == 0).any():
        raise ValueError("a model gave a vector that is zero or not finite")
    v = v / top
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


def embed_texts(rows: DataFrame, key: str, text: str, load: Callable[[], tuple[Tokenizer, Encoder]], dimensions: int, window: int = WINDOW) -> DataFrame:
    """key, embedding (array<double>) by a model. load() gives a tokenizer, whose tokens are (begin, end) places of a
    text, and an encoder of texts; each task calls it once. Windows of all rows of a batch are encoded
    together, AT_ONCE at a time. Null and blank texts, and those without tokens, have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, encode = load()
        for batch in batches:
            places, windows, weights, owners = [], [], [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                tokens = tokenize(body) if body and body.strip() else []
                for at in range(0, len(tokens), window):
                    part = tokens[at : at + window]
                    windows.append(body[part[0][0] : part[-1][1]])
                    weights.append(len(part))
                    owners.append(len(places))
                if tokens:
                    places.append(i)
            sums = np.zeros((len(places), dimensions))
            for at in range(0, len(windows), AT_ONCE):
                made = np.asarray(encode(windows[at : at + AT_ONCE]), float)
                if made.shape != (len(windows[at : at + AT_ONCE]), dimensions):
                    raise ValueError("a model gave another number of vectors or dimensions")
                np.add.at(sums, owners[at : at + AT_ONCE], _unit(made) * np.array(weights[at : at + AT_ONCE])[:, None])
            found = _unit(sums) if len(places) else sums
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(found.tolist(), pa.list_(pa.float64()))], [key, "embedding"])

    own = rows.select(key, F.col(text).cast("string"))
    return own.mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, embedding array<double>")
