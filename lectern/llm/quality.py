"""Quality of documents by positive-unlabelled learning (operator 12).

Texts with a good label are trusted positives; every other text is unlabelled, whatever its own label says. Three
steps, on a bounded sample of rows outside the held-out ones: each of some forty figures of a text (kinds of
characters, repeated words and lines, lengths) is cut into bins at the quantiles of the unlabelled sample, so that a
model is a sum of one weight for each figure's bin; the class prior is the least ratio of the unlabelled
to the positive share above a score that tells one from the other, taken on halves that the score was not learned
from and where that ratio is known best; and the weights minimise the non-negative unbiased risk
    prior * R(positive as good) + max(0, R(unlabelled as bad) - prior * R(positive as bad))
with logistic loss, by gradient steps that go back up where the second part falls below zero.

Learning is bounded by `sample` positives and as many unlabelled rows, dealt by a hash of the id; scores read every
whole text. Exact copies are learned from once.

Nulls and edge cases: null and empty texts have figures of zero and get their score; labels that are null or not 1
are unlabelled; without a trusted positive every score is a half. A null doc_id is kept and not learned from;
repeated rows get equal scores; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hashes, slices

#: ASCII characters whose share of a text is a figure each.
MARKS = ".,!?|#$%&*:;()\"-/@_=+<>[]{}~^'"
#: Quantiles of the unlabelled sample at which a figure is cut.
CUTS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)
NAMES = ["letters", "upper", "digits", "spaces", "others", "repeated_words", "distinct_words", "commonest_word", "repeated_lines", "ended_lines", "words", "word_length", "lines_a_word", *MARKS]
_CHUNK = 1 << 20
_LETTER, _UPPER, _DIGIT, _SPACE, _OTHER = range(5)


def _kinds() -> np.ndarray:
    """Kind of each character of the basic plane; those beyond it count as others."""
    out = np.full(1 << 16, _OTHER, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        out[i] = _UPPER if c.isupper() else _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else _OTHER
    return out


_TABLE: list[np.ndarray] = []


def _characters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """How many characters of each kind and of each ASCII one a text has, a piece at a time."""
    if not _TABLE:
        _TABLE.append(_kinds())
    kinds, ascii_ = np.zeros(5, np.int64), np.zeros(128, np.int64)
    for at in range(0, len(text), _CHUNK):
        codes = np.frombuffer(text[at : at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(codes, 0xFFFF)
        kinds += np.bincount(_TABLE[0][low], minlength=5)
        ascii_ += np.bincount(np.minimum(codes, 128), minlength=129)[:128]
    return kinds, ascii_


def figures(texts: list[str | None]) -> np.ndarray:
    """texts x NAMES, over whole texts."""
    out = np.zeros((len(texts), len(NAMES)))
    found, counts = hashes(texts, lower=False)
    ends = np.cumsum(counts)
    for i, text in enumerate(texts):
        if not text:
            continue
        words = found[ends[i] - counts[i] : ends[i]]
        kinds, ascii_ = _characters(text)
        n, size, letters = max(1, len(words)), len(text), max(1, int(kinds[_LETTER] + kinds[_UPPER]))
        each = np.unique(words, return_counts=True)[1]
        lines = text.split("\n")
        own = [s for x in lines if (s := x.rstrip())]
        ended = sum(x.endswith((".", "!", "?")) for x in own)
        row = [(kinds[_LETTER] + kinds[_UPPER]) / size, kinds[_UPPER] / letters, kinds[_DIGIT] / size, kinds[_SPACE] / size, kinds[_OTHER] / size,
               np.count_nonzero(words[1:] == words[:-1]) / n, len(each) / n, (each.max() if len(each) else 0) / n, 1 - len({*own}) / max(1, len(own)), ended / max(1, len(own)),
               math.log1p(len(words)), (size - kinds[_SPACE]) / n, len(lines) / n]
        out[i] = row + [ascii_[ord(c)] / size for c in MARKS]
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    cuts: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))  # of the constant, then of each figure's bins
    prior: float = 0.5

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The places of each row's weights."""
        at, out = 1, np.zeros((len(x), len(self.cuts) + 1), np.int32)
        for j, cuts in enumerate(self.cuts):
            out[:, j + 1] = at + np.searchsorted(cuts, x[:, j], side="right")
            at += len(cuts) + 1
        return out

    @property
    def size(self) -> int:
        return 1 + sum(len(c) + 1 for c in self.cuts)

    def indicators(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.size), np.float32)
        np.put_along_axis(out, self.bins(x), 1, axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[self.bins(x)].sum(1))


def risk(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """prior R(positive as good), R(unlabelled as bad) - prior R(positive as bad), and their gradients."""
    p, u = positive @ weights, unlabelled @ weights
    good = prior * np.logaddexp(0, -p).mean()
    bad = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    at_p, at_u = _sigmoid(p), _sigmoid(u)
    up = prior / len(positive) * (positive.T @ (at_p - 1))
    return float(good), float(bad), up, unlabelled.T @ at_u / len(unlabelled) - prior / len(positive) * (positive.T @ at_p)


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, penalty: float = 1e-3, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights of the least non-negative risk, by Adam over all rows at once."""
    w = np.zeros(positive.shape[1], np.float32)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        _, bad, up, down = risk(w, positive, unlabelled, prior)
        # Where the part of the bad ones is negative, it is overfitted: back up, by that part alone.
        g = (up + down if bad >= 0 else -down) + penalty * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w = (w - rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return w.astype(float)


def _telling(positive: np.ndarray, unlabelled: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights that tell positives from unlabelled rows, both counting alike, by Newton steps."""
    x = np.vstack([positive, unlabelled])
    y = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    share = np.r_[np.full(len(positive), 0.5 / len(positive)), np.full(len(unlabelled), 0.5 / len(unlabelled))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ w)
        curve = (x * (share * p * (1 - p))[:, None].astype(np.float32)).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (share * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The prior by scores of either: the unlabelled over the positive share above a score, where an upper bound
    of that ratio is least."""
    cuts = np.unique(np.r_[positive, unlabelled])
    above_p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    some = above_p > 0
    slack = sum(math.sqrt(math.log(4 / doubt) / 2 / len(x)) for x in (positive, unlabelled))
    ratio = above_u[some] / above_p[some]
    return float(min(1.0, ratio[np.argmin(ratio + slack / above_p[some])]))


def fit(positive: np.ndarray, unlabelled: np.ndarray, half_p: np.ndarray, half_u: np.ndarray) -> Model:
    """A model of figures; half_p and half_u deal the rows to two halves."""
    if not len(positive) or not len(unlabelled):
        return Model()
    model = Model([np.unique(np.quantile(unlabelled[:, j], CUTS)) for j in range(unlabelled.shape[1])])
    p, u = model.indicators(positive), model.indicators(unlabelled)
    ratios = []
    for side in (True, False):
        own_p, own_u = half_p == side, half_u == side
        if own_p.any() and own_u.any() and not own_p.all() and not own_u.all():
            w = _telling(p[own_p], u[own_u])
            ratios.append(least_ratio(p[~own_p] @ w, u[~own_u] @ w))
    model.prior = min(0.98, max(0.02, float(np.mean(ratios)))) if ratios else 0.5
    model.weights = minimise(p, u, model.prior)
    return model


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _part(rows: DataFrame, sample: int, salt: int):
    """Whether a row is in a sample of about `sample` rows at most, by a hash of its id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(min(1.0, sample / max(1, rows.count())) * 1_000_000)


def learn_from(documents: DataFrame, labels: DataFrame, sample: int = 10_000) -> Model:
    """Learn from the documents outside the held-out rows. sample: positives, and unlabelled rows, at most (about).
    What is broadcast to the documents, and what the figures of come back, is bounded by it."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.col("doc_id").isNotNull() & ~held_out())
    good = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter(F.col("doc_id").isNotNull() & ~held_out() & (F.col("quality") == 1)).select("doc_id").distinct()
    good = F.broadcast(good.filter(_part(good, sample, 1)).withColumn("good", F.lit(True)))
    marked = docs.join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"), _part(docs, sample, 2).alias("seen")).filter("good OR seen")
    once = marked.groupBy("text").agg(F.bool_or("good").alias("good"), F.bool_or("seen").alias("seen"), F.min("doc_id").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = figures(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("seen"), batch.column("half"), pa.array(found.tolist(), pa.list_(pa.float64()))], ["good", "seen", "half", "x"])

    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = once.select("text", "good", "seen", half.alias("half"), "doc_id").mapInArrow(run, "good boolean, seen boolean, half boolean, x array<double>").toArrow()  # twice `sample` rows at most
    x = np.array(rows.column("x").to_pylist()).reshape(rows.num_rows, len(NAMES))
    x = x[order := np.lexsort(x.T)] if rows.num_rows else x  # the order in which rows come does not matter
    flags = [np.array(rows.column(c).to_pylist(), bool)[order] if rows.num_rows else np.zeros(0, bool) for c in ("good", "seen", "half")]
    return fit(x[flags[0]], x[flags[1]], flags[2][flags[0]], flags[2][flags[1]])


def score(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(figures(batch.column("text").to_pylist())))], ["doc_id", "score"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
