"""Toxicity of documents: misspelled lexicon terms in context (operator 3).

Training (on labelled rows; `sample` of them at most, a documented bound): words and word beginnings
that occur in toxic documents far more often than in others form a lexicon, all that have enough
evidence. Every term may be misspelled: it is found within its allowed distance (none below five letters,
one from five, two from nine), whole words by the whole word and beginnings by the word's beginning. The terms
are a trie that the Levenshtein automata of many words walk together, a few bit operations a letter; a
word leaves a branch where its automaton dies. A task looks up each distinct word once, as far as it remembers them.

Scoring: each matched word has a weight learned for its term and distance. A window around each match
adds up the weights near it; a match within quotation marks or behind a reporting phrase counts apart,
so quotation can be told from abuse. A logistic regression over these few sums gives the score.

Nulls and edge cases: null and empty texts get the score of a document without matches; labels that are
null, or not 0 or 1, are not learned from; without labelled rows of both kinds every score is the
smoothed share of toxic rows, and nothing is rejected. A null doc_id is kept; repeated rows get equal scores; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import slices

_WORD = re.compile(r"[^\W_]+")
_QUOTES = '"“”«»„'
#: Words that announce somebody else's words, as plain English ones.
_REPORTING = frozenset("said says wrote writes called calls quoted quote quotes quoting term word insult insulted slur".split())
_SPAN = 8
#: Texts, and about how much of them, whose words are looked up together.
_ROWS, _BYTES = 4096, 4 << 20
N_FEATURES = 8


def allowed(length: int) -> int:
    """Edits that a term of this length may be away."""
    return 0 if length < 5 else 1 if length < 9 else 2


class _Node:
    """A place of the lexicon trie: what leads on from it, and the term or beginning that ends here."""

    __slots__ = ("children", "edits", "term", "whole", "begins")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        self.edits = 0  # most edits of any term from here on
        self.term, self.whole, self.begins = None, False, False


class Automaton:
    """terms: whole words; stems: beginnings of words. match(word) is (term, distance) or None: the shortest
    beginning that the word has exactly, or else the nearest term or beginning, the first of several in order.

    The lexicon is a trie, walked once for many words together. Each word is a Levenshtein automaton: for 0, 1 and 2
    edits, a number whose bits are the beginnings of the word that the letters walked so far may stand for. A
    branch is left by the words whose automaton has died there, so few words are left on most of it."""

    #: Letters of a word that count; no term is longer than that less its edits.
    LETTERS = 62
    #: Words that walk the trie together.
    TOGETHER = 20_000

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms, self.stems = frozenset(terms), frozenset(stems)
        self.lengths = sorted({len(t) for t in self.stems})
        self.root = _Node()
        for t in sorted(self.terms | self.stems):
            k = allowed(len(t))
            if not k or len(t) + k > self.LETTERS:
                continue  # such a one is only met exactly
            at = self.root
            at.edits = max(at.edits, k)
            for c in t:
                at = at.children.setdefault(c, _Node())
                at.edits = max(at.edits, k)
            at.term, at.whole, at.begins = t, t in self.terms, t in self.stems

    def match(self, word: str) -> tuple[str, int] | None:
        return self.match_all([word])[0]

    def match_all(self, words: list[str]) -> list[tuple[str, int] | None]:
        out: list[tuple[str, int] | None] = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            n = next((n for n in self.lengths if word[:n] in self.stems), None)
            if n is not None:
                out[i] = (word[:n], 0)
            elif word in self.terms:
                out[i] = (word, 0)
            else:
                rest.append(i)
        for at in range(0, len(rest), self.TOGETHER):
            own = rest[at : at + self.TOGETHER]
            for i, found in zip(own, self._walk([words[i] for i in own]), strict=True):
                out[i] = found
        return out

    def _walk(self, words: list[str]) -> list[tuple[str, int] | None]:
        if not words or not self.root.children:
            return [None] * len(words)
        n, one = len(words), np.uint64(1)
        length = np.array([min(len(w), self.LETTERS + 1) for w in words])
        letters = np.array([w[: self.LETTERS].replace("\0", "\ue000") for w in words], f"<U{self.LETTERS}").view(np.uint32).reshape(n, self.LETTERS)
        power = one << np.arange(1, self.LETTERS + 1, dtype=np.uint64)
        shown = np.minimum(length, self.LETTERS).astype(np.uint64)
        full = (one << (shown + one)) - one
        last = np.where(length <= self.LETTERS, one << shown, np.uint64(0))  # the bit of the whole word
        masks: dict[str, np.ndarray] = {}

        def mask(c: str) -> np.ndarray:
            """Where each word has a letter."""
            if c not in masks:
                masks[c] = (letters == np.uint32(ord(c))) @ power
            return masks[c]

        best, ends = np.full(n, 3, np.int8), np.full(n, -1)
        named: list[str] = []
        begin = [np.full(n, (2 << k) - 1, np.uint64) & full for k in range(3)]
        # Branches in the reverse order of letters, so that they are taken in order.
        stack = [(c, child, np.arange(n), begin) for c, child in sorted(self.root.children.items(), reverse=True)]
        while stack:
            c, node, who, before = stack.pop()
            all_of, same = full[who], mask(c)[who]
            now = [(before[0] << one) & same]
            for k in range(1, node.edits + 1):
                # a letter as it stands; left out, exchanged; and a letter more
                now.append((((before[k] << one) & same) | before[k - 1] | (before[k - 1] << one) | (now[k - 1] << one)) & all_of)
            alive = np.flatnonzero(now[-1])
            if not len(alive):
                continue
            who, now = who[alive], [r[alive] for r in now]
            if node.term is not None:
                named.append(node.term)
                for k in range(min(allowed(len(node.term)), node.edits), -1, -1):
                    hit = np.zeros(len(who), bool)
                    if node.whole:
                        hit |= (now[k] & last[who]) != 0
                    if node.begins:
                        hit |= now[k] != 0
                    better = who[hit & (best[who] > k)]
                    best[better], ends[better] = k, len(named) - 1
            stack += [(x, child, who, now) for x, child in sorted(node.children.items(), reverse=True)]
        return [(named[e], int(k)) if e >= 0 else None for e, k in zip(ends, best, strict=True)]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: dict[tuple[str, int], float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * (N_FEATURES + 1))

    def score(self, features: list[float]) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class Matcher:
    """Matches of whole texts; remembers the words it has met, up to a bound in characters."""

    def __init__(self, terms: list[str], stems: list[str], limit: int = 24 << 20):
        self.automaton, self.limit, self.left = Automaton(terms, stems), limit, limit
        self.known: dict[str, tuple[str, int] | None] = {}

    def matches(self, text: str | None) -> list[tuple[int, tuple[str, int], bool]]:
        """Position among the words, (term, distance), whether it is quoted."""
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, tuple[str, int], bool]]]:
        """The matches of each text; the new words of all are looked up together."""
        lowered = [(t or "").lower() for t in texts]
        listed = [_WORD.findall(t) for t in lowered]
        known = self.known
        new = [*{w for words in listed for w in words}.difference(known)]
        self.left -= sum(len(w) + 100 for w in new)
        if self.left < 0:
            known.clear()
            self.left = self.limit
            new = [*{w for words in listed for w in words}]
        known.update(zip(new, self.automaton.match_all(new), strict=True))
        out = []
        for text, low, words in zip(texts, lowered, listed, strict=True):
            found = [(i, m) for i, w in enumerate(words) if (m := known[w]) is not None]
            quoted = self._quoted(low, words) if found and (any(c in text for c in _QUOTES) or not _REPORTING.isdisjoint(words)) else frozenset()
            out.append([(i, m, i in quoted) for i, m in found])
        return out

    @staticmethod
    def _quoted(lowered: str, words: list[str]) -> set[int]:
        """Words between quotation marks that are at most 40 words apart, and the few behind a reporting one."""
        out: set[int] = set()
        opened, last = None, 0
        for i, m in enumerate(_WORD.finditer(lowered)):
            marks = sum(c in _QUOTES for c in lowered[last : m.start()])
            last = m.end()
            if marks % 2:
                if opened is not None and i - opened <= 40:
                    out.update(range(opened, i))
                    opened = None
                else:
                    opened = i
            if words[i] in _REPORTING:
                out.update(range(i + 1, i + 4))
        if opened is not None and len(words) - opened <= 40 and any(c in _QUOTES for c in lowered[last:]):
            out.update(range(opened, len(words)))
        return out


def features(found: list[tuple[int, tuple[str, int], bool]], weights: dict[tuple[str, int], float]) -> list[float]:
    """Sums over matches and over the best window of words, quoted ones apart."""
    plain, near, quoted, windows = 0.0, 0.0, 0.0, []
    spots = [(i, weights.get(m, 0.0), m[1], q) for i, m, q in found]
    for i, w, d, q in spots:
        if q:
            quoted += w
        elif d:
            near += w
        else:
            plain += w
    lo, total, best = 0, 0.0, 0.0
    for i, w, _, q in spots:
        total += 0 if q else w
        while spots[lo][0] < i - 2 * _SPAN:
            total -= 0 if spots[lo][3] else spots[lo][1]
            lo += 1
        best = max(best, total)
    one = max((w for _, w, _, q in spots if not q), default=0.0)
    kinds = len({m for _, m, q in found if not q and weights.get(m, 0) > 0})
    windows = [math.log1p(plain), math.log1p(near), math.log1p(quoted), math.log1p(best), one / 4, float(plain + near > 0), math.log1p(kinds), float(quoted > 0)]
    return windows


def _terms_of(text: str) -> set[str]:
    """A text's words, and as "x*" their beginnings of four to eight letters."""
    out: set[str] = set()
    for w in {*_WORD.findall(text.lower())}:
        if 3 <= len(w) <= 40:
            out.add(w)
            out.update(w[:n] + "*" for n in range(4, min(8, len(w) - 1) + 1))
    return out


def learn(labelled: DataFrame, sample: int = 20_000, least: int = 5, ratio: float = 12.0) -> Model:
    """labelled: doc_id, text, toxic (0 or 1). sample: rows learned from at most, dealt by a hash of the
    id. least: toxic documents that a term occurs in at least, as evidence. ratio: how much more often it
    does so than in others. Every such term is in the lexicon. Exact copies are learned from once."""
    rows = materialize(_sampled(labelled.filter(F.col("toxic").isin(0, 1)), sample).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("toxic").cast("int")).dropDuplicates(), "labelled")

    def count_terms(only: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    seen.update(_terms_of(text) if only is None else _terms_of(text) & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        return run

    def totals(df: DataFrame, only: frozenset | None, least: int) -> dict[str, int]:
        counted = df.select("text").mapInArrow(count_terms(only), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
        return {r["term"]: r["n"] for r in counted.filter(F.col("n") >= least).collect()}

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_other:
        share = (n_toxic + 1) / (n_toxic + n_other + 2)
        return Model(coefficients=[math.log(share / (1 - share)), *[0.0] * N_FEATURES])
    # Their number is bounded as the sample is.
    toxic = totals(rows.filter("toxic = 1"), None, least)
    other = totals(rows.filter("toxic = 0"), frozenset(toxic), 1)
    strong = {t: n for t, n in toxic.items() if (n + 0.5) / (n_toxic + 1) >= ratio * (other.get(t, 0) + 0.5) / (n_other + 1)}
    # How often the most frequent word with a beginning occurs.
    longest: dict[str, int] = {}
    for w in strong:
        if not w.endswith("*"):
            for n in range(4, min(8, len(w)) + 1):
                longest[w[:n]] = max(strong[w], longest.get(w[:n], 0))
    chosen: set[str] = set()
    for t in sorted(strong, key=lambda t: (-strong[t], len(t), t)):
        covered = [c for c in (t[:n] + "*" for n in range(4, len(t.rstrip("*")))) if c in strong and strong[c] >= strong[t]]
        # A beginning that hardly occurs but in one whole word is that word.
        if t.endswith("*") and longest.get(t[:-1], 0) >= 0.8 * strong[t]:
            continue
        # A word that has a chosen beginning stays, as it may be misspelled there.
        if t.endswith("*") and any(c in chosen for c in covered):
            continue
        chosen.add(t)
    words, stems = sorted(t for t in chosen if not t.endswith("*")), sorted(t[:-1] for t in chosen if t.endswith("*"))

    def match_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(words, stems)
        for batch in slices(batches, _ROWS, _BYTES):
            found = own.batch(batch.column("text").to_pylist())
            kept = [[{"at": i, "term": m[0], "distance": m[1], "quoted": q} for i, m, q in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(kept, spans)], ["toxic", "found"])

    spans = pa.list_(pa.struct([("at", pa.int32()), ("term", pa.string()), ("distance", pa.int32()), ("quoted", pa.bool_())]))
    # Matches of the sample alone, which is bounded.
    got = rows.select("toxic", "text").mapInArrow(match_rows, "toxic int, found array<struct<at:int,term:string,distance:int,quoted:boolean>>").collect()
    docs = [(r["toxic"], [(s["at"], (s["term"], s["distance"]), s["quoted"]) for s in r["found"]]) for r in got]
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for y, found in docs:
        seen[y].update({m for _, m, q in found if not q})
    weights = {m: max(0.0, min(6.0, math.log((seen[1][m] + 0.5) / (n_toxic + 1)) - math.log((seen[0][m] + 0.5) / (n_other + 1)))) for m in {*seen[0], *seen[1]}}
    # A misspelling that was never met weighs as those met once do, and no more than its term.
    known = {m for _, found in docs for _, m, _ in found}
    right = Automaton(words, stems)
    for d in (1, 2):
        once = [sum(1 for m in seen[y] if m[1] == d and seen[0][m] + seen[1][m] == 1) for y in (0, 1)]
        unmet = max(0.0, min(6.0, math.log((once[1] + 0.5) / (n_toxic + 1)) - math.log((once[0] + 0.5) / (n_other + 1))))
        weights |= {(t, d): min(unmet, weights.get(right.match(t), 0.0)) for t in (*words, *stems) if d <= allowed(len(t)) and (t, d) not in known}
    groups: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for y, found in docs:
        groups[tuple(features(found, weights))][y] += 1
    return Model(words, stems, weights, _regression(groups))


def _regression(groups: dict[tuple, list[int]], penalty: float = 1.0) -> list[float]:
    """Logistic regression by Newton steps over rows of equal features."""
    x = np.array([[1.0, *g] for g in groups])
    n = np.array([sum(c) for c in groups.values()], float)
    y = np.array([c[1] for c in groups.values()], float)
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - n * p) - ridge @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w.tolist()


def score(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_matches, matches (the terms found, in order) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(model.terms, model.stems)
        for batch in slices(batches, _ROWS, _BYTES):
            found = own.batch(batch.column("text").to_pylist())
            scores = [model.score(features(f, model.weights)) for f in found]
            arrays = [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([len(f) for f in found], pa.int32()), pa.array([[m[0] for _, m, _ in f] for f in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "score", "n_matches", "matches"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_matches int, matches array<string>")


def held_out(doc_id="doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(labels: DataFrame, sample: int) -> DataFrame:
    """About `sample` rows at most, dealt by a hash of the id."""
    count = labels.count()
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1_000_000))
    return labels if count <= sample else labels.filter(part < int(1_000_000 * sample / count))


def learn_from(documents: DataFrame, labels: DataFrame, sample: int = 20_000, **options) -> Model:
    """Learn from the labelled documents outside the held-out rows. The labels are sampled first, so what
    is broadcast to the documents is bounded by the sample."""
    known = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter("doc_id IS NOT NULL").dropDuplicates()
    known = F.broadcast(_sampled(known, sample))
    return learn(documents.select(F.col("doc_id").cast("long"), "text").join(known, "doc_id"), sample=2 * sample, **options)


def clean(df: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns. A model without a lexicon, which tells
    no text from another, rejects none."""
    if not model.terms and not model.stems:
        return df.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(model.terms, model.stems)
        for batch in slices(batches, _ROWS, _BYTES):
            scores = [model.score(features(f, model.weights)) for f in own.batch(batch.column("text").to_pylist())]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return df.withColumn("text", F.col("text").cast("string")).mapInArrow(run, df.withColumn("text", F.col("text").cast("string")).schema)
