"""Exact n-gram Jaccard join with adaptive multi-match prefixes (operator 2).

A document's set holds the hashes of its distinct n-word shingles. Documents link when the Jaccard
similarity of their sets reaches the threshold t = numerator / denominator.

1. Screening. Of a set of n shingles, the `p = n - ceil(t n) + l` of least hash form its short prefix,
   with l = ceil(n / 20). Two linked sets share at least min(l, l') shingles of their short prefixes, so
   a document needs that many which some other short prefix holds as well; most documents end here. Of
   the others, all shingles are counted: a linked document has ceil(t n) that others have. Shingles met
   twice or more are set in a bit table of bounded size, so no document needs to meet any other; where they
   are too many for it, they are joined instead.
2. Classes. Documents with equal sets are one class, represented by the smallest doc_id.
3. Adaptive prefixes. The shared shingles of a representative are ordered from rare to frequent. With c
   of them, and k = ceil(t n) needed, two linked sets share at least m among the c - k + m rarest, for
   the smaller m of both. Each document takes the m for which its postings plus the partners that share
   m of them by estimate cost least: a longer prefix where its shingles are frequent.
   A place in the order bounds what two sets can share, which rules out most members of a list.
4. Links. In each posting list, members are first compared with one member that stands for the list
   (the one whose shingles are met most, as the origin of many copies); connected members count as one
   component from then on. Lists that still hold several components compare the members outside their
   largest component with all others, each pair once, if it shares enough of its prefixes. So a large group
   of near copies costs its size times the members that no head reaches, and no link between components is
   missed.
   Each comparison intersects the whole sets.
5. Components of the links, by the smallest doc_id that can be reached.

Nulls and edge cases: null texts and texts without words have an empty set, link with nothing and are
their own component; a text shorter than a shingle is one shingle. Repeated rows are equal sets, and
rows that share a doc_id are classed each by its own text. A null doc_id is no one's representative: it
takes the component of the documents with its set, or null. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shared import repeated
from .words import Bits, combine, hashes, mix, slices

_MATCHES = (1, 2, 4, 8, 16)


def _sets(texts: list[str | None], n_gram: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    found, counts = hashes(texts, True)
    for end, n in zip(np.cumsum(counts), counts, strict=True):
        words = found[end - n : end]
        yield np.unique(combine(words, min(n_gram, n))) if n else np.empty(0, np.uint64)


def _least_overlap(n: int, num: int, den: int) -> int:
    """Shingles that a set shares with any set it is linked to, at least: ceil(t n)."""
    return -(-num * n // den)


def _slack(n: int) -> int:
    return -(-n // 20)


def _prefix_length(n: int, num: int, den: int) -> int:
    return min(n, n - _least_overlap(n, num, den) + _slack(n))


def _needed(n: int, num: int, den: int) -> int:
    """Shared prefix shingles that any link needs: the slack of the smallest set that fits."""
    return _slack(_least_overlap(n, num, den))


def _prefixes(df: DataFrame, n_gram: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [s[: _prefix_length(len(s), num, den)] for s in _sets(part.column("text").to_pylist(), n_gram)]
            once, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(n.astype(np.int32))], ["shingle", "n"])

    return df.select("text").mapInArrow(run, "shingle long, n int")


def _keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return _sum(mix(s)), _sum(mix(s ^ np.uint64(0x5851F42D4C957F2D)))


_SET = "doc_id long, n long, key_a long, key_b long, whole array<long>"


def _screened(df: DataFrame, n_gram: int, num: int, den: int, bits: Bits | None) -> DataFrame:
    """Every document with the size of its set; those whose short prefix may be shared enough (all that have
    words, without bits) with a key of their set and the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("whole", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows: dict[str, list] = {c: [] for c in schema.names}
            rows["doc_id"] = part.column("doc_id").to_pylist()
            for s in _sets(part.column("text").to_pylist(), n_gram):
                n = len(s)
                own = (None, None, None)
                if n and (bits is None or int(bits.has(s[: _prefix_length(n, num, den)]).sum()) >= _needed(n, num, den)):
                    own = (*_keys(s), s.view(np.int64))
                for c, v in zip(("n", "key_a", "key_b", "whole"), (n, *own), strict=True):
                    rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return df.mapInArrow(run, _SET)


def _screened_by_join(df: DataFrame, n_gram: int, num: int, den: int, common: DataFrame) -> DataFrame:
    """The same where the shingles met twice (common) are too many for a bit table: short prefixes meet them
    by a join. Sets of one key_a count together, so no set is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for s in {_keys(s)[0]: s for s in _sets(part.column("text").to_pylist(), n_gram) if len(s)}.items():
                own = s[1][: _prefix_length(len(s[1]), num, den)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), s[0]))], ["shingle", "key_a"])

    held = df.select("text").mapInArrow(run, "shingle long, key_a long")
    met = held.join(common, "shingle", "left_semi").groupBy("key_a").agg(F.count(F.lit(1)).alias("met"))
    # ceil(ceil(t n) / 20), as in _needed
    needed = F.expr(f"(({num} * n + {den - 1}) div {den} + 19) div 20")
    enough = F.coalesce(F.col("met") >= needed, F.lit(False))
    found = _screened(df, n_gram, num, den, None).join(met, "key_a", "left")
    return found.select("doc_id", "n", *[F.when(enough, F.col(c)).alias(c) for c in ("key_a", "key_b", "whole")])


def _sum(x: np.ndarray) -> int:
    return int(np.sum(x, dtype=np.uint64).view(np.int64))


def _whole_counts(kept: DataFrame) -> DataFrame:
    """All shingles of the documents left, added up where a task meets them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                once, n = np.unique(batch.column("whole").slice(at, 512).flatten().to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(once), pa.array(n.astype(np.int32))], ["shingle", "n"])

    return kept.select("whole").mapInArrow(run, "shingle long, n int")


def _shared_enough(kept: DataFrame, num: int, den: int, bits: Bits | None) -> DataFrame:
    """Documents of whose sets a share of num / den may be found in others. Without bits all, as the postings
    count the same by a join."""
    if bits is None:
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("whole")
            hits = bits.has(whole.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            sizes = whole.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(hits)])
            ends = np.cumsum(sizes)
            yield batch.filter(pa.array(den * (sums[ends] - sums[ends - sizes]) >= num * sizes))

    return kept.mapInArrow(run, kept.schema)


def _postings(reps: DataFrame, num: int, den: int) -> DataFrame:
    """shingle, rep, n, m, c, pos, score: the adaptive prefix of each representative. pos: the shingle's place
    among its c shared ones. score: how often its shingles
    are met, on average."""
    held = reps.select("rep", "n", F.explode("whole").alias("shingle"))
    common = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = held.join(common, "shingle").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("own"), F.sum("df").alias("met"))
    shared = shared.withColumn("k", F.expr(f"cast(({num} * n + {den - 1}) div {den} as int)")).withColumn("c", F.size("own")).filter("c >= k")

    def cost(m: int):
        """Postings read, and partners that are met m times if they are spread over the lists."""
        read = F.aggregate(F.slice("own", 1, F.col("c") - F.col("k") + m), F.lit(0.0), lambda a, x: a + x["df"].cast("double"))
        return F.when(F.col("k") >= m, F.struct((read + 8 * read / m).alias("cost"), F.lit(m).alias("m")))

    best = F.array_min(F.array_compact(F.array(*[cost(m) for m in _MATCHES])))
    shared = shared.withColumn("m", best["m"]).withColumn("score", F.col("met") / F.col("n"))
    prefix = F.slice("own", 1, F.col("c") - F.col("k") + F.col("m"))
    return shared.select("rep", "n", "m", "c", "score", F.posexplode(prefix).alias("pos", "x")).select(F.col("x.shingle").alias("shingle"), "rep", "n", "m", "c", "pos", "score")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b), those that link. The set of b travels with each pair, that of a is met there."""
    left = sets.select(F.col("rep").alias("a"), F.col("whole").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("whole").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    return pairs.select("a", "b").join(right, "b").join(left, "a").filter(den * both >= num * union).select("a", "b")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rep, comp: the smallest node that each can reach, by large-star and small-star rounds."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    while True:
        # large star: every larger neighbour of a node goes to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("low").alias("v"))).distinct()
        edges = materialize(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == last:
            break
        last = state
    return nodes.join(edges.select(F.col("u").alias("rep"), "v"), "rep", "left").select("rep", F.coalesce("v", "rep").alias("comp"))


def _may_link(x: str, y: str, num: int, den: int):
    """Whether two members of a list may link: by their sizes, and as they share no more than what both have
    before this shingle and behind it."""
    col = lambda side, c: F.col(f"{side}{c}")
    sizes = (col(x, "n") * den >= col(y, "n") * num) & (col(y, "n") * den >= col(x, "n") * num)
    behind = F.least(col(x, "c") - col(x, "pos"), col(y, "c") - col(y, "pos"))
    most = F.least(col(x, "pos"), col(y, "pos")) + behind
    return sizes & ((num + den) * most >= num * (col(x, "n") + col(y, "n")))


def _across(mixed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of members in different components that share enough of their prefixes (own): members outside the
    list's largest component with all others that they may link with. A pair is met in the list of the first
    shingle that both prefixes hold, and in no other. A skewed list is split by the optimiser."""
    x, y = mixed.filter("comp <> main").alias("x"), mixed.alias("y")
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))
    first = F.expr("NOT arrays_overlap(slice(x.own, 1, x.pos), slice(y.own, 1, y.pos))")
    enough = F.expr("size(array_intersect(x.own, y.own)) >= least(x.m, y.m)")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.comp") != F.col("y.comp")) & once & _may_link("x.", "y.", num, den) & first & enough)
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))


def join(df: DataFrame, n_gram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_equal (documents with the same set) of every document."""
    docs = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bits, common = repeated(_prefixes(docs, n_gram, num, den), "shingle", "n")
    screened = _screened(docs, n_gram, num, den, bits) if bits else _screened_by_join(docs, n_gram, num, den, common)
    screened = materialize(screened, "sets")
    likely = screened.filter("whole IS NOT NULL")
    # read again from `sets` where it is used: another copy of the sets would cost more
    kept = _shared_enough(likely, num, den, repeated(_whole_counts(likely), "shingle", "n")[0])
    key = ["key_a", "key_b", "n"]
    classes = materialize(kept.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_equal")).filter("rep IS NOT NULL"), "classes")
    is_rep = [kept[c] == classes[c] for c in key] + [kept["doc_id"] == classes["rep"]]
    reps = materialize(kept.join(classes, is_rep).select("rep", kept["n"], "whole").dropDuplicates(["rep", "n", "whole"]), "reps")
    postings = materialize(_postings(reps, num, den), "postings")
    sets = reps.select("rep", "whole")
    nodes = reps.select("rep")

    # One member stands for each list, first the one that is met most, then the one of the smallest set.
    # All others of the list are compared with it, unless they are connected already.
    links = None
    comp = nodes.withColumn("comp", F.col("rep"))
    for pick in (F.max(F.struct("score", "rep", "n", "m", "c", "pos")), F.min(F.struct("n", "rep", "m", "c", "pos"))):
        heads = postings.groupBy("shingle").agg(pick.alias("h")).select("shingle", *[F.col(f"h.{c}").alias(f"h_{c}") for c in ("rep", "n", "m", "c", "pos")])
        met = postings.join(heads, "shingle").filter((F.col("rep") != F.col("h_rep")) & _may_link("", "h_", num, den))
        pairs = met.select(F.least("rep", "h_rep").alias("a"), F.greatest("rep", "h_rep").alias("b"), F.least("m", "h_m").alias("m"))
        pairs = pairs.groupBy("a", "b", "m").agg(F.count(F.lit(1)).alias("shared")).filter("shared >= m").select("a", "b")
        if links is not None:
            apart = comp.select(F.col("rep").alias("a"), F.col("comp").alias("ca"))
            apart_b = comp.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
            pairs = pairs.join(apart, "a").join(apart_b, "b").filter("ca <> cb").select("a", "b")
        found = materialize(_verified(pairs, sets, num, den), "links")
        links = found if links is None else links.unionByName(found)
        comp = materialize(components(nodes, links), "comp")

    # Lists that still hold several components: members outside the largest one meet all others.
    placed = postings.join(comp, "rep")
    sizes = placed.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("size", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("shingle", F.col("top.comp").alias("main"))
    mixed = placed.join(main, "shingle")
    prefixes = postings.join(mixed.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("pos", "shingle"))).alias("own"))
    mixed = materialize(mixed.join(prefixes.select("rep", F.col("own.shingle").alias("own")), "rep"), "mixed")
    links = links.unionByName(materialize(_verified(_across(mixed, num, den), sets, num, den), "links"))
    comp = components(nodes, links)

    named = classes.join(comp, "rep")
    out = screened.select("doc_id", "n", "key_a", "key_b").join(named.select("key_a", "key_b", "n", "comp", "n_equal"), key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"), F.coalesce("n_equal", F.lit(1)).alias("n_equal"))


def one_of_each(df: DataFrame, n_gram: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The table without the documents that are linked, directly or through others, to one of smaller
    doc_id; of rows that repeat a doc_id and text one stays. Rows without a doc_id stay. The list of
    documents to go is broadcast up to broadcast_rows ids, and joined by a shuffle beyond that."""
    found = join(df, n_gram, num, den)
    marks = materialize(found.groupBy("doc_id").agg(F.max(F.col("component_id") < F.col("doc_id")).alias("goes"), F.count(F.lit(1)).alias("rows")).filter("doc_id IS NOT NULL AND (goes OR rows > 1)"), "goes")
    go, twice = marks.filter("goes").select("doc_id"), marks.filter("NOT goes").select("doc_id")
    sizes, own = (go.count(), twice.count()), f"id_{uuid.uuid4().hex}"  # a name that no column of df has

    def side(ids: DataFrame, n: int) -> DataFrame:
        ids = ids.withColumnRenamed("doc_id", own)
        return F.broadcast(ids) if n <= broadcast_rows else ids

    again = F.col("doc_id") == F.col(own)
    left = df.join(side(go, sizes[0]), again, "left_anti")
    if not sizes[1]:
        return left
    return left.join(side(twice, sizes[1]), again, "left_anti").unionByName(left.join(side(twice, sizes[1]), again, "left_semi").dropDuplicates(["doc_id", "text"]))
