"""Exact top-k search by inner product with MaxScore (operator 1).

A vector is a document whose terms are its nonzero components; a query is a list of weighted terms. The
candidates are dealt to shards. In a shard, each term has its postings and the largest and smallest
weight in them, so a query term has a bound: the most that it can add to any document. Terms sorted by
bound split into non-essential ones, whose bounds together stay below the k-th best score so far, and
essential ones. Only postings of essential terms are traversed; documents that they touch are probed in
the other terms, largest bound first, while partial score plus the bounds still ahead reach the k-th
best score. The shards' best are merged by score, ties to the smaller id.

Documents are visited in blocks of ascending id, so the k-th best score rises as they pass.

Queries meet shards in blocks: a group is one block of queries and one shard, both of bounded size.

Nulls and edge cases: vectors that are null, or hold a null or non-finite component, take no part, nor
do rows without id. Ids that repeat as queries count once (with their least vector); as candidates each
row counts. Weights so large that a score might not fit in 64 bits are an error. Vectors may be empty or
differ in length: missing components are zero. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Share of the k-th best score that the bounds of non-essential terms may reach together.
SPARE = 0.25
#: Queries whose essential terms are traversed together.
TOGETHER = 64
HITS = "query_id long, vec_id long, score long"
_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Shard:
    """Postings of some documents, in blocks of ascending id. Postings that hold most of a block are
    kept as a dense column, others as positions and weights."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, block: int = 2048):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        weights = np.ascontiguousarray(weights[order].T)
        self.blocks = [(at, np.ascontiguousarray(weights[:, at : at + block])) for at in range(0, len(ids), block)]
        self.high = np.stack([b.max(axis=1) for _, b in self.blocks])
        self.low = np.stack([b.min(axis=1) for _, b in self.blocks])
        self.offered = self.traversed = 0  # postings of the queries met, and those traversed
        self.postings = [[p if len(p := np.flatnonzero(row)) < len(row) // 4 else None for row in b] for _, b in self.blocks]

    def best_of_many(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for many queries against dense postings. Queries of which as many terms are non-essential
        go together: postings that are essential to one of them are traversed for all, as one product of
        matrices; others are only probed. Blocks whose bounds stay below every k-th best score are left out."""
        n = len(query_ids)
        best_ids, best_scores = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)
        q = queries.astype(np.float64)
        for (at, weights), high, low in zip(self.blocks, self.high, self.low, strict=True):
            self.offered += n * weights.shape[0]
            bound = np.maximum(0.0, np.where(q > 0, q * high, q * low))
            order = np.argsort(bound, axis=1, kind="stable")
            rising = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
            open_ = np.flatnonzero(rising[:, -1] >= best_scores[:, -1])
            if not len(open_):
                continue
            w, own = weights.astype(np.float64), self.ids[at : at + weights.shape[1]]
            least = best_scores[:, -1:]
            # non-essential: terms of least bound that together stay below a share of the k-th best score,
            # as nearly all documents would have to be probed if they came close to the whole of it
            spare = ((rising < SPARE * least) & (least > 0)).sum(axis=1)
            open_ = open_[np.argsort(spare[open_], kind="stable")]
            for lo in range(0, len(open_), TOGETHER):
                some = open_[lo : lo + TOGETHER]
                found = self._visit(q[some], w, own, query_ids[some], order[some], rising[some], spare[some], least[some, 0], k)
                self._merge(best_ids, best_scores, some, own, *found)
        rows, cols = np.nonzero(best_scores > -np.inf)
        return query_ids[rows], best_ids[rows, cols], best_scores[rows, cols].astype(np.int64)

    def _visit(self, q: np.ndarray, w: np.ndarray, own: np.ndarray, query_ids: np.ndarray, order: np.ndarray, rising: np.ndarray, spare: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, place and score of the documents of a block that may be among the k best of each query."""
        at_most = np.where(spare > 0, np.take_along_axis(rising, np.maximum(spare - 1, 0)[:, None], axis=1)[:, 0], 0.0)
        essential = np.ones(q.shape, bool)
        np.put_along_axis(essential, order, np.arange(q.shape[1])[None, :] >= spare[:, None], axis=1)
        terms = np.flatnonzero(essential.any(axis=0))
        self.traversed += len(q) * len(terms)
        part = np.where(essential, q, 0.0)[:, terms] @ w[terms]
        part[own[None, :] == query_ids[:, None]] = -np.inf
        full = np.isneginf(least)
        if full.any() and part.shape[1] > k:  # no k documents yet: the k best of this block, and their ties
            least = least.copy()
            least[full] = np.partition(part[full], part.shape[1] - k, axis=1)[:, part.shape[1] - k]
        rows, cols = np.nonzero((part + at_most[:, None] >= least[:, None]) & (part > -np.inf))
        scores, left = part[rows, cols], spare[rows]
        done = []
        while len(rows):  # probe the non-essential terms, largest bound first, while the document can still get in
            ready = left == 0
            if ready.any():
                done.append((rows[ready], cols[ready], scores[ready]))
                rows, cols, scores, left = (x[~ready] for x in (rows, cols, scores, left))
            left = left - 1
            t = order[rows, left]
            scores = scores + q[rows, t] * w[t, cols]
            keep = scores + np.where(left > 0, rising[rows, left - 1], 0.0) >= least[rows]
            rows, cols, scores, left = (x[keep] for x in (rows, cols, scores, left))
        if not done:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        rows, cols, scores = (np.concatenate([d[i] for d in done]) for i in range(3))
        sort = np.argsort(rows, kind="stable")
        return rows[sort], cols[sort], scores[sort]

    @staticmethod
    def _merge(best_ids: np.ndarray, best_scores: np.ndarray, some: np.ndarray, own: np.ndarray, rows: np.ndarray, cols: np.ndarray, scores: np.ndarray) -> None:
        """Adds what was found for the queries `some`, sorted by query, to their best so far."""
        edges = np.searchsorted(rows, np.arange(len(some) + 1))
        for i, a, b in zip(some, edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            ids, values = np.concatenate([best_ids[i], own[cols[a:b]]]), np.concatenate([best_scores[i], scores[a:b]])
            first = np.lexsort((ids, -values))[: best_ids.shape[1]]
            best_ids[i], best_scores[i] = ids[first], values[first]

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best (ties to the smaller id), in order."""
        terms = np.flatnonzero(query)
        q = query[terms]
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for (at, weights), high, low, postings in zip(self.blocks, self.high, self.low, self.postings, strict=True):
            bound = np.maximum(0, np.where(q > 0, q * high[terms], q * low[terms]))
            order = np.argsort(-bound, kind="stable")
            # ahead[i]: the most that terms i, i + 1, ... add together
            ahead = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
            least = scores[-1] if len(scores) == k else None
            n = weights.shape[1]
            essential = len(order) if least is None else int(np.searchsorted(-ahead[:-1], -least, side="right"))
            if least is not None and ahead[0] < least:
                continue
            score = np.zeros(n, np.int64)
            touched = np.zeros(n, bool)
            if least is None or least <= 0:
                touched[:] = True  # a document without any term scores 0
            alive = None
            for i, j in enumerate(order[:essential]):
                t = terms[j]
                p = postings[t]
                if p is None:
                    score += q[j] * weights[t]
                    touched[:] = True
                else:
                    score[p] += q[j] * weights[t][p]
                    touched[p] = True
                if least is not None and i % 8 == 7:
                    alive = np.flatnonzero(touched & (score + ahead[i + 1] >= least)) if i + 1 >= essential or touched.all() else None
                    if alive is not None and len(alive) < n // 4:
                        essential = i + 1
                        break
            alive = np.flatnonzero(touched) if alive is None or essential == len(order) else alive
            part = score[alive]
            for i in range(essential, len(order)):
                if least is not None:
                    keep = part + ahead[i] >= least
                    alive, part = alive[keep], part[keep]
                    if not len(alive):
                        break
                t = terms[order[i]]
                part = part + q[order[i]] * weights[t][alive]
            own = self.ids[at + alive]
            keep = own != query_id
            if least is not None:
                keep &= part >= least
            ids, scores = np.concatenate([ids, own[keep]]), np.concatenate([scores, part[keep]])
            first = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[first], scores[first]
        return ids, scores


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates of largest integer inner product, for queries
    (query_id, weights array<long>) against candidates (vec_id, weights array<long>)."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_pylist(), bool)
        if not asks.any() or asks.all():
            return _SCHEMA.empty_table()
        ids = group.column("id").to_numpy()
        width = int(max(pc.max(pc.list_value_length(group.column("weights"))).as_py() or 1, 1))
        weights = _matrix(group.column("weights"), width)
        if float(np.abs(weights.astype(float)).max(initial=0)) ** 2 * width >= 2**63:
            raise ValueError("weights so large that a score may not fit in 64 bits")
        shard = Shard(ids[~asks], weights[~asks])
        exact = np.abs(weights).max(initial=0).astype(float) ** 2 * width < 2**53
        if exact and width <= 4096 and 4 * np.count_nonzero(weights) > weights.size:
            many = [shard.best_of_many(ids[asks][lo : lo + 256], weights[asks][lo : lo + 256], k) for lo in range(0, int(asks.sum()), 256)]
            return pa.table([np.concatenate([m[j] for m in many]) for j in range(3)], schema=_SCHEMA)
        found = [(i, *shard.best(i, w, k)) for i, w in zip(ids[asks].tolist(), weights[asks], strict=True)]
        return pa.table([np.repeat([i for i, _, _ in found], [len(a) for _, a, _ in found]).astype(np.int64), np.concatenate([a for _, a, _ in found]), np.concatenate([b for _, _, b in found])], schema=_SCHEMA)

    queries = queries.groupBy("query_id").agg(F.min("weights").alias("weights"))
    sizes = candidates.agg(F.count(F.lit(1)).alias("n")).first()["n"], queries.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    shards, blocks = (max(1, -(-n // rows)) for n, rows in zip(sizes, (shard_rows, block_rows), strict=True))

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, m: int, asks: bool) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        return df.select(F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), every.alias(other), F.lit(asks).alias("asks"), F.col(key).alias("id"), "weights")

    met = dealt(candidates, "vec_id", "shard", shards, "block", blocks, False).unionByName(dealt(queries, "query_id", "block", blocks, "shard", shards, True))
    hits = met.groupBy("shard", "block").applyInArrow(run, HITS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, weights: floor(scale * component) of the vectors that take part."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & whole).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("weights"))
