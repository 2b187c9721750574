"""Vectors of long texts by windows, and top-k search with candidates where they lie."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import embed, retrieval
from lectern.sources.corpus import Corpus


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def load():
    """Words as tokens; a vector of a text's letters a, b and c, of any length."""
    def tokens(text):
        at, out = 0, []
        for w in text.split():
            at = text.index(w, at)
            out.append((at, at + len(w)))
            at += len(w)
        return out

    return tokens, lambda texts: np.array([[7.0 * t.count(c) for c in "abc"] for t in texts])


def test_three_windows_are_averaged_by_their_tokens(spark):
    text = " ".join(["a"] * 480 + ["b"] * 480 + ["c"] * 40)
    rows = [(1, text), (2, "a b"), (3, None), (4, " \n"), (5, "c " * 1000)]
    got = {r["key"]: r["embedding"] for r in embed.embed_texts(spark.createDataFrame(rows, "key long, body string"), "key", "body", load, 3).collect()}
    assert set(got) == {1, 2, 5}
    assert got[1] == pytest.approx(unit([480, 480, 40])) and got[2] == pytest.approx(unit([1, 1, 0])) and got[5] == pytest.approx([0, 0, 1])


def test_a_model_is_loaded_once_a_task_and_sees_bounded_batches(spark):
    loads, largest = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted():
        loads.add(1)
        tokens, encode = load()

        def bounded(texts):
            assert len(texts) <= embed.AT_ONCE
            largest.add(len(texts))
            return encode(texts)

        return tokens, bounded

    df = spark.range(300).select(F.col("id").alias("key"), F.lit("a b c a").alias("body")).repartition(3)
    assert embed.embed_texts(df, "key", "body", counted, 3, window=2).count() == 300
    assert loads.value == 3 and largest.value == 600


@pytest.mark.parametrize("vector", [[0.0, 0.0, 0.0], [float("nan"), 0.0, 1.0], [1.0, 2.0]])
def test_bad_vectors_of_a_model_are_errors(spark, vector):
    broken = lambda: (load()[0], lambda texts: np.array([vector for _ in texts]))
    with pytest.raises(Exception, match="a model gave"):
        embed.embed_texts(spark.createDataFrame([(1, "a")], "key long, body string"), "key", "body", broken, 3).collect()


def test_built_in_embedder(spark):
    words = [random.Random(1).choice(["ab", "cd", "éf", "x1"]) for _ in range(1000)]
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8
    total = np.zeros(8)
    for at in range(0, 1000, 480):
        own = np.bincount([place(w) for w in words[at : at + 480]], minlength=8).astype(float)
        total += own / np.linalg.norm(own) * len(words[at : at + 480])
    rows = [(1, " ".join(words)), (2, ""), (3, None)]
    many = spark.createDataFrame([(i, " ".join(words[: i + 1])) for i in range(9)], "key long, body string").coalesce(1)
    counted = {i: np.bincount([place(w) for w in words[: i + 1]], minlength=8) for i in range(9)}
    found = {r["key"]: r["embedding"] for r in embed.embed_words(many, "key", F.col("body"), 8).collect()}
    assert set(found) == set(counted) and all(found[i] == pytest.approx(list(c / np.linalg.norm(c))) for i, c in counted.items())
    got = embed.embed_words(spark.createDataFrame(rows, "key long, body string"), "key", F.col("body"), 8).collect()
    assert [r["key"] for r in got] == [1] and got[0]["embedding"] == pytest.approx(total / np.linalg.norm(total))
    small = embed.Hashed(8, room=200)
    assert small.places(words) == [place(w) for w in words]


def vectors(rng, n, d):
    return [[rng.choice([-2.0, -1.0, 0.0, 1.0, 2.0]) for _ in range(d)] for _ in range(n)]


@pytest.mark.parametrize("block_bytes", [32 << 20, 400])
def test_top_k_by_brute_force(spark, block_bytes):
    rng = random.Random(3)
    q = [(i, i % 3, v) for i, v in enumerate(vectors(rng, 20, 3))] + [(50, None, [1.0, 0.0, 0.0]), (51, 0, None), (52, 0, [0.0, 0.0, 0.0]), (53, 0, [float("inf"), 0.0, 0.0])]
    x = [(i, i % 4, v) for i, v in enumerate(vectors(rng, 300, 3))] + [(900, 0, None), (901, 0, [1.0]), (902, 0, [float("nan"), 1.0, 0.0]), (903, None, [1.0, 0.0, 0.0])]
    queries = spark.createDataFrame(q, "query_id long, course_id int, embedding array<double>")
    found = retrieval.top_k(queries, spark.createDataFrame(x, "chunk_id long, course_id int, embedding array<float>").repartition(7), 5, block_bytes)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    good = lambda v: v and len(v) == 3 and all(map(math.isfinite, v)) and any(v)
    want = {}
    for i, c, v in q:
        if c is None or not good(v):
            continue
        scores = [(-math.floor(max(-1, min(1, sum(a * b for a, b in zip(unit(v), unit(w))))) * 1e6 + 0.5) / 1e6, j) for j, d, w in x if d == c and good(w)]
        want[i] = [(j, -s) for s, j in sorted(scores)[:5]]
    assert got == {i: w for i, w in want.items() if w}


def test_candidates_are_not_shuffled(spark):
    q = spark.createDataFrame([(1, 7, [1.0, 0.0])], "query_id long, course_id int, embedding array<double>")
    plan = retrieval.top_k(q, spark.range(100).select(F.col("id").alias("chunk_id"), F.lit(7).alias("course_id"), F.array(F.rand(), F.rand()).alias("embedding")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "query_id" in next(x for x in plan.splitlines() if "Exchange" in x)


def test_gold_of_short_and_cut_questions(spark, tmp_path):
    docs = [(1, "one two three four five six\nseven", "en", "s", 1), (2, "x " * 5 + "\n" * 9 + "alpha beta gammas\ndelta\n" * 8, "en", "s", 1), (3, "zz", "fr", "s", 1)]
    asked = [(1, "two three four"), (2, "beta gamma"), (3, "two three four five s"), (4, "gammas\ndelta\nalpha"), (5, "zz"), (6, "four six"), (7, "three four five six\nsev"), (8, "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: (r["expected"], r["pages"]) for r in Corpus(spark, str(tmp_path)).gold.collect()}
    assert got == {1: (1, [1]), 2: (2, [2]), 3: (1, [1]), 4: (2, [2]), 5: (3, [1]), 7: (1, [1])}
