"""Whitening against the plain covariance of exact whole numbers, and its edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import queries, whitening

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(data, most=8):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} of (vec_id, vector) rows of one length."""
    good = [(i, v) for i, v in data if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * c - s for c, s in zip(r, sums, strict=True)] for r in x]
    y = np.array(d, dtype=np.longdouble) / n
    v = np.array(y.T @ y / n, dtype=float)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > 1e-12 * e.sum()).sum()))
    w = np.array(y, float) @ q[:, :k] / np.sqrt(e[:k])
    return {(i, c + 1): (n, sum(t * t for t in d[r]), abs(w[r, c]), e[c] / e.sum()) for r, (i, _) in enumerate(good) for c in range(k)}


def same(df, want):
    got = df.select(*COLUMNS).collect()
    assert len(got) == len(want)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] <= 1e-9
    for r in got:
        n, deviation, size, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(r["whitened"]) == pytest.approx(size, abs=1e-8) and r["explained"] == pytest.approx(explained, rel=1e-9)


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    return [(i, [float(c) for c in (rng.normal(size=d) * np.linspace(0.02, 0.3, d)).astype(np.float32)]) for i in range(n)]


def test_vectors_of_all_kinds_equal_brute_force(spark):
    data = vectors(1, 300, 12)
    data += [(1000 + i, data[0][1]) for i in range(150)]  # a hot vector
    odd = [(2000, None), (2001, []), (2002, [None] * 12), (2003, [float("nan")] * 12), (2004, [float("inf")] + [0.0] * 11), (2005, [0.1] * 5), (2006, [1e30] * 12)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>").withColumns({"n": F.lit("x"), "state": F.lit(1), "slot": F.lit(None).cast("int")})
    want = brute(data)
    same(whitening.whiten(df.repartition(20)), want)
    same(whitening.whiten(df.repartition(1)), want)
    rows = whitening.whiten(df).filter("component = 1").groupBy().agg(F.max("whitened"), F.min("whitened")).first()
    assert rows[0] > 0 > rows[1]  # one sign for all rows


def test_few_dimensions_and_zero_variance(spark):
    data = [(i, [0.5, float(np.float32(0.01 * (i % 7))), float(np.float32(0.01 * (i % 7)))]) for i in range(50)]
    same(whitening.whiten(spark.createDataFrame(data, "vec_id long, embedding array<float>")), brute(data))
    for rows in ([], [(1, [0.5, 0.2])], [(1, None)], [(1, [0.25]), (2, [0.25])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0


def test_null_ids_and_repeated_rows_return_their_own_rows(spark):
    data = vectors(4, 20, 3)
    rows = [(None if i == 3 else i, v) for i, v in data] + [data[5]]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 21 * 3
    assert len([r for r in got if r["vec_id"] is None]) == 3 and len([r for r in got if r["vec_id"] == 5]) == 6


def test_sums_beyond_a_long_are_exact_or_null():
    x = np.array([[2**61, -(2**61)], [3, 4]], dtype=np.int64)
    c = whitening.centred(x, 2, [2**61 + 3, 4 - 2**61])
    assert c.tolist() == [[2**61 - 3, -(2**61) - 4], [3 - 2**61, 2**61 + 4]]
    assert whitening.deviations(c) == [None, None]
    assert whitening.deviations(np.array([[3, 4]], dtype=np.int64)) == [25]


def test_rank_one_updates_with_deflation():
    rng = np.random.default_rng(7)
    for case in range(60):
        d = int(rng.integers(1, 9))
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        values = np.sort(rng.choice([0.0, 1.0, 1.0, 2.5, 2.5 + 1e-15, 1e-9, 1e6], size=d))
        v = q @ (rng.normal(size=d) * rng.choice([0.0, 1e-17, 1.0], size=d))
        rho = float(rng.choice([1e-6, 1.0, 1e4]))
        new, p = whitening.rank_one(values, q, v, rho)
        want = q @ np.diag(values) @ q.T + rho * np.outer(v, v)
        size = max(1.0, np.abs(want).max())
        assert np.abs(p @ np.diag(new) @ p.T - want).max() < 1e-13 * size * d, case
        assert np.abs(p.T @ p - np.eye(d)).max() < 1e-13 and (np.diff(new) >= 0).all()


def test_query(spark, sf_dir):
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(queries.op13_whitening(spark, sf_dir), brute(data))
