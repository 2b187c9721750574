"""The quality classifier: figures by plain counting, the risk by its definition, held-out accuracy, edge cases."""

import collections
import math
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain_figures(text):
    if not text:
        return [0.0] * len(quality.NAMES)
    words, size = WORD.findall(text), len(text)
    n, bmp = max(1, len(words)), [c if ord(c) < 0xFFFF else "￿" for c in text]
    upper = sum(c.isupper() for c in bmp)
    alpha = sum(c.isalpha() or c.isupper() for c in bmp)
    digits = sum(c.isdigit() and not c.isalpha() and not c.isupper() for c in bmp)
    spaces = sum(c.isspace() for c in bmp)
    lines = [x.rstrip() for x in text.split("\n") if x.rstrip()]
    counts = collections.Counter(words)
    return [alpha / size, upper / max(1, alpha), digits / size, spaces / size, (size - alpha - digits - spaces) / size,
            sum(a == b for a, b in zip(words, words[1:])) / n, len(counts) / n, max(counts.values(), default=0) / n, 1 - len({*lines}) / max(1, len(lines)),
            sum(x[-1] in ".!?" for x in lines) / max(1, len(lines)), math.log1p(len(words)), (size - spaces) / n, text.count("\n") / n + 1 / n] + [text.count(c) / size for c in quality.MARKS]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aBé \n\t.!|#1٣漢😀ǅ\x1c ªⅫ"), max_size=80)), max_size=5))
def test_figures_by_plain_counting(texts):
    got = quality.figures(texts)
    assert got.shape == (len(texts), len(quality.NAMES))
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(plain_figures(text))


def test_figures_of_a_long_text_are_those_of_all_of_it():
    text = "Good words here.\n" * 100_000 + "#" * 700_000
    assert quality.figures([text])[0].tolist() == pytest.approx(plain_figures(text))


def test_risk_and_its_gradient():
    rng = np.random.default_rng(1)
    p, u, w, prior = rng.integers(0, 2, (30, 5)).astype(float), rng.integers(0, 2, (50, 5)).astype(float), rng.normal(size=5), 0.7
    loss = lambda z: np.mean(np.log1p(np.exp(-z)))
    good, bad, up, down = quality.risk(w, p, u, prior)
    assert good == pytest.approx(prior * loss(p @ w)) and bad == pytest.approx(loss(-u @ w) - prior * loss(-p @ w))
    for j in range(5):
        e = np.zeros(5)
        e[j] = 1e-6
        a, b = quality.risk(w + e, p, u, prior), quality.risk(w - e, p, u, prior)
        assert (a[0] - b[0]) / 2e-6 == pytest.approx(up[j], abs=1e-5) and (a[1] - b[1]) / 2e-6 == pytest.approx(down[j], abs=1e-5)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_of_a_known_mixture(prior):
    rng = np.random.default_rng(2)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.concatenate([rng.normal(2, 1, int(6000 * prior)), rng.normal(-3, 1, 6000 - int(6000 * prior))])
    assert quality.least_ratio(positive, unlabelled) == pytest.approx(prior, abs=0.05)


def test_non_negative_risk_does_not_overfit():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (120, 200)).astype(np.float32)
    w = quality.minimise(x[:40], x[40:], 0.5, penalty=0.0)
    assert quality.risk(w, x[:40], x[40:], 0.5)[1] > -0.2


def test_scores_of_the_query_are_the_models(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn_from(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op12_quality(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        z, at = model.weights[0], 1
        for x, cuts in zip(plain_figures(texts[r["doc_id"]]), model.cuts, strict=True):
            z += model.weights[at + sum(c <= x + 1e-15 for c in cuts)]
            at += len(cuts) + 1
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3) or any(abs(c - x) < 1e-12 for x, cuts in zip(plain_figures(texts[r["doc_id"]]), model.cuts, strict=True) for c in cuts)
        assert r["predicted"] == (r["score"] >= 0.5)


def test_held_out_accuracy(spark):
    sf = os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op12_quality(spark, sf).filter("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert np.mean([r["predicted"] for r in good]) > 0.97 and np.mean([r["predicted"] for r in bad]) < 0.25
    s = np.array([r["score"] for r in good])
    assert np.mean([(s > r["score"]).mean() for r in bad]) > 0.98


def test_bad_labels_and_held_out_rows_teach_nothing(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).when(F.col("quality") == 0, None).otherwise(F.col("quality")))
    a, b = quality.learn_from(docs, labels), quality.learn_from(docs.withColumns({"good": F.lit(0), "half": F.lit("x")}), other)
    assert a.prior == b.prior and a.weights.tolist() == b.weights.tolist()


def test_edge_cases(spark):
    rows = [(None, "Some text."), (1, None), (2, ""), (3, "Same."), (3, "Same.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    model = quality.learn_from(docs, none)
    assert {r["score"] for r in quality.score(docs, model).collect()} == {0.5}
    some = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    got = quality.score(docs, quality.learn_from(docs, some)).collect()
    assert len(got) == 5 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1 and all(0 <= r["score"] <= 1 for r in got)
    empty = docs.limit(0)
    assert quality.score(empty, quality.learn_from(empty, some)).count() == 0
