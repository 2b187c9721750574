"""The pipeline's stages, each against brute force on what the stage before kept."""

import corpus_pipeline as pipeline
from lectern.llm import queries, toxicity
from lectern.llm.common import materialize
from tests.llm import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "repeats", "packing"]
    model = toxicity.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    clean = materialize(pipeline.drop_toxic(spark, docs, sf_dir), "t")
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, s in scores.items() if s < queries.TOXIC}

    before = [(r["doc_id"], r["text"]) for r in clean.collect()]
    single = materialize(pipeline.drop_near_copies(spark, clean, sf_dir), "n")
    assert single.columns == docs.columns
    assert {r["doc_id"] for r in single.collect()} == {c for _, c in brute.jaccard_components(before).values()}

    before = [(r["doc_id"], r["text"]) for r in single.collect()]
    cut = materialize(pipeline.cut_repeats(spark, single, sf_dir), "r")
    want = brute.without_repeats(before)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert r["text"].encode().split() == want[r["doc_id"]][1]
        assert r["n_chars"] == len(r["text"])

    packed = pipeline.pack(spark, cut, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(want)
    assert max(r["offset"] + r["length"] for r in packed) <= 2048


def test_nulls_ties_clashing_names_and_empty_tables(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    data = [(1, text, "x", 5, "own"), (None, text, None, None, None), (2, None, "x", 0, "own"), (3, "", None, 0, "own"), (4, "alone", "x", 5, "own"), (4, "alone", "x", 5, "own"), (5, "y " * 50_000, "x", 5, "own")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, n_chars long, length string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for folder, n in (("some", None), ("none", 0)):
        sf = f"{tmp_path}/{folder}"
        (docs if n is None else docs.limit(n)).write.parquet(f"file://{sf}/documents.parquet")
        (labels if n is None else labels.limit(n)).write.parquet(f"file://{sf}/labels.parquet")
        got = pipeline.run(spark, f"file://{sf}").collect()
        if n == 0:
            assert got == []
            continue
        # Without labels of both kinds nothing is rejected; equal rows are one, and so are whole copies, but a row
        # without id always stays, and as it comes first, what it shares with document 1 goes from there.
        assert {r["doc_id"] for r in got} == {None, 1, 2, 3, 4, 5} and len([r for r in got if r["doc_id"] == 4]) == 1
        assert [r["length"] for r in got if r["doc_id"] in (1, 2, 3)] == [1, 1, 1]
        assert max(r["offset"] + r["length"] for r in got) <= 2048
