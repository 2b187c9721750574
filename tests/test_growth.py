"""Steps whose work must grow with the input, not with the square of a line, a page or a table."""

import random
import time

from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import knowledge, layout, retrieval
from lectern.plans import health, index_queries
from lectern.sources import scratch
from lectern.sources.corpus import Corpus


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_split_once(spark):
    """Not again for each of its words, to count them."""
    page = spark.createDataFrame([(1, 1, " a  b\nc d \nwhole line")], "doc_id long, page_number int, text string")
    made = Corpus.spans_of(page)
    assert optimized(made).count("split(line") == 1
    rows = made.filter("line_index < 100").orderBy("span_index").select("line_index", "text").collect()
    assert [tuple(r) for r in rows] == [(0, " "), (0, "a "), (0, " "), (0, "b"), (1, "c "), (1, "d "), (1, ""), (2, "whole line")]


def test_reports_strip_margins_once(spark, sf_dir):
    """Filters on what was removed must not work out the margins anew."""
    c = Corpus(spark, sf_dir)
    c.memo["stripped"] = c.memo["quality"] = None
    assert health.stripped(c) is None and health.quality(c) is None


def test_equal_sizes_meet_no_base(spark):
    """Spans that no base can have stay out of the join."""
    rows = [(1, 1, 0, i, "x", 20.0 * i, 0.0, 20.0 * i + 10, 10.0, 10.0, 12.0, 0, 0.0) for i in range(20)]
    spans = spark.createDataFrame(rows, "doc_id long, page_number int, line_index int, span_index int, text string, x0 double, y0 double, x1 double, y1 double, origin_y double, size double, flags int, dir_y double")
    assert "largest" in optimized(layout.neighbours(spans)) and layout.neighbours(spans).isEmpty()


def test_a_long_word_is_masked_in_linear_time(spark):
    """A word is not tried again from each of its letters."""
    page = spark.createDataFrame([(1, 1, "a" * 200_000 + " x = 2", True)], "doc_id long, page_number int, content string, warned boolean")
    begin = time.monotonic()
    row = knowledge.mask_math(page).first()
    assert row["n_masked"] == 1 and row["masked"].endswith("a " + knowledge.OMITTED) and time.monotonic() - begin < 10


def test_fast_mathematics_has_the_same_matches(spark):
    texts = ["a=2x=3", "\\pα=b c", "2.5.1=3", "ab²c₁=d", "a=2x²", "x+(y) z", "αβ ≠ γ", "1.=2", "well-known a_b^c", "√x=1 y→z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    mark = lambda p: F.regexp_replace("t", p, "<$0>")
    assert df.filter(mark(knowledge.MATH_IN_LINE) != mark(knowledge._MATH_FAST)).isEmpty()


def test_fast_mathematics_anywhere_has_the_same_matches(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b2", "α", "é", "1", ".5", "=", "-", "+", "(", ")", "{x}", "\\", "²", "₁", "√", " ", "\n", "∈", "x", "/"]) for _ in range(rng.randrange(30))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    assert df.filter((found(knowledge.MATH) != found(knowledge._MATH_ANYWHERE)) | ((F.size(found(knowledge.MATH)) > 0) & ~F.col("t").rlike(knowledge._MATH_SIGN))).isEmpty()


def test_sources_are_made_bare_once(spark):
    """Not again for each expression of an item, of which there are as many as the source is long."""
    body = " ; ".join(f"a{i} = b{i}" for i in range(8000))
    items = spark.createDataFrame([(1, 1, "concepts", [1], [3], "a", "plain", body, body)], "item_id long, doc_id long, category string, ids array<long>, source_pages array<int>, formula string, name string, body string, also string")
    chunks = spark.createDataFrame([(1, 1, 3, body, [])], "chunk_id long, doc_id long, page_number int, content string, warnings array<string>")
    begin = time.monotonic()
    assert knowledge.ground(items, chunks).first()["outcome"] == "keep" and time.monotonic() - begin < 20


def test_only_texts_that_may_change_go_to_python(spark):
    df = spark.createDataFrame([("Plain Übung",), ("ﬁne é x",), (None,)], "t string")
    made = df.select("t", text.normalize_words(F.col("t"), normal_form=True).alias("w"))
    assert "nfkc(CASE WHEN" in optimized(made) or "CASE WHEN RLIKE" in optimized(made)
    assert [r["w"] for r in made.collect()] == ["plain übung", "fine é x", None]


def test_searchable_chunks_meet_their_resources_only(spark, sf_dir):
    """Covers and outlines are told in the row, without a second join of all chunks."""
    assert "LeftAnti" not in optimized(index_queries.searchable(Corpus(spark, sf_dir)))


def test_clean_texts_are_left_alone(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "b\n", "\n", " ", "\t", "\r", "\r\n", "\0", "\u3000", "\xa0", "\x85", "\u2028", "\x1c", "c d", "é"]) for _ in range(rng.randrange(12))) for _ in range(5000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    assert df.filter(~text.clean_text(F.col("t")).eqNullSafe(text._cleaned(F.col("t")))).isEmpty()
    low = [*texts, " \nCOMP 1234 : x\nWeek 1: y\nSchool of z\nd", "Outline\n1. a\n2. b\n3. c", "\u3000SYLLABUS\n- a\n- b\n- c", "x Outline"]
    told = spark.createDataFrame([(t,) for t in low], "t string").select(text.low_information(F.col("t")).alias("a"), text._low_information(F.col("t")).alias("b"))
    assert told.filter("NOT a <=> b").isEmpty() and {r["a"] for r in told.collect()} == {None, "cover", "outline"}


def test_rules_on_neighbours_follow_the_join(spark):
    anchors = spark.createDataFrame([(1, "which topic", 1, 1, 2, "Topic a", "t")], "query_id long, question string, rank int, doc_id long, page_number int, content string, title string")
    chunks = spark.createDataFrame([(1, 1, 0, 5, "Topic b")], "doc_id long, page_number int, chunk_index int, chunk_id long, content string")
    for made in (retrieval.adjacent(anchors, chunks), retrieval.bridges(anchors, chunks)):
        assert not any("Filter" in line and "[A-Za-z]+" in line for line in optimized(made).split("\n"))


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_search_shuffles_no_texts(spark, sf_dir):
    """The course and state of a chunk's resource are told in its row; a join of all chunks would write their texts."""
    c = Corpus(spark, sf_dir)
    found = index_queries.searchable(c)
    assert "Join" not in optimized(found)
    own = c.resource.select(F.col("resource_id").alias("doc_id"), "course_id", "status", "stage")
    assert same(found, found.select(*c.chunk.columns).join(own, "doc_id").select(*found.columns))


def test_only_pages_with_hits_are_judged(spark, tmp_path, monkeypatch):
    """Spans, margins and texts of documents without hits are not written."""
    page = lambda i, p: "\n".join(f"doc{i} page{p} line{k} x=..=y" if k == 3 else f"word{i}_{p}_{k} of the course" for k in range(8))
    docs = [(i, "\n".join(page(i, p) for p in range(4)), "en", f"src{i % 3}", 1) for i in range(300)]
    passage = "word121_2_4 of the course\nword121_2_5 of the course"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    c = Corpus(spark, str(tmp_path))
    made = {r["chunk_id"]: r["warnings"] for r in index_queries.page_warnings(c).collect()}
    met = index_queries.hits(c).select("doc_id").distinct().count()
    written = {p.name.split("-")[1]: spark.read.parquet(str(p)).count() for p in (tmp_path / "shared").glob("lectern-*")}
    assert len(made) == 5 and 121 in {k // 1_000_000 for k in made} and all("suspicious_symbolic_expression" in w for w in made.values())
    assert "spans" not in written and "quality" not in written and written["stripped"] <= 5 and written["pages"] == 4 * met <= 20


def test_issues_of_some_pages_are_those_of_all(spark, sf_dir):
    """Margins are told by all pages of a document, also where few of them are asked for."""
    c = Corpus(spark, sf_dir)
    wanted = c.pages.filter("page_number % 3 = 2").select("doc_id", "page_number")
    made, of_all = health.issues_on(c, wanted), health.issues(c).filter("page_number % 3 = 2")
    assert same(made, of_all) and {"repeated_header_footer", "suspicious_formula_layout", "unusual_symbol_position"} <= {r["code"] for r in made.select("code").distinct().collect()}
    assert health.issues_on(c, wanted.limit(0)).isEmpty()


def test_long_lists_of_ids_are_shuffled_with_the_same_result(spark, sf_dir, monkeypatch):
    sent = index_queries.page_warnings(Corpus(spark, sf_dir))
    monkeypatch.setattr(scratch, "SENT", 0)
    assert same(index_queries.page_warnings(Corpus(spark, sf_dir)), sent)
