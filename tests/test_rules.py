"""Rules on small inputs with literal expectations."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import chunking, text, urls, vectors
from lectern.operators import catalog, classify, evaluate, index, knowledge, links, pages, retrieval, sync


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "cleaned"), [("\r\na  \r\n\r\n\r\n\r\nb\t\n\n", "a\n\nb"), ("  indented\x00 ", "  indented"), ("", "")])
def test_clean_text(spark, raw, cleaned):
    assert one(spark, text.clean_text, raw) == cleaned


@pytest.mark.parametrize(
    ("content", "reason"),
    [
        ("COMP1234: Networks\nWeek 3: Routing\nSchool of Computing\nSemester 1", "cover"),
        ("Syllabus\n1. Graphs\n2. Trees\n- Heaps", "outline"),
        ("COMP1234: Networks\nWeek 3: Routing\nSchool of Computing\nWhat is a route?", None),
        ("x = y + 1", None),
        ("", None),
        ("Outline\n1. Graphs\nplain words", None),
    ],
)
def test_low_information(spark, content, reason):
    assert one(spark, text.low_information, content) == reason


def test_exam_cue_and_negation(spark):
    assert one(spark, text.exam_cue, "This is in the exam.") is True
    assert one(spark, text.exam_cue, "This is not in the exam.") is False
    assert one(spark, text.exam_cue, "A CRC test.") is False


def test_exercise_prompt(spark):
    assert one(spark, text.exercise_prompt, "Question 3 compute it", "x.pdf") is True
    assert one(spark, text.exercise_prompt, "Question 3\nSolution: 4", "x.pdf") is False
    assert one(spark, text.exercise_prompt, "Calculate the sum", "homework.pdf") is True


@pytest.mark.parametrize(
    ("href", "base", "want"),
    [
        ("/a?b#c", "https://X.example.org/p/q", "https://x.example.org/a?b"),
        ("d.pdf", "https://x.org:443/p/q?z", "https://x.org/p/d.pdf"),
        ("http://x.org/", "https://x.org", None),
        ("https://u:p@x.org/", "https://x.org", None),
        ("https://x.org?a=1", "https://y.org", "https://x.org/?a=1"),
    ],
)
def test_urls(spark, href, base, want):
    assert one(spark, lambda h, b: urls.normalize(urls.resolve(h, b)), href, base) == want


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([1e308, 1e308],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,)], "v array<double>")
    got = df.select(vectors.invalid_reason(F.col("v"), 2).alias("r")).collect()
    assert [r["r"] for r in got] == [None, None, "zero", "not finite", "dimension", "empty"]
    good = df.filter(vectors.invalid_reason(F.col("v"), 2).isNull()).select(F.round(vectors.dot(vectors.unit(F.col("v")), vectors.unit(F.col("v"))), 9).alias("n")).collect()
    assert [r["n"] for r in good] == [1.0, 1.0]


def test_split_page_covers_and_bounds():
    words = [f"word{i}{'.' if i % 9 == 0 else ''}" for i in range(600)]
    page = " ".join(words).replace("word100 ", "word100\n\n").replace("word333 ", "word333\n")
    at = 0
    for a, b in chunking.spans(page, 200, 20):
        assert 0 < b - a <= 200 and a <= at < b
        assert a == 0 or page[a - 1].isspace() or not page[a - 1 : a + 1].isalnum()
        at = b
    assert at == len(page)
    assert chunking.split_page(page, 200, 20) == [page[a:b] for a, b in chunking.spans(page, 200, 20)]
    with pytest.raises(ValueError):
        chunking.split_page("x", 10, 10)
    assert chunking.split_page("", 10, 1) == []
    assert chunking.split_page("   ", 10, 1) == []


def test_index_lifecycle(spark):
    chunk = "chunk_id long, course_id string, content_hash string, source_hash string, usable boolean"
    old = spark.createDataFrame([(1, "m", "a", "s", True), (2, "m", "b", "s", True), (3, "m", "c", "s", True), (9, "m", "z", "s", True), (5, "m", "e", "s", True)], "chunk_id long, model string, content_hash string, source_hash string, valid boolean")
    old = old.select("chunk_id", "model", F.lit("v1").alias("model_version"), F.lit(2).alias("dimensions"), "content_hash", "source_hash", "valid")
    now = spark.createDataFrame([(1, "x", "a", "s", True), (2, "x", "B", "s", True), (4, "x", "d", "s", True), (3, "x", "c", "s", False), (6, "x", "f", "s", False), (5, "x", "e", "s", True)], chunk)
    diff = index.index_diff(now, old, "m", "v1", 2)
    assert {r["chunk_id"]: r["action"] for r in diff.collect()} == {1: "skipped", 2: "updated", 3: "removed", 4: "new", 5: "skipped", 6: "unusable", 9: "removed"}
    stored = old.withColumn("embedding", F.array(F.lit(9.0)))
    plan = index.planned(now, diff)
    made = plan.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    new = index.index_apply(stored, diff, plan, made, now, "m", "v1", 2)
    assert {r["action"] for r in index.index_diff(now, new, "m", "v1", 2).collect()} == {"skipped", "unusable"}
    # another version of the model, or vectors of another length, are not current
    assert {r["chunk_id"] for r in index.index_diff(now, old, "m", "v2", 2).filter("action = 'updated'").collect()} == {1, 2, 5} == {r["chunk_id"] for r in index.index_diff(now, old, "m", "v1", 3).filter("action = 'updated'").collect()}
    short = made.withColumn("embedding", F.array(F.lit(1.0)))
    assert {r["chunk_id"] for r in index.index_apply(stored, diff, plan, short, now, "m", "v1", 2).filter("NOT valid").collect()} == {2, 4}
    # a stored state wins where indexing runs or failed, and a course that failed is not made ready
    reports = spark.createDataFrame([("x", "indexing")], "course_id string, stored string")
    assert [r["state"] for r in index.index_status(diff, reports).collect()] == ["indexing"]
    assert [r["state"] for r in index.index_status(diff, reports.withColumn("stored", F.lit("ready"))).collect()] == ["stale"]
    fleet = index.fleet_summary(diff, reports.select("course_id")).first()
    assert (fleet["ready_after"], fleet["newly_indexed"], fleet["errors"]) == (0, 0, 1) and index.fleet_summary(diff).first()["ready_after"] == 1
    # a batch is refused as a whole if one of its sources changed, and what has no vector is not valid
    plan = index.planned(now, diff, batch_ids=3)
    state = lambda df: {r["chunk_id"]: (r["content_hash"], r["valid"], r["embedding"]) for r in df.collect()}
    changed = now.withColumn("content_hash", F.when(F.col("chunk_id") == 2, "C").otherwise(F.col("content_hash")))
    assert state(index.index_apply(stored, diff, plan, made.filter("chunk_id <> 4"), changed, "m", "v1", 2)) == {1: ("a", True, [9.0]), 2: ("b", True, [9.0]), 5: ("e", True, [9.0]), 4: ("d", False, None)}
    assert index.refused(index.planned(now, diff), changed.filter("chunk_id <> 2")).count() == 1
    assert index.refused(plan, now.filter("chunk_id < 0")).count() == 2


def test_roles(spark):
    rows = [(1, {"filename": "Lecture 3.pdf"}), (2, {"filename": "tut5.pdf", "module_title": "Lectures"}), (3, {"filename": "Reading.pdf", "link_text": "Tutorial"}), (4, {"nearby_text": "notes"}), (5, {"filename": "Assignment2.pdf"})]
    got = {r["material_id"]: (r["role"], r["confidence"]) for r in classify.role_decision(spark.createDataFrame(rows, "material_id long, metadata map<string,string>")).collect()}
    assert got[1] == ("lecture", 0.9)
    assert got[3] == ("tutorial", 0.9)
    assert got[4] == ("other", 0.0)
    assert got[5] == ("other", 0.9) or got[5][0] == "other"


def test_hits_and_rerank(spark):
    q = spark.createDataFrame([(1, 7, [1.0, 0.0])], "query_id long, course_id int, embedding array<double>")
    x = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [0.8, 0.6]), (3, 7, [0.0, 1.0]), (4, 8, [1.0, 0.0])], "chunk_id long, course_id int, embedding array<double>")
    hits = retrieval.top_k(q, x, 2)
    assert [(r["chunk_id"], r["rank"]) for r in hits.orderBy("rank").collect()] == [(1, 1), (2, 2)]
    order = retrieval.rerank(hits, F.col("chunk_id")).orderBy("rank").collect()
    assert [(r["chunk_id"], r["original_rank"]) for r in order] == [(2, 2), (1, 1)]


def test_context_balances_and_bridges(spark):
    body = "Routing tables\n" + "word " * 30
    chunks = spark.createDataFrame([(i, 1, p, i, t) for i, p, t in [(1, 2, "Question 1 on routing"), (2, 4, body), (3, 5, body), (4, 9, "else\n" + "word " * 30)]], "chunk_id long, doc_id long, page_number int, chunk_index int, content string")
    ranked = chunks.filter("chunk_id IN (1, 2)").select(F.lit(1).alias("query_id"), F.lit("what is routing tables").alias("question"), F.col("chunk_id").cast("int").alias("rank"), "chunk_id", "doc_id", "page_number", "content", F.lit("x.pdf").alias("title"), F.lit("lecture").alias("role"))
    got = [(r["chunk_id"], r["added"]) for r in retrieval.select_context(ranked, chunks, 3).orderBy("place").collect()]
    assert got == [(2, False), (1, False), (3, True)]


def test_answers(spark):
    drafts = spark.createDataFrame([(1, True, "A [1].", [1]), (2, True, "A [1].", [1, 1]), (3, True, "A [3].", [3]), (4, True, "A [2].", [1]), (5, False, "none", []), (6, True, "A", [])], "query_id long, answerable boolean, answer string, citation_ids array<int>")
    places = spark.createDataFrame([(q, p) for q in range(1, 7) for p in (1, 2)], "query_id long, place int")
    assert {r["query_id"]: r["error"] for r in retrieval.check_answers(drafts, places).collect()} == {1: None, 2: "repeated", 3: "unknown", 4: "inline", 5: None, 6: "abstention"}


def test_mask_math(spark):
    data = [
        (1, 1, "so a = b + 1 holds", True), (1, 2, "a data-link layer", True), (1, 3, "a = b", False), (1, 4, None, True), (1, 5, "a \ue123 b", False),
        (1, 6, "f(x) = y, and\n= z alone", True), (1, 7, "see \ufffd now, xa=b(c)d-e end", True), (1, 8, "a\n= b", True),
    ]
    df = spark.createDataFrame(data, "doc_id long, page_number int, content string, warned boolean")
    got = {r["page_number"]: (r["masked"], r["n_masked"]) for r in knowledge.mask_math(df).collect()}
    assert got[1] == (f"so {knowledge.OMITTED} holds", 1)
    assert got[2] == ("a data-link layer", 0)
    assert got[3] == ("a = b", 0)
    assert got[4] == ("", 0)
    assert got[5] == ("a [UNREADABLE_SYMBOL] b", 1)
    assert got[6] == (f"{knowledge.OMITTED}, and\n= z alone", 1)
    assert got[7] == (f"see [UNREADABLE_SYMBOL] now, {knowledge.OMITTED} end", 2)
    assert got[8] == ("a\n= b", 0)


def test_change_class(spark):
    """A known file without a stored time is updated, one without a new time an error; external material goes by revision."""
    s = "resource_id long, revision string, updated_at int"
    old = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, None, 1), (4, None, 2), (5, None, None), (7, None, 1), (8, None, 3), (9, None, 1), (11, None, 5)], s)
    new = spark.createDataFrame([(1, "a", 9), (2, "b", 1), (3, None, 2), (4, None, 2), (5, None, 1), (6, None, 1), (7, None, None), (8, None, 2), (10, None, None), (11, "a", None), (12, "a", None)], s)
    want = {1: "UNCHANGED", 2: "UPDATED", 3: "UPDATED", 4: "UNCHANGED", 5: "UPDATED", 6: "NEW", 7: "ERROR", 8: "UNCHANGED", 9: "MISSING", 10: "ERROR", 11: "UPDATED", 12: "NEW"}
    assert {r["resource_id"]: r["change"] for r in sync.change_class(old, new).collect()} == want


def test_next_action(spark):
    rows = [(False, "UNCHANGED", "completed", "done", ".pdf"), (False, "UNCHANGED", "failed", "done", ".pdf"), (False, "UNCHANGED", "failed", "parse", ".PDF"), (False, "UNCHANGED", "failed", "parse", ".pptx"), (False, "UNCHANGED", "parsed", None, ".pdf"), (True, "NEW", "parsed", None, ".pdf"), (False, "UPDATED", "parsed", "parse", ".pptx")]
    df = spark.createDataFrame(rows, "l boolean, c string, s string, g string, t string").coalesce(1)
    got = df.select(sync.next_action(F.col("l"), F.col("c"), F.col("s"), F.col("g"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["skip", "knowledge", "parse", "unsupported", "knowledge", "error", "download+invalidate"]


def test_counters(spark):
    events = [(1, "discovery", "file"), (1, "discovery", "page_linked_file"), (1, "download", "updated"), (1, "download", "downloaded"), (1, "skip", "ignored_reading_material"), (1, "skip", None), (2, "error", None), (2, None, None)]
    got = {r["run_id"]: r for r in sync.counters(spark.createDataFrame(events, "run_id long, stage string, outcome string")).collect()}
    assert [got[1][c] for c in ("discovered", "page_linked_files", "downloaded", "updated", "skipped", "ignored_readings", "failed", "status")] == [2, 1, 2, 1, 2, 1, 0, "completed"]
    assert (got[2]["failed"], got[2]["status"]) == (1, "completed_with_errors")


def test_first_discovery_merges_later_ones(spark):
    rows = [("k", 2, 0, False, "late", ["b", "c"]), ("k", 1, 5, False, "", ["a", "b"]), ("k", 3, 0, True, "later", None), ("m", 1, 1, False, None, [])]
    got = {r["key"]: tuple(r)[1:] for r in sync.first_discovery(spark.createDataFrame(rows, "key string, page_id long, pos int, linked boolean, title string, evidence array<string>")).collect()}
    assert got == {"k": (1, 5, 3, True, "late", ["a", "b", "c"]), "m": (1, 1, 1, False, None, [])}


def test_gold_rules(spark):
    asked = [(1, "q", 5, None), (2, "q", 5, [1, 2]), (3, " ", 5, None), (4, None, 5, None), (5, "x" * 4001, 5, None), (0, "q", 5, None), (6, "q", 0, None), (7, "q", 5, [1, 1]), (8, "q", 5, [0]), (9, "q", 5, [None]), (10, "q", None, None), (11, "q", 5, [])]
    got = {r["item_id"]: r["problem"] for r in evaluate.bad_questions(spark.createDataFrame(asked, "item_id long, question string, expected long, pages array<int>")).collect()}
    assert got == {3: "question", 4: "question", 5: "length", 0: "id", 6: "expected", 7: "pages", 8: "pages", 9: "pages", 10: "expected"}
    samples = [("a", "lecture"), ("b", "exam"), ("c", None), ("d", "other"), ("d", "other"), (" ", "other"), (None, "other")]
    got = {r["sample_id"]: r["problem"] for r in evaluate.bad_samples(spark.createDataFrame(samples, "sample_id string, expected string"), ["lecture", "other"]).collect()}
    assert got == {"b": "label", "c": "label", "d": "repeated", " ": "id", None: "id"}


def test_projection_and_week_view(spark):
    items = spark.createDataFrame([(1, "concepts", 0, "n", "t", [3, 4], True), (1, "questions", 1, "q", "a", [], None), (1, "formulas", 2, "f", "x", [2, 2, 0, -1], False), (2, "formulas", 0, "g", "y", [2, 2, 0, -1], True)], "doc_id long, category string, idx int, name string, body string, source_pages array<int>, reliable boolean")
    rows = [tuple(r) for r in knowledge.projection(items).orderBy("idx").collect()]
    assert rows == [("concept", 1, 0, "n", "t", 3), ("question", 1, 1, "q", "a", None)]
    resources = spark.createDataFrame([(1, "c", "w", "p"), (2, "c", "w", None)], "doc_id long, course_id string, week_id string, path string")
    view = {(r["doc_id"], r["idx"]): (r["pages"], r["links"]) for r in knowledge.week_view(items.withColumnRenamed("body", "text"), resources).collect()}
    assert view == {(1, 0): ([3, 4], ["/api/resources/1/file#page=3", "/api/resources/1/file#page=4"]), (1, 1): ([], []), (2, 0): ([2], [])}


def test_batch_conflicts(spark):
    s = "chunk_id long, doc_id long, page_number int"
    got = knowledge.batch_conflicts(spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2), (4, 1, 1)], s), spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 1, 1)], s))
    assert {r["chunk_id"]: r["problem"] for r in got.collect()} == {2: "document", 3: "page", 4: "missing"}

def test_hit_at_k_unresolved(spark):
    gold = spark.createDataFrame([(1, 10, [2, 3]), (2, 10, None)], "item_id long, expected long, pages array<int>")
    hits = spark.createDataFrame([(1, 1, 11, 2), (1, 2, 10, 9), (1, 3, 10, 3)], "item_id long, rank int, doc_id long, page_number int")
    r = evaluate.hit_at_k(hits, gold).first()
    assert (r["questions"], r["resolved"], r["resource_hit_1"], r["resource_hit_3"], r["evidence_hit_3"]) == (2, 1, 0.0, 0.5, 1.0)


def test_active_courses(spark):
    courses = spark.createDataFrame([("a", 1), ("b", 2)], "course_id string, semester_id int")
    semesters = spark.createDataFrame([(1, True), (2, False)], "semester_id int, is_active boolean")
    ids = lambda df: sorted(r["course_id"] for r in df.collect())
    assert ids(catalog.active_courses(courses, semesters)) == ["a"]
    assert ids(catalog.active_courses(courses, semesters, named=2)) == ["b"]
    assert ids(catalog.active_courses(courses, semesters.filter("NOT is_active"))) == []


def test_course_closure(spark):
    make = spark.createDataFrame
    tables = {
        "semester": make([(1,), (2,)], "semester_id int"), "course": make([("a", 1), ("b", 2), ("c", 9)], "course_id string, semester_id int"), "week": make([("w", "a"), ("v", "b")], "week_id string, course_id string"),
        "resource": make([(1, "w", "a"), (2, "v", "b"), (3, "gone", "a")], "resource_id long, week_id string, course_id string"), "chunk": make([(10, 1), (20, 2)], "chunk_id long, resource_id long"), "vector": make([(10,), (20,), (30,)], "chunk_id long"),
    }
    own = catalog.course_closure(tables, "a")
    assert {n: t.count() for n, t in own.items()} == {"course": 1, "semester": 1, "week": 1, "resource": 2, "chunk": 1, "vector": 1}
    assert [tuple(r) for r in catalog.lost_rows(own).collect()] == [("resource", "gone")]
    assert "vector" not in catalog.course_closure(tables, "a", vectors=False)
    assert catalog.course_closure(tables, "nobody")["semester"].count() == 0


def test_report_is_never_overwritten(spark, tmp_path):
    report = spark.range(2)
    assert catalog.write_report(report, f"file://{tmp_path}/r").count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        catalog.write_report(report, f"file://{tmp_path}/r")


def test_bridges_and_neighbours_of_two_documents(spark):
    """Bridges between the chosen: pages of one number in two documents are two pages; exercises never added;
    neighbours of explanations come before those of other anchors."""
    body = lambda h: f"{h}\n" + "word " * 30
    data = [(d * 100 + p, d, p, body("Routing tables")) for d in (1, 2) for p in (1, 2, 3)] + [(301, 3, 2, "Question 1 on routing\n" + "word " * 30)]
    chunks = spark.createDataFrame(data, "chunk_id long, doc_id long, page_number int, content string").withColumn("chunk_index", F.col("page_number"))
    def ranked(ids):
        own = chunks.filter(F.col("chunk_id").isin(ids)).withColumn("rank", F.array_position(F.array(*map(F.lit, ids)), F.col("chunk_id")).cast("int"))
        return own.withColumn("query_id", F.lit(1)).withColumn("question", F.lit("what is routing")).withColumn("title", F.lit("x.pdf")).withColumn("role", F.lit("other"))
    context = lambda ids, limit=3: [(r["chunk_id"], r["added"]) for r in retrieval.select_context(ranked(ids), chunks, limit).orderBy("place").collect()]
    assert context([101, 103, 203]) == [(101, False), (103, False), (203, False), (102, True)]
    assert context([101, 103, 201, 203], limit=4) == [(101, False), (103, False), (201, False), (203, False), (102, True)]
    assert context([301, 102]) == [(102, False), (301, False), (101, True), (103, True)]
    assert context([301]) == [(301, False)]


PAGE = """<h1>Course</h1><h2>Week 1</h2><p>Read these</p><ul><li>First <a href="/files/31/download" title="Slides">part one</a> of two</li><li><a href="#top">up</a></li></ul>
<h2>Week 2</h2><p>Far away <a HREF="/ignored" data-api-endpoint="/api/v1/courses/1/files/7">seven</a></p><a href="https://public.test/a.pdf?x=1&amp;y=2#page=3">PDF</a>
<form><a href="/files/9">no</a></form><script><a href="/files/8">no</a></script><a href="javascript:alert(1)">bad</a><a href="https://evil.test/files/4">other</a><a href="/attachment" data-file-id="5">five</a>"""


def test_page_links_and_context(spark):
    df = spark.createDataFrame([(1, "https://canvas.test/courses/1/pages/x", PAGE), (2, None, None), (3, None, "")], "page_id long, url string, html string")
    rows = [r.asDict() for r in links.page_links(df).orderBy("pos").collect()]
    assert [(r["link_text"], r["kind"], r["file_id"]) for r in rows] == [("part one", "file", 31), ("seven", "file", 7), ("PDF", "document", None), ("bad", "unsupported", None), ("other", "unsupported", None), ("five", "file", 5)]
    assert [rows[0][k] for k in ("heading", "before", "around", "title")] == ["Course Week 1", "Read these", "First part one of two", "Slides"]
    assert [rows[1][k] for k in ("heading", "before", "around", "title")] == ["Course Week 2", "", "Far away seven", ""]
    assert rows[2]["target"] == "https://public.test/a.pdf?x=1&y=2"


def test_page_limits(spark):
    df = spark.createDataFrame([(1, "https://a.test/", "x" * 2_000_001), (2, "https://a.test/", '<a href="/files/1">x</a>' * 2001), (3, "https://a.test/", '<a href="/files/1">x</a>' * 2000)], "page_id long, url string, html string")
    found = links.page_links(df).groupBy("page_id").agg(F.max("problem").alias("p"), F.count(F.lit(1)).alias("n")).orderBy("page_id").collect()
    assert [tuple(r) for r in found] == [(1, "size", 1), (2, "links", 1), (3, None, 2000)]


def test_grounding_reduces_and_drops(spark):
    chunks = spark.createDataFrame([(1, 1, 3, "a = b holds. Some text", [])], "chunk_id long, doc_id long, page_number int, content string, warnings array<string>")
    item = lambda k, category, name, body, also=None, ids=(1,), pages=(3,): (k, 1, category, list(ids), list(pages), "a = b", name, body, also)
    data = [
        item(1, "concepts", "plain", "so a = b"), item(2, "concepts", "plain", "so a ∮ b", "safe words"), item(3, "concepts", "plain", "so a ∮ b"), item(4, "concepts", "a ∮ b", "fine", "fine"),
        item(5, "key_points", None, "so a ∮ b", "safe words"), item(6, "formulas", None, None), item(7, "exam_focus", None, "plain"), item(8, "concepts", "plain", "plain", ids=(1, 1)), item(9, "examples", None, "plain", ids=(2,)), item(10, "concepts", "plain", None, pages=(4,)),
    ]
    items = spark.createDataFrame(data, "item_id long, doc_id long, category string, ids array<long>, source_pages array<int>, formula string, name string, body string, also string")
    got = {r["item_id"]: (r["outcome"], r["reason"]) for r in knowledge.ground(items, chunks).collect()}
    assert got == {1: ("keep", None), 2: ("reduce", "symbols"), 3: ("drop", "symbols"), 4: ("drop", "symbols"), 5: ("drop", "symbols"), 6: ("keep", None), 7: ("drop", "cue"), 8: ("fail", "ids"), 9: ("drop", "ids"), 10: ("fail", "pages")}


def test_unsafe_symbols(spark):
    data = [("a = b", ["so a=b"]), ("a = c", ["so a=b"]), ("data-link", []), ("sign = to", []), ("有 ∈ 无", ["有 无"]), ("有 ∈ 无", ["x ∈ y"]), ("x \ue001", ["x \ue001"]), ("see /", ["see \ufffd"]), ("see /", ["see"])]
    df = spark.createDataFrame(data, "body string, contents array<string>").coalesce(1)
    assert [r[0] for r in df.select(knowledge.unsafe_symbols(F.col("body"), F.col("contents"))).collect()] == [False, True, False, False, True, False, True, True, False]


def test_paired_reports(spark):
    gold = spark.createDataFrame([(1, "q", "x", 10, [2, 3]), (2, "r", None, 10, None), (3, "s", "x", 11, [1])], "item_id long, question string, course_id string, expected long, pages array<int>")
    hits = "item_id long, rank int, doc_id long, page_number int"
    one = evaluate.question_report(spark.createDataFrame([(1, 1, 10, 9), (1, 2, 10, 3), (2, 1, 10, 1)], hits), gold)
    two = evaluate.question_report(spark.createDataFrame([(1, 1, 10, 2), (2, 2, 10, 1)], hits), gold)
    got = sorted((r["item_id"], r["metric"], r["before"], r["after"], r["regressed"]) for r in evaluate.pair_reports(one, two).collect())
    assert got == [(1, "evidence_hit_at_1", False, True, False), (2, "resource_hit_at_1", True, False, True)]
    for other in (two.filter("item_id <> 3"), two.withColumn("pages", F.array(F.lit(7)))):
        with pytest.raises(Exception, match="gold of the two reports differs"):
            evaluate.pair_reports(one, other).collect()


def test_drafts_are_parsed_strictly(spark):
    good = '{"citation_ids": [2, 1], "answerable": true, "answer": "A [1] and [2]."}'
    data = [good, '{"answerable": false, "answer": "x", "citation_ids": []}', '{"answerable": "true", "answer": "x", "citation_ids": []}', '{"answerable": true, "answer": 5, "citation_ids": []}', '{"answerable": true, "answer": "x [1]", "citation_ids": [1.0]}',
            '{"answerable": true, "answer": "x [1]", "citation_ids": [1, null]}', '{"answerable": true, "answer": "", "citation_ids": []}', '{"answerable": true, "answer": "x"}', "[]", "x", "", None, '{"answerable": false, "answer": "x", "citation_ids": [null]}', '{"answerable": false, "answer": "x", "citation_ids": [1, 2, 3, 4, 5, 6]}', '{"answerable": false, "answer": " ", "citation_ids": []}', '{"answerable": null, "answer": "x", "citation_ids": []}', good + " x", good + good, good + ", " + good, good + "] "]
    raw = spark.createDataFrame(list(enumerate(data)), "query_id long, draft string")
    drafts = retrieval.parse_drafts(raw)
    evidence = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "c")], "query_id long, place int, title string")
    errors = {r["query_id"]: r["error"] for r in retrieval.check_answers(drafts, evidence).collect()}
    assert errors == {k: None if k < 2 else "blank" if k == 14 else "json" for k in range(len(data))}
    got = {r["query_id"]: (r["answer"], r["sources"] and [tuple(s) for s in r["sources"]]) for r in retrieval.answers(drafts, evidence).collect()}
    assert got == {0: ("A [1] and [2].", [(1, "a"), (2, "b")]), 1: (retrieval.INSUFFICIENT, None)}


def test_prompt_batches(spark):
    import json

    data = [(k, 1, 1, k, "z" * n, []) for k, n in enumerate([100, 300, 2000, 10, 0, 700])] + [(9, 2, 1, 0, None, None)]
    chunks = spark.createDataFrame(data, "chunk_id long, doc_id long, page_number int, chunk_index int, content string, warnings array<string>")
    got = [r.asDict() for r in knowledge.prompt_batches(chunks, 600, 5).collect()]
    encoded = lambda r: {"source_chunk_id": r["chunk_index"], "resource_id": 1, "page_number": 1, "chunk_index": r["chunk_index"], "content": "z" * r["n_chars"], "warnings": [], "label": f"[CHUNK_ID={r['chunk_index']} | PAGE=1]"}
    own = sorted((r for r in got if r["doc_id"] == 1), key=lambda r: (r["batch"], r["chunk_index"], r["part"]))
    length = lambda rows: len(json.dumps({"chunks": [encoded(r) for r in rows]}, separators=(",", ":")))
    batches = [[r for r in own if r["batch"] == b] for b in range(own[-1]["batch"] + 1)]
    assert all(length(b) <= 600 for b in batches) and all(length([*a, b[0]]) > 600 for a, b in zip(batches, batches[1:]))
    assert [sum(r["n_chars"] for r in own if r["chunk_index"] == k) for k in range(6)] == [100, 300, 2000, 10, 0, 700]
    assert [(r["chunk_index"], r["part"]) for r in own] == sorted((r["chunk_index"], r["part"]) for r in own)
    assert all(r["too_many"] for r in own) and [(r["n_chars"], r["too_many"]) for r in got if r["doc_id"] == 2] == [(0, False)]


def test_invalidated_summaries(spark):
    items = spark.createDataFrame([(k, d, c, 0, "o", "p", [1]) for k, (d, c) in enumerate([(1, "concepts"), (2, "concepts"), (2, "key_points"), (3, "concepts")])], "item_id long, doc_id long, category string, idx int, overview string, point string, pages array<int>")
    resources = spark.createDataFrame([(1, "a", "w"), (2, "a", "w"), (3, "a", "v")], "doc_id long, course_id string, week_id string")
    concepts, summaries = knowledge.invalidate(items, resources, spark.createDataFrame([(1,)], "doc_id long"))
    assert sorted(r["doc_id"] for r in concepts.collect()) == [2, 3]
    assert [(r["week_id"], r["resource_id"], r["point"]) for r in summaries.collect()] == [("w", 2, "p [Resource 2, pages 1]")] * 2
