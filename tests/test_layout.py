"""Layout rules on small pages, with cases on both sides of each bound."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import layout, pages

SPANS = "doc_id long, page_number int, line_index int, span_index int, text string, x0 double, y0 double, x1 double, y1 double, origin_y double, size double, flags int, dir_y double"
PAGES = "doc_id long, page_number int, raw_text string, width double, height double"


def span(text, x, baseline, size=20.0, flags=0, line=0, index=0, page=1, doc=1, width=20.0, lean=0.0):
    return (doc, page, line, index, text, float(x), float(baseline - size), float(x + width), baseline + 2.0, float(baseline), float(size), flags, lean)


def moved(spark, *spans):
    spans = [s[:3] + (i,) + s[4:] for i, s in enumerate(spans)]
    return {r["span"]: r["symbol"] for r in layout.shifted(spark.createDataFrame(spans, SPANS)).collect()}


@pytest.mark.parametrize("baseline", [94, 106])
def test_raised_and_lowered_spans(spark, baseline):
    assert moved(spark, span("x", 20, 100), span("2(N-1)", 41, baseline, 13)) == {1: False}


def test_flag_and_symbol(spark):
    assert moved(spark, span("a", 20, 100), span(".", 41, 96, 13, flags=1), span("b", 62, 100)) == {1: True}


@pytest.mark.parametrize(
    "spans",
    [
        [span("normal", 20, 100), span("small", 41, 100, 13)],
        [span("title", 20, 100), span("body", 20, 200, 13, line=1)],
        [span("normal", 20, 100), span("far away", 400, 94, 13)],
        [span("normal", 20, 100), span("2", 41, 94, 13, lean=0.06, flags=1)],
        [span("normal", 20, 100), span(" ", 41, 94, 13)],
    ],
)
def test_what_is_not_shifted(spark, spans):
    assert moved(spark, *spans) == {}


def test_bounds(spark):
    """Base of 12.5 points: smaller than 10.625, at most 12.5 away, 1.5 to 8.125 off its baseline."""
    base = span("x", 100, 100, 12.5)
    assert moved(spark, base, span("2", 120, 98.5, 10.5)) == {1: False}
    assert moved(spark, base, span("2", 120, 98.5, 10.625)) == {}
    assert moved(spark, base, span("2", 120, 98.625, 10)) == {}
    assert moved(spark, base, span("2", 120, 108.125, 10)) == {1: False}
    assert moved(spark, base, span("2", 120, 108.25, 10)) == {}
    assert moved(spark, base, span("2", 132.5, 97, 10)) == {1: False}
    assert moved(spark, base, span("2", 132.625, 97, 10)) == {}
    assert moved(spark, base, span("2", 67.5, 97, 10)) == {1: False}
    assert moved(spark, base, span("2", 67.375, 97, 10)) == {}
    assert moved(spark, span("x", -9000, 100, 12.5), span("2", 90_000, 97, 10)) == {}
    assert moved(spark, span("x", 90_000, 100, 12.5), span("2", 90_020, 97, 10)) == {1: False}


def test_pairs_do_not_depend_on_bins(spark):
    spans = [span(str(i), (i * 37) % 500, 100 + i % 3 * 3, 8 + i % 4 * 3, index=i) for i in range(60)]
    df = spark.createDataFrame(spans, SPANS)
    got = [sorted(map(tuple, layout.neighbours(df, bin_width=w, most=m).collect())) for w, m in ((50.0, 64), (7.0, 64), (5000.0, 64), (20.0, 3))]
    want = sorted((1, 1, a[3], b[3]) for a in spans for b in spans
                  if a is not b and a[10] < 0.85 * b[10] and max(b[5] - a[7], a[5] - b[7], 0) <= b[10] and 0.12 * b[10] <= abs(a[9] - b[9]) <= 0.65 * b[10])
    assert len(want) > 10 and got == [want] * 4


def test_page_quality(spark):
    sheets = spark.createDataFrame([(1, 1, "", 0.0, 0.0), (1, 2, "  \n", 0.0, 0.0), (1, 3, None, 0.0, 0.0), (1, 4, "中文 � + �", 0.0, 0.0), (1, 5, "if a == b", 0.0, 0.0)], PAGES)
    got = pages.page_quality(sheets, spark.createDataFrame([span("x", 20, 100, page=5), span("²", 41, 94, 13, page=5, index=1), span("+", 41, 94, 13, page=5, index=2)], SPANS))
    rows = {(r["page_number"], r["code"]): (r["occurrences"], r["span_indices"]) for r in got.collect()}
    blank = {(p, c): (1, []) for p in (1, 2, 3) for c in ("empty_text", "possible_scanned_page")}
    assert rows == blank | {(4, "encoding_warning"): (2, []), (5, "suspicious_formula_layout"): (2, [1, 2]), (5, "unusual_symbol_position"): (1, [2])}


def sheet(doc, page, lines, width=600.0, height=800.0):
    """lines: (text, x, baseline, size). A page whose raw text has a line for each of them."""
    made = [span(t, x, y, size, line=i, index=i, page=page, doc=doc, width=4.0 * len(t)) for i, (t, x, y, size) in enumerate(lines)]
    return made, (doc, page, "\n".join(t for t, *_ in lines), width, height)


def strip(spark, sheets):
    spans = spark.createDataFrame([s for made, _ in sheets for s in made], SPANS)
    stripped = layout.strip_margins(spans, spark.createDataFrame([p for _, p in sheets], PAGES))
    return {r["page_number"]: (r["text"], r["headers_removed"], r["footers_removed"], sorted(r["span_indices"])) for r in stripped.collect()}


HEAD, FOOT, BODY = ("Repeated lecture header", 40, 25, 8), ("Example University", 40, 775, 8), ("TCP and CRC", 40, 200, 14)


def document(count, *more, head=HEAD):
    return [sheet(1, n, [head, (f"Body title {n}", 40, 140, 20), BODY, *more, FOOT, (f"Page {n}", 530, 775, 8)]) for n in range(1, count + 1)]


def test_header_footer_and_own_number_go(spark):
    got = strip(spark, document(5))
    assert got == {n: (f"Body title {n}\nTCP and CRC", 1, 2, [0, 3, 4]) for n in range(1, 6)}


def test_raw_line_of_several_margins(spark):
    sheets = [(made, (d, n, raw.replace(f"\nPage {n}", f"    Page {n}"), w, h)) for made, (d, n, raw, w, h) in document(5)]
    assert strip(spark, sheets)[3] == ("Body title 3\nTCP and CRC", 1, 2, [0, 3, 4])
    beside = [(made, (d, n, raw.replace("Example University", "Example University x"), w, h)) for made, (d, n, raw, w, h) in document(5)]
    assert strip(spark, beside)[3] == ("Body title 3\nTCP and CRC\nExample University x", 1, 1, [0, 4])


def test_a_header_that_the_body_has_too_stays(spark):
    got = strip(spark, document(5, ("Repeated lecture header", 40, 300, 14)))
    assert all(t.count("Repeated lecture header") == 2 and h == 0 for t, h, _, _ in got.values())


@pytest.mark.parametrize("head", [("Repeated lecture header", 40, 25, 13.75), ("Repeated lecture header", 40, 70, 8), ("CRC", 40, 25, 8), ("Header", 40, 25, 8), ("x y" * 40, 40, 25, 8)])
def test_size_place_and_length_are_required(spark, head):
    assert {(h, f) for _, h, f, _ in strip(spark, document(5, head=head)).values()} == {(0, 2)}


def test_too_few_pages(spark):
    assert {(h, f) for _, h, f, _ in strip(spark, document(2)).values()} == {(0, 0)}
    rare = [sheet(1, n, [*([HEAD] if n < 7 else []), BODY]) for n in range(1, 11)]
    assert {h for _, h, _, _ in strip(spark, rare).values()} == {0}
    often = [sheet(1, n, [*([HEAD] if n < 8 else []), BODY]) for n in range(1, 11)]
    assert sum(h for _, h, _, _ in strip(spark, often).values()) == 7


def test_wandering_headers_and_foreign_numbers_stay(spark):
    wander = [sheet(1, n, [("Repeated lecture header", 40 + 30 * n, 25, 8), BODY, (str(99 + n), 530, 775, 8)]) for n in range(1, 6)]
    assert {(h, f) for _, h, f, _ in strip(spark, wander).values()} == {(0, 0)}


def test_right_aligned_numbers_of_several_widths(spark):
    numbered = [sheet(1, n, [BODY, (f"Page {n}", 570 - 4.0 * len(f"Page {n}"), 775, 8)]) for n in range(1, 13)]
    assert {f for _, _, f, _ in strip(spark, numbered).values()} == {1}


def test_quoting_of_patterns(spark):
    odd = [sheet(1, n, [(r"Notes (a|b) \E .* $x", 40, 25, 8), BODY, (r"Notes (a|b) \E .* $x and more", 40, 400, 14)]) for n in range(1, 6)]
    assert strip(spark, odd)[2] == ("TCP and CRC\n" + r"Notes (a|b) \E .* $x and more", 1, 0, [0])


def test_null_and_empty_pages(spark):
    sheets = spark.createDataFrame([(1, 1, None, 600.0, 800.0), (2, 1, "", None, None)], PAGES)
    none = spark.createDataFrame([], SPANS)
    assert [(r["text"], r["headers_removed"]) for r in layout.strip_margins(none, sheets).collect()] == [("", 0), ("", 0)]
    assert layout.repeated_margins(none, sheets).count() == 0


def test_report(spark):
    """Replacement characters count twice, a private-use operator and a gap between equality signs once."""
    spans = [span("x", 20, 100)]
    sheets = spark.createDataFrame([(1, 1, "a  = ... = b �", 600.0, 800.0), (2, 1, "plain", 600.0, 800.0), (3, 1, " ", 600.0, 800.0)], PAGES)
    df = spark.createDataFrame(spans, SPANS).withColumn("doc_id", F.lit(2).cast("long"))
    stripped, quality = layout.strip_margins(df, sheets), pages.page_quality(sheets, df)
    report = pages.parsing_report(pages.issues(quality, stripped), pages.document_totals(stripped, quality))
    rows = {r["doc_id"]: r for r in report.collect()}
    assert [(i["code"], i["occurrences"], i["severity"]) for i in rows[1]["issues"]] == [("encoding_warning", 1, "warning"), ("suspicious_symbolic_expression", 1, "warning"), ("unreadable_symbol", 2, "warning")]
    assert (rows[1]["status"], rows[1]["encoding_pages"], rows[2]["status"], rows[2]["issues"]) == ("review", 1, "healthy", None)
    assert (rows[3]["status"], rows[3]["possible_scan"], [i["severity"] for i in rows[3]["issues"]]) == ("review", True, ["critical", "critical"])


def test_refresh_counts(spark):
    resources = spark.createDataFrame([(1, "a", True), (2, "a", True), (3, None, True), (4, "a", False), (5, "a", True)], "resource_id long, path string, pdf boolean")
    reports = spark.createDataFrame([(1, "healthy"), (2, "review"), (3, "healthy"), (4, "healthy")], "resource_id long, status string")
    r = pages.refresh_counts(resources, reports, []).first()
    assert (r["reviewed"], r["healthy"], r["needs_review"], r["unable"]) == (5, 1, 1, 3)
