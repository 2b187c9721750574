"""Page quality: warnings of a page, totals and the health of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text
from lectern.operators import layout

#: Warnings that make a page's formulas unreliable.
FORMULA_RISKS = ["suspicious_formula_layout", "unusual_symbol_position", "encoding_warning", "possible_scanned_page", "empty_text", "layout_review_recommended"]
#: Warnings of the page alone, in the order in which they are found.
PAGE_WARNINGS = ["empty_text", "possible_scanned_page", "encoding_warning", "suspicious_formula_layout", "unusual_symbol_position"]
#: Code, label, explanation and severity of each issue, and those of any other code.
ISSUES = [
    ("suspicious_formula_layout", "Formula layout may be unreliable", "Raised or lowered text may have lost its position. Compare formulas with the original slide.", "warning"),
    ("unusual_symbol_position", "Symbol positioning needs review", "A symbol has unusual positioning that plain text may not preserve.", "warning"),
    ("unreadable_symbol", "Unreadable symbol detected", "A PDF glyph could not be reliably interpreted. Check the original symbol.", "warning"),
    ("encoding_warning", "Text encoding needs review", "Replacement characters indicate that some source characters may be missing.", "warning"),
    ("empty_text", "No extractable text", "This page may be blank or image-only. Its contents were not interpreted as text.", "critical"),
    ("possible_scanned_page", "Little or no extractable text", "This may be a scanned or image-only page. Automatic text recognition is not available.", "critical"),
    ("suspicious_symbolic_expression", "Suspicious mathematical expression", "The extracted expression has an unreliable symbol pattern. No formula repair was attempted.", "warning"),
    ("layout_review_recommended", "Text layout needs review", "Text order or interleaving may not reflect the original slide layout.", "warning"),
    ("repeated_header_footer", "Repeated page furniture cleaned", "Repeated headers or footers were removed conservatively from learning text.", "info"),
]
OTHER_ISSUE = ("Page needs review", "Compare extracted text with the original PDF page.", "warning")


def label_issues(issues: DataFrame) -> DataFrame:
    """Adds label, explanation and severity to rows with a `code`; unknown codes get a default."""
    labels = issues.sparkSession.createDataFrame(ISSUES, "code string, label string, explanation string, severity string")  # nine rows
    joined = issues.join(F.broadcast(labels), "code", "left")
    return joined.fillna(dict(zip(("label", "explanation", "severity"), OTHER_ISSUE, strict=True)))


def _listed(found: list[tuple[str, Column]]) -> Column:
    """Codes with their occurrences, of those that occur."""
    none = F.array().cast("array<int>")
    return F.explode(F.array_compact(F.array(*[F.when(n > 0, F.struct(F.lit(code).alias("code"), n.cast("int").alias("occurrences"), none.alias("span_indices"))) for code, n in found])))


def page_quality(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, page_number, code, occurrences, span_indices of every warning of a page alone: a blank page is empty and
    perhaps scanned, replacement characters are counted, and shifted spans make formulas and symbols unreliable."""
    raw = F.coalesce("raw_text", F.lit(""))
    blank = F.when(raw.rlike(r"[^\s\p{Z}]"), 0).otherwise(1)
    by_text = pages.select("doc_id", "page_number", _listed([("empty_text", blank), ("possible_scanned_page", blank), ("encoding_warning", F.regexp_count(raw, F.lit("\ufffd")))]).alias("w")).select("doc_id", "page_number", "w.*")
    codes = F.explode(F.when(F.col("symbol"), F.array(F.lit(PAGE_WARNINGS[3]), F.lit(PAGE_WARNINGS[4]))).otherwise(F.array(F.lit(PAGE_WARNINGS[3]))))
    moved = layout.shifted(spans).select("doc_id", "page_number", "span", codes.alias("code"))
    by_layout = moved.groupBy("doc_id", "page_number", "code").agg(F.count(F.lit(1)).cast("int").alias("occurrences"), F.array_sort(F.collect_list("span")).alias("span_indices"))
    return by_text.unionByName(by_layout)


def margin_warnings(stripped: DataFrame) -> DataFrame:
    """The warning of each page from which margins were removed, as rows of page_quality."""
    n = F.col("headers_removed") + F.col("footers_removed")
    return stripped.filter(n > 0).select("doc_id", "page_number", F.lit("repeated_header_footer").alias("code"), n.alias("occurrences"), "span_indices")


def issues(quality: DataFrame, stripped: DataFrame) -> DataFrame:
    """doc_id, page_number, code, occurrences, label, explanation, severity: the warnings of pages, and what a report adds, which
    is unreadable symbols of the raw text and malformed mathematics of the cleaned one."""
    symbols = F.when(text.unreadable_count(F.col("raw_text")) > 0, text.unreadable_count(F.col("raw_text"))).when(F.contains("raw_text", F.lit(text.UNREADABLE)), 1).otherwise(0)
    added = stripped.select("doc_id", "page_number", _listed([("unreadable_symbol", symbols), ("suspicious_symbolic_expression", text.malformed_math(F.col("text")).cast("int"))]).alias("w")).select("doc_id", "page_number", "w.*")
    found = quality.unionByName(margin_warnings(stripped)).unionByName(added)
    return label_issues(found.select("doc_id", "page_number", "code", "occurrences"))


def document_totals(stripped: DataFrame, quality: DataFrame) -> DataFrame:
    """Pages, pages with text, empty pages, characters, removed headers and footers, and pages with warnings (in all and
    of each kind) of each document."""
    shown = F.col("text").rlike(r"[^\s\p{Z}]")
    own = stripped.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(shown).alias("pages_with_text"), F.count_if(~shown).alias("empty_pages"), F.sum(F.length("text")).cast("long").alias("characters"),
        F.sum("headers_removed").cast("long").alias("headers_removed"), F.sum("footers_removed").cast("long").alias("footers_removed"),
    )
    codes = quality.select("doc_id", "page_number", "code").unionByName(margin_warnings(stripped).select("doc_id", "page_number", "code"))
    each = codes.groupBy("doc_id", "page_number").agg(F.collect_set("code").alias("codes"))
    counted = each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("warning_pages"), *[F.count_if(F.array_contains("codes", c)).alias(c) for c in PAGE_WARNINGS])
    joined = own.join(counted, "doc_id", "left")
    return joined.fillna(0, ["warning_pages", *PAGE_WARNINGS])


def scanned(totals: DataFrame, share: float = 0.1) -> DataFrame:
    """Adds needs_ocr: hardly any page has text."""
    return totals.withColumn("needs_ocr", F.col("pages_with_text") <= share * F.col("pages"))


def review_pages(issues: DataFrame) -> DataFrame:
    """Pages to review: any issue that is more than information."""
    return issues.filter("severity <> 'info'").groupBy("doc_id").agg(F.countDistinct("page_number").alias("review_pages"))


def parsing_report(issues: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id, status, pages, pages_with_text, review_pages, encoding_pages, possible_scan, issues (by page and code) of
    every document of `totals`."""
    listed = F.array_sort(F.collect_list(F.struct("page_number", "code", "occurrences", "severity")))
    found = issues.groupBy("doc_id").agg(listed.alias("issues"), F.size(F.collect_set(F.when(F.col("severity") != "info", F.col("page_number")))).cast("long").alias("review_pages"))
    joined = scanned(totals).join(found, "doc_id", "left").withColumn("review_pages", F.coalesce("review_pages", F.lit(0).cast("long")))
    status = F.when((F.col("review_pages") > 0) | F.col("needs_ocr"), "review").otherwise("healthy")
    return joined.select("doc_id", status.alias("status"), "pages", "pages_with_text", "review_pages", F.col("encoding_warning").alias("encoding_pages"), F.col("needs_ocr").alias("possible_scan"), "issues")


def refresh_counts(resources: DataFrame, reports: DataFrame, by: list[str]) -> DataFrame:
    """How many resources were looked at, are healthy, need review, or have no report as they are no PDF or have no
    file. resources: resource_id, path, pdf, ...; reports: resource_id, status."""
    own = resources.join(reports.select("resource_id", F.col("status").alias("_state")), "resource_id", "left")
    able = F.col("pdf") & F.col("path").isNotNull() & F.col("_state").isNotNull()
    state = F.when(F.coalesce(able, F.lit(False)), F.col("_state")).otherwise("unable")
    return own.withColumn("_state", state).groupBy(*by).agg(
        F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("_state") == "healthy").alias("healthy"), F.count_if(F.col("_state") == "review").alias("needs_review"), F.count_if(F.col("_state") == "unable").alias("unable"))


def report_freshness(resources: DataFrame, reports: DataFrame) -> DataFrame:
    """Which stored report holds for a resource. resources: resource_id, file_type, fingerprint; reports:
    resource_id, fingerprint, status, issues, pages. Issues beyond the last page are dropped."""
    r, p = resources.alias("r"), reports.alias("p")
    joined = r.join(p, F.col("r.resource_id") == F.col("p.resource_id"), "left")
    status = (
        F.when(F.col("r.file_type") != ".pdf", "unsupported")
        .when(F.col("p.resource_id").isNull(), "unavailable")
        .when(F.col("p.fingerprint").isNull(), "unknown")
        .when(F.col("p.fingerprint") != F.col("r.fingerprint"), "stale")
        .otherwise(F.col("p.status"))
    )
    kept = F.filter(F.col("p.issues"), lambda x: x["page_number"] <= F.col("p.pages"))
    return joined.select("r.resource_id", status.alias("status"), F.coalesce(F.size(kept), F.lit(0)).alias("n_issues"))


def issues_by_page(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("n_issues"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def latest(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter("_rank = 1").drop("_rank")
