"""Warnings, margins and reports of the corpus's laid-out pages, which several queries rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.operators import layout, pages
from lectern.sources.corpus import Corpus
from lectern.sources.scratch import sent, written


def _once(c: Corpus, name: str, made) -> DataFrame:
    """Written once for a corpus, as reports use it several times and filters on it would work it out anew."""
    if name not in c.memo:
        c.memo[name] = written(made(), name)
    return c.memo[name]


def stripped(c: Corpus) -> DataFrame:
    return _once(c, "stripped", lambda: layout.strip_margins(c.spans, c.sheets))


def quality(c: Corpus) -> DataFrame:
    return _once(c, "quality", lambda: pages.page_quality(c.sheets, c.spans))


def issues(c: Corpus) -> DataFrame:
    return pages.issues(quality(c), stripped(c))


def issues_on(c: Corpus, wanted: DataFrame) -> DataFrame:
    """issues of some pages (doc_id, page_number; written). Margins need all pages of these documents, the other warnings just the
    page, so neither spans nor texts of other documents are written."""
    of = written(wanted.select("doc_id").distinct(), "wanted")
    own = written(c.cleaned(c.pages_of(c.documents.join(sent(of), "doc_id", "left_semi"))), "pages")
    met = sent(wanted)
    there = lambda df: df.join(met, layout.PAGE, "left_semi")
    shown = there(own)
    cut = written(there(layout.strip_margins(c.spans_of(own), c.sheets_of(own))), "stripped")
    return pages.issues(pages.page_quality(c.sheets_of(shown), c.spans_of(shown)), cut)


def totals(c: Corpus) -> DataFrame:
    return pages.document_totals(stripped(c), quality(c))


def report(c: Corpus) -> DataFrame:
    return pages.parsing_report(issues(c), totals(c))
