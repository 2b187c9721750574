"""Queries of chunking, page quality, roles, kinds and knowledge items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import classify, evaluate, knowledge, layout, links, pages, retrieval
from lectern.plans import health, oracle
from lectern.plans.registry import query
from lectern.sources.corpus import Corpus

_C = F.col


@query("chunk_pages", "SELECT doc_id, page_number, chunk_index, content FROM chunk", "chunk")
def chunk_pages(c: Corpus) -> DataFrame:
    return c.chunk.select("doc_id", "page_number", "chunk_index", "content")


@query("chunk_numbering", "SELECT doc_id, count(*) AS n, CAST(min(chunk_index) AS INTEGER) AS low, CAST(max(chunk_index) AS INTEGER) AS high FROM chunk GROUP BY 1", "chunk")
def chunk_numbering(c: Corpus) -> DataFrame:
    return c.chunk.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"))


_OPENING = "SELECT doc_id, substr(string_agg(substr(content, 1, 1000), chr(10) ORDER BY chunk_index), 1, 1000) AS opening FROM chunk WHERE chunk_index < 3 GROUP BY 1"


def openings(c: Corpus) -> DataFrame:
    """doc_id, opening: the first three chunks, each and together 1,000 characters at most."""
    own = F.array_sort(F.collect_list(F.struct("chunk_index", F.substring("content", 1, 1000).alias("t"))))
    made = c.chunk.filter("chunk_index < 3").groupBy("doc_id").agg(own.alias("own"))
    return made.select("doc_id", F.substring(F.array_join(F.transform("own", lambda x: x["t"]), "\n"), 1, 1000).alias("opening"))


@query("opening_text", _OPENING, "chunk")
def opening_text(c: Corpus) -> DataFrame:
    return openings(c)


# Pages whose links lead to files of the course (words from a to f) and to documents elsewhere (g to m), below a part
# with a list, a paragraph and an anchor that leads nowhere; every fiftieth page has too many links.
_PART = """concat('<h2>Part <b>', page_id, '</b></h2><p>Read &amp; see</p><ul><li>See <a href="/files/77" title="T">this</a> now</li></ul><p>Then <a href="https://public.test/x.pdf?a=1#p">that</a></p><a name="z">no</a><h3>Sub</h3>', CASE WHEN page_id % 50 = 0 THEN repeat('<a href="/files/1">x</a>', 2000) ELSE '' END)"""
_TURNED = "regexp_replace(regexp_replace(html, 'href=\"/[a-f][^\"]*\"', concat('href=\"/files/', page_id + 1, '/download\"'){g}), 'href=\"/([g-m][^\"]*)\"', 'href=\"https://public.test/{one}.pdf\"'{g})"
_LINKED = f"""linked AS ({oracle.VIEWS['link'].replace('FROM pages', 'FROM (SELECT page_id, url, ' + _TURNED.format(g=", 'g'", one=chr(92) + '1') + ' AS html FROM pages)')}),
    described AS (SELECT page_id, pos + 3 AS pos, href, link_text, concat('Part ', page_id, ' Sub') AS heading, '' AS before, trim(link_text) AS around, CASE WHEN starts_with(href, '/files/') AND url LIKE 'https://%' THEN 'file' WHEN ends_with(href, '.pdf') THEN 'document' ELSE 'unsupported' END AS kind, CASE WHEN starts_with(href, '/files/') AND url LIKE 'https://%' THEN page_id + 1 END AS file_id FROM linked
        UNION ALL SELECT page_id, pos, href, link_text, concat('Part ', page_id), before, around, CASE WHEN kind = 'file' AND url NOT LIKE 'https://%' THEN 'unsupported' ELSE kind END, CASE WHEN url LIKE 'https://%' THEN file_id END FROM pages, (VALUES (0, '/files/77', 'this', 'Read & see', 'See this now', 'file', 77), (1, 'https://public.test/x.pdf?a=1#p', 'that', '', 'Then that', 'document', NULL), (2, NULL, 'no', '', '', 'unsupported', NULL)) AS v(pos, href, link_text, before, around, kind, file_id))"""


def material_links(c: Corpus) -> DataFrame:
    turned = F.concat(F.expr(_PART), F.expr(_TURNED.format(g="", one="$1")))
    return links.page_links(c.table("pages").select("page_id", "url", turned.alias("html")))


@query("page_links", f"WITH {_LINKED} SELECT * FROM described WHERE page_id % 50 <> 0")
def page_links(c: Corpus) -> DataFrame:
    return material_links(c).filter("problem IS NULL").select("page_id", "pos", "href", "link_text", "heading", "before", "around", "kind", "file_id")


@query("inactive_links", f"WITH {_LINKED} SELECT page_id, CASE WHEN page_id % 50 = 0 THEN 0 ELSE count(*) FILTER (WHERE kind <> 'unsupported') END AS links, CASE WHEN page_id % 50 = 0 THEN 0 ELSE count(*) FILTER (WHERE kind = 'unsupported') END AS unsupported, page_id % 50 = 0 AS too_many FROM described GROUP BY 1")
def inactive_links(c: Corpus) -> DataFrame:
    followed = _C("kind") != "unsupported"
    return material_links(c).groupBy("page_id").agg(F.count_if(followed).alias("links"), F.count_if(~followed).alias("unsupported"), F.bool_or(_C("problem").isNotNull()).alias("too_many"))


@query("page_quality", "SELECT * FROM warning", "warning")
def page_quality(c: Corpus) -> DataFrame:
    return health.quality(c).select("doc_id", "page_number", "code", "occurrences", F.array_join(F.transform("span_indices", lambda x: x.cast("string")), ",").alias("spans"))


@query("review_pages", "SELECT doc_id, count(DISTINCT page_number) AS review_pages FROM issue WHERE severity <> 'info' GROUP BY 1", "issue")
def review_pages(c: Corpus) -> DataFrame:
    return pages.review_pages(health.issues(c))


@query("parsing_report", "SELECT r.*, issues FROM report r LEFT JOIN (SELECT doc_id, string_agg(concat_ws(':', page_number, code, occurrences, severity), ',' ORDER BY page_number, code) AS issues FROM issue GROUP BY 1) i ON i.doc_id = r.doc_id", "report")
def parsing_report(c: Corpus) -> DataFrame:
    listed = F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i["page_number"].cast("string"), i["code"], i["occurrences"].cast("string"), i["severity"])), ",")
    return health.report(c).withColumn("issues", listed)


@query("issues_by_page", "SELECT doc_id, page_number, count(*) AS n_issues, string_agg(code, ',' ORDER BY code) AS codes FROM issue GROUP BY ALL", "issue")
def issues_by_page(c: Corpus) -> DataFrame:
    return pages.issues_by_page(health.issues(c))


@query("repeated_margins", "SELECT * FROM margin_often", "margin_often")
def repeated_margins(c: Corpus) -> DataFrame:
    return layout.repeated_margins(c.spans, c.sheets)


@query("strip_margins", "SELECT doc_id, page_number, text, headers_removed, footers_removed FROM stripped", "stripped")
def strip_margins(c: Corpus) -> DataFrame:
    return health.stripped(c).select("doc_id", "page_number", "text", "headers_removed", "footers_removed")


_TOTALS = f"""
    SELECT p.*, {', '.join(f"coalesce({k}, 0) AS {k}" for k in ('warning_pages', *pages.PAGE_WARNINGS))} FROM (
        SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE regexp_matches(text, '[^\\s\\p{{Z}}]')) AS pages_with_text, count(*) FILTER (WHERE NOT regexp_matches(text, '[^\\s\\p{{Z}}]')) AS empty_pages, CAST(sum(length(text)) AS BIGINT) AS characters,
               CAST(sum(headers_removed) AS BIGINT) AS headers_removed, CAST(sum(footers_removed) AS BIGINT) AS footers_removed FROM stripped GROUP BY 1) p
    LEFT JOIN (SELECT doc_id, count(DISTINCT page_number) AS warning_pages, {', '.join(f"count(DISTINCT page_number) FILTER (WHERE code = '{k}') AS {k}" for k in pages.PAGE_WARNINGS)} FROM issue WHERE code NOT IN ('unreadable_symbol', 'suspicious_symbolic_expression') GROUP BY 1) w ON w.doc_id = p.doc_id"""


@query("document_totals", _TOTALS, "issue")
def document_totals(c: Corpus) -> DataFrame:
    return health.totals(c)


@query("scanned_flag", "SELECT doc_id, count(*) FILTER (WHERE regexp_matches(text, '[^\\s\\p{Z}]')) <= 0.1 * count(*) AS needs_ocr FROM stripped GROUP BY 1", "stripped")
def scanned_flag(c: Corpus) -> DataFrame:
    return pages.scanned(health.totals(c)).select("doc_id", "needs_ocr")


@query("span_neighbours", "SELECT * FROM span_pair", "span_pair")
def span_neighbours(c: Corpus) -> DataFrame:
    return layout.neighbours(c.spans)


@query("margin_medians", "SELECT * FROM body_font", "body_font")
def margin_medians(c: Corpus) -> DataFrame:
    return layout.body_fonts(c.spans, c.sheets)


# Materials of roles: each document with a file name and titles that name a role in some of them.
_FILE = "concat(CASE doc_id % 6 WHEN 0 THEN 'Lecture ' WHEN 1 THEN 'tutorial-' WHEN 2 THEN 'reading ' WHEN 3 THEN 'slides ' ELSE '' END, source)"
_MODULE = "concat(CASE doc_id % 5 WHEN 0 THEN 'Tutorial exercises ' WHEN 1 THEN 'Lecture notes ' WHEN 2 THEN 'assignment2 ' ELSE 'Week ' END, doc_id % 9)"


def materials(c: Corpus) -> DataFrame:
    fields = F.array(F.struct(F.lit("filename").alias("field"), F.expr(_FILE).alias("value")), F.struct(F.lit("module_title").alias("field"), F.expr(_MODULE).alias("value")))
    return c.documents.select(_C("doc_id").alias("material_id"), F.map_from_entries(fields).alias("metadata"), fields.alias("fields"))


def _signals_sql() -> str:
    out = []
    for field, expr in (("filename", _FILE), ("module_title", _MODULE)):
        p = classify.PRIORITIES[field]
        t = f"(SELECT doc_id, {oracle.normalized(expr)} AS t FROM documents)"
        rules = [(classify.PURPOSE, max(5, p - 1), "other"), *((r, p, role) for role, r in classify.STRONG.items()), *((r, 3 if p >= 8 else 1, role) for role, r in classify.WEAK.items())]
        out += [f"SELECT doc_id AS material_id, CAST({w} AS INTEGER) AS weight, '{role}' AS role FROM {t} WHERE regexp_matches(t, '{r}')" for r, w, role in rules]
    return " UNION ".join(out)


_SIGNALS = _signals_sql()
_SCORES = f"""SELECT material_id, lecture, tutorial, CASE WHEN direct THEN least(other, 6) ELSE other END AS other, twos FROM (SELECT material_id, {', '.join(f"CAST(coalesce(max(weight) FILTER (WHERE role = '{r}') + CASE WHEN count(DISTINCT weight) FILTER (WHERE role = '{r}') > 1 THEN 1 ELSE 0 END, 0) AS INTEGER) AS {r}" for r in classify.ROLES)},
    bool_or(weight >= 8 AND role IN ('lecture', 'tutorial')) AS direct, coalesce(list(role) FILTER (WHERE weight = 2), []) AS twos FROM ({_SIGNALS}) GROUP BY 1)"""
_DECISION = f"""SELECT doc_id AS material_id, coalesce(CASE WHEN ok THEN winner ELSE 'other' END, 'other') AS role, coalesce(CASE WHEN ok THEN CASE WHEN strength >= 7 AND margin >= 3 THEN 0.9 ELSE 0.65 END WHEN strength > 0 THEN 0.2 ELSE 0.0 END, 0.0) AS confidence,
    coalesce(CASE WHEN ok THEN CASE WHEN strength >= 7 AND margin >= 3 THEN 'Direct role evidence.' ELSE 'Low-strength or competing role evidence; review or fallback needed.' END END, 'Weak or conflicting role evidence.') AS reason
    FROM documents LEFT JOIN (SELECT *, (strength >= 4 OR list_contains(twos, winner)) AND margin >= 2 AS ok FROM (SELECT material_id, twos, greatest(lecture, tutorial, other) AS strength, CASE WHEN lecture >= tutorial AND lecture >= other THEN 'lecture' WHEN tutorial >= other THEN 'tutorial' ELSE 'other' END AS winner,
        greatest(lecture, tutorial, other) - list_sort([lecture, tutorial, other])[2] AS margin FROM ({_SCORES}))) ON material_id = doc_id"""


@query("role_signals", _SIGNALS)
def role_signals(c: Corpus) -> DataFrame:
    return classify.role_signals(materials(c))


@query("merge_evidence", f"SELECT material_id, string_agg(weight || ':' || role, ',' ORDER BY weight, role) AS evidence FROM ({_SIGNALS}) GROUP BY 1")
def merge_evidence(c: Corpus) -> DataFrame:
    made = classify.merge_evidence(classify.role_signals(materials(c)))
    return made.select("material_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["weight"].cast("string"), e["role"])), ",").alias("evidence"))


@query("role_scores", f"SELECT material_id, lecture, tutorial, other FROM ({_SCORES})")
def role_scores(c: Corpus) -> DataFrame:
    return classify.role_scores(classify.role_signals(materials(c))).select("material_id", "lecture", "tutorial", "other")


@query("role_decision", _DECISION)
def role_decision(c: Corpus) -> DataFrame:
    return classify.role_decision(materials(c))


_LEADS = "concat(CASE doc_id % 4 WHEN 0 THEN 'Lecture slides' WHEN 1 THEN 'Week 3 Tutorial' WHEN 2 THEN concat('Overview', chr(10), 'Learning objectives') ELSE '' END, chr(10), opening)"
_NORM_LINES = f"list_transform(list_filter(string_split({_LEADS}, chr(10)), lambda w: length(trim(w)) <= 120), lambda w: {oracle.normalized('w')})"
_CONTENT = f"""SELECT doc_id, CASE WHEN len(roles) = 1 THEN roles[1] END AS role FROM (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN len(list_filter(ls, lambda w: regexp_matches(w, '{r}'))) > 0" + (" OR (len(list_filter(ls, lambda w: starts_with(w, 'learning objectives'))) > 0 AND len(list_filter(ls, lambda w: starts_with(w, 'overview'))) > 0)" if role == 'lecture' else "") + f" THEN '{role}' END" for role, r in classify.HEADINGS.items())}], lambda w: w IS NOT NULL) AS roles
    FROM (SELECT doc_id, {_NORM_LINES} AS ls FROM ({_OPENING})))"""


def content_roles(c: Corpus) -> DataFrame:
    return openings(c).select("doc_id", classify.content_role(F.expr(_LEADS.replace("chr(10)", "char(10)"))).alias("role"))


@query("content_role", _CONTENT, "chunk")
def content_role(c: Corpus) -> DataFrame:
    return content_roles(c)


def cascaded(c: Corpus) -> DataFrame:
    """Every tenth document was set by hand, and some have an external decision."""
    d = classify.role_decision(materials(c)).join(content_roles(c).select(_C("doc_id").alias("material_id"), _C("role").alias("content")), "material_id", "left")
    m = _C("material_id")
    return classify.cascade(d.select("material_id", "role", "confidence", "content", F.when(m % 10 == 0, "tutorial").alias("manual"), F.when(m % 7 == 0, "lecture").alias("external"), F.when(m % 14 == 0, 0.9).otherwise(0.5).alias("external_confidence")))


_CASCADE = f"""SELECT d.material_id, coalesce(manual, CASE WHEN confidence >= 0.8 THEN d.role END, k.role, CASE WHEN external_confidence >= 0.8 THEN external END, d.role) AS role,
    CASE WHEN manual IS NOT NULL THEN 'manual' WHEN confidence >= 0.8 THEN 'metadata' WHEN k.role IS NOT NULL THEN 'document_content' WHEN external IS NOT NULL AND external_confidence >= 0.8 THEN 'external' ELSE 'metadata' END AS method
    FROM (SELECT *, CASE WHEN material_id % 10 = 0 THEN 'tutorial' END AS manual, CASE WHEN material_id % 7 = 0 THEN 'lecture' END AS external, CASE WHEN material_id % 14 = 0 THEN 0.9 ELSE 0.5 END AS external_confidence FROM ({_DECISION})) d LEFT JOIN ({_CONTENT}) k ON k.doc_id = d.material_id"""


@query("role_cascade", _CASCADE, "chunk")
def role_cascade(c: Corpus) -> DataFrame:
    return cascaded(c)


@query("external_decisions", f"SELECT method, count(*) AS n FROM ({_CASCADE}) GROUP BY 1", "chunk")
def external_decisions(c: Corpus) -> DataFrame:
    return cascaded(c).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("manual_override", f"SELECT material_id, CASE WHEN material_id % 6 = 0 THEN 'tutorial' ELSE role END AS role FROM ({_DECISION})")
def manual_override(c: Corpus) -> DataFrame:
    manual = c.documents.filter("doc_id % 6 = 0").select(_C("doc_id").alias("material_id"), F.lit("tutorial").alias("manual"))
    return classify.role_decision(materials(c)).join(manual, "material_id", "left").select("material_id", F.coalesce("manual", "role").alias("role"))


@query("reclassify_preview", f"""
    SELECT material_id, r.role AS before, CASE WHEN material_id % 6 = 0 THEN r.role ELSE d.role END AS after, CASE WHEN material_id % 6 = 0 THEN 'manual' ELSE method END AS method, CAST(CASE WHEN material_id % 6 = 0 THEN 1.0 ELSE confidence END AS DOUBLE) AS confidence
    FROM (SELECT * FROM resource WHERE course_id = 'en' ORDER BY resource_id LIMIT 100) r JOIN (SELECT k.material_id, k.role, k.method, c.confidence FROM ({_CASCADE}) k JOIN ({_DECISION}) c ON c.material_id = k.material_id) d ON material_id = resource_id""", "resource", "chunk")
def reclassify_preview(c: Corpus) -> DataFrame:
    """The first hundred resources of a course, as they are and as they would be; every sixth was set by hand."""
    decided = cascaded(c).join(classify.role_decision(materials(c)).select("material_id", "confidence"), "material_id")
    known = c.resource.filter("course_id = 'en'").select(_C("resource_id").alias("material_id"), "role", (_C("resource_id") % 6 == 0).alias("manual"))
    return classify.preview(decided, known, 100)


_PHRASES = {"READING": ["reading", "chapter notes"], "CORE": ["lecture", "tutorial exercises", "slides"]}


def _kinds_sql() -> str:
    fields = [("filename", _FILE), ("module_title", _MODULE)]
    rules = [(k, p) for k, ps in _PHRASES.items() for p in ps]
    hits = []
    for f, expr in fields:
        for kind, p in rules:
            plural = "" if p.endswith("s") else "s?"
            hits.append(f"CASE WHEN regexp_matches({oracle.normalized(expr)}, '\\b{p}{plural}\\b') THEN '{kind}/{f}:{p}' END")
    found = f"list_filter([{', '.join(hits)}], lambda w: w IS NOT NULL)"
    kind = "CASE WHEN len(list_filter(hs, lambda w: starts_with(w, 'READING'))) > 0 THEN 'READING' WHEN len(hs) > 0 THEN 'CORE' ELSE 'UNKNOWN' END"
    return f"SELECT doc_id AS material_id, kind, array_to_string(list_transform(list_filter(hs, lambda w: starts_with(w, kind)), lambda w: split_part(w, '/', 2)), ',') AS reasons FROM (SELECT *, {kind} AS kind FROM (SELECT doc_id, {found} AS hs FROM documents))"


_KINDS = _kinds_sql()


@query("material_kind", _KINDS)
def material_kind(c: Corpus) -> DataFrame:
    return classify.material_kind(materials(c), _PHRASES)


@query("combine_kind", f"SELECT kind, count(*) AS n FROM ({_KINDS}) GROUP BY 1")
def combine_kind(c: Corpus) -> DataFrame:
    return classify.material_kind(materials(c), _PHRASES).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Knowledge items: the chunks of all documents, one category each, some with bad citations.
_CATEGORY = "CASE chunk_index % 5 WHEN 0 THEN 'concepts' WHEN 1 THEN 'key_points' WHEN 2 THEN 'formulas' WHEN 3 THEN 'examples' ELSE 'exam_focus' END"
#: Every ninth document states what its source does not have.
_BODY = "CASE WHEN doc_id % 9 = 4 THEN 'x ∯ y' ELSE 'Some words' END"
_ITEMS = f"items AS (SELECT chunk_id AS item_id, doc_id, {_CATEGORY} AS category, chunk_index AS idx, page_number, content FROM chunk)"


#: An item's name: the first line of its chunk.
_NAME = "string_split(content, chr(10))[1]"


def items(c: Corpus) -> DataFrame:
    own = c.chunk
    ids = F.when(_C("doc_id") % 11 == 0, F.array("chunk_id", "chunk_id")).when(_C("doc_id") % 13 == 0, F.array(F.lit(-1).cast("long"))).otherwise(F.array("chunk_id"))
    page = F.when(_C("doc_id") % 17 == 0, _C("page_number") + 1).otherwise(_C("page_number"))
    return own.select(_C("chunk_id").alias("item_id"), "doc_id", F.expr(_CATEGORY).alias("category"), _C("chunk_index").alias("idx"), ids.alias("ids"), F.array(page).alias("source_pages"), F.element_at(F.split("content", "\n", -1), 1).alias("formula"), F.element_at(F.split("content", "\n", -1), 1).alias("name"), _C("content").alias("point"), F.expr(_BODY).alias("body"), F.when(_C("doc_id") % 2 == 0, "A plain text").alias("also"), "page_number")


def _warned_chunks(c: Corpus) -> DataFrame:
    return c.chunk.withColumn("warnings", F.array().cast("array<string>"))


_RELIABLE = "NOT regexp_matches(content, '[\\x{FFFD}\\x{FFFC}\\p{Co}]') AND NOT contains(content, '[UNREADABLE_SYMBOL]') AND NOT regexp_matches(content, '[=＝]\\s*(?:\\.{2,}|…+|⋯+|\\[MATHEMATICAL EXPRESSION OMITTED[^\\]\\n]*\\])\\s*[=＝]')"
_CUE = f"len(list_filter(string_split(content, chr(10)), lambda w: regexp_matches(w, '{text.EXAM_CUES}') AND NOT regexp_matches(w, '{text.NEGATED_CUES}'))) > 0"
_GROUND = f"""{_ITEMS}, grounded AS (SELECT item_id, doc_id, category, idx, reason, CASE WHEN reason IS NULL THEN 'keep' WHEN reason IN ('ids', 'pages') AND category NOT IN ('examples', 'exam_focus') THEN 'fail' WHEN reason = 'symbols' AND category = 'concepts' AND doc_id % 2 = 0 THEN 'reduce' ELSE 'drop' END AS outcome FROM (
    SELECT *, CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'ids' WHEN doc_id % 17 = 0 THEN 'pages' WHEN category = 'formulas' AND NOT ({_RELIABLE} AND trim(string_split(content, chr(10))[1]) <> '') THEN 'formula' WHEN doc_id % 9 = 4 THEN 'symbols' WHEN category = 'exam_focus' AND NOT ({_CUE}) THEN 'cue' END AS reason FROM items))"""


@query("grounding", f"WITH {_GROUND} SELECT item_id, doc_id, category, outcome, reason FROM grounded", "chunk")
def grounding(c: Corpus) -> DataFrame:
    return knowledge.ground(items(c), _warned_chunks(c))


@query("filter_counters", f"WITH {_GROUND} SELECT category, count(*) FILTER (WHERE outcome = 'keep') AS keep, count(*) FILTER (WHERE outcome = 'reduce') AS reduce, count(*) FILTER (WHERE outcome = 'drop') AS \"drop\", count(*) FILTER (WHERE outcome = 'fail') AS fail FROM grounded GROUP BY 1", "chunk")
def filter_counters(c: Corpus) -> DataFrame:
    return knowledge.counters(knowledge.ground(items(c), _warned_chunks(c)), ["keep", "reduce", "drop", "fail"])


@query("evidence_attach", f"WITH {_ITEMS} SELECT item_id, content || CASE WHEN doc_id % 11 = 0 THEN '|' || content ELSE '' END AS quotes FROM items WHERE doc_id % 11 = 0 OR doc_id % 13 <> 0", "chunk")
def evidence_attach(c: Corpus) -> DataFrame:
    made = knowledge.attach_evidence(items(c), c.chunk)
    return made.select("item_id", F.array_join(F.transform("evidence", lambda e: e["quote"]), "|").alias("quotes"))


_JSON = "'{\"source_chunk_id\":' || chunk_id || ',\"resource_id\":' || doc_id || ',\"page_number\":' || page_number || ',\"chunk_index\":' || chunk_index || ',\"content\":' || to_json(content)::VARCHAR || ',\"warnings\":[],\"label\":\"[CHUNK_ID=' || chunk_id || ' | PAGE=' || page_number || ']\"}'"


_LONG = "SELECT doc_id AS chunk_id, doc_id // 5 AS doc_id, 1 AS page_number, CAST(doc_id % 5 AS INTEGER) AS chunk_index, coalesce(text, '') AS content, [CASE WHEN doc_id % 2 = 0 THEN 'empty_text' ELSE 'a \"b\"' END] AS warnings FROM documents"
_OWN_JSON = "length(CAST(json_object('source_chunk_id', chunk_id, 'resource_id', doc_id, 'page_number', page_number, 'chunk_index', chunk_index, 'content', piece, 'warnings', warnings, 'label', '[CHUNK_ID=' || chunk_id || ' | PAGE=' || page_number || ']') AS VARCHAR))"


@query("prompt_batches", f"""
    WITH halved AS (
        SELECT *, content AS piece, '' AS path FROM ({_LONG})
        UNION ALL SELECT chunk_id, doc_id, page_number, chunk_index, content, warnings, CASE WHEN h = 0 THEN substr(piece, 1, length(piece) // 2) ELSE substr(piece, length(piece) // 2 + 1) END, path || h FROM halved, (VALUES (0), (1)) AS v(h) WHERE 13 + {_OWN_JSON} > 12000 AND length(piece) >= 2
    ), sized AS (
        SELECT doc_id, chunk_index, CAST(row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY path) - 1 AS INTEGER) AS part, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, path) AS i, length(piece) AS n_chars, {_OWN_JSON} AS n_json FROM halved WHERE NOT (13 + {_OWN_JSON} > 12000 AND length(piece) >= 2)
    ), packed AS (
        SELECT *, 0 AS batch, 13 + n_json AS used FROM sized WHERE i = 1
        UNION ALL SELECT s.*, CASE WHEN used + 1 + s.n_json > 12000 THEN batch + 1 ELSE batch END, CASE WHEN used + 1 + s.n_json > 12000 THEN 13 + s.n_json ELSE used + 1 + s.n_json END FROM packed p JOIN sized s ON s.doc_id = p.doc_id AND s.i = p.i + 1)
    SELECT doc_id, batch, chunk_index, part, n_chars, n_json, max(batch) OVER (PARTITION BY doc_id) + 1 > 20 AS too_many FROM packed""")
def prompt_batches(c: Corpus) -> DataFrame:
    """Every five documents as the chunks of one, so that long ones are halved, some more than once."""
    warning = F.when(_C("doc_id") % 2 == 0, "empty_text").otherwise('a "b"')
    own = c.documents.select(_C("doc_id").alias("chunk_id"), F.floor(_C("doc_id") / 5).alias("doc_id"), F.lit(1).alias("page_number"), (_C("doc_id") % 5).cast("int").alias("chunk_index"), _C("text").alias("content"), F.array(warning).alias("warnings"))
    return knowledge.prompt_batches(own, 12_000, 20)


_CLAIMS = f"{_ITEMS}, claims AS (SELECT doc_id, category, idx, field, CASE field WHEN 'name' THEN string_split(content, chr(10))[1] ELSE content END AS claim, CASE WHEN doc_id % 11 = 0 THEN item_id || ',' || item_id WHEN doc_id % 13 = 0 THEN '-1' ELSE CAST(item_id AS VARCHAR) END AS ids FROM items, (VALUES ('name'), ('point')) AS f(field))"


@query("review_jobs", f"WITH {_CLAIMS} SELECT doc_id, concat_ws('.', category, idx, field) AS claim_id, claim, md5(ids) AS job FROM claims WHERE trim(claim) <> ''", "chunk")
def review_jobs(c: Corpus) -> DataFrame:
    return knowledge.review_jobs(items(c), ["name", "point"])


def decisions(c: Corpus) -> DataFrame:
    """Every claim has a decision; those of some documents and fields are not supported."""
    claims = knowledge.review_jobs(items(c), ["name", "point"])
    bad = ((_C("doc_id") % 3 == 0) & _C("claim_id").endswith(".name")) | ((_C("doc_id") % 6 == 0) & _C("claim_id").endswith(".point"))
    return claims.select("doc_id", "claim_id", (~bad).alias("supported"))


def reviewed(c: Corpus) -> DataFrame:
    return knowledge.apply_review(items(c), decisions(c), ["name", "point"], ["name", "point"])


_REVIEW = f"{_ITEMS}, reviewed AS (SELECT doc_id, category, idx, n AS name, p AS point, CASE WHEN trim(n) = '' AND trim(p) = '' THEN 'rejected' WHEN n <> on1 OR p <> op1 THEN 'reduced' ELSE 'accepted' END AS outcome FROM (SELECT *, string_split(content, chr(10))[1] AS on1, content AS op1, CASE WHEN doc_id % 3 = 0 AND trim(string_split(content, chr(10))[1]) <> '' THEN '' ELSE string_split(content, chr(10))[1] END AS n, CASE WHEN doc_id % 6 = 0 AND trim(content) <> '' THEN '' ELSE content END AS p FROM items))"


@query("apply_review", f"WITH {_REVIEW} SELECT * FROM reviewed", "chunk")
def apply_review(c: Corpus) -> DataFrame:
    return reviewed(c)


@query("review_counters", f"WITH {_REVIEW} SELECT category, count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'rejected') AS rejected, count(*) FILTER (WHERE outcome = 'reduced') AS reduced FROM reviewed GROUP BY 1", "chunk")
def review_counters(c: Corpus) -> DataFrame:
    return knowledge.counters(reviewed(c), ["accepted", "rejected", "reduced"])


@query("claim_id_sets", f"WITH {_CLAIMS}, e AS (SELECT doc_id || '/' || concat_ws('.', category, idx, field) AS claim FROM claims WHERE trim(claim) <> '') SELECT claim, 'missing' AS problem FROM e WHERE hash_mod(claim) UNION ALL SELECT 'x', 'unknown'".replace("hash_mod(claim)", "length(claim) % 5 = 0"), "chunk")
def claim_id_sets(c: Corpus) -> DataFrame:
    expected = knowledge.review_jobs(items(c), ["name", "point"]).select(F.concat_ws("/", _C("doc_id").cast("string"), "claim_id").alias("claim"))
    decided = expected.filter(F.length("claim") % 5 != 0).unionByName(c.spark.createDataFrame([("x",)], "claim string"))
    return evaluate.id_coverage(expected, decided, "claim")


@query("knowledge_projection", f"WITH {_ITEMS} SELECT CASE category WHEN 'concepts' THEN 'concept' ELSE 'question' END AS kind, doc_id, idx, {_NAME} AS name, content AS text, CAST(page_number + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS INTEGER) AS source_page FROM items WHERE category IN ('concepts', 'exam_focus')", "chunk")
def knowledge_projection(c: Corpus) -> DataFrame:
    """Concepts and, here those that speak of exams, questions."""
    own = items(c).withColumn("category", F.when(_C("category") == "exam_focus", "questions").otherwise(_C("category"))).withColumn("body", _C("point"))
    return knowledge.projection(own)


@query("first_source_page", f"WITH {_ITEMS} SELECT item_id, CAST(page_number + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS INTEGER) AS first_page FROM items", "chunk")
def first_source_page(c: Corpus) -> DataFrame:
    return items(c).select("item_id", F.try_element_at("source_pages", F.lit(1)).alias("first_page"))


@query("topic_overview", f"WITH {_ITEMS}, o AS (SELECT doc_id, list(string_split(content, chr(10))[1] ORDER BY idx) AS names, list(content ORDER BY idx) AS points FROM items GROUP BY 1) SELECT doc_id, array_to_string((list_filter(names, lambda w, i: list_position(names, w) = i))[1:6], '; ') AS topic, array_to_string(points[1:6], ' ') AS overview FROM o", "chunk")
def topic_overview(c: Corpus) -> DataFrame:
    return knowledge.topic_overview(items(c).select("doc_id", "idx", "name", "point"))


# Outputs of batches of eight chunks: an item for each line of a chunk, a topic and an overview for each batch.
_MERGED = "CASE chunk_index % 3 WHEN 0 THEN 'concepts' WHEN 1 THEN 'key_points' ELSE 'questions' END"
_PIECES = f"SELECT doc_id, chunk_index // 8 AS batch, {_MERGED} AS category, chunk_index, i, CAST(json_object('name', ls[i], 'source_pages', [page_number // 4]) AS VARCHAR) AS item FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(content, chr(10)) AS ls FROM chunk))"


@query("merge_outputs", f"""
    WITH pieces AS ({_PIECES}), first1 AS (SELECT doc_id, category, item, min(chunk_index * 1000000 + i) AS spot FROM pieces GROUP BY ALL),
    batches AS (SELECT doc_id, chunk_index // 8 AS batch, concat('Topic ', (chunk_index // 16) % 2) AS topic, CASE WHEN (chunk_index // 8) % 3 = 2 THEN '' ELSE concat('Overview ', chunk_index // 8) END AS overview FROM chunk GROUP BY ALL)
    SELECT * FROM (SELECT doc_id, category, CAST(row_number() OVER (PARTITION BY doc_id, category ORDER BY spot) AS INTEGER) AS place, item FROM first1) WHERE category <> 'questions' OR place <= 5
    UNION ALL SELECT doc_id, 'topic', 0, string_agg(topic, chr(10) || chr(10) ORDER BY batch) FROM (SELECT doc_id, topic, min(batch) AS batch FROM batches GROUP BY ALL) GROUP BY 1
    UNION ALL SELECT doc_id, 'overview', 0, coalesce(string_agg(overview, chr(10) || chr(10) ORDER BY batch) FILTER (WHERE overview <> ''), '') FROM batches GROUP BY 1""", "chunk")
def merge_outputs(c: Corpus) -> DataFrame:
    named = c.chunk.select("doc_id", "chunk_index", "page_number", F.expr(_MERGED).alias("category"), F.floor(_C("chunk_index") / 8).cast("int").alias("batch"), F.posexplode(F.split("content", "\n", -1)).alias("pos", "name"))
    item = text.canonical_json(name=_C("name"), source_pages=F.array(F.floor(_C("page_number") / 4)))
    merged = knowledge.merge_items(named.select("doc_id", "batch", F.struct("chunk_index", "pos").alias("pos"), "category", item.alias("item")))
    n = _C("batch")
    outputs = named.select("doc_id", "batch").distinct().select("doc_id", "batch", F.concat(F.lit("Topic "), F.floor(n / 2) % 2).alias("topic"), F.when(n % 3 == 2, "").otherwise(F.concat(F.lit("Overview "), n)).alias("overview"))
    joined = knowledge.merge_texts(outputs).unpivot(["doc_id"], ["topic", "overview"], "category", "item")
    return merged.unionByName(joined.withColumn("place", F.lit(0)))


@query("week_summary", "SELECT r.course_id, r.week_id, r.resource_id, k.chunk_index AS idx, string_split(k.content, chr(10))[1] AS overview, concat(k.content, ' [Resource ', r.resource_id, ', pages ', k.page_number, ']') AS point FROM resource r JOIN chunk k ON k.doc_id = r.resource_id", "resource", "chunk")
def week_summary(c: Corpus) -> DataFrame:
    named = items(c).select(_C("doc_id").alias("resource_id"), "idx", _C("name").alias("overview"), "point", F.array("page_number").alias("pages"))
    return knowledge.week_summary(named.join(c.resource.select("resource_id", "course_id", "week_id"), "resource_id"))


@query("week_learning_view", f"""
    WITH {_ITEMS} SELECT course_id, week_id, category, doc_id, idx, content AS text, CAST(page_number + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS pages, CASE WHEN path IS NOT NULL THEN concat('/api/resources/', doc_id, '/file#page=', page_number + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END) ELSE '' END AS links
    FROM items JOIN resource ON resource_id = doc_id WHERE category <> 'formulas' OR {_RELIABLE}""", "chunk", "resource")
def week_learning_view(c: Corpus) -> DataFrame:
    reliable = text.symbol_source_ok(_C("point"), F.array().cast("array<string>"), pages.FORMULA_RISKS)
    twice = F.concat("source_pages", "source_pages", F.array(F.lit(0)))  # pages count once, and only those above zero
    own = items(c).select("doc_id", "category", "idx", _C("point").alias("text"), twice.alias("source_pages"), reliable.alias("reliable"))
    made = knowledge.week_view(own, c.resource.select(_C("resource_id").alias("doc_id"), "course_id", "week_id", "path"))
    return made.withColumns({"pages": F.array_join(F.transform("pages", lambda p: p.cast("string")), ","), "links": F.array_join("links", ",")})


# Stored knowledge: fingerprints of every document but each ninth, out of date for each fourth.
_STORED = "stored AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE md5(text) END AS fingerprint FROM documents WHERE doc_id % 9 <> 0)"


def _stored(c: Corpus) -> DataFrame:
    return c.documents.filter("doc_id % 9 <> 0").select("doc_id", F.when(_C("doc_id") % 4 == 0, "old").otherwise(F.md5("text")).alias("fingerprint"))


@query("stale_knowledge", f"WITH {_STORED} SELECT s.doc_id, s.fingerprint <> md5(d.text) AS stale FROM stored s JOIN documents d ON d.doc_id = s.doc_id")
def stale_knowledge(c: Corpus) -> DataFrame:
    live = c.documents.select("doc_id", F.md5("text").alias("live"))
    return _stored(c).join(live, "doc_id").select("doc_id", (_C("fingerprint") != _C("live")).alias("stale"))


@query("current_siblings", f"WITH {_STORED} SELECT lang AS course_id, source AS week_id, d.doc_id FROM documents d JOIN stored s ON s.doc_id = d.doc_id AND s.fingerprint = md5(d.text)")
def current_siblings(c: Corpus) -> DataFrame:
    live = c.documents.select("doc_id", F.md5("text").alias("fingerprint"), _C("lang").alias("course_id"), _C("source").alias("week_id"))
    return live.join(_stored(c), ["doc_id", "fingerprint"], "left_semi").select("course_id", "week_id", "doc_id")


@query("invalidate_projections", f"""
    WITH {_ITEMS} SELECT 'concept' AS tab, CAST(NULL AS VARCHAR) AS week_id, doc_id, idx, string_split(content, chr(10))[1] AS line FROM items WHERE category = 'concepts' AND doc_id % 12 <> 0
    UNION ALL SELECT 'summary', week_id, k.doc_id, k.chunk_index, concat(k.content, ' [Resource ', k.doc_id, ', pages ', k.page_number, ']')
    FROM resource r JOIN chunk k ON k.doc_id = r.resource_id WHERE k.doc_id % 12 <> 0 AND EXISTS (SELECT 1 FROM resource u WHERE u.course_id = r.course_id AND u.week_id = r.week_id AND u.resource_id % 12 = 0)""", "chunk", "resource")
def invalidate_projections(c: Corpus) -> DataFrame:
    """Every twelfth document is updated: the concepts that stay, and the summaries that are made anew."""
    updated = c.documents.filter("doc_id % 12 = 0").select("doc_id")
    own = items(c).withColumn("overview", _C("name")).withColumn("pages", F.array("page_number"))
    left, summaries = knowledge.invalidate(own, c.resource.select(_C("resource_id").alias("doc_id"), "course_id", "week_id"), updated)
    concepts = left.select(F.lit("concept").alias("tab"), F.lit(None).cast("string").alias("week_id"), "doc_id", "idx", _C("name").alias("line"))
    return concepts.unionByName(summaries.select(F.lit("summary").alias("tab"), "week_id", _C("resource_id").alias("doc_id"), "idx", _C("point").alias("line")))


# Drafts: an answer for each gold passage that cites in its text and in its list.
_DRAFTS = "drafts AS (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'repeated' WHEN 1 THEN 'unknown' WHEN 2 THEN 'inline' WHEN 3 THEN 'abstention' END AS error FROM benchmark)"


def _drafts(c: Corpus) -> DataFrame:
    k = _C("item_id") % 5
    ids = F.when(k == 0, F.array(F.lit(1), F.lit(1))).when(k == 1, F.array(F.lit(7))).when(k == 3, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    answer = F.when(k == 2, "Fact [2].").when(k == 3, "Fact.").when(k == 1, "Fact [7].").otherwise("Fact [1].")
    return c.table("benchmark").select(_C("item_id").alias("query_id"), F.lit(True).alias("answerable"), answer.alias("answer"), ids.alias("citation_ids"))


def _places(c: Corpus) -> DataFrame:
    return c.table("benchmark").select(_C("item_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("place"))


@query("citation_sets", f"WITH {_DRAFTS} SELECT item_id AS query_id, error FROM drafts")
def citation_sets(c: Corpus) -> DataFrame:
    return retrieval.check_answers(_drafts(c), _places(c))


_ANSWER = f"""
    WITH asked AS (SELECT item_id, any_value(question) AS question, min(course_id) AS course_id, min(expected) AS expected FROM gold GROUP BY 1),
    evidence AS (SELECT item_id, CAST(chunk_index + 1 AS INTEGER) AS place, chunk_id, doc_id, page_number FROM asked JOIN chunk ON doc_id = expected WHERE chunk_index < 2)
    SELECT item_id AS query_id, false AS answerable, '{retrieval.INSUFFICIENT}' AS answer, CAST(NULL AS INTEGER) AS citation_id, CAST(NULL AS BIGINT) AS chunk_id, CAST(NULL AS INTEGER) AS page_number FROM benchmark WHERE item_id % 8 = 6
    UNION ALL SELECT item_id, true, 'Both [2] and [1].', place, chunk_id, page_number FROM evidence WHERE item_id % 8 IN (5, 7) AND (SELECT count(*) FROM evidence e WHERE e.item_id = evidence.item_id) = 2"""


@query("answer_check", _ANSWER, "chunk", "gold")
def answer_check(c: Corpus) -> DataFrame:
    """A draft for each benchmark passage, with the first two chunks of its document as evidence. Two of eight drafts
    cite them rightly, one abstains, and the others err, three of them in their JSON."""
    k = _C("item_id") % 8
    draft = (
        F.when(k == 0, '{"answerable": true, "answer": "A [1].", "citation_ids": [1, 1]}').when(k == 1, '{"answerable": true, "answer": "A [7].", "citation_ids": [7]}')
        .when(k == 2, '{"answerable": true, "answer": "A [1].", "citation_ids": ["1"]}').when(k == 3, '{"answerable": true, "answer": "A [1].", "citation_ids": [1], "title": "x"}')
        .when(k == 4, "so A [1].").when(k == 6, '{"answerable": false, "answer": "None.", "citation_ids": []}').otherwise('{"answerable": true, "answer": "Both [2] and [1].", "citation_ids": [2, 1]}')
    )
    raw = c.table("benchmark").select(_C("item_id").alias("query_id"), draft.alias("draft"))
    asked = c.gold.groupBy("item_id").agg(F.min("expected").alias("doc_id"))
    evidence = c.chunk.filter("chunk_index < 2").join(asked, "doc_id").select(_C("item_id").alias("query_id"), (_C("chunk_index") + 1).alias("place"), "chunk_id", "page_number")
    made = retrieval.answers(retrieval.parse_drafts(raw), evidence)
    return made.select("query_id", "answerable", "answer", F.explode_outer("sources").alias("s")).select("query_id", "answerable", "answer", _C("s.place").alias("citation_id"), "s.chunk_id", "s.page_number")
