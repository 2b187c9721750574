"""Queries of the column expressions: text, links and vectors, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text, urls, vectors
from lectern.operators import knowledge, pages
from lectern.plans import oracle
from lectern.plans.registry import query
from lectern.sources.corpus import Corpus

_C = F.col


@query("clean_text", f"SELECT doc_id, {oracle.clean('text')} AS cleaned FROM documents")
def clean_text(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", text.clean_text(_C("text")).alias("cleaned"))


@query("normalize_words", f"SELECT doc_id, {oracle.normalized('text')} AS words FROM documents")
def normalize_words(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", text.normalize_words(_C("text"), normal_form=True).alias("words"))


@query("section_heading", f"SELECT chunk_id, CASE WHEN length(h) > 120 THEN '' ELSE regexp_replace(replace(lower(h), 'ß', 'ss'), '[\\s\\p{{Z}}]+', ' ', 'g') END AS heading FROM (SELECT chunk_id, coalesce(({oracle.lines('content')})[1], '') AS h FROM chunk)", "chunk")
def section_heading(c: Corpus) -> DataFrame:
    return c.chunk.select("chunk_id", text.section_heading(_C("content")).alias("heading"))


_TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z][a-z0-9]+'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


@query("section_terms", f"""
    SELECT doc_id, item_id, array_to_string(list_sort(list_filter({_TERMS.format('h')}, lambda x: list_contains({_TERMS.format('question')}, x) AND NOT list_contains({_STOP}, x))), ' ') AS terms
    FROM (SELECT doc_id, item_id, coalesce(({oracle.lines('d.text')})[1], '') AS h, question FROM gold g JOIN documents d ON d.doc_id = g.expected)""", "gold")
def section_terms(c: Corpus) -> DataFrame:
    met = c.gold.join(c.documents.select("doc_id", "text"), _C("expected") == _C("doc_id"))
    return met.select("doc_id", "item_id", F.array_join(text.section_terms(_C("text"), _C("question")), " ").alias("terms"))


@query("has_body", "SELECT chunk_id, len(regexp_extract_all(regexp_replace(content, '[^A-Za-z\\p{L}\\p{M}\\p{N}_]+', ' ', 'g'), '(?:^| )[A-Za-z]+')) >= 25 AS has_body FROM (SELECT chunk_id, array_to_string(list_filter(string_split(regexp_replace(content, '[^\\p{L}\\p{M}\\p{N}_]+', ' ', 'g'), ' '), lambda x: regexp_full_match(x, '[A-Za-z]+')), ' ') AS content FROM chunk)", "chunk")
def has_body(c: Corpus) -> DataFrame:
    return c.chunk.select("chunk_id", text.has_body(_C("content")).alias("has_body"))


@query("exercise_prompt", """
    SELECT chunk_id, NOT regexp_matches(content, '(?im)^\\s*(?:worked\\s+)?(?:solution|answer)\\b')
       AND (regexp_matches(content, '(?i)^\\s*(?:question|exercise|problem)\\s*\\d')
            OR (regexp_matches(filename, '(?i)assignment|homework|exercise') AND regexp_matches(content, '(?i)\\b(?:calculate|determine|give an example|what is)\\b'))) AS prompt
    FROM chunk JOIN resource ON resource_id = doc_id""", "chunk", "resource")
def exercise_prompt(c: Corpus) -> DataFrame:
    met = c.chunk.join(c.resource.select("resource_id", "filename"), _C("doc_id") == _C("resource_id"))
    return met.select("chunk_id", text.exercise_prompt(_C("content"), _C("filename")).alias("prompt"))


@query("unreadable_mask", "SELECT doc_id, len(regexp_extract_all(text, '[\\x{FFFD}\\x{FFFC}\\p{Co}]')) AS n_unreadable, md5(regexp_replace(text, '[\\x{FFFD}\\x{FFFC}\\p{Co}]', '[UNREADABLE_SYMBOL]', 'g')) AS masked_md5 FROM documents")
def unreadable_mask(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", text.unreadable_count(_C("text")).cast("long").alias("n_unreadable"), F.md5(text.mask_unreadable(_C("text"))).alias("masked_md5"))


@query("malformed_math", "SELECT doc_id, regexp_matches(text, '[=＝]\\s*(?:\\.{2,}|…+|⋯+|\\[MATHEMATICAL EXPRESSION OMITTED[^\\]\\n]*\\])\\s*[=＝]') AS malformed FROM documents")
def malformed_math(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", text.malformed_math(_C("text")).alias("malformed"))


def _masked_sql() -> str:
    """The rule in RE2, which has the same leftmost matches."""
    mark = lambda x: x.replace("'", "''")
    o, c = knowledge.OPEN, knowledge.CLOSE
    return f"""
        a AS (SELECT doc_id, page_number, len(regexp_extract_all(text, '[\\x{{FFFD}}\\x{{FFFC}}\\p{{Co}}]')) AS n, regexp_replace(text, '[\\x{{FFFD}}\\x{{FFFC}}\\p{{Co}}]', '[UNREADABLE_SYMBOL]', 'g') AS t FROM page),
        b AS (SELECT doc_id, page_number, n, regexp_replace(t, '{mark(knowledge.MATH_IN_LINE)}', '{o}\\0{c}', 'g') AS t FROM a),
        d AS (SELECT doc_id, page_number, n, regexp_replace(regexp_replace(t, '{o}({knowledge.HYPHENATED}){c}', '\\1', 'g'), '\\[{o}(UNREADABLE_SYMBOL){c}\\]', '[\\1]', 'g') AS t FROM b),
        e AS (SELECT doc_id, page_number, n, regexp_replace(t, '{o}([^{c}]*\\[UNREADABLE_SYMBOL\\][^{c}]*){c}', '\\1', 'g') AS t FROM d),
        masked AS (SELECT doc_id, page_number, regexp_replace(t, '{knowledge.GROWN}', '{knowledge.OMITTED}', 'g') AS masked, CAST(n + len(regexp_extract_all(t, '{knowledge.GROWN}')) AS BIGINT) AS n_masked FROM e)"""


@query("math_mask", f"WITH {_masked_sql()} SELECT doc_id, page_number, masked, n_masked FROM masked", "page")
def math_mask(c: Corpus) -> DataFrame:
    """Every page counts as one with a formula warning here."""
    return knowledge.mask_math(c.pages.select(_C("doc_id"), _C("page_number"), _C("text").alias("content"), F.lit(True).alias("warned")))


@query("masking_stats", f"WITH {_masked_sql()} SELECT doc_id, count(*) FILTER (WHERE n_masked > 0) AS chunks_masked, CAST(sum(n_masked) AS BIGINT) AS segments_masked FROM masked GROUP BY 1", "page")
def masking_stats(c: Corpus) -> DataFrame:
    masked = math_mask(c)
    return masked.groupBy("doc_id").agg(F.count_if(_C("n_masked") > 0).alias("chunks_masked"), F.sum("n_masked").alias("segments_masked"))


@query("exam_cue", f"""
    SELECT chunk_id, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '{text.EXAM_CUES}') AND NOT regexp_matches(x, '{text.NEGATED_CUES}'))) > 0 AS cue FROM chunk""", "chunk")
def exam_cue(c: Corpus) -> DataFrame:
    return c.chunk.select("chunk_id", text.exam_cue(_C("content")).alias("cue"))


#: Covers and outlines as the first chunk of some documents; those of 4 and 5 in ten just miss the rule.
COVERED = """CASE WHEN chunk_index > 0 THEN content
    WHEN doc_id % 10 = 1 THEN concat('COMP1234: Networks', chr(10), 'Week ', page_number, ': Routing', chr(10), 'School of Computing', chr(10), 'Term ', doc_id)
    WHEN doc_id % 10 = 2 THEN concat('Outline', chr(10), '1. Routing', chr(10), '2. Switching', chr(10), '3) Names of part ', doc_id)
    WHEN doc_id % 10 = 3 THEN concat('Syllabus', chr(10), '- Routing   - Switching   - Names')
    WHEN doc_id % 10 = 4 THEN concat('COMP1234: Networks', chr(10), 'Week 3: Routing', chr(10), 'School of Computing', chr(10), '1. Item')
    WHEN doc_id % 10 = 5 THEN concat('Outline', chr(10), '1. Routing', chr(10), 'Switching', chr(10), '3. Names')
    ELSE content END"""

_LOW = f"""
    SELECT chunk_id, CASE
        WHEN len(ls) = 0 OR regexp_matches(content, '{text.BODY_EVIDENCE}') THEN NULL
        WHEN len(ls) BETWEEN 4 AND 12 AND n_words <= 60 AND len(list_filter(ls, lambda x: len(regexp_extract_all(x, '[^\\s\\p{{Z}}]+')) > 10)) = 0
             AND regexp_matches(ls[1], '{text.COURSE_LINE}') AND len(list_filter(ls, lambda x: regexp_matches(x, '{text.SESSION_LINE}'))) > 0
             AND len(list_filter(ls, lambda x: regexp_matches(x, '{text.AFFILIATION_LINE}'))) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '{text.LIST_ITEM}'))) = 0 THEN 'cover'
        WHEN lower(ls[1]) IN ('syllabus', 'outline', 'table of contents') AND n_words <= 200 AND len(items) >= 3
             AND len(list_filter(items, lambda x: NOT (regexp_matches(x, '{text.LIST_ITEM}') AND len(regexp_extract_all(regexp_extract(x, '{text.LIST_ITEM}', 1), '[^\\s\\p{{Z}}]+')) <= 10))) = 0 THEN 'outline'
        END AS reason
    FROM (SELECT chunk_id, content, {oracle.lines('content')} AS ls, len(regexp_extract_all(content, '[^\\s\\p{{Z}}]+')) AS n_words,
                 flatten(list_transform(({oracle.lines('content')})[2:], lambda x: regexp_split_to_array(x, '\\s{{3,}}'))) AS items FROM (SELECT chunk_id, {COVERED} AS content FROM chunk))"""


def shown() -> Column:
    """The content of chunks, of which the first of some documents are covers, outlines and nearly such."""
    return F.expr(COVERED.replace("chr(10)", "'\\n'"))


def covered(c: Corpus) -> DataFrame:
    return c.chunk.withColumn("content", shown())


@query("low_information", _LOW, "chunk")
def low_information(c: Corpus) -> DataFrame:
    return covered(c).select("chunk_id", text.low_information(_C("content")).alias("reason"))


@query("symbol_source_ok", "SELECT doc_id, page_number, length(trim(text)) > 0 AND NOT regexp_matches(text, '[\\x{FFFD}\\x{FFFC}\\p{Co}]') AND NOT contains(text, '[UNREADABLE_SYMBOL]') AND NOT regexp_matches(text, '[=＝]\\s*(?:\\.{2,}|…+|⋯+|\\[MATHEMATICAL EXPRESSION OMITTED[^\\]\\n]*\\])\\s*[=＝]') AS ok FROM page", "page")
def symbol_source_ok(c: Corpus) -> DataFrame:
    warnings = F.when(F.length(F.trim("text")) == 0, F.array(F.lit("empty_text"))).otherwise(F.array().cast("array<string>"))
    return c.pages.select("doc_id", "page_number", text.symbol_source_ok(_C("text"), warnings, pages.FORMULA_RISKS).alias("ok"))


_HREF = """CASE WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href
    ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || href END"""
_PARTS = "regexp_replace(lower(regexp_extract(u, '(?i)^https://([^/?#]*)', 1)), ':443$', '') AS host, regexp_replace(regexp_extract(u, '(?i)^https://[^/?#]*([^#]*)', 1), '^\\?', '/?') AS rest"
_NORMAL = "CASE WHEN regexp_matches(u, '(?i)^https://') AND NOT regexp_matches(u, '[\\\\\\x00-\\x20\\x7f]') AND length(u) <= 8192 AND regexp_matches(host, '^[a-z0-9.-]+(:\\d+)?$') THEN 'https://' || host || CASE WHEN rest = '' THEN '/' ELSE rest END END"
_LINKS = f"links AS (SELECT page_id, pos, href, link_text, url AS base, {_NORMAL} AS url FROM (SELECT *, {_PARTS} FROM (SELECT page_id, pos, href, link_text, url, {_HREF} AS u FROM link)))"


def links(c: Corpus) -> DataFrame:
    """page_id, pos, href, link_text, base, url (normalised, or null)."""
    return c.link.select("page_id", "pos", "href", "link_text", _C("url").alias("base"), urls.normalize(urls.resolve(_C("href"), _C("url"))).alias("url"))


@query("url_normalize", f"WITH {_LINKS} SELECT page_id, pos, url FROM links", "link")
def url_normalize(c: Corpus) -> DataFrame:
    return links(c).select("page_id", "pos", "url")


_FILE_URL = "concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), CASE page_id % 8 WHEN 0 THEN concat('/files/', page_id + 1, '/download') WHEN 1 THEN concat('/courses/3/files?preview=', page_id) WHEN 2 THEN concat('/api/v1/courses/12/files/', page_id, '/') WHEN 3 THEN concat('/files/', page_id, '/evil/x') WHEN 4 THEN concat('/courses/3/files?preview=0&file_id=', page_id) WHEN 5 THEN concat('/files?preview=', page_id) WHEN 6 THEN concat('/files/0', page_id) ELSE concat('.evil.test/files/', page_id) END)"


@query("file_id_from_url", f"""
    SELECT page_id, CASE WHEN u LIKE 'https://%' AND page_id % 8 IN (0, 1, 2, 4) THEN CASE WHEN page_id % 8 = 0 THEN page_id + 1 ELSE page_id END END AS file_id FROM (SELECT page_id, {_FILE_URL} AS u FROM pages)""")
def file_id_from_url(c: Corpus) -> DataFrame:
    """Eight forms of addresses, of which four name a file of the site."""
    made = c.table("pages").select("page_id", F.expr(_FILE_URL).alias("u"), urls.site(_C("url")).alias("site"))
    return made.select("page_id", urls.file_id(_C("u"), _C("site")).alias("file_id"))


@query("source_key", f"WITH {_LINKS} SELECT page_id, pos, sha256(url) AS key, 'external:' || sha256(url) AS material_key FROM links WHERE url IS NOT NULL", "link")
def source_key(c: Corpus) -> DataFrame:
    kept = links(c).filter("url IS NOT NULL")
    return kept.select("page_id", "pos", urls.source_key(_C("url")).alias("key"), urls.material_key(F.lit(None).cast("long"), _C("url")).alias("material_key"))


#: Vectors of which some are null, empty, zero, short or not finite.
_MADE = "CASE chunk_id % 8 WHEN 1 THEN NULL WHEN 2 THEN {empty} WHEN 3 THEN {zero} WHEN 4 THEN {short} WHEN 5 THEN {nan} ELSE embedding END"


@query("unit_vector", f"""
    WITH v AS (SELECT chunk_id, {_MADE.format(empty='[]', zero='list_transform(embedding, lambda x: 0.0)', short='embedding[1:9]', nan="list_append(embedding[1:63], CAST('nan' AS DOUBLE))")} AS embedding FROM vectors),
    r AS (SELECT *, CASE WHEN embedding IS NULL OR len(embedding) = 0 THEN 'empty' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 THEN 'not finite'
          WHEN list_sum(list_transform(embedding, lambda x: x * x)) = 0 THEN 'zero' END AS reason FROM v),
    u AS (SELECT chunk_id, reason, CASE WHEN reason IS NULL THEN list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) END AS u FROM r)
    SELECT chunk_id, reason, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS norm, round(u[1], 6) AS first, round(u[64], 6) AS last FROM u""", "vectors")
def unit_vector(c: Corpus) -> DataFrame:
    made = _MADE.format(empty="array()", zero="transform(embedding, x -> 0D)", short="slice(embedding, 1, 9)", nan="concat(slice(embedding, 1, 63), array(double('nan')))")
    made = c.vectors.withColumn("embedding", _C("embedding").cast("array<double>")).withColumn("embedding", F.expr(made))
    reason = vectors.invalid_reason(_C("embedding"), 64)
    made = made.select("chunk_id", reason.alias("reason"), F.when(reason.isNull(), vectors.unit(_C("embedding"))).alias("u"))
    return made.select("chunk_id", "reason", F.round(vectors.dot(_C("u"), _C("u")), 6).alias("norm"), F.round(F.get("u", 0), 6).alias("first"), F.round(F.get("u", 63), 6).alias("last"))


@query("cosine", "SELECT a.chunk_id, b.chunk_id AS other_id, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS score FROM vectors a JOIN vectors b ON b.chunk_id = a.chunk_id + 1", "vectors")
def cosine(c: Corpus) -> DataFrame:
    """Each vector with the one of the next id."""
    unit = vectors.unit(_C("embedding"))
    other = c.vectors.select((_C("chunk_id") - 1).alias("chunk_id"), _C("chunk_id").alias("other_id"), unit.alias("y"))
    return c.vectors.select("chunk_id", unit.alias("x")).join(other, "chunk_id").select("chunk_id", "other_id", F.round(vectors.cosine(_C("x"), _C("y")), 6).alias("score"))


_REPORT = "CASE WHEN doc_id % 4 = 1 THEN {} END"
_SOURCE = f"""sha256(CAST(json_object('chunk_index', chunk_index, 'page_number', page_number, 'parsing_report', {_REPORT.format("json_object('pages', doc_id % 7, 'status', 'review \"x\"')")}, 'path', path, 'resource_id', doc_id, 'revision', revision, 'updated_at', updated_at, 'week_id', week_id) AS VARCHAR))"""


def source_hash() -> Column:
    """Hash of all that a chunk's vector depends on besides its text: place, week, time, revision, file and report, but
    not the role."""
    report = F.expr(_REPORT.format("named_struct('pages', doc_id % 7, 'status', 'review \"x\"')"))
    names = ("chunk_index", "page_number", "path", "revision", "updated_at", "week_id")
    return F.sha2(text.canonical_json(**{n: _C(n) for n in names}, resource_id=_C("doc_id"), parsing_report=report), 256)


@query("fingerprints", f"SELECT chunk_id, sha256(content) AS content_hash, {_SOURCE} AS source_hash FROM chunk JOIN resource ON resource_id = doc_id", "chunk", "resource")
def fingerprints(c: Corpus) -> DataFrame:
    met = c.chunk.join(c.resource, _C("doc_id") == _C("resource_id"))
    return met.select("chunk_id", F.sha2("content", 256).alias("content_hash"), source_hash().alias("source_hash"))


@query("corpus_fingerprint", """
    SELECT d.doc_id, sha256(CAST(json_object('chunks', coalesce(chunks, []), 'digest', sha256(text), 'updated_at', updated_at, 'week_id', week_id) AS VARCHAR)) AS fingerprint
    FROM documents d JOIN resource ON resource_id = d.doc_id LEFT JOIN (SELECT doc_id, list({'hash': sha256(content), 'index': chunk_index, 'page': page_number} ORDER BY chunk_index) AS chunks FROM chunk GROUP BY 1) k ON k.doc_id = d.doc_id""", "chunk", "resource")
def corpus_fingerprint(c: Corpus) -> DataFrame:
    """Of a document's file, week, time and ordered chunks."""
    own = F.array_sort(F.collect_list(F.struct("chunk_index", F.struct(F.sha2("content", 256).alias("hash"), _C("chunk_index").alias("index"), _C("page_number").alias("page")).alias("c"))))
    listed = c.chunk.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.transform("own", lambda x: x["c"]).alias("chunks"))
    met = c.documents.select("doc_id", F.sha2("text", 256).alias("digest")).join(c.resource.select(_C("resource_id").alias("doc_id"), "updated_at", "week_id"), "doc_id").join(listed, "doc_id", "left")
    none = F.array().cast(listed.schema["chunks"].dataType)
    made = text.canonical_json(chunks=F.coalesce("chunks", none), digest=_C("digest"), updated_at=_C("updated_at"), week_id=_C("week_id"))
    return met.select("doc_id", F.sha2(made, 256).alias("fingerprint"))


@query("file_type", """
    SELECT page_id, name, CASE WHEN regexp_matches(lower(name), '[^./](\\.[^./]+)$') THEN regexp_extract(lower(name), '[^./](\\.[^./]+)$', 1) ELSE 'unknown' END AS file_type
    FROM (SELECT page_id, url_decode(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)) AS name FROM pages)""")
def file_type(c: Corpus) -> DataFrame:
    named = c.table("pages").select("page_id", text.file_name(_C("url")).alias("name"))
    return named.select("page_id", "name", text.file_type(_C("name")).alias("file_type"))


_TITLE = "CASE doc_id % 4 WHEN 0 THEN concat('Week ', doc_id % 13) WHEN 1 THEN concat('Module ', doc_id % 17, ': x') WHEN 2 THEN concat('topic ', doc_id % 3) ELSE source END"


@query("week_number", f"SELECT doc_id, CASE WHEN n > 0 THEN n END AS week_number FROM (SELECT doc_id, TRY_CAST(regexp_extract({_TITLE}, '(?i)^\\s*(?:week|module|topic)\\s+(\\d+)\\b', 1) AS INTEGER) AS n FROM documents)")
def week_number(c: Corpus) -> DataFrame:
    return c.documents.select("doc_id", text.week_number(F.expr(_TITLE)).alias("week_number"))


#: Metadata that may speak for a material's role.
METADATA = ["filename", "display_name", "item_title", "link_text", "page_title", "module_title", "nearby_text"]


@query("bounded_metadata", "SELECT doc_id, filename, substr(text, 1, 500) AS nearby_text, CAST(2 AS INTEGER) AS n_keys FROM (SELECT doc_id, source || '.pdf' AS filename, text FROM documents)")
def bounded_metadata(c: Corpus) -> DataFrame:
    given = F.create_map(F.lit("filename"), F.concat("source", F.lit(".pdf")), F.lit("nearby_text"), _C("text"), F.lit("secret"), F.lit("x"))
    kept = F.transform_values(F.map_filter(given, lambda k, v: k.isin(METADATA)), lambda k, v: F.substring(v, 1, 500))
    return c.documents.select("doc_id", kept.alias("m")).select("doc_id", _C("m")["filename"].alias("filename"), _C("m")["nearby_text"].alias("nearby_text"), F.size("m").alias("n_keys"))


@query("revision_hash", """
    SELECT event_id, CASE WHEN event_id % 3 = 2 AND event_id % 2 = 1 THEN NULL ELSE
        sha256(concat_ws('|', CASE WHEN event_id % 3 = 2 THEN '-' ELSE '"' || event_type || '"' END, CASE WHEN event_id % 2 = 1 THEN '-' ELSE strftime(ts, '%Y-%m-%d') END, user_id)) END AS revision FROM events""")
def revision_hash(c: Corpus) -> DataFrame:
    etag = F.when(_C("event_id") % 3 == 2, F.concat(F.lit('W/"'), "event_type", F.lit('"'))).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    modified = F.when(_C("event_id") % 2 == 1, F.lit("never")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return c.table("events").select("event_id", urls.revision_hash(etag, modified, _C("user_id")).alias("revision"))


@query("classification_columns", """
    SELECT resource_id, CASE WHEN resource_id % 6 = 0 THEN 1.0 WHEN resource_id % 6 = 1 THEN 0.65 ELSE 0.9 END AS confidence, CASE WHEN resource_id % 6 = 0 THEN 'manual' ELSE 'metadata' END AS method FROM resource""", "resource")
def classification_columns(c: Corpus) -> DataFrame:
    details = F.struct(F.when(_C("resource_id") % 6 == 1, 0.65).otherwise(0.9).alias("confidence"), F.lit("metadata").alias("method"))
    manual = _C("resource_id") % 6 == 0
    rows = c.resource.select("resource_id", manual.alias("manual"), details.alias("details"))
    return rows.select("resource_id", F.when(_C("manual"), 1.0).otherwise(_C("details.confidence")).cast("double").alias("confidence"), F.when(_C("manual"), "manual").otherwise(_C("details.method")).alias("method"))


@query("source_link", "SELECT chunk_id, CASE WHEN path IS NOT NULL THEN concat('/api/resources/', doc_id, '/file#page=', page_number) END AS link, substr(content, 1, 300) AS preview FROM chunk JOIN resource ON resource_id = doc_id", "chunk", "resource")
def source_link(c: Corpus) -> DataFrame:
    met = c.chunk.join(c.resource.select("resource_id", "path"), _C("doc_id") == _C("resource_id"))
    place = F.when(_C("path").isNotNull(), F.concat(F.lit("/api/resources/"), "doc_id", F.lit("/file#page="), "page_number"))
    return met.select("chunk_id", place.alias("link"), F.substring("content", 1, 300).alias("preview"))


#: Every known code, and one that is not, dealt to pages; and the labels and severities as the oracle has them.
_CODE = "CASE page_number % 10 WHEN 0 THEN 'suspicious_formula_layout' WHEN 1 THEN 'unusual_symbol_position' WHEN 2 THEN 'unreadable_symbol' WHEN 3 THEN 'encoding_warning' WHEN 4 THEN 'empty_text' WHEN 5 THEN 'possible_scanned_page' WHEN 6 THEN 'suspicious_symbolic_expression' WHEN 7 THEN 'layout_review_recommended' WHEN 8 THEN 'repeated_header_footer' ELSE concat('odd_', page_number) END"
_LABELS = """(VALUES ('suspicious_formula_layout', 'Formula layout may be unreliable', 'warning'), ('unusual_symbol_position', 'Symbol positioning needs review', 'warning'), ('unreadable_symbol', 'Unreadable symbol detected', 'warning'),
    ('encoding_warning', 'Text encoding needs review', 'warning'), ('empty_text', 'No extractable text', 'critical'), ('possible_scanned_page', 'Little or no extractable text', 'critical'),
    ('suspicious_symbolic_expression', 'Suspicious mathematical expression', 'warning'), ('layout_review_recommended', 'Text layout needs review', 'warning'), ('repeated_header_footer', 'Repeated page furniture cleaned', 'info')) AS i(code, label, severity)"""


@query("issue_labels", f"SELECT doc_id, page_number, p.code, coalesce(label, 'Page needs review') AS label, coalesce(severity, 'warning') AS severity FROM (SELECT doc_id, page_number, {_CODE} AS code FROM page) p LEFT JOIN {_LABELS} ON i.code = p.code", "page")
def issue_labels(c: Corpus) -> DataFrame:
    return pages.label_issues(c.pages.select("doc_id", "page_number", F.expr(_CODE).alias("code"))).select("doc_id", "page_number", "code", "label", "severity")


@query("usage_allowlist", "SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS prompt_tokens FROM events")
def usage_allowlist(c: Corpus) -> DataFrame:
    return c.table("events").select("event_id", F.from_json("props", "k long").alias("u")).select("event_id", _C("u.k").alias("prompt_tokens"))
