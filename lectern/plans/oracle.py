"""The derived tables of lectern.sources.corpus in DuckDB SQL, and how a query is put together."""

from __future__ import annotations

from lectern.sources.corpus import CHUNK_OVERLAP, CHUNK_SIZE, COURSE, KNOWLEDGE, MARGIN_LINES, PAGE_LINES, RAW_TEXT, RESOURCE, SEMESTER, SNAPSHOT, SPAN_BOX, SPAN_KIND, WEEK

_WHITE = r"[\t\x0B\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"


def clean(x: str) -> str:
    one = rf"replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(0), '')"
    trimmed = rf"regexp_replace({one}, '(?m){_WHITE}+$', '', 'g')"
    return rf"trim(regexp_replace({trimmed}, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


def normalized(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def lines(x: str) -> str:
    """Trimmed lines that are not blank."""
    return rf"list_filter(list_transform(string_split({x}, chr(10)), lambda x: regexp_replace(x, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda x: x <> '')"


def _stop(at: str) -> str:
    """Where the chunk that begins at `at` ends."""
    low, end = f"({at} + {max(CHUNK_SIZE // 2, CHUNK_OVERLAP + 1)})", f"least({at} + {CHUNK_SIZE}, length(t))"
    win = f"substr(t, {low} + 1, {end} - {low})"
    marks = ".!?。！？"
    last = [
        f"length(regexp_extract({win}, '(?s)^.*\\n\\n'))",
        f"length(regexp_extract({win}, '(?s)^.*\\n'))",
        f"greatest(length(regexp_extract({win}, '(?s)^.*[{marks}]\\s+')), length(regexp_extract({win}, '(?s)^(.*[{marks}])[^\\x00-\\x7f]', 1)))",
        f"length(regexp_extract({win}, '(?s)^.*\\s+'))",
    ]
    whens = " ".join(f"WHEN {x} > 0 THEN {low} + {x}" for x in last)
    return f"CASE WHEN {end} = length(t) THEN length(t) {whens} ELSE {end} END"


VIEWS = {
    "resource": RESOURCE.format(documents="documents"),
    "semester": SEMESTER.format(documents="documents"),
    "course": COURSE.format(documents="documents"),
    "week": WEEK.format(documents="documents"),
    "knowledge": KNOWLEDGE.format(documents="documents"),
    "chunk_vec": "SELECT vec_id * 1000000 AS chunk_id, embedding FROM embeddings",
    "doc_lines": "SELECT doc_id, lang, i - 1 AS pos, ls[i] AS line FROM (SELECT doc_id, lang, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents))",
    "doc_pages": f"SELECT doc_id, CAST(pos // {PAGE_LINES} + 1 AS INTEGER) AS page_number, string_agg(line, chr(10) ORDER BY pos) AS raw_text FROM doc_lines GROUP BY ALL",
    "page": f"SELECT doc_id, page_number, {clean('raw_text')} AS text FROM doc_pages",
    "steps": f"""
        SELECT doc_id, page_number, t, 0 AS pos0, {_stop('0')} AS stop FROM (SELECT doc_id, page_number, text AS t FROM page WHERE length(text) > 0)
        UNION ALL
        SELECT doc_id, page_number, t, nxt AS pos0, {_stop('nxt')} AS stop FROM (
            SELECT doc_id, page_number, t,
                   CASE WHEN regexp_matches(substr(t, back, 1), '[\\p{{L}}\\p{{N}}]') AND regexp_matches(substr(t, back + 1, 1), '[\\p{{L}}\\p{{N}}]')
                        THEN back + length(regexp_extract(substr(t, back + 1, stop - back), '(?s)^.*?\\s+')) ELSE back END AS nxt
            FROM (SELECT *, greatest(pos0 + 1, stop - {CHUNK_OVERLAP}) AS back FROM steps WHERE stop < length(t)))""",
    "chunk": """
        SELECT doc_id * 1000000 + chunk_index AS chunk_id, * FROM (
            SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, pos0) - 1 AS INTEGER) AS chunk_index, substr(t, pos0 + 1, stop - pos0) AS content
            FROM steps WHERE regexp_matches(substr(t, pos0 + 1, stop - pos0), '[^\\s\\p{Z}]'))""",
    "vectors": "SELECT vec_id AS chunk_id, label AS course_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings",
    "snap_old": f"SELECT user_id AS resource_id, max(ts) AS updated_at FROM events WHERE ts < TIMESTAMP '{SNAPSHOT}' GROUP BY 1",
    "snap_new": "SELECT user_id AS resource_id, max(ts) AS updated_at FROM events GROUP BY 1",
    "link": """
        SELECT page_id, url, CAST(i - 1 AS INTEGER) AS pos, hrefs[i] AS href, texts[i] AS link_text FROM (
            SELECT page_id, url, unnest(generate_series(1, len(hrefs))) AS i, hrefs, texts FROM (
                SELECT page_id, url, regexp_extract_all(b, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(b, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts
                FROM (SELECT page_id, url, regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g') AS b FROM pages)))""",
    "gold": f"""SELECT DISTINCT item_id, question, course_id, expected, generate_series(CAST(seen // {PAGE_LINES} + 1 AS INTEGER), CAST((seen + own) // {PAGE_LINES} + 1 AS INTEGER)) AS pages FROM (
        SELECT item_id, b.text AS question, d.lang AS course_id, doc_id AS expected, len(string_split(substr(d.text, 1, strpos(d.text, b.text) - 1), chr(10))) - 1 AS seen, len(string_split(b.text, chr(10))) - 1 AS own
        FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text))""",
}
_NEEDS = {"doc_pages": ["doc_lines"], "page": ["doc_pages"], "steps": ["page"], "chunk": ["steps"]}


def _spans() -> str:
    lines = "SELECT doc_id, page_number, ls[i] AS line, i - 1 AS l FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, page_number, string_split(text, chr(10)) AS ls FROM page))"
    parts = f"SELECT doc_id, page_number, l, CASE WHEN l < 2 THEN string_split(line, ' ') ELSE [line] END AS parts FROM ({lines}) WHERE trim(line) <> ''"
    words = f"SELECT *, {SPAN_KIND.format(l='l', p='p')} AS k, CASE WHEN p + 1 < len(parts) THEN parts[p + 1] || ' ' ELSE parts[p + 1] END AS text FROM (SELECT *, unnest(range(len(parts))) AS p FROM ({parts}))"
    out = [f"SELECT *, origin_y - size AS y0, origin_y + 2 AS y1 FROM (SELECT doc_id, page_number, l AS line_index, l * 1000000 + p AS span_index, text, {SPAN_BOX} FROM ({words}))"]
    for i, (_, when, what, x0, x1, y0, size) in enumerate(MARGIN_LINES):
        right = f"CAST({x1} AS DOUBLE)" if x1 != "0" else f"CAST({x0} AS DOUBLE) + 120"
        out.append(
            f"SELECT doc_id, page_number, {100 + i}, {100_000_000 + i}, {what}, CAST({size} AS DOUBLE), CAST({y0} + 8 AS DOUBLE), CAST({x0} AS DOUBLE), {right}, CAST(0 AS DOUBLE), 0, CAST({y0} AS DOUBLE), CAST({y0} + 10 AS DOUBLE) FROM page WHERE {when}")
    return " UNION ALL ".join(out)


_NUMBERED = "regexp_matches(line_text, concat('(?i)^(page\\s+)?0*', l.page_number, '$'))"
_SIZED = "CAST({} AS DOUBLE)".format
VIEWS |= {
    "sheet": f"SELECT doc_id, page_number, text AS body, {RAW_TEXT.format(nl='chr(10)')} AS raw_text FROM page",
    "span": _spans(),
    "span_pair": f"""
        SELECT DISTINCT s.doc_id, s.page_number, s.span_index AS span, b.span_index AS base FROM span s JOIN span b ON s.doc_id = b.doc_id AND s.page_number = b.page_number AND s.line_index = b.line_index AND s.span_index <> b.span_index
        WHERE trim(s.text) <> '' AND trim(b.text) <> '' AND abs(s.dir_y) <= {_SIZED(0.05)} AND s.size < {_SIZED(0.85)} * b.size AND greatest(b.x0 - s.x1, s.x0 - b.x1, 0) <= b.size
          AND abs(s.origin_y - b.origin_y) BETWEEN {_SIZED(0.12)} * b.size AND {_SIZED(0.65)} * b.size""",
    "span_moved": f"""
        SELECT s.doc_id, s.page_number, s.span_index AS span, NOT regexp_matches(s.text, '[\\p{{L}}\\p{{N}}]') AS symbol FROM span s LEFT JOIN (SELECT DISTINCT doc_id, page_number, span FROM span_pair) p ON p.doc_id = s.doc_id AND p.page_number = s.page_number AND p.span = s.span_index
        WHERE p.span IS NOT NULL OR (s.flags % 2 = 1 AND abs(s.dir_y) <= {_SIZED(0.05)} AND trim(s.text) <> '')""",
    "layout_line": "SELECT doc_id, page_number, line_index, trim(string_agg(text, '' ORDER BY span_index), chr(10) || chr(9) || ' ' || chr(160)) AS line_text, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, max(size) AS font, max(abs(dir_y)) AS lean FROM span GROUP BY ALL",
    "body_font": "SELECT doc_id, page_number, CAST(median(size) AS DOUBLE) AS body_font FROM span WHERE trim(text) <> '' AND origin_y > 64 AND origin_y < 736 GROUP BY ALL",
    "margin_line": f"""
        SELECT * FROM (
            SELECT l.doc_id, l.page_number, line_text, CASE WHEN y1 <= 64 THEN 'header' WHEN y0 >= 736 THEN 'footer' END AS zone, count(*) OVER (PARTITION BY l.doc_id, l.page_number, line_text) AS times, font, lean, body_font,
                   CASE WHEN {_NUMBERED} THEN '<physical-page-number>' WHEN length(line_text) >= 8 AND regexp_matches(line_text, '\\S\\s+\\S') AND NOT regexp_matches(line_text, '(?i)^(page\\s+)?[0-9]+$') THEN line_text END AS key,
                   CAST(round_even(CASE WHEN {_NUMBERED} THEN x1 ELSE x0 END / 600 / {_SIZED(0.02)}, 0) AS INTEGER) AS x, CAST(round_even(y0 / 800 / {_SIZED(0.02)}, 0) AS INTEGER) AS y
            FROM layout_line l LEFT JOIN body_font m ON m.doc_id = l.doc_id AND m.page_number = l.page_number)
        WHERE zone IS NOT NULL AND key IS NOT NULL AND font <= {_SIZED(0.8)} * body_font AND lean <= {_SIZED(0.05)} AND length(line_text) BETWEEN 1 AND 100""",
    "margin_often": f"""
        SELECT m.doc_id, zone, key, x, y, count(DISTINCT m.page_number) AS n_pages FROM margin_line m JOIN (SELECT doc_id, count(*) AS n FROM page GROUP BY 1) d ON d.doc_id = m.doc_id
        GROUP BY m.doc_id, zone, key, x, y, n HAVING count(DISTINCT m.page_number) >= greatest(3, ceil({_SIZED(0.7)} * n))""",
    # A raw line of margins alone is left with blanks when they are taken out of it, as none here begins another.
    "stripped": f"""
        SELECT doc_id, page_number, raw_text, {clean("array_to_string(list_filter(ls, lambda x: NOT list_contains(gone, x)), chr(10))")} AS text,
               CAST(coalesce(list_sum(list_transform(gone, lambda x: len(list_filter(heads, lambda m: contains(x, m))))), 0) AS INTEGER) AS headers_removed, CAST(coalesce(list_sum(list_transform(gone, lambda x: len(list_filter(feet, lambda m: contains(x, m))))), 0) AS INTEGER) AS footers_removed
        FROM (SELECT *, list_filter(ls, lambda x: len(list_filter(ls, lambda y: y = x)) = 1 AND x <> '' AND trim(list_reduce(list_prepend(x, list_concat(heads, feet)), lambda a, m: replace(a, m, ''))) = '') AS gone
              FROM (SELECT s.doc_id, s.page_number, s.raw_text, string_split(s.raw_text, chr(10)) AS ls, coalesce(heads, []) AS heads, coalesce(feet, []) AS feet FROM sheet s LEFT JOIN (
                  SELECT f.doc_id, f.page_number, list(DISTINCT line_text) FILTER (WHERE f.zone = 'header') AS heads, list(DISTINCT line_text) FILTER (WHERE f.zone = 'footer') AS feet
                  FROM margin_line f JOIN margin_often o ON o.doc_id = f.doc_id AND o.zone = f.zone AND o.key = f.key AND o.x = f.x AND o.y = f.y WHERE times = 1 GROUP BY ALL) g ON g.doc_id = s.doc_id AND g.page_number = s.page_number))""",
    "warning": f"""
        SELECT doc_id, page_number, unnest(['empty_text', 'possible_scanned_page']) AS code, 1 AS occurrences, '' AS spans FROM sheet WHERE NOT regexp_matches(raw_text, '[^\\s\\p{{Z}}]')
        UNION ALL SELECT doc_id, page_number, 'encoding_warning', CAST(length(raw_text) - length(replace(raw_text, chr(65533), '')) AS INTEGER), '' FROM sheet WHERE contains(raw_text, chr(65533))
        UNION ALL SELECT doc_id, page_number, 'suspicious_formula_layout', CAST(count(*) AS INTEGER), string_agg(span, ',' ORDER BY span) FROM span_moved GROUP BY doc_id, page_number
        UNION ALL SELECT doc_id, page_number, 'unusual_symbol_position', CAST(count(*) AS INTEGER), string_agg(span, ',' ORDER BY span) FROM span_moved WHERE symbol GROUP BY doc_id, page_number""",
    "issue": f"""
        SELECT doc_id, page_number, code, occurrences, CASE WHEN code IN ('empty_text', 'possible_scanned_page') THEN 'critical' WHEN code = 'repeated_header_footer' THEN 'info' ELSE 'warning' END AS severity FROM (
            SELECT doc_id, page_number, code, occurrences FROM warning
            UNION ALL SELECT doc_id, page_number, 'repeated_header_footer', headers_removed + footers_removed FROM stripped WHERE headers_removed + footers_removed > 0
            UNION ALL SELECT doc_id, page_number, 'unreadable_symbol', greatest(1, CAST(length(raw_text) - length(regexp_replace(raw_text, '[\\x{{FFFD}}\\x{{FFFC}}\\p{{Co}}]', '', 'g')) AS INTEGER)) FROM stripped WHERE regexp_matches(raw_text, '[\\x{{FFFD}}\\x{{FFFC}}\\p{{Co}}]') OR contains(raw_text, '[UNREADABLE_SYMBOL]')
            UNION ALL SELECT doc_id, page_number, 'suspicious_symbolic_expression', 1 FROM stripped WHERE regexp_matches(text, '[=＝]\\s*(\\.{{2,}}|…+|⋯+|\\[MATHEMATICAL EXPRESSION OMITTED[^\\]\\n]*\\])\\s*[=＝]'))""",
    "report": """
        SELECT p.doc_id, CASE WHEN coalesce(review_pages, 0) > 0 OR pages_with_text <= 0.1 * pages THEN 'review' ELSE 'healthy' END AS status, pages, pages_with_text, coalesce(review_pages, 0) AS review_pages, coalesce(encoding_pages, 0) AS encoding_pages, pages_with_text <= 0.1 * pages AS possible_scan
        FROM (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE regexp_matches(text, '[^\\s\\p{Z}]')) AS pages_with_text FROM stripped GROUP BY 1) p
        LEFT JOIN (SELECT doc_id, count(DISTINCT page_number) FILTER (WHERE severity <> 'info') AS review_pages, count(DISTINCT page_number) FILTER (WHERE code = 'encoding_warning') AS encoding_pages FROM issue GROUP BY 1) i ON i.doc_id = p.doc_id""",
}
_NEEDS |= {
    "sheet": ["page"], "span": ["page"], "span_pair": ["span"], "span_moved": ["span_pair"], "layout_line": ["span"], "body_font": ["span"], "margin_line": ["layout_line", "body_font"], "margin_often": ["margin_line"],
    "stripped": ["sheet", "margin_often"], "warning": ["sheet", "span_moved"], "issue": ["warning", "stripped"], "report": ["issue"],
}


def with_views(body: str, *names: str) -> str:
    """body with the derived tables that it names in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, []):
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    ctes = ", ".join(f"{x} AS ({VIEWS[x]})" for x in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {ctes}, {body[5:]}" if ctes else f"WITH RECURSIVE {body[5:]}"
    return f"WITH RECURSIVE {ctes} {body}" if ctes else body
