"""Queries over the catalog: scans, listings, upserts, scopes, weeks and sync telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as text_functions
from lectern.operators import catalog, pages, sync
from lectern.plans import health
from lectern.plans.registry import query
from lectern.sources.corpus import Corpus
from lectern.sources.scratch import shared_dir

_C = F.col


@query("catalog_scan", """
    SELECT 'semester' AS level, CAST(NULL AS VARCHAR) AS parent, CAST(semester_id AS VARCHAR) AS key FROM (SELECT * FROM semester ORDER BY semester_id DESC LIMIT 2 OFFSET 0)
    UNION ALL SELECT 'course', CAST(semester_id AS VARCHAR), course_id FROM (SELECT * FROM course ORDER BY course_id LIMIT 100 OFFSET 1)
    UNION ALL SELECT 'week', course_id, week_id FROM (SELECT * FROM week ORDER BY course_id NULLS FIRST, week_number NULLS FIRST, week_id NULLS FIRST LIMIT 50 OFFSET 10)
    UNION ALL SELECT 'resource', week_id, CAST(resource_id AS VARCHAR) FROM (SELECT * FROM resource ORDER BY course_id NULLS FIRST, week_id NULLS FIRST, resource_id LIMIT 200 OFFSET 100)""", "semester", "course", "week", "resource")
def catalog_scan(c: Corpus) -> DataFrame:
    """A page of each listing: semesters by year from the last, courses by code, weeks by number, resources."""
    text = lambda x: _C(x).cast("string")
    level = lambda name, df, parent, key: df.select(F.lit(name).alias("level"), parent.alias("parent"), text(key).alias("key"))
    semesters = level("semester", catalog.listing(c.semester, [F.desc("semester_id")], 0, 2), F.lit(None).cast("string"), "semester_id")
    courses = level("course", catalog.listing(c.course, [_C("course_id")], 1, 100), text("semester_id"), "course_id")
    weeks = level("week", catalog.listing(c.week, [_C("course_id"), _C("week_number"), _C("week_id")], 10, 50), text("course_id"), "week_id")
    resources = level("resource", catalog.listing(c.resource, [_C("course_id"), _C("week_id"), _C("resource_id")], 100, 200), text("week_id"), "resource_id")
    return semesters.unionByName(courses).unionByName(weeks).unionByName(resources)


@query("chunk_listing", "SELECT doc_id, chunk_index, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS n FROM chunk) WHERE n > 2 AND n <= 7", "chunk")
def chunk_listing(c: Corpus) -> DataFrame:
    """The second page of five of each document, after an offset of two."""
    return catalog.page_of(c.chunk, "doc_id", "chunk_index", 2, 5).select("doc_id", "chunk_index", "content")


@query("week_resources", "SELECT course_id, week_id, resource_id, filename, role, CASE WHEN resource_id % 6 = 0 THEN 'manual' ELSE 'metadata' END AS method, r.status, h.status AS health FROM resource r JOIN report h ON doc_id = resource_id", "resource", "report")
def week_resources(c: Corpus) -> DataFrame:
    report = health.report(c).select("doc_id", _C("status").alias("health"))
    method = F.when(_C("resource_id") % 6 == 0, "manual").otherwise("metadata")
    joined = c.resource.join(report, _C("resource_id") == _C("doc_id"))
    return joined.select("course_id", "week_id", "resource_id", "filename", "role", method.alias("method"), "status", "health").orderBy("course_id", "week_id", "filename", "resource_id")


_LISTING = """concat('{"course": {"id": ', doc_id % 5, ', "name": "', lang, '", "other": 1, "term": {"id": ', doc_id % 3, '}}, "items": [{"id": ', doc_id, ', "type": "File", "content_id": ', doc_id * 2, '}, {"id": ', doc_id + 1, ', "type": "Page", "content_id": 5}]}')"""


@query("listing_flatten", "SELECT doc_id, CAST(doc_id % 5 AS BIGINT) AS canvas_course_id, CAST(doc_id % 3 AS BIGINT) AS term_id, doc_id + k AS item_id, CASE WHEN k = 0 THEN doc_id * 2 END AS file_id FROM documents, (VALUES (0), (1)) AS v(k)")
def listing_flatten(c: Corpus) -> DataFrame:
    return catalog.flatten_listing(c.documents.select("doc_id", F.expr(_LISTING).alias("json")))


_REPLACED = """
    SELECT chunk_id, doc_id, content FROM chunk WHERE doc_id % 3 <> 0
    UNION ALL SELECT chunk_id, doc_id, concat('new ', content) AS content FROM chunk WHERE doc_id % 3 = 0 AND chunk_index < 2"""


def _replacement(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, the new ones of every third document, and the ids of these documents."""
    new = c.chunk.filter("doc_id % 3 = 0 AND chunk_index < 2").select("chunk_id", "doc_id", F.concat(F.lit("new "), "content").alias("content"))
    return c.chunk.select("chunk_id", "doc_id", "content"), new, c.chunk.filter("doc_id % 3 = 0").select("doc_id").distinct()


@query("replace_by_key", _REPLACED, "chunk")
def replace_by_key(c: Corpus) -> DataFrame:
    return catalog.replace_by_key(*_replacement(c), "doc_id")


@query("replace_on_disk", _REPLACED, "chunk")
def replace_on_disk(c: Corpus) -> DataFrame:
    """The same in place, in a table of 16 folders."""
    old, new, keys = _replacement(c)
    path = f"{shared_dir(c.spark)}/lectern-replaced-{uuid.uuid4().hex}"
    catalog.write_bucketed(old, path, "doc_id", 16)
    return catalog.replace_on_disk(path, new, keys, "doc_id", 16)


@query("upsert_by_key", """
    SELECT coalesce(n.resource_id, o.resource_id) AS resource_id, coalesce(o.first_seen, n.updated_at) AS first_seen, coalesce(n.updated_at, o.first_seen) AS updated_at
    FROM (SELECT resource_id, updated_at AS first_seen FROM snap_old WHERE resource_id % 5 <> 0) o FULL JOIN (SELECT * FROM snap_new WHERE resource_id % 7 <> 0) n ON n.resource_id = o.resource_id""", "snap_old", "snap_new")
def upsert_by_key(c: Corpus) -> DataFrame:
    old = c.snap_old.filter("resource_id % 5 <> 0").select("resource_id", _C("updated_at").alias("first_seen"), "updated_at")
    new = c.snap_new.filter("resource_id % 7 <> 0").select("resource_id", _C("updated_at").alias("first_seen"), "updated_at")
    return catalog.upsert(old, new, "resource_id", immutable=["first_seen"])


@query("course_snapshot", """
    WITH own AS (SELECT * FROM resource WHERE course_id = 'de'), kids AS (SELECT chunk.* FROM chunk JOIN own ON doc_id = resource_id)
    SELECT 'semester' AS tab, CAST(semester_id AS VARCHAR) AS key, 0 AS lost FROM course WHERE course_id = 'de'
    UNION ALL SELECT 'course', c.course_id, CAST(s.semester_id IS NULL AS INTEGER) FROM course c LEFT JOIN semester s ON s.semester_id = c.semester_id WHERE course_id = 'de'
    UNION ALL SELECT 'week', w.week_id, CAST(c.course_id IS NULL AS INTEGER) FROM week w LEFT JOIN course c ON c.course_id = w.course_id WHERE w.course_id = 'de'
    UNION ALL SELECT 'resource', CAST(resource_id AS VARCHAR), CAST(w.week_id IS NULL AS INTEGER) FROM own r LEFT JOIN week w ON w.week_id = r.week_id AND w.course_id = 'de'
    UNION ALL SELECT 'chunk', CAST(chunk_id AS VARCHAR), 0 FROM kids
    UNION ALL SELECT 'vector', CAST(v.chunk_id AS VARCHAR), 0 FROM chunk_vec v JOIN kids k ON k.chunk_id = v.chunk_id""", "semester", "course", "week", "resource", "chunk", "chunk_vec")
def course_snapshot(c: Corpus) -> DataFrame:
    """All rows of one course; lost: a row's parent is not among them."""
    tables = {"semester": c.semester, "course": c.course, "week": c.week, "resource": c.resource, "chunk": c.chunk.withColumnRenamed("doc_id", "resource_id"), "vector": c.chunk_vec}
    own = catalog.course_closure(tables, "de")
    keys = {n: t.select(F.lit(n).alias("tab"), _C("chunk_id" if n == "vector" else f"{n}_id").cast("string").alias("key"), *([_C(catalog.PARENTS[n][1]).cast("string")] if n in catalog.PARENTS and n != "vector" else [])) for n, t in own.items()}
    lost = catalog.lost_rows(own).distinct().withColumn("lost", F.lit(1))
    out = None
    for n, t in keys.items():
        parent = t.columns[2] if len(t.columns) > 2 else "key"
        gone = lost.select(_C("tab").alias("_t"), _C("key").alias("_k"), "lost")
        made = t.join(gone, (_C("tab") == _C("_t")) & (_C(parent) == _C("_k")), "left").select("tab", "key", F.coalesce("lost", F.lit(0)).alias("lost"))
        out = made if out is None else out.unionByName(made)
    return out


@query("report_sink", "SELECT course_id, count(*) AS resources FROM resource GROUP BY 1", "resource")
def report_sink(c: Corpus) -> DataFrame:
    """Writes the report to a new folder of the shared place, where an existing one is an error, and reads it."""
    report = c.resource.groupBy("course_id").agg(F.count(F.lit(1)).alias("resources"))
    return catalog.write_report(report)


_SCOPE = """CASE WHEN doc_id % 9 = 0 THEN 'term not mapped' WHEN doc_id % 9 = 1 THEN 'conflicting term' WHEN doc_id % 4 <> 1 THEN 'different term' WHEN doc_id % 6 = 5 THEN 'inactive' WHEN doc_id % 10 = 7 THEN 'restricted' END"""


@query("scope_exclusion", f"SELECT reason, count(*) AS n FROM (SELECT {_SCOPE} AS reason FROM documents) GROUP BY 1")
def scope_exclusion(c: Corpus) -> DataFrame:
    courses = c.documents.select(
        "doc_id", F.when(_C("doc_id") % 9 != 0, _C("doc_id") % 4).alias("term_id"), F.when(_C("doc_id") % 9 == 1, -1).otherwise(_C("doc_id") % 4).alias("declared_term"),
        (_C("doc_id") % 6 != 5).alias("active"), (_C("doc_id") % 10 == 7).alias("restricted"),
    )
    return courses.select(sync.exclusion(F.lit(1)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("active_scope", "SELECT resource_id, r.course_id FROM resource r JOIN course c ON c.course_id = r.course_id JOIN semester s ON s.semester_id = c.semester_id WHERE is_active", "resource", "course", "semester")
def active_scope(c: Corpus) -> DataFrame:
    return c.resource.join(catalog.active_courses(c.course, c.semester), "course_id", "left_semi").select("resource_id", "course_id")


@query("request_scope", """
    SELECT resource_id, false AS missing FROM resource WHERE (course_id = 'en' AND week_id = 'src1') OR course_id = 'es' OR (course_id = 'de' AND week_id = 'src2' AND resource_id = -1)
    UNION ALL SELECT -1, true""", "resource")
def request_scope(c: Corpus) -> DataFrame:
    scope = c.spark.createDataFrame([("en", "src1", None), ("es", None, None), ("de", "src2", -1)], "course string, week string, file long")
    return sync.in_scope(c.resource, scope)


@query("course_stats", "SELECT course_id, count(DISTINCT resource_id) AS resources, count(chunk_id) AS chunks FROM resource LEFT JOIN chunk ON doc_id = resource_id GROUP BY 1", "resource", "chunk")
def course_stats(c: Corpus) -> DataFrame:
    return c.resource.join(c.chunk, _C("doc_id") == _C("resource_id"), "left").groupBy("course_id").agg(F.countDistinct("resource_id").alias("resources"), F.count("chunk_id").alias("chunks"))


@query("week_health", "SELECT course_id, week_id, count(*) AS resources, count(*) FILTER (WHERE h.status = 'review') AS needing_review, count(*) FILTER (WHERE path IS NULL) AS unavailable FROM resource JOIN report h ON doc_id = resource_id GROUP BY ALL", "resource", "report")
def week_health(c: Corpus) -> DataFrame:
    report = health.report(c).select("doc_id", _C("status").alias("health"))
    joined = c.resource.join(report, _C("resource_id") == _C("doc_id"))
    return joined.groupBy("course_id", "week_id").agg(F.count(F.lit(1)).alias("resources"), F.count_if(_C("health") == "review").alias("needing_review"), F.count_if(_C("path").isNull()).alias("unavailable"))


@query("dashboard_cards", """
    SELECT c.course_id, w.modules, w.last_module, coalesce(r.parsed, 0) AS parsed, coalesce(r.current_knowledge, 0) AS current_knowledge
    FROM course c JOIN semester s ON s.semester_id = c.semester_id AND is_active
    LEFT JOIN (SELECT course_id, count(*) AS modules, first(title ORDER BY week_number DESC NULLS LAST, title DESC) AS last_module FROM week GROUP BY 1) w ON w.course_id = c.course_id
    LEFT JOIN (SELECT course_id, count(*) FILTER (WHERE status IN ('parsed', 'completed')) AS parsed, count(k.resource_id) AS current_knowledge FROM resource r LEFT JOIN knowledge k ON k.resource_id = r.resource_id AND k.revision = r.revision GROUP BY 1) r ON r.course_id = c.course_id""", "course", "semester", "week", "resource", "knowledge")
def dashboard_cards(c: Corpus) -> DataFrame:
    """Courses of the active semester by code: modules, the last one, parsed resources and those whose
    knowledge is of the present revision."""
    known = c.knowledge.select("resource_id", "revision", F.lit(1).alias("known"))
    counts = c.resource.join(known, ["resource_id", "revision"], "left").groupBy("course_id").agg(F.count_if(_C("status").isin("parsed", "completed")).alias("parsed"), F.count("known").alias("current_knowledge"))
    modules = c.week.groupBy("course_id").agg(F.count(F.lit(1)).alias("modules"), F.max_by("title", F.struct("week_number", "title")).alias("last_module"))
    cards = catalog.active_courses(c.course, c.semester).join(modules, "course_id", "left").join(counts, "course_id", "left")
    return cards.select("course_id", "modules", "last_module", F.coalesce("parsed", F.lit(0).cast("long")).alias("parsed"), F.coalesce("current_knowledge", F.lit(0).cast("long")).alias("current_knowledge")).orderBy("course_id")


# Runs: a user is one, and each event a stage and outcome.
_STAGE = "CASE event_type WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'page' WHEN event_id % 5 = 1 THEN 'link' ELSE 'discovery' END WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'parse' ELSE 'download' END WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'knowledge' ELSE 'download' END WHEN 'signup' THEN 'skip' ELSE 'error' END"
_OUTCOME = "CASE event_type WHEN 'view' THEN CASE WHEN event_id % 5 = 1 AND event_id % 2 = 0 THEN 'unsupported' WHEN event_id % 5 = 2 THEN 'page_linked_file' ELSE 'file' END WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'parsed' ELSE 'downloaded' END WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'analyzed' ELSE 'updated' END WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'ignored_reading_material' WHEN event_id % 3 = 1 THEN 'unsupported' END END"
_RUNS = f"runs AS (SELECT user_id AS run_id, ts, {_STAGE} AS stage, {_OUTCOME} AS outcome FROM events)"


def _runs(c: Corpus) -> DataFrame:
    return c.table("events").select(_C("user_id").alias("run_id"), "ts", F.expr(_STAGE).alias("stage"), F.expr(_OUTCOME).alias("outcome"))


_COUNTED = """SELECT run_id, count(*) FILTER (WHERE stage = 'discovery') AS discovered, count(*) FILTER (WHERE stage = 'download') AS downloaded, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE stage = 'skip') AS skipped, count(*) FILTER (WHERE stage = 'error') AS failed,
    count(*) FILTER (WHERE stage = 'parse') AS files_parsed, count(*) FILTER (WHERE stage = 'knowledge') AS files_analyzed, count(*) FILTER (WHERE stage = 'page') AS pages_inspected, count(*) FILTER (WHERE stage = 'link') AS page_links_found, count(*) FILTER (WHERE outcome = 'page_linked_file') AS page_linked_files,
    count(*) FILTER (WHERE stage = 'link' AND outcome = 'unsupported') AS page_links_unsupported, count(*) FILTER (WHERE outcome = 'ignored_reading_material') AS ignored_readings, count(*) FILTER (WHERE stage = 'skip' AND outcome = 'unsupported') AS unsupported FROM runs GROUP BY 1"""


@query("sync_counters", f"WITH {_RUNS} SELECT *, CASE WHEN failed > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM ({_COUNTED})")
def sync_counters(c: Corpus) -> DataFrame:
    return sync.counters(_runs(c))


@query("token_usage", "SELECT user_id AS run_id, count(*) AS requests, count(*) FILTER (WHERE TRY_CAST(json_extract(props, '$.k') AS BIGINT) IS NOT NULL) AS with_usage, CAST(sum(TRY_CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1")
def token_usage(c: Corpus) -> DataFrame:
    used = c.table("events").select(_C("user_id").alias("run_id"), F.from_json("props", "k long")["k"].alias("k"))
    return used.groupBy("run_id").agg(F.count(F.lit(1)).alias("requests"), F.count("k").alias("with_usage"), F.sum("k").alias("tokens"))


@query("run_progress", f"""
    WITH {_RUNS} SELECT k.run_id, least(discovered, downloaded + skipped + failed) AS settled, CAST(floor(100 * least(discovered, downloaded + skipped + failed) / discovered) AS BIGINT) AS percent, greatest(discovered - downloaded - skipped - failed, 0) AS remaining, greatest(downloaded - updated, 0) AS new_downloads, seconds
    FROM ({_COUNTED}) k JOIN (SELECT run_id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS seconds FROM runs GROUP BY 1) t ON t.run_id = k.run_id WHERE discovered > 0""")
def run_progress(c: Corpus) -> DataFrame:
    return sync.progress(_runs(c))


@query("latest_run", "SELECT user_id AS run_id, arg_max(event_id, ts) AS latest, arg_max(event_id, CASE WHEN event_type = 'view' THEN ts END) AS latest_running FROM events GROUP BY 1")
def latest_run(c: Corpus) -> DataFrame:
    return c.table("events").groupBy(_C("user_id").alias("run_id")).agg(F.max_by("event_id", "ts").alias("latest"), F.max_by("event_id", F.when(_C("event_type") == "view", _C("ts"))).alias("latest_running"))


_EVIDENCE = "array('title', concat('p', page_id % 4))"


@query("first_discovery", """
    SELECT page_id, key, times, linked, title, evidence FROM (SELECT page_id, href AS key, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS n FROM link)
    JOIN (SELECT href, count(*) AS times, bool_or(page_id % 3 = 0) AS linked, arg_min(link_text, page_id * 100000 + pos) FILTER (WHERE page_id % 2 = 1) AS title, array_to_string(list_sort(list_distinct(list_concat(['title'], list(concat('p', page_id % 4))))), ',') AS evidence FROM link GROUP BY 1) a ON a.href = key WHERE n = 1""", "link")
def first_discovery(c: Corpus) -> DataFrame:
    """Every second page gives no title, every third is linked from a page."""
    met = c.link.select(_C("href").alias("key"), "page_id", "pos", (_C("page_id") % 3 == 0).alias("linked"), F.when(_C("page_id") % 2 == 1, _C("link_text")).otherwise("").alias("title"), F.expr(_EVIDENCE).alias("evidence"))
    return sync.first_discovery(met).select("page_id", "key", "times", "linked", "title", F.array_join("evidence", ",").alias("evidence"))


_WEEKS = "SELECT DISTINCT lang AS course_id, source AS title, CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) AS pos, CASE WHEN CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 3 > 0 THEN CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 5 + 1 END AS parsed FROM documents"


@query("next_week_number", f"""
    WITH w AS ({_WEEKS}), f AS (SELECT *, CASE WHEN parsed IS NOT NULL AND row_number() OVER (PARTITION BY course_id, parsed ORDER BY pos) = 1 THEN parsed END AS own FROM w)
    SELECT course_id, title, CAST(coalesce(own, coalesce(max(own) OVER (PARTITION BY course_id), 0) + row_number() OVER (PARTITION BY course_id, own IS NULL ORDER BY pos)) AS INTEGER) AS week_number FROM f""")
def next_week_number(c: Corpus) -> DataFrame:
    weeks = c.sql(_WEEKS.replace("documents", "{documents}").replace("\\d", "[0-9]"), documents=c.documents)
    return sync.number_weeks(weeks).select("course_id", "title", "week_number")


@query("week_adoption", f"""
    WITH w AS ({_WEEKS}), old AS (SELECT course_id, pos AS week, title, pos + 1 AS number, CASE WHEN pos % 2 = 0 THEN pos END AS module_id FROM w WHERE pos % 4 <> 3)
    SELECT w.course_id, w.pos AS module_id, coalesce(m.week, CASE WHEN t.n = 1 THEN t.week END, CASE WHEN k.n = 1 THEN k.week END) AS week,
           CASE WHEN m.week IS NOT NULL THEN 'module' WHEN t.n = 1 THEN 'title' WHEN k.n = 1 THEN 'number' ELSE 'create' END AS how
    FROM w LEFT JOIN (SELECT course_id, module_id, min(week) AS week FROM old WHERE module_id IS NOT NULL GROUP BY ALL) m ON m.course_id = w.course_id AND m.module_id = w.pos
    LEFT JOIN (SELECT course_id, title, min(week) AS week, count(*) AS n FROM old WHERE module_id IS NULL GROUP BY ALL) t ON t.course_id = w.course_id AND t.title = w.title
    LEFT JOIN (SELECT course_id, number, min(week) AS week, count(*) AS n FROM old WHERE module_id IS NULL GROUP BY ALL) k ON k.course_id = w.course_id AND k.number = w.parsed""")
def week_adoption(c: Corpus) -> DataFrame:
    weeks = c.sql(_WEEKS.replace("documents", "{documents}").replace("\\d", "[0-9]"), documents=c.documents)
    old = weeks.filter("pos % 4 <> 3").select("course_id", _C("pos").alias("week"), "title", (_C("pos") + 1).alias("number"), F.when(_C("pos") % 2 == 0, _C("pos")).alias("module_id"))
    return sync.adopt_weeks(weeks.select("course_id", _C("pos").alias("module_id"), "title", _C("parsed").alias("number")), old)


@query("identity_conflicts", "SELECT 'href' AS kind, href AS value, count(DISTINCT page_id) AS n FROM link GROUP BY href HAVING count(DISTINCT page_id) > 1 UNION ALL SELECT 'path', path, count(*) FROM resource WHERE path IS NOT NULL GROUP BY path HAVING count(*) > 1", "link", "resource")
def identity_conflicts(c: Corpus) -> DataFrame:
    return sync.conflicts(c.link, "href", "page_id", "href").unionByName(sync.conflicts(c.resource, "path", "resource_id", "path"))


@query("change_class", """
    SELECT coalesce(o.resource_id, n.resource_id) AS resource_id, CASE WHEN n.resource_id IS NULL THEN 'MISSING' WHEN n.resource_id % 10 = 1 THEN CASE WHEN o.resource_id IS NULL THEN 'NEW' WHEN n.resource_id % 20 = 1 THEN 'UNCHANGED' ELSE 'UPDATED' END
        WHEN n.resource_id % 10 = 2 THEN 'ERROR' WHEN o.resource_id IS NULL THEN 'NEW' WHEN o.resource_id % 10 = 3 OR n.updated_at > o.updated_at THEN 'UPDATED' ELSE 'UNCHANGED' END AS change
    FROM (SELECT * FROM snap_old WHERE resource_id % 9 <> 0) o FULL JOIN (SELECT * FROM snap_new WHERE resource_id % 7 <> 0) n ON o.resource_id = n.resource_id""", "snap_old", "snap_new")
def change_class(c: Corpus) -> DataFrame:
    """Some are external and have revisions, some have no new or no stored time."""
    k = _C("resource_id")
    timed = lambda df, lost: df.withColumn("updated_at", F.when(k % 10 != lost, _C("updated_at")))
    old = timed(c.snap_old, 3).filter(k % 9 != 0).withColumn("revision", F.when(k % 20 == 1, "a").when(k % 20 == 11, "b"))
    new = timed(c.snap_new, 2).filter(k % 7 != 0).withColumn("revision", F.when(k % 10 == 1, "a"))
    return sync.change_class(old, new).select("resource_id", "change")


@query("resume_stage", """
    SELECT resource_id, CASE WHEN resource_id % 13 = 0 THEN 'error' WHEN c = 'UNCHANGED' AND status IN ('completed', 'unsupported') THEN 'skip' WHEN c = 'NEW' THEN 'download' WHEN c = 'UPDATED' THEN 'download+invalidate'
           WHEN s = 'done' THEN 'knowledge' WHEN s = 'parse' AND filename LIKE '%.PPTX' THEN 'unsupported' WHEN s IS NOT NULL THEN s WHEN status = 'parsed' THEN 'knowledge' ELSE 'download' END AS action
    FROM (SELECT *, CASE resource_id % 3 WHEN 0 THEN 'UNCHANGED' WHEN 1 THEN 'NEW' ELSE 'UPDATED' END AS c, CASE (resource_id // 3) % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'parse' WHEN 2 THEN 'parse' WHEN 3 THEN stage END AS s FROM resource)""", "resource")
def resume_stage(c: Corpus) -> DataFrame:
    change = F.expr("CASE resource_id % 3 WHEN 0 THEN 'UNCHANGED' WHEN 1 THEN 'NEW' ELSE 'UPDATED' END")
    stage = F.expr("CASE floor(resource_id / 3) % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'parse' WHEN 2 THEN 'parse' WHEN 3 THEN stage END")
    return c.resource.select("resource_id", sync.next_action(_C("resource_id") % 13 == 0, change, _C("status"), stage, text_functions.file_type(_C("filename"))).alias("action"))


@query("report_freshness", """
    SELECT resource_id, CASE WHEN filename LIKE '%.PPTX' THEN 'unsupported' WHEN resource_id % 4 = 3 THEN 'unavailable' WHEN resource_id % 8 = 1 THEN 'unknown' WHEN resource_id % 8 = 2 THEN 'stale' ELSE 'healthy' END AS status FROM resource""", "resource")
def report_freshness(c: Corpus) -> DataFrame:
    resources = c.resource.select("resource_id", F.lower(F.regexp_extract("filename", r"(\.[^.]+)$", 1)).alias("file_type"), _C("revision").alias("fingerprint"))
    stored = F.when(_C("resource_id") % 8 == 1, None).when(_C("resource_id") % 8 == 2, "old").otherwise(_C("revision"))
    empty = F.array().cast("array<struct<page_number:int,code:string>>")
    reports = c.resource.filter("resource_id % 4 <> 3").select("resource_id", stored.alias("fingerprint"), F.lit("healthy").alias("status"), empty.alias("issues"), F.lit(1).alias("pages"))
    return pages.report_freshness(resources, reports).select("resource_id", "status")


@query("health_refresh_counts", """
    SELECT r.course_id, count(*) AS reviewed, count(*) FILTER (WHERE state = 'healthy') AS healthy, count(*) FILTER (WHERE state = 'review') AS needs_review, count(*) FILTER (WHERE state = 'unable') AS unable
    FROM (SELECT resource_id, course_id, CASE WHEN path IS NULL OR lower(filename) NOT LIKE '%.pdf' THEN 'unable' ELSE h.status END AS state FROM resource JOIN report h ON doc_id = resource_id) r
    JOIN course c ON c.course_id = r.course_id JOIN semester s ON s.semester_id = c.semester_id WHERE is_active GROUP BY 1""", "resource", "report", "course", "semester")
def health_refresh_counts(c: Corpus) -> DataFrame:
    active = c.resource.join(catalog.active_courses(c.course, c.semester), "course_id", "left_semi")
    return pages.refresh_counts(active.withColumn("pdf", F.lower("filename").endswith(".pdf")), health.report(c).withColumnRenamed("doc_id", "resource_id"), ["course_id"])


@query("reading_skip", "SELECT page_id, pos, href FROM link WHERE NOT regexp_matches(lower(link_text), 'the')", "link")
def reading_skip(c: Corpus) -> DataFrame:
    kinds = c.link.withColumn("kind", F.when(F.lower("link_text").contains("the"), "READING").otherwise("UNKNOWN"))
    return sync.skip_readings(kinds).select("page_id", "pos", "href")
