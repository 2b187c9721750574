"""Queries of the vector index, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text, vectors
from lectern.operators import classify, embed, evaluate, index, pages, retrieval
from lectern.plans import health, material_queries, oracle, text_queries
from lectern.plans.registry import query
from lectern.sources.corpus import Corpus
from lectern.sources.scratch import sent, written

_C = F.col
_MODEL, _VERSION, _DIMENSIONS = "m1", "v1", 64
_USABLE = "length(trim(text)) > 0 AND (status IN ('parsed', 'completed') OR (status = 'failed' AND stage = 'knowledge'))"
_SOURCE = "sha256(CAST(json_object('n_chars', d.n_chars, 'resource_id', d.doc_id, 'week_id', d.source) AS VARCHAR))"
_CURRENT = f"SELECT d.doc_id AS chunk_id, course_id, sha256(text) AS content_hash, {_SOURCE} AS source_hash, {_USABLE} AS usable FROM documents d JOIN resource ON doc_id = resource_id"
_INDEX = f"""
    SELECT doc_id AS chunk_id, 'm1' AS model, CASE WHEN doc_id % 19 = 0 THEN 'v0' ELSE 'v1' END AS model_version, CASE WHEN doc_id % 29 = 0 THEN 32 ELSE 64 END AS dimensions, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, 'x') ELSE text END) AS content_hash, {_SOURCE} AS source_hash, doc_id % 23 <> 0 AS valid FROM documents d WHERE doc_id % 10 <> 0
    UNION ALL SELECT doc_id + 1000000, 'm1', 'v1', 64, sha256(text), {_SOURCE}, true FROM documents d WHERE doc_id % 50 = 0"""
oracle.VIEWS["current"], oracle.VIEWS["idx"] = _CURRENT, _INDEX
oracle._NEEDS["current"] = ["resource"]
def _pooled(k: str, x: str, t: str, d: int, window: int = 480) -> str:
    """k, b, v: the built-in embedder over the texts x of a table t, entry b of each unit vector, in windows of words."""
    words = f"SELECT {k}, w, (i - 1) // {window} AS win FROM (SELECT {k}, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT {k}, list_filter(string_split({oracle.normalized(x)}, ' '), lambda w: w <> '') AS ws FROM {t}))"
    counts = f"SELECT {k}, win, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {d} AS b, CAST(count(*) AS DOUBLE) AS n FROM ({words}) GROUP BY ALL"
    sums = f"SELECT {k}, b, sum(n * size / z) AS s FROM (SELECT {k}, win, b, n, sum(n) OVER (PARTITION BY {k}, win) AS size, sqrt(sum(n * n) OVER (PARTITION BY {k}, win)) AS z FROM ({counts})) GROUP BY ALL"
    return f"SELECT {k}, b, s / sqrt(sum(s * s) OVER (PARTITION BY {k})) AS v FROM ({sums})"


_DIFF = """
    SELECT coalesce(c.chunk_id, i.chunk_id) AS chunk_id, course_id, CASE WHEN c.chunk_id IS NULL THEN 'removed' WHEN NOT usable THEN CASE WHEN i.chunk_id IS NULL THEN 'unusable' ELSE 'removed' END WHEN i.chunk_id IS NULL THEN 'new'
        WHEN model = 'm1' AND model_version = 'v1' AND dimensions = 64 AND c.content_hash = i.content_hash AND c.source_hash = i.source_hash AND valid THEN 'skipped' ELSE 'updated' END AS action
    FROM current c FULL JOIN idx i ON c.chunk_id = i.chunk_id"""
oracle.VIEWS["diff"] = _DIFF
oracle._NEEDS["diff"] = ["current", "idx"]


def _current(c: Corpus) -> DataFrame:
    d = c.documents.join(c.resource.drop("n_chars"), _C("doc_id") == _C("resource_id"))
    source = F.sha2(text.canonical_json(n_chars=_C("n_chars"), resource_id=_C("doc_id"), week_id=_C("source")), 256)
    return d.select(_C("doc_id").alias("chunk_id"), "course_id", F.sha2("text", 256).alias("content_hash"), source.alias("source_hash"), retrieval.usable(_C("text"), _C("status"), _C("stage")).alias("usable"))


def _index(c: Corpus) -> DataFrame:
    source = F.sha2(text.canonical_json(n_chars=_C("n_chars"), resource_id=_C("doc_id"), week_id=_C("source")), 256)
    old = F.when(_C("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(_C("text"))
    known = c.documents.filter("doc_id % 10 <> 0").select(_C("doc_id").alias("chunk_id"), F.lit(_MODEL).alias("model"), F.when(_C("doc_id") % 19 == 0, "v0").otherwise(_VERSION).alias("model_version"), F.when(_C("doc_id") % 29 == 0, 32).otherwise(_DIMENSIONS).alias("dimensions"), F.sha2(old, 256).alias("content_hash"), source.alias("source_hash"), (_C("doc_id") % 23 != 0).alias("valid"))
    gone = c.documents.filter("doc_id % 50 = 0").select((_C("doc_id") + 1_000_000).alias("chunk_id"), F.lit(_MODEL).alias("model"), F.lit(_VERSION).alias("model_version"), F.lit(_DIMENSIONS).alias("dimensions"), F.sha2("text", 256).alias("content_hash"), source.alias("source_hash"), F.lit(True).alias("valid"))
    return known.unionByName(gone)


def _diff(c: Corpus) -> DataFrame:
    return index.index_diff(_current(c), _index(c), _MODEL, _VERSION, _DIMENSIONS)


@query("usable_chunks", "SELECT chunk_id FROM current WHERE usable", "current")
def usable_chunks(c: Corpus) -> DataFrame:
    return _current(c).filter("usable").select("chunk_id")


@query("current_vectors", "SELECT chunk_id FROM diff WHERE action = 'skipped'", "diff")
def current_vectors(c: Corpus) -> DataFrame:
    return _diff(c).filter("action = 'skipped'").select("chunk_id")


@query("role_filter", "SELECT chunk_id FROM current JOIN resource ON resource_id = chunk_id WHERE usable AND role IN ('lecture', 'tutorial')", "current", "resource")
def role_filter(c: Corpus) -> DataFrame:
    roles = c.resource.filter(_C("role").isin("lecture", "tutorial")).select(_C("resource_id").alias("chunk_id"))
    return _current(c).filter("usable").join(roles, "chunk_id", "left_semi").select("chunk_id")


@query("course_chunks", "SELECT course_id, week_id, resource_id, chunk_id FROM chunk JOIN resource ON resource_id = doc_id WHERE course_id = 'fr'", "chunk", "resource")
def course_chunks(c: Corpus) -> DataFrame:
    return c.chunk.join(c.resource.filter("course_id = 'fr'"), _C("doc_id") == _C("resource_id")).select("course_id", "week_id", "resource_id", "chunk_id")


@query("index_join", "SELECT c.chunk_id, i.chunk_id IS NOT NULL AS indexed, coalesce(i.content_hash = c.content_hash, false) AS same FROM current c LEFT JOIN idx i ON i.chunk_id = c.chunk_id", "current", "idx")
def index_join(c: Corpus) -> DataFrame:
    cur, idx = _current(c).alias("c"), _index(c).alias("i")
    return cur.join(idx, _C("c.chunk_id") == _C("i.chunk_id"), "left").select("c.chunk_id", _C("i.chunk_id").isNotNull().alias("indexed"), F.coalesce(_C("i.content_hash") == _C("c.content_hash"), F.lit(False)).alias("same"))


@query("orphan_vectors", "SELECT i.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'gone' ELSE 'unusable' END AS why FROM idx i LEFT JOIN current c ON i.chunk_id = c.chunk_id WHERE c.chunk_id IS NULL OR NOT c.usable", "current", "idx")
def orphan_vectors(c: Corpus) -> DataFrame:
    return index.orphans(_current(c), _index(c))


@query("index_diff", "SELECT chunk_id, course_id, action FROM diff", "diff")
def index_diff(c: Corpus) -> DataFrame:
    return _diff(c)


@query("index_apply", f"""
    WITH plan AS (SELECT c.*, c.chunk_id // 64 AS batch FROM current c JOIN diff d ON d.chunk_id = c.chunk_id WHERE action IN ('new', 'updated')),
    refused AS (SELECT DISTINCT course_id, batch FROM plan WHERE chunk_id % 31 = 5),
    marked AS (SELECT plan.*, refused.batch IS NOT NULL AS refused FROM plan LEFT JOIN refused ON refused.batch = plan.batch AND refused.course_id IS NOT DISTINCT FROM plan.course_id),
    made AS (SELECT doc_id, round(sum(v), 6) AS words, round(sum(v * (b + 1)), 6) AS weighted FROM ({_pooled('doc_id', 'text', 'documents', 64)}) GROUP BY 1)
    SELECT i.chunk_id, i.content_hash, i.valid, CAST(i.chunk_id - 1 AS DOUBLE) AS words, CAST(2 * i.chunk_id - 1 AS DOUBLE) AS weighted FROM idx i JOIN diff d ON d.chunk_id = i.chunk_id LEFT JOIN marked m ON m.chunk_id = i.chunk_id WHERE action = 'skipped' OR refused
    UNION ALL SELECT chunk_id, content_hash, words IS NOT NULL, coalesce(words, 0), coalesce(weighted, 0) FROM marked LEFT JOIN made ON doc_id = chunk_id WHERE NOT refused""", "diff")
def index_apply(c: Corpus) -> DataFrame:
    """Stored vectors are (-1, chunk_id), so that kept ones are told from new ones; every 31st document changes while
    the others are embedded."""
    current, diff = _current(c), _diff(c)
    plan = index.planned(current, diff)
    wanted = c.documents.select(_C("doc_id").alias("chunk_id"), "text").join(plan.select("chunk_id"), "chunk_id", "left_semi")
    made = embed.embed_words(wanted, "chunk_id", text.normalize_words(_C("text")), 64)
    live = current.withColumn("content_hash", F.when(_C("chunk_id") % 31 == 5, "changed").otherwise(_C("content_hash")))
    stored = _index(c).withColumn("embedding", F.array(F.lit(-1.0), _C("chunk_id").cast("double")))
    new = index.index_apply(stored, diff, plan, made, live, _MODEL, _VERSION, _DIMENSIONS)
    total = lambda weight: F.aggregate(F.transform("embedding", weight), F.lit(0.0), lambda a, x: a + x)
    return new.select("chunk_id", "content_hash", "valid", F.round(F.coalesce(total(lambda x: x), F.lit(0.0)), 6).alias("words"), F.round(F.coalesce(total(lambda x, i: x * (i + 1)), F.lit(0.0)), 6).alias("weighted"))


_STATS = "SELECT course_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE action = '{a}') AS {a}" for a in ("new", "updated", "skipped", "removed", "unusable")) + " FROM diff GROUP BY 1"


@query("index_stats", _STATS, "diff")
def index_stats(c: Corpus) -> DataFrame:
    return index.index_stats(_diff(c))


# Of the last indexing of courses: 'fr' still runs, 'es' failed, 'de' was ready.
_STORED = "CASE course_id WHEN 'fr' THEN 'indexing' WHEN 'es' THEN 'error' WHEN 'de' THEN 'ready' END"
_STATUS = f"""SELECT *, usable - compatible AS missing, CASE WHEN {_STORED} IN ('indexing', 'error') THEN {_STORED} WHEN usable = 0 THEN 'unavailable' WHEN usable = compatible THEN 'ready' ELSE 'stale' END AS state FROM (
    SELECT course_id, count(*) FILTER (WHERE action IN ('new', 'updated', 'skipped')) AS usable, count(*) FILTER (WHERE action = 'skipped') AS compatible FROM diff WHERE course_id IS NOT NULL GROUP BY 1)"""


@query("index_status", _STATUS, "diff")
def index_status(c: Corpus) -> DataFrame:
    return index.index_status(_diff(c), _reports(c))


def _reports(c: Corpus) -> DataFrame:
    return c.course.select("course_id", F.expr(_STORED).alias("stored")).filter("stored IS NOT NULL")


@query("backfill_summary", f"""
    WITH st AS ({_STATUS}), s AS ({_STATS}) SELECT count(*) AS courses, count(*) FILTER (WHERE usable > 0 AND usable = compatible) AS ready_before, count(*) FILTER (WHERE usable > 0 AND s.course_id <> 'es') AS ready_after,
        CAST(sum(CASE WHEN s.course_id = 'es' THEN 0 ELSE s.new END) AS BIGINT) AS newly_indexed, CAST(sum(CASE WHEN s.course_id = 'es' THEN 0 ELSE s.updated END) AS BIGINT) AS stale_updated, count(*) FILTER (WHERE usable = 0) AS unavailable, count(*) FILTER (WHERE s.course_id = 'es') AS errors
    FROM s JOIN st ON s.course_id = st.course_id""", "diff")
def backfill_summary(c: Corpus) -> DataFrame:
    """Over all courses, of which the indexing of 'es' fails."""
    return index.fleet_summary(_diff(c), c.course.filter("course_id = 'es'").select("course_id"))


@query("readiness_gate", f"WITH st AS ({_STATUS}) SELECT item_id, expected, CASE WHEN state = 'ready' THEN 'proceed' ELSE state END AS outcome FROM gold g JOIN st ON st.course_id = g.course_id", "diff", "gold")
def readiness_gate(c: Corpus) -> DataFrame:
    status = index.index_status(_diff(c), _reports(c)).select("course_id", "state")
    return c.gold.join(status, "course_id").select("item_id", "expected", F.when(_C("state") == "ready", "proceed").otherwise(_C("state")).alias("outcome"))


@query("source_recheck", "SELECT i.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'gone' ELSE 'content_hash' END AS changed FROM idx i LEFT JOIN current c ON c.chunk_id = i.chunk_id WHERE c.chunk_id IS NULL OR c.content_hash <> i.content_hash", "current", "idx")
def source_recheck(c: Corpus) -> DataFrame:
    return index.recheck(_index(c), _current(c), ["content_hash", "source_hash"])


@query("hygiene_diagnostics", f"SELECT l.chunk_id, reason FROM ({text_queries._LOW}) l JOIN chunk k ON k.chunk_id = l.chunk_id JOIN resource ON resource_id = doc_id WHERE reason IS NOT NULL AND {_USABLE.replace('length(trim(text)) > 0 AND ', '')} AND role IN ('lecture', 'tutorial')", "chunk", "resource")
def hygiene_diagnostics(c: Corpus) -> DataFrame:
    """Covers and outlines among the chunks that a search for lectures and tutorials would look at."""
    own = c.resource.filter(_C("role").isin("lecture", "tutorial")).select(_C("resource_id").alias("doc_id"), "status", "stage")
    asked = text_queries.covered(c).join(own, "doc_id").filter(retrieval.usable(_C("content"), _C("status"), _C("stage")))
    return asked.select("chunk_id", text.low_information(_C("content")).alias("reason")).filter("reason IS NOT NULL")


_TOPK = """
    SELECT * FROM (SELECT q.chunk_id AS query_id, q.course_id, x.chunk_id, round(greatest(-1.0, least(1.0, list_cosine_similarity(q.embedding, x.embedding))), 6) AS score,
        CAST(row_number() OVER (PARTITION BY q.chunk_id ORDER BY round(list_cosine_similarity(q.embedding, x.embedding), 6) DESC, x.chunk_id) AS INTEGER) AS rank
    FROM vectors q JOIN vectors x ON q.course_id = x.course_id WHERE q.chunk_id % 100 = 0) WHERE rank <= {k}"""


def _queries(c: Corpus) -> DataFrame:
    return c.vectors.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


@query("topk_cosine", _TOPK.format(k=5), "vectors")
def topk_cosine(c: Corpus) -> DataFrame:
    return retrieval.top_k(_queries(c), c.vectors, 5)


@query("course_isolation", f"SELECT course_id, count(*) AS hits, count(DISTINCT query_id) AS queries FROM ({_TOPK.format(k=10)}) GROUP BY 1", "vectors")
def course_isolation(c: Corpus) -> DataFrame:
    return retrieval.top_k(_queries(c), c.vectors, 10).groupBy("course_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("query_id").alias("queries"))


def _embedded_sql(d: int, n: str = "") -> str:
    """hits: the five best searchable chunks of every question, by vectors of d dimensions; n tells two such apart."""
    asked = "" if n else f"""searched AS (SELECT k.*, course_id FROM chunk k JOIN resource ON resource_id = k.doc_id JOIN ({text_queries._LOW}) l ON l.chunk_id = k.chunk_id WHERE reason IS NULL AND {_USABLE.replace('length(trim(text)) > 0 AND ', '')}),
        asked AS (SELECT item_id, any_value(question) AS question, min(course_id) AS course_id, min(expected) AS expected FROM gold GROUP BY 1),"""
    return f"""{asked} cw{n} AS ({_pooled('chunk_id', 'content', 'searched', d)}), qw{n} AS ({_pooled('item_id', 'question', 'asked', d)}),
        scored{n} AS (SELECT a.item_id, cw.chunk_id, round(least(1.0, sum(cw.v * qw.v)), 6) AS score FROM asked a JOIN qw{n} qw ON qw.item_id = a.item_id JOIN searched k ON k.course_id = a.course_id JOIN cw{n} cw ON cw.chunk_id = k.chunk_id AND cw.b = qw.b GROUP BY 1, 2),
        hits{n} AS (SELECT h.*, k.doc_id, k.page_number, k.chunk_index, k.content, a.question, a.expected FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM scored{n}) h
            JOIN chunk k ON k.chunk_id = h.chunk_id JOIN asked a ON a.item_id = h.item_id WHERE rank <= 5)"""


_DISTINCT = lambda x: f"list_distinct(string_split({oracle.normalized(x)}, ' '))"
_HITS = _embedded_sql(64)
_RERANKED = f"{_HITS}, reranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY rerank_score DESC, rank) AS INTEGER) AS place FROM (SELECT *, CAST(len(list_intersect({_DISTINCT('question')}, {_DISTINCT('content')})) AS DOUBLE) AS rerank_score FROM hits))"
_RETRIEVAL_VIEWS = ("chunk", "resource", "gold")


def _asked(c: Corpus) -> DataFrame:
    """One row for each question: its course and expected document are the smallest where it is found."""
    return c.gold.groupBy("item_id").agg(F.any_value("question").alias("question"), F.min("course_id").alias("course_id"), F.min("expected").alias("expected"))


def searchable(c: Corpus) -> DataFrame:
    """Chunks that a search may find: not blank, of parsed resources, no covers and outlines."""
    told = c.course_chunk.filter(text.low_information(text_queries.shown()).isNull())
    return told.filter(retrieval.usable(_C("content"), _C("status"), _C("stage")))


def hits(c: Corpus, dimensions: int = 64) -> DataFrame:
    """The five best searchable chunks of every question, by the built-in embedder; searched once for a corpus."""
    if dimensions not in c.memo:
        asked = _asked(c)
        vector = lambda df, key, x: embed.embed_words(df, [key, "course_id"], text.normalize_words(_C(x)), dimensions)
        found = retrieval.top_k(vector(asked, "item_id", "question").withColumnRenamed("item_id", "query_id"), vector(searchable(c), "chunk_id", "content"), 5)
        named = written(found.withColumnRenamed("query_id", "item_id").drop("course_id"), "found")
        c.memo[dimensions] = written(c.chunk.join(sent(named), "chunk_id").join(asked.select("item_id", "question", "expected"), "item_id"), "hits")
    return c.memo[dimensions]


def reranked(c: Corpus) -> DataFrame:
    named = hits(c).withColumnRenamed("item_id", "query_id")
    return retrieval.rerank(named, retrieval.shared_words(_C("question"), _C("content"))).withColumnRenamed("query_id", "item_id")


def _summed(made: DataFrame, key: str) -> DataFrame:
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.select(key, F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("used"), F.round(weighted, 6).alias("weighted"))


@query("embed_corpus", f"SELECT chunk_id, count(*) AS used, round(sum(v * (b + 1)), 6) AS weighted FROM ({_pooled('chunk_id', 'content', 'chunk', 64)}) GROUP BY 1", "chunk")
def embed_corpus(c: Corpus) -> DataFrame:
    return _summed(embed.embed_words(c.chunk, "chunk_id", text.normalize_words(_C("content")), 64), "chunk_id")


@query("embed_windows", f"SELECT doc_id, count(*) AS used, round(sum(v * (b + 1)), 6) AS weighted FROM ({_pooled('doc_id', 'text', 'documents', 64)}) GROUP BY 1")
def embed_windows(c: Corpus) -> DataFrame:
    """Whole documents, in windows of 480 words."""
    return _summed(embed.embed_words(c.documents, "doc_id", text.normalize_words(_C("text")), 64), "doc_id")


@query("score_pairs", f"WITH {_RERANKED} SELECT item_id, chunk_id, rerank_score FROM reranked", *_RETRIEVAL_VIEWS)
def score_pairs(c: Corpus) -> DataFrame:
    return hits(c).select("item_id", "chunk_id", retrieval.shared_words(_C("question"), _C("content")).cast("double").alias("rerank_score"))


@query("rerank", f"WITH {_RERANKED} SELECT item_id, chunk_id, score, rank AS original_rank, place AS rank FROM reranked", *_RETRIEVAL_VIEWS)
def rerank(c: Corpus) -> DataFrame:
    return reranked(c).select("item_id", "chunk_id", "score", "original_rank", "rank")


@query("same_candidates", f"WITH {_RERANKED}, a AS (SELECT item_id, chunk_id FROM hits WHERE rank <= 3), b AS (SELECT item_id, chunk_id FROM reranked WHERE place <= 3) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b", *_RETRIEVAL_VIEWS)
def same_candidates(c: Corpus) -> DataFrame:
    """Of the three best by either score, as all five are the same."""
    return evaluate.same_rows(hits(c).filter("rank <= 3").select("item_id", "chunk_id"), reranked(c).filter("rank <= 3").select("item_id", "chunk_id"))


@query("post_rerank_scope", f"WITH {_RERANKED} SELECT item_id, chunk_id, place AS rank FROM reranked JOIN resource ON resource_id = doc_id WHERE week_id IN ('src0', 'src1', 'src2', 'src3')", *_RETRIEVAL_VIEWS)
def post_rerank_scope(c: Corpus) -> DataFrame:
    weeks = c.resource.filter(_C("week_id").isin("src0", "src1", "src2", "src3")).select(_C("resource_id").alias("doc_id"))
    return reranked(c).join(weeks, "doc_id", "left_semi").select("item_id", "chunk_id", "rank")


# Chunks below headings, so that exercises, neighbours and bridges occur: every third is an exercise, every
# fifth page has a heading of its own, all others share their document's.
_HEADING = "CASE WHEN chunk_index % 3 = 1 THEN 'Exercise 1 on the topic' WHEN page_number % 5 = 4 THEN 'Further notes' ELSE concat('Topic ', doc_id % 5) END"
_ASKED = "concat('Which topic? ', {})"
_MAY = "(status IN ('parsed', 'completed') OR (status = 'failed' AND stage = 'knowledge'))"
_LINE1 = lambda x: f"coalesce(({oracle.lines(x)})[1], '')"
_SHARED = lambda x, q: f"list_filter(list_intersect(regexp_extract_all(lower({_LINE1(x)}), '[a-z][a-z0-9]+'), regexp_extract_all(lower({q}), '[a-z][a-z0-9]+')), lambda w: NOT list_contains({'[' + ', '.join(repr(w) for w in text.STOP_WORDS) + ']'}, w))"
_HEAD = lambda x: f"CASE WHEN length({_LINE1(x)}) > 120 THEN '' ELSE regexp_replace(replace(lower({_LINE1(x)}), 'ß', 'ss'), '[\\s\\p{{Z}}]+', ' ', 'g') END"
_EXERCISE = lambda x, title: f"(NOT regexp_matches({x}, '(?im)^\\s*(?:worked\\s+)?(?:solution|answer)\\b') AND (regexp_matches({x}, '(?i)^\\s*(?:question|exercise|problem)\\s*\\d') OR (regexp_matches({title}, '(?i)assignment|homework|exercise') AND regexp_matches({x}, '(?i)\\b(?:calculate|determine|give an example|what is)\\b'))))"
_WORDS = lambda x: f"len(list_filter(string_split(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: regexp_full_match(w, '[A-Za-z]+'))) >= 25"
_CANDIDATES = f"cand AS (SELECT chunk_id, doc_id, page_number, chunk_index, content, {_WORDS('content')} AS body, {_HEAD('content')} AS heading FROM (SELECT chunk_id, doc_id, page_number, chunk_index, concat({_HEADING}, chr(10), content) AS content FROM chunk JOIN resource ON resource_id = doc_id WHERE {_MAY}))"
_PAIRS = f"""pairs AS (SELECT l.query_id, l.doc_id, l.place AS lp, r.place AS rp, k.page_number, k.chunk_index, k.chunk_id FROM chosen l JOIN chosen r ON r.query_id = l.query_id AND r.doc_id = l.doc_id AND r.heading = l.heading AND r.page_number - l.page_number BETWEEN 2 AND 3
        JOIN cand k ON k.doc_id = l.doc_id AND k.page_number > l.page_number AND k.page_number < r.page_number WHERE l.heading <> '' AND len(l.terms) > 0 AND k.heading = l.heading AND k.body AND NOT {_EXERCISE('k.content', 'l.title')})"""
#: The rule over `ranked`: query_id, question, rank, chunk_id, doc_id, page_number, content, title, role.
_SELECTED = f"""{_CANDIDATES}, m AS (SELECT *, {_EXERCISE('content', 'title')} AS prompt, {_SHARED('content', 'question')} AS terms, {_HEAD('content')} AS heading, {_WORDS('content')} AS body FROM ranked),
    m2 AS (SELECT *, NOT prompt AND body AND (role = 'lecture' OR len(terms) > 0) AS explains FROM m),
    m3 AS (SELECT *, bool_or(prompt) OVER (PARTITION BY query_id) AND bool_or(explains) OVER (PARTITION BY query_id) AS balanced, row_number() OVER (PARTITION BY query_id, prompt ORDER BY rank) AS nth FROM m2),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN balanced AND prompt THEN 1 ELSE 0 END, rank) AS place FROM m3 WHERE NOT balanced OR explains OR (prompt AND nth = 1)) WHERE place <= 3),
    near AS (SELECT a.query_id, CASE WHEN a.explains THEN 0 ELSE 1 END AS late, a.rank, k.page_number, k.chunk_index, k.chunk_id FROM m3 a JOIN cand k ON k.doc_id = a.doc_id AND abs(k.page_number - a.page_number) = 1
        WHERE a.balanced AND NOT a.prompt AND k.body AND NOT {_EXERCISE('k.content', 'a.title')} AND list_has_any(a.terms, {_SHARED('k.content', 'a.question')}) AND (a.query_id, k.chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM chosen)),
    near1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY late, rank) AS one FROM near) WHERE one = 1),
    near2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, rank, page_number, chunk_index, chunk_id) AS n FROM near1) WHERE n <= 2),
    {_PAIRS},
    fresh AS (SELECT * FROM pairs p WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM chosen) AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM near2)),
    over1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, page_number ORDER BY lp, rp, chunk_index) AS one FROM fresh) WHERE one = 1),
    over2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lp, rp, page_number, chunk_index, chunk_id) AS n FROM over1) WHERE n <= 2),
    context AS (SELECT query_id, CAST(place AS INTEGER) AS place, chunk_id, added FROM (SELECT query_id, chunk_id, added, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place FROM (
        SELECT query_id, chunk_id, place AS p, false AS added FROM chosen UNION ALL SELECT query_id, chunk_id, 3 + n, true FROM near2 UNION ALL SELECT query_id, chunk_id, 5 + n, true FROM over2)) WHERE place <= 5)"""
_RANKED = f"{_RERANKED}, ranked AS (SELECT item_id AS query_id, {_ASKED.format('question')} AS question, place AS rank, chunk_id, doc_id, page_number, concat({_HEADING}, chr(10), content) AS content, filename AS title, role FROM reranked JOIN resource ON resource_id = doc_id)"
#: A question to each document, whose hits are its five longest chunks.
_OWN = f"""ranked AS (SELECT * FROM (SELECT doc_id AS query_id, 'Which topic?' AS question, row_number() OVER (PARTITION BY doc_id ORDER BY length(content) DESC, chunk_index) AS rank, chunk_id, doc_id, page_number, concat({_HEADING}, chr(10), content) AS content, filename AS title, role
    FROM chunk JOIN resource ON resource_id = doc_id) WHERE rank <= 5)"""


def _sectioned(df: DataFrame) -> DataFrame:
    return df.withColumn("content", F.concat(F.expr(_HEADING), F.lit("\n"), "content"))


def _candidates(c: Corpus) -> DataFrame:
    """Chunks below headings that may be searched."""
    own = c.resource.select(_C("resource_id").alias("doc_id"), "status", "stage")
    return _sectioned(c.chunk.join(own, "doc_id").filter(retrieval.usable(_C("content"), _C("status"), _C("stage"))))


def _titled(c: Corpus, df: DataFrame) -> DataFrame:
    return _sectioned(df.join(c.resource.select(_C("resource_id").alias("doc_id"), _C("filename").alias("title"), "role"), "doc_id"))


@query("context_select", f"WITH {_OWN}, {_SELECTED} SELECT query_id, place, chunk_id, added FROM context", "chunk", "resource")
def context_select(c: Corpus) -> DataFrame:
    """A question to each document, whose hits are its five longest chunks."""
    longest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.length("content")), "chunk_index"))
    own = c.chunk.withColumn("rank", longest).filter("rank <= 5").withColumn("query_id", _C("doc_id")).withColumn("question", F.lit("Which topic?"))
    return retrieval.select_context(_titled(c, own), _candidates(c), 3)


def _context(c: Corpus) -> DataFrame:
    asked = reranked(c).withColumnRenamed("item_id", "query_id").withColumn("question", F.expr(_ASKED.format("question")))
    return retrieval.select_context(_titled(c, asked), _candidates(c), 3)


@query("citation_numbers", f"WITH {_RANKED}, {_SELECTED} SELECT query_id, chunk_id, place AS citation_id FROM context", *_RETRIEVAL_VIEWS)
def citation_numbers(c: Corpus) -> DataFrame:
    return _context(c).select("query_id", "chunk_id", _C("place").alias("citation_id"))


def _evidence(c: Corpus) -> DataFrame:
    return _context(c).join(_sectioned(c.chunk).select("chunk_id", "doc_id", "page_number", "content"), "chunk_id").join(_asked(c).select(_C("item_id").alias("query_id"), "question"), "query_id")


@query("evidence_payload", f"WITH {_RANKED}, {_SELECTED} SELECT x.query_id, any_value(a.question) AS question, string_agg(x.chunk_id || ':' || concat({_HEADING}, chr(10), k.content), '|' ORDER BY place) AS evidence, 26 + length(CAST(to_json(any_value(a.question)) AS VARCHAR)) + sum(CASE WHEN true THEN 37 + length(CAST(place AS VARCHAR)) + length(CAST(x.chunk_id AS VARCHAR)) + length(CAST(to_json(concat({_HEADING}, chr(10), k.content)) AS VARCHAR)) END) - 1 > 1500 AS rejected FROM context x JOIN chunk k ON k.chunk_id = x.chunk_id JOIN asked a ON a.item_id = x.query_id GROUP BY 1", *_RETRIEVAL_VIEWS)
def evidence_payload(c: Corpus) -> DataFrame:
    made = retrieval.payload(_evidence(c), 1500)  # a bound that some exceed
    parsed = made.withColumn("p", F.from_json("payload", "question string, evidence array<struct<citation_id:int,chunk_id:long,text:string>>"))
    listed = F.array_join(F.transform("p.evidence", lambda e: F.concat_ws(":", e["chunk_id"].cast("string"), e["text"])), "|")
    return parsed.select("query_id", _C("p.question").alias("question"), listed.alias("evidence"), "rejected")


@query("qa_evidence", f"""WITH {_RANKED}, {_SELECTED}, own AS (SELECT x.query_id, x.place, x.chunk_id, k.doc_id, k.page_number, path, concat({_HEADING}, chr(10), k.content) AS content, question FROM context x JOIN chunk k ON k.chunk_id = x.chunk_id JOIN resource ON resource_id = k.doc_id JOIN asked a ON a.item_id = x.query_id)
    SELECT query_id, place AS citation_id, chunk_id, o.doc_id, o.page_number, CASE WHEN path IS NOT NULL THEN concat('/api/resources/', o.doc_id, '/file#page=', o.page_number) END AS link, coalesce(w.codes, '') AS warnings,
        length(question) + sum(length(content)) OVER (PARTITION BY query_id) > 1200 AS long
    FROM own o LEFT JOIN (SELECT doc_id, page_number, string_agg(code, ',' ORDER BY code) AS codes FROM warning GROUP BY ALL) w ON w.doc_id = o.doc_id AND w.page_number = o.page_number""", *_RETRIEVAL_VIEWS, "warning")
def qa_evidence(c: Corpus) -> DataFrame:
    """Evidence of every question, with the warnings of its pages and whether question and texts exceed 1,200 characters."""
    own = written(_evidence(c).join(c.resource.select(_C("resource_id").alias("doc_id"), "path"), "doc_id"), "evidence")
    met = own.select("doc_id", "page_number").distinct()
    there = lambda df: df.join(F.broadcast(met), ["doc_id", "page_number"], "left_semi") if own.count() <= 1_000_000 else df.join(met, ["doc_id", "page_number"], "left_semi")
    shown = there(c.pages)
    found = pages.page_quality(c.sheets_of(shown), c.spans_of(shown)).groupBy("doc_id", "page_number").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("warnings"))
    size = F.length("question") + F.sum(F.length("content")).over(Window.partitionBy("query_id"))
    link = F.when(_C("path").isNotNull(), F.concat(F.lit("/api/resources/"), "doc_id", F.lit("/file#page="), "page_number"))
    return own.join(found, ["doc_id", "page_number"], "left").select("query_id", _C("place").alias("citation_id"), "chunk_id", "doc_id", "page_number", link.alias("link"), F.coalesce("warnings", F.lit("")).alias("warnings"), (size > 1200).alias("long"))


@query("page_warnings", f"WITH {_RERANKED} SELECT item_id, r.chunk_id, coalesce(w.codes, '') AS warnings FROM reranked r LEFT JOIN (SELECT doc_id, page_number, string_agg(code, ',' ORDER BY code) AS codes FROM issue GROUP BY ALL) w ON w.doc_id = r.doc_id AND w.page_number = r.page_number", *_RETRIEVAL_VIEWS, "issue")
def page_warnings(c: Corpus) -> DataFrame:
    """Pages are judged where a hit lies on them."""
    met = written(hits(c).select("doc_id", "page_number").distinct(), "met")
    codes = pages.issues_by_page(health.issues_on(c, met)).select("doc_id", "page_number", _C("codes").alias("warnings"))
    return reranked(c).join(codes, ["doc_id", "page_number"], "left").select("item_id", "chunk_id", F.coalesce("warnings", F.lit("")).alias("warnings"))


_FIRST = f"chosen AS (SELECT *, page_number AS place, filename AS title, {_HEAD('content')} AS heading, {_SHARED('content', 'question')} AS terms FROM (SELECT * EXCLUDE (content), doc_id AS query_id, concat({_HEADING}, chr(10), content) AS content, 'Which topic?' AS question FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY chunk_index) AS f FROM chunk) JOIN resource ON resource_id = doc_id WHERE f = 1))"


def _first_chunks(c: Corpus) -> DataFrame:
    """The first chunk of every page as an anchor of a question to its document."""
    first = c.chunk.groupBy("doc_id", "page_number").agg(F.min_by(F.struct("chunk_id", "chunk_index", "content"), "chunk_index").alias("f"))
    own = first.select("doc_id", "page_number", "f.*", _C("doc_id").alias("query_id"), F.lit("Which topic?").alias("question"), _C("page_number").alias("rank"))
    return _titled(c, own)


@query("adjacent_pages", f"WITH {_FIRST}, {_CANDIDATES} SELECT query_id, a.chunk_id AS anchor, k.chunk_id FROM chosen a JOIN cand k ON k.doc_id = a.doc_id AND abs(k.page_number - a.page_number) = 1 WHERE k.body AND NOT {_EXERCISE('k.content', 'a.title')} AND list_has_any(a.terms, {_SHARED('k.content', 'a.question')})", "chunk", "resource")
def adjacent_pages(c: Corpus) -> DataFrame:
    anchors = _first_chunks(c)
    found = retrieval.adjacent(anchors, _candidates(c))
    of = anchors.select("query_id", _C("rank").alias("anchor_rank"), _C("chunk_id").alias("anchor"))
    return found.join(of, ["query_id", "anchor_rank"]).select("query_id", "anchor", "chunk_id")


@query("bridge_pages", f"WITH {_FIRST}, {_CANDIDATES}, {_PAIRS} SELECT DISTINCT query_id, chunk_id FROM pairs", "chunk", "resource")
def bridge_pages(c: Corpus) -> DataFrame:
    return retrieval.bridges(_first_chunks(c), _candidates(c)).select("query_id", "chunk_id")


_GOLD_PAGES = "gp AS (SELECT a.item_id, a.expected, CASE WHEN a.item_id % 5 <> 0 THEN g.pages END AS pages FROM asked a JOIN gold g ON g.item_id = a.item_id AND g.expected = a.expected)"


def gold_pages(c: Corpus) -> DataFrame:
    """item_id, expected, pages: those of the expected document that hold the question; unresolved (null) for every
    fifth one."""
    own = c.gold.select("item_id", "expected", F.when(_C("item_id") % 5 != 0, _C("pages")).alias("pages"))
    return own.join(_asked(c).select("item_id", "expected"), ["item_id", "expected"], "left_semi")


def _metrics_sql(source: str, rank: str) -> str:
    ks = (1, 3, 5)
    part = lambda c, k, n: f"round(count(*) FILTER (WHERE {c} <= {k}) / nullif({n}, 0), 6)"
    cols = [f"{part('r', k, 'count(*)')} AS resource_hit_{k}" for k in ks] + [f"{part('e', k, 'count(*) FILTER (WHERE resolved)')} AS evidence_hit_{k}" for k in ks]
    return f"SELECT count(*) AS questions, count(*) FILTER (WHERE resolved) AS resolved, {', '.join(cols)} FROM (SELECT gp.item_id, min(CASE WHEN h.doc_id = gp.expected THEN {rank} END) AS r, min(CASE WHEN h.doc_id = gp.expected AND list_contains(gp.pages, h.page_number) THEN {rank} END) AS e, bool_or(gp.pages IS NOT NULL) AS resolved FROM gp LEFT JOIN {source} h ON h.item_id = gp.item_id GROUP BY 1)"


@query("hit_at_k", f"WITH {_HITS}, {_GOLD_PAGES} {_metrics_sql('hits', 'rank')}", *_RETRIEVAL_VIEWS)
def hit_at_k(c: Corpus) -> DataFrame:
    return evaluate.hit_at_k(hits(c).drop("expected"), gold_pages(c))


@query("retrieval_eval", f"WITH {_HITS}, {_GOLD_PAGES} SELECT h.item_id, h.rank, h.chunk_id, h.doc_id = gp.expected AS right_resource, coalesce(h.doc_id = gp.expected AND list_contains(gp.pages, h.page_number), false) AS right_page FROM hits h JOIN gp ON gp.item_id = h.item_id", *_RETRIEVAL_VIEWS)
def retrieval_eval(c: Corpus) -> DataFrame:
    joined = hits(c).drop("expected").join(gold_pages(c), "item_id")
    right = _C("doc_id") == _C("expected")
    return joined.select("item_id", "rank", "chunk_id", right.alias("right_resource"), F.coalesce(right & F.array_contains("pages", _C("page_number")), F.lit(False)).alias("right_page"))


_LONG = "SELECT metric, before, after, after < before AS regressed FROM (SELECT unnest(['resource_hit_1', 'resource_hit_3', 'resource_hit_5', 'evidence_hit_1', 'evidence_hit_3', 'evidence_hit_5']) AS metric, unnest([x.resource_hit_1, x.resource_hit_3, x.resource_hit_5, x.evidence_hit_1, x.evidence_hit_3, x.evidence_hit_5]) AS before, unnest([y.resource_hit_1, y.resource_hit_3, y.resource_hit_5, y.evidence_hit_1, y.evidence_hit_3, y.evidence_hit_5]) AS after FROM x, y) WHERE before IS DISTINCT FROM after"
_SECOND = _embedded_sql(16, "2")


_RANKS = lambda h: f"SELECT gp.item_id, min(CASE WHEN h.doc_id = gp.expected THEN rank END) AS r, min(CASE WHEN h.doc_id = gp.expected AND list_contains(gp.pages, h.page_number) THEN rank END) AS e, bool_or(gp.pages IS NOT NULL) AS resolved FROM gp LEFT JOIN {h} h ON h.item_id = gp.item_id GROUP BY 1"


@query("ab_pair", f"""WITH {_HITS}, {_SECOND}, {_GOLD_PAGES}, x AS ({_RANKS('hits')}), y AS ({_RANKS('hits2')})
    SELECT item_id, metric, before, after, before AND NOT after AS regressed FROM (
        SELECT x.item_id, kind || '_hit_at_' || k AS metric, coalesce(CASE kind WHEN 'resource' THEN x.r ELSE x.e END <= k, false) AS before, coalesce(CASE kind WHEN 'resource' THEN y.r ELSE y.e END <= k, false) AS after
        FROM x JOIN y ON y.item_id = x.item_id, (VALUES ('resource'), ('evidence')) AS m(kind), (VALUES (1), (3), (5)) AS n(k) WHERE kind = 'resource' OR x.resolved) WHERE before <> after""", *_RETRIEVAL_VIEWS)
def ab_pair(c: Corpus) -> DataFrame:
    """Question by question, vectors of 64 and of 16 dimensions."""
    gold = gold_pages(c).join(_asked(c).select("item_id", "question", "course_id"), "item_id")
    report = lambda h: evaluate.question_report(h.select("item_id", "rank", "doc_id", "page_number"), gold)
    return evaluate.pair_reports(report(hits(c)), report(hits(c, 16)))


@query("ab_eval", f"WITH {_HITS}, {_SECOND}, {_GOLD_PAGES}, x AS ({_metrics_sql('hits', 'rank')}), y AS ({_metrics_sql('hits2', 'rank')}) {_LONG}", *_RETRIEVAL_VIEWS)
def ab_eval(c: Corpus) -> DataFrame:
    gold = gold_pages(c)
    return evaluate.compare_reports(evaluate.hit_at_k(hits(c).drop("expected"), gold), evaluate.hit_at_k(hits(c, 16).drop("expected"), gold))


@query("rerank_eval", f"WITH {_RERANKED}, {_GOLD_PAGES}, x AS ({_metrics_sql('hits', 'rank')}), y AS ({_metrics_sql('reranked', 'place')}) SELECT 'before' AS arm, * FROM x UNION ALL SELECT 'after', * FROM y", *_RETRIEVAL_VIEWS)
def rerank_eval(c: Corpus) -> DataFrame:
    gold = gold_pages(c)
    arm = lambda name, h: evaluate.hit_at_k(h.drop("expected"), gold).withColumn("arm", F.lit(name))
    return arm("before", hits(c)).unionByName(arm("after", reranked(c)))


_PAGES = "CASE item_id % 6 WHEN 0 THEN NULL WHEN 1 THEN {0}1, 2{1} WHEN 2 THEN {0}2, 2{1} WHEN 3 THEN {0}0, 1{1} ELSE {0}3{1} END"
_SAMPLE = "CASE WHEN doc_id % 50 = 0 THEN ' ' WHEN doc_id % 50 = 1 THEN 'same' ELSE concat('s', doc_id) END"
_LABEL = "CASE doc_id % 4 WHEN 0 THEN 'lecture' WHEN 1 THEN 'tutorial' WHEN 2 THEN 'other' ELSE CASE WHEN doc_id % 8 = 3 THEN 'exam' END END"


@query("gold_load", f"""
    SELECT 'retrieval' AS gold, CAST(item_id AS VARCHAR) AS item, problem FROM (SELECT item_id, CASE WHEN NOT regexp_matches(text, '[^\\s\\p{{Z}}]') THEN 'question' WHEN length(text) > 4000 THEN 'length' WHEN item_id <= 0 THEN 'id' WHEN item_id % 7 = 0 THEN 'expected' WHEN item_id % 6 IN (2, 3) THEN 'pages' END AS problem FROM benchmark) WHERE problem IS NOT NULL
    UNION ALL SELECT 'classification', sample, CASE WHEN trim(sample) = '' THEN 'id' WHEN n > 1 THEN 'repeated' ELSE 'label' END FROM (SELECT {_SAMPLE} AS sample, count(*) AS n, count(*) FILTER (WHERE {_LABEL} IS NULL OR {_LABEL} = 'exam') AS bad FROM documents GROUP BY 1) WHERE trim(sample) = '' OR n > 1 OR bad > 0""")
def gold_load(c: Corpus) -> DataFrame:
    """Retrieval gold with pages that are repeated or not positive, and classification gold with blank and repeated ids and
    labels that are none."""
    asked = c.table("benchmark").select("item_id", _C("text").alias("question"), F.when(_C("item_id") % 7 == 0, 0).otherwise(5).alias("expected"), F.expr(_PAGES.format("array(", ")")).alias("pages"))
    samples = c.documents.select(F.expr(_SAMPLE).alias("sample_id"), F.expr(_LABEL).alias("expected"))
    named = lambda df, gold, key: df.select(F.lit(gold).alias("gold"), _C(key).cast("string").alias("item"), "problem")
    return named(evaluate.bad_questions(asked), "retrieval", "item_id").unionByName(named(evaluate.bad_samples(samples, ["lecture", "tutorial", "other"]), "classification", "sample_id"))


@query("gold_check", f"WITH {_HITS}, {_GOLD_PAGES} SELECT * FROM (SELECT gp.item_id, gp.expected, CASE WHEN r.course_id <> a.course_id THEN 'document' WHEN gp.item_id % 2 = 1 AND pages IS NOT NULL THEN 'pages' END AS problem FROM gp JOIN asked a ON a.item_id = gp.item_id JOIN resource r ON r.resource_id = gp.expected) WHERE problem IS NOT NULL", *_RETRIEVAL_VIEWS)
def gold_check(c: Corpus) -> DataFrame:
    """Every second question also expects a page that is not there."""
    gold = gold_pages(c).join(_asked(c).select("item_id", "course_id"), "item_id")
    gold = gold.withColumn("pages", F.when(_C("item_id") % 2 == 1, F.array_append("pages", F.lit(1_000_000))).otherwise(_C("pages")))
    own = c.chunk.join(c.resource.select(_C("resource_id").alias("doc_id"), "course_id"), "doc_id").select("doc_id", "course_id", "page_number")
    return evaluate.bad_gold(gold, own)


# Roles by rules against gold: the resources' own roles, without those of no known label.
_PREDICTED = f"SELECT material_id AS doc_id, r.role AS expected, d.role AS predicted FROM ({material_queries._DECISION}) d JOIN resource r ON r.resource_id = material_id WHERE material_id % 5 <> 0"
_ACCURACY = "SELECT w.expected, count(p.doc_id) AS total, count(*) FILTER (WHERE p.expected = p.predicted) AS correct, round(count(*) FILTER (WHERE p.expected = p.predicted) / nullif(count(p.doc_id), 0), 6) AS accuracy FROM (VALUES ('lecture'), ('tutorial'), ('other'), ('none'), (NULL)) AS w(expected) LEFT JOIN p ON w.expected IS NULL OR w.expected = p.expected GROUP BY 1"


def predicted(c: Corpus) -> DataFrame:
    """The classifier by metadata rules, on four of five resources, whose roles are the gold."""
    gold = c.resource.filter("resource_id % 5 <> 0").select(_C("resource_id").alias("material_id"), _C("role").alias("expected"))
    return classify.role_decision(material_queries.materials(c)).join(gold, "material_id").select(_C("material_id").alias("doc_id"), "expected", _C("role").alias("predicted"))


@query("label_accuracy", f"WITH p AS ({_PREDICTED}) {_ACCURACY}", "resource")
def label_accuracy(c: Corpus) -> DataFrame:
    return evaluate.label_accuracy(predicted(c), c.spark.createDataFrame([("lecture",), ("tutorial",), ("other",), ("none",)], "expected string"))


@query("classification_eval", f"WITH p AS ({_PREDICTED}) SELECT doc_id, expected, predicted FROM p WHERE expected <> predicted", "resource")
def classification_eval(c: Corpus) -> DataFrame:
    """The failures of the classifier."""
    return predicted(c).filter("expected <> predicted")


@query("review_template", "SELECT item_id, expected, question, CAST(NULL AS BOOLEAN) AS accepted, CAST(NULL AS VARCHAR) AS note FROM gold", "gold")
def review_template(c: Corpus) -> DataFrame:
    return c.gold.select("item_id", "expected", "question", F.lit(None).cast("boolean").alias("accepted"), F.lit(None).cast("string").alias("note"))


_DIGEST = "SELECT {by} count(*) AS n, CAST(sum(h) AS VARCHAR) AS total, CAST(bit_xor(h) AS VARCHAR) AS mixed FROM (SELECT *, CAST('0x' || substr(sha256(CAST({row} AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM {t}) {group}"


@query("table_digest", _DIGEST.format(by="doc_id,", row="json_object('chunk_index', chunk_index, 'content', content)", t="chunk", group="GROUP BY doc_id") + " UNION ALL " + _DIGEST.format(by="NULL,", row="json_object('chunk_index', chunk_index, 'content', content)", t="chunk", group=""), "chunk")
def table_digest(c: Corpus) -> DataFrame:
    """The digest of every document's chunks, and that of all chunks, added up from these."""
    own = evaluate.digest(c.chunk, ["doc_id"], ["chunk_index", "content"])
    return own.unionByName(evaluate.add_digests(own, []).withColumn("doc_id", F.lit(None).cast("long")))


@query("snapshot_equal", "SELECT only_a, only_b, only_a = 0 AND only_b = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT * FROM snap_old EXCEPT ALL SELECT * FROM snap_new)) AS only_a, (SELECT count(*) FROM (SELECT * FROM snap_new EXCEPT ALL SELECT * FROM snap_old)) AS only_b)", "snap_old", "snap_new")
def snapshot_equal(c: Corpus) -> DataFrame:
    """How two snapshots differ, and whether their digests are equal."""
    return evaluate.same_rows(c.snap_old, c.snap_new).join(F.broadcast(evaluate.same_digest(c.snap_old, c.snap_new)))  # one row each


@query("constraint_audit", """
    SELECT 'resource.filename unique' AS rule, filename AS key FROM resource GROUP BY filename HAVING count(*) > 1 UNION ALL SELECT 'document.n_chars' , CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars <> length(text)
    UNION ALL SELECT 'label.document', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'resource.status', CAST(resource_id AS VARCHAR) FROM resource WHERE status NOT IN ('parsed', 'completed', 'failed')
    UNION ALL SELECT 'chunk.page_number', CAST(chunk_id AS VARCHAR) FROM chunk WHERE page_number <= 0""", "resource", "chunk")
def constraint_audit(c: Corpus) -> DataFrame:
    lost = c.table("labels").join(c.documents, "doc_id", "left_anti")
    found = [
        evaluate.repeated(c.resource, "resource.filename unique", ["filename"]), evaluate.violations(c.documents, "document.n_chars", _C("n_chars") != F.length("text"), "doc_id"),
        evaluate.violations(lost, "label.document", F.lit(True), "doc_id"), evaluate.violations(c.resource, "resource.status", ~_C("status").isin("parsed", "completed", "failed"), "resource_id"),
        evaluate.violations(c.chunk, "chunk.page_number", _C("page_number") <= 0, "chunk_id"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
