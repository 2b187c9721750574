"""Course-scoped retrieval: vector top-k, reranking, balanced evidence and its payload."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from lectern.functions import text, vectors
from lectern.sources.scratch import written


def usable(content: Column, status: Column, stage: Column) -> Column:
    """A chunk that may be searched: not blank, and its resource parsed or failed only later."""
    return content.rlike(r"[^\s\p{Z}]") & (status.isin("parsed", "completed") | ((status == "failed") & (stage == "knowledge")))


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[list]:
    """The queries with a vector, in blocks whose vectors take about block_bytes at most."""
    q = queries.select("query_id", "course_id", vectors.unit(F.col("embedding")).alias("q")).filter(F.col("course_id").isNotNull() & (F.size("q") > 0) & F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x)))
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n = max(1, -(-size["n"] * (8 * max(1, size["d"] or 1) + 64) // block_bytes))
    for i in range(n):
        yield (q if n == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i)).collect()


def _local_best(block: list, k: int):
    """The k best candidates of each query of a block in one task: a bounded heap for each, as sorted arrays."""
    courses: dict = {}
    for r in block:
        courses.setdefault((r["course_id"], len(r["q"])), []).append(r)
    asked = {c: ([r["query_id"] for r in rows], np.array([r["q"] for r in rows])) for c, rows in courses.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            lists = batch.column("embedding")
            length, course, ids = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), batch.column("course_id").to_pylist(), batch.column("chunk_id").to_numpy(zero_copy_only=False)
            flat, starts = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(length)])
            rows_of: dict = {}
            for i, c in enumerate(zip(course, length.tolist(), strict=True)):
                if c in asked:
                    rows_of.setdefault(c, []).append(i)
            for c, rows in rows_of.items():
                at = np.array(rows)[np.argsort(ids[rows], kind="stable")]
                x = flat[starts[at][:, None] + np.arange(c[1])]
                top = np.abs(x).max(1)
                fit = np.isfinite(top) & (top > 0)
                at, x = at[fit], x[fit] / top[fit][:, None]
                x /= np.sqrt((x * x).sum(1))[:, None]
                millionths = np.floor(np.clip(x @ asked[c][1].T, -1, 1) * 1e6 + 0.5).astype(np.int64)
                places = (millionths << 32) - np.arange(len(at))[:, None]  # by score, then id
                few = min(k, len(at))
                if not few:
                    continue
                chosen = np.argpartition(-places, few - 1, axis=0)[:few] if few < len(at) else np.repeat(np.arange(len(at))[:, None], places.shape[1], 1)
                for j in range(places.shape[1]):
                    new = [(-int(millionths[i, j]), int(ids[at[i]])) for i in chosen[:, j]]
                    best[c, j] = sorted(best.get((c, j), []) + new)[:k]
        rows = [(asked[c][0][j], c[0], i, -s / 1e6) for (c, j), found in best.items() for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], t) for x, t in enumerate(types)], ["query_id", "course_id", "chunk_id", "score"])

    return run, (types := [])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block_bytes: int = 32 << 20) -> DataFrame:
    """queries: query_id, course_id, embedding; candidates: chunk_id, course_id, embedding. The k best of the
    query's own course by cosine (six decimals), ties to the smaller chunk_id. Candidates stay where they lie: blocks of
    queries of a checked size go to them, each task keeps the k best of each query, and only those are
    shuffled and merged. Vectors that are null, zero, not finite or of another length take no part."""
    kinds = {f.name: f.dataType for f in queries.schema.fields} | {"chunk_id": candidates.schema["chunk_id"].dataType}
    names = [("query_id", kinds["query_id"]), ("course_id", kinds["course_id"]), ("chunk_id", kinds["chunk_id"])]
    schema = ", ".join(f"{n} {t.simpleString()}" for n, t in names) + ", score double"
    own = candidates.select("chunk_id", candidates["course_id"].cast(kinds["course_id"]).alias("course_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = None
    for block in _blocks(queries, block_bytes):
        run, types = _local_best(block, k)
        types += [*to_arrow_schema(StructType([StructField(n, t) for n, t in names])).types, pa.float64()]
        part = own.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def shared_words(a: Column, b: Column) -> Column:
    """The built-in pair score: distinct words that two texts share."""
    words = lambda t: F.array_distinct(F.split(text.normalize_words(t), " "))
    return F.size(F.array_intersect(words(a), words(b)))


def rerank(hits: DataFrame, score: Column, keep: int = 5) -> DataFrame:
    """Hits by another score, ties by their first rank; the cosine stays. Scores that are not finite go to
    the end."""
    scored = hits.withColumn("rerank_score", score.cast("double")).withColumnRenamed("rank", "original_rank")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "original_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def _met(anchor: Column, fits: Column) -> Column:
    """fits, a rule on chunks, for those alone that met an anchor, of which `anchor` is a condition: a rule that names no
    column of the anchors would be worked out for all chunks, before they meet."""
    return F.when(anchor, fits)


def adjacent(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, anchor_rank, chunk_id: chunks with body on the pages next to an anchor whose headings share
    the query's terms, exercises left out. anchors: query_id, question, rank, doc_id, page_number, content,
    title; chunks: those that may be searched."""
    own = anchors.withColumn("terms", text.section_terms(F.col("content"), F.col("question"))).filter(F.size("terms") > 0)
    near = own.select("query_id", "question", "title", "terms", "rank", "doc_id", F.explode(F.array(F.col("page_number") - 1, F.col("page_number") + 1)).alias("page_number"))
    met = near.join(chunks.select("doc_id", "page_number", "chunk_id", "chunk_index", "content"), ["doc_id", "page_number"])
    fits = text.has_body(F.col("content")) & F.arrays_overlap("terms", text.section_terms(F.col("content"), F.col("question")))
    return met.filter(_met(F.size("terms") > 0, fits & ~text.exercise_prompt(F.col("content"), F.col("title")))).select("query_id", F.col("rank").alias("anchor_rank"), "doc_id", "page_number", "chunk_index", "chunk_id")


def bridges(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id: chunks of equal heading, exercises left out, on pages strictly between two anchors
    of one document that are two or three pages apart; the heading of the first shares the query's terms.
    anchors and chunks as for `adjacent`."""
    own = anchors.select("query_id", "doc_id", "page_number", "rank", "title", text.section_heading(F.col("content")).alias("heading"), F.size(text.section_terms(F.col("content"), F.col("question"))).alias("terms")).filter("heading <> ''")
    l, r = own.filter("terms > 0").alias("l"), own.alias("r")
    met = l.join(r, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("query_id", "doc_id", "heading")] + [(F.col("r.page_number") - F.col("l.page_number")).between(2, 3)])
    gaps = met.select("l.query_id", "l.doc_id", "l.heading", "l.title", F.struct(F.col("l.rank"), F.col("r.rank").alias("other")).alias("anchor_rank"), F.explode(F.sequence(F.col("l.page_number") + 1, F.col("r.page_number") - 1)).alias("page_number"))
    found = gaps.join(chunks.select("doc_id", "page_number", "chunk_id", "chunk_index", "content"), ["doc_id", "page_number"])
    keep = (text.section_heading(F.col("content")) == F.col("heading")) & text.has_body(F.col("content")) & text.low_information(F.col("content")).isNull() & ~text.exercise_prompt(F.col("content"), F.col("title"))
    return found.filter(_met(F.col("heading") != "", keep)).groupBy("query_id", "doc_id", "page_number", "chunk_index", "chunk_id").agg(F.min("anchor_rank").alias("anchor_rank"))


def select_context(ranked: DataFrame, chunks: DataFrame, limit: int = 3, most: int = 5, additions: int = 2) -> DataFrame:
    """query_id, place, chunk_id, added: balanced evidence. ranked: query_id, question, rank, chunk_id, doc_id,
    page_number, content, title, role. Where there are both explanations and an exercise, explanations come
    first, one exercise stays, and neighbours of anchors follow, those of explanations before others. Then
    pages between two of the chosen follow, one chunk of each."""
    prompt = text.exercise_prompt(F.col("content"), F.col("title"))
    explains = ~prompt & text.has_body(F.col("content")) & ((F.col("role") == "lecture") | (F.size(text.section_terms(F.col("content"), F.col("question"))) > 0))
    marked = ranked.withColumn("prompt", prompt).withColumn("explains", explains)
    of_query = Window.partitionBy("query_id")
    marked = marked.withColumn("balanced", F.max("prompt").over(of_query) & F.max("explains").over(of_query))
    marked = marked.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "prompt").orderBy("rank")))
    marked = written(marked, "marked")  # used by each step below
    first = marked.filter(~F.col("balanced") | F.col("explains") | (F.col("prompt") & (F.col("nth") == 1)))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("balanced") & F.col("prompt"), 1).otherwise(0), "rank")
    chosen = first.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    base = chosen.select("query_id", "place", "chunk_id", F.lit(False).alias("added"))
    anchors = marked.filter("balanced AND NOT prompt").withColumn("rank", F.struct(~F.col("explains"), F.col("rank")))

    def more(found: DataFrame, so_far: DataFrame, by: list[str], after: int) -> DataFrame:
        seen = so_far.select(F.col("query_id").alias("q"), F.col("chunk_id").alias("c"))
        new = found.join(seen, (F.col("query_id") == F.col("q")) & (F.col("chunk_id") == F.col("c")), "left_anti")
        once = new.groupBy("query_id", *by).agg(F.min(F.struct("anchor_rank", "page_number", "chunk_index", F.col("chunk_id").alias("id"))).alias("f"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy("f"))
        best = once.withColumn("nth", nth).filter(F.col("nth") <= additions)
        return so_far.unionByName(best.select("query_id", (after + F.col("nth")).alias("place"), F.col("f.id").alias("chunk_id"), F.lit(True).alias("added")))

    near = written(more(adjacent(anchors, chunks), base, ["chunk_id"], limit), "near")
    over = more(bridges(chosen.withColumn("rank", F.col("place")), chunks), near, ["doc_id", "page_number"], limit + additions)
    together = over.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return together.filter(F.col("place") <= most)


def payload(evidence: DataFrame, limit: int = 30_000) -> DataFrame:
    """query_id, payload, rejected: JSON of the question and its numbered evidence."""
    own = F.array_sort(F.collect_list(F.struct(F.col("place").alias("citation_id"), "chunk_id", F.col("content").alias("text"))))
    made = evidence.groupBy("query_id", "question").agg(own.alias("evidence"))
    made = made.select("query_id", F.to_json(F.struct("question", "evidence")).alias("payload"))
    return made.withColumn("rejected", F.length("payload") > limit)


#: Fixed value: the answer where the evidence does not suffice.
INSUFFICIENT = "当前课程材料中没有足够信息回答这个问题。"
_DRAFT = "struct<answerable: boolean, answer: string, citation_ids: array<int>>"


def parse_drafts(raw: DataFrame) -> DataFrame:
    """raw: query_id, draft (JSON). query_id, answerable, answer, citation_ids; all null where the JSON is not
    an object of just these three of just these types, the answer has no or more than 8,000 characters, or
    more than five are cited."""
    listed = F.try_parse_json(F.concat(F.lit("["), "draft", F.lit("]")))  # so that nothing may follow the object
    v = F.try_variant_get(listed, "$[0]", "variant")
    d = F.try_variant_get(v, "$", _DRAFT)
    typed = F.schema_of_variant(v).isin([f"OBJECT<answer: STRING, answerable: BOOLEAN, citation_ids: ARRAY<{t}>>" for t in ("BIGINT", "VOID")])
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull() & F.col("draft").rlike(r"\}\s*$")
    fits = typed & alone & d.isNotNull() & ~F.exists(d["citation_ids"], lambda x: x.isNull()) & F.length(d["answer"]).between(1, 8_000) & (F.size(d["citation_ids"]) <= 5)
    return raw.select("query_id", *[F.when(fits, d[c]).alias(c) for c in ("answerable", "answer", "citation_ids")])


def answers(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, answerable, answer, sources of the drafts that pass: the evidence they cite, ascending (all its columns, none
    of which a draft states). An abstention has the fixed answer and no source. evidence: query_id, place, ..."""
    good = drafts.join(check_answers(drafts, evidence).filter("error IS NULL").select("query_id"), "query_id", "left_semi")
    facts = F.struct(*[c for c in evidence.columns if c != "query_id"])
    cited = good.select("query_id", F.explode("citation_ids").alias("place")).join(evidence, ["query_id", "place"])
    sources = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(facts)).alias("sources"))
    return good.join(sources, "query_id", "left").select("query_id", "answerable", F.when(F.col("answerable"), F.col("answer")).otherwise(F.lit(INSUFFICIENT)).alias("answer"), "sources")


def check_answers(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """drafts: query_id, answerable, answer, citation_ids; evidence: query_id, place. Adds error (null if the draft
    was parsed, its answer is not blank, and its citations are unique, exist, are those named in the text,
    and are empty just for abstentions)."""
    known = evidence.groupBy("query_id").agg(F.collect_set("place").alias("places"))
    inline = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    declared = F.array_sort("citation_ids")
    error = (
        F.when(F.col("answerable").isNull() | F.col("answer").isNull() | F.col("citation_ids").isNull(), "json")
        .when(F.regexp_replace("answer", r"(?U)\s+", "") == "", "blank")
        .when(F.size(F.array_distinct("citation_ids")) != F.size("citation_ids"), "repeated")
        .when(F.size(F.array_except("citation_ids", F.coalesce("places", F.array().cast("array<int>")))) > 0, "unknown")
        .when(declared != inline, "inline")
        .when(F.col("answerable") == (F.size("citation_ids") == 0), "abstention")
    )
    return drafts.join(known, "query_id", "left").select("query_id", error.alias("error"))
