"""The incremental vector index: which chunks are new, changed, unchanged, unusable or gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_diff(current: DataFrame, index: DataFrame, model: str, version: str, dimensions: int) -> DataFrame:
    """current: chunk_id, course_id, content_hash, source_hash, usable; index: chunk_id, model, model_version, dimensions,
    content_hash, source_hash, valid. One row for each chunk of either: chunk_id, course_id, action. A vector is
    current if model, its version, dimensions and both hashes are the same and it is valid."""
    c, i = current.alias("c"), index.alias("i")
    joined = c.join(i, F.col("c.chunk_id") == F.col("i.chunk_id"), "full_outer")
    same = (F.col("i.model") == model) & (F.col("i.model_version") == version) & (F.col("i.dimensions") == dimensions) & (F.col("c.content_hash") == F.col("i.content_hash")) & (F.col("c.source_hash") == F.col("i.source_hash")) & F.col("i.valid")
    same = F.coalesce(same, F.lit(False))
    action = (
        F.when(F.col("c.chunk_id").isNull(), "removed")
        .when(~F.col("c.usable"), F.when(F.col("i.chunk_id").isNull(), "unusable").otherwise("removed"))
        .when(F.col("i.chunk_id").isNull(), "new").when(same, "skipped").otherwise("updated")
    )
    return joined.select(F.coalesce("c.chunk_id", "i.chunk_id").alias("chunk_id"), F.col("c.course_id").alias("course_id"), action.alias("action"))


def index_stats(diff: DataFrame) -> DataFrame:
    names = ["new", "updated", "skipped", "removed", "unusable"]
    return diff.groupBy("course_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("action") == n).alias(n) for n in names])


def index_status(diff: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """course_id, usable, compatible, missing, state of each course before anything is indexed. reports: course_id,
    stored (state of its last indexing), of which one that runs or failed wins over what is found."""
    c = diff.filter("course_id IS NOT NULL").groupBy("course_id").agg(F.count_if(F.col("action").isin("new", "updated", "skipped")).alias("usable"), F.count_if(F.col("action") == "skipped").alias("compatible"))
    state = F.when(F.col("usable") == 0, "unavailable").when(F.col("usable") == F.col("compatible"), "ready").otherwise("stale")
    if reports is not None:
        c = c.join(reports.select("course_id", "stored"), "course_id", "left")
        state = F.when(F.col("stored").isin("indexing", "error"), F.col("stored")).otherwise(state)
    return c.select("course_id", "usable", "compatible", (F.col("usable") - F.col("compatible")).alias("missing"), state.alias("state"))


def fleet_summary(diff: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row over all courses. failed: course_id of those whose indexing raised an error; they are not made ready."""
    s, status = index_stats(diff.filter("course_id IS NOT NULL")), index_status(diff)
    if failed is not None:
        status = status.join(failed.select("course_id", F.lit(True).alias("failed")), "course_id", "left")
    error = F.coalesce("failed", F.lit(False)) if failed is not None else F.lit(False)
    joined = s.join(status, "course_id")
    return joined.agg(
        F.count(F.lit(1)).alias("courses"), F.count_if(F.col("state") == "ready").alias("ready_before"), F.count_if((F.col("usable") > 0) & ~error).alias("ready_after"),
        F.sum(F.when(~error, F.col("new")).otherwise(0)).alias("newly_indexed"), F.sum(F.when(~error, F.col("updated")).otherwise(0)).alias("stale_updated"),
        F.count_if(F.col("state") == "unavailable").alias("unavailable"), F.count_if(error).alias("errors"),
    )


_HASHES = ["content_hash", "source_hash"]


def planned(current: DataFrame, diff: DataFrame, batch_ids: int = 64) -> DataFrame:
    """Chunks to embed, in batches: those of one course whose ids share a range of batch_ids."""
    pending = diff.filter("action IN ('new', 'updated')").select("chunk_id")
    return current.join(pending, "chunk_id", "left_semi").withColumn("batch", F.floor(F.col("chunk_id") / batch_ids))


def refused(plan: DataFrame, live: DataFrame) -> DataFrame:
    """course_id, batch of the batches with a chunk that, in the live table, is gone, no longer usable, of another
    course or of other hashes than when it was planned."""
    now = live.filter("usable").select("chunk_id", F.col("course_id").alias("now_course"), *[F.col(h).alias(f"now_{h}") for h in _HASHES])
    joined = plan.join(now, "chunk_id", "left")
    same = F.col("course_id").eqNullSafe(F.col("now_course"))
    for h in _HASHES:
        same &= F.col(h).eqNullSafe(F.col(f"now_{h}"))
    return joined.filter(~same).select("course_id", "batch").distinct()


def index_apply(index: DataFrame, diff: DataFrame, plan: DataFrame, vectors: DataFrame, live: DataFrame, model: str, version: str, dimensions: int) -> DataFrame:
    """The new index: unchanged rows as they are, planned ones with their new vectors (chunk_id, embedding), those
    of refused batches as they were. A planned chunk without a vector, or with one of length zero or of other
    dimensions, is not valid."""
    p, r = plan.alias("p"), refused(plan, live).alias("r")
    met = p.join(r, F.col("p.course_id").eqNullSafe(F.col("r.course_id")) & (F.col("p.batch") == F.col("r.batch")), "left")
    marked = met.select("p.*", F.col("r.batch").isNotNull().alias("refused"))
    old = diff.filter("action = 'skipped'").select("chunk_id").unionByName(marked.filter("refused").select("chunk_id"))
    kept = index.join(old, "chunk_id", "left_semi")
    made = marked.filter("NOT refused").join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    some = F.coalesce(F.exists("embedding", lambda x: x != 0) & (F.size("embedding") == dimensions), F.lit(False))
    return kept.unionByName(made.select("chunk_id", F.lit(model).alias("model"), F.lit(version).alias("model_version"), F.lit(dimensions).alias("dimensions"), *_HASHES, some.alias("valid"), "embedding"))


def orphans(current: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows whose chunk is gone, or is not usable."""
    gone = index.join(current, "chunk_id", "left_anti").select("chunk_id", F.lit("gone").alias("why"))
    unusable = index.join(current.filter(~F.col("usable")), "chunk_id", "left_semi").select("chunk_id", F.lit("unusable").alias("why"))
    return gone.unionByName(unusable)


def recheck(evidence: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """chunk_id, changed: evidence rows of which a column no longer equals the live one (or the row is gone)."""
    e, l = evidence.alias("e"), live.alias("l")
    joined = e.join(l, F.col("e.chunk_id") == F.col("l.chunk_id"), "left")
    moved = F.array_compact(F.array(*[F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"l.{c}")), F.lit(c)) for c in columns]))
    changed = F.when(F.col("l.chunk_id").isNull(), "gone").otherwise(F.array_join(moved, ","))
    return joined.select("e.chunk_id", changed.alias("changed")).filter("changed <> ''")
