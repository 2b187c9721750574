"""Change detection and sync telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exclusion(active_term: Column) -> Column:
    """Why a course (term_id, declared_term, active, restricted) is out of scope, in fixed order; null if in."""
    c = F.col
    return (
        F.when(c("term_id").isNull(), "term not mapped").when(c("declared_term") != c("term_id"), "conflicting term").when(c("term_id") != active_term, "different term")
        .when(~c("active"), "inactive").when(c("restricted"), "restricted")
    )


def in_scope(resources: DataFrame, scope: DataFrame) -> DataFrame:
    """resource_id, missing: resources that a requested scope (course, week, file; null is any) covers, and
    one row for each scope without any, with the file asked for. Scopes are grouped by how far they go, so
    each group is an equality join."""
    kinds = [(["course"], "week IS NULL AND file IS NULL"), (["course", "week"], "week IS NOT NULL AND file IS NULL"), (["course", "week", "file"], "file IS NOT NULL")]
    own = resources.select("resource_id", F.col("course_id").alias("course"), F.col("week_id").alias("week"), F.col("resource_id").alias("file"))
    found, missing = None, None
    for keys, which in kinds:
        part = scope.filter(which)
        hit, miss = own.join(part.select(*keys).distinct(), keys, "left_semi").select("resource_id"), part.join(own.select(*keys), keys, "left_anti").select("file")
        found, missing = (hit, miss) if found is None else (found.unionByName(hit), missing.unionByName(miss))
    return found.distinct().withColumn("missing", F.lit(False)).unionByName(missing.select(F.col("file").alias("resource_id"), F.lit(True).alias("missing")))


#: Counters of a run: stage and outcome of the events that each counts, outcome None for any.
COUNTERS = {
    "discovered": [("discovery", "file"), ("discovery", "page_linked_file")], "downloaded": [("download", "downloaded")], "updated": [("download", "updated")], "skipped": [("skip", None)], "failed": [("error", None)],
    "files_parsed": [("parse", "parsed")], "files_analyzed": [("knowledge", "analyzed")], "pages_inspected": [("page", None)], "page_links_found": [("link", None)], "page_linked_files": [("discovery", "page_linked_file")],
    "page_links_unsupported": [("link", "unsupported")], "ignored_readings": [("skip", "ignored_reading_material")], "unsupported": [("skip", "unsupported")],
}


def counters(events: DataFrame) -> DataFrame:
    """events: run_id, stage, outcome. All counters of each run, and whether it had errors. An updated file is a
    downloaded one too."""
    def hit(stage: str, outcome: str | None) -> Column:
        return (F.col("stage") == stage) & (F.lit(True) if outcome is None else F.col("outcome") == outcome)

    def counted(of: list) -> Column:
        return F.count_if(F.array_contains(F.array(*[F.coalesce(hit(*x), F.lit(False)) for x in of]), True))

    made = events.groupBy("run_id").agg(*[counted(of + COUNTERS["updated"] if k == "downloaded" else of).alias(k) for k, of in COUNTERS.items()])
    return made.withColumn("status", F.when(F.col("failed") > 0, "completed_with_errors").otherwise("completed"))


def progress(events: DataFrame) -> DataFrame:
    """How far each run has come. events: run_id, stage, outcome, ts."""
    spans = events.groupBy("run_id").agg(F.floor((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1_000_000).alias("seconds"))
    c = counters(events).join(spans, "run_id").filter("discovered > 0")
    done = F.col("downloaded") + F.col("skipped") + F.col("failed")
    settled = F.least("discovered", done)
    zero = F.lit(0).cast("long")
    return c.select("run_id", settled.alias("settled"), F.floor(100 * settled / F.col("discovered")).alias("percent"), F.greatest(F.col("discovered") - done, zero).alias("remaining"), F.greatest(F.col("downloaded") - F.col("updated"), zero).alias("new_downloads"), "seconds")


def first_discovery(links: DataFrame) -> DataFrame:
    """The first row of each key in discovery order (page_id, pos), with what later ones add: how often the key was met,
    whether any was linked from a page, the first title that is not empty, and all evidence, each once and in
    order. links: key, page_id, pos, linked, title, evidence (an array)."""
    at = F.struct("page_id", "pos")
    return links.groupBy("key").agg(
        F.min(at).alias("f"), F.count(F.lit(1)).alias("times"), F.bool_or("linked").alias("linked"), F.min_by("title", F.when(F.coalesce("title", F.lit("")) != "", at)).alias("title"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("evidence")))).alias("evidence"),
    ).select("key", "f.page_id", "f.pos", "times", "linked", "title", "evidence")


def number_weeks(weeks: DataFrame) -> DataFrame:
    """weeks: course_id, title, pos, parsed. The parsed number where it is free, by position; the others
    follow the largest one of their course."""
    own = F.when(F.col("parsed").isNotNull() & (F.row_number().over(Window.partitionBy("course_id", "parsed").orderBy("pos")) == 1), F.col("parsed"))
    taken = weeks.withColumn("own", own).withColumn("open", F.col("own").isNull())
    top = F.coalesce(F.max("own").over(Window.partitionBy("course_id")), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("course_id", "open").orderBy("pos"))
    return taken.withColumn("top", top).withColumn("nth", nth).withColumn("week_number", F.coalesce("own", F.col("top") + F.col("nth")).cast("int")).drop("own", "open", "top", "nth")


def adopt_weeks(modules: DataFrame, old: DataFrame) -> DataFrame:
    """modules: course_id, module_id, title, number; old: course_id, week, title, number, module_id. A module
    takes the week that has its id, else the only legacy week of its title, else of its number."""
    known = old.filter("module_id IS NOT NULL").groupBy("course_id", "module_id").agg(F.min("week").alias("by_module"))
    legacy = old.filter("module_id IS NULL")

    def only(key: str) -> DataFrame:
        return legacy.groupBy("course_id", key).agg(F.min("week").alias(f"by_{key}"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")

    joined = modules.join(known, ["course_id", "module_id"], "left").join(only("title"), ["course_id", "title"], "left").join(only("number"), ["course_id", "number"], "left")
    how = F.when(F.col("by_module").isNotNull(), "module").when(F.col("by_title").isNotNull(), "title").when(F.col("by_number").isNotNull(), "number").otherwise("create")
    return joined.select("course_id", "module_id", F.coalesce("by_module", "by_title", "by_number").alias("week"), how.alias("how"))


def conflicts(df: DataFrame, column: str, owner: str, kind: str) -> DataFrame:
    """Values that more than one owner has."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.countDistinct(owner).alias("n"))
    return counted.filter("n > 1").select(F.lit(kind).alias("kind"), "value", "n")


def change_class(old: DataFrame, new: DataFrame) -> DataFrame:
    """resource_id, change. External material goes by its revision alone; a file of the course by its time, without which
    it cannot be told what it is (ERROR), while a known file without a stored time is UPDATED."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col("o.resource_id") == F.col("n.resource_id"), "full_outer")
    change = (
        F.when(F.col("n.resource_id").isNull(), "MISSING")
        .when(F.col("n.revision").isNotNull(), F.when(F.col("o.resource_id").isNull(), "NEW").when(F.col("o.revision").eqNullSafe(F.col("n.revision")), "UNCHANGED").otherwise("UPDATED"))
        .when(F.col("n.updated_at").isNull(), "ERROR").when(F.col("o.resource_id").isNull(), "NEW")
        .when(F.col("o.updated_at").isNull() | (F.col("n.updated_at") > F.col("o.updated_at")), "UPDATED").otherwise("UNCHANGED")
    )
    return joined.select(F.coalesce("o.resource_id", "n.resource_id").alias("resource_id"), change.alias("change"))


def next_action(locked: Column, change: Column, status: Column, stage: Column, file_type: Column | None = None) -> Column:
    """What to do next for a resource. What was downloaded and is no PDF is unsupported."""
    resumed = F.when(stage == "done", "knowledge").when(stage.isNotNull(), stage).when(status == "parsed", "knowledge").otherwise("download")
    if file_type is not None:
        resumed = F.when((resumed == "parse") & (F.lower(file_type) != ".pdf"), "unsupported").otherwise(resumed)
    return (
        F.when(locked, "error").when((change == "UNCHANGED") & status.isin("completed", "unsupported"), "skip").when(change == "NEW", "download").when(change == "UPDATED", "download+invalidate")
        .otherwise(resumed)
    )


def skip_readings(materials: DataFrame, policy: bool = True) -> DataFrame:
    """Without reading material, if the policy is on."""
    return materials.filter(F.col("kind") != "READING") if policy else materials
