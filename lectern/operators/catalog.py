"""Catalog tables: listings, upserts, closures and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.scratch import shared_dir

LISTING = "course struct<id:long,name:string,term:struct<id:long>>, items array<struct<id:long,type:string,content_id:long>>"


def page_of(df: DataFrame, by: str, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of each group, in order."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_n", n).filter((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")


def flatten_listing(raw: DataFrame) -> DataFrame:
    """doc_id, json of a nested course listing -> one row for each item; unknown fields are ignored, and
    only items that are files have a file id."""
    parsed = raw.select("doc_id", F.from_json("json", LISTING).alias("l"))
    items = parsed.select("doc_id", F.col("l.course.id").alias("canvas_course_id"), F.col("l.course.term.id").alias("term_id"), F.explode_outer("l.items").alias("i"))
    return items.select("doc_id", "canvas_course_id", "term_id", F.col("i.id").alias("item_id"), F.when(F.col("i.type") == "File", F.col("i.content_id")).alias("file_id"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """old with all rows of the given keys replaced by those of new; new rows of other keys are refused."""
    return old.join(keys, key, "left_anti").unionByName(new.join(keys, key, "left_semi"))


BUCKET = "_bucket"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A new table in folders by a hash of its key, which replace_on_disk can replace one by one."""
    df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition(BUCKET).write.partitionBy(BUCKET).mode("errorifexists").parquet(path)


def replace_on_disk(path: str, new: DataFrame, keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """Replaces all rows of the given keys of a table that write_bucketed wrote, in place; gives the table. Only folders
    that hold one of the keys are written, by dynamic partition overwrite; all others keep their files. New rows
    of other keys are an error, before anything is written. Running it again has the same result."""
    spark = new.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    wanted = keys.select(key).distinct()
    if not new.join(wanted, key, "left_anti").isEmpty():
        raise ValueError("new rows belong to keys that are not replaced")
    touched = [r[0] for r in wanted.select(bucket).distinct().collect()]  # as many as there are buckets, at most
    old = spark.read.parquet(path)
    kept = old.filter(F.col(BUCKET).isin(touched)).join(wanted, key, "left_anti")
    made = kept.unionByName(new.select(*[c for c in old.columns if c != BUCKET]).withColumn(BUCKET, bucket))
    filled = {r[0] for r in made.select(BUCKET).distinct().collect()}
    made.repartition(BUCKET).write.option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).mode("overwrite").parquet(path)
    # A folder that is left without a row is not overwritten, so it goes.
    jvm = spark._jvm
    for b in set(touched) - filled:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return spark.read.schema(old.schema).parquet(path).drop(BUCKET)


def upsert(old: DataFrame, new: DataFrame, key: str, immutable: list[str]) -> DataFrame:
    """Insert or update by key; immutable columns of known rows stay."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    first = lambda c: ("o", "n") if c in immutable else ("n", "o")
    return joined.select(*[F.coalesce(*(F.col(f"{side}.{c}") for side in first(c))).alias(c) for c in old.columns])


#: Parent of each catalog table, and the column by which its rows name it.
PARENTS = {"course": ("semester", "semester_id"), "week": ("course", "course_id"), "resource": ("week", "week_id"), "chunk": ("resource", "resource_id"), "vector": ("chunk", "chunk_id")}


def listing(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit in an order, which should end in a key."""
    return df.orderBy(*order).offset(offset).limit(limit)


def active_courses(courses: DataFrame, semesters: DataFrame, named: int | None = None) -> DataFrame:
    """Courses of the active semester, or of the named one whether it is active or not; none if there is none."""
    wanted = semesters.filter("is_active" if named is None else F.col("semester_id") == named)
    return courses.join(wanted, "semester_id", "left_semi")


def course_closure(tables: dict[str, DataFrame], course: str, vectors: bool = True) -> dict[str, DataFrame]:
    """One course's rows of semester, course, week, resource, chunk and, if wanted, vector. tables: these,
    each with its own key (`<name>_id`; a vector has its chunk's) and its parent's."""
    own = {"course": tables["course"].filter(F.col("course_id") == course)}
    own["semester"] = tables["semester"].join(own["course"], "semester_id", "left_semi")
    own["week"] = tables["week"].filter(F.col("course_id") == course)
    own["resource"] = tables["resource"].filter(F.col("course_id") == course)
    own["chunk"] = tables["chunk"].join(own["resource"], "resource_id", "left_semi")
    if vectors:
        own["vector"] = tables["vector"].join(own["chunk"], "chunk_id", "left_semi")
    return own


def lost_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """tab, key: rows of the catalog tables whose parent is missing; a null key of a parent counts as lost."""
    found = None
    for name, (parent, key) in PARENTS.items():
        if name in tables:
            lost = tables[name].join(tables[parent].select(key).distinct(), key, "left_anti").select(F.lit(name).alias("tab"), F.col(key).cast("string").alias("key"))
            found = lost if found is None else found.unionByName(lost)
    return found


def write_report(report: DataFrame, path: str | None = None) -> DataFrame:
    """Writes JSON to a folder that must not exist, and reads it back."""
    spark = report.sparkSession
    path = path or f"{shared_dir(spark)}/lectern-report-{uuid.uuid4().hex}"
    report.write.mode("errorifexists").json(path)
    return spark.read.schema(report.schema).json(path)
