"""Evaluation of retrieval and classification, audits and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text


def hit_at_k(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: questions, resolved, resource_hit_k and evidence_hit_k. hits: item_id, rank, doc_id,
    page_number; gold: item_id, expected, pages (null: not resolved, so not part of the evidence figures)."""
    joined = gold.join(hits, "item_id", "left")
    right = F.col("doc_id") == F.col("expected")
    best = joined.groupBy("item_id").agg(F.min(F.when(right, F.col("rank"))).alias("r"), F.min(F.when(right & F.array_contains("pages", F.col("page_number")), F.col("rank"))).alias("e"), F.bool_or(F.col("pages").isNotNull()).alias("resolved"))
    part = lambda c, k, n: F.round(F.count_if(F.col(c) <= k) / F.nullif(n, F.lit(0)), 6)
    questions, resolved = F.count(F.lit(1)), F.count_if("resolved")
    return best.agg(questions.alias("questions"), resolved.alias("resolved"), *[part("r", k, questions).alias(f"resource_hit_{k}") for k in ks], *[part("e", k, resolved).alias(f"evidence_hit_{k}") for k in ks])


def compare_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, regressed of the metrics that differ between two one-row reports."""
    metrics = [c for c in before.columns if "_hit_" in c]
    long = lambda df, name: df.unpivot([], metrics, "metric", name)
    joined = long(before, "before").join(long(after, "after"), "metric")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn("regressed", F.col("after") < F.col("before"))


def question_report(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """A row for each question: item_id, question, course_id, expected, pages, and whether its document
    (resource_hit_at_k) and one of its pages (evidence_hit_at_k; null without pages) are among the first k."""
    right = F.col("doc_id") == F.col("expected")
    ranks = gold.select("item_id", "expected", "pages").join(hits, "item_id").groupBy("item_id").agg(
        F.min(F.when(right, F.col("rank"))).alias("r"), F.min(F.when(right & F.array_contains("pages", F.col("page_number")), F.col("rank"))).alias("e"))
    within = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    flags = [within("r", k).alias(f"resource_hit_at_{k}") for k in ks] + [F.when(F.col("pages").isNotNull(), within("e", k)).alias(f"evidence_hit_at_{k}") for k in ks]
    return gold.join(ranks, "item_id", "left").select("item_id", *GOLD, *flags)


GOLD = ["question", "course_id", "expected", "pages"]


def pair_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """item_id, metric, before, after, regressed of every question's metrics that differ between two question
    reports. It is an error if a question is in one report only, or their gold differs."""
    metrics = [c for c in before.columns if "_hit_at_" in c]
    b, a = before.alias("b"), after.alias("a")
    same = F.col("b.item_id").isNotNull() & F.col("a.item_id").isNotNull()
    for c in GOLD:
        same &= F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    both = b.join(a, F.col("b.item_id") == F.col("a.item_id"), "full_outer")
    alike = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("the gold of the two reports differs")).cast("boolean"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").alias("before"), F.col(f"a.{m}").alias("after")) for m in metrics]))
    return both.select(alike.alias("alike"), F.col("b.item_id"), each.alias("x")).filter("alike AND x.before <> x.after").select("item_id", "x.*").withColumn("regressed", F.col("before") & ~F.col("after"))


def label_accuracy(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """expected (null: all), total, correct, accuracy of expected and predicted; a label without rows has no
    accuracy."""
    got = rows.groupingSets([[], ["expected"]], "expected").agg(F.grouping("expected").alias("g"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("expected") == F.col("predicted")).alias("correct"))
    wanted = labels.select("expected", F.lit(0).alias("g")).unionByName(labels.sparkSession.createDataFrame([(None, 1)], labels.select("expected", F.lit(0).alias("g")).schema))
    w, o = wanted.alias("w"), got.alias("o")
    joined = w.join(o, F.col("w.expected").eqNullSafe(F.col("o.expected")) & (F.col("w.g") == F.col("o.g").cast("int")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("w.expected", F.coalesce("total", zero).alias("total"), F.coalesce("correct", zero).alias("correct"), F.round(F.col("correct") / F.nullif(F.col("total"), zero), 6).alias("accuracy"))


def violations(df: DataFrame, rule: str, bad: Column, key: str) -> DataFrame:
    """rule, key of rows that break a rule."""
    return df.filter(bad).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counted.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"))


def digest(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by, n, total, mixed: how many rows there are, and the sum and the exclusive or of their hashes (60 bits of the SHA-256
    of their canonical JSON). Needs no order and gathers no rows; digests of parts add up. Equal rows count as
    often as they occur, as the sum has them each time."""
    row = F.conv(F.substring(F.sha2(text.canonical_json(**{c: F.col(c) for c in columns}), 256), 1, 15), 16, 10)
    hashed = df.select(*by, row.cast("decimal(20,0)").alias("h"), row.cast("long").alias("b"))
    return hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("h").cast("decimal(38,0)"), F.lit(0)).cast("string").alias("total"), F.coalesce(F.bit_xor("b"), F.lit(0)).cast("string").alias("mixed"))


def add_digests(parts: DataFrame, by: list[str]) -> DataFrame:
    """The digest of tables by those of their parts."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).cast("decimal(38,0)").cast("string").alias("total"), F.bit_xor(F.col("mixed").cast("long")).cast("string").alias("mixed"))


def same_digest(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, equal: whether two tables of the same columns have the same rows, in any order."""
    columns = sorted(a.columns)
    both = digest(a, [], columns).unionByName(digest(b, [], columns))  # two rows
    return both.agg((F.countDistinct("n", "total", "mixed") == 1).alias("equal"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each side has beyond the other's (both 0 if they are equal)."""
    left, right = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_a")), b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_b"))
    return left.join(F.broadcast(right))  # one row each


def id_coverage(expected: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """key, problem: ids that are missing, unknown or decided twice."""
    n = decided.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    e, d = expected.select(key).distinct().alias("e"), n.alias("d")
    joined = e.join(d, F.col(f"e.{key}") == F.col(f"d.{key}"), "full_outer")
    problem = F.when(F.col(f"d.{key}").isNull(), "missing").when(F.col(f"e.{key}").isNull(), "unknown").when(F.col("n") > 1, "repeated")
    return joined.select(F.coalesce(f"e.{key}", f"d.{key}").alias(key), problem.alias("problem")).filter("problem IS NOT NULL")


def bad_gold(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """item_id, problem: gold whose document is not in the course or lacks expected pages. gold: item_id,
    course_id, expected, pages; pages: doc_id, course_id, page_number."""
    known = pages.groupBy("doc_id", "course_id").agg(F.collect_set("page_number").alias("has"))
    joined = gold.join(known, (F.col("expected") == F.col("doc_id")) & (gold["course_id"] == known["course_id"]), "left")
    problem = F.when(F.col("has").isNull(), "document").when(F.size(F.array_except("pages", "has")) > 0, "pages")
    return joined.select("item_id", "expected", problem.alias("problem")).filter("problem IS NOT NULL")


def bad_questions(gold: DataFrame, id_column: str = "item_id") -> DataFrame:
    """item_id, problem: questions of a retrieval gold that cannot be used. gold: item_id, question, expected, pages (null
    for unresolved, else unique and positive)."""
    pages = F.col("pages").isNotNull() & (F.exists("pages", lambda p: p.isNull() | (p <= 0)) | (F.size(F.array_distinct("pages")) != F.size("pages")))
    problem = (
        F.when(F.coalesce(~F.col("question").rlike(r"[^\s\p{Z}]"), F.lit(True)), "question").when(F.length("question") > 4000, "length")
        .when(F.coalesce(F.col(id_column) <= 0, F.lit(True)), "id").when(F.coalesce(F.col("expected") <= 0, F.lit(True)), "expected").when(pages, "pages")
    )
    return gold.select(F.col(id_column).alias("item_id"), problem.alias("problem")).filter("problem IS NOT NULL")


def bad_samples(gold: DataFrame, labels: list[str]) -> DataFrame:
    """sample_id, problem: samples of a classification gold whose id is blank or repeated, or whose label is none."""
    n = gold.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("expected").isin(labels), F.lit(False))).alias("labelled"))
    problem = F.when(F.coalesce(~F.col("sample_id").rlike(r"[^\s\p{Z}]"), F.lit(True)), "id").when(F.col("n") > 1, "repeated").when(~F.col("labelled"), "label")
    return n.select("sample_id", problem.alias("problem")).filter("problem IS NOT NULL")
