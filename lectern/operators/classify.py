"""Roles and kinds of materials by rules over their metadata and opening text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text

#: Metadata fields and how much they count.
PRIORITIES = {"filename": 12, "display_name": 12, "item_title": 10, "link_text": 10, "page_title": 8, "module_title": 4, "nearby_text": 2}
#: Words of each role. Purpose words speak for "other".
PURPOSE = r"\b(?:assignments?|assessments?|homework|readings?|syllabus|course outline|projects?|exams?|rubrics?|announcements?|reference materials?)(?:\d+)?\b"
STRONG = {"lecture": r"\b(?:lectures?|lec)\b", "tutorial": r"\b(?:tutorials?|tut)\b"}
WEAK = {"lecture": r"\b(?:slides?|presentation|topic overview|concepts)\b", "tutorial": r"\b(?:exercises?|worksheets?|practice|solutions?|answers?|labs?|practicals?|workshops?)\b"}
#: Headings that give a role away.
HEADINGS = {
    "lecture": r"^(?:(?:week|module) \d+ )?lecture(?: slides?)?\b",
    "tutorial": r"^(?:(?:week|module) \d+ )?(?:tutorial|exercises?|questions|solutions?|worked examples?|workshop|practical)\b",
    "other": r"^(?:assignment|assessment|reading|project|exam|rubric|course outline|syllabus)\b",
}
LECTURE_MARKERS = ["learning objectives", "topic introduction", "overview"]
ROLES = ["lecture", "tutorial", "other"]

#: Why a role was decided: for sure, less so, and not.
REASONS = ["Direct role evidence.", "Low-strength or competing role evidence; review or fallback needed.", "Weak or conflicting role evidence."]


def role_signals(materials: DataFrame) -> DataFrame:
    """material_id, weight, role: distinct signals of the metadata fields (column `metadata`, a map)."""
    long = materials.select("material_id", F.explode("metadata").alias("field", "value")).withColumn("t", text.normalize_words(F.col("value")))
    p = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in PRIORITIES.items()])
    rules = [(F.col("t").rlike(PURPOSE), F.greatest(F.lit(5), p - 1), "other")]
    rules += [(F.col("t").rlike(r), p, role) for role, r in STRONG.items()]
    rules += [(F.col("t").rlike(r), F.when(p >= 8, 3).otherwise(1), role) for role, r in WEAK.items()]
    found = F.array_compact(F.array(*[F.when(hit & p.isNotNull(), F.struct(w.cast("int").alias("weight"), F.lit(role).alias("role"))) for hit, w, role in rules]))
    return long.select("material_id", F.explode(found).alias("s")).select("material_id", "s.weight", "s.role").distinct()


def merge_evidence(signals: DataFrame) -> DataFrame:
    """material_id, evidence: the union of all signals, in order."""
    return signals.groupBy("material_id").agg(F.array_sort(F.collect_set(F.struct("weight", "role"))).alias("evidence"))


def role_scores(signals: DataFrame) -> DataFrame:
    """material_id and the score of each role: the top weight, and one more for a second one."""
    top = lambda r: F.max(F.when(F.col("role") == r, F.col("weight")))
    more = lambda r: F.when(F.countDistinct(F.when(F.col("role") == r, F.col("weight"))) > 1, 1).otherwise(0)
    made = signals.groupBy("material_id").agg(
        *[F.coalesce(top(r) + more(r), F.lit(0)).alias(r) for r in ROLES],
        F.bool_or((F.col("weight") >= 8) & F.col("role").isin("lecture", "tutorial")).alias("direct"),
        F.collect_set(F.when(F.col("weight") == 2, F.col("role"))).alias("twos"),
    )
    return made.withColumn("other", F.when(F.col("direct"), F.least("other", F.lit(6))).otherwise(F.col("other")))


def role_decision(materials: DataFrame) -> DataFrame:
    """material_id, role, confidence, reason of every material, also of those without any signal."""
    scores = role_scores(role_signals(materials))
    ranked = F.array_sort(F.array(*[F.struct((-F.col(r)).alias("s"), F.lit(i).alias("i"), F.lit(r).alias("role")) for i, r in enumerate(ROLES)]))
    s = scores.withColumn("ranked", ranked).withColumn("winner", F.col("ranked")[0]["role"]).withColumn("strength", -F.col("ranked")[0]["s"])
    s = s.withColumn("margin", F.col("strength") + F.col("ranked")[1]["s"])
    supported = ((F.col("strength") >= 4) | F.array_contains("twos", F.col("winner"))) & (F.col("margin") >= 2)
    sure = (F.col("strength") >= 7) & (F.col("margin") >= 3)
    s = s.select(
        "material_id", F.when(supported, F.col("winner")).otherwise("other").alias("role"),
        F.when(supported, F.when(sure, 0.9).otherwise(0.65)).otherwise(F.when(F.col("strength") > 0, 0.2).otherwise(0.0)).alias("confidence"),
        F.when(supported, F.when(sure, REASONS[0]).otherwise(REASONS[1])).otherwise(REASONS[2]).alias("reason"),
    )
    out = materials.select("material_id").join(s, "material_id", "left")
    return out.select("material_id", F.coalesce("role", F.lit("other")).alias("role"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("reason", F.lit(REASONS[2])).alias("reason"))


def content_role(opening: Column) -> Column:
    """The one role that the headings of an opening text name; null if none or several."""
    lines = F.transform(F.filter(F.split(opening, "\n", -1), lambda x: F.length(F.trim(x)) <= 120), lambda x: text.normalize_words(x))
    markers = F.size(F.filter(F.array(*map(F.lit, LECTURE_MARKERS)), lambda m: F.exists(lines, lambda x: F.startswith(x, m))))

    def named(role: str, pattern: str) -> Column:
        hit = F.exists(lines, lambda x: x.rlike(pattern))
        return F.when(hit | (markers >= 2) if role == "lecture" else hit, F.lit(role))

    hits = [named(role, pattern) for role, pattern in HEADINGS.items()]
    roles = F.array_compact(F.array(*hits))
    return F.when(F.size(roles) == 1, F.get(roles, 0))


def cascade(decided: DataFrame, high: float = 0.8) -> DataFrame:
    """material_id, role, method: columns manual, role, confidence, content, external, external_confidence. The
    first sure answer counts: manual, metadata, content, external, else the metadata's."""
    role = F.coalesce("manual", F.when(F.col("confidence") >= high, F.col("role")), F.col("content"), F.when(F.col("external_confidence") >= high, F.col("external")), F.col("role"))
    method = (
        F.when(F.col("manual").isNotNull(), "manual").when(F.col("confidence") >= high, "metadata").when(F.col("content").isNotNull(), "document_content")
        .when(F.col("external_confidence") >= high, "external").otherwise("metadata")
    )
    return decided.select("material_id", role.alias("role"), method.alias("method"))


def material_kind(materials: DataFrame, phrases: dict[str, list[str]]) -> DataFrame:
    """material_id, kind, reasons: READING before CORE before UNKNOWN, by whole phrases with an optional
    plural; the first 12 reasons of the kind, by field, then kind and phrase in the order given."""
    rules = [(kind, p) for kind, ps in phrases.items() for p in ps]
    long = materials.select("material_id", F.posexplode("fields").alias("fi", "f")).select("material_id", "fi", "f.field", text.normalize_words(F.col("f.value")).alias("t"))
    hit = [F.when(F.col("t").rlike(rf"\b{p}{'' if p.endswith('s') else 's?'}\b"), F.struct(F.col("fi"), F.lit(i).alias("ri"), F.lit(kind).alias("kind"), F.concat("field", F.lit(f":{p}")).alias("reason"))) for i, (kind, p) in enumerate(rules)]
    found = long.select("material_id", F.explode(F.array_compact(F.array(*hit))).alias("h")).groupBy("material_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    return materials.select("material_id").join(found, "material_id", "left").select("material_id", *combine_kind(F.coalesce("hs", F.array().cast("array<struct<fi:int,ri:int,kind:string,reason:string>>"))))


def combine_kind(hits: Column) -> list[Column]:
    kind = F.when(F.exists(hits, lambda h: h["kind"] == "READING"), "READING").when(F.exists(hits, lambda h: h["kind"] == "CORE"), "CORE").otherwise("UNKNOWN")
    reasons = F.slice(F.array_distinct(F.transform(F.filter(hits, lambda h: h["kind"] == kind), lambda h: h["reason"])), 1, 12)
    return [kind.alias("kind"), F.array_join(reasons, ",").alias("reasons")]


def preview(decided: DataFrame, known: DataFrame, limit: int = 100) -> DataFrame:
    """material_id, before, after, method, confidence of the first resources, changed or not; what was set by hand stays.
    decided: material_id, role, method, confidence; known: material_id, role, manual."""
    first = known.select("material_id", F.col("role").alias("before"), "manual").orderBy("material_id").limit(limit)
    joined = first.join(decided, "material_id")
    kept = lambda own, other: F.when(F.col("manual"), own).otherwise(F.col(other))
    return joined.select("material_id", "before", kept(F.col("before"), "role").alias("after"), kept(F.lit("manual"), "method").alias("method"), kept(F.lit(1.0), "confidence").alias("confidence")).orderBy("material_id")
