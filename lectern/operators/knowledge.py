"""Knowledge items: math masking, prompt batches, grounding, reviews and week summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text, vectors
from lectern.operators.pages import FORMULA_RISKS

#: An operand, and expressions that count as mathematics.
ATOM = r"(?:[0-9]+(?:\.[0-9]+)?|[A-Za-zα-ωΑ-Ω][A-Za-z0-9α-ωΑ-Ω]*|\([^()\n]{1,80}\)|\{[^{}\n]{1,80}\})"
MATH = (
    ATOM + r"(?:\s*[=^_+*/−×÷<>≤≥⊕⊗±∓≠≈≡→←↔⇒⇔-]\s*" + ATOM + r")+"
    r"|\\[A-Za-z]+(?:\{[^{}\n]{0,80}\})*"
    r"|[A-Za-z0-9α-ωΑ-Ω]+[⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]+"
    r"|[√∑∏∫][A-Za-z0-9α-ωΑ-Ω(){}]*"
)
#: What stands for masked mathematics, hyphenated words that are none, and signs that are named.
OMITTED = "[MATHEMATICAL EXPRESSION OMITTED — PDF layout is unreliable]"
HYPHENATED = r"[A-Za-z]{2,}(?:-[A-Za-z]{2,})+"
NAMED_SIGN = r"(?:sign|symbol|delimiter)\s*=\s*(?:to|for|as|in|is)"
#: Characters next to mathematics that belong to it.
ADJACENT = r"[a-zA-Z0-9α-ρσ-ω(){}\[\]^_+\-=*/−×÷<>≤≥]"
#: Mathematics never crosses a line; these are the line ends, and white space without them.
_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
_BLANK = r"[ \t\x1f\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
MATH_IN_LINE = MATH.replace(r"\s", _BLANK).replace(r"\n", _BREAKS)
#: Private-use characters, of which masked text has none, around what was found.
OPEN, CLOSE = "\ue000", "\ue001"
GROWN = f"{ADJACENT}*(?:{OPEN}[^{CLOSE}]*{CLOSE}{ADJACENT}*)+"
#: The same matches without going back: what may follow an operand, a blank or a mark is in none of them. A match that
#: begins with a letter behind a letter would have begun there, unless the last one ended between them.
_LETTER = "A-Za-zα-ωΑ-Ω"
_FIRST = f"(?:\\G|(?<![{_LETTER}])|(?![{_LETTER}]))"


def _fast(mathematics: str, blank: str) -> str:
    own = mathematics.replace("[0-9]+(?:\\.[0-9]+)?", "[0-9]++(?:\\.[0-9]++)?+").replace("[A-Za-z0-9α-ωΑ-Ω]*|", "[A-Za-z0-9α-ωΑ-Ω]*+|")
    return _FIRST + "(?:" + own.replace(blank + "*", blank + "*+").replace("[A-Za-z0-9α-ωΑ-Ω]+[⁰", "[A-Za-z0-9α-ωΑ-Ω]++[⁰") + ")"


_MATH_FAST, _MATH_ANYWHERE = _fast(MATH_IN_LINE, _BLANK), _fast(MATH, r"\s")
#: Characters of which all mathematics has one, as a class that is quick to match: any that are not Latin count.
_MATH_SIGN = r"[=^_+*/<>\\±×÷¹²³\x{100}-\x{10ffff}-]"
_GROWN_FAST = f"{ADJACENT}*+(?:{OPEN}[^{CLOSE}]*+{CLOSE}{ADJACENT}*+)++"


def mask_math(chunks: DataFrame) -> DataFrame:
    """chunks: doc_id, page_number, content, warned. Adds masked and n_masked. Unreadable symbols are masked
    everywhere; on warned pages mathematics is marked, marks on hyphenated words and on masked symbols are
    taken back, and what is left is replaced with all that touches it."""
    content = F.coalesce("content", F.lit(""))
    readable = text.mask_unreadable(content)
    marked = F.regexp_replace(readable, _MATH_FAST, f"{OPEN}$0{CLOSE}")
    marked = F.regexp_replace(marked, f"{OPEN}({HYPHENATED}){CLOSE}", "$1")
    marked = F.regexp_replace(marked, rf"\[{OPEN}(UNREADABLE_SYMBOL){CLOSE}\]", "[$1]")
    marked = F.regexp_replace(marked, rf"{OPEN}([^{CLOSE}]*\[UNREADABLE_SYMBOL\][^{CLOSE}]*){CLOSE}", "$1")
    grown = f"(?<!{ADJACENT}){_GROWN_FAST}"  # from the first character on
    found = chunks.select("doc_id", F.col("page_number").cast("int").alias("page_number"), "warned", readable.alias("readable"), text.unreadable_count(content).cast("long").alias("n"), marked.alias("marked"))
    return found.select(
        "doc_id", "page_number", F.when(F.col("warned"), F.regexp_replace("marked", grown, OMITTED)).otherwise(F.col("readable")).alias("masked"),
        F.when(F.col("warned"), F.col("n") + F.regexp_count("marked", F.lit(grown))).otherwise(F.col("n")).alias("n_masked"),
    )


#: More halvings than any text needs: 2^24 times the limit.
_HALVINGS = 24


def prompt_batches(chunks: DataFrame, limit: int = 12_000, most: int = 20) -> DataFrame:
    """chunks: chunk_id, doc_id, page_number, chunk_index, content, warnings. Ordered chunks packed into batches
    whose JSON has at most `limit` characters; a chunk that alone is longer is halved until it fits (one
    character that does not fit stays). n_json: characters of a part's JSON. More than `most` batches are flagged
    by `too_many`. Sizes and cuts are worked out within the row; of a document only its parts' sizes meet."""
    frame = len('{"chunks":[]}')
    content = F.coalesce("content", F.lit(""))
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    label = F.concat(F.lit("[CHUNK_ID="), show("chunk_id"), F.lit(" | PAGE="), show("page_number"), F.lit("]"))
    fields = [F.col("chunk_id").alias("source_chunk_id"), F.col("doc_id").alias("resource_id"), "page_number", "chunk_index", F.lit("").alias("content"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), label.alias("label")]
    rows = chunks.select("chunk_id", "doc_id", "chunk_index", content.alias("content"), F.length(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})).alias("own"))
    too_long = lambda x: (F.length(x) >= 2) & (frame + F.col("own") + text.json_length(x) > limit)
    halves = lambda x: F.array(F.substring(x, F.lit(1), F.floor(F.length(x) / 2).cast("int")), F.substring(x, F.floor(F.length(x) / 2).cast("int") + 1, F.length(x)))
    once = lambda parts: F.flatten(F.transform(parts, lambda x: F.when(too_long(x), halves(x)).otherwise(F.array(x))))
    cut = F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), F.array("content"), lambda parts, _: F.when(F.exists(parts, too_long), once(parts)).otherwise(parts))
    pieces = rows.select("chunk_id", "doc_id", "chunk_index", "own", F.posexplode(F.when(too_long(F.col("content")), cut).otherwise(F.array("content"))).alias("part", "piece"))
    sized = pieces.select("doc_id", F.struct("chunk_index", "chunk_id", "part", F.length("piece").cast("long").alias("n_chars"), (F.col("own") + text.json_length(F.col("piece"))).cast("long").alias("n_json")).alias("row"))
    room = limit - frame + 1  # each part has a comma, which the first has no need of
    begin = F.struct(F.lit(0).cast("long").alias("room"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, row: Column) -> Column:
        new = (F.size(state["starts"]) == 0) | (row["n_json"] + 1 > state["room"])
        left = F.when(new, F.lit(room)).otherwise(state["room"]) - row["n_json"] - 1
        return F.struct(left.cast("long").alias("room"), (state["i"] + 1).alias("i"), F.when(new, F.array_append(state["starts"], state["i"])).otherwise(state["starts"]).alias("starts"))

    grouped = sized.groupBy("doc_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    packed = grouped.withColumn("starts", F.aggregate("rows", begin, step, lambda state: state["starts"]))
    stop = lambda b: F.coalesce(F.get("starts", b + 1), F.size("rows"))
    batches = F.transform("starts", lambda start, b: F.transform(F.slice("rows", start + 1, stop(b) - start), lambda r: F.struct(b.alias("batch"), r.alias("r"))))
    out = packed.select("doc_id", (F.size("starts") > most).alias("too_many"), F.explode(F.flatten(batches)).alias("x"))
    return out.select("doc_id", F.col("x.batch").alias("batch"), F.col("x.r.chunk_index").alias("chunk_index"), F.col("x.r.part").alias("part"), F.col("x.r.n_chars").alias("n_chars"), F.col("x.r.n_json").alias("n_json"), "too_many")


def merge_items(items: DataFrame, most_questions: int = 5) -> DataFrame:
    """doc_id, category, place, item: the items of a document's batches, each once and where it came first, five
    questions at most. items: doc_id, batch, pos, category, item (its whole JSON)."""
    first = items.groupBy("doc_id", "category", "item").agg(F.min(F.struct("batch", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("first"))
    return first.withColumn("place", place).filter((F.col("category") != "questions") | (F.col("place") <= most_questions)).select("doc_id", "category", "place", "item")


def merge_texts(outputs: DataFrame) -> DataFrame:
    """doc_id, topic, overview: those of a document's batches that are not empty, each once, in order, an empty line
    between two. outputs: doc_id, batch, topic, overview."""
    own = outputs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("batch", "topic", "overview"))).alias("own"))
    joined = lambda c: F.array_join(F.array_distinct(F.filter(F.transform("own", lambda o: o[c]), lambda x: x != "")), "\n\n")
    return own.select("doc_id", joined("topic").alias("topic"), joined("overview").alias("overview"))


#: Categories whose bad citations are dropped; those of others fail the batch.
DROPPED = ["examples", "exam_focus"]


def ground(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """items: item_id, doc_id, category, ids (cited chunk_ids), source_pages, formula, name, body; chunks: chunk_id,
    doc_id, page_number, content, warnings. Adds outcome (keep, reduce, drop, fail) and reason of each item. A formula
    whose column `reliable`, if there is one, is not true is dropped. An
    item with symbols that its sources lack is dropped; a concept whose name is safe is reduced to it and to
    what else is safe (here, if `also`, a second text, is). Columns name, body and also may be missing or null."""
    for column in ("name", "body", "also"):
        items = items if column in items.columns else items.withColumn(column, F.lit(None).cast("string"))
    if "reliable" not in items.columns:
        items = items.withColumn("reliable", F.lit(True))
    # what is told of a chunk is worked out once, however many items cite it
    unreadable = _unreadable(F.col("content"))
    told = chunks.select(F.col("doc_id").alias("d"), "chunk_id", "page_number", "content", "warnings", unreadable.alias("unreadable"))
    trusted = ~F.arrays_overlap("warnings", F.array(*map(F.lit, FORMULA_RISKS))) & ~F.col("unreadable") & ~text.malformed_math(F.col("content"))
    told = told.select("d", "chunk_id", "page_number", "content", "unreadable", trusted.alias("trusted"))
    long = items.select("item_id", "doc_id", F.explode_outer("ids").alias("cited"))
    found = long.join(told, (F.col("cited") == F.col("chunk_id")) & (F.col("doc_id") == F.col("d")), "left")
    known = found.groupBy("item_id").agg(
        F.count_if(F.col("chunk_id").isNull()).alias("missing"),
        F.array_sort(F.collect_set("page_number")).alias("real_pages"),
        F.bool_and("trusted").alias("sources_ok"),
        F.bool_or("unreadable").alias("unreadable"),
        F.collect_list(F.when(F.col("content").isNotNull(), F.struct("content", "trusted"))).alias("sources"),
    )
    joined = items.join(known, "item_id", "left")
    contents = F.transform("sources", lambda s: s["content"])
    reliable = F.transform(F.filter("sources", lambda s: s["trusted"]), lambda s: s["content"])
    unsafe = lambda c: F.coalesce(unsafe_symbols(F.col(c), contents, reliable, F.col("unreadable")), F.lit(False))
    ids_ok = (F.size("ids") > 0) & (F.size(F.array_distinct("ids")) == F.size("ids")) & (F.col("missing") == 0)
    pages_ok = (F.array_sort(F.array_distinct("source_pages")) == F.col("real_pages")) & (F.size(F.array_distinct("source_pages")) == F.size("source_pages"))
    literal = F.exists("sources", lambda s: F.contains(s["content"], F.col("formula")))
    formula_ok = F.coalesce(F.col("sources_ok"), F.lit(False)) & F.coalesce(F.col("reliable"), F.lit(False)) & (F.trim("formula") != "") & literal
    cue = F.exists("sources", lambda s: text.exam_cue(s["content"]))
    bad = F.when(~F.coalesce(ids_ok, F.lit(False)), "ids").when(~F.coalesce(pages_ok, F.lit(False)), "pages")
    reason = (
        F.when(bad.isNotNull(), bad).when((F.col("category") == "formulas") & ~F.coalesce(formula_ok, F.lit(False)), "formula")
        .when(unsafe("name") | unsafe("body") | unsafe("also"), "symbols").when((F.col("category") == "exam_focus") & ~F.coalesce(cue, F.lit(False)), "cue")
    )
    # a column of its own, as what is left of an item is only asked of those that fail by their symbols
    reasoned = joined.select("item_id", "doc_id", "category", "name", "body", "also", "sources", "unreadable", reason.alias("reason"))
    left = F.coalesce((F.trim("also") != "") & ~unsafe("also"), F.lit(False)) | F.coalesce((F.trim("body") != "") & ~unsafe("body"), F.lit(False))
    reduced = (F.col("category") == "concepts") & ~unsafe("name") & left
    fails = F.col("reason").isin("ids", "pages") & ~F.col("category").isin(DROPPED)
    outcome = F.when(F.col("reason").isNull(), "keep").when((F.col("reason") == "symbols") & reduced, "reduce").when(fails, "fail").otherwise("drop")
    return reasoned.select("item_id", "doc_id", "category", outcome.alias("outcome"), "reason")


def unsafe_symbols(body: Column, contents: Column, reliable: Column | None = None, unreadable: Column | None = None) -> Column:
    """Whether a text has unreadable or malformed symbols, or mathematics or operators that none of its
    reliable sources (all contents, if they are not given) has literally. unreadable: whether any of the contents is, if
    that is known. The sources are looked at only for what was found, and made bare once for all of it."""
    reliable = contents if reliable is None else reliable
    unreadable = F.exists(contents, _unreadable) if unreadable is None else unreadable
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    nowhere = lambda x, y: ~F.exists(y, lambda c: F.contains(c, x))
    prose = lambda x: x.rlike(f"^(?:{HYPHENATED}|{NAMED_SIGN})$")
    missed = lambda marks, y: (F.size(marks) > 0) & vectors.let(y, lambda z: F.exists(marks, lambda x: nowhere(x, z)))
    mathematics = F.when(body.rlike(_MATH_SIGN), F.regexp_extract_all(body, F.lit(_MATH_ANYWHERE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.filter(mathematics, lambda x: ~prose(x))
    unfounded = vectors.let(F.transform(found, bare), lambda marks: missed(marks, F.transform(reliable, bare)))
    signs = lambda pattern: F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    operators = r"[\p{Sm}&&[^\x00-\x7f]]"
    alone = vectors.let(F.when(unreadable, signs(r"[=^+/*]|" + operators)).otherwise(signs(operators)), lambda marks: missed(marks, reliable))
    return _unreadable(body) | text.malformed_math(body) | unfounded | alone


def _unreadable(x: Column) -> Column:
    return (text.unreadable_count(x) > 0) | F.contains(x, F.lit(text.UNREADABLE))


def attach_evidence(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, evidence: the true content of each cited chunk in the order of citation."""
    long = items.select("item_id", F.posexplode("ids").alias("pos", "chunk_id"))
    own = F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "page_number", F.col("content").alias("quote"))))
    return long.join(chunks.select("chunk_id", "page_number", "content"), "chunk_id").groupBy("item_id").agg(own.alias("evidence"))


def review_jobs(items: DataFrame, fields: list[str]) -> DataFrame:
    """One claim for each field that is not empty; claims of equal source lists share a job."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("claim")) for f in fields]))
    claims = items.select("doc_id", "category", "idx", "ids", each.alias("x")).filter(F.trim("x.claim") != "")
    job = F.md5(F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))))
    return claims.select("doc_id", F.concat_ws(".", "category", F.col("idx").cast("string"), "x.field").alias("claim_id"), "x.claim", job.alias("job"))


def apply_review(items: DataFrame, decisions: DataFrame, fields: list[str], required: list[str]) -> DataFrame:
    """decisions: doc_id, claim_id, supported. Fields that are not supported become empty; items without
    any of the required fields go. Adds outcome: accepted, reduced or rejected."""
    out = items
    for f in fields:
        own = decisions.select(F.col("doc_id").alias("_d"), F.col("claim_id").alias("_c"), F.col("supported").alias(f"_{f}"))
        out = out.join(own, (F.col("doc_id") == F.col("_d")) & (F.concat_ws(".", "category", F.col("idx").cast("string"), F.lit(f)) == F.col("_c")), "left").drop("_d", "_c")
    blank = [((F.trim(f) != "") & ~F.coalesce(F.col(f"_{f}"), F.lit(False))) for f in fields]
    for f, b in zip(fields, blank, strict=True):
        out = out.withColumn(f"_new_{f}", F.when(b, F.lit("")).otherwise(F.col(f)))
    kept = F.array_contains(F.array(*[F.trim(f"_new_{f}") != "" for f in required]), True)
    changed = F.array_contains(F.array(*[F.col(f"_new_{f}") != F.col(f) for f in fields]), True)
    outcome = F.when(~kept, "rejected").when(changed, "reduced").otherwise("accepted")
    return out.select("doc_id", "category", "idx", *[F.col(f"_new_{f}").alias(f) for f in fields], outcome.alias("outcome"))


def counters(outcomes: DataFrame, names: list[str]) -> DataFrame:
    """How many items of each category had each outcome."""
    return outcomes.groupBy("category").agg(*[F.count_if(F.col("outcome") == n).alias(n) for n in names])


def week_summary(items: DataFrame) -> DataFrame:
    """items: course_id, week_id, resource_id, idx, overview, point, pages. The overviews and points of a week
    with their place, a row for each; a week's summary is its rows in the order of (resource_id, idx), so that
    no task gathers a week."""
    cited = F.concat("point", F.lit(" [Resource "), F.col("resource_id").cast("string"), F.lit(", pages "), F.array_join(F.transform("pages", lambda x: x.cast("string")), ", "), F.lit("]"))
    return items.select("course_id", "week_id", "resource_id", "idx", "overview", cited.alias("point"))


def invalidate(items: DataFrame, resources: DataFrame, updated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What updated documents (doc_id) leave valid: the concepts of all others, and the summaries of the weeks that
    have one, rebuilt from their other documents. items: as for week_summary, with doc_id and category;
    resources: doc_id, course_id, week_id."""
    others = items.join(updated, "doc_id", "left_anti")
    weeks = resources.join(updated, "doc_id", "left_semi").select("course_id", "week_id").distinct()
    own = others.join(resources, "doc_id").join(weeks, ["course_id", "week_id"], "left_semi")
    return others.filter("category = 'concepts'"), week_summary(own.withColumn("resource_id", F.col("doc_id")))


def topic_overview(items: DataFrame, limit: int = 6000, most: int = 6) -> DataFrame:
    """items: doc_id, idx, name, point. topic: the first distinct names; overview: the first points as long
    as they fit together."""
    own = F.array_sort(F.collect_list(F.struct("idx", "name", "point")))
    made = items.groupBy("doc_id").agg(own.alias("own"))
    points = F.slice(F.transform("own", lambda x: x["point"]), 1, most)
    joined = F.aggregate(points, F.lit(""), lambda a, x: F.when(F.length(a) + F.length(x) + 1 <= limit, F.when(a == "", x).otherwise(F.concat(a, F.lit(" "), x))).otherwise(a))
    return made.select("doc_id", F.array_join(F.slice(F.array_distinct(F.transform("own", lambda x: x["name"])), 1, most), "; ").alias("topic"), joined.alias("overview"))


def batch_conflicts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """chunk_id, problem: chunks of a prompt that are not stored, or are of another document or page there. Both:
    chunk_id, doc_id, page_number."""
    b, o = batch.alias("b"), stored.alias("o")
    joined = b.join(o, F.col("b.chunk_id") == F.col("o.chunk_id"), "left")
    problem = F.when(F.col("o.chunk_id").isNull(), "missing").when(~F.col("b.doc_id").eqNullSafe(F.col("o.doc_id")), "document").when(~F.col("b.page_number").eqNullSafe(F.col("o.page_number")), "page")
    return joined.select("b.chunk_id", problem.alias("problem")).filter("problem IS NOT NULL")


def projection(items: DataFrame) -> DataFrame:
    """kind, doc_id, idx, name, text, source_page: a document's concepts and questions as rows, with their first page. items:
    doc_id, category, idx, name, body, source_pages."""
    kind = F.when(F.col("category") == "concepts", "concept").when(F.col("category") == "questions", "question")
    return items.withColumn("kind", kind).filter("kind IS NOT NULL").select("kind", "doc_id", "idx", "name", F.col("body").alias("text"), F.try_element_at("source_pages", F.lit(1)).alias("source_page"))


def week_view(items: DataFrame, resources: DataFrame) -> DataFrame:
    """course_id, week_id, category, doc_id, idx, text, pages, links: what a week shows, in the order of (category, doc_id,
    idx). Formulas that are not reliable are left out; pages are the distinct ones above zero, each with a link to its file
    if there is one. items: doc_id, category, idx, text, source_pages, reliable; resources: doc_id, course_id, week_id, path."""
    own = items.filter((F.col("category") != "formulas") | F.coalesce(F.col("reliable"), F.lit(False))).join(resources.select("doc_id", "course_id", "week_id", "path"), "doc_id")
    pages = F.array_sort(F.array_distinct(F.filter("source_pages", lambda p: p > 0)))
    link = lambda p: F.concat(F.lit("/api/resources/"), F.col("doc_id").cast("string"), F.lit("/file#page="), p.cast("string"))
    none = F.array().cast("array<string>")
    return own.withColumn("pages", pages).select("course_id", "week_id", "category", "doc_id", "idx", "text", "pages", F.when(F.col("path").isNotNull(), F.transform("pages", link)).otherwise(none).alias("links"))
