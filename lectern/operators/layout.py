"""Layout of pages: shifted spans, margins by place and font, and what is left of a page without them.

spans: doc_id, page_number, line_index, span_index, text, x0, y0, x1, y1, origin_y, size, flags, dir_y; pages: doc_id,
page_number, raw_text, width, height. A line is the spans of one line_index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text

PAGE = ["doc_id", "page_number"]
LINE = [*PAGE, "line_index"]
#: Share of a page's height that is margin, of a document's pages that a margin recurs on, and
#: of the body's font that a margin's may have; the fewest pages; and the step of places that count as equal.
MARGIN, SHARE, FONT, LEAST, STEP = 0.08, 0.7, 0.8, 3, 0.02
#: How much smaller a shifted span is than its neighbour, and between which shares of the
#: neighbour's size its baseline lies off; writing that leans more than this is not horizontal.
SMALLER, OFF, LEAN = 0.85, (0.12, 0.65), 0.05
#: What stands for a page's own number.
NUMBER = "<physical-page-number>"


def _shown(x: Column) -> Column:
    return x.rlike(r"[^\s\p{Z}]")


def neighbours(spans: DataFrame, bin_width: float = 50.0, most: int = 64) -> DataFrame:
    """doc_id, page_number, span, base: smaller spans with their larger neighbours of the same line from whose baseline
    they lie off. Spans meet in bins of x, a base in all that its own size reaches, so that a line with many
    spans is not compared with itself; a pair counts in the first bin that both have."""
    return _near(spans, bin_width, most).select(*PAGE, "span", "base")


def _symbol() -> Column:
    return (~F.col("text").rlike(r"[\p{L}\p{N}]")).alias("symbol")


def _near(spans: DataFrame, bin_width: float = 50.0, most: int = 64) -> DataFrame:
    """neighbours with `symbol` of the span. Only what is smaller than some span of the table can be small, and only what is larger
    than some can be a base; the others stay out of the join."""
    shown = spans.filter(_shown(F.col("text")))
    bounds = F.broadcast(spans.agg(F.min("size").alias("least"), F.max("size").alias("largest")))  # one row
    bin_of = lambda x: F.greatest(F.lit(-1), F.least(F.lit(most), F.floor(x / bin_width))).cast("int")
    reach = lambda name, low, high: F.explode(F.sequence(bin_of(low), F.greatest(bin_of(low), bin_of(high)))).alias(name)
    fit = shown.crossJoin(bounds)
    low, high = F.col("x0") - F.col("size"), F.col("x1") + F.col("size")
    small = fit.filter((F.abs("dir_y") <= LEAN) & (F.col("size") < F.col("largest") * SMALLER)).select(*LINE, F.col("span_index").alias("span"), _symbol(), F.col("x0").alias("s0"), F.col("x1").alias("s1"), F.col("origin_y").alias("sy"), F.col("size").alias("ss"), bin_of(F.col("x0")).alias("sb"), reach("bin", F.col("x0"), F.col("x1")))
    base = fit.filter(F.col("least") < F.col("size") * SMALLER).select(*LINE, F.col("span_index").alias("base"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("origin_y").alias("by"), F.col("size").alias("bs"), bin_of(low).alias("bb"), reach("bin", low, high))
    gap = F.greatest(F.col("b0") - F.col("s1"), F.col("s0") - F.col("b1"), F.lit(0.0))
    off = F.abs(F.col("sy") - F.col("by"))
    near = (F.col("ss") < F.col("bs") * SMALLER) & (gap <= F.col("bs")) & (off >= OFF[0] * F.col("bs")) & (off <= OFF[1] * F.col("bs"))
    return small.join(base, [*LINE, "bin"]).filter((F.col("bin") == F.greatest("sb", "bb")) & (F.col("span") != F.col("base")) & near)


def shifted(spans: DataFrame, **bins) -> DataFrame:
    """doc_id, page_number, span, symbol: spans that lie off a larger neighbour's baseline, or are flagged as
    superscript; symbol: without a letter or digit."""
    flagged = spans.filter(_shown(F.col("text")) & (F.abs("dir_y") <= LEAN) & (F.col("flags").bitwiseAND(1) == 1)).select(*PAGE, F.col("span_index").alias("span"), _symbol())
    return _near(spans, **bins).select(*PAGE, "span", "symbol").unionByName(flagged).distinct()


def body_fonts(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_number, body_font: median size of the spans whose origin lies strictly within the margins."""
    own = spans.filter(_shown(F.col("text"))).join(pages.select(*PAGE, "height"), PAGE)
    body = own.filter((F.col("origin_y") > MARGIN * F.col("height")) & (F.col("origin_y") < (1 - MARGIN) * F.col("height")))
    return body.groupBy(*PAGE).agg(F.median("size").alias("body_font"))


def lines(spans: DataFrame) -> DataFrame:
    """The lines of pages: line_text, place, largest size, whether one of its spans leans, and their indices."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_index", "text"))), lambda x: x["text"]), "")
    made = spans.groupBy(*LINE).agg(
        whole.alias("line_text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max("size").alias("font"),
        F.bool_or(F.abs("dir_y") > LEAN).alias("leans"), F.array_sort(F.collect_list("span_index")).alias("span_indices"))
    return made.withColumn("line_text", F.regexp_replace("line_text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def margin_lines(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines that may be margins: doc_id, page_number, zone, key, x, y (steps of the page), line_text, span_indices,
    times (how often the page has that text). Small type near an edge, 100 characters at most, either the page's own
    number, placed by its right edge, or at least eight characters in two words that are no other number."""
    sized = pages.filter((F.col("width") > 0) & (F.col("height") > 0)).select(*PAGE, "width", "height")
    spans = spans.repartition(*PAGE)  # one exchange for lines and fonts
    counted = lines(spans).withColumn("times", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "line_text")))
    small = counted.join(sized, PAGE).join(body_fonts(spans, pages), PAGE).filter((F.col("font") <= F.col("body_font") * FONT) & ~F.col("leans") & (F.length("line_text").between(1, 100)))
    zone = F.when(F.col("y1") / F.col("height") <= MARGIN, "header").when(F.col("y0") / F.col("height") >= 1 - MARGIN, "footer")
    number = F.regexp_extract("line_text", r"(?i)^(?:Page\s+)?([0-9]+)$", 1)
    is_own = F.coalesce(F.ltrim(number, F.lit("0")) == F.col("page_number").cast("string"), F.lit(False))
    prose = (number == "") & (F.length("line_text") >= 8) & (F.size(F.split("line_text", r"[\s\p{Z}]+")) >= 2)
    key = F.when(is_own, F.lit(NUMBER)).when(prose, F.col("line_text"))
    step = lambda x, of: F.rint(x / F.col(of) / STEP).cast("int")
    placed = small.select(*PAGE, zone.alias("zone"), key.alias("key"), step(F.when(is_own, F.col("x1")).otherwise(F.col("x0")), "width").alias("x"), step(F.col("y0"), "height").alias("y"), "line_text", "span_indices", "times")
    return placed.filter("zone IS NOT NULL AND key IS NOT NULL")


def _often(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """The margin lines that recur in one place on max(3, 70 %) of a document's pages, with n_pages."""
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy("doc_id", "zone", "key", "x", "y")
    found = margin_lines(spans, pages)
    other = ~F.col("page_number").eqNullSafe(F.lag("page_number").over(place.orderBy("page_number")))
    seen = found.withColumn("other", other).withColumn("n_pages", F.count_if("other").over(place))
    need = F.greatest(F.lit(LEAST).cast("double"), F.ceil(F.col("n") * SHARE).cast("double"))
    return seen.join(n, "doc_id").filter(F.col("n_pages") >= need).drop("n", "other")


def repeated_margins(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, zone, key, x, y, n_pages of the margins that recur."""
    return _often(spans, pages).select("doc_id", "zone", "key", "x", "y", "n_pages").distinct()


def strip_margins(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page_number, raw_text, text (cleaned), headers_removed, footers_removed, span_indices (of what was removed).
    A raw line goes if it consists of repeated margins alone and the page has it once; a margin whose text
    the page has in another line too stays. Null raw text is empty."""
    own = _often(spans, pages).filter("times = 1")
    quoted = F.concat(F.lit(r"\Q"), F.replace("line_text", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    found = own.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct((-F.length("line_text")).alias("longest"), quoted.alias("part"), "line_text", "zone", "span_indices"))).alias("margins"))
    one = F.concat(F.lit("(?:"), F.array_join(F.transform("margins", lambda m: m["part"]), "|"), F.lit(")"))
    found = found.withColumn("pattern", F.concat(F.lit(r"(?U)^\s*"), one, F.lit(r"(?:\s+"), one, F.lit(r")*\s*$")))
    raw = F.coalesce("raw_text", F.lit(""))
    joined = pages.select(*PAGE, raw.alias("raw_text")).join(found, PAGE, "left").withColumn("lines", F.split("raw_text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1))
    # A line that goes holds a margin and is the only one of its text, so few are matched and it is told by that text.
    holds = lambda x: F.exists("margins", lambda m: F.contains(x, m["line_text"]))
    once = lambda x: F.size(F.filter("lines", lambda y: y == x)) == 1
    goes = lambda x: F.when(holds(x), F.when(once(x), F.coalesce(F.regexp_like(x, F.col("pattern")), F.lit(False))).otherwise(False)).otherwise(False)
    cut = joined.withColumn("gone", F.when(F.col("pattern").isNotNull(), F.filter("lines", goes)).otherwise(F.array().cast("array<string>")))
    cut = cut.withColumn("kept", F.when(F.size("gone") > 0, F.filter("lines", lambda x: ~F.array_contains("gone", x))).otherwise(F.col("lines")))
    cut = cut.withColumn("hit", F.flatten(F.transform("gone", lambda x: F.filter("margins", lambda m: F.contains(x, m["line_text"])))))
    hit = F.coalesce("hit", F.array().cast(cut.schema["hit"].dataType))
    removed = lambda zone: F.size(F.filter(hit, lambda m: m["zone"] == zone)).cast("int")
    return cut.select(*PAGE, "raw_text", text.clean_text(F.array_join("kept", "\n")).alias("text"), removed("header").alias("headers_removed"), removed("footer").alias("footers_removed"),
                      F.flatten(F.transform(hit, lambda m: m["span_indices"])).alias("span_indices"))
