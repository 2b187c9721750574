"""Links of web pages with the text around them.

A page is a table of events, its tags and pieces of text by position. Contexts are carried along by windows over that
table: how deep lists and blocks are nested, which heading, block and anchor a piece of text belongs to, and the
paragraph before. Every event of a page has its page's key, so one exchange serves all of them.
"""

from __future__ import annotations

import html as html_parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions import urls
from lectern.sources.scratch import written

#: Elements whose content is no part of the page, and those whose text is the text around a link.
INACTIVE = ["script", "style", "form", "template"]
AROUND = ["p", "li", "td", "figcaption"]
#: Characters of an element's text and of a title that are kept, and those of a paragraph that introduces what follows.
LONGEST, TITLE, INTRODUCTION = 1500, 500, 500
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_TOKEN = rf"</?[a-zA-Z]{_REST}|<[^a-zA-Z/]?[^<>]*+>?|[^<]++"
_GONE = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}\b{_REST}.*?(?:</{t}\s*>|\z)" for t in INACTIVE)


@F.pandas_udf(T.StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    """Character references decoded, which has no built-in."""
    return texts.map(lambda t: html_parser.unescape(t) if t and "&" in t else t)


def _attribute(name: str) -> Column:
    found = [F.nullif(F.regexp_extract("token", rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", i), F.lit("")) for i in (1, 2, 3)]
    return F.coalesce(*found)


def _plain(pieces: Column) -> Column:
    """Collected (pos, token) as one text, white space as one space."""
    whole = F.array_join(F.transform(F.array_sort(pieces), lambda x: x["token"]), "")
    return F.trim(F.regexp_replace(F.substring(whole, 1, LONGEST), r"(?U)\s+", " "))


def _depth(df: DataFrame, name: str, up: Column, order) -> DataFrame:
    """How deep elements are open; closing tags that close nothing do not count."""
    df = df.withColumn(name, F.sum(F.when(up & ~F.col("closes"), 1).when(up, -1).otherwise(0)).over(order))
    return df.withColumn(name, (F.col(name) - F.least(F.lit(0), F.min(name).over(order))).cast("int"))


def _events(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, token, tag, closes, and for each event the depths of blocks and lists and the positions of the
    heading, anchor and block that it is in."""
    tokens = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all(F.regexp_replace("html", _GONE, ""), F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    kind = F.when(F.col("token").rlike("^</?[a-zA-Z]"), tag).when(F.col("token").rlike("^<[!?/]"), "").otherwise("#text")
    named = tokens.withColumn("tag", kind).withColumn("closes", F.col("token").startswith("</"))
    kept = named.filter(F.col("tag").isin("#text", "a", "ul", "ol", *AROUND) | F.col("tag").rlike("^h[1-6]$")).repartition("page_id")
    kept = kept.withColumn("token", F.when(F.col("tag") == "#text", _decoded("token")).otherwise(F.col("token")))
    order = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda when, value, over=order: F.last(F.when(when, value), ignorenulls=True).over(over)
    opens = ~F.col("closes")
    is_block, is_list, level = F.col("tag").isin(*AROUND), F.col("tag").isin("ul", "ol"), F.regexp_extract("tag", "^h([1-6])$", 1).try_cast("int")
    df = _depth(_depth(kept.withColumn("level", level), "blocks", is_block, order), "lists", is_list, order)
    df = df.withColumn("head", last(F.col("level").isNotNull() & opens, F.struct("pos", "level")))
    df = df.withColumn("head_end", F.col("closes") & F.coalesce(F.col("level") == F.col("head.level"), F.lit(False)))
    df = df.withColumn("in_head", F.col("head").isNotNull() & (F.coalesce(last(F.col("head_end"), F.col("pos")), F.lit(-1)) < F.col("head.pos")))
    anchor = last(F.col("tag") == "a", F.struct("pos", "closes"))
    df = df.withColumn("anchor", F.when(~anchor["closes"], anchor["pos"]))
    own = Window.partitionBy("page_id", "blocks").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("block", F.when(F.col("blocks") > 0, last(is_block & opens, F.struct("pos", "tag"), own)))


def _contexts(events: DataFrame) -> DataFrame:
    """The opening tags of anchors with heading, before, around and link_text."""
    order = Window.partitionBy("page_id").orderBy("pos")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    is_text, is_link, opens, is_list = F.col("tag") == "#text", (F.col("tag") == "a") & ~F.col("closes"), ~F.col("closes"), F.col("tag").isin("ul", "ol")
    piece = F.collect_list(F.when(is_text, F.struct("pos", "token")))
    blocks = events.filter("block IS NOT NULL").groupBy("page_id", F.col("block.pos").alias("b")).agg(_plain(piece).alias("body"), F.bool_or(is_link).alias("linked"))
    heads = events.filter(F.col("in_head") | F.col("head_end")).groupBy("page_id", F.col("head.pos").alias("h")).agg(_plain(F.collect_list(F.when(is_text & F.col("in_head"), F.struct("pos", "token")))).alias("body"), F.min(F.when(F.col("head_end"), F.col("pos"))).alias("end"))
    titles = heads.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("h", F.struct("body", "end")))).alias("titles"))
    anchors = events.filter(is_text & F.col("anchor").isNotNull()).groupBy("page_id", F.col("anchor").alias("pos")).agg(_plain(piece).alias("link_text"))
    # The block that a closing tag ends is the one that the event before it is in.
    ended = F.lag("block").over(order)
    df = events.withColumn("b", F.when(F.col("closes") & (F.col("tag") == "p") & (ended["tag"] == "p"), ended["pos"])).join(blocks, ["page_id", "b"], "left")
    paragraph = F.when(~F.col("linked") & (F.length("body") <= INTRODUCTION), F.col("body")).otherwise("")
    told = F.when(F.col("level").isNotNull() & opens, "").when(is_list, "").when(F.col("b").isNotNull(), paragraph)
    df = df.withColumn("told", told).withColumn("said", F.coalesce(F.last("told", ignorenulls=True).over(earlier), F.lit("")))
    of_list = Window.partitionBy("page_id", "lists").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("before", F.when(F.col("lists") > 0, F.last(F.when(is_list & opens, F.col("said")), ignorenulls=True).over(of_list)).otherwise(F.col("said")))
    above = [F.last(F.when(F.col("level").isNotNull() & opens & (F.col("level") <= k), F.struct("pos", "level")), ignorenulls=True).over(so_far) for k in range(1, 7)]
    df = df.withColumn("above", F.array(*[F.when(a["level"] == k, a["pos"]) for k, a in enumerate(above, 1)]))
    found = df.filter(is_link).drop("body", "linked", "b").join(titles, "page_id", "left").join(anchors, ["page_id", "pos"], "left")
    found = found.withColumn("near", F.col("block.pos")).join(blocks.select("page_id", F.col("b").alias("near"), F.col("body").alias("around")), ["page_id", "near"], "left")
    shown = F.transform("above", lambda h: F.when(F.get(F.map_values(F.map_filter("titles", lambda k, v: k == h)), 0)["end"] < F.col("pos"), F.get(F.map_values(F.map_filter("titles", lambda k, v: k == h)), 0)["body"]))
    return found.withColumn("heading", F.array_join(F.array_compact(shown), " "))


def page_links(pages: DataFrame, most: int = 2000, n_chars: int = 2_000_000) -> DataFrame:
    """page_id, pos, href, link_text, title, heading, before, around, kind, file_id, target, problem. pages: page_id,
    url (the base of relative addresses), html. kind: file (of the page's own site, by its canonical address, its path or
    its attribute), document (a PDF elsewhere) or unsupported. heading: the headings above by level; before: the paragraph
    before, or before the list that holds the link; around: the text of the innermost block. Links in scripts,
    styles, forms and templates, and to the page itself, are left out. A page beyond a limit is one row with a
    problem; null pages have no links. An element without its closing tag ends with the next closing tag of its kind."""
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    fits = given.filter(F.length("html") <= n_chars)
    found = _contexts(written(_events(fits), "link-events")).withColumn("anchors", F.count(F.lit(1)).over(Window.partitionBy("page_id")))
    href, endpoint, named = _decoded(_attribute("href")), _decoded(_attribute("data-api-endpoint")), _attribute("data-file-id")
    links = found.withColumns({"href": href, "endpoint": endpoint, "named": named, "title": F.substring(F.coalesce(_decoded(_attribute("title")), F.lit("")), 1, TITLE)})
    links = links.filter((F.col("anchors") > most) | ~F.coalesce(F.col("href").startswith("#"), F.lit(False)))
    links = links.withColumns({"at": urls.normalize(urls.resolve(F.col("href"), F.col("url"))), "canonical": urls.normalize(urls.resolve(F.col("endpoint"), F.col("url"))), "site": urls.site(urls.normalize(F.col("url")))})
    ids = [urls.file_id(F.col(c), F.col("site")) for c in ("canonical", "at")]
    attribute = F.when((urls.site(F.col("at")) == F.col("site")) & F.col("named").rlike("^[1-9][0-9]{0,17}$"), F.col("named").try_cast("long"))
    file_id = F.coalesce(*ids, attribute)
    is_pdf = F.lower(F.regexp_extract("at", r"^https://[^/?#]*([^?#]*)", 1)).endswith(".pdf")
    kind = F.when(file_id.isNotNull(), "file").when(is_pdf, "document").otherwise("unsupported")
    target = F.when(ids[0].isNotNull(), F.col("canonical")).when(kind != "unsupported", F.col("at"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    good = links.filter(F.col("anchors") <= most).select("page_id", place.cast("int").alias("pos"), "href", text("link_text"), "title", "heading", "before", text("around"), kind.alias("kind"), file_id.alias("file_id"), target.alias("target"), F.lit(None).cast("string").alias("problem"))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema}
    problem = lambda df, what: df.select(*[F.col("page_id") if c == "page_id" else F.lit(what).alias(c) if c == "problem" else e for c, e in empty.items()])
    many = links.filter(F.col("anchors") > most).select("page_id").distinct()
    return good.unionByName(problem(many, "links")).unionByName(problem(given.filter(F.length("html") > n_chars), "size"))
