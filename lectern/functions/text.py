"""Column expressions over text: cleaning, normal forms, headings and the rules on what a text is."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for an unreadable symbol.
UNREADABLE = "[UNREADABLE_SYMBOL]"
#: Words of a question that say nothing about its subject.
STOP_WORDS = ["what", "how", "is", "are", "the", "and", "of", "to", "in", "does", "do", "for", "can", "it"]
#: Evidence of prose, instructions or calculation.
BODY_EVIDENCE = (
    r"(?i)[?!=<>。！？]|https?://|\b(?:is|are|was|were|means|defines?|contains?|consists?|provides?|uses?|used|can|must|should|will|has|have|calculat\w*|"
    r"compute|computes|show|explain|consider|find|detect\w*|transmit\w*|receiv\w*|connects?|supports?|governs?|carries|forwards?|identif\w*|responsible)\b"
)
#: Patterns of covers and outlines.
COURSE_LINE = r"^[A-Z]{2,8}\s?\d{3,5}\s*:\s*\S"
SESSION_LINE = r"(?i)^(?:Week|Lecture|Session)\s+\d+\s*[:–-]\s*\S"
AFFILIATION_LINE = r"(?i)^(?:School|Department|Faculty) of\s+\S"
LIST_ITEM = r"^(?:\d+[.)]|[-–•❑▪])\s*(\S.*)$"
OUTLINE_HEADINGS = ["syllabus", "outline", "table of contents"]
#: Words that announce exam content, and those that take it back.
EXAM_CUES = (
    r"(?i)\b(exams?|assessments?|quizzes|quiz|important|remember|learning outcomes?)\b|\b(?:midterm|final|practice|upcoming) test\b"
    r"|\b(?:on|for) (?:the |a )?test\b|考试|考核|测验|学习目标|重点"
)
NEGATED_CUES = r"(?i)\b(?:not|never|no|unimportant|excluded)\b|不考|非重点|无需记忆"
#: A gap between two equality signs.
MALFORMED_MATH = r"[=＝]\s*(?:\.{2,}|…+|⋯+|\[MATHEMATICAL EXPRESSION OMITTED[^\]\n]*\])\s*[=＝]"


#: What may be white space at a line's end, as a class that is quick to match.
_LINE_END = r"[\x00-\x09\x0b-\x20\x7f-\xa0\x{1680}-\x{3000}](?:\n|\z)"


def clean_text(text: Column) -> Column:
    """One kind of line end, no NUL, no white space at line ends, two empty lines at most, none outside. Texts that are
    so are left alone."""
    unclean = F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\0")) | F.contains(text, F.lit("\n\n\n")) | F.startswith(text, F.lit("\n")) | F.endswith(text, F.lit("\n")) | text.rlike(_LINE_END)
    return F.when(unclean, _cleaned(text)).otherwise(text)


def _cleaned(text: Column) -> Column:
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.replace(text, F.lit("\0"), F.lit(""))
    text = F.regexp_replace(text, r"(?dm)[\t\x0B\f\r \x1c-\x1f\x85\p{Z}]+$", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\n+|\n+\z", "")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode normal form, which has no built-in; for inputs that may need it."""
    return texts.str.normalize("NFKC")


#: Characters that no normal form changes alone, whatever stands beside them here: ASCII and most Latin letters.
_STABLE = r"[^\x00-\x7f\xc0-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e]"


def _normal(text: Column) -> Column:
    """nfkc, to which only texts with other characters go."""
    return F.coalesce(nfkc(F.when(text.rlike(_STABLE), text)), text)


def normalize_words(text: Column, normal_form: bool = False) -> Column:
    """Lower-case runs of letters and digits, joined by one space."""
    text = _normal(text) if normal_form else text
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def shown_lines(text: Column) -> Column:
    """Lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\s\p{Z}]+"))


def section_heading(text: Column) -> Column:
    first = F.coalesce(F.get(shown_lines(text), 0), F.lit(""))
    return F.when(F.length(first) > 120, F.lit("")).otherwise(F.regexp_replace(F.replace(F.lower(first), F.lit("ß"), F.lit("ss")), r"[\s\p{Z}]+", " "))


def plain_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9]+"), F.lit(0)))


def section_terms(text: Column, question: Column) -> Column:
    """Words of the heading that the question has too, without the empty ones."""
    heading = F.coalesce(F.get(shown_lines(text), 0), F.lit(""))
    return F.array_sort(F.array_except(F.array_intersect(plain_words(heading), plain_words(question)), F.array(*map(F.lit, STOP_WORDS))))


def has_body(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b[A-Za-z]+\b")) >= 25


def exercise_prompt(text: Column, title: Column) -> Column:
    """An exercise without its answer."""
    asks = text.rlike(r"(?i)^\s*(?:question|exercise|problem)\s*\d")
    told = title.rlike(r"(?i)assignment|homework|exercise") & text.rlike(r"(?i)\b(?:calculate|determine|give an example|what is)\b")
    return ~text.rlike(r"(?im)^\s*(?:worked\s+)?(?:solution|answer)\b") & (asks | told)


def unreadable_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[�￼\p{Co}]"))


def mask_unreadable(text: Column) -> Column:
    return F.regexp_replace(text, r"[�￼\p{Co}]", UNREADABLE)


def malformed_math(text: Column) -> Column:
    return text.rlike(MALFORMED_MATH)


def symbol_source_ok(text: Column, warnings: Column, risks: list[str]) -> Column:
    """Whether symbols in a text can be relied on."""
    return ~F.arrays_overlap(warnings, F.array(*map(F.lit, risks))) & (unreadable_count(text) == 0) & ~F.contains(text, F.lit(UNREADABLE)) & ~malformed_math(text)


def exam_cue(text: Column) -> Column:
    return F.exists(F.split(text, "\n", -1), lambda x: x.rlike(EXAM_CUES) & ~x.rlike(NEGATED_CUES))


#: How a cover or an outline must begin.
_LOW_BEGIN = r"\A[\s\p{Z}]*+(?:[A-Z]{2,8}\s?\d{3,5}\s*:|(?iu:" + "|".join(OUTLINE_HEADINGS) + "))"


def low_information(text: Column) -> Column:
    """Why a text is a cover or an outline only; null if it is neither. Texts that do not begin like one are not parted."""
    return F.when(text.rlike(_LOW_BEGIN), _low_information(text))


def _low_information(text: Column) -> Column:
    lines = shown_lines(text)
    first = F.coalesce(F.get(lines, 0), F.lit(""))
    words = word_count(text)
    short = F.forall(lines, lambda x: word_count(x) <= 10)
    cover = (
        F.size(lines).between(4, 12) & (words <= 60) & short & first.rlike(COURSE_LINE)
        & F.exists(lines, lambda x: x.rlike(SESSION_LINE)) & F.exists(lines, lambda x: x.rlike(AFFILIATION_LINE)) & ~F.exists(lines, lambda x: x.rlike(LIST_ITEM))
    )
    items = F.flatten(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.split(x, r"\s{3,}", -1)))
    listed = F.forall(items, lambda x: x.rlike(LIST_ITEM) & (word_count(F.regexp_extract(x, LIST_ITEM, 1)) <= 10))
    outline = F.lower(first).isin(OUTLINE_HEADINGS) & (words <= 200) & (F.size(items) >= 3) & listed
    return F.when((F.size(lines) == 0) | text.rlike(BODY_EVIDENCE), None).when(cover, F.lit("cover")).when(outline, F.lit("outline"))


def week_number(title: Column) -> Column:
    """The number that a week's title begins with, if it is above zero."""
    n = F.regexp_extract(title, r"(?i)^\s*(?:week|module|topic)\s+(\d{1,9})\b", 1).try_cast("int")
    return F.when(n > 0, n)


def file_name(url: Column) -> Column:
    """Last segment of a URL's path, decoded."""
    return F.try_url_decode(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1))


def file_type(name: Column) -> Column:
    """Lower-case suffix with its dot, or unknown."""
    suffix = F.regexp_extract(F.lower(name), r"[^./](\.[^./]+)$", 1)
    return F.when(F.coalesce(suffix, F.lit("")) == "", F.lit("unknown")).otherwise(suffix)


def canonical_json(**fields: Column) -> Column:
    """JSON of named fields in the order of their names; nulls are written, so that no two identities look alike."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def json_length(text: Column) -> Column:
    """Characters of a text within JSON quotation marks, without these."""
    return F.length(text) + F.regexp_count(text, F.lit(r'["\\\x08\x0c\n\r\t]')) + 5 * F.regexp_count(text, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]"))
