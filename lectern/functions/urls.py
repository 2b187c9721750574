"""Column expressions over links: normal form, file ids, keys and revisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve(href: Column, base: Column) -> Column:
    """Absolute, root-relative, relative and fragment references against a base URL; . and .. in paths are followed."""
    origin = F.regexp_extract(base, r"^(?i)([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^(?i)([a-z][a-z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    whole = (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(?i)([a-z][a-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )
    return F.when(whole.rlike(r"^(?i)https?://[^?#]*/\.\.?(?:[/?#]|$)"), _without_dots(whole)).otherwise(whole)


def _without_dots(url: Column) -> Column:
    head, path, rest = (F.regexp_extract(url, r"^(?i)(https?://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3))
    steps = F.split(path, "/", -1)
    last = F.element_at(steps, -1)
    walked = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x)))
    ends = F.when(last.isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    return F.concat(head, F.lit("/"), F.array_join(walked, "/"), ends, rest)


def normalize(url: Column) -> Column:
    """https only, no credentials, backslash, control or space, 8192 characters at most; lower-case ASCII
    host, no default port, no fragment, path at least "/". Null if rejected."""
    host = F.lower(F.regexp_extract(url, r"^(?i)https://([^/?#]*)", 1))
    host = F.regexp_replace(host, r":443$", "")
    rest = F.regexp_replace(F.regexp_extract(url, r"^(?i)https://[^/?#]*([^#]*)", 1), r"^\?", "/?")
    rest = F.when(rest == "", F.lit("/")).otherwise(rest)
    bad = ~url.rlike(r"^(?i)https://") | url.rlike(r"[\\\x00-\x20\x7f]") | (F.length(url) > 8192) | ~host.rlike(r"^[a-z0-9.-]+(:\d+)?$")
    return F.when(~bad, F.concat(F.lit("https://"), host, rest))


#: Paths of a file of the course site, and of a file browser whose query names one.
FILE_PATH = r"^/(?:api/v1/)?(?:courses/\d+/)?files/([1-9]\d{0,17})(?:/(?:download|preview))?/?$"
FILE_BROWSER = r"^/courses/\d+/files/?$"


def site(url: Column) -> Column:
    """Scheme and authority of a normalised URL."""
    return F.regexp_extract(url, r"^(https://[^/?#]*)", 1)


def file_id(url: Column, origin: Column) -> Column:
    """Id of a file of the site, from its path or from a file browser's query, which must name it once."""
    path = F.regexp_extract(url, r"^https://[^/?#]*([^?#]*)", 1)
    asked = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&", -1)

    def only(key: str) -> Column:
        named = F.filter(asked, lambda x: x.startswith(f"{key}=") & (F.length(x) > len(key) + 1))
        return F.when(F.size(named) == 1, F.nullif(F.regexp_extract(F.get(named, 0), r"=([1-9]\d{0,17})$", 1), F.lit("")))

    found = F.when(path.rlike(FILE_PATH), F.regexp_extract(path, FILE_PATH, 1)).when(path.rlike(FILE_BROWSER), F.coalesce(only("preview"), only("file_id")))
    return F.when((site(url) == origin) & (origin != ""), found.try_cast("long"))


def source_key(url: Column) -> Column:
    return F.sha2(url, 256)


def material_key(file: Column, url: Column) -> Column:
    """What a material is known by: its file id, or else the hash of its URL."""
    return F.when(file.isNotNull(), F.concat(F.lit("canvas:"), file.cast("string"))).otherwise(F.concat(F.lit("external:"), source_key(url)))


def revision_hash(etag: Column, modified: Column, size: Column) -> Column:
    """Hash of a strong ETag, a valid date and the size; null without any validator."""
    strong = F.when(etag.rlike(r'^"[^"]*"$'), etag)
    dated = F.when(modified.rlike(r"^\d{4}-\d\d-\d\d"), modified)
    return F.when(strong.isNotNull() | dated.isNotNull(), F.sha2(F.concat_ws("|", F.coalesce(strong, F.lit("-")), F.coalesce(dated, F.lit("-")), F.coalesce(size.cast("string"), F.lit("-"))), 256))
