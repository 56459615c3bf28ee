"""URL functions as native columns.  parse_url gives null for URLs with blanks, so all of this is regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_NETLOC = r"^(?:[^:/?#]+:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*([^?#]*)"

# fixed values: what is extracted and what is passed over, by file extension
DOCUMENT_EXTENSIONS = {"pdf": "pdf", "docx": "docx", "doc": "docx"}
SKIPPED_EXTENSIONS = (
    "jpg jpeg png gif svg webp zip tar gz bz2 7z rar mp4 mp3 avi mov wmv css js json xml ico xls xlsx ppt pptx exe msi "
    "dmg pkg"
).split()
EXTRACTABLE = ("html", "pdf", "docx")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _NETLOC, 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def classify(url: Column) -> Column:
    """html, pdf, docx or skip, by the extension of the lower-cased path; whatever has no known one is html."""
    extension = F.regexp_extract(F.lower(path(url)), r"\.([^./]*)$", 1)
    kind = F.when(extension.isin(SKIPPED_EXTENSIONS), "skip")
    for ext, name in DOCUMENT_EXTENSIONS.items():
        kind = kind.when(extension == ext, name)
    return kind.otherwise("html")


def same_domain(url: Column, domain: Column | str) -> Column:
    """Equal network locations, port and user included; the scheme doesn't matter and subdomains don't count."""
    return netloc(url) == (F.lower(F.lit(domain)) if isinstance(domain, str) else F.lower(domain))


def relevant_path(url: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Patterns are searched in the path alone, ignoring case; exclusion wins, and without any pattern all pass."""
    found = lambda patterns: F.greatest(*[path(url).rlike(f"(?i){p}") for p in patterns], F.lit(False))
    keep = ~found(exclude) if exclude else F.lit(True)
    return keep & found(include) if include else keep


def filename(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path(url), "([^/]*)$", 1), F.lit("")), url)


def _without_dots(full: Column) -> Column:
    """A path without `.` and `..` segments."""
    parts = F.split(full, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(p == ".", acc).otherwise(F.concat(acc, F.array(p))),
    )
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def resolve(link: Column, base: Column) -> Column:
    """An absolute URL of a link on a page, without fragment; the query stays."""
    bare = without_fragment(F.regexp_replace(link, r"(?U)^\s+|\s+$", ""))
    origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    own = F.coalesce(F.nullif(path(base), F.lit("")), F.lit("/"))
    folder = F.regexp_extract(own, "^(.*/)", 1)
    relative = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    route, rest = F.regexp_extract(relative, r"^([^?]*)", 1), F.regexp_extract(relative, r"(\?.*)$", 1)
    clean = F.when(route.rlike(r"(^|/)\.\.?(/|$)"), _without_dots(route)).otherwise(route)
    return (
        F.when(bare == "", without_fragment(base))
        .when(bare.rlike(_SCHEME), bare)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^([^:/?#]+:)", 1), bare))
        .when(bare.startswith("?"), F.concat(origin, own, bare))
        .otherwise(F.concat(origin, clean, rest))
    )
