"""Column expressions over addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow import policy

_PARTS = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def resolved(c: Column, base: Column) -> Column:
    """An address made absolute against a base: //host, /path, ?query and relative paths."""
    url = F.trim(c)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/")))
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    return (
        F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme, F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.startswith("?"), F.concat(page, url))
        .when((url == "") | url.startswith("#"), F.concat(page, url))
        .otherwise(F.concat(folder, url))
    )


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, _PARTS, group)


def key_form(c: Column) -> Column:
    """An absolute address to compare by: scheme and host in lower case, single slashes, no query, fragment or end slash."""
    path = F.regexp_replace(F.regexp_replace(_part(c, 3), "/+", "/"), "/$", "")
    return F.concat(F.lower(_part(c, 1)), F.lit("://"), F.lower(_part(c, 2)), path)


def fetch_form(c: Column) -> Column:
    """An absolute address to read: as written, but for the fragment; an empty path is a slash."""
    path = F.when(_part(c, 3) == "", F.lit("/")).otherwise(_part(c, 3))
    return F.concat(F.lower(_part(c, 1)), F.lit("://"), F.lower(_part(c, 2)), path, _part(c, 4))


def stable_id(c: Column) -> Column:
    return F.substring(F.sha2(key_form(c), 256), 1, 20)


def host(c: Column) -> Column:
    """Host in lower case, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(c, 2), r"^.*@", ""), r":\d*$", ""))


def admissible(c: Column) -> Column:
    """http or https, a usual port, and no local host."""
    port = F.regexp_extract(_part(c, 2), r":(\d*)$", 1)
    name = host(c)
    local = (name == "") | (name == "localhost") | name.endswith(".local") | name.endswith(".internal")
    return F.lower(_part(c, 1)).isin("http", "https") & port.isin("", "80", "443") & ~local


def excluded(c: Column, discovery_host: str | None = None, kept_path: str = "/noticias/") -> Column:
    """Links that never lead to a document: by domain, first host label, or path.

    Of the host that notices are discovered on only the pages under ``kept_path`` are followed; it holds no documents itself.
    """
    name = host(c)
    labels = F.split(name, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    domains = F.array(*[F.lit(d) for d in policy.EXCLUDED_DOMAINS])
    path = F.lower(F.regexp_replace(_part(c, 3), "/+$", ""))
    by_path = F.lit(False)
    for p in policy.EXCLUDED_PATHS:
        by_path = by_path | (path == p) | path.startswith(p + "/")
    if discovery_host:
        by_path = by_path | (name.endswith(discovery_host) & ~path.contains(kept_path))
    return F.arrays_overlap(suffixes, domains) | F.get(labels, F.lit(0)).isin(*policy.EXCLUDED_LABELS) | by_path
