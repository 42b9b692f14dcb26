"""URL references (RFC 3986) as column expressions: parts, resolution against a base, one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def without_dots(path: Column) -> Column:
    """The path without its segments . and .., as RFC 3986 removes them: .. takes the segment before with it, never the root."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
    )
    ended = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(path)


def resolved(reference: Column, base: Column) -> Column:
    """The absolute URL that a reference means on a page of URL base, without its fragment.

    White space at the ends, and tabs and line ends anywhere, do not count. Scheme and host in lower case, the scheme's own port left out, an empty path as /. Null where either is null, or
    where the result would have no scheme or, for http and https, no host.
    """
    reference, base = (F.trim(F.regexp_replace(x, r"[\t\n\r]", "")) for x in (reference, base))
    r = {n: _part(reference, i) for i, n in enumerate(("scheme", "host", "path", "query"), 1)}
    b = {n: _part(base, i) for i, n in enumerate(("scheme", "host", "path", "query"), 1)}
    has_host = F.regexp_like(reference, F.lit(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"))
    has_query = F.regexp_like(reference, F.lit(r"^[^?#]*\?"))
    base_query = F.regexp_like(base, F.lit(r"^[^?#]*\?"))
    own = (r["scheme"] != "") | has_host
    folder = F.when(b["path"] == "", F.lit("/")).otherwise(F.regexp_extract(b["path"], r"^(.*/)?", 0))
    path = F.when(own | r["path"].startswith("/"), r["path"]).when(r["path"] == "", b["path"]).otherwise(F.concat(folder, r["path"]))
    scheme = F.lower(F.when(r["scheme"] != "", r["scheme"]).otherwise(b["scheme"]))
    host = F.lower(F.when(own, r["host"]).otherwise(b["host"]))
    port = F.when(scheme == "http", F.regexp_replace(host, ":80$|:$", "")).when(scheme == "https", F.regexp_replace(host, ":443$|:$", "")).otherwise(host)
    query = F.when(own | (r["path"] != "") | has_query, F.when(has_query, F.concat(F.lit("?"), r["query"]))).otherwise(F.when(base_query, F.concat(F.lit("?"), b["query"])))
    web = scheme.isin("http", "https")
    clean = F.when(web & (path == ""), F.lit("/")).otherwise(without_dots(path))
    authority = F.when((host != "") | has_host, F.concat(F.lit("//"), port)).otherwise(F.lit(""))
    return F.when((scheme != "") & ~(web & (host == "")), F.concat(scheme, F.lit(":"), authority, clean, F.coalesce(query, F.lit(""))))
