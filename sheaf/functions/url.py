"""URL scalars: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "source", "ref_src")


def domain(u: Column) -> Column:
    """Authority, with port and user."""
    return F.try_parse_url(u, F.lit("AUTHORITY"))


def host(u: Column) -> Column:
    return F.try_parse_url(u, F.lit("HOST"))


def is_valid(u: Column) -> Column:
    return F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")).isin("http", "https") & host(u).isNotNull(), F.lit(False))


def without_fragment(u: Column) -> Column:
    """Fragment and default port dropped."""
    bare = F.regexp_replace(u, "#.*$", "")
    return F.regexp_replace(F.regexp_replace(bare, "^(http://[^/?]+):80(?=[/?]|$)", "$1"), "^(https://[^/?]+):443(?=[/?]|$)", "$1")


def credibility_key(u: Column) -> Column:
    """Scheme added, host lower case without www., one trailing slash, tracking parameters and fragment dropped."""
    full = F.when(F.rlike(u, F.lit("^https?://")), u).otherwise(F.concat(F.lit("https://"), u))
    bare = F.regexp_replace(full, "#.*$", "")
    scheme = F.regexp_extract(bare, "^(https?)://", 1)
    netloc = F.regexp_replace(F.lower(F.regexp_extract(bare, "^https?://([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(bare, "^https?://[^/?]*([^?]*)", 1)
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    kept = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~(p.contains("=") & F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING)))
    query = F.array_join(kept, "&")
    return F.concat(scheme, F.lit("://"), netloc, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def display_name(u: Column) -> Column:
    return F.split_part(F.regexp_replace(u, "^https?://", ""), F.lit("/"), F.lit(1))


def _resolved(path: Column) -> Column:
    """A path without . and .. segments; .. above the root is dropped."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(parts, none, lambda out, x: F.when(x == ".", out).when(x == "..", F.when(F.size(out) > 1, F.slice(out, 1, F.size(out) - 1)).otherwise(out)).otherwise(F.array_append(out, x)))
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))


def join(base: Column, href: Column) -> Column:
    """A reference made absolute: with a scheme, without one, rooted, relative, of a query or a fragment only, or empty."""
    scheme = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    own = F.regexp_extract(href, "^([^?#]*)", 1)
    return (
        F.when(href == "", base).when(F.rlike(href, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), href).when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, _resolved(own), tail)).when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("#"), F.concat(root, path, query, href)).otherwise(F.concat(root, _resolved(F.concat(folder, own)), tail))
    )
