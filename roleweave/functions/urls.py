"""URL expressions (P3-P6).  Native string/regex work, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roleweave.functions import dictionaries as D
from roleweave.functions.text import col, title_case

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_NETLOC = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)"


def netloc(url="url") -> Column:
    """The authority part of an absolute URL (host with any port / user info), as
    URL parsers return it; "" when absent."""
    return F.regexp_extract(col(url), _NETLOC, 1)


def company_from_host(url="url") -> Column:
    """First label of the lower-cased network location without "www.", title-cased."""
    host = F.replace(F.lower(netloc(url)), F.lit("www."), F.lit(""))
    return title_case(F.split(host, r"\.").getItem(0))


def search_domain(url="url", second_level=D.SECOND_LEVEL_LABELS, overrides=D.DOMAIN_OVERRIDES,
                  full_host=D.FULL_HOST_DOMAINS) -> Column:
    """The registrable domain searched for a site.

    More than two labels and a second-to-last label that is not a generic
    second level -> the last two; more than three labels with such a second
    level -> the last three; else the whole network location.  Override table
    (e.g. an ATS domain standing for its company) and domains that need the full
    host are applied last.
    """
    dom = netloc(url)
    parts = F.split(dom, r"\.")
    n = F.size(parts)
    second = F.element_at(parts, -2)
    generic = second.isin(*second_level)
    last2 = F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))
    last3 = F.concat_ws(".", F.element_at(parts, -3), F.element_at(parts, -2), F.element_at(parts, -1))
    sd = F.when((n > 2) & ~generic, last2).when((n > 3) & generic, last3).otherwise(dom)
    for needle, repl in overrides.items():
        sd = F.when(sd.contains(needle), F.lit(repl)).otherwise(sd)
    for needle in full_host:
        sd = F.when(sd.contains(needle), dom).otherwise(sd)
    return sd


def company_from_domain(domain: Column, overrides=D.COMPANY_NAME_OVERRIDES) -> Column:
    """Company name from a searched domain, with the fixed spelling overrides."""
    name = title_case(F.split(domain, r"\.").getItem(0))
    for needle, repl in overrides:
        name = F.when(name.contains(needle), F.lit(repl)).otherwise(name)
    return name


def without_dots(path: Column) -> Column:
    """A path that begins with ``/`` without its ``.`` and ``..`` segments (RFC 3986, 5.2.4)."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    # a path that ends in a dot segment names a directory: nothing behind the last slash
    segments = F.concat(F.slice(segments, 2, F.size(segments)), F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda stack, s: F.when(s == ".", stack).when(s == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(s))),
    )
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def absolute_url(base="page_url", href="href") -> Column:
    """P5: resolve ``href`` against ``base`` (RFC 3986 reference resolution: absolute,
    scheme-relative, absolute path, query-only, fragment-only, relative path).  Dot
    segments of the two kinds of path are removed; what names its own host is kept as written."""
    b, h = col(base), F.coalesce(col(href), F.lit(""))
    scheme = F.regexp_extract(b, _SCHEME, 1)
    origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    no_frag = F.regexp_replace(b, "#.*$", "")
    no_query = F.regexp_replace(no_frag, r"\?.*$", "")
    path = F.regexp_extract(no_query, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/.*)?$", 1)
    directory = F.regexp_replace(path, "[^/]*$", "")
    directory = F.when(directory == "", F.lit("/")).otherwise(directory)
    tail = F.regexp_extract(h, r"(?s)[?#].*$", 0)
    target = F.regexp_replace(h, r"(?s)[?#].*$", "")
    return (
        F.when(h == "", b)
        .when(h.rlike(_SCHEME), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, without_dots(target), tail))
        .when(h.startswith("?"), F.concat(no_query, h))
        .when(h.startswith("#"), F.concat(no_frag, h))
        .otherwise(F.concat(origin, without_dots(F.concat(directory, target)), tail))
    )
