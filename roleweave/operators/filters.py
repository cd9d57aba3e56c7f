"""Row predicates and the gates built from them.

Each ``is_*`` returns a boolean Column; each ``filter_*`` is a
``DataFrame -> DataFrame`` narrow transformation (no shuffle), so Catalyst can
push the parts that touch stored columns down to the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions import dictionaries as D
from roleweave.functions.dates import as_of_lit
from roleweave.functions.postings import experience_range
from roleweave.functions.text import col, contains_any, contains_any_bounded, text_or_empty


def is_in_region(location="location", words: Iterable[str] = D.REGION_WORDS) -> Column:
    """empty location counts as in the region; else substring of any word."""
    loc = text_or_empty(location)
    return (loc == "") | contains_any(F.lower(loc), words)


def is_foreign(title="title", location="location", words: Iterable[str] = D.FOREIGN_WORDS) -> Column:
    """a foreign place word, word-bounded, in ``lower(title + ' ' + location)``."""
    text = F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(location)))
    return contains_any_bounded(text, words)


def location_gate(targets: Iterable[str], title="title", location="location",
                  region_words: Iterable[str] = D.REGION_WORDS,
                  foreign_words: Iterable[str] = D.FOREIGN_WORDS,
                  fallback_places: Iterable[str] = D.FALLBACK_PLACES,
                  excluded_cities: Iterable[str] = D.EXCLUDED_CITIES,
                  home_region: str = D.HOME_REGION) -> Column:
    """keep-predicate of the strict location filter.

    No targets: everything passes (the gate, foreign test included, is off).
    Else: foreign -> drop; no location -> keep; a target in the location -> keep;
    home region targeted and F1 -> keep; a fallback place and none of the
    excluded cities -> keep; otherwise drop.
    """
    targets = [t.lower() for t in targets]
    if not targets:
        return F.lit(True)
    loc = text_or_empty(location)
    low = F.lower(loc)
    keep = (loc == "") | contains_any(low, targets)
    if home_region in targets:
        keep = keep | is_in_region(location, region_words)
    fallback = contains_any(low, fallback_places) & ~contains_any(low, excluded_cities)
    keep = keep | fallback
    return ~is_foreign(title, location, foreign_words) & keep


def filter_location(postings: DataFrame, targets: Iterable[str], **kw) -> DataFrame:
    """F3 as a DataFrame operator."""
    return postings.where(location_gate(targets, **kw))


def max_age_days(source="source", limits: Mapping[str, int] = D.MAX_AGE_DAYS,
                 default: int = D.DEFAULT_MAX_AGE_DAYS) -> Column:
    """Per-source age limit; the limit table is a handful of literals."""
    src = F.lower(text_or_empty(source))
    expr = None
    for name, days in limits.items():
        expr = (F.when(src == name.lower(), F.lit(days)) if expr is None
                else expr.when(src == name.lower(), F.lit(days)))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def is_recent(ts="posted_ts", as_of=None, source="source",
              limits: Mapping[str, int] = D.MAX_AGE_DAYS, default: int = D.DEFAULT_MAX_AGE_DAYS) -> Column:
    """``ts >= as_of - limit(source) days`` (inclusive)."""
    return col(ts) >= as_of_lit(as_of) - F.make_dt_interval(max_age_days(source, limits, default))


def filter_recent(postings: DataFrame, as_of, ts="posted_ts", **kw) -> DataFrame:
    return postings.where(is_recent(ts, as_of, **kw))


def keeps_experience(experience="experience", max_min: int = D.EXP_KEEP_MAX_MIN,
                     min_max: int = D.EXP_KEEP_MIN_MAX) -> Column:
    """blank experience passes; else drop ``min > max_min`` or ``max < min_max``."""
    rng = experience_range(experience)
    return experience_in_reach(text_or_empty(experience) != "", rng["min"], rng["max"], max_min, min_max)


def experience_in_reach(has_exp: Column, lo: Column, hi: Column, max_min: int = D.EXP_KEEP_MAX_MIN,
                        min_max: int = D.EXP_KEEP_MIN_MAX) -> Column:
    """F10 on a range that is parsed already."""
    return ~has_exp | ~((lo > max_min) | (hi < min_max))


def excluded_by_query(text: Column, words: Iterable[str] = D.SEARCH_EXCLUSIONS) -> Column:
    """the search exclusions (``-word``) applied after the fact, word-bounded."""
    return contains_any_bounded(F.lower(text), words)


def is_present(*cols) -> Column:
    """every given text column is non-null and non-empty."""
    out = F.lit(True)
    for c in cols:
        out = out & (text_or_empty(c) != "")
    return out
