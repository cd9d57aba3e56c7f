"""JSON responses -> postings.

Responses arrive as a table of bodies; ``from_json`` with a fixed schema, one
``explode`` and projections turn them into postings (no per-row Python).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions import dictionaries as D
from roleweave.functions.text import contains_any, text_or_empty, truncate
from roleweave.functions.urls import company_from_domain, search_domain
from roleweave.operators.filters import excluded_by_query, is_present

JOB_API_SCHEMA = "struct<jobPostings: array<struct<title: string, externalPath: string, locationsText: string>>>"
SEARCH_API_SCHEMA = "struct<results: array<struct<title: string, url: string, snippet: string, description: string>>>"


def in_site_region(location="location", words: Iterable[str] = D.BIG4_REGION_WORDS) -> Column:
    """F8: a site's region words in the location; an empty location is *not* in the region."""
    loc = F.lower(text_or_empty(location))
    return (loc != "") & contains_any(loc, list(words))


def read_job_api(responses: DataFrame, url_prefix: str, company: str, body_col: str = "body",
                 region_words: Iterable[str] = D.BIG4_REGION_WORDS, default_location: str = "India",
                 source: str = "Big4") -> DataFrame:
    """Postings of a job-board API response ``{"jobPostings": [{title, externalPath, locationsText}]}``.

    url = prefix + path; a missing location is ``default_location``; a posting is kept
    when its location is in the region (F8), or its title says "india", or its url
    names one of the two home cities.
    """
    parsed = responses.select("*", F.from_json(F.col(body_col), JOB_API_SCHEMA).alias("_r"))
    jobs = parsed.select("*", F.posexplode(F.col("_r.jobPostings")).alias("pos", "j")).drop("_r")
    out = jobs.select(
        *[c for c in responses.columns if c != body_col], "pos",
        text_or_empty(F.col("j.title")).alias("title"),
        F.lit(company).alias("company"),
        F.coalesce(F.col("j.locationsText"), F.lit(default_location)).alias("location"),
        F.lit("").alias("description"),
        F.concat(F.lit(url_prefix), text_or_empty(F.col("j.externalPath"))).alias("url"),
        F.lit(source).alias("source"),
    )
    url_lc = F.lower(F.col("url"))
    keep = (in_site_region("location", region_words) | F.lower("title").contains("india")
            | url_lc.contains("bangalore") | url_lc.contains("mumbai"))
    return out.where(keep)


def read_search_results(responses: DataFrame, descriptions: DataFrame | None = None, body_col: str = "body",
                        site_col: str = "site_url", location_col: str = "location",
                        exclusions: Iterable[str] | None = D.SEARCH_EXCLUSIONS,
                        source: str = "search_api") -> DataFrame:
    """Postings of a search-API response ``{"results": [{title, url, snippet|description}]}``.

    Results without title or url are skipped (F14); title is cut to 200 characters;
    company comes from the searched site's domain (P4); location is the searched
    location; the description is the fetched page text when there is one (J4, left
    join on url), else the snippet.  ``exclusions``: the query's ``-word`` terms,
    applied to title and snippet (F13).
    """
    parsed = responses.select("*", F.from_json(F.col(body_col), SEARCH_API_SCHEMA).alias("_r"))
    res = parsed.select("*", F.posexplode(F.col("_r.results")).alias("pos", "r")).drop("_r")
    res = res.select(
        *[c for c in responses.columns if c != body_col], "pos",
        F.col("r.title").alias("raw_title"), F.col("r.url").alias("url"),
        F.coalesce(F.col("r.snippet"), F.col("r.description"), F.lit("")).alias("snippet"),
    ).where(is_present("raw_title", "url"))
    if exclusions:
        res = res.where(~excluded_by_query(F.concat_ws(" ", "raw_title", "snippet"), exclusions))
    if descriptions is not None:
        # one description per url: the first fetched result's text (bounded by one row per url)
        d = descriptions.groupBy("url").agg(F.first("text", ignorenulls=True).alias("fetched"))
        res = res.join(d, "url", "left")
    else:
        res = res.withColumn("fetched", F.lit(None).cast("string"))
    dom = search_domain(F.col(site_col))
    keep = [c for c in responses.columns if c not in (body_col, location_col)]
    return res.select(
        *keep, "pos",
        truncate("raw_title", D.TITLE_MAX_CHARS).alias("title"),
        company_from_domain(dom).alias("company"),
        F.col(location_col).alias("location"),
        F.coalesce(F.nullif(F.col("fetched"), F.lit("")), F.col("snippet")).alias("description"),
        "url",
        F.lit(source).alias("source"),
    )


def read_embedded_json(pages: DataFrame, script_id: str, json_path: str, html_col: str = "html") -> DataFrame:
    """The JSON of ``<script id="...">`` in each page, read at ``json_path``
    (``$.props.pageProps...`` syntax); null where the script is absent."""
    pat = r'(?is)<script[^>]*\bid="' + script_id + r'"[^>]*>(.*?)</script\s*>'
    body = F.regexp_extract(F.col(html_col), pat, 1)
    return pages.withColumn("embedded", F.when(body != "", F.get_json_object(body, json_path)))
