"""Search frontier (S10, J6, W2): what to fetch, and where paging stops.

Keywords come from a table column (e.g. profile titles, P15); locations and the
page count are configuration, so the keyword x location x page expansion is an
``explode`` over a small literal list per keyword row, not a join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions import dictionaries as D


def quote_plus(c: Column) -> Column:
    """Form-encoding as Python's ``quote_plus``: Spark's encoder differs only on
    ``*`` (kept, Python escapes it) and ``~`` (escaped, Python keeps it)."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def naukri_url(keyword: Column, location: Column, page: Column, base: str = "https://www.naukri.com") -> Column:
    """Lower-case slugs (spaces -> "-"), ``-{page}`` from page 2 on, max two days old."""
    slug = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("-"))
    return F.concat(F.lit(base + "/"), slug(keyword), F.lit("-jobs-in-"), slug(location),
                    F.when(page > 1, F.concat(F.lit("-"), page.cast("string"))).otherwise(F.lit("")),
                    F.lit("?jobAge=2"))


def linkedin_url(keyword: Column, location: Column, page: Column,
                 base: str = "https://www.linkedin.com/jobs/search") -> Column:
    """Guest search, 25 results per page (``start`` = page index x 25), past 7 days."""
    start = ((page - 1) * 25).cast("string")
    return F.concat(F.lit(base + "?keywords="), quote_plus(keyword), F.lit("&location="), quote_plus(location),
                    F.lit("&trk=public_jobs_jobs-search-bar_search-submit&position=1&pageNum=0&start="), start,
                    F.lit("&f_TPR=r604800"))


def cognizant_url(keyword: Column, page: Column,
                  base: str = "https://careers.cognizant.com/global/en/search-results") -> Column:
    """10 results per page; the first page has no offset."""
    first = F.concat(F.lit(base + "?keywords="), quote_plus(keyword))
    return F.when(page > 1, F.concat(first, F.lit("&from="), ((page - 1) * 10).cast("string"), F.lit("&s=1"))) \
        .otherwise(first)


def search_query(site_domain: Column, keyword: Column, location: Column,
                 exclusions: Iterable[str] = D.SEARCH_EXCLUSIONS) -> Column:
    """The site-restricted web query text for a search API."""
    excl = " ".join(f"-{w}" for w in exclusions)
    return F.concat(F.lit("site:"), site_domain, F.lit(' "'), keyword, F.lit('" '), location,
                    F.lit(f" {D.SEARCH_SITE_OPERATORS} {excl}"))


def frontier(keywords: DataFrame, keyword_col: str, locations: Iterable[str], max_pages: int = 3) -> DataFrame:
    """S10 + J6: one row per (keyword, location, page) with the URLs to fetch."""
    locs = F.array(*[F.lit(x) for x in locations])
    pages = F.sequence(F.lit(1), F.lit(max_pages))
    df = (keywords.select(F.col(keyword_col).alias("keyword")).distinct()
          .select("keyword", F.posexplode(locs).alias("location_rank", "location"))
          .select("keyword", "location_rank", "location", F.explode(pages).alias("page")))
    return df.select(
        "keyword", "location", "page",
        naukri_url(F.col("keyword"), F.col("location"), F.col("page")).alias("naukri_url"),
        linkedin_url(F.col("keyword"), F.col("location"), F.col("page")).alias("linkedin_url"),
        cognizant_url(F.col("keyword"), F.col("page")).alias("cognizant_url"),
    )


def stop_at_first_empty(pages: DataFrame, search_cols: Iterable[str], page_col: str = "page_no",
                        count_col: str = "n_cards") -> DataFrame:
    """Per search, keep the pages before the first page that yielded no card.

    The first empty page per search is an aggregate (partially computed before the
    shuffle, so a search holding a third of all pages is no hot task) joined back
    on the search key.
    """
    keys = list(search_cols)
    first_empty = pages.groupBy(*keys).agg(
        F.min(F.when(F.col(count_col) == 0, F.col(page_col))).alias("_first_empty"))
    return (pages.join(first_empty, keys, "left")
            .where(F.col("_first_empty").isNull() | (F.col(page_col) < F.col("_first_empty")))
            .drop("_first_empty"))
