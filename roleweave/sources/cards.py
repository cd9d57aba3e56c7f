"""Raw job cards to postings.

A raw card is a row of what a site's card shows: title, company, location, link and so
on, null where the card lacks the element.  The site's rules are a table that is joined
by site: defaults ("Unknown" title and company, "" elsewhere), link prefixing, title
cut, the validity rule (F7), the site region rule (F8) and the searched-place rule (F9).
How the cards are cut out of a site's markup is left to the pages' source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.functions import dictionaries as D
from roleweave.functions.text import text_or_empty, truncate

RULES_SCHEMA = ("site string, source string, base_url string, prefix_rooted_only boolean, company string, "
                "default_location string, cut_title boolean, require_valid boolean, require_title boolean, "
                "region_words array<string>, "
                "title_region boolean, location_region boolean, url_cities array<string>, "
                "searched_location string")


def _normalize(c: DataFrame) -> DataFrame:
    title0 = F.coalesce(F.col("title"), F.lit("Unknown"))
    title = F.when(F.col("cut_title"), truncate(title0, D.TITLE_MAX_CHARS)).otherwise(title0)
    company = F.coalesce(F.col("rule_company"), F.col("card_company"), F.lit("Unknown"))
    link = text_or_empty("link")
    url = F.when((link != "") & ~link.startswith("http") & (~F.col("prefix_rooted_only") | link.startswith("/")),
                 F.concat(F.col("base_url"), link)).otherwise(link)
    # a missing location element takes the site default; an empty one stays empty
    location = F.coalesce(F.col("location"), F.col("default_location"), F.lit(""))
    df = c.select(
        "page_id", "site", "card_no", title.alias("title"), company.alias("company"), location.alias("location"),
        text_or_empty("experience").alias("experience"), text_or_empty("description").alias("description"),
        url.alias("url"), F.col("source"), F.col("posted").alias("posted_date"), "skills",
        "require_valid", "region_words", "title_region", "location_region", "url_cities", "searched_location",
        (F.col("require_title") & F.col("title").isNull()).alias("_no_title"),
    )
    # a card without title or link is dropped (sites that require it); company sites
    # skip a card whose title element is missing
    valid = ~F.col("require_valid") | ((F.col("title") != "Unknown") & (F.col("url") != ""))
    # F8: site region words in the location (an empty location is not in the region),
    # or "india" in the title / location when the site says so, or one of the site's
    # city names in the url; a site without region words keeps everything
    loc_lc, title_lc, url_lc = F.lower("location"), F.lower("title"), F.lower("url")
    words = F.coalesce("region_words", F.array().cast("array<string>"))
    region = F.exists(words, lambda w: (loc_lc != "") & loc_lc.contains(w))
    region = (F.size(words) == 0) | region \
        | (F.col("title_region") & title_lc.contains("india")) \
        | (F.col("location_region") & loc_lc.contains("india")) \
        | F.exists(F.coalesce("url_cities", F.array().cast("array<string>")), lambda w: url_lc.contains(w))
    # searched-location rule (Cognizant): keep if the location contains the searched
    # place, the search was for "india", or the card says "multiple locations"
    sl = F.lower(F.coalesce("searched_location", F.lit("")))
    searched = (sl == "") | loc_lc.contains(sl) | (sl == "india") | (loc_lc == "multiple locations")
    return df.where(valid & ~F.col("_no_title") & region & searched).drop(
        "_no_title", "require_valid", "region_words", "title_region", "location_region", "url_cities", "searched_location")


def cards_to_postings(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """S4 + J7: raw cards and the rules table -> postings; a card of a site without rules is dropped."""
    r = rules.withColumnRenamed("company", "rule_company")
    c = raw.withColumnRenamed("company", "card_company").join(r, "site")
    return _normalize(c)
