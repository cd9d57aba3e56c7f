"""Raw pages -> postings from their links.

A page table (page_id, url, html) is scanned; every ``<a href=...>...</a>`` is
pulled out with native regular expressions (scripts, styles and comments are
dropped first), its text is the concatenation of its stripped text nodes,
short texts fall back to ``aria-label`` then ``title``, and links that look like
job links and mention a search keyword become postings.  Everything is a
projection plus one ``row_number`` per (page, url) — no parser UDF.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roleweave.functions import dictionaries as D
from roleweave.functions.postings import job_id
from roleweave.functions.text import col, contains_any, strip, truncate
from roleweave.functions.urls import absolute_url, company_from_host

_ANCHOR = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
_NOISE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A page table; pages without html yield nothing."""
    df = spark.read.parquet(path) if fmt == "parquet" else spark.read.format(fmt).load(path)
    return df.where(F.col("html").isNotNull() & (F.col("html") != ""))


def unescape(c: Column) -> Column:
    """The common named/decimal character references (``&amp;`` last)."""
    out = c
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
                    ("&nbsp;", " "), ("&#34;", '"'), ("&#60;", "<"), ("&#62;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def attribute(attrs: Column, name: str) -> Column:
    """Value of attribute ``name`` in an attribute string (quoted or bare); null if absent."""
    pat = rf"(?is)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    present = attrs.rlike(rf"(?is)(?:^|\s){name}\s*=")
    val = F.concat(F.regexp_extract(attrs, pat, 1), F.regexp_extract(attrs, pat, 2), F.regexp_extract(attrs, pat, 3))
    return F.when(present, unescape(val))


def link_text(inner: Column) -> Column:
    """Text of an element with every text node stripped and joined with no separator."""
    nodes = F.split(inner, "<[^>]*>")
    return F.array_join(F.transform(nodes, lambda t: strip(unescape(t))), "")


def anchors(pages: DataFrame) -> DataFrame:
    """One row per ``<a>`` with an ``href``: page_id, page_url, pos, href, text, aria, title_attr."""
    clean = F.regexp_replace(F.col("html"), _NOISE, "")
    z = F.arrays_zip(F.regexp_extract_all(clean, F.lit(_ANCHOR), 1).alias("attrs"),
                     F.regexp_extract_all(clean, F.lit(_ANCHOR), 2).alias("inner"))
    a = (pages.where(F.col("html").isNotNull() & (F.col("html") != ""))
         .select("page_id", F.col("url").alias("page_url"), F.posexplode(z).alias("pos", "a")))
    return (a.select("page_id", "page_url", "pos", F.col("a.attrs").alias("attrs"), F.col("a.inner").alias("inner"))
            .withColumn("href", attribute(F.col("attrs"), "href"))
            .where(F.col("href").isNotNull())
            .select("page_id", "page_url", "pos", "href", link_text(F.col("inner")).alias("text"),
                    attribute(F.col("attrs"), "aria-label").alias("aria"),
                    attribute(F.col("attrs"), "title").alias("title_attr")))


def is_job_link(href="href", text="text", url_patterns: Iterable[str] = D.JOB_URL_PATTERNS,
                link_words: Iterable[str] = D.JOB_LINK_WORDS) -> Column:
    """the href matches a job-URL pattern, or the (lower, stripped) text is longer
    than 5 characters and contains a job word."""
    h = F.lower(F.coalesce(col(href), F.lit("")))
    t = strip(F.lower(F.coalesce(col(text), F.lit(""))))
    by_url = h.rlike("|".join(f"(?:{p})" for p in url_patterns)) if url_patterns else F.lit(False)
    by_text = (F.length(t) > D.LINK_WORDS_MIN_TEXT) & contains_any(t, list(link_words))
    return by_url | by_text


def keyword_tokens(keywords: str) -> list[str] | None:
    """F6 tokens: comma-separated keywords split on whitespace; None when no keyword."""
    kws = [k.strip().lower() for k in keywords.split(",") if k.strip()]
    if not kws:
        return None
    return sorted({tok for k in kws for tok in k.split()})


def mentions_keyword(text="text", keywords: str = "") -> Column:
    """no keywords -> true; else some token longer than 3 characters occurs in the
    lower-cased text (keywords with only short tokens match nothing)."""
    toks = keyword_tokens(keywords)
    if toks is None:
        return F.lit(True)
    toks = [t for t in toks if len(t) > D.KEYWORD_TOKEN_MIN_CHARS]
    return contains_any(F.lower(col(text)), toks)


def harvest_links(pages: DataFrame, keywords: str = "", url_patterns: Iterable[str] = D.JOB_URL_PATTERNS,
                  link_words: Iterable[str] = D.JOB_LINK_WORDS, location: str = D.CAREER_PAGE_LOCATION,
                  source: str = "career_page") -> DataFrame:
    """Postings from the job links of career pages.

    Per page, links are taken in document order; a resolved URL is kept the first
    time a link to it passes the filters (W3).
    """
    a = anchors(pages)
    short = F.length(F.col("text")) < D.LINK_TEXT_MIN_CHARS
    alt = F.coalesce(F.nullif(F.col("aria"), F.lit("")), F.nullif(F.col("title_attr"), F.lit("")), F.lit(""))
    a = a.withColumn("text", F.when(short, alt).otherwise(F.col("text")))
    a = a.where(F.length("text") >= D.LINK_TEXT_MIN_CHARS)
    a = a.withColumn("url", absolute_url("page_url", "href"))
    a = a.where(is_job_link("href", "text", url_patterns, link_words) & mentions_keyword("text", keywords))
    w = Window.partitionBy("page_id", "url").orderBy("pos")
    a = a.withColumn("_first", F.row_number().over(w)).where(F.col("_first") == 1)
    out = a.select(
        "page_id", "pos",
        truncate("text", D.TITLE_MAX_CHARS).alias("title"),
        company_from_host("page_url").alias("company"),
        F.lit(location).alias("location"),
        F.lit("").alias("description"),
        "url",
        F.lit(source).alias("source"),
    )
    return out.withColumn("job_id", job_id("title", "company", "url"))
