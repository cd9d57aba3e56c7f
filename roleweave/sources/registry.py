"""New sources plug in as functions ``(spark, path, **options) -> DataFrame``
returning posting rows; a run unions whatever sources it is given (U1)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str):
    def deco(fn: Callable[..., DataFrame]):
        SOURCES[name] = fn
        return fn

    return deco


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns a source lacks are null; no dedup."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out


@register_source("career_pages")
def _career_pages(spark: SparkSession, path: str, keywords: str = "", **kw) -> DataFrame:
    from roleweave.sources.pages import harvest_links, read_pages

    return harvest_links(read_pages(spark, path), keywords, **kw)


@register_source("job_api")
def _job_api(spark: SparkSession, path: str, url_prefix: str = "", company: str = "", **kw) -> DataFrame:
    from roleweave.sources.api_json import read_job_api

    return read_job_api(spark.read.parquet(path), url_prefix, company, **kw)


@register_source("search_api")
def _search_api(spark: SparkSession, path: str, descriptions_path: str | None = None, **kw) -> DataFrame:
    from roleweave.sources.api_json import read_search_results

    desc = spark.read.parquet(descriptions_path) if descriptions_path else None
    return read_search_results(spark.read.parquet(path), desc, **kw)


@register_source("postings")
def _postings(spark: SparkSession, path: str, **_) -> DataFrame:
    return spark.read.parquet(path)
