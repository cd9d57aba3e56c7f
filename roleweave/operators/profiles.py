"""Profiles from résumé text.

One row in, one row out: every extractor is a native expression over the whole
text (regular expressions rewritten from Python's Unicode semantics, see
:func:`roleweave.functions.text.java_regex`), so ``build_profiles`` is a single
``select`` with no shuffle, whatever the size of the résumé table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.functions import dictionaries as D
from roleweave.functions.dates import IST_ZONE, as_of_lit
from roleweave.functions.text import bounded_regex, col, dictionary_hits, java_regex, strip, title_case


def _empty() -> Column:
    return F.array().cast("array<string>")


def extract_skills(text="text", skills: Iterable[str] = D.TECHNICAL_SKILLS) -> Column:
    """Sorted distinct dictionary skills occurring in ``lower(text)`` not touching a
    word character on either side.

    Skills of word characters alone are intersected with the text's tokens; the others
    are searched one by one, the bounded regex only where the skill occurs at all.
    """
    return dictionary_hits(F.lower(col(text)), skills, bounded=True)


def _ints(arr: Column) -> Column:
    return F.filter(F.transform(arr, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def extract_experience_years(text="text", as_of=None) -> Column:
    """Years of experience.

    First from month-year ranges (the separator may be empty): the span between
    the smallest and largest 4-digit year (1990-2099) found inside them, where an
    open end ("present", "current", "now", "date") counts as the IST year of
    ``as_of``; used when positive.  Otherwise the largest number stated as
    "N years of experience" / "experience: N years" / "N years in ...", or 0.
    """
    t = col(text)
    # the range starts with a month name and ends with a digit or a word, so Python's
    # \b on either side is the one-sided test (cheap); see bounded_regex
    ranges = F.regexp_extract_all(t, F.lit(bounded_regex(D.DATE_RANGE_PATTERN, ignore_case=True)), 0)
    year_re = java_regex(D.YEAR_PATTERN)
    years = F.flatten(F.transform(ranges, lambda m: _ints(F.regexp_extract_all(m, F.lit(year_re), 1))))
    open_re = java_regex(r"(?i)" + D.DATE_RANGE_OPEN_PATTERN)
    has_open = F.exists(ranges, lambda m: m.rlike(open_re))
    now_year = F.year(F.from_utc_timestamp(as_of_lit(as_of), IST_ZONE)).cast("bigint")
    lo = F.array_min(years)
    hi = F.when(has_open, now_year).otherwise(F.array_max(years))
    span = F.when((F.size(years) > 0) & (hi > lo), hi - lo)
    stated = F.concat(*[_ints(F.regexp_extract_all(t, F.lit(java_regex(p, ignore_case=True)), 1))
                        for p in D.STATED_YEARS_PATTERNS])
    return F.coalesce(span, F.array_max(stated), F.lit(0).cast("bigint"))


def _pattern_matches(t: Column, patterns: Iterable[str]) -> Column:
    """All matches of every ``\\bpattern\\b`` (case-insensitive), pattern by pattern
    (overlaps across patterns are kept, as with separate searches).

    Word-boundary tests at every position are the expensive part, so each pattern
    is first tested without boundaries — a necessary condition — and only rows
    where it occurs run the bounded extraction.
    """
    arrs = []
    for p in patterns:
        gate = t.rlike(java_regex(p, ignore_case=True))
        found = F.regexp_extract_all(t, F.lit(bounded_regex(p, ignore_case=True)), 0)
        arrs.append(F.when(gate, found).otherwise(_empty()))
    return F.flatten(F.array(*arrs))


def _titled_set(arr: Column) -> Column:
    """Distinct, stripped, title-cased, sorted."""
    return F.sort_array(F.array_distinct(F.transform(arr, lambda m: title_case(strip(m)))))


def extract_titles(text="text", patterns: Iterable[str] = D.JOB_TITLE_PATTERNS) -> Column:
    """X3."""
    return _titled_set(_pattern_matches(col(text), patterns))


def extract_education(text="text", patterns: Iterable[str] = D.EDUCATION_PATTERNS,
                      max_line: int = D.INSTITUTION_LINE_MAX_CHARS) -> Column:
    """Degree patterns plus whole lines naming an institution (shorter than ``max_line``)."""
    t = col(text)
    # ".*\b(words)\b.*" without DOTALL matches exactly the lines holding a word, whole;
    # testing each line is the same and avoids the pattern's quadratic backtracking
    words = "(?:" + "|".join(D.INSTITUTION_WORDS) + ")"
    word_re = bounded_regex(words, ignore_case=True)
    lines = F.when(t.rlike(java_regex(words, ignore_case=True)),
                   F.filter(F.split(t, "\n"), lambda u: u.rlike(word_re))).otherwise(_empty())
    short = F.filter(F.transform(lines, lambda u: strip(u)), lambda u: F.length(u) < max_line)
    return _titled_set(F.concat(_pattern_matches(t, patterns), short))


def extract_email(text="text") -> Column:
    """First e-mail address, "" when none (texts without "@" skip the search)."""
    t = col(text)
    return F.when(t.contains("@"), F.regexp_extract(t, java_regex(D.EMAIL_PATTERN), 0)).otherwise(F.lit(""))


def extract_phone(text="text") -> Column:
    """First run of digits/spaces/dashes/brackets holding at least 10 digits, stripped."""
    cands = F.regexp_extract_all(col(text), F.lit(java_regex(D.PHONE_CANDIDATE_PATTERN)), 0)
    ok = F.filter(cands, lambda p: F.length(F.regexp_replace(p, r"(?U)\D", "")) >= D.PHONE_MIN_DIGITS)
    return F.coalesce(strip(F.get(ok, 0)), F.lit(""))


def extract_links(text="text", keep: Iterable[str] = D.LINK_KEEP_WORDS) -> Column:
    """Profile links (linkedin, github, gitlab, portfolio), trailing punctuation
    removed, first-occurrence order, no repeats."""
    keep = list(keep)
    t = col(text)
    # a kept link contains one of the keep words, so a text without any has no kept
    # link: skip the (backtracking-heavy) URL search there
    low_t = F.lower(t)
    any_word = None
    for w in keep:
        any_word = low_t.contains(w) if any_word is None else (any_word | low_t.contains(w))
    found = F.when(any_word, F.regexp_extract_all(t, F.lit(java_regex(D.LINK_PATTERN)), 0)).otherwise(_empty())

    def wanted(x):
        low = F.lower(x)
        out = None
        for w in keep:
            out = low.contains(w) if out is None else (out | low.contains(w))
        return out

    cleaned = F.transform(F.filter(found, wanted), lambda x: F.regexp_replace(x, D.LINK_TRAILING_PUNCT, ""))
    return F.array_distinct(cleaned)


def summary(titles: Column, skills: Column, education: Column, text: Column, max_chars: int | None = None) -> Column:
    """Labelled lists (absent ones omitted) followed by the text, newline-joined.

    The whole text is used by default; ``max_chars`` cuts it (the original matcher
    used the first 2000 characters).
    """
    body = text if max_chars is None else F.substring(text, 1, max_chars)
    lt, ls, le = D.SUMMARY_LABELS
    return F.concat_ws(
        "\n",
        F.when(F.size(titles) > 0, F.concat(F.lit(lt), F.array_join(titles, ", "))),
        F.when(F.size(skills) > 0, F.concat(F.lit(ls), F.array_join(skills, ", "))),
        F.when(F.size(education) > 0, F.concat(F.lit(le), F.array_join(education, ", "))),
        body,
    )


def search_keyword(titles="job_titles", needle: str = D.KEYWORD_NEEDLE, fallback: str = D.KEYWORD_FALLBACK) -> Column:
    """The first (alphabetical) title containing ``needle``, else ``fallback``."""
    hit = F.filter(col(titles), lambda t: F.lower(t).contains(needle.lower()))
    return F.coalesce(F.get(hit, 0), F.lit(fallback))


def build_profiles(resumes: DataFrame, as_of=None, id_col: str = "profile_id", text_col: str = "text",
                   skills: Iterable[str] = D.TECHNICAL_SKILLS, summary_chars: int | None = None) -> DataFrame:
    """One profile per résumé row (narrow; no shuffle).

    A blank text gives the empty profile whose ``raw_text`` is the fixed
    "could not extract" marker.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = resumes.select(F.col(id_col).alias("profile_id"), t.alias("raw_text"))
    df = df.select(
        "profile_id", "raw_text",
        extract_skills("raw_text", skills).alias("skills"),
        extract_experience_years("raw_text", as_of).alias("experience_years"),
        extract_education("raw_text").alias("education"),
        extract_titles("raw_text").alias("job_titles"),
        extract_email("raw_text").alias("email"),
        extract_phone("raw_text").alias("phone"),
        extract_links("raw_text").alias("links"),
    )
    blank = strip(F.col("raw_text")) == ""
    out = df.select(
        "profile_id",
        F.when(blank, F.lit("")).otherwise(F.col("email")).alias("email"),
        F.when(blank, F.lit("")).otherwise(F.col("phone")).alias("phone"),
        F.when(blank, _empty()).otherwise(F.col("links")).alias("links"),
        F.when(blank, _empty()).otherwise(F.col("skills")).alias("skills"),
        F.when(blank, F.lit(0).cast("bigint")).otherwise(F.col("experience_years")).alias("experience_years"),
        F.when(blank, _empty()).otherwise(F.col("job_titles")).alias("job_titles"),
        F.when(blank, _empty()).otherwise(F.col("education")).alias("education"),
        F.when(blank, F.lit(D.EMPTY_RESUME_TEXT)).otherwise(F.col("raw_text")).alias("raw_text"),
        F.when(blank, F.lit("")).otherwise(
            summary(F.col("job_titles"), F.col("skills"), F.col("education"), F.col("raw_text"), summary_chars)
        ).alias("summary"),
    )
    return out
