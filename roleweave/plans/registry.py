"""The registered query set: one Spark builder and one DuckDB oracle per operator group.

Every builder takes ``(spark, sf_dir)``, reads the driver's tables (or the
stand-ins Spark derives from them, see :mod:`roleweave.plans.stand_ins`) and
returns a DataFrame whose column names equal the oracle's.  Doubles are
rounded to 6 places and times rendered as text in both, so the comparison
hashes identical values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.plans import stand_ins as S
from roleweave.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# parameters of the fixtures: word lists that hit the driver's data (the
# defaults stay the original ones)
FX_ALIGN_WORDS = ("gear", "rod")
FX_THRESHOLD = 0.35
FX_PLACE = "nation_15"
FX_MATCH = {"align_words": FX_ALIGN_WORDS, "preferred_place": FX_PLACE}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run

    return deco


def _ts_text(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


# --------------------------------------------------------------------------
# T12 — match (similarity none): supplier profiles x lineitem postings
# --------------------------------------------------------------------------
_EXP_SQL = r"""
  case when s_exp = '' then 0::bigint
       when regexp_matches(s_exp, '(\d+)\s*(?:-|to)\s*(\d+)') then try_cast(regexp_extract(s_exp, '(\d+)\s*(?:-|to)\s*(\d+)', 1) as bigint)
       when regexp_matches(s_exp, '(\d+)\+?\s*y') and (contains(s_exp, 'up to') or contains(s_exp, 'max')) then 0::bigint
       when regexp_matches(s_exp, '(\d+)\+?\s*y') then try_cast(regexp_extract(s_exp, '(\d+)\+?\s*y', 1) as bigint)
       else 0::bigint end as exp_min,
  case when s_exp = '' then 99::bigint
       when regexp_matches(s_exp, '(\d+)\s*(?:-|to)\s*(\d+)') then try_cast(regexp_extract(s_exp, '(\d+)\s*(?:-|to)\s*(\d+)', 2) as bigint)
       when regexp_matches(s_exp, '(\d+)\+?\s*y') and (contains(s_exp, 'up to') or contains(s_exp, 'max')) then try_cast(regexp_extract(s_exp, '(\d+)\+?\s*y', 1) as bigint)
       when regexp_matches(s_exp, '(\d+)\+?\s*y') then 99::bigint
       else 99::bigint end as exp_max"""

_MATCH_SQL_TEMPLATE = r"""
posts0 as (
  select *, lower(coalesce(experience, '')) as s_exp from {src}),
posts as (
  select ord, posted_ts, company, md5(regexp_replace(lower(concat(title,'|',company,'|',url)), '^\s+|\s+$', '', 'g')) as job_id,
         lower(concat_ws(' ', title, description, company, location, skill_text, experience)) as text_lc,
         lower(title) as title_lc,
         (contains(lower(title), 'gear') or contains(lower(title), 'rod')) as align,
         contains(lower(location), 'nation_15') as place,
         coalesce(experience, '') <> '' as has_exp,
         """ + _EXP_SQL + r"""
  from posts0),
kept as (select * from posts where not has_exp or not (exp_min > 4 or exp_max < 1)),
prof as (
  select profile_id, list_distinct(list_transform(skills, lambda x: lower(x))) as sk,
         list_distinct(list_transform(job_titles, lambda x: lower(x))) as ti, experience_years as years
  from fx_profiles),
pairs as (
  select p.profile_id, p.years, j.*,
         list_sort(list_filter(p.sk, lambda s: contains(j.text_lc, s))) as skill_hits,
         list_sort(list_filter(p.ti, lambda t: contains(j.title_lc, t))) as title_hits
  from prof p cross join kept j),
comp as (
  select *,
    case when len(skill_hits) > 0 then least(len(skill_hits) * 0.03::double, 0.30::double) else 0.0::double end as sb,
    case when len(title_hits) > 0 then 0.15::double else 0.0::double end as tb,
    case when align then 0.10::double else 0.0::double end as al,
    case when place then 0.05::double else 0.0::double end as pl,
    case when not has_exp then 0.0::double
         when exp_min <= years and years <= exp_max and exp_max <> 99 then 0.20::double
         when exp_min <= years then 0.10::double
         when exp_min - years >= 2 then -0.50::double
         else -0.15::double end as ex,
    case when not has_exp then null
         when exp_min <= years and years <= exp_max and exp_max <> 99
           then concat('Exp match (', years, ' yrs in ', exp_min, '-', exp_max, ' range)')
         when exp_min <= years then concat('Exp match (meets min ', exp_min, ' yrs)')
         when exp_min - years >= 2 then concat('Exp penalty (requires ', exp_min, ' yrs, has ', years, ')')
         else concat('Exp penalty (slightly under ', exp_min, ' yrs)') end as exr
  from pairs),
scored as (
  select *, greatest(0.0::double, least(0.0::double + sb + tb + al + pl + ex, 1.0::double)) as score,
         list_filter([
           case when len(skill_hits) > 0 then concat('Skills match: ', array_to_string(skill_hits[1:5], ', ')) end,
           case when len(title_hits) > 0 then concat('Title match: ', array_to_string(title_hits[1:3], ', ')) end,
           case when align then 'High Profile Alignment (Java/Backend)' end,
           case when place then 'Location Preference (Mumbai)' end,
           exr], lambda x: x is not null) as rs
  from comp)
"""

_MATCH_SQL_BODY = _MATCH_SQL_TEMPLATE.replace("{src}", "fx_postings")

MATCH_SQL = S.with_ctes(_MATCH_SQL_BODY + f"""
select profile_id, ord, job_id, round(score, 6) as score, cast(trunc(score * 100) as integer) as score_pct,
       array_to_string(case when len(rs) = 0 then ['Content similarity'] else rs end, ' | ') as reasons
from scored where score >= {FX_THRESHOLD}
""", "fx_postings", "fx_profiles")


@register("match_scores", MATCH_SQL)
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T12 over the whole supplier-profile and lineitem-posting stand-ins."""
    from roleweave.operators.matching import match

    m = match(S.profiles(spark, sf_dir), S.postings(spark, sf_dir), threshold=FX_THRESHOLD, **FX_MATCH)
    return m.select("profile_id", "ord", "job_id", F.round("score", 6).alias("score"), "score_pct",
                    F.array_join("reasons", " | ").alias("reasons"))


# --------------------------------------------------------------------------
# shared fixture parameters for the gates
# --------------------------------------------------------------------------
FX_REGION_WORDS = ("asia",)
FX_FOREIGN_WORDS = ("nation_2", "america")
FX_TARGETS = ("nation_1", "india")

_BOUND = r"[^\p{L}\p{N}_]"


def _sql_contains_any(expr: str, words) -> str:
    return "(" + " or ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def _sql_bounded_any(expr: str, words) -> str:
    alts = "|".join(words)
    return f"regexp_matches({expr}, '(^|{_BOUND})({alts})($|{_BOUND})')"


def _sql_location_cols(src_loc="location", src_title="title") -> str:
    loc = f"coalesce({src_loc}, '')"
    low = f"lower({loc})"
    in_region = f"({loc} = '' or {_sql_contains_any(low, FX_REGION_WORDS)})"
    foreign = _sql_bounded_any(f"lower(concat(coalesce({src_title}, ''), ' ', {loc}))", FX_FOREIGN_WORDS)
    from roleweave.functions import dictionaries as D

    fallback = f"({_sql_contains_any(low, D.FALLBACK_PLACES)} and not {_sql_contains_any(low, D.EXCLUDED_CITIES)})"
    keep = (f"(not {foreign} and ({loc} = '' or {_sql_contains_any(low, FX_TARGETS)} or {in_region} "
            f"or {fallback}))")
    return f"{in_region} as in_region, {foreign} as is_foreign, {keep} as keep_location"


def _location_cols_spark(df):
    from roleweave.operators import filters

    return df.select(
        "*",
        filters.is_in_region("location", FX_REGION_WORDS).alias("in_region"),
        filters.is_foreign("title", "location", FX_FOREIGN_WORDS).alias("is_foreign"),
        filters.location_gate(FX_TARGETS, region_words=FX_REGION_WORDS, foreign_words=FX_FOREIGN_WORDS)
        .alias("keep_location"),
    )


# --------------------------------------------------------------------------
# P1, P2, P6, P7, P12, F10 — posting keys and derived columns
# --------------------------------------------------------------------------
POSTING_KEYS_SQL = S.with_ctes(r"""
p as (select *, lower(coalesce(experience, '')) as s_exp from fx_postings),
q as (select ord, md5(regexp_replace(lower(concat(title,'|',company,'|',url)), '^\s+|\s+$', '', 'g')) as job_id,
             concat_ws(' ', title, description, company, location, skill_text, experience) as job_text,
             split_part(url, '?', 1) as url_no_query, substr(title, 1, 200) as short_title,
             """ + _EXP_SQL + r""", s_exp from p)
select ord, job_id, job_text, url_no_query, short_title, exp_min, exp_max,
       (s_exp = '' or not (exp_min > 4 or exp_max < 1)) as keeps_experience
from q
""", "fx_postings")


@register("posting_keys", POSTING_KEYS_SQL)
def posting_keys(spark, sf_dir):
    """P1 job id, P2 job text, P6 url without query, P7 title cut, P12 experience range, F10."""
    from roleweave.functions import postings as P
    from roleweave.operators.filters import keeps_experience

    df = S.postings(spark, sf_dir)
    rng = P.experience_range("experience")
    return df.select("ord", P.job_id().alias("job_id"), P.job_text().alias("job_text"),
                     P.strip_query("url").alias("url_no_query"), P.short_title("title").alias("short_title"),
                     rng["min"].alias("exp_min"), rng["max"].alias("exp_max"),
                     keeps_experience("experience").alias("keeps_experience"))


# --------------------------------------------------------------------------
# F1, F2, F3 — location gate
# --------------------------------------------------------------------------
LOCATION_GATE_SQL = S.with_ctes(f"""
select ord, {_sql_location_cols()} from fx_postings
""", "fx_postings")


@register("location_gate", LOCATION_GATE_SQL)
def location_gate(spark, sf_dir):
    """F1 region words, F2 word-bounded foreign words, F3 strict location gate."""
    return _location_cols_spark(S.postings(spark, sf_dir)).select("ord", "in_region", "is_foreign", "keep_location")


# --------------------------------------------------------------------------
# P11, F4, F12 — free-text dates, recency gate, freshness
# --------------------------------------------------------------------------
_ISO_RE = (r"^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6}))?)?)?"
           r"([+-]\d{2}(?::?\d{2})?)?)?$")


def _sql_posted_ts(raw: str, as_of: str) -> str:
    s = f"regexp_replace(lower(coalesce({raw}, '')), '^\\s+|\\s+$', '', 'g')"
    si = f"replace({s}, 'z', '+00:00')"
    g = lambda i: f"regexp_extract({si}, '{_ISO_RE}', {i})"
    num = lambda i: f"cast(coalesce(nullif({g(i)}, ''), '0') as integer)"
    frac = f"cast(rpad(coalesce(nullif({g(7)}, ''), '0'), 6, '0') as integer) / 1000000.0"
    off = g(8)
    off_min = (f"(case when {off} = '' then 0 else "
               f"(case when substr({off}, 1, 1) = '-' then -1 else 1 end) * "
               f"(cast(substr({off}, 2, 2) as integer) * 60 + "
               f"coalesce(try_cast(nullif(substr(replace({off}, ':', ''), 4, 2), '') as integer), 0)) end)")
    iso = (f"try(make_timestamp({num(1)}, {num(2)}, {num(3)}, {num(4)}, {num(5)}, {num(6)} + {frac}) "
           f"- to_minutes({off_min}))")
    unit = f"regexp_extract({s}, '(\\d+)\\s+(day|week|month|year)', 2)"
    n = f"try_cast(regexp_extract({s}, '(\\d+)\\s+(day|week|month|year)', 1) as integer)"
    mult = f"(case {unit} when 'day' then 1 when 'week' then 7 when 'month' then 30 else 365 end)"
    since = f"date_diff('day', DATE '0001-01-01', TIMESTAMP '{as_of}'::date)"
    return (f"(case when coalesce({raw}, '') = '' then TIMESTAMP '{as_of}' - INTERVAL 86400 SECOND "
            f"when regexp_matches({si}, '{_ISO_RE}') and {iso} is not null then {iso} "
            f"when contains({s}, 'just now') or contains({s}, 'today') or contains({s}, 'hour') "
            f"or contains({s}, 'minute') then TIMESTAMP '{as_of}' "
            f"when regexp_matches({s}, '(\\d+)\\s+(day|week|month|year)') and {n} is not null "
            f"and {n}::bigint * {mult} <= {since} "
            f"then TIMESTAMP '{as_of}' - to_days(cast(least({n}::bigint * {mult}, {since}) as integer)) "
            f"else TIMESTAMP '1970-01-01 00:00:00' end)")


RECENCY_SQL = S.with_ctes(f"""
d as (select ord, source, posted_date, {_sql_posted_ts('posted_date', S.AS_OF)} as ts from fx_postings)
select ord, posted_date, strftime(ts, '%Y-%m-%d %H:%M:%S') as parsed_ts,
       ts >= TIMESTAMP '{S.AS_OF}' - to_days(case when lower(coalesce(source, '')) = 'naukri' then 2 else 10 end)
         as recent,
       ts >= TIMESTAMP '{S.AS_OF}' - INTERVAL 86400 SECOND as fresh
from d
""", "fx_postings")


@register("recency_gate", RECENCY_SQL)
def recency_gate(spark, sf_dir):
    """P11 free-text date -> timestamp, F4 per-source age gate, F12 freshness."""
    from roleweave.functions.dates import is_fresh, with_posted_ts
    from roleweave.operators.filters import is_recent

    df = with_posted_ts(S.postings(spark, sf_dir).select("ord", "source", "posted_date"), "posted_date", S.AS_OF,
                        out="ts")
    return df.select("ord", "posted_date", _ts_text("ts").alias("parsed_ts"),
                     is_recent("ts", S.AS_OF).alias("recent"), is_fresh("ts", S.AS_OF).alias("fresh"))


# --------------------------------------------------------------------------
# J3, W1, O2, O3, W6, K4, P9, P10 — digest of un-notified matches
# --------------------------------------------------------------------------
_DIGEST_SQL_TAIL = r"""
matched as (select * from scored where score >= {t}),
todo as (select m.* from matched m where not exists (
           select 1 from fx_seen s where s.notified = 1 and s.job_id = m.job_id and s.profile_id = m.profile_id)),
keyed as (select *, case when coalesce(company, '') = '' then 'unknown'
                         else lower(regexp_replace(company, '^\s+|\s+$', '', 'g')) end as company_key from todo),
capped as (select * from (select *, row_number() over (partition by profile_id, company_key
                                   order by posted_ts desc, score desc, ord) as cr from keyed) where cr <= 2),
ranked as (select * from (select *, row_number() over (partition by profile_id
                                   order by posted_ts desc, score desc, ord) as rank from capped) where rank <= 30),
dig as (select r.*, p.title, p.url, p.location, p.source, p.description,
               cast(trunc(r.score * 100) as integer) as pct,
               array_to_string(case when len(r.rs) = 0 then ['Content similarity'] else r.rs end, ' | ') as reasons_text,
               count(*) over (partition by r.profile_id) as total_found
        from ranked r join {src} p on p.ord = r.ord)
"""

DIGEST_SQL = S.with_ctes(_MATCH_SQL_BODY + "," + _DIGEST_SQL_TAIL.format(t=FX_THRESHOLD, src="fx_postings") + f"""
select profile_id, rank, ord, job_id, title, url, company, location, source, round(score, 6) as score,
       pct as score_pct, case when pct >= 70 then 'high' when pct >= 40 then 'mid' else 'low' end as badge,
       reasons_text as reasons,
       concat(substr(coalesce(description, ''), 1, 200), case when length(coalesce(description, '')) > 200
              then '...' else '' end) as snippet,
       posted_ts >= TIMESTAMP '{S.AS_OF}' - INTERVAL 86400 SECOND as fresh, total_found
from dig
""", "fx_postings", "fx_profiles", "fx_seen")


def _fx_matches(spark, sf_dir, posts=None, **options):
    from roleweave.operators.matching import match

    posts = S.postings(spark, sf_dir) if posts is None else posts
    return match(S.profiles(spark, sf_dir), posts, threshold=FX_THRESHOLD, **options, **FX_MATCH)


def _fx_digest(spark, sf_dir):
    from roleweave.functions import dictionaries as D
    from roleweave.functions.dates import is_fresh
    from roleweave.operators import selection, state
    from roleweave.operators.matching import cutoffs_of, in_reach, newest

    posts, notified = S.postings(spark, sf_dir), S.notified(spark, sf_dir)

    def pick(matches):
        return selection.top_recent(selection.cap_per_company(state.unnotified(matches, notified)))

    # the newest postings bound how far back the digest of a profile can reach
    cutoffs = cutoffs_of(pick(_fx_matches(spark, sf_dir, newest(posts), by_job=True)), D.DIGEST_SIZE)
    reached = in_reach(posts, S.profiles(spark, sf_dir), cutoffs)
    picked = pick(_fx_matches(spark, sf_dir, reached, by_job=True, cutoffs=cutoffs)).withColumn("fresh", is_fresh("posted_ts", S.AS_OF))
    return selection.digest_rows(picked, reached)


@register("digest", DIGEST_SQL)
def digest(spark, sf_dir):
    """J3 un-notified, W1 two per company, O2/O3 newest-first top 30, K4 digest rows."""
    d = _fx_digest(spark, sf_dir)
    return d.select("profile_id", "rank", "ord", "job_id", "title", "url", "company", "location", "source",
                    F.round("score", 6).alias("score"), "score_pct", "badge",
                    F.array_join("reasons", " | ").alias("reasons"), "snippet", "fresh", "total_found")


DIGEST_TEXT_SQL = S.with_ctes(_MATCH_SQL_BODY + "," + _DIGEST_SQL_TAIL.format(t=FX_THRESHOLD, src="fx_postings") + r"""
select profile_id,
       concat('=== New Matches ===', chr(10), chr(10), string_agg(
         concat(rank, '. ', coalesce(title, ''), ' at ', coalesce(company, ''),
                chr(10), '   Location: ', coalesce(nullif(location, ''), 'N/A'),
                chr(10), '   Match: ', pct, '%',
                chr(10), '   Apply: ', coalesce(url, ''),
                chr(10), '   Reasons: ', array_to_string(case when len(rs) = 0 then ['Content similarity'] else rs end, ', '),
                chr(10)), chr(10) order by rank)) as message,
       count(*) as n_jobs
from dig group by profile_id
""", "fx_postings", "fx_profiles", "fx_seen")


@register("digest_text", DIGEST_TEXT_SQL)
def digest_text(spark, sf_dir):
    """K5: one plain-text digest message per profile."""
    from roleweave.operators.selection import digest_text as render

    return render(_fx_digest(spark, sf_dir))


# --------------------------------------------------------------------------
# K1, W4, J2 — rows a run adds to the seen table
# --------------------------------------------------------------------------
SEEN_APPEND_SQL = S.with_ctes(_MATCH_SQL_BODY + f""",
matched as (select * from scored where score >= {FX_THRESHOLD}),
firsts as (select * from (select *, row_number() over (partition by profile_id, job_id order by score desc, ord) as r
                          from matched) where r = 1)
select f.job_id, f.profile_id, p.title, p.url, round(f.score, 6) as score, '{S.AS_OF}' as first_seen
from firsts f join fx_postings p on p.ord = f.ord where not exists (select 1 from fx_seen s where s.job_id = f.job_id and s.profile_id = f.profile_id)
""", "fx_postings", "fx_profiles", "fx_seen")


@register("seen_append", SEEN_APPEND_SQL)
def seen_append(spark, sf_dir):
    """K1 insert-or-ignore: first match per profile and job id (W4) that is not yet seen."""
    from roleweave.operators import state

    from roleweave.operators.matching import with_shown

    m = with_shown(_fx_matches(spark, sf_dir, by_job=True), S.postings(spark, sf_dir), ("title", "location", "url", "source"))
    new = state.new_seen_rows(m, S.seen(spark, sf_dir), S.AS_OF, "fixture")
    return new.select("job_id", "profile_id", "title", "url", F.round("score", 6).alias("score"), _ts_text("first_seen").alias("first_seen"))


# --------------------------------------------------------------------------
# A9 — run funnel per source
# --------------------------------------------------------------------------
FUNNEL_SQL = S.with_ctes(f"""
g as (select source, {_sql_location_cols()}, {_sql_posted_ts('posted_date', S.AS_OF)} as ts from fx_postings)
select source, count(*) as found, count_if(keep_location) as after_location,
       count_if(keep_location and ts >= TIMESTAMP '{S.AS_OF}' - to_days(case when lower(coalesce(source, '')) = 'naukri'
                then 2 else 10 end)) as after_date
from g group by source
""", "fx_postings")


@register("run_funnel", FUNNEL_SQL)
def run_funnel(spark, sf_dir):
    """One pass of conditional counts per source: found -> location gate -> date gate."""
    from roleweave.functions.dates import with_posted_ts
    from roleweave.operators.filters import is_recent

    df = with_posted_ts(_location_cols_spark(S.postings(spark, sf_dir)), "posted_date", S.AS_OF, out="ts")
    return df.groupBy("source").agg(
        F.count("*").alias("found"),
        F.count_if("keep_location").alias("after_location"),
        F.count_if(F.col("keep_location") & is_recent("ts", S.AS_OF)).alias("after_date"))


# --------------------------------------------------------------------------
# A1, A2, A5, O4 — state statistics and the paged listing
# --------------------------------------------------------------------------
STATS_SQL = S.with_ctes("""
select count(*) as total_jobs_seen, cast(count_if(notified = 1) as bigint) as total_notified,
       cast(floor((count(*) + 19) / 20) as bigint) as pages
from fx_seen
""", "fx_seen")


@register("state_stats", STATS_SQL)
def state_stats(spark, sf_dir):
    """A1 total seen, A2 total notified, A5 listing pages of 20."""
    from roleweave.operators.selection import page_count

    seen = S.seen(spark, sf_dir)
    return seen.agg(F.count("*").alias("total_jobs_seen"),
                    F.count_if(F.col("notified") == 1).alias("total_notified")).select(
        "total_jobs_seen", "total_notified", page_count(F.col("total_jobs_seen")).alias("pages"))


STORE_STATS_SQL = S.with_ctes("""
select count(*) as total_jobs_seen, cast(count_if(notified = 1) as bigint) as total_notified,
       count(distinct strftime(first_seen, '%Y-%m-%d')) as total_runs,
       coalesce(concat(strftime(max(first_seen) + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%f'), '+05:30'), 'Never') as last_run
from fx_seen
""", "fx_seen")


@register("store_stats", STORE_STATS_SQL)
def store_stats(spark, sf_dir):
    """A1-A4: totals seen and notified, runs and the last run's time, with a run for each day
    on which a posting was first seen."""
    from roleweave.operators.state import stats

    seen = S.seen(spark, sf_dir)
    runs = seen.groupBy(F.date_format("first_seen", "yyyy-MM-dd").alias("run_id")).agg(F.max("first_seen").alias("timestamp"))
    return stats(seen, runs)


LISTING_SQL = S.with_ctes("""
select job_id, strftime(first_seen, '%Y-%m-%d') as first_seen_day,
       concat(strftime(first_seen + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%f'), '+05:30') as first_seen_ist,
       substr(concat(strftime(first_seen + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%f'), '+05:30'), 1, 16)
         as first_seen_minute,
       notified
from fx_seen order by first_seen desc, job_id limit 20 offset 20
""", "fx_seen")


@register("seen_listing", LISTING_SQL)
def seen_listing(spark, sf_dir):
    """Second page (20 rows, offset 20) of the seen table, newest first; P13 IST
    rendering and P14 display cuts of the first-seen time."""
    from roleweave.functions.dates import display_date, display_minute, ist_iso
    from roleweave.operators.selection import listing

    seen = S.seen(spark, sf_dir).withColumn("score", F.lit(0.0))
    page = listing(seen, limit=20, offset=20).withColumn("first_seen_ist", ist_iso("first_seen"))
    return page.select("job_id", display_date(F.date_format("first_seen", "yyyy-MM-dd")).alias("first_seen_day"),
                       "first_seen_ist", display_minute("first_seen_ist").alias("first_seen_minute"), "notified")


# --------------------------------------------------------------------------
# X1, X2, X5-X7, X10 — profiles extracted from the whole texts of `documents`
# --------------------------------------------------------------------------
def _re2_quote(w: str) -> str:
    return r"\Q" + w.replace("'", "''") + r"\E"


def _skills_sql(low: str) -> str:
    from roleweave.functions import dictionaries as D

    items = []
    for w in sorted(set(D.TECHNICAL_SKILLS)):
        lit = w.replace("'", "''")
        items.append(f"case when contains({low}, '{lit}') and regexp_matches({low}, "
                     f"'(^|{_BOUND}){_re2_quote(w)}($|{_BOUND})') then '{lit}' end")
    return "list_filter([" + ", ".join(items) + "], lambda x: x is not null)"


RESUME_SKILLS_SQL = f"""
select doc_id, array_to_string({_skills_sql('lower(text)')}, ',') as skills from documents
"""


@register("resume_skills", RESUME_SKILLS_SQL)
def resume_skills(spark, sf_dir):
    """X1 over every document's whole text: bounded dictionary skills, sorted."""
    from roleweave.operators.profiles import extract_skills
    from roleweave.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").repartition("doc_id")
    return docs.select("doc_id", F.array_join(extract_skills("text"), ",").alias("skills"))


_PY_SPACE = r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_RE2_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"
_RE2_PHONE = r"\+?[\d" + _PY_SPACE + r"\-\(\)]{10,20}"
_RE2_LINK = (r"(?:(?:https?|ftp):\/\/)?(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b"
             r"(?:[-a-zA-Z0-9()@:%_\+.~#?&//=]*)")

RESUME_CONTACTS_SQL = f"""
select doc_id,
       regexp_extract(text, '{_RE2_EMAIL}', 0) as email,
       coalesce(regexp_replace(list_filter(regexp_extract_all(text, '{_RE2_PHONE}'),
                  lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 10)[1],
                '^[{_PY_SPACE}]+|[{_PY_SPACE}]+$', '', 'g'), '') as phone,
       array_to_string(list_distinct(list_transform(list_filter(regexp_extract_all(text, '{_RE2_LINK}'),
                  lambda x: contains(lower(x), 'linkedin.com') or contains(lower(x), 'github.com')
                         or contains(lower(x), 'gitlab.com') or contains(lower(x), 'portfolio')),
                  lambda x: regexp_replace(x, '[.)\\]}}]+$', ''))), ' ') as links
from documents
"""


@register("resume_contacts", RESUME_CONTACTS_SQL)
def resume_contacts(spark, sf_dir):
    """X5 first e-mail, X6 first phone-like run with >= 10 digits, X7 profile links."""
    from roleweave.operators.profiles import extract_email, extract_links, extract_phone
    from roleweave.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").repartition("doc_id")
    return docs.select("doc_id", extract_email("text").alias("email"), extract_phone("text").alias("phone"),
                       F.array_join(extract_links("text"), " ").alias("links"))


def _experience_sql() -> str:
    from roleweave.functions import dictionaries as D
    sp = "[" + _PY_SPACE + "]"
    rng = rf"(?i)\b(?:{D.DATE_RANGE_PATTERN})\b".replace(r"\s", sp).replace("'", "''")
    stated = [p.replace(r"\s", sp) for p in D.STATED_YEARS_PATTERNS]
    year = D.YEAR_PATTERN
    opens = D.DATE_RANGE_OPEN_PATTERN
    as_of_year = int(S.AS_OF[:4])  # the fixture clock is mid-day-safe: same year in IST
    stated_arrays = " || ".join(
        f"list_transform(regexp_extract_all(text, '(?i){p}', 1), lambda x: try_cast(x as bigint))" for p in stated)
    return f"""
r as (select doc_id, text, regexp_extract_all(text, '{rng}') as ranges from documents),
y as (select *, flatten(list_transform(ranges, lambda m: list_transform(regexp_extract_all(m, '{year}', 1),
                                        lambda x: cast(x as bigint)))) as years,
             len(list_filter(ranges, lambda m: regexp_matches(m, '(?i){opens}'))) > 0 as has_open
      from r),
z as (select doc_id, case when len(years) > 0 and
                (case when has_open then {as_of_year} else list_max(years) end) > list_min(years)
              then (case when has_open then {as_of_year} else list_max(years) end) - list_min(years) end as span,
             list_max(list_filter({stated_arrays}, lambda x: x is not null)) as stated
      from y)
select doc_id, cast(coalesce(span, stated, 0) as bigint) as experience_years from z
"""


RESUME_EXPERIENCE_SQL = "with " + _experience_sql()


@register("resume_experience", RESUME_EXPERIENCE_SQL)
def resume_experience(spark, sf_dir):
    """X2 years of experience (month-year ranges, else stated years) over whole texts."""
    from roleweave.operators.profiles import extract_experience_years
    from roleweave.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").repartition("doc_id")
    return docs.select("doc_id", extract_experience_years("text", S.AS_OF).alias("experience_years"))


@register("resume_profiles")
def resume_profiles(spark, sf_dir):
    """X10 build_profiles over every document (X1-X9, A10-A12) plus P15 search keyword."""
    from roleweave.operators.profiles import build_profiles, search_keyword
    from roleweave.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents")
    prof = build_profiles(docs, S.AS_OF, id_col="doc_id")
    return prof.select("profile_id", "skills", "experience_years", "job_titles", "education", "email", "phone",
                       "links", F.length("summary").alias("summary_chars"),
                       search_keyword("job_titles").alias("search_keyword"))


# --------------------------------------------------------------------------
# T1-T3, A6-A8, W5 — TF-IDF cosine: benchmark items (profiles) x documents
# --------------------------------------------------------------------------
FX_STOP_WORDS = ("the", "and", "of", "to", "in", "is", "it", "that", "for", "on", "with", "as", "was", "by",
                 "are", "be", "or", "an", "at", "from", "this", "la", "le", "de", "et", "les", "des", "en", "un",
                 "une", "der", "die", "und", "das")
FX_MAX_FEATURES = 5000


def _sql_terms(table: str, id_col: str) -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(FX_STOP_WORDS))
    return f"""
  (select id, term, count(*) as tf from (
     select id, tok as term from (
       select id, unnest(l) as tok from (
         select {id_col} as id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                            lambda t: not list_contains([{stop}], t)) as l from {table}))
     union all
     select id, concat(l[i], ' ', l[i + 1]) as term from (
       select id, l, unnest(range(1, len(l))) as i from (
         select {id_col} as id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                                            lambda t: not list_contains([{stop}], t)) as l from {table})
       where len(l) >= 2))
   group by id, term)"""


TFIDF_SQL = f"""
with jt as {_sql_terms('documents', 'doc_id')},
pt as {_sql_terms('benchmark', 'item_id')},
m as (select count(*) + 1 as n from documents),
stats as (select term, sum(tf) as tf_jobs, count(*) as df_jobs from jt group by term),
cand as (select p.id as profile_id, s.term, coalesce(s.tf_jobs, 0) + coalesce(q.tf, 0) as total,
                coalesce(s.df_jobs, 0) + case when q.tf is null then 0 else 1 end as df_p, coalesce(q.tf, 0) as tf_p
         from (select distinct id from pt) p cross join stats s
         left join pt q on q.id = p.id and q.term = s.term
         union all
         select q.id, q.term, q.tf, 1, q.tf from pt q where q.term not in (select term from stats)),
vocab as (select * from (select *, row_number() over (partition by profile_id order by total desc, term) as r
                         from cand) where r <= {FX_MAX_FEATURES}),
idf as (select v.profile_id, v.term, v.tf_p, ln(m.n / (1.0 + v.df_p)) + 1.0 as idf from vocab v, m),
pw as (select profile_id, term, tf_p * idf as w, idf from idf where tf_p > 0),
pn as (select profile_id, sqrt(sum(w * w)) as pnorm from pw group by profile_id),
jw as (select i.profile_id, j.id as doc_id, j.term, j.tf * i.idf as w from jt j join idf i on i.term = j.term),
jn as (select profile_id, doc_id, sqrt(sum(w * w)) as jnorm from jw group by profile_id, doc_id),
dot as (select jw.profile_id, jw.doc_id, sum(jw.w * pw.w) as dot
        from jw join pw on pw.profile_id = jw.profile_id and pw.term = jw.term group by jw.profile_id, jw.doc_id)
select d.profile_id, d.doc_id, round(d.dot / (jn.jnorm * pn.pnorm), 6) as cosine
from dot d join jn using (profile_id, doc_id) join pn using (profile_id) where d.dot > 0
"""


@register("tfidf_cosine", TFIDF_SQL)
def tfidf_cosine(spark, sf_dir):
    """Per-profile-corpus TF-IDF cosine, benchmark items x every document (whole texts)."""
    from roleweave.operators.tfidf import pair_cosine
    from roleweave.sources.tables import read_table

    bench = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("profile_id"), "text")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cos = pair_cosine(bench, docs, stop_words=FX_STOP_WORDS, max_features=FX_MAX_FEATURES)
    return cos.select("profile_id", "doc_id", F.round("cosine", 6).alias("cosine"))


# --------------------------------------------------------------------------
# S1, S2, F5, F6, W3, P3, P5, P7 — postings harvested from page links
# P4 — searched domain and company of each page's site
# --------------------------------------------------------------------------
FX_LINK_WORDS = ("the", "and")
FX_KEYWORDS = "ther, tion"

_WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sql_unescape(e: str) -> str:
    out = e
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                    ("&nbsp;", "\u00a0"), ("&#34;", '"'), ("&#60;", "<"), ("&#62;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{ent}', '{ch}')"
    return out


def _sql_title_case(e: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({e}, '(\\p{{L}}+|\\P{{L}}+)', 1), "
            f"lambda r: concat(upper(substr(r, 1, 1)), lower(substr(r, 2)))), '')")


def _sql_attr(attrs: str, name: str) -> str:
    pat = rf"(?is)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    pat = pat.replace("'", "''")
    present = rf"(?is)(?:^|\s){name}\s*=".replace("'", "''")
    val = (f"concat(regexp_extract({attrs}, '{pat}', 1), regexp_extract({attrs}, '{pat}', 2), "
           f"regexp_extract({attrs}, '{pat}', 3))")
    return f"(case when regexp_matches({attrs}, '{present}') then {_sql_unescape(val)} end)"


def _sql_absolute(b: str, h: str) -> str:
    scheme = f"regexp_extract({b}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)"
    origin = f"regexp_extract({b}, '^([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)', 1)"
    no_frag = f"regexp_replace({b}, '#.*$', '')"
    no_query = f"regexp_replace({no_frag}, '\\?.*$', '')"
    path = f"regexp_extract({no_query}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*(/.*)?$', 1)"
    d0 = f"regexp_replace({path}, '[^/]*$', '')"
    directory = f"(case when {d0} = '' then '/' else {d0} end)"
    return (f"(case when {h} = '' then {b} when regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') then {h} "
            f"when starts_with({h}, '//') then concat({scheme}, ':', {h}) "
            f"when starts_with({h}, '/') then concat({origin}, {h}) "
            f"when starts_with({h}, '?') then concat({no_query}, {h}) "
            f"when starts_with({h}, '#') then concat({no_frag}, {h}) "
            f"else concat({origin}, {directory}, {h}) end)")


def _sql_company_from_host(u: str) -> str:
    host = f"replace(lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)), 'www.', '')"
    return _sql_title_case(f"split_part({host}, '.', 1)")


def _anchor_sql() -> str:
    from roleweave.functions import dictionaries as D

    anchor = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
    noise = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
    url_re = "|".join(f"(?:{p})" for p in D.JOB_URL_PATTERNS)
    link_words = " or ".join(f"contains(tl, '{w}')" for w in FX_LINK_WORDS)
    from roleweave.sources.pages import keyword_tokens

    toks = [t for t in keyword_tokens(FX_KEYWORDS) if len(t) > 3]
    kw = " or ".join(f"contains(lower(text), '{t}')" for t in toks) or "false"
    return f"""
with c as (select page_id, url as page_url, regexp_replace(html, '{noise}', '', 'g') as h from pages
           where html is not null and html <> ''),
z as (select page_id, page_url, regexp_extract_all(h, '{anchor}', 1) as attrs, regexp_extract_all(h, '{anchor}', 2) as inns
      from c),
a0 as (select page_id, page_url, unnest(range(0, len(attrs))) as pos, attrs, inns from z),
a1 as (select page_id, page_url, pos, attrs[pos + 1] as att, inns[pos + 1] as inn from a0),
a2 as (select page_id, page_url, pos, {_sql_attr('att', 'href')} as href,
              array_to_string(list_transform(string_split_regex(inn, '<[^>]*>'),
                              lambda t: {_sql_strip(_sql_unescape('t'))}), '') as text0,
              {_sql_attr('att', 'aria-label')} as aria, {_sql_attr('att', 'title')} as title_attr
       from a1),
a3 as (select page_id, page_url, pos, href,
              case when length(text0) < 3 then coalesce(nullif(aria, ''), nullif(title_attr, ''), '') else text0 end
                as text
       from a2 where href is not null),
a4 as (select *, {_sql_absolute('page_url', 'href')} as url, {_sql_strip('lower(text)')} as tl from a3
       where length(text) >= 3),
a5 as (select * from a4 where (regexp_matches(lower(href), '{url_re}') or (length(tl) > 5 and ({link_words})))
                           and ({kw})),
a6 as (select * from (select *, row_number() over (partition by page_id, url order by pos) as r from a5) where r = 1)
select page_id, pos, substr(text, 1, 200) as title, {_sql_company_from_host('page_url')} as company,
       'India' as location, url, 'career_page' as source,
       md5(regexp_replace(lower(concat(substr(text, 1, 200), '|', {_sql_company_from_host('page_url')}, '|', url)),
                          '^{_WS}+|{_WS}+$', '', 'g')) as job_id
from a6
"""


@register("anchor_links", _anchor_sql())
def anchor_links(spark, sf_dir):
    """S1 page scan, S2 link harvest (F5 job-link test, F6 keyword tokens, W3 first per url,
    P3 company from host, P5 absolute url, P7 title cut) over every page."""
    from roleweave.sources.pages import harvest_links
    from roleweave.sources.tables import read_table

    pages = read_table(spark, sf_dir, "pages")
    out = harvest_links(pages, keywords=FX_KEYWORDS, link_words=FX_LINK_WORDS)
    return out.select("page_id", "pos", "title", "company", "location", "url", "source", "job_id")


def _sql_search_domain(u: str) -> str:
    from roleweave.functions import dictionaries as D

    dom = f"regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)"
    parts = f"string_split({dom}, '.')"
    n = f"len({parts})"
    second = f"{parts}[-2]"
    generic = "(" + " or ".join(f"{second} = '{x}'" for x in D.SECOND_LEVEL_LABELS) + ")"
    last2 = f"concat({parts}[-2], '.', {parts}[-1])"
    last3 = f"concat({parts}[-3], '.', {parts}[-2], '.', {parts}[-1])"
    sd = f"(case when {n} > 2 and not {generic} then {last2} when {n} > 3 and {generic} then {last3} else {dom} end)"
    for needle, repl in D.DOMAIN_OVERRIDES.items():
        sd = f"(case when contains({sd}, '{needle}') then '{repl}' else {sd} end)"
    for needle in D.FULL_HOST_DOMAINS:
        sd = f"(case when contains({sd}, '{needle}') then {dom} else {sd} end)"
    return sd


def _sql_company_from_domain(sd: str) -> str:
    from roleweave.functions import dictionaries as D

    name = _sql_title_case(f"split_part({sd}, '.', 1)")
    for needle, repl in D.COMPANY_NAME_OVERRIDES:
        name = f"(case when contains({name}, '{needle}') then '{repl}' else {name} end)"
    return name


HOST_DOMAINS_SQL = f"""
with d as (select page_id, url, {_sql_search_domain('url')} as search_domain from pages)
select page_id, {_sql_company_from_host('url')} as host_company, search_domain,
       {_sql_company_from_domain('search_domain')} as company
from d
"""


@register("host_domains", HOST_DOMAINS_SQL)
def host_domains(spark, sf_dir):
    """P3 company from host; P4 searched domain and company name, for every page url."""
    from roleweave.functions.urls import company_from_domain, company_from_host, search_domain
    from roleweave.sources.tables import read_table

    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    d = pages.withColumn("search_domain", search_domain("url"))
    return d.select("page_id", company_from_host("url").alias("host_company"), "search_domain",
                    company_from_domain(F.col("search_domain")).alias("company"))


# --------------------------------------------------------------------------
# T13 — a whole run: F3 + P11/F4 gates -> T12 -> J3 -> W1 -> O3 -> K4, and K3
# --------------------------------------------------------------------------
_GATED_SQL = f"""
gated as (
  select * exclude (keep_location, ts, posted_ts), ts as posted_ts from (
    select *, {_sql_location_cols()}, {_sql_posted_ts('posted_date', S.AS_OF)} as ts from fx_postings)
  where keep_location
    and ts >= TIMESTAMP '{S.AS_OF}' - to_days(case when lower(coalesce(source, '')) = 'naukri' then 2 else 10 end))"""

_RUN_BODY = (_GATED_SQL + "," + _MATCH_SQL_TEMPLATE.replace("{src}", "gated") + ","
             + _DIGEST_SQL_TAIL.format(t=FX_THRESHOLD, src="gated"))

RUN_DIGEST_SQL = S.with_ctes(_RUN_BODY + f"""
select profile_id, rank, ord, job_id, title, company, url, round(score, 6) as score, pct as score_pct,
       reasons_text as reasons, strftime(posted_ts, '%Y-%m-%d %H:%M:%S') as posted_at,
       posted_ts >= TIMESTAMP '{S.AS_OF}' - INTERVAL 86400 SECOND as fresh
from dig
""", "fx_postings", "fx_profiles", "fx_seen")

RUN_LOG_SQL = S.with_ctes(_RUN_BODY + """
select p.profile_id, (select count(*) from gated) as jobs_found,
       cast(coalesce(c.n, 0) as bigint) as jobs_new, cast(coalesce(d.n, 0) as bigint) as jobs_notified
from fx_profiles p
left join (select profile_id, count(*) as n from capped group by profile_id) c on c.profile_id = p.profile_id
left join (select profile_id, count(*) as n from ranked group by profile_id) d on d.profile_id = p.profile_id
""", "fx_postings", "fx_profiles", "fx_seen")


def _fx_run(spark, sf_dir):
    from roleweave.functions.dates import with_posted_ts
    from roleweave.plans.run import plan_run

    posts = with_posted_ts(S.postings(spark, sf_dir), "posted_date", S.AS_OF)
    seen = S.seen(spark, sf_dir)
    return plan_run(
        S.profiles(spark, sf_dir), posts, seen, S.notified(spark, sf_dir), S.AS_OF, run_id="fixture",
        targets=FX_TARGETS, threshold=FX_THRESHOLD,
        location_opts={"region_words": FX_REGION_WORDS, "foreign_words": FX_FOREIGN_WORDS},
        match_opts=FX_MATCH)


@register("run_digest", RUN_DIGEST_SQL)
def run_digest(spark, sf_dir):
    """Location and date gates, matching, un-notified filter, company cap and the
    newest-first top 30 per profile — the digest one run delivers."""
    d = _fx_run(spark, sf_dir).digest
    return d.select("profile_id", "rank", "ord", "job_id", "title", "company", "url",
                    F.round("score", 6).alias("score"), "score_pct", F.array_join("reasons", " | ").alias("reasons"),
                    _ts_text("posted_ts").alias("posted_at"), "fresh")


@register("run_log", RUN_LOG_SQL)
def run_log(spark, sf_dir):
    """K3: one run-log row per profile (postings after the gates, un-notified after the
    company cap, digest size)."""
    return _fx_run(spark, sf_dir).run_log.select("profile_id", "jobs_found", "jobs_new", "jobs_notified")


# --------------------------------------------------------------------------
# ST1-ST3 — first-seen state kept by a file stream over `events`
# --------------------------------------------------------------------------
STREAM_FIRST_SEEN_SQL = """
select user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as first_seen
from events group by user_id, event_type
"""


@register("stream_first_seen", STREAM_FIRST_SEEN_SQL)
def stream_first_seen(spark, sf_dir):
    """ST1/ST2: `events` read as a file stream (availableNow), first-seen time per
    (user_id, event_type) kept by foreachBatch in an append-only state table."""
    from roleweave.streaming.incremental import _scratch, file_stream, first_seen_stream

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = file_stream(spark, sf_dir, schema, glob="events.parquet")
    root = _scratch(spark, "first-seen")
    q = first_seen_stream(stream, ["user_id", "event_type"], "ts", f"{root}/state", f"{root}/ckpt")
    q.awaitTermination()
    st = spark.read.parquet(f"{root}/state")
    return st.select("user_id", "event_type",
                     F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen"))


# --------------------------------------------------------------------------
# ST3 — rows behind the watermark, over four ordered landings of `events`
# --------------------------------------------------------------------------
_LANDING = "case when event_id % 10 = 3 then 3 else (4 * event_id) // (m + 1) end"
STREAM_LATE_SQL = f"""
with e as (select event_id, user_id, event_type, ts, {_LANDING} as landing from events, (select max(event_id) as m from events)),
marks as (select a.landing, max(b.ts) - interval 10 day as mark from (select distinct landing from e) a
          left join e b on b.landing < a.landing - 1 group by a.landing),
k as (select e.*, mark is null or ts > date_trunc('milliseconds', mark) as in_time from e join marks on marks.landing = e.landing)
select event_type, count(*) filter (in_time) as kept, count(distinct user_id) filter (in_time) as users,
       (select count(*) from k where not in_time) as late
from k group by event_type having count(*) filter (in_time) > 0
"""


@register("stream_late", STREAM_LATE_SQL)
def stream_late(spark, sf_dir):
    """ST3: `events` landing in time order in four files, a tenth of them with the last one;
    rows behind the ten-day watermark are dropped and counted (streams while it is built)."""
    from roleweave.streaming.incremental import _scratch, file_stream, in_time_stream, late_rows

    root = _scratch(spark, "late")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("event_id")).scalar()
    landing = F.when(F.col("event_id") % 10 == 3, F.lit(3)).otherwise(F.floor(4 * F.col("event_id") / (last + 1)))
    landed = events.withColumn("landing", landing.cast("int"))
    for n in range(4):
        landed.where(F.col("landing") == n).drop("landing").coalesce(1).write.parquet(f"{root}/in/{n}")
    stream = file_stream(spark, f"{root}/in/*", events.schema, max_files_per_trigger=1)
    query = in_time_stream(stream, ["event_id"], "ts", f"{root}/out", f"{root}/checkpoint")
    query.awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("event_type").agg(F.count("*").alias("kept"), F.count_distinct("user_id").alias("users")).withColumn(
        "late", F.lit(late_rows(query)).cast("long"))


# --------------------------------------------------------------------------
# S5 / F8 — job-board API responses;  S6, J4, F13, F14 — search-API responses
# (response bodies are stand-ins serialised by Spark from the `pages` table)
# --------------------------------------------------------------------------
_SIMPLE_ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'
_TITLE_RE = r"(?is)<title>(.*?)</title>"
_H1_RE = r"(?is)<h1[^>]*>(.*?)</h1>"
_P_RE = r"(?is)<p>([^<]*)</p>"
_LANG_RE = r'<html lang="([^"]*)"'
FX_SITE_REGION_WORDS = ("fr", "de")
FX_API_PREFIX = "https://jobs.example.com/apply"


def _job_api_bodies(spark, sf_dir):
    from roleweave.sources.tables import read_table

    pages = read_table(spark, sf_dir, "pages")
    hrefs = F.regexp_extract_all("html", F.lit(_SIMPLE_ANCHOR), 1)
    texts = F.regexp_extract_all("html", F.lit(_SIMPLE_ANCHOR), 2)
    loc = F.when(F.col("page_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.regexp_extract("html", _LANG_RE, 1))
    jobs = F.transform(F.arrays_zip(hrefs.alias("h"), texts.alias("t")),
                       lambda z: F.struct(z["t"].alias("title"), z["h"].alias("externalPath"),
                                          loc.alias("locationsText")))
    return pages.select("page_id", F.to_json(F.struct(jobs.alias("jobPostings"))).alias("body"))


JOB_API_SQL = f"""
with a as (select page_id, regexp_extract_all(html, '{_SIMPLE_ANCHOR}', 1) as hs,
                  regexp_extract_all(html, '{_SIMPLE_ANCHOR}', 2) as ts,
                  case when page_id % 3 = 0 then null else regexp_extract(html, '{_LANG_RE}', 1) end as lang
           from pages),
b as (select page_id, unnest(range(0, len(hs))) as pos, hs, ts, lang from a),
c as (select page_id, pos, coalesce(ts[pos + 1], '') as title, 'PwC' as company, coalesce(lang, 'India') as location,
             '' as description, concat('{FX_API_PREFIX}', coalesce(hs[pos + 1], '')) as url, 'Big4' as source from b)
select * from c
where (location <> '' and ({" or ".join(f"contains(lower(location), '{w}')" for w in FX_SITE_REGION_WORDS)}))
   or contains(lower(title), 'india') or contains(lower(url), 'bangalore') or contains(lower(url), 'mumbai')
"""


@register("job_api_postings", JOB_API_SQL)
def job_api_postings(spark, sf_dir):
    """Postings parsed from job-board API JSON bodies, kept by the site region rule (F8)."""
    from roleweave.sources.api_json import read_job_api

    return read_job_api(_job_api_bodies(spark, sf_dir), FX_API_PREFIX, "PwC", region_words=FX_SITE_REGION_WORDS)


# --------------------------------------------------------------------------
# S7 — JSON embedded in pages (stand-ins: each page with a heading gets a script
# element that holds its title, serialised by Spark)
# --------------------------------------------------------------------------
EMBEDDED_TITLES_SQL = """
select page_id, case when regexp_matches(html, '(?is)<h1') then regexp_extract(html, '(?is)<title>(.*?)</title>', 1) end as embedded
from pages where html is not null and html <> ''
"""


@register("embedded_titles", EMBEDDED_TITLES_SQL)
def embedded_titles(spark, sf_dir):
    """A value at a path of the JSON in each page's script element, null where there is none."""
    from roleweave.sources.api_json import read_embedded_json
    from roleweave.sources.pages import read_pages

    pages = read_pages(spark, f"{sf_dir}/pages.parquet")
    posting = F.struct(F.regexp_extract("html", _TITLE_RE, 1).alias("title"))
    data = F.to_json(F.struct(F.struct(posting.alias("posting")).alias("pageProps")))
    script = F.concat(F.lit('<script id="page-data" type="application/json">'), data, F.lit("</script>"))
    held = pages.withColumn("html", F.when(F.col("html").rlike("(?is)<h1"), F.concat("html", script)).otherwise(F.col("html")))
    return read_embedded_json(held, "page-data", "$.pageProps.posting.title").select("page_id", "embedded")


def _search_inputs(spark, sf_dir):
    from roleweave.sources.tables import read_table

    pages = read_table(spark, sf_dir, "pages")
    even = F.col("page_id") % 2 == 0
    page_res = F.struct(F.regexp_extract("html", _TITLE_RE, 1).alias("title"), F.col("url").alias("url"),
                        F.when(even, F.regexp_extract("html", _H1_RE, 1)).alias("snippet"),
                        F.when(~even, F.regexp_extract("html", _P_RE, 1)).alias("description"))
    links = F.transform(F.arrays_zip(F.regexp_extract_all("html", F.lit(_SIMPLE_ANCHOR), 1).alias("h"),
                                     F.regexp_extract_all("html", F.lit(_SIMPLE_ANCHOR), 2).alias("t")),
                        lambda z: F.struct(z["t"].alias("title"), z["h"].alias("url"),
                                           F.lit(None).cast("string").alias("snippet"),
                                           F.lit(None).cast("string").alias("description")))
    results = F.concat(F.array(page_res), links)
    bodies = pages.select("page_id", F.col("url").alias("site_url"), F.lit("India").alias("location"),
                          F.to_json(F.struct(results.alias("results"))).alias("body"))
    descriptions = pages.where(even).select("url", F.regexp_extract("html", _H1_RE, 1).alias("text"))
    return bodies, descriptions


def _search_sql() -> str:
    from roleweave.functions import dictionaries as D

    excl = "|".join(D.SEARCH_EXCLUSIONS)
    return f"""
with r0 as (select page_id, url as site_url, 0 as pos, regexp_extract(html, '{_TITLE_RE}', 1) as raw_title, url,
                   case when page_id % 2 = 0 then regexp_extract(html, '{_H1_RE}', 1) end as snip,
                   case when page_id % 2 <> 0 then regexp_extract(html, '{_P_RE}', 1) end as descr
            from pages),
a as (select page_id, url as site_url, regexp_extract_all(html, '{_SIMPLE_ANCHOR}', 1) as hs,
             regexp_extract_all(html, '{_SIMPLE_ANCHOR}', 2) as ts from pages),
r1 as (select page_id, site_url, i + 1 as pos, ts[i + 1] as raw_title, hs[i + 1] as url, null as snip, null as descr
       from (select *, unnest(range(0, len(hs))) as i from a)),
r as (select *, coalesce(snip, descr, '') as snippet from (select * from r0 union all select * from r1)
      where coalesce(raw_title, '') <> '' and coalesce(url, '') <> ''),
f as (select * from r where not regexp_matches(lower(concat_ws(' ', raw_title, snippet)),
                                             '(^|{_BOUND})({excl})($|{_BOUND})')),
d as (select url, first(regexp_extract(html, '{_H1_RE}', 1)) as fetched from pages where page_id % 2 = 0 group by url)
select f.page_id, f.site_url, f.pos, substr(f.raw_title, 1, 200) as title,
       {_sql_company_from_domain(_sql_search_domain('f.site_url'))} as company, 'India' as location,
       coalesce(nullif(d.fetched, ''), f.snippet) as description, f.url, 'search_api' as source
from f left join d on d.url = f.url
"""


@register("search_postings", _search_sql())
def search_postings(spark, sf_dir):
    """S6 search-API results (F14 presence, F13 exclusions, P4 company), J4 fetched
    descriptions joined by url."""
    from roleweave.sources.api_json import read_search_results

    bodies, descriptions = _search_inputs(spark, sf_dir)
    return read_search_results(bodies, descriptions)


# --------------------------------------------------------------------------
# S10, J6 — search frontier;  W2 — stop paging at the first empty page
# --------------------------------------------------------------------------
FX_LOCATIONS = ("Bangalore", "Pune", "Remote India")


def _frontier_sql() -> str:
    locs = ", ".join(f"({i}, '{x}')" for i, x in enumerate(FX_LOCATIONS))
    qp = lambda e: f"replace(url_encode({e}), '%20', '+')"
    slug = lambda e: f"replace(lower({e}), ' ', '-')"
    return f"""
with k as (select distinct p_name as keyword from part),
l as (select * from (values {locs}) t(r, location)),
g as (select keyword, location, page from k, l, range(1, 4) t(page))
select keyword, location, page,
       concat('https://www.naukri.com/', {slug('keyword')}, '-jobs-in-', {slug('location')},
              case when page > 1 then concat('-', page) else '' end, '?jobAge=2') as naukri_url,
       concat('https://www.linkedin.com/jobs/search?keywords=', {qp('keyword')}, '&location=', {qp('location')},
              '&trk=public_jobs_jobs-search-bar_search-submit&position=1&pageNum=0&start=', (page - 1) * 25,
              '&f_TPR=r604800') as linkedin_url,
       case when page > 1 then concat('https://careers.cognizant.com/global/en/search-results?keywords=',
                                       {qp('keyword')}, '&from=', (page - 1) * 10, '&s=1')
            else concat('https://careers.cognizant.com/global/en/search-results?keywords=', {qp('keyword')}) end
         as cognizant_url
from g
"""


@register("search_frontier", _frontier_sql())
def search_frontier(spark, sf_dir):
    """S10 + J6: keyword (every part name) x configured location x page -> site URLs."""
    from roleweave.sources.frontier import frontier
    from roleweave.sources.tables import read_table

    return frontier(read_table(spark, sf_dir, "part"), "p_name", FX_LOCATIONS, max_pages=3)


def _search_queries_sql() -> str:
    from roleweave.functions import dictionaries as D

    tail = f" {D.SEARCH_SITE_OPERATORS} " + " ".join(f"-{w}" for w in D.SEARCH_EXCLUSIONS)
    tail = tail.replace("'", "''")
    return f"""
select p_partkey, concat('site:', lower(p_brand), '.example.com "', p_name, '" {FX_LOCATIONS[0]}{tail}') as query_text from part
"""


@register("search_queries", _search_queries_sql())
def search_queries(spark, sf_dir):
    """The search-API query text for every part's name at a site of its brand."""
    from roleweave.sources.frontier import search_query
    from roleweave.sources.tables import read_table

    site = F.concat(F.lower("p_brand"), F.lit(".example.com"))
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", search_query(site, F.col("p_name"), F.lit(FX_LOCATIONS[0])).alias("query_text"))


def _page_stop_sql() -> str:
    from roleweave.functions import dictionaries as D

    url_re = "|".join(f"(?:{p})" for p in D.JOB_URL_PATTERNS)
    words = " or ".join(f"contains(tl, '{w}')" for w in FX_LINK_WORDS)
    anchor = r"(?is)<a\b([^>]*)>(.*?)</a\s*>"
    noise = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
    return f"""
with c as (select page_id, url, regexp_replace(coalesce(html, ''), '{noise}', '', 'g') as h from pages),
z as (select page_id, regexp_extract_all(h, '{anchor}', 1) as attrs, regexp_extract_all(h, '{anchor}', 2) as inns
      from c),
a1 as (select page_id, attrs[i + 1] as att, inns[i + 1] as inn from (select *, unnest(range(0, len(attrs))) as i from z)),
a2 as (select page_id, {_sql_attr('att', 'href')} as href,
              array_to_string(list_transform(string_split_regex(inn, '<[^>]*>'),
                              lambda t: {_sql_strip(_sql_unescape('t'))}), '') as text from a1),
a3 as (select page_id, href, {_sql_strip('lower(text)')} as tl from a2 where href is not null),
n as (select page_id, count(*) as n_cards from a3
      where regexp_matches(lower(href), '{url_re}') or (length(tl) > 5 and ({words})) group by page_id),
p as (select c.page_id, lower(regexp_extract(c.url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1)) as host,
             coalesce(try_cast(nullif(regexp_extract(c.url, '[?&]page=([0-9]+)', 1), '') as integer), 1) as page_no,
             coalesce(n.n_cards, 0) as n_cards
      from c left join n on n.page_id = c.page_id),
q as (select *, min(case when n_cards = 0 then page_no end) over (partition by host) as first_empty from p)
select page_id, host, page_no, n_cards from q where first_empty is null or page_no < first_empty
"""


@register("page_stop", _page_stop_sql())
def page_stop(spark, sf_dir):
    """Pages grouped by site, numbered from their url; a site's pages at and after its
    first page without job links (F5 on the S2 anchors) are dropped."""
    from roleweave.functions.urls import netloc
    from roleweave.sources.frontier import stop_at_first_empty
    from roleweave.sources.pages import anchors, is_job_link
    from roleweave.sources.tables import read_table

    pages = read_table(spark, sf_dir, "pages")
    cards = (anchors(pages).where(is_job_link("href", "text", link_words=FX_LINK_WORDS))
             .groupBy("page_id").agg(F.count("*").alias("n_cards")))
    p = pages.select("page_id", F.lower(netloc("url")).alias("host"),
                     F.coalesce(F.nullif(F.regexp_extract("url", r"[?&]page=([0-9]+)", 1), F.lit("")).try_cast("int"),
                                F.lit(1)).alias("page_no"))
    p = p.join(cards, "page_id", "left").withColumn("n_cards", F.coalesce("n_cards", F.lit(0)).cast("bigint"))
    return stop_at_first_empty(p, ["host"]).select("page_id", "host", "page_no", "n_cards")


# --------------------------------------------------------------------------
# S4, J7, F7-F9 — raw cards normalised under the rules of their site
# --------------------------------------------------------------------------
RAW_CARDS_SQL = S.with_ctes("""
c as (select ord as page_id, source as site, case when experience <> '' then title end as title,
             case when source <> 'linkedin' then company end as company,
             case when posted_date <> 'Just now' then location end as location,
             case when posted_date = '' then '' when source = 'career_page' then regexp_replace(url, '^https://[^/]+', '')
                  else url end as link from fx_postings),
n as (select page_id, site,
             case when site = 'linkedin' then coalesce(title, 'Unknown') else substr(coalesce(title, 'Unknown'), 1, 200) end as title,
             case when site = 'career_page' then 'Example' else coalesce(company, 'Unknown') end as company,
             coalesce(location, case site when 'naukri' then '' when 'linkedin' then 'Remote' else 'India' end) as location,
             case when link <> '' and not starts_with(link, 'http') and (site <> 'naukri' or starts_with(link, '/'))
                  then concat(case site when 'naukri' then 'https://n.example.com' when 'linkedin' then 'https://l.example.com'
                              else 'https://c.example.com' end, link) else link end as url,
             title is null as untitled
      from c)
select page_id, title, company, location, url,
       case site when 'naukri' then 'Naukri' when 'linkedin' then 'LinkedIn' else 'Career page' end as source
from n
where case site
  when 'naukri' then title <> 'Unknown' and url <> '' and (contains(lower(location), 'asia') or contains(lower(location), 'africa')
                     or contains(lower(location), 'india'))
  when 'linkedin' then contains(lower(location), 'nation_3') or contains(lower(title), 'india') or contains(lower(url), 'nation-4')
  else title <> 'Unknown' and url <> '' and not untitled and contains(lower(location), 'nation_1') end
""", "fx_postings")


@register("raw_cards", RAW_CARDS_SQL)
def raw_cards(spark, sf_dir):
    """S4 raw cards to postings under the site rules table (J7 join; F7 validity, F8 region,
    F9 searched place)."""
    from roleweave.sources.cards import RULES_SCHEMA, cards_to_postings

    rules = spark.createDataFrame(S.CARD_RULES, RULES_SCHEMA)
    return cards_to_postings(S.raw_cards(spark, sf_dir), rules).select("page_id", "title", "company", "location", "url", "source")


# --------------------------------------------------------------------------
# O1, O5 — matches ordered by score, previews
# --------------------------------------------------------------------------
SCORE_RANK_SQL = S.with_ctes(_MATCH_SQL_BODY + f"""
select profile_id, ord, round(score, 6) as score,
       row_number() over (partition by profile_id order by score desc, ord) as score_rank
from scored where score >= {FX_THRESHOLD}
""", "fx_postings", "fx_profiles")


@register("score_rank", SCORE_RANK_SQL)
def score_rank(spark, sf_dir):
    """O1: every match with its place among its profile's by score, then arrival order."""
    from roleweave.operators.matching import rank_by_score

    return rank_by_score(_fx_matches(spark, sf_dir, by_ord=True)).select("profile_id", "ord", F.round("score", 6).alias("score"), "score_rank")


SCORE_PREVIEW_SQL = f"select * from ({SCORE_RANK_SQL}) where score_rank <= 5"


@register("score_preview", SCORE_PREVIEW_SQL)
def score_preview(spark, sf_dir):
    """The five best matches of each profile."""
    from roleweave.operators.matching import earliest, floors_of
    from roleweave.operators.selection import preview

    # the best of the first postings say what a match scores at least to be among the best of all
    floors = floors_of(preview(_fx_matches(spark, sf_dir, earliest(S.postings(spark, sf_dir))), 5), 5)
    return preview(_fx_matches(spark, sf_dir, floors=floors), 5).select("profile_id", "ord", F.round("score", 6).alias("score"), "score_rank")


# --------------------------------------------------------------------------
# A9 — all stages of a run
# --------------------------------------------------------------------------
RUN_STAGES_SQL = S.with_ctes(_RUN_BODY + f"""
select (select count(*) from fx_postings) as found,
       (select count(*) from (select {_sql_location_cols()} from fx_postings) where keep_location) as after_location,
       (select count(*) from gated) as after_date, (select count(*) from matched) as matched,
       (select count(*) from todo) as unnotified, (select count(*) from capped) as capped,
       (select count(*) from ranked) as sent
""", "fx_postings", "fx_profiles", "fx_seen")


@register("run_stages", RUN_STAGES_SQL)
def run_stages(spark, sf_dir):
    """Rows after each of a run's seven stages; what comes after matching is counted in one pass."""
    run = _fx_run(spark, sf_dir)
    after = ("matched", "unnotified", "capped", "sent")
    counts = run.counts.agg(F.struct(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in after])).scalar()
    located = _location_cols_spark(S.postings(spark, sf_dir))
    return located.agg(F.count("*").alias("found"), F.count_if("keep_location").alias("after_location")).select(
        "found", "after_location", run.gated.agg(F.count("*")).scalar().alias("after_date"), *[counts[c].alias(c) for c in after])


# --------------------------------------------------------------------------
# K1-K4, T13 — state written by two runs, the second of which is repeated
# --------------------------------------------------------------------------
RUN_STATE_SQL = S.with_ctes(_GATED_SQL + "," + _MATCH_SQL_TEMPLATE.replace("{src}", "gated") + f""",
m as (select *, case when coalesce(company, '') = '' then 'unknown'
                     else lower(regexp_replace(company, '^\\s+|\\s+$', '', 'g')) end as company_key
      from scored where score >= {FX_THRESHOLD}),
c1 as (select * from (select *, row_number() over (partition by profile_id, company_key order by posted_ts desc, score desc, ord) as cr
                      from m) where cr <= 2),
r1 as (select * from (select *, row_number() over (partition by profile_id order by posted_ts desc, score desc, ord) as rk from c1)
       where rk <= 30),
todo2 as (select * from m where not exists (select 1 from r1 where r1.profile_id = m.profile_id and r1.job_id = m.job_id)),
c2 as (select * from (select *, row_number() over (partition by profile_id, company_key order by posted_ts desc, score desc, ord) as cr
                      from todo2) where cr <= 2),
r2 as (select * from (select *, row_number() over (partition by profile_id order by posted_ts desc, score desc, ord) as rk from c2)
       where rk <= 30)
select 'notified' as tbl, 'r1' as run_id, profile_id, job_id from r1
union all select 'digest', 'r1', profile_id, job_id from r1
union all select 'digest', 'r2', profile_id, job_id from r2
union all select distinct 'seen', 'r1', profile_id, job_id from m
union all select 'runs', r, profile_id, null from fx_profiles, (select unnest(['r1', 'r2']) as r)
""", "fx_postings", "fx_profiles")


@register("run_state", RUN_STATE_SQL)
def run_state(spark, sf_dir):
    """K1-K4: the rows of two runs, of which the second, delivered at first, is repeated as a
    dry run, which leaves its digest and log but no notifications (writes under the
    checkpoint folder while the query is built)."""
    from roleweave.functions.dates import with_posted_ts
    from roleweave.operators import state
    from roleweave.plans.run import execute_run
    from roleweave.streaming.incremental import _scratch

    root = _scratch(spark, "run-state")
    posts = with_posted_ts(S.postings(spark, sf_dir), "posted_date", S.AS_OF)
    for run_id, delivered in (("r1", True), ("r2", True), ("r2", False)):
        execute_run(spark, S.profiles(spark, sf_dir), posts, root, S.AS_OF, run_id, targets=FX_TARGETS,
                    threshold=FX_THRESHOLD, match_opts=FX_MATCH, delivered=delivered,
                    location_opts={"region_words": FX_REGION_WORDS, "foreign_words": FX_FOREIGN_WORDS})
    rows = None
    for name, schema in (("notified", state.NOTIFIED_SCHEMA), ("digest", state.DIGEST_SCHEMA), ("seen", state.SEEN_SCHEMA), ("runs", state.RUNS_SCHEMA)):
        job = F.col("job_id") if name != "runs" else F.lit(None).cast("string")
        table = "digests" if name == "digest" else name
        part = state.read_state(spark, root, table, schema).select(F.lit(name).alias("tbl"), "run_id", "profile_id", job.alias("job_id"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


# --------------------------------------------------------------------------
# U1, E1, U2 — sources united, repeats of a posting kept once
# --------------------------------------------------------------------------
UNION_SQL = S.with_ctes("""
select ord, title, company, location, url, source,
       case when source = 'career_page' then null else experience end as experience
from fx_postings
""", "fx_postings")


@register("union_sources", UNION_SQL)
def union_of_sources(spark, sf_dir):
    """Postings of three registered sources united by name; a column that one lacks is null."""
    from roleweave.sources.registry import SOURCES, register_source, union_sources

    def stand_in(name, *dropped):
        @register_source(f"stand_in_{name}")
        def read(spark, path, **_):
            return S.postings(spark, path).where(F.col("source") == name).drop(*dropped)

    stand_in("linkedin")
    stand_in("naukri")
    stand_in("career_page", "experience")
    frames = [SOURCES[f"stand_in_{name}"](spark, sf_dir) for name in ("linkedin", "naukri", "career_page")]
    return union_sources(frames).select("ord", "title", "company", "location", "url", "source", "experience")


DEDUPE_SQL = S.with_ctes(_GATED_SQL + "," + _MATCH_SQL_TEMPLATE.replace("{src}", "gated") + f""",
r as (select *, row_number() over (partition by profile_id, job_id order by score desc, ord) as n
      from scored where score >= {FX_THRESHOLD})
select profile_id, job_id, ord, round(score, 6) as score from r where n = 1
""", "fx_postings", "fx_profiles")


@register("run_dedupe", DEDUPE_SQL)
def run_dedupe(spark, sf_dir):
    """A run's matches with repeats of a posting kept once for each profile."""
    from roleweave.functions.dates import with_posted_ts
    from roleweave.plans.run import score_run

    posts = with_posted_ts(S.postings(spark, sf_dir), "posted_date", S.AS_OF)
    _, matches = score_run(S.profiles(spark, sf_dir), posts, S.AS_OF, FX_TARGETS, FX_THRESHOLD,
                           {"region_words": FX_REGION_WORDS, "foreign_words": FX_FOREIGN_WORDS}, None, FX_MATCH, dedupe=True)
    return matches.select("profile_id", "job_id", "ord", F.round("score", 6).alias("score"))


# --------------------------------------------------------------------------
# T4 — a run's matching with the term cosine over all terms
# --------------------------------------------------------------------------
MATCH_TFIDF_SQL = S.with_ctes(_GATED_SQL + "," + _MATCH_SQL_TEMPLATE.replace("{src}", "gated") + f""",
jd as (select ord, text_lc as text from kept),
pd as (select profile_id, summary as text from fx_profiles),
jt as {_sql_terms('jd', 'ord')},
pt as {_sql_terms('pd', 'profile_id')},
nn as (select count(*) + 1 as n from kept),
stats as (select term, count(*) as df from jt group by term),
pw as (select p.id as profile_id, p.term, p.tf * (ln(nn.n / (2.0 + coalesce(s.df, 0))) + 1.0) as w,
              ln(nn.n / (2.0 + coalesce(s.df, 0))) + 1.0 as idf
       from pt p left join stats s on s.term = p.term, nn),
pn as (select profile_id, sqrt(sum(w * w)) as pnorm from pw group by profile_id),
jw as (select j.id as ord, j.term, j.tf, ln(nn.n / (1.0 + s.df)) + 1.0 as idf0 from jt j join stats s on s.term = j.term, nn),
jn as (select p.profile_id, j.ord, sqrt(sum(pow(j.tf * coalesce(w.idf, j.idf0), 2))) as jnorm
       from fx_profiles p cross join jw j left join pw w on w.profile_id = p.profile_id and w.term = j.term group by all),
dot as (select w.profile_id, j.ord, sum(j.tf * w.idf * w.w) as dot from jw j join pw w on w.term = j.term group by all),
cosine as (select d.profile_id, d.ord, d.dot / (jn.jnorm * pn.pnorm) as cos
           from dot d join jn using (profile_id, ord) join pn using (profile_id) where d.dot > 0),
final as (select c.*, greatest(0.0::double, least(coalesce(x.cos, 0.0) + sb + tb + al + pl + ex, 1.0::double)) as total
          from comp c left join cosine x on x.profile_id = c.profile_id and x.ord = c.ord)
select profile_id, ord, round(total, 6) as score, exr as exp_reason from final where total >= {FX_THRESHOLD}
""", "fx_postings", "fx_profiles")


@register("match_tfidf", MATCH_TFIDF_SQL)
def match_tfidf(spark, sf_dir):
    """T4: the gated postings scored with the TF-IDF cosine (all terms) beside the rules."""
    from roleweave.functions.dates import with_posted_ts
    from roleweave.plans.run import score_run

    posts = with_posted_ts(S.postings(spark, sf_dir), "posted_date", S.AS_OF)
    _, m = score_run(S.profiles(spark, sf_dir), posts, S.AS_OF, FX_TARGETS, FX_THRESHOLD,
                     {"region_words": FX_REGION_WORDS, "foreign_words": FX_FOREIGN_WORDS}, None,
                     {**FX_MATCH, "similarity": "tfidf", "tfidf_options": {"stop_words": FX_STOP_WORDS}})
    reason = F.get(F.filter("reasons", lambda r: r.startswith("Exp ")), 0)
    return m.select("profile_id", "ord", F.round("score", 6).alias("score"), reason.alias("exp_reason"))
