"""Stand-in inputs built from the driver's TPC-H-like tables.

The driver ships no posting or profile table, so these builders only reshape
its tables into rows of the schemas the jobs expect; they do none of the jobs'
work and the jobs take nothing from how they are made.  Whole tables are used
(no id subsets).  Each builder has a SQL twin (:data:`POSTINGS_SQL`,
:data:`PROFILES_SQL`, :data:`SEEN_SQL`) used by the DuckDB oracles, written so
that the two agree row for row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.sources.tables import read_table

# fixed clock of the fixtures: the newest l_shipdate
AS_OF = "2001-11-04 00:00:00"
# state cut-off: postings shipped before this were "seen" by an earlier run
SEEN_BEFORE = "2001-10-01 00:00:00"


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table of few files over all cores, before anything is made of them.

    The given tables are one file of one row group each, which one task would read; a table
    of as many splits as there are cores is left as it is.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    return rows.repartition(max(2 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting per lineitem row (title from the part, company = supplier,
    location = nation and region, source from the return flag)."""
    # spread by what is joined first, so a join by shuffles does not move the rows again
    li = spread(read_table(spark, sf_dir, "lineitem"), "l_partkey")
    part = read_table(spark, sf_dir, "part")
    sup = read_table(spark, sf_dir, "supplier")
    nat = read_table(spark, sf_dir, "nation")
    reg = read_table(spark, sf_dir, "region")
    j = (li.join(part, F.col("p_partkey") == F.col("l_partkey"))
         .join(sup, F.col("s_suppkey") == F.col("l_suppkey"))
         .join(nat, F.col("n_nationkey") == F.col("s_nationkey"))
         .join(reg, F.col("r_regionkey") == F.col("n_regionkey")))
    s = lambda c: F.col(c).cast("string")
    q = F.col("l_quantity").cast("int") % 8
    qs, line = q.cast("string"), F.col("l_linenumber")
    title = F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"))
    text = F.concat(F.col("p_brand"), F.lit(" "), F.col("p_type"), F.lit(" size "), s("p_size"))
    return j.select(
        F.concat(s("l_orderkey"), F.lit("-"), s("l_linenumber"), F.lit("-"), s("l_partkey"), F.lit("-"),
                 s("l_suppkey"), F.lit("-"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
        .alias("ord"),
        F.when(F.col("p_size") == 50, F.concat(title, F.repeat(F.concat(F.lit(" "), title), 20))).otherwise(title)
        .alias("title"),
        F.col("s_name").alias("company"),
        F.concat(F.col("n_name"), F.lit(", "), F.col("r_name")).alias("location"),
        F.when(F.col("p_size") == 49, F.repeat(F.concat(text, F.lit(". ")), 12)).otherwise(text).alias("description"),
        F.concat(F.lit("https://jobs."), F.lower(F.replace(F.col("n_name"), F.lit("_"), F.lit("-"))),
                 F.lit(".example.com/jobs/"), s("l_partkey"), F.lit("?ref="), F.col("l_linestatus")).alias("url"),
        F.when(F.col("l_returnflag") == "R", "naukri").when(F.col("l_returnflag") == "A", "linkedin")
        .otherwise("career_page").alias("source"),
        F.col("l_shipdate").alias("posted_ts"),
        F.when(line == 7, F.lit(""))
        .when(line == 6, F.concat(qs, F.lit("+ years")))
        .when(line == 5, F.concat(F.lit("Up to "), qs, F.lit(" years")))
        .when(line == 4, F.concat(F.lit("max "), qs, F.lit(" yrs")))
        .when(line == 3, F.concat(qs, F.lit(" to "), (q + 3).cast("string"), F.lit(" Years")))
        .otherwise(F.concat(qs, F.lit("-"), (q + line).cast("string"), F.lit(" Yrs")))
        .alias("experience"),
        F.when(line % 2 == 0, F.array(F.lower("p_brand"), F.lower("p_type"))).otherwise(F.array().cast("array<string>"))
        .alias("skills"),
        # free-text date as a source would print it, for the date parser
        F.when(F.col("l_linenumber") == 1, F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(F.col("l_linenumber") == 2, F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("l_linenumber") == 3,
              F.concat(F.datediff(F.lit(AS_OF).cast("timestamp"), F.col("l_shipdate")).cast("string"),
                       F.lit(" days ago")))
        .when(F.col("l_linenumber") == 4,
              F.concat(F.floor(F.datediff(F.lit(AS_OF).cast("timestamp"), F.col("l_shipdate")) / 7).cast("string"),
                       F.lit(" weeks ago")))
        .when(F.col("l_linenumber") == 5, F.lit("Just now"))
        .when(F.col("l_linenumber") == 6, F.lit(""))
        .when(F.col("l_orderkey") % 4 == 1, F.lit("9999999 years ago"))
        .when(F.col("l_orderkey") % 4 == 2, F.lit("3000 years ago"))
        .when(F.col("l_orderkey") % 4 == 3, F.lit("99999999999 days ago"))
        .otherwise(F.lit("30+ days ago")).alias("posted_date"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per supplier (whole table): a title, a skill that occurs in many
    postings, the supplier's name and its endings as skills (more than the score counts),
    a null skill, years of experience, home nation."""
    sup = read_table(spark, sf_dir, "supplier")
    part = read_table(spark, sf_dir, "part")
    nat = read_table(spark, sf_dir, "nation")
    j = sup.join(part, F.col("p_partkey") == F.col("s_suppkey")).join(nat, F.col("n_nationkey") == F.col("s_nationkey"))
    title = F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"))
    skill1 = F.concat(F.lower("p_brand"), F.lit(" "), F.lower("p_type"))
    return j.select(
        F.col("s_suppkey").alias("profile_id"),
        F.array(title).alias("job_titles"),
        F.concat(F.array(skill1, F.lit(None).cast("string")),
                 F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: F.substring(F.lower("s_name"), i, F.lit(100))))
        .alias("skills"),
        (F.col("s_suppkey") % 6).cast("int").alias("experience_years"),
        F.col("n_name").alias("home"),
        F.concat(F.lit("Job Titles: "), title, F.lit("\nSkills: "), skill1, F.lit(", "), F.lower("s_name"))
        .alias("summary"),
    )


def _seen_keys() -> list[Column]:
    return [F.split_part("ord", F.lit("-"), F.lit(4)).cast("bigint").alias("profile_id"),
            F.md5(F.lower(F.concat("title", F.lit("|"), "company", F.lit("|"), "url"))).alias("job_id")]


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier runs' state: postings shipped before the cut-off were seen; the
    linkedin ones were also notified, each to the profile of its own supplier."""
    p = postings(spark, sf_dir).where(F.col("posted_ts") < F.lit(SEEN_BEFORE).cast("timestamp"))
    return (p.groupBy(*_seen_keys())
            .agg(F.min("posted_ts").alias("first_seen"),
                 F.max(F.when(F.col("source") == "linkedin", 1).otherwise(0)).alias("notified")))


def notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the deliveries of earlier runs, one row each: those that :func:`seen` marks as notified."""
    p = postings(spark, sf_dir).where((F.col("posted_ts") < F.lit(SEEN_BEFORE).cast("timestamp")) & (F.col("source") == "linkedin"))
    return p.select(*_seen_keys())


CARD_RULES = [
    # site, source, base_url, prefix_rooted_only, company, default_location, cut_title, require_valid, require_title,
    # region_words, title_region, location_region, url_cities, searched_location
    ("naukri", "Naukri", "https://n.example.com", True, None, "", True, True, False, ["asia", "africa"], False, True, [], ""),
    ("linkedin", "LinkedIn", "https://l.example.com", False, None, "Remote", False, False, False, ["nation_3"], True, False,
     ["nation-4"], ""),
    ("career_page", "Career page", "https://c.example.com", False, "Example", "India", True, True, True, [], False, False, [],
     "nation_1"),
]


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw card per posting row, as sites print them: a missing title, company or
    place, a rooted or an empty link."""
    link = F.regexp_replace("url", "^https://[^/]+", "")
    return postings(spark, sf_dir).select(
        F.col("ord").alias("page_id"), F.col("source").alias("site"), F.lit(1).alias("card_no"),
        F.when(F.col("experience") != "", F.col("title")).alias("title"),
        F.when(F.col("source") != "linkedin", F.col("company")).alias("company"),
        F.when(F.col("posted_date") != "Just now", F.col("location")).alias("location"),
        "experience", "description",
        F.when(F.col("posted_date") == "", F.lit("")).when(F.col("source") == "career_page", link).otherwise(F.col("url"))
        .alias("link"), F.col("posted_date").alias("posted"), "skills")


# --------------------------------------------------------------------------
# SQL twins (DuckDB), used as CTEs by the oracle queries
# --------------------------------------------------------------------------
POSTINGS_SQL = f"""
select concat(cast(l_orderkey as varchar),'-',cast(l_linenumber as varchar),'-',cast(l_partkey as varchar),'-',
              cast(l_suppkey as varchar),'-',cast(cast(round(l_extendedprice*100) as bigint) as varchar)) as ord,
       case when p_size = 50 then concat(p_name,' ',lower(p_type),repeat(concat(' ',p_name,' ',lower(p_type)),20))
            else concat(p_name,' ',lower(p_type)) end as title, s_name as company, concat(n_name,', ',r_name) as location,
       case when p_size = 49 then repeat(concat(p_brand,' ',p_type,' size ',cast(p_size as varchar),'. '),12)
            else concat(p_brand,' ',p_type,' size ',cast(p_size as varchar)) end as description,
       case when l_linenumber % 2 = 0 then concat(lower(p_brand),' ',lower(p_type)) else '' end as skill_text,
       concat('https://jobs.',lower(replace(n_name,'_','-')),'.example.com/jobs/',cast(l_partkey as varchar),
              '?ref=',l_linestatus) as url,
       case l_returnflag when 'R' then 'naukri' when 'A' then 'linkedin' else 'career_page' end as source,
       l_shipdate as posted_ts,
       case l_linenumber when 7 then '' when 6 then concat(cast(l_quantity as int)%8,'+ years')
            when 5 then concat('Up to ',cast(l_quantity as int)%8,' years') when 4 then concat('max ',cast(l_quantity as int)%8,' yrs')
            when 3 then concat(cast(l_quantity as int)%8,' to ',cast(l_quantity as int)%8+3,' Years')
            else concat(cast(cast(l_quantity as int)%8 as varchar),'-',
                        cast(cast(l_quantity as int)%8+l_linenumber as varchar),' Yrs') end as experience,
       case l_linenumber
         when 1 then strftime(l_shipdate, '%Y-%m-%d')
         when 2 then strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ')
         when 3 then concat(cast(date_diff('day', l_shipdate::date, TIMESTAMP '{AS_OF}'::date) as varchar), ' days ago')
         when 4 then concat(cast(floor(date_diff('day', l_shipdate::date, TIMESTAMP '{AS_OF}'::date) / 7) as bigint)::varchar,
                            ' weeks ago')
         when 5 then 'Just now'
         when 6 then ''
         else case l_orderkey % 4 when 1 then '9999999 years ago' when 2 then '3000 years ago'
                                  when 3 then '99999999999 days ago' else '30+ days ago' end end as posted_date
from lineitem join part on p_partkey=l_partkey join supplier on s_suppkey=l_suppkey
 join nation on n_nationkey=s_nationkey join region on r_regionkey=n_regionkey
"""

PROFILES_SQL = """
select s_suppkey as profile_id,
       [concat(p_name,' ',lower(p_type))] as job_titles,
       list_concat([concat(lower(p_brand),' ',lower(p_type))],
                   list_transform(range(1, 12), lambda i: substr(lower(s_name), i::int))) as skills,
       cast(s_suppkey % 6 as integer) as experience_years,
       n_name as home,
       concat('Job Titles: ', p_name, ' ', lower(p_type), chr(10), 'Skills: ', lower(p_brand), ' ', lower(p_type),
              ', ', lower(s_name)) as summary
from supplier join part on p_partkey = s_suppkey join nation on n_nationkey = s_nationkey
"""

SEEN_SQL = f"""
select cast(split_part(ord, '-', 4) as bigint) as profile_id, md5(lower(concat(title,'|',company,'|',url))) as job_id,
       min(posted_ts) as first_seen, max(case when source='linkedin' then 1 else 0 end) as notified
from fx_postings where posted_ts < TIMESTAMP '{SEEN_BEFORE}' group by 1, 2
"""


def with_ctes(body: str, *names: str) -> str:
    """Prefix an oracle query with the stand-in CTEs it needs."""
    defs = {"fx_postings": POSTINGS_SQL, "fx_profiles": PROFILES_SQL, "fx_seen": SEEN_SQL}
    order = [n for n in ("fx_postings", "fx_profiles", "fx_seen") if n in names or (n == "fx_postings" and "fx_seen" in names)]
    return "with " + ",\n".join(f"{n} as ({defs[n]})" for n in order) + ",\n" + body
