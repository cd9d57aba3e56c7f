"""Row rules against golden rows (F1 cases, P11 dates, P12 ranges, X8 title case, P4 domains)."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from roleweave.functions.dates import posted_ts
from roleweave.functions.postings import experience_range, job_id
from roleweave.functions.text import title_case
from roleweave.functions.urls import company_from_domain, search_domain
from roleweave.operators.filters import is_foreign, is_in_region, location_gate

AS_OF = "2001-11-04 00:00:00"
NOW = dt.datetime(2001, 11, 4)


def test_region_cases(spark):
    """One row a branch: a word inside another, upper case, no word, no place."""
    from roleweave.functions import dictionaries as D

    word = D.REGION_WORDS[0]
    cases = [(f"x{word}x", True), (word.upper(), True), ("Oslo", False), ("", True), (None, True)]
    df = spark.createDataFrame(cases, "location string, expected boolean")
    for r in df.select("expected", is_in_region("location").alias("got")).collect():
        assert r["got"] == r["expected"]


def test_foreign_is_word_bounded(spark):
    df = spark.createDataFrame([("Focus engineer", "Pune"), ("Engineer", "Austin, TX"), ("Dev", "Canada"),
                                ("Engineer", "Chennai (can relocate)")], "title string, location string")
    got = [r[0] for r in df.select(is_foreign("title", "location")).collect()]
    assert got == [False, True, True, False]


def test_location_gate(spark):
    df = spark.createDataFrame([("Dev", "Pune"), ("Dev", ""), ("Dev", "Pan India"), ("Dev", "Remote - Bangalore"),
                                ("Dev", "London"), ("Dev", "Chennai")], "title string, location string")
    got = [r[0] for r in df.select(location_gate(["pune"])).collect()]
    assert got == [True, True, True, False, False, False]
    got_in = [r[0] for r in df.select(location_gate(["india"])).collect()]
    assert got_in == [True, True, True, True, False, True]


def test_posted_dates(spark):
    day = 86400
    cases = [("", -day), ("Just now", 0), ("today", 0), ("23 hours ago", 0), ("2 days ago", -2 * day),
             ("1 week ago", -7 * day), ("3 months ago", -90 * day), ("1 year ago", -365 * day),
             ("2023-10-25", None), ("2023-10-25T10:00:00Z", None), ("20231025", None)]
    epoch = ["yesterday", "30+ days ago", "a week ago", "2023", "now", "epoch"]
    df = spark.createDataFrame([(c,) for c, _ in cases] + [(e,) for e in epoch], "d string")
    got = [r[0] for r in df.select(posted_ts("d", AS_OF)).collect()]
    for (text, off), ts in zip(cases, got):
        if off is not None:
            assert ts == NOW + dt.timedelta(seconds=off), text
    assert got[8] == dt.datetime(2023, 10, 25)
    assert got[9] == dt.datetime(2023, 10, 25, 10)
    assert got[10] == dt.datetime(2023, 10, 25)
    assert all(t == dt.datetime(1970, 1, 1) for t in got[len(cases):])


def test_experience_ranges(spark):
    cases = [("2-5 Yrs", 2, 5), ("2 to 5 years", 2, 5), ("3+ years", 3, 99), ("up to 2 yrs", 0, 2),
             ("max 3 years", 0, 3), ("", 0, 99), ("fresher", 0, 99), (None, 0, 99)]
    df = spark.createDataFrame(cases, "e string, lo int, hi int")
    for r in df.select("lo", "hi", experience_range("e").alias("r")).collect():
        assert (r["r"]["min"], r["r"]["max"]) == (r["lo"], r["hi"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abcXYZ -.'é1_", max_size=12), min_size=1, max_size=8))
def test_title_case_matches_python(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = [r[0] for r in df.select(title_case("s")).collect()]
    assert got == [w.title() for w in words]


def test_job_id_matches_md5_of_stripped_key(spark):
    import hashlib

    rows = [("  Dev ", "Acme", "http://x/1\t"), ("Dev", None, "u")]
    df = spark.createDataFrame(rows, "title string, company string, url string")
    got = [r[0] for r in df.select(job_id()).collect()]
    exp = [hashlib.md5(f"{t}|{c or ''}|{u}".lower().strip().encode()).hexdigest() for t, c, u in rows]
    assert got == exp


def test_search_domains(spark):
    urls = ["https://careers.hcltech.com/x", "https://ibegin.tcsapps.com/a", "https://x.y.oraclecloud.com/p",
            "https://www.example.co.in/jobs", "https://wipro.com", "https://careers.infosys.com/joblist"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("sd", search_domain("url"))
    got = [(r["sd"], r["c"]) for r in df.select("sd", company_from_domain(F.col("sd")).alias("c")).collect()]
    assert got == [("hcltech.com", "Hcltech"), ("tcs.com", "TCS"), ("x.y.oraclecloud.com", "X"),
                   ("example.co.in", "Example"), ("wipro.com", "Wipro"), ("infosys.com", "Infosys")]


def test_with_posted_ts_equals_column_form(spark):
    from roleweave.functions.dates import with_posted_ts

    texts = ["", "Just now", "2 days ago", "2023-10-25", "2023-10-25T10:00:00Z", "20231025", "30+ days ago",
             " 5 weeks ago ", "2023-02-30", "12 hours ago", None]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    a = [r[0] for r in df.select(posted_ts("d", AS_OF)).collect()]
    b = [r["posted_ts"] for r in with_posted_ts(df, "d", AS_OF).collect()]
    assert a == b


@pytest.mark.parametrize("text,want", [
    ("9999999 years ago", "1970-01-01 00:00:00"), ("999999 years ago", "1970-01-01 00:00:00"), ("3000 years ago", "1970-01-01 00:00:00"),
    ("99999999999 days ago", "1970-01-01 00:00:00"), ("2147483647 days ago", "1970-01-01 00:00:00"), ("2 days ago", "2001-11-02 00:00:00"),
])
def test_ages_before_the_year_1_fall_to_epoch(spark, text, want):
    df = spark.createDataFrame([(text,)], "d string").select(posted_ts("d", "2001-11-04 00:00:00").cast("string").alias("t"))
    assert df.first()["t"] == want


def test_references_are_resolved_as_in_the_standard(spark):
    """RFC 3986, section 5.4, normal and abnormal examples, against the base http://a/b/c/d;p?q."""
    from roleweave.functions.urls import absolute_url

    same = ["g", "g/", "g?y", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "g.", ".g", "g..", "..g", "g?y/./x", "g?y/../x", "g#s/./x", "g#s/../x"]
    cases = {h: f"http://a/b/c/{h}" for h in same} | {
        "g:h": "g:h", "http:g": "http:g", "./g": "http://a/b/c/g", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "#s": "http://a/b/c/d;p?q#s",
        "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/",
        "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "../../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
        "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y",
    }
    df = spark.createDataFrame([("http://a/b/c/d;p?q", h) for h in cases] + [("http://a", "x/../y")], "page_url string, href string")
    got = {r["href"]: r["url"] for r in df.select("href", absolute_url().alias("url")).collect()}
    assert got.pop("x/../y") == "http://a/y"
    assert got == cases
