"""Résumé extraction (X1-X10): golden rows for each rule."""

import pytest

from roleweave.functions import dictionaries as D
from roleweave.operators import profiles as X

AS_OF = "2024-05-04 00:00:00"


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = [r["v"] for r in df.select("id", column.alias("v")).orderBy("id").collect()]
    return [list(v) if isinstance(v, list) else v for v in out]


def check(spark, column, golden):
    texts = [t for t, _ in golden]
    for (text, want), got in zip(golden, values(spark, column, texts)):
        assert got == want, text[:60]


def test_skills(spark):
    check(spark, X.extract_skills("text"), [
        ("Skills: Python, C++, .NET, Spring Boot, CI/CD", [w for w in sorted(D.TECHNICAL_SKILLS) if w in (".net", "c++", "ci/cd", "python", "spring", "spring boot")]),
        ("javascript-dev ÉJava java_dev java", [w for w in sorted(D.TECHNICAL_SKILLS) if w in ("java", "javascript")]),
        ("éjava xjava java1", []), ("SQL;SQL", ["sql"]), ("", []),
    ])


def test_skills_are_bounded_words_of_the_list(spark):
    words = ["go", "node.js", "c#", "a b", "é", "_x"]
    check(spark, X.extract_skills("text", words), [
        ("Go GO going", ["go"]), ("node.js nodexjs", ["node.js"]), ("xnode.js", []), ("C# c##", ["c#"]), ("a b aa b", ["a b"]),
        ("É", ["é"]), ("_x", ["_x"]), ("a_x", []), ("go,node.js/c#", ["c#", "go", "node.js"]),
    ])


def test_experience(spark):
    check(spark, X.extract_experience_years("text", AS_OF), [
        ("Jan 2018 - Dec 2021", 3), ("Mar 2019 to Present", 5), ("June 2015–july 2017, Aug 2012 — now", 12), ("jan 2010 feb 2013", 3),
        ("Dec 2021 - Jan 2021", 0), ("Mar'19 – Dec 2021", 0), ("5+ years of experience", 5), ("experience: 7 yrs", 7), ("3 years in fintech", 3),
        ("2 yrs experience and 4 years in x", 4), ("2015to2016", 0), ("Jan 2018 - Jan 2018; 6 years of experience", 6), ("99999999999 years of experience", 99999999999),
        ("", 0),
    ])


def test_titles(spark):
    check(spark, X.extract_titles("text"), [
        ("Senior Java Developer", ["Java Developer", "Senior Java Developer"]), ("SOFTWARE   ENGINEER", ["Software   Engineer"]),
        ("data scientist, Data Analyst", ["Data Analyst", "Data Scientist"]), ("xjava developer", []), ("", []),
    ])


def test_education(spark):
    got = values(spark, X.extract_education("text"), ["MBA from XYZ University", "a very long line about a university that goes on beyond the sixty characters of the rule " * 2, "no school here", ""])
    assert "Mba From Xyz University" in got[0] and got[1:] == [[x for x in got[1] if len(x) < 60], [], []]


@pytest.mark.parametrize("column,golden", [
    (X.extract_email, [("a.b+c@example.co.in, x@y.org", "a.b+c@example.co.in"), ("a@b", ""), ("", "")]),
    (X.extract_phone, [("tel +91 (987) 654-3210.", "+91 (987) 654-3210"), ("12345", ""), ("", "")]),
    (X.extract_links, [
        ("see https://github.com/someone/repo). and www.linkedin.com/in/x, www.linkedin.com/in/x", ["https://github.com/someone/repo", "www.linkedin.com/in/x"]),
        ("https://me.example.com/portfolio} https://other.example.com", ["https://me.example.com/portfolio"]), ("", []),
    ]),
])
def test_contacts(spark, column, golden):
    check(spark, column("text"), golden)


def test_build_profiles_blank_and_summary(spark):
    df = spark.createDataFrame([(1, "   "), (2, "Java Developer\nPython and SQL\nXYZ University")],
                               "profile_id long, text string")
    rows = {r["profile_id"]: r for r in X.build_profiles(df, AS_OF).collect()}
    assert rows[1]["raw_text"] == D.EMPTY_RESUME_TEXT and rows[1]["summary"] == "" and list(rows[1]["skills"]) == []
    s = rows[2]["summary"]
    assert s.startswith("Job Titles: Java Developer\nSkills: java, python, sql\nEducation: University, Xyz University\n")
    assert s.endswith("XYZ University")


def test_search_keyword(spark):
    df = spark.createDataFrame([(["Architect", "Java Developer", "Senior Java Developer"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(X.search_keyword("t")).collect()]
    assert got == ["Java Developer", D.KEYWORD_FALLBACK]
