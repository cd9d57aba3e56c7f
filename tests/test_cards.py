"""Raw cards to postings (S4, J7, F7-F9), embedded JSON (S7) and the union of sources."""

from roleweave.sources.cards import RULES_SCHEMA, cards_to_postings

CARD_SCHEMA = ("page_id long, site string, card_no int, title string, company string, location string, experience string, "
               "description string, link string, posted string, skills array<string>")


def test_cards_to_postings(spark):
    cards = spark.createDataFrame([
        (1, "li", 0, "Java  Developer", "Acme", "Pune, India", None, None, "https://in.example.com/jobs/view/1?trk=x", "2023-10-25", None),
        (1, "li", 1, "No Link", None, None, None, None, None, None, None),
        (1, "li", 2, "Remote role", None, "London, UK", None, None, "/jobs/view/3", None, None),
        (2, "it", 0, "Cloud Engineer", "own", "Bengaluru", None, None, "/job/9", None, None),
        (2, "it", 1, "Cloud Engineer", None, "Dubai", None, None, "/job/10", None, None),
        (2, "it", 2, None, None, "Bengaluru", None, None, "/job/11", None, None),
        (2, "it", 3, "In India", None, None, None, None, "job/12", None, None),
        (3, "sl", 0, "x", None, "Chennai Area", None, None, "u", None, None),
        (3, "sl", 1, "x", None, "Multiple Locations", None, None, "u", None, None),
        (3, "sl", 2, "x", None, "Delhi", None, None, "u", None, None),
        (4, "unknown site", 0, "x", None, "Delhi", None, None, "u", None, None),
    ], CARD_SCHEMA)
    rules = spark.createDataFrame([
        ("li", "linkedin", "https://www.linkedin.com", False, None, "", False, True, False, [], False, False, [], ""),
        ("it", "IT_Giants", "https://careers.example.com", True, "ExampleTech", "India", True, False, True,
         ["india", "bengaluru"], True, False, [], ""),
        ("sl", "sl", "", False, None, None, False, False, False, [], False, False, [], "Chennai"),
    ], RULES_SCHEMA)
    out = {(r["page_id"], r["card_no"]): r for r in cards_to_postings(cards, rules).collect()}
    a = out[(1, 0)]
    assert (a["title"], a["company"], a["location"], a["url"], a["posted_date"]) == (
        "Java  Developer", "Acme", "Pune, India", "https://in.example.com/jobs/view/1?trk=x", "2023-10-25")
    assert out[(1, 2)]["url"] == "https://www.linkedin.com/jobs/view/3" and out[(1, 2)]["company"] == "Unknown"
    assert out[(2, 0)]["company"] == "ExampleTech" and out[(2, 0)]["url"] == "https://careers.example.com/job/9"
    assert out[(2, 3)]["location"] == "India" and out[(2, 3)]["url"] == "job/12"  # only rooted links get the prefix
    # dropped: no link (F7), out of the region (F8), no title element, not the searched place (F9), no rules
    assert out.keys() == {(1, 0), (1, 2), (2, 0), (2, 3), (3, 0), (3, 1)}


def test_embedded_json(spark):
    from roleweave.sources.api_json import read_embedded_json

    html = ('<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"initialState":'
            '{"jobSearch":{"jobDetails":[{"title":"Java Dev"},{"title":"SRE"}]}}}}}</script></html>')
    df = spark.createDataFrame([(1, html), (2, "<html></html>")], "page_id long, html string")
    got = {r["page_id"]: r["embedded"] for r in
           read_embedded_json(df, "__NEXT_DATA__", "$.props.pageProps.initialState.jobSearch.jobDetails[*].title")
           .collect()}
    assert got == {1: '["Java Dev","SRE"]', 2: None}


def test_union_sources(spark):
    from roleweave.sources.registry import union_sources

    a = spark.createDataFrame([("t1", "u1")], "title string, url string")
    b = spark.createDataFrame([("t1", "u1", "x")], "title string, url string, company string")
    rows = union_sources([a, b]).collect()
    assert len(rows) == 2 and rows[0]["company"] is None  # UNION ALL, no cross-source dedup
