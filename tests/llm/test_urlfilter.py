import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from roleweave.llm import urlfilter as u

GLOB = st.text(alphabet="ab./*", max_size=12)


def slow(glob, text):
    parts = re.findall(r"\*+|[^*]+", glob)
    return bool(re.fullmatch("".join("(?s:.*)" if p[:2] == "**" else "[^/]*" if p == "*" else re.escape(p) for p in parts), text))


@settings(max_examples=150, deadline=None)
@given(st.lists(GLOB, min_size=1, max_size=25), st.lists(st.text(alphabet="ab./é", max_size=14), max_size=20))
def test_all_globs_at_once(globs, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = u.Automaton.of([u.parse_glob(g) for g in globs]).matches(data, offsets)
    assert got.tolist() == [[slow(g, t) for g in globs] for t in texts]


def judged(spark, urls, **how):
    df = spark.createDataFrame([(i, x, "extra", "extra") for i, x in enumerate(urls)], "page_id long, url string, host string, verdict string")
    return [tuple(r)[1:] for r in u.judge(df, **how).orderBy("page_id").collect()]


def test_contract(spark):
    urls = {
        "http://a.NET/x?y": ("a.net", "/x", "net/", "block"),
        "https://www.example.net/en/1#t": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://badexample.net/en/1": ("badexample.net", "/en/1", "net/", "block"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "https://example.com/den": ("example.com", "/den", None, "allow"),
        "https://x.org/fr/1": ("x.org", "/fr/1", "org/fr/", "allow"),
        "http://a.net?x=/": ("a.net", "", None, "allow"),
        "http://foo.com/x.net/y": ("foo.com", "/x.net/y", None, "allow"),
        "net/": ("", "", None, "allow"),
        "x://y://net/": ("y:", "//net/", None, "allow"),
        "": ("", "", None, "allow"),
        "http://É.NET/É": ("É.net", "/É", "net/", "block"),
        "http://a.com/" + "z" * 5000: ("a.com", "/" + "z" * 5000, None, "allow"),
        "http://a.com/x/login": ("a.com", "/x/login", None, "block"),
        "http://b.net/login": ("b.net", "/login", "net/", "block"),
        "http://x.org/fr/login": ("x.org", "/fr/login", "org/fr/", "allow"),
    }
    got = judged(spark, [*urls, None])
    assert [g[:4] for g in got] == [*urls.values(), ("", "", None, "allow")]
    assert got[13][4] == "**/login"


def test_ties_repeats_and_empty(spark):
    rules = (("block", "a.b", "/"), ("allow", "a.b", "/"))
    assert [g[3] for g in judged(spark, ["http://a.b/"] * 3, rules=rules, globs=())] == ["block"] * 3
    assert judged(spark, []) == []
