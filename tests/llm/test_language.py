import math
import random
from collections import defaultdict

import numpy as np
import pytest

from helpers import AWKWARD, STEMS, corpus, documents, words
from roleweave.llm import common, language


def nats(train, order, text):
    """PPM with method C and exclusion, byte by byte."""
    tree = defaultdict(lambda: defaultdict(int))
    for t in map(str.encode, train):
        for i in range(len(t)):
            for d in range(min(order, i) + 1):
                tree[t[i - d : i]][t[i]] += 1
    t, total = text.encode(), 0.0
    for i in range(len(t)):
        d = min(order, i)
        while t[i - d : i] not in tree:
            d -= 1
        out, p = set(), 1.0
        while d >= 0:
            left = {k: v for k, v in tree[t[i - d : i]].items() if k not in out}
            n, kinds = sum(left.values()), len(left)
            if t[i] in left:
                p *= left[t[i]] / (n + kinds)
                break
            p *= kinds / (n + kinds) if n else 1
            out |= set(left)
            d -= 1
        else:
            p /= 256 - len(out)
        total -= math.log(p)
    return total


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths(spark, order, monkeypatch):
    rows = [(1, "the cat sat on the mat", "a", "s"), (2, "thé hat", "a", "s"), (3, "x", "a", "s"), (4, "der hund der katze", "b", "s"), (5, "über alles", "b", "s"), (6, "über alles", "b", "s")]
    model = language.train(documents(spark, rows), order=order)
    assert model.languages == ("a", "b")
    texts = ["the hund", "", "x", "zzz é", "catdertheé ü", "日本", "sat on the über"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    train = {"a": [r[1] for r in rows[:3]], "b": [r[1] for r in rows[3:5]]}  # the copied text counts once
    want = np.array([[nats(train[x], order, t) for x in "ab"] for t in texts])
    for size in (3, 1 << 20):
        monkeypatch.setattr(language, "BYTES", size)
        assert np.allclose(language.PpmTable(model).code_lengths(data, offsets), want, atol=1e-4)


def test_held_out_and_awkward_rows(spark):
    model = language.train(documents(spark, corpus(90) + AWKWARD))
    rng = random.Random(9)
    fresh = [(i, words(rng, 6, STEMS[x]), x, "s") for i, x in enumerate(["aa", "bb", "cc"] * 10)]
    got = {r.doc_id: r for r in language.identify(documents(spark, fresh), model).collect()}
    assert all(got[i].lang_pred == x and 0 < got[i].score <= 1 for i, _, x, _ in fresh)
    rows = language.identify(documents(spark, AWKWARD), model).collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 4 and by[900].score == 0.0
    assert by[904].lang_pred == by[None].lang_pred == "aa"


def test_nothing_learned_and_empty_table(spark):
    model = language.train(documents(spark, [(1, "text", None, "s"), (2, None, "aa", "s")]))
    assert model.languages == ()
    assert [(r.lang_pred, r.score) for r in language.identify(documents(spark, [(1, "text", "x", "s")]), model).collect()] == [("und", 0.0)]
    assert language.identify(documents(spark, []), language.train(documents(spark, corpus(6)))).count() == 0


def test_sample_bound(spark):
    model = language.train(documents(spark, corpus(60)), per_language=2)
    assert 0 < model.counts[1].sum() <= 6  # one start for each text of the sample


def test_lowest_hashes(spark):
    # one group of many distinct hashes, one of copies alone, a small one, and a range that starts too narrow
    rng = random.Random(3)
    big = [rng.getrandbits(64) - (1 << 63) for _ in range(5000)]
    rows = [("big", h) for h in big] + [("copies", 5)] * 3000 + [("copies", -7)] + [("small", h) for h in big[:3]] + [(None, 1), ("big", None)]
    high = [(1 << 62) + i for i in range(2000)]  # all in the upper half
    rows += [("high", h) for h in high]
    df = spark.createDataFrame(rows, "g string, h long").repartition(16)
    got = common.lowest_hashes(df, "g", "h", 10)
    assert got == {"big": sorted(big)[9], "copies": 5, "small": max(big[:3]), "high": sorted(high)[9]}
    assert common.lowest_hashes(df.where("false"), "g", "h", 10) == {}


def test_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_GROUPS", 2)
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)], "g string, h long")
    assert common.lowest_hashes(df, "g", "h", 5) == {"a": 2, "b": 2}


def test_counts_do_not_depend_on_partitions(spark, monkeypatch):
    docs = documents(spark, corpus(40))
    want = language.train(docs.coalesce(1))
    monkeypatch.setattr(language, "GRAMS_HELD", 50)
    assert language.train(docs.repartition(13)).key == want.key
