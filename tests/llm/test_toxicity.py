import random

import numpy as np
import pyarrow as pa

from helpers import AWKWARD, STEMS, documents, words
from roleweave.llm import subwords, toxicity

BAD = ["stupid", "pathetic", "worthless"]


def labelled(n=160, seed=4):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        toxic = int(i % 4 == 0)
        text = words(rng, rng.randint(30, 60), STEMS["aa"]).split()
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text), "aa", f"s{i % 3}"))
        marks.append((i, 1, toxic))
    return rows, marks


def marks_table(spark, marks):
    return spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_bucket_pairs():
    word, bucket = subwords.buckets_of(["stupid", "stupiid", "é", "stupid"])
    by = [set(bucket[word == i].tolist()) for i in range(4)]
    assert by[0] == by[3] and len(by[0] & by[1]) >= 4 and len(by[2]) == 2  # <é> whole and as its 3-gram
    assert subwords.buckets_of(["ab"])[1].tolist() == subwords.buckets_of(["x", "ab"])[1][subwords.buckets_of(["x", "ab"])[0] == 1].tolist()


def test_word_of():
    assert [subwords.word_of(x) for x in ("IDIOT!!", "«Été»", "--", "a-b.", "x")] == ["idiot", "été", "", "a-b", "x"]


def test_held_out(spark):
    rows, marks = labelled(400)
    model = toxicity.train(documents(spark, rows), marks_table(spark, marks[:300] + [(5, 1, None), (None, 1, 1), (7, 1, 9)]))
    got = {r.doc_id: r for r in toxicity.score(documents(spark, rows), model).collect()}
    held = [(got[i].score, t) for i, _, t in marks[300:]]
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    # a misspelling never met shares n-grams with the word it comes from
    rng = random.Random(1)
    plain = words(rng, 40, STEMS["aa"])
    pair = documents(spark, [(1, plain, "aa", "s"), (2, f"{plain} stuppid patheticc", "aa", "s")])
    a, b = (r.score for r in toxicity.score(pair, model).orderBy("doc_id").collect())
    assert b > a
    odd = toxicity.score(documents(spark, AWKWARD), model).collect()
    by = {r.doc_id: r.score for r in odd}
    assert len(odd) == len(AWKWARD) and by[900] == by[901] == by[902] and by[None] == by[904]


def test_one_class_no_class_and_empty(spark):
    rows, marks = labelled(8)
    docs = documents(spark, rows)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, marks_table(spark, [(1, 1, 1)]))).collect()} == {1.0}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, marks_table(spark, []))).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), toxicity.train(docs, marks_table(spark, marks))).count() == 0


def test_word_table_starts_anew(monkeypatch):
    rows, marks = labelled(24)
    model = subwords.fit([(r[1], m[2]) for r, m in zip(rows, marks)])
    want = subwords.Scorer(model).logits([r[1] for r in rows])
    monkeypatch.setattr(subwords, "WORDS_KEPT", 10)
    small = subwords.Scorer(model)
    assert np.allclose(np.concatenate([small.logits([r[1]]) for r in rows]), want)


def naive(model, text):
    """The mean over words of the mean over their buckets, one word at a time, and the number of words."""
    found = []
    for raw in text.split():
        if word := subwords.word_of(raw):
            found.append(model.weights[subwords.buckets_of([word])[1]].astype(float).mean(axis=0))
    return model.bias + (np.mean(found, axis=0) if found else 0), len(text.split())


def test_scores_are_plain_averages(monkeypatch):
    rows, marks = labelled(24)
    model = subwords.fit([(r[1], m[2]) for r, m in zip(rows, marks)])
    texts = ["", " ", "--", "  a  --\x1cb\u3000c\x85 ", "IDIOT!! stupid", *[r[1] for r in rows], " ".join(r[1] for r in rows) + " "]
    texts += [" ".join(f"w{i % 97}" for i in range(9000))]
    want = [naive(model, t) for t in texts]
    for size in ((1 << 22, 1 << 12, 1 << 7), (50, 7, 3)):
        monkeypatch.setattr(subwords, "BYTES_AT_ONCE", size[0])
        monkeypatch.setattr(subwords, "PIECE", size[1])
        monkeypatch.setattr(subwords, "PIECES_AT_ONCE", size[2])
        scorer = subwords.Scorer(model)
        got, number = scorer.score(pa.array(texts))
        assert np.allclose(got, [w for w, _ in want]) and number.tolist() == [n for _, n in want]
        # what lies beside a text doesn't change a bit of its score
        alone = np.concatenate([scorer.score(pa.array([t]))[0] for t in texts])
        assert (alone == got).all()
