import hashlib
import zlib

import pytest
from helpers import AWKWARD, corpus, documents
from pyspark.sql import functions as F

from roleweave.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    i, text, lang, source, n = row
    values = [i, source, lang, None if n is None else n + more, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i - i % 2
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 2])))
        i //= 2
    return out


def by_brute_force(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0], plain_leaf(r), r))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = levels_of([x[2] for x in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, (_, doc_id, made, row) in enumerate(groups[g]):
            steps = siblings(trees[g], i) + siblings(top, at)
            altered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and row[4] is not None
            node = plain_leaf(row, 1) if altered else made
            for left, right in steps:
                node = h(left, node, right)
            out.append((doc_id, made, trees[g][-1][0], top[-1][0], h(*[a + b for a, b in steps]), node))
    return sorted(out, key=str)


def made(spark, df):
    got = merkle.manifest(df, merkle.one_more_character(df))
    got = got.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.proof(F.col("steps"))).alias("p"), merkle.fold(F.coalesce("altered_leaf", "leaf"), F.col("steps")).alias("f"))
    return sorted(map(tuple, got.collect()), key=str)


def with_sizes(rows):
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_is_that_of_plain_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = corpus(75) + AWKWARD + [(5000 + i, "é" * i, None, None) for i in range(5)] + [(6000, "alone", "zz", "s")]
    assert made(spark, documents(spark, rows)) == by_brute_force(with_sizes(rows))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9])
def test_groups_of_every_small_size(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(i, f"t{i}", "aa", "s") for i in range(n)]
    assert made(spark, documents(spark, rows)) == by_brute_force(with_sizes(rows))


def test_places_joined_by_a_shuffle_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 3)
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = corpus(50) + [(7, "same", "aa", "s")] * 30 + [(None, None, None, None)] * 3
    assert made(spark, documents(spark, rows)) == by_brute_force(with_sizes(rows))


def test_a_row_that_changed_is_found_and_only_that(spark):
    df = documents(spark, corpus(60))
    got = merkle.manifest(df, merkle.one_more_character(df)).select("doc_id", (merkle.fold(F.coalesce("altered_leaf", "leaf"), F.col("steps")) == F.col("root")).alias("ok")).collect()
    assert {r.doc_id for r in got if not r.ok} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0}


def test_an_empty_table(spark):
    assert made(spark, documents(spark, [])) == []
