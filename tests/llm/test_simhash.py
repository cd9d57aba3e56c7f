import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import AWKWARD, corpus, documents
from roleweave.llm import simhash
from roleweave.llm.components import components


def slow_print(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def roots(n, linked):
    up = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = i, j
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                up[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while up[i] != i:
            i = up[i]
        out.append(i)
    return out


def test_fingerprints():
    for t in ["", " ", "A", "a b c d", "a b c d e", "É a\x85b c d e f", "ab " * 500] + [t for _, t, _, _ in corpus(12)]:
        assert simhash.fingerprint(t.encode()) == slow_print(t), t[:40]


def near(rng, n, groups=4):
    base = rng.integers(0, 2**63, groups, dtype=np.uint64)
    flips = lambda k: np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    return np.unique(np.array([base[i % groups] ^ flips(int(rng.integers(0, 7))) for i in range(n)], np.uint64))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 150), st.integers(0, 6))
def test_bit_slices_against_all_pairs(seed, n, radius):
    rng = np.random.default_rng(seed)
    fps = near(rng, n)
    rng.shuffle(fps)
    label = np.arange(len(fps))
    simhash.close_pairs(fps, np.ones(len(fps), np.int64), len(fps) - 1 - np.arange(len(fps)), radius, label)
    while not np.array_equal(label, up := label[label]):
        label = up
    assert label.tolist() == roots(len(fps), lambda i, j: bin(int(fps[i] ^ fps[j])).count("1") <= radius)


def test_blocks_of_a_hot_bucket_lose_no_link(spark):
    fps = near(np.random.default_rng(5), 300, groups=2)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = roots(len(fps), lambda i, j: bin(int(fps[i] ^ fps[j])).count("1") <= 4)
    for rows in (16, 2048):
        found = {r.node: r.root for r in components(simhash.links(df, 4, block_rows=rows), "a", "b").collect()}
        groups = [found.get(int(x), int(x)) for x in fps.view(np.int64)]
        first = {}
        assert [first.setdefault(g, i) for i, g in enumerate(groups)] == [first.setdefault(("w", w), i) for i, w in enumerate(want)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (None, 5), (7, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in range(101, 160)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_table(spark):
    rows = corpus(20)
    long = " ".join(f"w{i}" for i in range(900))
    rows += [(50, rows[3][1].upper(), "aa", "s"), (51, rows[3][1], "aa", "s"), (60, long, "aa", "s"), (61, long + " end", "aa", "s")] + AWKWARD
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = [slow_print(r[1]) for r in rows]
    group = roots(len(rows), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(key, [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got])) == sorted(map(key, [(r[0], p, least[g]) for r, p, g in zip(rows, prints, group)]))
    by = {r.doc_id: r.component_id for r in got}
    assert by[50] == by[51] == 3 and by[900] == by[901] == by[902] == 900 and by[61] == 60


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
