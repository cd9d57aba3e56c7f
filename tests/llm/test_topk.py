import random

import numpy as np
import pytest

from roleweave.llm import topk


def slow(rows, queries, k):
    out = []
    for q, v in sorted(queries):
        best = sorted(((-int(np.dot(np.array(v, object), np.array(w, object))), i) for i, w in rows if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, v array<bigint>, part int, score int")


@pytest.mark.parametrize("dim,scale,pivots", [(4, 20, 3), (8, 20, 24), (3, 10**8, 5)])
def test_against_all_pairs(spark, monkeypatch, dim, scale, pivots):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "DATA_ROWS", 50)
    rng = random.Random(dim)
    centres = [[rng.randint(-scale, scale) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + rng.randint(-scale // 8, scale // 8) for c in rng.choice(centres)]) for i in range(160)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(300, [0] * dim)]  # a very common vector, and zero
    queries = [r for r in rows if r[0] % 7 == 0] + [(300, [0] * dim)]
    got = topk.top_k(table(spark, rows), table(spark, queries), 9, pivots=pivots).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == slow(rows, queries, 9)


def test_pruning_drops_rows_but_no_result():
    far = np.array([[1000, 0]]), np.array([5.0])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[900, 0], [-900, 0]], pa.list_(pa.int64()))], ["id", "v"])
    sent = list(topk._replicate(*far, np.array([0.0]), 1, "<i2", iter([batch])))
    assert [np.frombuffer(x, np.int64).tolist() for b in sent for x in b.column(2).to_pylist()] == [[1]]


def test_awkward_rows(spark):
    rows = [(1, [1, 2]), (1, [1, 2]), (2, None), (None, [1, 1]), (3, [2, 2]), (4, [2, 2]), (5, [1, 2, 3])]
    got = topk.top_k(table(spark, rows), table(spark, rows[:1]), 20).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(1, 1, 3, 6), (1, 2, 4, 6)]
    assert topk.top_k(table(spark, [(1, [1])]), table(spark, [(1, [1])]), 20).count() == 0
    assert topk.top_k(table(spark, []), table(spark, []), 20).count() == 0
    assert topk.top_k(table(spark, rows), table(spark, []), 20).count() == 0


def test_quantized(spark):
    df = spark.createDataFrame([(1, [0.5, -0.01]), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, None), (6, [])], "i int, e array<float>")
    assert [r[0] for r in df.orderBy("i").select(topk.quantized(df["e"])).collect()] == [[32, -1], None, None, None, None, None]


def test_one_outlier_alone_in_its_task(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    rows = [(i, [10, 3 if i % 2 else -3]) for i in range(8)] + [(50, [0, 40000])]  # bounds of 50 are the worst of all
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false"), spark.conf.set("spark.sql.shuffle.partitions", "64")
        got = topk.top_k(table(spark, rows), table(spark, rows[:2]), 2, pivots=1).orderBy("query_id", "rank").collect()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
    assert [tuple(r) for r in got] == slow(rows, rows[:2], 2)
    assert got[2].vec_id == 50 and got[2].score == 120000
