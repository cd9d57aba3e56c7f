"""Exact top-k by inner product: a Voronoi kNN join.

Queries and data are grouped by their nearest pivot.  A summary of each query group (its
largest distance to the pivot) bounds every inner product of its queries with a data
vector from both sides: pivot . x -/+ radius |x|.  The (k+1)-th best lower bound over all
data is a threshold that each query's k-th best score reaches, so a data vector goes to
a query group only if its upper bound reaches the group's threshold.  Groups are then
solved apart, in cells of bounded size: a large group's queries and data are dealt into
parts by a hash of their id, and every part of queries meets every part of data.
Scores are exact whole numbers; bounds carry a margin for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roleweave.llm.common import saved

#: Pivots: the bound of what every task holds of the data.
PIVOTS = 24
#: Rows of a part of a group, queries and data.
QUERY_ROWS, DATA_ROWS = 1024, 8192
#: Scores that one product of matrices makes at a time.
SCORES = 1 << 22


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return ((pivots**2).sum(axis=1) - 2 * (x @ pivots.T)).argmin(axis=1)


def _radii(pivots: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's summary of its queries: rows and largest distance to the pivot, by group."""
    rows, far = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for batch in batches:
        x = _matrix(batch.column(0), pivots.shape[1]).astype(float)
        group = _nearest(x, pivots)
        rows += np.bincount(group, minlength=len(pivots))
        np.maximum.at(far, group, np.sqrt(((x - pivots[group]) ** 2).sum(axis=1)))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(rows), pa.array(far)], ["part", "n", "far"])


def _lower(pivots: np.ndarray, radius: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's best lower bounds by query group, ``k`` of each at most."""
    best = np.full((0, len(pivots)), -np.inf)
    for batch in batches:
        x = _matrix(batch.column(0), pivots.shape[1]).astype(float)
        if len(x):
            low = x @ pivots.T - np.sqrt((x**2).sum(axis=1))[:, None] * radius
            best = np.sort(np.concatenate([best, low]), axis=0)[-k:]
    groups = np.repeat(np.arange(len(pivots), dtype=np.int32), len(best))
    yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(best.T.ravel())], ["part", "low"])


def _group_queries(pivots: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group = _nearest(_matrix(batch.column(1), pivots.shape[1]).astype(float), pivots)
        yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), *batch.columns], ["part", "id", "v"])


def _replicate(pivots: np.ndarray, radius: np.ndarray, least: np.ndarray, parts: int, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each data vector once for every query group whose threshold its upper bound reaches.

    Vectors of a batch that go to the same cells travel as one row: their ids and their
    matrix as bytes.
    """
    for batch in batches:
        whole = _matrix(batch.column(1), pivots.shape[1])
        ids, x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), whole.astype(float)
        norm = np.sqrt((x**2).sum(axis=1))[:, None]
        upper = x @ pivots.T + norm * radius
        margin = 1e-9 * norm * (radius + np.sqrt((pivots**2).sum(axis=1))) + 1e-9
        row, group = np.nonzero(upper + margin >= least)
        if not len(row):
            continue
        dealt = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        cell = group * parts + dealt[row]
        order = np.argsort(cell, kind="stable")
        cell, row = cell[order], row[order]
        cut = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        pieces = np.split(row, cut[1:])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array((cell[cut] // parts).astype(np.int32)), pa.array((cell[cut] % parts).astype(np.int32)),
                pa.array([ids[r].tobytes() for r in pieces], pa.binary()), pa.array([whole[r].astype(kind).tobytes() for r in pieces], pa.binary()),
            ],
            ["part", "x_part", "ids", "vectors"],
        )


def _solve(k: int, exact_float: bool, stored: str, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
    """The best ``k`` of each query of a cell among the cell's data."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(data):
        kind = np.float64 if exact_float else np.int64
        q, wanted = np.stack(queries["v"].to_numpy()).astype(kind), queries["id"].to_numpy(np.int64)
        ids = np.frombuffer(b"".join(data["ids"]), np.int64)
        x = np.frombuffer(b"".join(data["vectors"]), stored).reshape(len(ids), -1).astype(kind)
        by_id = np.argsort(ids, kind="stable")
        ids, x = ids[by_id], x[by_id]
        for at in range(0, len(q), max(1, SCORES // len(x))):
            part = slice(at, at + max(1, SCORES // len(x)))
            score = q[part] @ x.T
            for i, own in enumerate(wanted[part]):
                s, mine = score[i], ids != own
                if not mine.all():
                    s, its = s[mine], ids[mine]
                else:
                    its = ids
                if len(s) > k:  # all that reach the k-th score, then the smaller ids of the ties
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    some = np.flatnonzero(s >= edge)
                else:
                    some = np.arange(len(s))
                some = some[np.argsort(-s[some], kind="stable")][:k]
                out["query_id"].append(np.full(len(some), own)), out["vec_id"].append(its[some]), out["score"].append(s[some].astype(np.int64))
    return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})


def quantized(vector: Column, scale: int = 64) -> Column:
    """floor(scale * component) of each component as double; null where the vector is null or
    empty or has a null or non-finite component."""
    doubles = F.transform(vector, lambda c: c.cast("double"))
    # exists() is null where nothing is true and a component is null; transform() counts nulls instead
    bad = F.exists(doubles, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(doubles, lambda c: F.floor(F.lit(float(scale)) * c)))


def top_k(data: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's ``k`` best data rows by inner product.

    Vectors are arrays of whole numbers of one length.  Ties go to the smaller id; a row
    with the query's own id is no candidate; fewer candidates give fewer rows, a query
    without any gives none.  Rows with a null id or vector take no part, and of rows with
    one id and vector one does.  Vectors of another length than most have no product with
    them and take no part either.
    No query or data row is capped or left out: the bounds only drop rows that can't be
    among the best.  Scores must fit 64 bits.
    """
    narrow = lambda df: df.select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v")).where("id is not null and v is not null").distinct()
    x, q = narrow(data), narrow(queries)
    lengths = x.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if lengths is not None:
        x, q = x.where(F.size("v") == lengths["length"]), q.where(F.size("v") == lengths["length"])
    x, q = saved(x), saved(q)
    # pivots: distinct query vectors with the smallest hashes, a bounded sample
    centre = [r[0] for r in q.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()]
    result = "query_id bigint, vec_id bigint, score bigint"
    if not centre:
        return data.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    p = np.array(centre, float)
    groups, far = np.zeros(len(p), np.int64), np.zeros(len(p))
    for r in q.select("v").mapInArrow(lambda b: _radii(p, b), "part int, n bigint, far double").groupBy("part").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect():
        groups[r["part"]], far[r["part"]] = r["n"], r["far"]
    low = x.select("v").mapInArrow(lambda b: _lower(p, far, k + 1, b), "part int, low double")
    ranked = low.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("low")))).where(F.col("place") <= k + 1)
    least = np.full(len(p), -np.inf)
    for r in ranked.groupBy("part").agg(F.min("low").alias("low"), F.count("*").alias("n")).collect():
        least[r["part"]] = r["low"] if r["n"] > k else -np.inf
    least[groups == 0] = np.inf  # no query there
    biggest = float(np.abs(p).max()) + float(far.max())
    # the largest component of all rows, those with poor bounds too: they can be sent as well
    whole = x.agg(F.count("*").alias("n"), F.max(F.array_max("v").cast("double")).alias("high"), F.min(F.array_min("v").cast("double")).alias("low")).first()
    rows, most = whole["n"], max(whole["high"] or 0.0, -(whole["low"] or 0.0))
    exact_float = max(biggest, most) * most * p.shape[1] < 2**52
    query_parts = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // QUERY_ROWS))) for n in groups]), F.col("part") + 1)
    data_parts = max(1, -(-rows // DATA_ROWS))
    own = F.pmod(F.xxhash64("id"), query_parts).cast("int")
    asked = q.mapInArrow(lambda b: _group_queries(p, b), "part int, id bigint, v array<bigint>").withColumn("q_part", own).withColumn(
        "x_part", F.explode(F.sequence(F.lit(0), F.lit(data_parts - 1)))
    )
    stored = "<i2" if max(biggest, most) < 2**15 else "<i8"
    sent = x.mapInArrow(
        lambda b: _replicate(p, far, least, data_parts, stored, b), "part int, x_part int, ids binary, vectors binary"
    ).withColumn("q_part", F.explode(F.sequence(F.lit(0), query_parts - 1)))
    cell = ["part", "q_part", "x_part"]
    solved = asked.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInPandas(lambda a, b: _solve(k, exact_float, stored, a, b), result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
