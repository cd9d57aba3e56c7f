"""SimHash near-duplicates with a bit-sliced comparison.

A document's fingerprint is the majority of the bits of its shingles' hashes.  Two
fingerprints link when they differ in at most ``radius`` bits.  With ``radius + 2``
blocks of bits, a linked pair agrees on at least two blocks, so each distinct
fingerprint goes into one bucket for each pair of blocks and every linked pair meets.

In a bucket the bit planes lie vertically: bit ``i`` of a plane's words belongs to the
i-th fingerprint.  XOR of a plane with itself shifted by a lag compares 64 pairs at
once, carry-save counters add the differing bits of 64 pairs at once, and a word of
pairs is abandoned as soon as all of them exceed the radius.  Buckets of more than
``block_rows`` rows are dealt into blocks by hash, and each pair of blocks is a unit of
its own, so a hot bucket spreads over tasks and keeps every comparison.

A unit reports a spanning forest of its links, not all pairs; components are found by
:mod:`roleweave.llm.components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roleweave.llm.common import saved, tidy
from roleweave.llm.components import components

#: The contract's shingle length, radius, and seed of XXH64.
SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Hashes whose bits are unpacked at a time.
HASHES = 1 << 16
#: Planes that are added up between two looks at which words of pairs to abandon.
PLANES = 8


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Majority of the bits of the shingles' XXH64; 0 for a text without words."""
    found = text.lower().split()  # for bytes: A-Z, and space or \\t to \\r
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(ends + 1).tolist()]
    ends = [*ends[words - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[at : at + HASHES].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def _fingerprints(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        prints = np.array([fingerprint(t or b"", words) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's 64 bits as a long) of every row; null text is empty."""
    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(documents[id_col].alias("doc_id"), documents[text_col].cast("string").alias("text")).mapInArrow(
        tidy(lambda batches: _fingerprints(words, batches)), f"doc_id {kind}, fp bigint"
    )


def _planes(fps: np.ndarray, words: int) -> np.ndarray:
    """Bit planes (64, words) of uint64, lane i of a plane being bit i % 64 of word i // 64."""
    bits = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    out = np.zeros((64, words * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def _exceeds(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical counter is above the radius, or has overflowed."""
    above, equal = over.copy(), ~over
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            above |= equal & counter[k]
            equal &= ~counter[k]
    return above


def close_pairs(fps: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int, label: np.ndarray) -> None:
    """Joins in ``label`` all i and i + lag, ``first[i] <= lag <= last[i]``, that are within the radius.

    ``label`` is a union-find forest over the rows, every row its own root at the start.
    """
    n = len(fps)
    words = (n + 63) // 64
    lanes = words * 64
    planes = _planes(fps, words)
    lo, hi = np.ones(lanes, np.int64), np.zeros(lanes, np.int64)
    lo[:n], hi[:n] = first, last
    most = hi.reshape(words, 64).max(axis=1)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for q in range(int(hi.max(initial=0)) // 64 + 1):
        live_words = np.flatnonzero(most >= max(1, 64 * q))
        if not len(live_words):
            break
        lane = (live_words[:, None] * 64 + np.arange(64)).ravel()
        flat = np.arange(n)
        while not np.array_equal(flat, flat2 := label[flat]):
            flat = flat2
        label[:] = flat
        own = np.append(flat, np.full(lanes + 64 * q + 64 - n, -1))
        at_r, at_w, at_valid = [], [], []
        for r in range(64):
            lag = 64 * q + r
            ok = (lo[lane] <= lag) & (lag <= hi[lane])
            if lag and ok.any():
                ok &= own[lane] != own[lane + lag]
                valid = np.packbits(ok, bitorder="little").view("<u8")
                some = np.flatnonzero(valid)
                at_r.append(np.full(len(some), r, np.int64))
                at_w.append(live_words[some])
                at_valid.append(valid[some])
        if not at_r:
            continue
        r, w, alive = np.concatenate(at_r), np.concatenate(at_w), np.concatenate(at_valid)
        if not len(r):
            continue
        padded = np.zeros((64, words + q + 2), np.uint64)
        padded[:, :words] = planes
        counter = [np.zeros(len(r), np.uint64) for _ in range(max(1, radius.bit_length()))]
        over = np.zeros(len(r), np.uint64)
        low, high = r.astype(np.uint64), (64 - r).astype(np.uint64) % np.uint64(64)
        for plane in range(64):
            row = padded[plane]
            shifted = (row[w + q] >> low) | np.where(r > 0, row[w + q + 1] << high, np.uint64(0))
            carry = row[w] ^ shifted
            for k in range(len(counter)):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if plane % PLANES == PLANES - 1:
                alive &= ~_exceeds(counter, over, radius)
                keep = np.flatnonzero(alive)
                if not len(keep):
                    break
                if len(keep) < len(alive):
                    r, w, alive, over, low, high = r[keep], w[keep], alive[keep], over[keep], low[keep], high[keep]
                    counter = [c[keep] for c in counter]
        else:
            bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, bit = np.nonzero(bits)
            i = w[which] * 64 + bit
            for x, y in zip(i.tolist(), (i + 64 * q + r[which]).tolist()):
                x, y = root(x), root(y)
                if x != y:
                    label[max(x, y)] = min(x, y)


def _forest(radius: int, rows_at_once: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges of each unit's links; rows come sorted by unit and side, whole units in one task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(key: np.ndarray, side: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        n = len(fps)
        new = np.append(True, (key[1:] != key[:-1]).any(axis=1))
        starts = np.flatnonzero(new)
        unit = np.cumsum(new) - 1
        ends = np.append(starts[1:], n)[unit]
        index = np.arange(n)
        crossed = key[:, 1] != key[:, 2]
        second = (starts + np.add.reduceat(side == 0, starts))[unit]
        first = np.where(crossed, second - index, 1)
        last = np.where(crossed & (side == 1), 0, ends - 1 - index)
        label = np.arange(n)
        close_pairs(fps.view(np.uint64), np.maximum(first, 1), last, radius, label)
        while not np.array_equal(label, up := label[label]):
            label = up
        linked = np.flatnonzero(label != index)
        return pa.RecordBatch.from_arrays([pa.array(fps[linked]), pa.array(fps[label[linked]])], schema=schema)

    kept: list[np.ndarray] = []
    count = 0
    for batch in batches:
        rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]).astype(np.int64)
        if not len(rows):
            continue
        kept.append(rows)
        count += len(rows)
        if count < rows_at_once:
            continue
        rows = np.concatenate(kept)
        change = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))
        cut = int(change[-1]) + 1 if len(change) else 0
        if cut:
            yield solve(rows[:cut, :3], rows[:cut, 3], np.ascontiguousarray(rows[:cut, 4]))
        kept, count = [rows[cut:]], len(rows) - cut
    if count:
        rows = np.concatenate(kept)
        yield solve(rows[:, :3], rows[:, 3], np.ascontiguousarray(rows[:, 4]))


def links(prints: DataFrame, radius: int = RADIUS, block_rows: int = 2048, column: str = "fp") -> DataFrame:
    """``a``, ``b``: edges between distinct fingerprints that connect all that are within the radius.

    The edges are a spanning forest of each unit's links: enough for components, never
    the square of a group.  Null fingerprints take no part.
    """
    blocks = radius + 2
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]

    def bits(k: int):
        return F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1))

    keys = [
        F.lit(t) + F.lit(blocks * blocks) * (bits(x) + F.shiftleft(bits(y), cuts[x + 1] - cuts[x]))
        for t, (x, y) in enumerate(combinations(range(blocks), 2))
    ]
    distinct = prints.select(F.col(column).alias("fp")).where("fp is not null").distinct()
    keyed = distinct.select(F.explode(F.array(*keys)).alias("bucket"), "fp")
    # how many blocks a bucket is dealt into: by its size, one for nearly all
    dealt = (
        keyed.groupBy("bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > block_rows)
        .select("bucket", F.ceil(F.col("rows") / F.lit(block_rows)).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    units = (
        keyed.join(dealt, "bucket", "left").withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .select("bucket", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with_part"))
        .select(
            "bucket", F.least("part", "with_part").cast("long").alias("lower"), F.greatest("part", "with_part").cast("long").alias("upper"),
            F.when(F.col("part") <= F.col("with_part"), 0).otherwise(1).cast("long").alias("side"), "fp",
        )
    )
    return (
        units.repartition("bucket", "lower", "upper").sortWithinPartitions("bucket", "lower", "upper", "side")
        .mapInArrow(tidy(lambda batches: _forest(radius, 8 * block_rows, batches)), "a bigint, b bigint")
    )


def near_duplicates(documents: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of every row of ``documents``.

    ``component_id`` is the least id reachable over links, the row's own included;
    equal fingerprints link, the zero of texts without words too.  Null text reads as
    empty.  A row with a null id has a fingerprint and links others, but names no
    component; a component of such rows alone has a null name.  Repeated rows come out
    as often as they went in.
    """
    prints = saved(fingerprints(documents, words, id_col, text_col))
    roots = components(links(prints, radius), "a", "b")
    # exact copies share a fingerprint: their least id is gathered before any join
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    rooted = first.join(roots, first["fp"] == roots["node"], "left").select(first["fp"], "first_id", F.coalesce("root", "fp").alias("root"))
    # only components of several fingerprints need a second minimum
    least = rooted.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
