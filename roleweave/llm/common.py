"""What the operators here share: sessions, Arrow batches, checkpoints, deterministic samples."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.session import checkpoint_dir, prepare

#: Rows of one Arrow batch handed to Python; keeps a batch of long texts small.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package on its workers and batches small enough for long texts."""
    prepare(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder of ``spark.checkpoint.dir``.

    A lost executor costs nothing: the rows are in shared storage, and the plan before
    them is cut.  The files go when Spark cleans the checkpoint up.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_KEPT: dict = {}


def kept_in_worker(key: tuple, make):
    """``make()``, kept by this Python worker until it is asked for something else.

    Tables and word caches are worth keeping between tasks, but a worker serves many
    operators: it holds one such object at a time.
    """
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Returns freed memory to the system, which a long-lived worker would else hold."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(step):
    """An Arrow step (batches to batches) that returns what its task held when its batches end.

    Arrow allocates from the C library meanwhile, whose freed memory goes back to the
    system; tables that :func:`kept_in_worker` keeps stay.
    """

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def id_hash(column: str | Column) -> Column:
    """crc32 of an id's decimal text (null stays null)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary"))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array as one uint8 array, and its ``len + 1`` offsets; null reads as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: Labels learned at most; where a table holds more, those of the most distinct rows (ties: the least label).
MOST_GROUPS = 256
#: Share of the hash range looked at first, in multiples of what should hold the sample.
LOOK = 2.0


def lowest_hashes(rows: DataFrame, group: str, hashed: str, per_group: int) -> dict:
    """Per group, the ``per_group``-th smallest distinct hash (the largest if there are fewer).

    Rows at or below it are a deterministic sample of at most ``per_group`` distinct
    texts a group.  A mergeable count of distinct hashes tells which part of the hash
    range holds about twice as many; only rows of that part are shuffled, and the exact
    place is found among them, so no group gathers more at any number of tasks.  A range
    that held too few is widened.  The driver receives one row a group, for at most
    :data:`MOST_GROUPS` groups.
    """
    from pyspark.sql import Window

    rows = rows.select(group, hashed).where(F.col(group).isNotNull() & F.col(hashed).isNotNull())
    counted = rows.groupBy(group).agg(F.approx_count_distinct(hashed).alias("number")).orderBy(F.desc("number"), group).limit(MOST_GROUPS)
    share = {r[0]: min(1.0, LOOK * per_group / max(1, r["number"])) for r in counted.collect()}
    limits: dict = {}
    w = Window.partitionBy(group).orderBy(hashed)
    while share:
        looked = {g: min((1 << 63) - 1, int(part * (1 << 64)) - (1 << 63)) for g, part in share.items()}
        found = (
            rows.where(within_limits(F.col(group), F.col(hashed), looked)).distinct()
            .withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= per_group)
            .groupBy(group).agg(F.max(hashed).alias("limit_hash"), F.count("*").alias("number"))
        )
        for r in found.collect():
            if r["number"] >= per_group or share[r[0]] >= 1:
                limits[r[0]] = r["limit_hash"]
        share = {g: min(1.0, 4 * part) for g, part in share.items() if g not in limits and part < 1}
    return limits


def within_limits(group: Column, hashed: Column, limits: dict) -> Column:
    """True for rows whose hash is at or below their group's limit."""
    chosen = F.lit(False)
    for value, limit in limits.items():
        chosen = chosen | ((group == F.lit(value)) & (hashed <= F.lit(limit)))
    return chosen
