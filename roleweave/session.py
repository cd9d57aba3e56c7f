"""Session helpers: the confs every job here relies on, and the checkpoint folder."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

# SQL confs that change results or plans; applied to whatever session we are handed.
SESSION_CONFS = {
    # all stored times are UTC; IST is a rendering (see functions.dates)
    "spark.sql.session.timeZone": "UTC",
    # runtime re-planning: partition coalescing, skew-join splitting, join strategy switch
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # joins move rows by all of their keys, unless a query keeps its rows in blocks (see keep_blocks)
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the executors' Python workers (``addPyFile``
    of a zip built once per application): the Arrow UDFs and ``mapInPandas``
    functions live in package modules."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    import tempfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="roleweave-pyfiles-")
    zip_path = shutil.make_archive(os.path.join(out, "roleweave"), "zip", root_dir=os.path.dirname(pkg_dir),
                                   base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(zip_path)
    _SHIPPED.add(sc.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply :data:`SESSION_CONFS` to an existing session and ship the package to the
    executors (both idempotent)."""
    for k, v in SESSION_CONFS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def keep_blocks(spark: SparkSession) -> None:
    """Joins on a block and more leave rows that lie by block where they are.

    It only decides how rows move, and holds until the next :func:`prepare`.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "roleweave") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's builder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("ROLEWEAVE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SESSION_CONFS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A local session may leave it unset (tests, a laptop); then a folder under the
    system's temp folder is picked.  On a cluster that folder would be one machine's
    own, so an unset value is an error there.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[(\*|\d+)(, ?\d+)?\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        d = tempfile.mkdtemp(prefix="roleweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d
