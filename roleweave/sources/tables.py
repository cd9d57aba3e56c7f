"""Parquet table scans (S9 and the driver's tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def with_session_timestamps(df: DataFrame) -> DataFrame:
    """Cast TIMESTAMP_NTZ columns to TIMESTAMP (watermarks and intervals need it).

    With the session time zone at UTC the wall-clock value is unchanged.
    """
    cols = [F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, TimestampNTZType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, ``{sf_dir}/{name}.parquet``."""
    return with_session_timestamps(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
