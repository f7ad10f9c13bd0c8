"""Shared helpers of the training-data operators: staging, column hygiene, bounded broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guilloche.staging import new_path, shared_dir, stage

__all__ = ["empty", "new_path", "shared_dir", "small", "stage", "table"]

#: Rows up to which a dimension table counts as small enough to broadcast.
BROADCAST_ROWS = 200_000
#: What its rows may take together, written as JSON.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows of ``max_bytes`` together (as JSON); else as it is, for a shuffled join."""
    size = F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    rows, total = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if rows <= max_rows and (total or 0) <= max_bytes else df


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
