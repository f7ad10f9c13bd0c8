"""Screening of arriving notes (S8): each file is whole notes, so a micro-batch is complete in itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def screen_stream(spark: SparkSession, source: DataFrame, screen: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Apply ``screen`` to each micro-batch of a file stream and write its rows, once a batch.

    A batch that is tried again overwrites its own folder, so rows arrive exactly once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        screen(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def arriving(spark: SparkSession, path: str, schema, *, format: str = "parquet", files_per_batch: int = 100, recursive: bool = False) -> DataFrame:
    """Rows of the files that arrive below ``path``; with ``recursive`` in its folders as well."""
    source = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return source.option("recursiveFileLookup", recursive).load(path)
