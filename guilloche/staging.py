"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Where it is unset, a local session gets
    a fresh temporary folder and any other one a folder inside the warehouse, unless that lies on
    one machine.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_guilloche_dir", None)
    if not known:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            known = "file://" + tempfile.mkdtemp(prefix="spark-")
        else:
            known = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_guilloche"
            if "://" not in known or known.startswith("file:"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark._guilloche_dir = known
    return known.rstrip("/") if "://" in known or known.startswith("file:") else "file://" + known.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_dealt(df: DataFrame, label: str, key: str, tasks: int) -> DataFrame:
    """``stage`` in as many buckets of ``key`` as there are to be tasks: what is read back stays dealt out by it, so that grouping by it shuffles nothing.

    Rows that are already dealt out by the key, to a number of tasks that divides this one, make
    one file a bucket. The table is only a name for the files while they are looked up.
    """
    spark, name = df.sparkSession, f"{re.sub(r'[^a-z0-9]', '_', label)}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", new_path(spark, label)).bucketBy(tasks, key).saveAsTable(name)
    dealt = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return dealt
