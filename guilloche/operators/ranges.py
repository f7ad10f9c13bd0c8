"""Running sums and ranks along an order, by ranges, so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guilloche.staging import stage


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each name in ``sums``, the sum of its values up to and with each row of its group, in the given order.

    Rows are dealt out by ranges of keys and order and written. A range adds up its own rows;
    the sums of the ranges before, one row for each group and range, are added to that.
    """
    added = {f"_v{k}": v for k, v in enumerate(sums.values())}
    dealt = rows.withColumns(added).repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(v).alias(v) for v in added])
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    same = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    bases = totals.select(*same, F.col("_range").alias("_at"), *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_b{v}") for v in added])
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.col("_range") == F.col("_at")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    joined = dealt.withColumns({f"_r{v}": F.sum(v).over(within) for v in added}).join(bases, on)
    return joined.select(*rows.columns, *[(F.col(f"_r{v}") + F.col(f"_b{v}")).alias(name) for name, v in zip(sums, added)])
