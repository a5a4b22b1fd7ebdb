"""Consecutive numbers in sort order without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialize


def consecutive(df: DataFrame, keys: list[str], name: str, start: int = 0) -> DataFrame:
    """Add start, start + 1, ... by ascending keys (distinct rows): ranges are sorted apart, then offset by their sizes."""
    ranged = materialize(df.repartitionByRange(*keys).withColumn("part_", F.spark_partition_id()))
    sizes = ranged.groupBy("part_").agg(F.count("*").alias("n_"))
    offset = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select("part_", F.coalesce(F.sum("n_").over(offset), F.lit(0)).alias("offset_"))
    within = Window.partitionBy("part_").orderBy(*keys)
    number = F.row_number().over(within) - 1 + F.col("offset_") + start
    return ranged.join(sizes, "part_").withColumn(name, number.cast("bigint")).drop("part_", "offset_")
