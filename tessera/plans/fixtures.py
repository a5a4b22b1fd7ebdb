"""Arrays derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .spec import ArraySpec


def e2(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as a matrix (vec_id, dimension)."""
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    return t.select(F.col("vec_id").cast("bigint").alias("x0"), F.posexplode("embedding").alias("x1", "v"))


def s3(spark: SparkSession, d: str) -> DataFrame:
    """Largest price by supplier, line number and quantity."""
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    at = [F.col("l_suppkey").cast("int").alias("x0"), (F.col("l_linenumber") - 1).cast("int").alias("x1"), (F.col("l_quantity") - 1).cast("int").alias("x2")]
    return t.groupBy(*at).agg(F.max("l_extendedprice").alias("v"))


def _event_cells(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet")
    ts = F.col("ts").cast("timestamp_ntz")
    return t.select("event_type", F.col("user_id").cast("int").alias("u"), (F.dayofyear(ts) - 1).cast("int").alias("d"), F.hour(ts).cast("int").alias("h"), "value")


def t3(spark: SparkSession, d: str) -> DataFrame:
    """Largest event value by user, day and hour."""
    return _event_cells(spark, d).groupBy(F.col("u").alias("x0"), F.col("d").alias("x1"), F.col("h").alias("x2")).agg(F.max("value").alias("v"))


# The event types in alphabetical order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def c4(spark: SparkSession, d: str) -> DataFrame:
    """Largest event value by type, user, day and hour."""
    rank = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")) - 1
    return _event_cells(spark, d).groupBy(rank.cast("int").alias("x0"), F.col("u").alias("x1"), F.col("d").alias("x2"), F.col("h").alias("x3")).agg(F.max("value").alias("v"))


def spec(name: str, dtype: str, block_shape, extent) -> ArraySpec:
    return ArraySpec(name, len(block_shape), dtype, tuple(block_shape), tuple(extent))


#: Generous fixed extents: larger than any coordinate of the tables at the scales in use.
E2 = spec("E2", "float32", (50, 16), (1 << 24, 64))
S3 = spec("S3", "float64", (20, 3, 10), (1 << 20, 7, 50))
T3 = spec("T3", "float64", (32, 10, 8), (1 << 20, 366, 24))
C4 = spec("C4", "float64", (1, 32, 10, 8), (5, 1 << 20, 366, 24))
