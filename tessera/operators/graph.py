"""Connected components of an edge list by spreading smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node of its component) from (a, b). Each round halves paths by pointer jumping."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        heard = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        new = materialize(roots.join(heard, "node").select("node", F.least("root", "heard").alias("root")))
        up = new.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = materialize(new.join(up, "root").select("node", F.least("root", "next").alias("root")))
        changed = new.join(roots.select("node", F.col("root").alias("old")), "node").where(F.col("old") != F.col("root"))
        if changed.isEmpty():
            return new
        roots = new
