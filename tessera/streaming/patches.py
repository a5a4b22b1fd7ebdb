"""Incremental ingestion: a stream of cell patches upserted into a snapshot, last writer by (ts, sequence) wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.region import with_blocks
from ..operators.store import TileArray
from ..sources.snapshot import load, save_blocks


def last_writes(patches: DataFrame, coords: list[str]) -> DataFrame:
    """The latest value of each cell of a micro-batch (columns coords, v, ts)."""
    return patches.groupBy(*coords).agg(F.max_by("v", F.struct("ts", "v")).alias("v"))


def upsert(array: TileArray, patches: DataFrame) -> TileArray:
    """Write single cells; blocks they touch are created, and the cells' slices marked dirty."""
    spec = array.spec
    new = last_writes(patches, spec.coords)
    touched = with_blocks(new, spec.block_shape)
    kept = array.block_cells().join(touched.select(*spec.blocks, *spec.coords), [*spec.blocks, *spec.coords], "left_anti").select(*spec.coords, "v")
    blocks = array.blocks.unionByName(touched.select(*spec.blocks).distinct()).distinct()
    axes = F.array(*(F.struct(F.lit(i).alias("axis"), (F.col(f"x{i}") % s).cast("int").alias("slice")) for i, s in enumerate(spec.block_shape)))
    dirty = touched.select(*spec.blocks, F.explode(axes).alias("a")).select(*spec.blocks, "a.axis", "a.slice")
    return TileArray(spec, kept.unionByName(new.withColumn("v", F.col("v").cast(spec.value_type))), blocks, array.dirty.unionByName(dirty).distinct())


def ingest(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that folds every micro-batch into the snapshot at `path` (it must exist); only partitions it touches are rewritten."""

    def fold(batch: DataFrame, _: int) -> None:
        array = load(batch.sparkSession, path)
        save_blocks(upsert(array, batch), path, with_blocks(batch, array.spec.block_shape).select("b0"))

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
