"""A cache of a computed source with block-level invalidation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.region import Roi, with_blocks
from ..plans.lineage import materialize
from ..plans.spec import ArraySpec
from .store import TileArray

#: Layers of fetched blocks after which they are written as one.
MAX_LAYERS = 8


class BlockCache:
    """Holds blocks of `source` (a function of no arguments giving cells) and refetches only absent or dirty ones.

    Every fetch writes the blocks it got as a layer, partitioned by the first block axis, and nothing else; `owner` says
    which layer holds a block. Frozen, it never fetches: what it hasn't seen reads 0, and invalidations are kept for the thaw.
    """

    def __init__(self, source: Callable[[], DataFrame], spec: ArraySpec):
        self.source, self.spec = source, spec
        self.store = TileArray.empty(source().sparkSession, spec)
        self.layers: list[DataFrame] = []
        self.owner = self.store.blocks.withColumn("layer", F.lit(0))
        self.frozen, self.deferred = False, []

    def invalidate(self, roi: Roi) -> None:
        """The source changed in a region."""
        if self.frozen:
            self.deferred.append(roi)
        else:
            self.store = self.store.set_dirty(roi)

    def _cells(self) -> DataFrame:
        """The cells of all layers that still own them, with their block columns."""
        out = None
        for k, layer in enumerate(self.layers):
            own = layer.join(self.owner.where(F.col("layer") == k).select(*self.spec.blocks), self.spec.blocks, "left_semi")
            out = own if out is None else out.unionByName(own)
        return out

    def _hold(self, blocks: DataFrame, cells: DataFrame, dirty: DataFrame) -> None:
        """Take cells (with block columns) as the content of whole blocks."""
        b = self.spec.blocks
        kind = self.spec.value_type
        self.layers.append(materialize(cells.select(*b, *self.spec.coords, F.col("v").cast(kind).alias("v"))))
        new = blocks.withColumn("layer", F.lit(len(self.layers) - 1))
        self.owner = materialize(self.owner.join(blocks, b, "left_anti").unionByName(new))
        held, dirty = self.owner.select(*b), materialize(dirty)
        if len(self.layers) >= MAX_LAYERS:
            self.layers, self.owner = [materialize(self._cells())], materialize(self.owner.withColumn("layer", F.lit(0)))
        self.store = TileArray(self.spec, self._cells(), held, dirty)

    def refresh(self, roi: Roi) -> DataFrame:
        """Bring a region up to date and return its cells, dense."""
        if not self.frozen:
            need = materialize(self.store.needed_dirty(roi))
            if not need.isEmpty():
                fresh = with_blocks(self.source(), self.spec.block_shape).join(need, self.spec.blocks, "left_semi")
                self._hold(need, fresh, self.store.dirty.join(need, self.spec.blocks, "left_anti"))
        return self.store.read(roi, dense=True)

    def put(self, roi: Roi, patch: DataFrame) -> None:
        """Push cells into the cache: the blocks they touch are written anew."""
        box = roi.block_range(self.spec.block_shape)
        new = self.store.write(roi, patch)
        touched = materialize(new.blocks.where(box.contains("b")))
        self._hold(touched, new.block_cells(box), new.dirty)

    def freeze(self) -> None:
        self.frozen = True

    def unfreeze(self) -> None:
        self.frozen = False
        for roi in self.deferred:
            self.invalidate(roi)
        self.deferred = []

    def clean_blocks(self) -> DataFrame:
        return self.store.clean_blocks()

    def free(self, roi: Roi) -> None:
        """Forget the clean blocks a region touches; they read 0 until they are fetched again."""
        b = self.spec.blocks
        gone = materialize(self.clean_blocks().where(roi.block_range(self.spec.block_shape).contains("b")))
        self.owner = materialize(self.owner.join(gone, b, "left_anti"))
        cells = self._cells() if self.layers else self.store.cells
        self.store = TileArray(self.spec, cells, self.owner.select(*b), self.store.dirty)

    def report(self) -> DataFrame:
        """One row: blocks, used bytes and the dirty share."""
        d = self.store.directory()
        return d.agg(F.count("*").alias("blocks"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("used_bytes"), F.coalesce(F.avg(F.col("dirty").cast("double")), F.lit(0.0)).alias("dirty_share"))
