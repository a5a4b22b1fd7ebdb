"""The blocked array: cells, the directory of stored blocks, and dirty slices. Every mutator returns a new array.

cells:  x0.., v              only cells ever written; an absent cell of a stored block is 0
blocks: b0..                 the stored blocks, whether or not any of their cells is non-zero
dirty:  b0.., axis, slice    one row per dirty slice; a block is dirty while it has any
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.region import Roi, grid, with_blocks
from ..plans.spec import ITEM_BYTES, ArraySpec


def _all(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms)


class TileArray:
    """Immutable handle of three DataFrames and a spec."""

    def __init__(self, spec: ArraySpec, cells: DataFrame, blocks: DataFrame | None = None, dirty: DataFrame | None = None, ranges: DataFrame | None = None):
        """`cells` may carry the block columns it is stored by; reads then name them. `ranges`: b0.., vmin, vmax, if tracked."""
        self.spec, self.spark = spec, cells.sparkSession
        kinds = dict(cells.dtypes)
        at = [F.col(c) if kinds[c] in ("int", "bigint") else F.col(c).cast("int").alias(c) for c in spec.coords]  # no cast between a predicate and the scan
        v = F.col("v").cast(spec.value_type).alias("v")
        self._stored = cells.select(*spec.blocks, *at, v) if set(spec.blocks) <= set(kinds) else None
        self.cells = cells.select(*at, v)
        self.blocks = blocks if blocks is not None else with_blocks(self.cells, spec.block_shape).select(*spec.blocks).distinct()
        self.dirty = dirty if dirty is not None else self._no_dirty()
        self._ranges = (ranges if ranges is not None else self.directory().select(*spec.blocks, "vmin", "vmax")) if spec.minmax else None

    # -- construction ---------------------------------------------------------------------------

    @staticmethod
    def empty(spark: SparkSession, spec: ArraySpec) -> "TileArray":
        """No block stored."""
        ints = ", ".join(f"{c} int" for c in spec.coords)
        cells = spark.createDataFrame([], f"{ints}, v {spec.value_type}")
        return TileArray(spec, cells, spark.createDataFrame([], ", ".join(f"{c} int" for c in spec.blocks)))

    @staticmethod
    def from_numpy(spark: SparkSession, spec: ArraySpec, a: np.ndarray) -> "TileArray":
        """All of `a` written at the origin."""
        return TileArray.empty(spark, spec).write(Roi((0,) * a.ndim, a.shape), numpy_cells(spark, a, spec))

    def _no_dirty(self) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"{c} int" for c in [*self.spec.blocks, "axis", "slice"]))

    def _with(self, cells=None, blocks=None, dirty=None, spec=None, ranges=None) -> "TileArray":
        same = self._stored if self._stored is not None else self.cells
        ranges = self._ranges if ranges is None and cells is None else ranges
        return TileArray(spec or self.spec, same if cells is None else cells, self.blocks if blocks is None else blocks, self.dirty if dirty is None else dirty, ranges)

    def _inside_cells(self, roi: Roi) -> DataFrame:
        """Cells of a region; where they are stored by block, the predicate names the blocks too."""
        if self._stored is None:
            return self.cells.where(roi.contains())
        return self._stored.where(roi.cells(self.spec.block_shape)).select(*self.spec.coords, "v")

    def block_cells(self, box: Roi | None = None) -> DataFrame:
        """Cells with their block columns; of a box of blocks only, if given."""
        out = self._stored if self._stored is not None else with_blocks(self.cells, self.spec.block_shape)
        return out if box is None else out.where(box.contains("b"))

    # -- reads ----------------------------------------------------------------------------------

    def read(self, roi: Roi, dense: bool = False) -> DataFrame:
        """Cells of a region; dense: every cell of it, 0 where nothing is stored."""
        inside = self._inside_cells(roi)
        if not dense:
            return inside
        zero = F.lit(0).cast(self.spec.value_type)
        return grid(self.spark, roi).join(inside, self.spec.coords, "left").withColumn("v", F.coalesce("v", zero))

    def __getitem__(self, slices) -> DataFrame:
        return self.read(Roi.of_slices(slices, self.spec.ndim))

    def at(self, *point: int) -> DataFrame:
        """One row: the value at a point, 0 if its block is absent."""
        return self.read(Roi(point, tuple(x + 1 for x in point)), dense=True)

    def nonzero(self) -> DataFrame:
        """Non-zero cells, by block, then scan order (axis 0 fastest)."""
        order = [*self.spec.blocks, *reversed(self.spec.coords)]
        return with_blocks(self.cells.where(F.col("v") != 0), self.spec.block_shape).orderBy(*order).select(*self.spec.coords, "v")

    def coordinate_lists(self) -> DataFrame:
        """The non-zero cells while coordinate lists are enabled, else no row."""
        return self.nonzero() if self.spec.coo else self.nonzero().limit(0)

    def nonzero_numpy(self) -> list[np.ndarray]:
        """One array a coordinate, then the values, on the driver."""
        rows = self.nonzero().toPandas()
        return [rows[c].to_numpy() for c in [*self.spec.coords, "v"]]

    def to_numpy(self, roi: Roi) -> np.ndarray:
        """A region as a dense array on the driver."""
        out = np.zeros(roi.shape(), dtype=self.spec.dtype if self.spec.dtype != "bool" else bool)
        rows = self.read(roi).toPandas()
        out[tuple(rows[c].to_numpy() - a for c, a in zip(self.spec.coords, roi.p))] = rows["v"].to_numpy()
        return out

    # -- writes ---------------------------------------------------------------------------------

    def _touched(self, roi: Roi) -> DataFrame:
        return grid(self.spark, roi.block_range(self.spec.block_shape), "b")

    def _written(self, roi: Roi, cells: DataFrame) -> "TileArray":
        """Directory and dirty slices after a write that left `cells`."""
        box = roi.block_range(self.spec.block_shape)
        if self.spec.delete_empty:  # of the touched blocks those left with a non-zero cell, however many the region spans
            touched = with_blocks(cells.where(F.col("v") != 0), self.spec.block_shape).where(box.contains("b")).select(*self.spec.blocks).distinct()
            kept = lambda df: df.where(~box.contains("b")).unionByName(df.where(box.contains("b")).join(touched, self.spec.blocks, "left_semi"))
        else:
            touched, kept = self._touched(roi), lambda df: df
        new = touched.join(self.blocks, self.spec.blocks, "left_anti")
        blocks = kept(self.blocks).unionByName(new).distinct()
        dirty = self._clean(roi, kept(self.dirty).unionByName(self._all_slices(new)))
        if self.spec.delete_empty:
            cells = kept(with_blocks(cells, self.spec.block_shape)).select(*self.spec.coords, "v")
        ranges = None
        if self._ranges is not None:  # only the touched blocks are measured again
            there = TileArray(self.spec.with_(minmax=False), with_blocks(cells, self.spec.block_shape).where(box.contains("b")), blocks.where(box.contains("b")), dirty)
            ranges = self._ranges.where(~box.contains("b")).unionByName(there.directory().select(*self.spec.blocks, "vmin", "vmax"))
        return self._with(cells, blocks, dirty, ranges=ranges)

    def write(self, roi: Roi, patch: DataFrame) -> "TileArray":
        """Replace a region by the patch's cells (absolute coordinates); cells it lacks become 0. Creates blocks."""
        inside = patch.where(roi.contains()).select(*self.spec.coords, F.col("v").cast(self.spec.value_type).alias("v"))
        return self._written(roi, self.cells.where(~roi.contains()).unionByName(inside))

    def __setitem__(self, slices, patch):
        raise TypeError("arrays are immutable: use array = array.write(roi, patch)")

    def write_point(self, point: tuple[int, ...], v) -> "TileArray":
        """Upsert one cell."""
        row = self.spark.createDataFrame([tuple(point)], ", ".join(f"{c} int" for c in self.spec.coords)).withColumn("v", F.lit(v))
        return self.write(Roi(tuple(point), tuple(x + 1 for x in point)), row)

    def write_nonzero(self, roi: Roi, patch: DataFrame, write_as_zero) -> "TileArray":
        """Masked write: 0 keeps the old value, `write_as_zero` writes 0, anything else is written."""
        new = patch.where(roi.contains()).select(*self.spec.coords, F.col("v").cast(self.spec.value_type).alias("new"))
        both = self._inside_cells(roi).join(new, self.spec.coords, "full_outer")  # the cells outside aren't shuffled
        zero = F.lit(0).cast(self.spec.value_type)
        v = F.when(F.col("new").isNull() | (F.col("new") == 0), F.coalesce("v", zero)).when(F.col("new") == write_as_zero, zero).otherwise(F.col("new"))
        return self._written(roi, self.cells.where(~roi.contains()).unionByName(both.select(*self.spec.coords, v.alias("v"))))

    def delete(self, roi: Roi) -> "TileArray":
        """Drop every block the region touches, whole."""
        hit = roi.block_range(self.spec.block_shape).contains("b")
        cells = self.block_cells().where(~hit).select(*self.spec.coords, "v")
        ranges = None if self._ranges is None else self._ranges.where(~hit)
        return self._with(cells, self.blocks.where(~hit), self.dirty.where(~hit), ranges=ranges)

    def relabel(self, lut: DataFrame) -> "TileArray":
        """v := r[v mod len(r)] for every cell of every stored block; lut: (k 0.., r). Zeros of stored blocks follow r[0].

        The table may be of any size: it is joined on the index, and Catalyst broadcasts it if it is small.
        A value whose index the table lacks is kept.
        """
        n, zero_to = lut.agg(F.count("*"), F.max(F.when(F.col("k") == 0, F.col("r")))).first()
        cells = self.cells
        if zero_to:
            cells = self.dense_cells()
        index = F.pmod(F.col("v").cast("bigint"), F.lit(n))
        out = cells.withColumn("k", index).join(lut.select(F.col("k").cast("bigint").alias("k"), "r"), "k", "left")
        return self._with(out.select(*self.spec.coords, F.coalesce(F.col("r").cast(self.spec.value_type), "v").alias("v")))

    def dense_cells(self) -> DataFrame:
        """Every cell of every stored block (clipped to the extent), zeros included."""
        out = self.blocks
        for i, s in enumerate(self.spec.block_shape):
            last = (F.col(f"b{i}") + 1) * s
            last = F.least(last, F.lit(self.spec.extent[i])) if self.spec.extent else last
            out = out.withColumn(f"x{i}", F.explode(F.sequence(F.col(f"b{i}") * s, last - 1)))
        return out.select(*self.spec.coords).join(self.cells, self.spec.coords, "left").withColumn("v", F.coalesce("v", F.lit(0).cast(self.spec.value_type)))

    # -- flags ----------------------------------------------------------------------------------

    def set_delete_empty(self, on: bool) -> "TileArray":
        """From now on writes drop the all-zero blocks they touch; blocks there already stay."""
        return self._with(spec=self.spec.with_(delete_empty=on))

    def set_compression(self, on: bool) -> "TileArray":
        return self._with(spec=self.spec.with_(compressed=on))

    def set_minmax(self, on: bool) -> "TileArray":
        """Keep each block's smallest and largest value: measured now, and after a write only where it touched."""
        return self._with(spec=self.spec.with_(minmax=on))

    def set_coordinate_lists(self, on: bool) -> "TileArray":
        """Coordinate lists; also toggles the deletion of empty blocks."""
        return self._with(spec=self.spec.with_(coo=on, delete_empty=on))

    # -- directory ------------------------------------------------------------------------------

    def directory(self) -> DataFrame:
        """One row per stored block: cells, non-zeros, smallest and largest value (padding zeros count), raw bytes, dirty."""
        cells = self.spec.block_cells
        per = with_blocks(self.cells, self.spec.block_shape).groupBy(*self.spec.blocks).agg(
            F.count("*").alias("n"), F.sum(F.when(F.col("v") != 0, 1).otherwise(0)).alias("nnz"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        zero = F.lit(0).cast(self.spec.value_type)
        padded = F.coalesce(F.col("n"), F.lit(0)) < cells
        dirty = self.dirty.select(*self.spec.blocks).distinct().withColumn("dirty", F.lit(True))
        return (
            self.blocks.join(per, self.spec.blocks, "left")
            .join(dirty, self.spec.blocks, "left")
            .select(
                *self.spec.blocks,
                F.coalesce("nnz", F.lit(0)).cast("bigint").alias("nnz"),
                F.lit(cells).cast("bigint").alias("n_cells"),
                F.when(padded, F.least(F.coalesce("lo", zero), zero)).otherwise(F.col("lo")).alias("vmin"),
                F.when(padded, F.greatest(F.coalesce("hi", zero), zero)).otherwise(F.col("hi")).alias("vmax"),
                F.lit(cells * ITEM_BYTES[self.spec.dtype]).cast("bigint").alias("raw_bytes"),
                F.coalesce("dirty", F.lit(False)).alias("dirty"),
            )
        )

    def minmax(self) -> DataFrame:
        """One row (vmin, vmax) over the tracked ranges of the blocks, or over the directory without them."""
        return (self.directory() if self._ranges is None else self._ranges).agg(F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))

    def num_blocks(self) -> int:
        return self.blocks.count()

    @property
    def block_shape(self) -> tuple[int, ...]:
        return self.spec.block_shape

    def stored_blocks(self, roi: Roi | None = None) -> DataFrame:
        """Stored blocks touching a region with their bounds: b0.., start0.., stop0.., in block order."""
        out = self.blocks if roi is None else self.blocks.where(roi.block_range(self.spec.block_shape).contains("b"))
        bounds = {f"start{i}": F.col(f"b{i}") * s for i, s in enumerate(self.spec.block_shape)}
        bounds |= {f"stop{i}": (F.col(f"b{i}") + 1) * s for i, s in enumerate(self.spec.block_shape)}
        return out.withColumns(bounds).orderBy(*self.spec.blocks)

    def enumerate_blocks(self, roi: Roi) -> DataFrame:
        """Coordinates of all blocks covering a region, stored or not."""
        return self._touched(roi)

    def block_bounds(self, b: tuple[int, ...]) -> Roi:
        return Roi(tuple(i * s for i, s in zip(b, self.spec.block_shape)), tuple((i + 1) * s for i, s in zip(b, self.spec.block_shape)))

    def compression(self) -> DataFrame:
        """b0.., raw_bytes, stored_bytes, compressed of each stored block; stored is snappy's size if the array is compressed."""
        spec = self.spec
        dtype = np.dtype(spec.dtype)

        def size(key, pdf: pd.DataFrame) -> pd.DataFrame:
            block = np.zeros(spec.block_shape, dtype=dtype)
            own = pdf[pdf["v"].notna()]
            if len(own):
                block[tuple(own[c].to_numpy(dtype=np.int64) % s for c, s in zip(spec.coords, spec.block_shape))] = own["v"].to_numpy()
            raw = block.tobytes(order="F")
            packed = len(pa.Codec("snappy").compress(raw)) if spec.compressed else len(raw)
            packed = -(-packed // dtype.itemsize) * dtype.itemsize if spec.compressed else packed
            return pd.DataFrame([(*key, len(raw), packed)], columns=[*spec.blocks, "raw_bytes", "stored_bytes"])

        if not spec.compressed:  # sizes follow from the directory alone
            raw = F.lit(spec.block_cells * ITEM_BYTES[spec.dtype]).cast("bigint")
            return self.blocks.select(*spec.blocks, raw.alias("raw_bytes"), raw.alias("stored_bytes"), F.lit(False).alias("compressed"))
        cells = self.blocks.join(self.block_cells(), spec.blocks, "left")
        ints = ", ".join(f"{b} int" for b in spec.blocks)
        return cells.groupBy(*spec.blocks).applyInPandas(size, f"{ints}, raw_bytes bigint, stored_bytes bigint").withColumn("compressed", F.lit(True))

    def sizes(self) -> DataFrame:
        """One row: blocks, compressed blocks, uncompressed_bytes, size_bytes and the mean of the blocks' ratios (null without blocks)."""
        return self.compression().agg(
            F.count("*").alias("blocks"), F.count_if("compressed").alias("compressed_blocks"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("uncompressed_bytes"),
            F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("size_bytes"), F.avg(F.col("stored_bytes") / F.col("raw_bytes")).alias("ratio"),
        )

    def size_bytes(self) -> int:
        return self.sizes().first()["size_bytes"]

    def average_compression_ratio(self) -> float:
        """Mean of the blocks' ratios; NaN without blocks."""
        got = self.sizes().first()["ratio"]
        return float("nan") if got is None else float(got)

    # -- dirty tracking -------------------------------------------------------------------------

    def _sides(self, blocks: DataFrame) -> DataFrame:
        """Add n0..: the side of each block, clipped to the extent."""
        sides = {}
        for i, s in enumerate(self.spec.block_shape):
            sides[f"n{i}"] = F.least(F.lit(s), self.spec.extent[i] - F.col(f"b{i}") * s) if self.spec.extent else F.lit(s)
        return blocks.withColumns(sides)

    def _all_slices(self, blocks: DataFrame) -> DataFrame:
        return self._slices(self._sides(blocks).withColumns({f"p{i}": F.lit(0) for i in range(self.spec.ndim)} | {f"q{i}": F.col(f"n{i}") for i in range(self.spec.ndim)}))

    def _slices(self, boxes: DataFrame) -> DataFrame:
        """Slices p_i..q_i-1 of every axis of each block row."""
        axes = F.array(*(F.struct(F.lit(i).alias("axis"), F.sequence(F.col(f"p{i}"), F.col(f"q{i}") - 1).alias("at")) for i in range(self.spec.ndim)))
        out = boxes.select(*self.spec.blocks, F.explode(axes).alias("a")).select(*self.spec.blocks, F.col("a.axis").alias("axis"), F.explode("a.at").alias("slice"))
        return out.select(*self.spec.blocks, F.col("axis").cast("int").alias("axis"), F.col("slice").cast("int").alias("slice"))

    def _inside(self, roi: Roi, blocks: DataFrame) -> DataFrame:
        """Blocks a region touches, with the part of it inside each: p0.., q0.., and sides n0..."""
        out = self._sides(blocks.where(roi.block_range(self.spec.block_shape).contains("b")))
        box = {}
        for i, s in enumerate(self.spec.block_shape):
            box[f"p{i}"] = F.greatest(F.lit(0), roi.p[i] - F.col(f"b{i}") * s).cast("int")
            box[f"q{i}"] = F.least(F.col(f"n{i}"), roi.q[i] - F.col(f"b{i}") * s).cast("int")
        out = out.withColumns(box)
        return out.where(_all([F.col(f"p{i}") < F.col(f"q{i}") for i in range(self.spec.ndim)]))

    def _clean(self, roi: Roi, dirty: DataFrame) -> DataFrame:
        """Slices left dirty: a slice goes if the region spans all other axes of its block; a block with an axis all clean is clean."""
        spans = [(F.col(f"p{i}") == 0) & (F.col(f"q{i}") == F.col(f"n{i}")) for i in range(self.spec.ndim)]
        inside = self._inside(roi, dirty.select(*self.spec.blocks).distinct())
        marked = dirty.join(inside, self.spec.blocks, "left")
        goes = F.lit(False)
        for d in range(self.spec.ndim):
            others = _all([F.lit(True), *(spans[i] for i in range(self.spec.ndim) if i != d)])
            goes = goes | ((F.col("axis") == d) & others & (F.col("slice") >= F.col(f"p{d}")) & (F.col("slice") < F.col(f"q{d}")))
        left = marked.where(~F.coalesce(goes, F.lit(False))).select(*self.spec.blocks, "axis", "slice")
        alive = left.groupBy(*self.spec.blocks).agg(F.count_distinct("axis").alias("axes")).where(F.col("axes") == self.spec.ndim)
        return left.join(alive.select(*self.spec.blocks), self.spec.blocks, "left_semi")

    def set_dirty(self, roi: Roi, dirty: bool = True) -> "TileArray":
        """Mark or clean the stored blocks' slices in a region; absent blocks are skipped."""
        if not dirty:
            return self._with(dirty=self._clean(roi, self.dirty))
        return self._with(dirty=self.dirty.unionByName(self._slices(self._inside(roi, self.blocks))).distinct())

    def needed_dirty(self, roi: Roi) -> DataFrame:
        """Blocks of a region that are absent, or dirty within it: some dirty slice in range on every axis."""
        inside = self._inside(roi, self._touched(roi))
        hit = self.dirty.join(inside, self.spec.blocks)
        in_range = reduce(lambda a, b: a | b, [(F.col("axis") == d) & (F.col("slice") >= F.col(f"p{d}")) & (F.col("slice") < F.col(f"q{d}")) for d in range(self.spec.ndim)])
        dirty = hit.where(in_range).groupBy(*self.spec.blocks).agg(F.count_distinct("axis").alias("axes")).where(F.col("axes") == self.spec.ndim)
        absent = inside.select(*self.spec.blocks).join(self.blocks, self.spec.blocks, "left_anti")
        return dirty.select(*self.spec.blocks).unionByName(absent)

    def is_dirty(self, roi: Roi) -> bool:
        return not self.needed_dirty(roi).isEmpty()

    def dirty_blocks(self, roi: Roi | None = None) -> DataFrame:
        """Stored blocks with any dirty slice, touching the region."""
        out = self.dirty.select(*self.spec.blocks).distinct()
        return out if roi is None else out.where(roi.block_range(self.spec.block_shape).contains("b"))

    def clean_blocks(self) -> DataFrame:
        return self.blocks.join(self.dirty.select(*self.spec.blocks).distinct(), self.spec.blocks, "left_anti")

    def dirty_slices(self, axis: int, at: int) -> DataFrame:
        """Stored blocks (b0..) whose slice `at` of an axis is dirty; `at` counts from the block's low corner."""
        return self.dirty.where((F.col("axis") == axis) & (F.col("slice") == at)).select(*self.spec.blocks)

    def set_slice_dirty(self, axis: int, at: int, dirty: bool = True) -> "TileArray":
        """Mark or clean one slice of an axis in every stored block that reaches that far."""
        here = (F.col("axis") == axis) & (F.col("slice") == at)
        rest = self.dirty.where(~here)
        if not dirty:
            return self._with(dirty=rest)
        marked = self._sides(self.blocks).where(F.col(f"n{axis}") > at).select(*self.spec.blocks, F.lit(axis).alias("axis"), F.lit(at).alias("slice"))
        return self._with(dirty=rest.unionByName(marked))

    def differences(self, other: "TileArray") -> DataFrame:
        """part ('cells', 'blocks', 'dirty') and n: rows of either side that the other lacks; cells of value 0 are as absent."""
        out = None
        for part in ("cells", "blocks", "dirty"):
            a, b = (getattr(x, part) for x in (self, other))
            if part == "cells":
                a, b = a.where(F.col("v") != 0), b.where(F.col("v") != 0)
            rows = a.withColumn("side_", F.lit(1)).unionByName(b.withColumn("side_", F.lit(-1)))
            if part == "cells":  # dealt out apart from what the cells come from, so that no task holds both
                rows = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *reversed(self.spec.coords))
            apart = rows.groupBy(*a.columns).agg(F.abs(F.sum("side_")).alias("n_"))  # equal rows of the two sides cancel out, each as often as it occurs
            n = apart.agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("n")).select(F.lit(part).alias("part"), "n")
            out = n if out is None else out.unionByName(n)
        return out

    def equals(self, other: "TileArray") -> bool:
        """Same block shape, non-zero cells, stored blocks and dirty slices."""
        return self.block_shape == other.block_shape and self.differences(other).where("n > 0").isEmpty()


def numpy_cells(spark: SparkSession, a: np.ndarray, spec: ArraySpec, origin: tuple[int, ...] | None = None) -> DataFrame:
    """All cells of a NumPy array as rows."""
    at = np.indices(a.shape).reshape(a.ndim, -1)
    origin = origin or (0,) * a.ndim
    table = {f"x{i}": (at[i] + o).astype(np.int32) for i, o in enumerate(origin)} | {"v": a.ravel().astype(np.float64 if a.dtype.kind == "f" else np.int64)}
    return spark.createDataFrame(pd.DataFrame(table)).withColumn("v", F.col("v").cast(spec.value_type))
