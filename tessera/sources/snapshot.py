"""Array snapshots as Parquet: spec/v=<n> naming the layers of each version, and per layer cells/, blocks/, dirty/, ranges/, held/.

A save never overwrites what a plan may be reading: it writes a layer of its own and then one more spec, and readers take the
highest. A layer holds whole partitions of the first block axis (listed in held/, absent in a layer that holds all); of two
layers that hold a partition the later counts. All access goes through Spark, so any file system it knows will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.region import Roi, with_blocks
from ..operators.store import TileArray
from ..plans.spec import ArraySpec

#: Layers after which a partial save writes everything anew.
MAX_LAYERS = 8


def _current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest spec; (0, {}) where nothing is saved."""
    try:
        rows = spark.read.schema("value string, v int").text(f"{path}/spec")
    except AnalysisException:
        return 0, {}
    newest = rows.orderBy(F.col("v").desc()).first()
    return (newest["v"], json.loads(newest["value"])) if newest else (0, {})


def _point(spark: SparkSession, path: str, version: int, spec: ArraySpec, layers: list[str]) -> None:
    """One more spec; its folder shows up whole or not at all."""
    text = json.dumps(spec.as_dict() | {"layers": layers, "format": 2})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/spec/v={version}")


def _write(array: TileArray, folder: str, held: DataFrame | None) -> None:
    spec = array.spec
    codec = "snappy" if spec.compressed else "uncompressed"
    own = (lambda df: df) if held is None else (lambda df: df.join(held, "b0", "left_semi"))
    cells = own(array.block_cells()).withColumns({c: F.col(c).cast("int") for c in spec.coords})
    cells = cells.repartitionByRange(*spec.blocks).sortWithinPartitions(*spec.blocks, *spec.coords)  # a first-axis block may span tasks
    cells.write.partitionBy("b0").option("compression", codec).parquet(f"{folder}/cells")
    own(array.blocks).write.parquet(f"{folder}/blocks")
    own(array.dirty).write.parquet(f"{folder}/dirty")
    if spec.minmax:
        own(array._ranges).write.parquet(f"{folder}/ranges")
    if held is not None:
        held.write.parquet(f"{folder}/held")


def save(array: TileArray, path: str) -> None:
    """Write a new version of one layer; cells are partitioned by the first block axis and sorted by block within files."""
    version, _ = _current(array.spark, path)
    layer = uuid.uuid4().hex
    _write(array, f"{path}/{layer}", None)
    _point(array.spark, path, version + 1, array.spec, [layer])


def save_blocks(array: TileArray, path: str, changed: DataFrame) -> None:
    """Write only the partitions (b0) of `changed` anew, as one more layer; everything if there are many layers or none."""
    version, now = _current(array.spark, path)
    if not now or len(now["layers"]) >= MAX_LAYERS:
        return save(array, path)
    layer = uuid.uuid4().hex
    _write(array, f"{path}/{layer}", changed.select(F.col("b0").cast("int").alias("b0")).distinct())
    _point(array.spark, path, version + 1, array.spec, [*now["layers"], layer])


def _layered(spark: SparkSession, path: str, layers: list[str], part: str, schema: str) -> DataFrame:
    """A part of the array: of each layer the partitions no later layer holds."""
    out = None
    later: list[DataFrame] = []
    for k, layer in reversed(list(enumerate(layers))):
        rows = spark.read.schema(schema).parquet(f"{path}/{layer}/{part}")
        for held in later:
            rows = rows.join(held, "b0", "left_anti")  # the changed partitions' numbers
        out = rows if out is None else rows.unionByName(out)
        if k:
            later.append(spark.read.schema("b0 int").parquet(f"{path}/{layer}/held"))
    return out


def load(spark: SparkSession, path: str) -> TileArray:
    """The current version; reads of a region prune partitions by block and row groups by cell."""
    _, held = _current(spark, path)
    if not held:
        raise FileNotFoundError(path)
    layers, _ = held.pop("layers"), held.pop("format")
    spec = ArraySpec.from_dict(held)
    ints = ", ".join(f"{b} int" for b in spec.blocks)
    at = ", ".join(f"{c} int" for c in [*spec.coords])
    rest = "".join(f", {b} int" for b in spec.blocks[1:])
    cells = _layered(spark, path, layers, "cells", f"{at}, v {spec.value_type}{rest}, b0 int")
    ranges = _layered(spark, path, layers, "ranges", f"{ints}, vmin {spec.value_type}, vmax {spec.value_type}") if spec.minmax else None
    return TileArray(spec, cells, _layered(spark, path, layers, "blocks", ints), _layered(spark, path, layers, "dirty", f"{ints}, axis int, slice int"), ranges)


def read_region(spark: SparkSession, path: str, roi: Roi) -> DataFrame:
    """Cells of a region straight from storage."""
    return load(spark, path).read(roi)


class ParquetSource:
    """A source of cells with an optional region; coordinates are then relative to its low corner."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.roi = spark, path, None

    def set_roi(self, roi: Roi) -> None:
        self.roi = None if roi == Roi.empty(roi.ndim) else roi

    def load(self) -> DataFrame:
        if self.roi is None:
            return load(self.spark, self.path).cells
        return self._moved(self.roi)

    def _moved(self, roi: Roi) -> DataFrame:
        low = self.roi.p if self.roi else (0,) * roi.ndim
        return read_region(self.spark, self.path, roi).withColumns({f"x{i}": (F.col(f"x{i}") - a).cast("int") for i, a in enumerate(low)})

    def shape(self) -> tuple[int, ...]:
        spec = load(self.spark, self.path).spec
        if spec.extent is None:
            raise ValueError("the array has no extent")
        whole = Roi((0,) * spec.ndim, spec.extent)
        if self.roi is None:
            return whole.shape()
        common = whole.intersect(self.roi)
        return common.shape() if common else (0,) * spec.ndim

    def read_block(self, roi: Roi) -> DataFrame:
        """Cells of a box in this source's coordinates, clipped to its region."""
        if self.roi is None:
            return self._moved(roi)
        common = (roi + self.roi.p).intersect(self.roi)
        return self._moved(common or Roi(self.roi.p, self.roi.p))


class ParquetSink:
    """Writes cells as a snapshot, whole or a box at a time; the block shape defaults to the whole shape."""

    def __init__(self, path: str, name: str = "array", dtype: str = "float32", compression: int = 1):
        if not 0 <= compression <= 9:
            raise ValueError("compression is 0 (none) to 9")
        self.path, self.name, self.dtype, self.compression = path, name, dtype, compression
        self.shape: tuple[int, ...] | None = None
        self.block_shape: tuple[int, ...] | None = None
        self._started = False

    def set_shape(self, shape) -> None:
        self.shape = tuple(shape)

    def set_block_shape(self, shape) -> None:
        self.block_shape = tuple(shape)

    def _spec(self) -> ArraySpec:
        if self.shape is None:
            raise ValueError("set_shape first")
        return ArraySpec(self.name, len(self.shape), self.dtype, self.block_shape or self.shape, self.shape, compressed=self.compression > 0)

    def save(self, cells: DataFrame) -> None:
        save(TileArray(self._spec(), cells), self.path)

    def write_block(self, roi: Roi, cells: DataFrame) -> None:
        """Replace a box by cells in coordinates relative to its low corner; a later write wins. The first one starts the array."""
        spec, spark = self._spec(), cells.sparkSession
        at = cells.withColumns({f"x{i}": (F.col(f"x{i}") + a).cast("int") for i, a in enumerate(roi.p)})
        if not self._started:
            save(TileArray.empty(spark, spec), self.path)
            self._started = True
        changed = roi.block_range(spec.block_shape)
        b0 = spark.range(changed.p[0], changed.q[0]).select(F.col("id").cast("int").alias("b0"))
        save_blocks(load(spark, self.path).write(roi, at), self.path, b0)


def write_labels(labels: DataFrame, path: str, spec: ArraySpec, compression: int = 1) -> None:
    """A label volume (x0.., label) as an int64 snapshot; the level is 1 to 9."""
    if not 1 <= compression <= 9:
        raise ValueError("compression is 1 to 9")
    save(TileArray(spec.with_(dtype="int64", compressed=True), labels.withColumnRenamed("label", "v")), path)


def write_features(features: DataFrame, path: str) -> None:
    """The wide table of region statistics, one row a label."""
    features.write.parquet(path)


def write_mesh(mesh: tuple[DataFrame, DataFrame, DataFrame], path: str) -> None:
    """verts, lines and faces of a mesh."""
    for name, df in zip(("verts", "lines", "faces"), mesh):
        df.write.parquet(f"{path}/{name}")


def read_mesh(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """verts, lines and faces as written."""
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("verts", "lines", "faces"))
