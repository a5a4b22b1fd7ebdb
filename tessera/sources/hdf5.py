"""HDF5 datasets, if h5py is there: chunks are read on the executors from a path they all see."""

from __future__ import annotations

import importlib.util

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.region import Roi, tiles


def available() -> bool:
    return importlib.util.find_spec("h5py") is not None


def split_descriptor(text: str) -> tuple[str, str]:
    """'file.h5/group/dataset' to file and dataset, cut after the file's suffix or else at the last '/'."""
    for suffix in (".h5/", ".hdf5/"):
        if suffix in text:
            at = text.index(suffix) + len(suffix) - 1
            return text[:at], text[at + 1 :]
    file, _, name = text.rpartition("/")
    return file, name


def read_dataset(spark: SparkSession, file: str, dataset: str, chunk: tuple[int, ...], roi: Roi | None = None) -> DataFrame:
    """Cells of a dataset, in coordinates relative to the region's low corner."""
    if not available():
        raise RuntimeError("h5py is not installed")
    import h5py

    with h5py.File(file, "r") as f:
        shape, kind = f[dataset].shape, f[dataset].dtype.kind
    box = Roi((0,) * len(shape), shape)
    box = box if roi is None else box.intersect(roi) or Roi(box.p, box.p)
    n = len(shape)

    def read(frames):
        import h5py

        with h5py.File(file, "r") as f:
            for pdf in frames:
                for row in pdf.itertuples():
                    p, q = [getattr(row, f"p{i}") for i in range(n)], [getattr(row, f"q{i}") for i in range(n)]
                    a = f[dataset][tuple(slice(x, y) for x, y in zip(p, q))]
                    at = np.indices(a.shape).reshape(n, -1)
                    yield pd.DataFrame({f"x{i}": (at[i] + p[i] - box.p[i]).astype(np.int32) for i in range(n)} | {"v": a.ravel()})

    ints = ", ".join(f"x{i} int" for i in range(n))
    return tiles(spark, box, chunk).mapInPandas(read, f"{ints}, v {'double' if kind == 'f' else 'bigint'}")


class Hdf5Source:
    """A dataset as a source; with a region set, coordinates are relative to its low corner."""

    def __init__(self, spark: SparkSession, file: str, dataset: str, chunk: tuple[int, ...]):
        self.spark, self.file, self.dataset, self.chunk, self.roi = spark, file, dataset, tuple(chunk), None

    def set_roi(self, roi: Roi) -> None:
        self.roi = None if roi == Roi.empty(roi.ndim) else roi

    def shape(self) -> tuple[int, ...]:
        """The dataset's shape, cut to the region."""
        import h5py

        with h5py.File(self.file, "r") as f:
            whole = Roi((0,) * len(f[self.dataset].shape), tuple(f[self.dataset].shape))
        common = whole if self.roi is None else whole.intersect(self.roi)
        return common.shape() if common else (0,) * whole.ndim

    def read_block(self, roi: Roi) -> DataFrame:
        """Cells of a box in this source's coordinates, clipped to its region."""
        low = self.roi.p if self.roi else (0,) * roi.ndim
        box = roi + low
        box = box if self.roi is None else box.intersect(self.roi) or Roi(low, low)
        start = [max(0, a) for a in box.p]
        out = read_dataset(self.spark, self.file, self.dataset, self.chunk, box)
        return out.withColumns({f"x{i}": (F.col(f"x{i}") + (a - b)).cast("int") for i, (a, b) in enumerate(zip(start, low))})


class Hdf5Sink:
    """Writes boxes into a dataset made at the first write; chunks are the block shape, by default the whole shape.

    An HDF5 file has one writer, so boxes pass through the driver, a block at a time.
    """

    def __init__(self, file: str, dataset: str, dtype: str = "float32", compression: int = 1):
        if not 0 <= compression <= 9:
            raise ValueError("compression is 0 (none) to 9")
        if not available():
            raise RuntimeError("h5py is not installed")
        self.file, self.dataset, self.dtype, self.compression = file, dataset, dtype, compression
        self.shape: tuple[int, ...] | None = None
        self.block_shape: tuple[int, ...] | None = None
        self._made = False

    def set_shape(self, shape) -> None:
        self.shape = tuple(shape)

    def set_block_shape(self, shape) -> None:
        self.block_shape = tuple(shape)

    def write_block(self, roi: Roi, cells: DataFrame) -> None:
        """Replace a box by cells in coordinates relative to its low corner; absent ones are 0, a later write wins."""
        import h5py

        if self.shape is None:
            raise ValueError("set_shape first")
        rows = cells.where(Roi((0,) * roi.ndim, roi.shape()).contains()).toPandas()  # one box
        block = np.zeros(roi.shape(), dtype=self.dtype)
        block[tuple(rows[f"x{i}"].to_numpy() for i in range(roi.ndim))] = rows["v"].to_numpy()
        with h5py.File(self.file, "a") as f:
            if not self._made:
                extra = {"compression": "gzip", "compression_opts": self.compression} if self.compression else {}
                f.create_dataset(self.dataset, shape=self.shape, dtype=self.dtype, chunks=self.block_shape or self.shape, **extra)
                self._made = True
            f[self.dataset][tuple(slice(a, b) for a, b in zip(roi.p, roi.q))] = block

    def save(self, cells: DataFrame) -> None:
        """All cells of the shape, a block at a time."""
        if self.shape is None:
            raise ValueError("set_shape first")
        n = len(self.shape)
        for row in tiles(cells.sparkSession, Roi((0,) * n, self.shape), self.block_shape or self.shape).toLocalIterator():
            box = Roi(tuple(row[f"p{i}"] for i in range(n)), tuple(row[f"q{i}"] for i in range(n)))
            own = cells.where(box.contains()).withColumns({f"x{i}": (F.col(f"x{i}") - a).cast("int") for i, a in enumerate(box.p)})
            self.write_block(box, own)
