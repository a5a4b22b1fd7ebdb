"""Raw cube directories: knossos.conf and files of 128**3 uint8 voxels, axis 0 fastest."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.region import Roi

SIDE = 128


def read_config(spark: SparkSession, path: str) -> dict:
    """experiment name, scale and boundary (x, y, z), magnification."""
    out: dict = {}
    for (line,) in spark.read.text(f"{path}/knossos.conf").toLocalIterator():  # a few lines
        m = re.match(r'([a-z][a-z ]*?)\s+(?:"([^"]*)"|([-+0-9.eE]+))\s*;?$', line.strip())
        if m:
            out[m[1]] = m[2] if m[2] is not None else m[3]
    axes = lambda key, kind: tuple(kind(out[f"{key} {a}"]) for a in "xyz")
    return {"name": out["experiment name"], "scale": axes("scale", float), "boundary": axes("boundary", int), "magnification": int(out.get("magnification", 1))}


def cube_path(name: str, x: int, y: int, z: int) -> str:
    """Relative path of a cube."""
    return f"x{x:04d}/y{y:04d}/z{z:04d}/{name}_x{x:04d}_y{y:04d}_z{z:04d}.raw"


def read_cubes(spark: SparkSession, path: str, roi: Roi | None = None) -> DataFrame:
    """x0, x1, x2, v of the cubes' voxels within the boundary and the region; the cube's path prunes whole files."""
    boundary = read_config(spark, path)["boundary"]
    box = Roi((0, 0, 0), boundary)
    box = box if roi is None else box.intersect(roi)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.raw").load(path)
    for i, axis in enumerate("xyz"):
        files = files.withColumn(f"b{i}", F.regexp_extract("path", rf"_{axis}(\d{{4}})[_.]", 1).cast("int"))
    if box is None:
        return spark.createDataFrame([], "x0 int, x1 int, x2 int, v smallint")
    files = files.where(box.block_range((SIDE,) * 3).contains("b")).select("b0", "b1", "b2", "length", "content")

    def decode(frames):
        for pdf in frames:
            for row in pdf.itertuples():
                if row.length != SIDE**3:
                    raise ValueError(f"cube {row.b0, row.b1, row.b2} has {row.length} bytes, not {SIDE**3}")
                cube = np.frombuffer(row.content, dtype=np.uint8).reshape((SIDE,) * 3, order="F")
                start = np.array([row.b0, row.b1, row.b2]) * SIDE
                lo, hi = np.maximum(box.p - start, 0), np.minimum(box.q - start, SIDE)
                for z in range(lo[2], hi[2], 16):  # bounded batches of rows
                    part = cube[lo[0] : hi[0], lo[1] : hi[1], z : min(z + 16, hi[2])]
                    at = np.indices(part.shape).reshape(3, -1) + (start + [lo[0], lo[1], z])[:, None]
                    yield pd.DataFrame({f"x{i}": at[i].astype(np.int32) for i in range(3)} | {"v": part.ravel().astype(np.int16)})

    return files.mapInPandas(decode, "x0 int, x1 int, x2 int, v smallint")


class KnossosSource:
    """A cube directory as a source; with a region set, coordinates are relative to its low corner."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.roi = spark, path, None
        self.config = read_config(spark, path)

    def set_roi(self, roi: Roi) -> None:
        self.roi = None if roi == Roi.empty(roi.ndim) else roi

    def shape(self) -> tuple[int, ...]:
        """The boundary, cut to the region."""
        whole = Roi((0, 0, 0), self.config["boundary"])
        common = whole if self.roi is None else whole.intersect(self.roi)
        return common.shape() if common else (0, 0, 0)

    def read_block(self, roi: Roi) -> DataFrame:
        """Voxels of a box in this source's coordinates, clipped to its region."""
        low = self.roi.p if self.roi else (0, 0, 0)
        box = roi + low
        box = box if self.roi is None else box.intersect(self.roi) or Roi(low, low)
        return read_cubes(self.spark, self.path, box).withColumns({f"x{i}": (F.col(f"x{i}") - a).cast("int") for i, a in enumerate(low)})
