"""Cell-wise operators: threshold, channel selection, decimation, relocation to a region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.region import Roi


def threshold(cells: DataFrame, t: float, if_lower: int = 0, if_higher: int = 1) -> DataFrame:
    """v := if_higher where v > t, else if_lower; NaN counts as lower, t is taken in v's own type."""
    kind = cells.schema["v"].dataType
    high = (F.col("v") > F.lit(t).cast(kind)) & ~F.isnan(F.col("v").cast("double"))
    return cells.withColumn("v", F.when(high, F.lit(if_higher)).otherwise(F.lit(if_lower)).cast("smallint"))


def drop_axis(cells: DataFrame, dim: int, ndim: int) -> DataFrame:
    """Remove a coordinate column; the axes after it move up."""
    keep = [i for i in range(ndim) if i != dim]
    return cells.select(*(F.col(f"x{i}").alias(f"x{k}") for k, i in enumerate(keep)), "v")


def select_channel(cells: DataFrame, dim: int, channel: int, ndim: int) -> DataFrame:
    """Fix an axis and drop it."""
    return drop_axis(cells.where(F.col(f"x{dim}") == channel), dim, ndim)


def resample(cells: DataFrame, factor: float, ndim: int) -> DataFrame:
    """Decimation by the integer stride 1 / factor, phase 0; no interpolation."""
    if not 0 < factor <= 1 or abs(1 / factor - round(1 / factor)) > 1e-9:
        raise ValueError("factor must be 1 / n for an integer n")
    s = round(1 / factor)
    for i in range(ndim):
        cells = cells.where(F.col(f"x{i}") % s == 0)
    return cells.withColumns({f"x{i}": F.floor(F.col(f"x{i}") / s).cast("int") for i in range(ndim)})


def resampled_extent(extent: tuple[int, ...], factor: float) -> tuple[int, ...]:
    """ceil(factor * side) for each axis."""
    s = round(1 / factor)
    return tuple(-(-n // s) for n in extent)


def within(cells: DataFrame, roi: Roi) -> DataFrame:
    """The cells of a region, with coordinates relative to its low corner."""
    return cells.where(roi.contains()).withColumns({f"x{i}": (F.col(f"x{i}") - a).cast("int") for i, a in enumerate(roi.p)})
