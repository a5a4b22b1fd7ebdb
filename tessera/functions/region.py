"""Regions of interest, tilings and the column expressions they compile to."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roi:
    """Half-open box [p, q)."""

    p: tuple[int, ...]
    q: tuple[int, ...]

    def __post_init__(self):
        if len(self.p) != len(self.q):
            raise ValueError("p and q differ in length")

    @staticmethod
    def empty(ndim: int) -> "Roi":
        """The all-zero box, which also stands for 'unset'."""
        return Roi((0,) * ndim, (0,) * ndim)

    @staticmethod
    def of_slices(slices, ndim: int) -> "Roi":
        """From `ndim` slices with explicit ends, as in a[0:4, 2:5]."""
        slices = slices if isinstance(slices, tuple) else (slices,)
        if len(slices) != ndim or any(not isinstance(s, slice) or s.step is not None or s.start is None or s.stop is None for s in slices):
            raise IndexError(f"need {ndim} slices with start and stop and without step")
        return Roi(tuple(int(s.start) for s in slices), tuple(int(s.stop) for s in slices))

    def __add__(self, shift) -> "Roi":
        return Roi(tuple(a + d for a, d in zip(self.p, shift)), tuple(a + d for a, d in zip(self.q, shift)))

    def __repr__(self) -> str:
        return f"{self.p} -- {self.q}"

    @property
    def ndim(self) -> int:
        return len(self.p)

    def intersect(self, other: "Roi") -> "Roi | None":
        """The common box; None unless it is positive on every axis (touching boxes don't intersect)."""
        p = tuple(map(max, self.p, other.p))
        q = tuple(map(min, self.q, other.q))
        return Roi(p, q) if all(a < b for a, b in zip(p, q)) else None

    def shape(self) -> tuple[int, ...]:
        return tuple(b - a for a, b in zip(self.p, self.q))

    def size(self) -> int:
        return prod(self.shape())

    def remove_axis(self, axis: int) -> "Roi":
        return Roi(self.p[:axis] + self.p[axis + 1 :], self.q[:axis] + self.q[axis + 1 :])

    def insert_axis_before(self, axis: int, start: int, stop: int) -> "Roi":
        return Roi((*self.p[:axis], start, *self.p[axis:]), (*self.q[:axis], stop, *self.q[axis:]))

    def append_axis(self, start: int, stop: int) -> "Roi":
        return self.insert_axis_before(self.ndim, start, stop)

    def prepend_axis(self, start: int, stop: int) -> "Roi":
        return self.insert_axis_before(0, start, stop)

    def contains(self, prefix: str = "x") -> Column:
        """Predicate on the coordinate columns."""
        terms = [(F.col(f"{prefix}{i}") >= a) & (F.col(f"{prefix}{i}") < b) for i, (a, b) in enumerate(zip(self.p, self.q))]
        return reduce(lambda a, b: a & b, terms)

    def block_range(self, block_shape) -> "Roi":
        """Box of the coordinates of the blocks it touches; empty for an empty region."""
        if any(a >= b for a, b in zip(self.p, self.q)):
            return Roi(self.p, self.p)
        return Roi(tuple(a // s for a, s in zip(self.p, block_shape)), tuple((b - 1) // s + 1 for b, s in zip(self.q, block_shape)))

    def cells(self, block_shape) -> Column:
        """Predicate on cells that also names the blocks, so partition pruning sees it."""
        return self.block_range(block_shape).contains("b") & self.contains("x")


def grid(spark: SparkSession, box: Roi, prefix: str = "x") -> DataFrame:
    """Every integer point of a box, one column an axis, generated on the executors."""
    names = [f"{prefix}{i}" for i in range(box.ndim)]
    shape = box.shape()
    if min(shape) <= 0:
        return spark.range(0).select(*(F.col("id").cast("int").alias(n) for n in names))
    out, step = [], prod(shape)
    for name, start, side in zip(names, box.p, shape):
        step //= side
        out.append((F.floor(F.col("id") / step) % side + start).cast("int").alias(name))
    return spark.range(prod(shape)).select(*out)


def tiles(spark: SparkSession, box: Roi, block_shape, overlap=None) -> DataFrame:
    """Tiles of a box: b0.., p0.., q0..; clipped to it, `overlap` cells wider on the high side."""
    overlap = overlap or (0,) * box.ndim
    out = grid(spark, box.block_range(block_shape), "b")
    bounds = {}
    for i, s in enumerate(block_shape):
        bounds[f"p{i}"] = F.greatest(F.col(f"b{i}") * s, F.lit(box.p[i])).cast("int")
        bounds[f"q{i}"] = F.least((F.col(f"b{i}") + 1) * s + overlap[i], F.lit(box.q[i])).cast("int")
    return out.withColumns(bounds)


def with_blocks(df: DataFrame, block_shape) -> DataFrame:
    """Add the block coordinate of each cell."""
    return df.withColumns({f"b{i}": F.floor(F.col(f"x{i}") / s).cast("int") for i, s in enumerate(block_shape)})


def with_halo(df: DataFrame, block_shape, overlap) -> DataFrame:
    """One row per (cell, tile that holds it when tiles overlap by `overlap` on the high side)."""
    out = with_blocks(df, block_shape)
    for i, (s, o) in enumerate(zip(block_shape, overlap)):
        b = F.col(f"b{i}")
        reach = F.array(*(F.when((F.col(f"x{i}") - (b - k + 1) * s < o) & (b - k >= 0), b - k) for k in range(1, -(-o // s) + 1))) if o else F.array()
        out = out.withColumn(f"b{i}", F.explode(F.array_compact(F.concat(F.array(b), reach))))
    return out


def intersections(a: DataFrame, b: DataFrame, ndim: int, cell: tuple[int, ...]) -> DataFrame:
    """Pairs of boxes (id, p0.., q0..) that overlap, with the common box: an interval join bucketed on a grid of `cell`.

    A pair meets in every bucket both touch and is kept in the one that holds its common low corner.
    """

    def bucketed(df: DataFrame, side: str) -> DataFrame:
        out = df.select(F.col("id").alias(f"{side}_id"), *(F.col(f"{k}{i}").alias(f"{side}{k}{i}") for k in "pq" for i in range(ndim)))
        for i, s in enumerate(cell):
            low, high = F.floor(F.col(f"{side}p{i}") / s), F.floor((F.col(f"{side}q{i}") - 1) / s)
            out = out.where(F.col(f"{side}p{i}") < F.col(f"{side}q{i}")).withColumn(f"g{i}", F.explode(F.sequence(low, high)))
        return out

    pairs = bucketed(a, "a").join(bucketed(b, "b"), [f"g{i}" for i in range(ndim)])
    low = [F.greatest(f"ap{i}", f"bp{i}") for i in range(ndim)]
    high = [F.least(f"aq{i}", f"bq{i}") for i in range(ndim)]
    keep = reduce(lambda x, y: x & y, [(lo < hi) & (F.floor(lo / s) == F.col(f"g{i}")) for i, (lo, hi, s) in enumerate(zip(low, high, cell))])
    return pairs.where(keep).select("a_id", "b_id", *(c.alias(f"p{i}") for i, c in enumerate(low)), *(c.alias(f"q{i}") for i, c in enumerate(high)))
