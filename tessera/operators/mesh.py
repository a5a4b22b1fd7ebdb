"""Boundary quads of a labelled object: faces, unique edges and vertices, a slab of the first axis at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialize

# Corner order around a face, by normal axis, on the two other axes in ascending order.
CORNERS = {0: ((0, 0), (1, 0), (1, 1), (0, 1)), 1: ((0, 0), (0, 1), (1, 1), (1, 0)), 2: ((0, 0), (1, 0), (1, 1), (0, 1))}

#: Voxels of a slab at most, unless one layer has more.
SLAB_VOXELS = 1 << 16


class _Slab:
    """The object's voxels of layers low - 1 to high, as sorted keys ordered by (x, y, z), and the boundary they make.

    A face is named by its lower voxel and axis; it is a boundary exactly if one of its two voxels is of the object.
    A slab owns the faces, and the edges and corners by their lower ends, of layers low to high - 1; the layer on
    either side is what it needs to tell them, and the corners of layer high as well.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, low: int, high: int, extent, closed: bool):
        self.low, self.high = low, high
        self.base = (low - 2, int(y.min()) - 1, int(z.min()) - 1)
        n1, n2 = int(y.max()) - self.base[1] + 3, int(z.max()) - self.base[2] + 3
        if (high - low + 5) * n1 * n2 >= 1 << 62:
            raise ValueError("the object's box is too large")
        self.strides = (n1 * n2, n2, 1)
        own = np.unique(((x - self.base[0]) * n1 + (y - self.base[1])) * n2 + (z - self.base[2]))
        self.faces = []
        for axis, s in enumerate(self.strides):
            lower = np.setxor1d(own, own - s, assume_unique=True)
            at = self.points(lower)
            keep = (at[0] >= low - 1) & (at[0] <= (high - 1 if axis == 0 else high))
            if not closed:
                for c, n in zip(at, extent):
                    keep &= (c >= 0) & (c < n - 1)
            self.faces.append(lower[keep])

    def points(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, y, z of keys."""
        rest = keys % self.strides[0]
        return keys // self.strides[0] + self.base[0], rest // self.strides[1] + self.base[1], rest % self.strides[1] + self.base[2]

    def owned(self, keys: np.ndarray) -> np.ndarray:
        x = keys // self.strides[0] + self.base[0]
        return (x >= self.low) & (x < self.high)

    def corners(self, axis: int, faces: np.ndarray) -> list[np.ndarray]:
        """Keys of the four corners of faces of an axis."""
        a, b = [self.strides[i] for i in range(3) if i != axis]
        return [faces + self.strides[axis] + k * a + l * b for k, l in CORNERS[axis]]

    def verts(self) -> np.ndarray:
        """Corners in order: the owned ones, then those of layer high."""
        found = np.unique(np.concatenate([c for axis, f in enumerate(self.faces) for c in self.corners(axis, f)]))
        x = found // self.strides[0] + self.base[0]
        return found[(x >= self.low) & (x <= self.high)]

    def own_faces(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Axes and corner keys of the owned faces."""
        mine = [f[self.owned(f)] for f in self.faces]
        at = [self.corners(axis, f) for axis, f in enumerate(mine)]
        return np.repeat(np.arange(3), [len(f) for f in mine]), [np.concatenate([c[i] for c in at]) for i in range(4)]

    def own_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Both ends of the owned edges, the lower first."""
        found = []
        for axis, f in enumerate(self.faces):
            at = self.corners(axis, f)
            for i in range(4):
                a, b = np.minimum(at[i], at[(i + 1) % 4]), np.maximum(at[i], at[(i + 1) % 4])
                along = self.strides.index(int(b[0] - a[0])) if len(a) else 0
                found.append(a[self.owned(a)] * 3 + along)
        edges = np.unique(np.concatenate(found))
        return edges // 3, edges // 3 + np.array(self.strides)[edges % 3]


def _voxels(labels: DataFrame, extent: tuple[int, int, int], label: int) -> tuple[DataFrame, int]:
    """slab, x0.., of the object's voxels, those next to a slab included, and the layers of a slab."""
    width = max(1, SLAB_VOXELS // max(1, extent[1] * extent[2]))
    own = labels.where(F.col("label") == label).select(*(F.col(f"x{i}").cast("int").alias(f"x{i}") for i in range(3))).dropna()
    x = F.col("x0").cast("bigint")
    return own.select(F.explode(F.sequence(F.floor((x - 1) / width), F.floor((x + 1) / width))).alias("slab"), "x0", "x1", "x2"), width


def _by_slab(voxels: DataFrame, width: int, extent, closed: bool, schema: str, columns: Callable[[_Slab], list[np.ndarray]]) -> DataFrame:
    """Rows of the columns a slab gives, in one task a slab."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    fields = pa.schema([(n, kinds[c.split()[1]]) for n, c in zip(names, schema.split(", "))])

    def run(key, table):
        at = [table.column(f"x{i}").to_numpy().astype(np.int64) for i in range(3)]
        low = key[0].as_py() * width
        got = columns(_Slab(*at, low, low + width, extent, closed))
        if names[0] == "slab":
            got = [np.full(len(got[0]), key[0].as_py()), *got]
        return pa.Table.from_arrays([pa.array(c).cast(f.type) for c, f in zip(got, fields)], schema=fields)

    return voxels.groupBy("slab").applyInArrow(run, schema)


def mesh_faces(labels: DataFrame, extent: tuple[int, int, int], label: int, closed: bool = False) -> DataFrame:
    """axis and corner coordinates c0..c3 (structs x, y, z) of every face between the object and something else.

    Without `closed`, faces whose lower voxel lies on the high border (or outside) are left out, so objects
    touching it stay open.
    """

    def columns(s: _Slab) -> list[np.ndarray]:
        axes, at = s.own_faces()
        return [axes, *(c for k in at for c in s.points(k))]

    schema = ", ".join(["axis int", *(f"{c}{i} int" for i in range(4) for c in "xyz")])
    flat = _by_slab(*_voxels(labels, extent, label), extent, closed, schema, columns)
    return flat.select("axis", *(F.struct(*(F.col(f"{c}{i}").alias(c) for c in "xyz")).alias(f"c{i}") for i in range(4)))


def mesh_lines(labels: DataFrame, extent: tuple[int, int, int], label: int, closed: bool = False) -> DataFrame:
    """Distinct undirected edges (a, b; structs x, y, z) of consecutive corners, a before b."""
    schema = ", ".join(f"{e}{c} int" for e in "ab" for c in "xyz")
    flat = _by_slab(*_voxels(labels, extent, label), extent, closed, schema, lambda s: [c for k in s.own_lines() for c in s.points(k)])
    return flat.select(*(F.struct(*(F.col(f"{e}{c}").alias(c) for c in "xyz")).alias(e) for e in "ab"))


def extract_mesh(labels: DataFrame, extent: tuple[int, int, int], label: int, closed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """verts (vid, x, y, z), lines (a, b), faces (v0..v3); vertex ids 0.. by (x, y, z).

    Slabs are in the order of the ids, so an id is its rank in the slab and the corners of the slabs before;
    the corners of layer `high` are the first of the next slab.
    """
    voxels, width = _voxels(labels, extent, label)
    voxels = materialize(voxels)

    def owned_verts(s: _Slab) -> np.ndarray:
        found = s.verts()
        return found[s.owned(found)]

    def verts(s: _Slab) -> list[np.ndarray]:
        found = owned_verts(s)
        return [np.arange(len(found)), *s.points(found)]

    def ranks(s: _Slab, ends) -> list[np.ndarray]:
        found = s.verts()
        return [np.searchsorted(found, e) for e in ends]

    sizes = _by_slab(voxels, width, extent, closed, "slab bigint, n_ bigint", lambda s: [np.array([len(owned_verts(s))])])
    before = Window.orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)  # one row per slab
    offsets = materialize(sizes.select("slab", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_")))

    def numbered(ids: list[str], rest: list[str], columns: Callable[[_Slab], list[np.ndarray]]) -> DataFrame:
        schema = ", ".join(["slab bigint", *(f"{c} int" for c in ids + rest)])
        rows = _by_slab(voxels, width, extent, closed, schema, columns).join(offsets, "slab")
        return rows.select(*((F.col(c) + F.col("offset_")).alias(c) for c in ids), *rest)

    return (
        numbered(["vid"], ["x", "y", "z"], verts),
        numbered(["a", "b"], [], lambda s: ranks(s, s.own_lines())),
        numbered(["v0", "v1", "v2", "v3"], [], lambda s: ranks(s, s.own_faces()[1])),
    )
