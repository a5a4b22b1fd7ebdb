"""Connected components of equal non-zero cells (2 * ndim neighbours), labelled 1..K by smallest cell."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.region import with_blocks
from ..plans.lineage import materialize
from ..plans.spec import ArraySpec
from .graph import components
from .numbering import consecutive


def linear_id(spec: ArraySpec):
    """Row-major index of a cell in the extent."""
    if spec.extent is None:
        raise ValueError("connected components need an extent")
    out = F.lit(0).cast("bigint")
    for i, n in enumerate(spec.extent):
        out = out * n + F.col(f"x{i}")
    return out


def _local_roots(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each cell's component within one block; 0-valued cells keep their own."""
    top = np.iinfo(np.int64).max
    root = np.where(values != 0, ids, top)
    while True:
        new = root.copy()
        for axis in range(values.ndim):
            lo = tuple(slice(None, -1) if k == axis else slice(None) for k in range(values.ndim))
            hi = tuple(slice(1, None) if k == axis else slice(None) for k in range(values.ndim))
            same = (values[lo] == values[hi]) & (values[lo] != 0)
            new[lo] = np.where(same, np.minimum(new[lo], new[hi]), new[lo])
            new[hi] = np.where(same, np.minimum(new[lo], new[hi]), new[hi])
        flat = new[values != 0]
        place = np.searchsorted(ids.ravel(), np.minimum(flat, ids.max()))
        new[values != 0] = np.minimum(flat, new.ravel()[place])  # pointer jumping inside the block
        if np.array_equal(new, root):
            return root
        root = new


def connected_components(cells: DataFrame, spec: ArraySpec) -> DataFrame:
    """x0.., label of every non-zero cell; background has no row.

    Blocks label themselves, equal cells across block faces give edges between local roots, components of
    that reduced edge list give global roots, and distinct roots are numbered in ascending order.
    """
    fg = with_blocks(cells.where(F.col("v") != 0), spec.block_shape).withColumn("gid", linear_id(spec))
    shape, coords, extent = spec.block_shape, spec.coords, spec.extent
    ints = ", ".join(f"{c} int" for c in coords)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        at = tuple(pdf[c].to_numpy() % s for c, s in zip(coords, shape))
        values = np.zeros(shape, dtype=np.int64)
        values[at] = pd.factorize(pdf["v"])[0] + 1  # equal values, equal codes; exact for every type
        start = [int(pdf[c].iloc[0]) // s * s for c, s in zip(coords, shape)]
        ids = np.zeros(shape, dtype=np.int64)
        for k, (o, n) in enumerate(zip(start, extent)):
            side = (o + np.arange(shape[k])).reshape([-1 if j == k else 1 for j in range(len(shape))])
            ids = ids * n + side
        order = np.sort(ids.ravel())
        if not np.array_equal(order, ids.ravel()):  # a block that reaches past the extent: use ranks of its own
            own = np.arange(ids.size, dtype=np.int64).reshape(shape)
            first = _local_roots(values, own)
            root = ids.ravel()[np.where(values != 0, first, 0)]
        else:
            root = _local_roots(values, ids)
        return pdf[[*coords, "v"]].assign(root=root[at])

    labelled = materialize(fg.groupBy(*spec.blocks).applyInPandas(local, f"{ints}, v {dict(cells.dtypes)['v']}, root bigint"))
    edges = None
    for k, s in enumerate(shape):
        low = labelled.where(F.col(f"x{k}") % s == s - 1).withColumn(f"x{k}", F.col(f"x{k}") + 1).select(*coords, "v", F.col("root").alias("a"))
        high = labelled.where(F.col(f"x{k}") % s == 0).select(*coords, F.col("v").alias("w"), F.col("root").alias("b"))
        met = low.join(high, coords).where(F.col("v") == F.col("w")).select("a", "b")
        edges = met if edges is None else edges.unionByName(met)
    merged = components(edges.distinct()).withColumnRenamed("root", "top")
    rooted = labelled.join(merged, F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("top", "root"))
    numbers = consecutive(rooted.select("root").distinct(), ["root"], "label", start=1)
    return rooted.join(numbers, "root").select(*coords, "label")
