"""Registered queries of region algebra, sources, sinks, snapshots, sizes, meshes and slice-wise dirtiness, with their DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.region import Roi, grid, tiles
from ..operators import features as ft
from ..operators import mesh as ms
from ..operators.cache import BlockCache
from ..operators.segment import connected_components
from ..operators.store import TileArray, numpy_cells
from ..operators.transform import threshold
from ..sources import hdf5, knossos, snapshot
from . import fixtures as fx
from .lineage import shared_dir
from .queries import _C4, _E2, _FACES, _FG2, _MESH_EXTENT, _S3, _T3, _TL, _boxes, _by_label, _cc_sql, _object, _rounded, _wide, query


def _double(df):
    return _wide(df).withColumn("v", F.col("v").cast("double"))


# -- region algebra ------------------------------------------------------------------------------


@query(
    f"""WITH {_T3}, b AS (SELECT x0 // 32 AS k, min(x0) AS p0, min(x1) AS p1, min(x2) AS p2, max(x0) + 1 AS q0, max(x1) + 1 AS q1, max(x2) + 1 AS q2 FROM t3 GROUP BY k)
    SELECT k::BIGINT AS k, (q0 - p0)::BIGINT AS n0, (q1 - p1)::BIGINT AS n1, (q2 - p2)::BIGINT AS n2, ((q0 - p0) * (q1 - p1) * (q2 - p2))::BIGINT AS size,
    '(' || p0 || ', ' || p1 || ', ' || p2 || ') -- (' || q0 || ', ' || q1 || ', ' || q2 || ')' AS shown, true AS same FROM b"""
)
def roi_measures(spark, d):
    """Shape, size, print and equality of the bounding box of each strip of users."""
    low_high = [f(f"x{i}").alias(f"{n}{i}") for n, f in (("p", F.min), ("q", F.max)) for i in range(3)]
    strips = fx.t3(spark, d).groupBy(F.floor(F.col("x0") / 32).alias("k")).agg(*low_high)

    def measure(frames):
        for pdf in frames:
            rois = [Roi(tuple(int(r[f"p{i}"]) for i in range(3)), tuple(int(r[f"q{i}"]) + 1 for i in range(3))) for _, r in pdf.iterrows()]
            yield pdf[["k"]].assign(**{f"n{i}": [r.shape()[i] for r in rois] for i in range(3)}, size=[r.size() for r in rois], shown=[repr(r) for r in rois],
                                    same=[r == Roi(r.p, r.q) and r != r + (1, 0, 0) for r in rois])

    return _wide(strips.mapInPandas(measure, "k bigint, n0 bigint, n1 bigint, n2 bigint, size bigint, shown string, same boolean"))


@query(f"WITH {_E2} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, v::DOUBLE AS v FROM e2 WHERE x0 >= 107 AND x0 < 160 AND x1 >= 13 AND x1 < 41")
def roi_translate(spark, d):
    return _double(TileArray(fx.E2, fx.e2(spark, d)).read(Roi((100, 10), (153, 38)) + (7, 3)))


@query(f"WITH {_C4} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, x3::BIGINT AS x3, v FROM c4 WHERE x0 = 2 AND x1 >= 5 AND x1 < 90 AND x2 >= 3 AND x2 < 25 AND x3 >= 6 AND x3 < 20")
def roi_axis_edits(spark, d):
    """The 4-d region made from a 3-d one by putting an axis in, on, and away again."""
    roi = Roi((5, 3), (90, 25)).append_axis(6, 20).prepend_axis(2, 3).insert_axis_before(2, 0, 1).remove_axis(2)
    return _wide(TileArray(fx.C4, fx.c4(spark, d)).read(roi))


@query(f"WITH {_E2}, g AS (SELECT DISTINCT x0 // 50 AS b0, x1 // 16 AS b1 FROM e2) SELECT count(*)::BIGINT AS blocks, min(b0 * 50)::BIGINT AS low, max(b1 * 16 + 16)::BIGINT AS high FROM g")
def tiling_counts(spark, d):
    """Blocks of the tiling of the data's own box, which the data fills."""
    n = fx.e2(spark, d).agg(F.max("x0"), F.max("x1")).first()
    t = tiles(spark, Roi((0, 0), (int(n[0]) + 1, int(n[1]) + 1)), fx.E2.block_shape)
    return t.agg(F.count("*").alias("blocks"), F.min("p0").cast("bigint").alias("low"), F.max("q1").cast("bigint").alias("high"))


@query("SELECT * FROM (VALUES ('positive step', true), ('too few slices', true), ('no end', true), ('corners of different length', true), ('assignment', true)) t(refused, raised)")
def argument_checks(spark, d):
    a = TileArray(fx.E2, fx.e2(spark, d))

    def assign():
        a[0:1, 0:1] = None

    cases = {"positive step": lambda: a[0:10:2, 0:4], "too few slices": lambda: a[0:10], "no end": lambda: a[0:, 0:4], "corners of different length": lambda: Roi((0,), (1, 2)), "assignment": assign}
    rows = []
    for name, f in cases.items():
        try:
            f()
            rows.append((name, False))
        except (IndexError, ValueError, TypeError):
            rows.append((name, True))
    return spark.createDataFrame(rows, "refused string, raised boolean")


# -- snapshots, sources, sinks -------------------------------------------------------------------


@query(f"WITH {_S3} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, v FROM s3")
def snapshot_round_trip(spark, d):
    path = shared_dir(spark)
    snapshot.save(TileArray(fx.S3.with_(compressed=True), fx.s3(spark, d)), path)
    return _wide(snapshot.load(spark, path).cells)


@query(f"WITH {_S3} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, v FROM s3 WHERE x0 // 20 = 2 AND x1 // 3 = 1 AND x2 // 10 = 3")
def snapshot_block(spark, d):
    """One block read back, by its bounds."""
    path = shared_dir(spark)
    snapshot.save(TileArray(fx.S3, fx.s3(spark, d)), path)
    a = snapshot.load(spark, path)
    return _wide(a.read(a.block_bounds((2, 1, 3))))


@query(
    f"""WITH {_E2} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, v::DOUBLE AS v FROM e2 WHERE NOT (x0 >= 60 AND x0 < 70)
    UNION ALL SELECT x0, x1, (x1 + 1)::DOUBLE FROM e2 WHERE x0 >= 60 AND x0 < 70"""
)
def snapshot_partial_save(spark, d):
    """Only the partition that changed is written again."""
    path = shared_dir(spark)
    snapshot.save(TileArray(fx.E2, fx.e2(spark, d)), path)
    a = snapshot.load(spark, path)
    roi = Roi((60, 0), (70, 64))
    patch = a.read(roi).withColumn("v", (F.col("x1") + 1).cast("float"))
    snapshot.save_blocks(a.write(roi, patch), path, spark.range(1, 2).select(F.col("id").cast("int").alias("b0")))
    return _double(snapshot.load(spark, path).cells)


@query(f"WITH {_S3} SELECT (x0 - 20)::BIGINT AS x0, (x1 - 1)::BIGINT AS x1, (x2 - 4)::BIGINT AS x2, v FROM s3 WHERE x0 >= 25 AND x0 < 60 AND x1 >= 2 AND x1 < 6 AND x2 >= 9 AND x2 < 44")
def source_read_block(spark, d):
    """A block of a source restricted to a region, in the region's coordinates."""
    path = shared_dir(spark)
    snapshot.save(TileArray(fx.S3, fx.s3(spark, d)), path)
    source = snapshot.ParquetSource(spark, path)
    source.set_roi(Roi((20, 1, 4), (60, 6, 50)))
    return _wide(source.read_block(Roi((5, 1, 5), (90, 9, 40))))


@query("SELECT 40::BIGINT AS n0, 5::BIGINT AS n1, 46::BIGINT AS n2, (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey BETWEEN 20 AND 59 AND l_linenumber BETWEEN 2 AND 6 AND l_quantity BETWEEN 5 AND 50))::BIGINT AS n")
def source_shape(spark, d):
    path = shared_dir(spark)
    snapshot.save(TileArray(fx.S3, fx.s3(spark, d)), path)
    source = snapshot.ParquetSource(spark, path)
    source.set_roi(Roi((20, 1, 4), (60, 6, 50)))
    return source.load().agg(F.count("*").alias("n")).select(*(F.lit(n).cast("bigint").alias(f"n{i}") for i, n in enumerate(source.shape())), "n")


@query(
    f"""WITH {_E2} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, CASE WHEN x0 >= 45 AND x0 < 75 AND x1 >= 20 AND x1 < 40 THEN v::DOUBLE * 2 ELSE v::DOUBLE END AS v FROM e2 WHERE x0 < 100"""
)
def sink_blocks(spark, d):
    """A sink filled box by box; the last box overwrites part of the first ones."""
    path, cells = shared_dir(spark), fx.e2(spark, d)
    sink = snapshot.ParquetSink(path)
    sink.set_shape((100, 64))
    sink.set_block_shape((30, 16))
    at = lambda roi, k: cells.where(roi.contains()).select((F.col("x0") - roi.p[0]).alias("x0"), (F.col("x1") - roi.p[1]).alias("x1"), (F.col("v") * k).alias("v"))
    for roi, k in ((Roi((0, 0), (50, 64)), 1), (Roi((50, 0), (100, 64)), 1), (Roi((45, 20), (75, 40)), 2)):
        sink.write_block(roi, at(roi, k))
    return _double(snapshot.load(spark, path).cells)


@query(_cc_sql(_FG2, 2, "SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, label::BIGINT AS label FROM cc"))
def labels_round_trip(spark, d):
    path = shared_dir(spark)
    labels = connected_components(threshold(fx.e2(spark, d), 0.1), fx.E2.with_(dtype="uint8"))
    snapshot.write_labels(labels, path, fx.E2, compression=6)
    return _wide(snapshot.load(spark, path).cells.withColumnRenamed("v", "label"))


@query(f"{_TL} SELECT label::BIGINT AS label, count(*)::BIGINT AS count, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum, round(avg(x0), 6) AS c0, round(max(v), 6) AS q6 FROM c GROUP BY label")
def features_round_trip(spark, d):
    path, cells = shared_dir(spark), fx.t3(spark, d)
    snapshot.write_features(ft.region_features(cells, _boxes(cells).select("x0", "x1", "x2", "label"), 3), path)
    return _wide(_rounded(spark.read.parquet(path).select("label", "count", "minimum", "maximum", "c0", "q6")))


_NUMBERED = _FACES + """, q AS (SELECT cx, cy, cz, row_number() OVER (ORDER BY cx, cy, cz) - 1 AS vid FROM (SELECT DISTINCT cx, cy, cz FROM p)),
    n AS (SELECT fx, fy, fz, axis, max(vid) FILTER (i = 0)::BIGINT AS v0, max(vid) FILTER (i = 1)::BIGINT AS v1, max(vid) FILTER (i = 2)::BIGINT AS v2, max(vid) FILTER (i = 3)::BIGINT AS v3
      FROM p JOIN q USING (cx, cy, cz) GROUP BY fx, fy, fz, axis)"""


@query(_NUMBERED + " SELECT v0, v1, v2, v3 FROM n")
def mesh_numbered_faces(spark, d):
    return _wide(ms.extract_mesh(_object(spark, d), _MESH_EXTENT, 1)[2])


@query(
    _NUMBERED
    + """, e AS (SELECT v0 AS a, v1 AS b FROM n UNION ALL SELECT v1, v2 FROM n UNION ALL SELECT v2, v3 FROM n UNION ALL SELECT v3, v0 FROM n)
    SELECT 'verts' AS part, count(*)::BIGINT AS n, sum(cx + cy * 3 + cz * 7)::BIGINT AS digest FROM q
    UNION ALL SELECT 'lines', count(*), sum(a + 3 * b) FROM (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e) UNION ALL SELECT 'faces', count(*), sum(v0 + 2 * v1 + 3 * v2 + 5 * v3) FROM n"""
)
def mesh_round_trip(spark, d):
    """The mesh written and read again, as counts and weighted sums of its three parts."""
    path = shared_dir(spark)
    snapshot.write_mesh(ms.extract_mesh(_object(spark, d), _MESH_EXTENT, 1), path)
    verts, lines, faces = snapshot.read_mesh(spark, path)
    one = lambda name, df, e: df.agg(F.count("*").alias("n"), F.sum(F.expr(e)).cast("bigint").alias("digest")).select(F.lit(name).alias("part"), "n", "digest")
    return one("verts", verts, "x + y * 3 + z * 7").unionByName(one("lines", lines, "a + 3 * b")).unionByName(one("faces", faces, "v0 + 2 * v1 + 3 * v2 + 5 * v3"))


@query("SELECT x.range AS x, y.range AS y, z.range AS z, printf('x%04d/y%04d/z%04d/cube_x%04d_y%04d_z%04d.raw', x.range, y.range, z.range, x.range, y.range, z.range) AS path FROM range(0, 3) x, range(0, 2) y, range(9, 12) z")
def cube_paths(spark, d):
    rows = [(x, y, z, knossos.cube_path("cube", x, y, z)) for x in range(3) for y in range(2) for z in range(9, 12)]
    return spark.createDataFrame(rows, "x bigint, y bigint, z bigint, path string")


@query("SELECT * FROM (VALUES ('a/b.h5/g/d', 'a/b.h5', 'g/d'), ('b.hdf5/d', 'b.hdf5', 'd'), ('x/y', 'x', 'y')) t(descriptor, file, dataset)")
def dataset_descriptors(spark, d):
    return spark.createDataFrame([(s, *hdf5.split_descriptor(s)) for s in ("a/b.h5/g/d", "b.hdf5/d", "x/y")], "descriptor string, file string, dataset string")


@query(f"WITH {_E2} SELECT (x0 - 20)::BIGINT AS x0, (x1 - 5)::BIGINT AS x1, v::DOUBLE AS v FROM e2 WHERE x0 >= 20 AND x0 < 70 AND x1 >= 5 AND x1 < 60")
def numpy_round_trip(spark, d):
    """A region to NumPy and an array from it."""
    a = TileArray(fx.E2, fx.e2(spark, d)).to_numpy(Roi((20, 5), (70, 60)))
    return _double(TileArray.from_numpy(spark, fx.E2, a).cells)


@query(f"WITH {_S3}, n AS (SELECT x0, x1, x2, v FROM s3 WHERE x0 < 40 AND v <> 0) SELECT row_number() OVER (ORDER BY x0 // 20, x1 // 3, x2 // 10, x2, x1, x0) - 1 AS i, x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, v FROM n")
def nonzero_columns(spark, d):
    """The non-zero cells as arrays, in block then scan order."""
    first = fx.s3(spark, d).where("x0 < 40")
    x0, x1, x2, v = TileArray(fx.S3, first).set_coordinate_lists(True).nonzero_numpy()
    rows = [(i, int(a), int(b), int(c), float(w)) for i, (a, b, c, w) in enumerate(zip(x0, x1, x2, v))]
    return spark.createDataFrame(rows, "i bigint, x0 bigint, x1 bigint, x2 bigint, v double")


@query(f"WITH {_T3} SELECT on_ AS enabled, CASE WHEN on_ THEN (SELECT count(*) FROM t3 WHERE v <> 0) ELSE 0 END::BIGINT AS n FROM (VALUES (true), (false)) t(on_)")
def coordinate_lists(spark, d):
    a = TileArray(fx.T3, fx.t3(spark, d))
    count = lambda on: a.set_coordinate_lists(on).coordinate_lists().agg(F.count("*").alias("n")).select(F.lit(on).alias("enabled"), "n")
    return count(True).unionByName(count(False))


# -- equality, sizes, ranges ---------------------------------------------------------------------


@query(
    f"WITH {_T3}, m AS (SELECT count(*) AS n FROM t3 WHERE v <> 0 AND x0 // 32 = 1 AND x1 // 10 IN (0, 1) AND x2 // 8 = 0),"
    " b AS (SELECT count(*) AS n FROM (SELECT DISTINCT x0 // 32, x1 // 10, x2 // 8 FROM t3 WHERE x0 // 32 = 1 AND x1 // 10 IN (0, 1) AND x2 // 8 = 0))"
    " SELECT 'cells' AS part, n::BIGINT AS n FROM m UNION ALL SELECT 'blocks', n FROM b UNION ALL SELECT 'dirty', 0"
)
def array_differences(spark, d):
    """What an array and a copy with two blocks deleted differ in."""
    a = TileArray(fx.T3, fx.t3(spark, d))
    return a.differences(a.delete(Roi((40, 5, 1), (41, 11, 2))))


@query("SELECT 'itself' AS other, true AS equal UNION ALL SELECT 'one cell written', false UNION ALL SELECT 'one block dirty', false UNION ALL SELECT 'written twice', true")
def array_equality(spark, d):
    a = TileArray(fx.E2, fx.e2(spark, d))
    b = a.write_point((60, 43), 42.0)
    rows = [("itself", a.equals(a)), ("one cell written", a.equals(b)), ("one block dirty", a.equals(a.set_dirty(Roi((0, 0), (1, 1))))), ("written twice", b.equals(b.write_point((60, 43), 42.0)))]
    return spark.createDataFrame(rows, "other string, equal boolean")


@query(f"WITH {_S3}, b AS (SELECT DISTINCT x0 // 20, x1 // 3, x2 // 10 FROM s3) SELECT count(*)::BIGINT AS blocks, 0::BIGINT AS compressed_blocks, count(*)::BIGINT * 4800 AS uncompressed_bytes, count(*)::BIGINT * 4800 AS size_bytes, 1.0::DOUBLE AS ratio FROM b")
def sizes_uncompressed(spark, d):
    return TileArray(fx.S3, fx.s3(spark, d)).set_compression(True).set_compression(False).sizes()


@query(f"WITH {_S3}, b AS (SELECT DISTINCT x0 // 20, x1 // 3, x2 // 10 FROM s3) SELECT count(*)::BIGINT AS blocks, count(*)::BIGINT AS compressed_blocks, count(*)::BIGINT * 4800 AS uncompressed_bytes, true AS smaller, true AS whole_items FROM b")
def sizes_compressed(spark, d):
    """Accounting of compressed blocks; snappy's own figure has no SQL, its bounds have."""
    a = TileArray(fx.S3, fx.s3(spark, d)).set_compression(True)
    s = a.sizes().select("blocks", "compressed_blocks", "uncompressed_bytes", ((F.col("size_bytes") < F.col("uncompressed_bytes")) & (F.col("ratio") < 0.9)).alias("smaller"), (F.col("size_bytes") % 8 == 0).alias("whole_items"))
    return s


@query(
    f"""WITH {_S3}, w AS (SELECT x0, x1, x2, v FROM s3 WHERE NOT (x0 >= 15 AND x0 < 45 AND x1 < 3 AND x2 < 10) UNION ALL SELECT a.range, b.range, c.range, 200000.0 + a.range FROM range(15, 45) a, range(0, 3) b, range(0, 10) c),
    r AS (SELECT x0 // 20 AS b0, x1 // 3 AS b1, x2 // 10 AS b2, count(*) AS n, min(v) AS lo, max(v) AS hi FROM w GROUP BY ALL)
    SELECT min(CASE WHEN n < 600 THEN least(lo, 0) ELSE lo END)::DOUBLE AS vmin, max(hi)::DOUBLE AS vmax, count(*)::BIGINT AS blocks FROM r"""
)
def tracked_minmax(spark, d):
    """Ranges kept per block through a write, which measures the touched blocks alone."""
    roi = Roi((15, 0, 0), (45, 3, 10))
    patch = grid(spark, roi).withColumn("v", 200000.0 + F.col("x0"))
    a = TileArray(fx.S3, fx.s3(spark, d)).set_minmax(True).write(roi, patch)
    return a.minmax().select(F.col("vmin").cast("double").alias("vmin"), F.col("vmax").cast("double").alias("vmax"), F.lit(a.num_blocks()).cast("bigint").alias("blocks"))


# -- region statistics ---------------------------------------------------------------------------


@query(_TL + ", m AS (SELECT max(label) AS top FROM c) SELECT r.range AS label, n.count::BIGINT AS count, n.hi0::BIGINT AS hi0 FROM m, range(0, top + 1) r LEFT JOIN (SELECT label, count(*) AS count, max(x0) AS hi0 FROM c WHERE label % 3 > 0 GROUP BY label) n ON n.label = r.range WHERE r.range <= (SELECT max(label) FROM c WHERE label % 3 > 0)")
def region_dense_rows(spark, d):
    """A row for every label up to the largest, also those without cells."""
    cells = fx.t3(spark, d)
    out = ft.region_features(cells, _boxes(cells).where("label % 3 > 0").select("x0", "x1", "x2", "label"), 3, dense=True)
    return _wide(out.select("label", "count", "hi0"))


_AXES2 = f"""WITH {_E2}, c AS (SELECT e.label, x0, x1, v::DOUBLE + 1 AS w FROM e2 JOIN embeddings e ON e.vec_id = e2.x0 WHERE e.label > 0)"""


@query(
    _AXES2
    + """, s AS (SELECT label, var_pop(x0) AS a, var_pop(x1) AS b, covar_pop(x0, x1) AS o FROM c GROUP BY label),
    l AS (SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + o * o) AS big FROM s), u AS (SELECT label, big - b AS p, o AS q FROM l),
    n AS (SELECT label, p / sqrt(p * p + q * q) AS p, q / sqrt(p * p + q * q) AS q FROM u)
    SELECT label::BIGINT AS label, round(CASE WHEN greatest(abs(p), abs(q)) = abs(p) THEN sign(p) ELSE sign(q) END * p, 5) + 0.0 AS a0, round(CASE WHEN greatest(abs(p), abs(q)) = abs(p) THEN sign(p) ELSE sign(q) END * q, 5) + 0.0 AS a1 FROM n"""
)
def region_axes_2d(spark, d):
    """The first principal axis, its largest component positive."""
    out = ft.principal_axes(ft.covariance(_by_label(spark, d), 2), 2)
    return _wide(_rounded(out.select("label", *(F.col("axes")[0][i].alias(f"a{i}") for i in range(2))), 5)).withColumns({f"a{i}": F.col(f"a{i}") + F.lit(0.0) for i in range(2)})


@query(
    _AXES2
    + """, m AS (SELECT label, sum(w * x0) / sum(w) AS m0, sum(w * x1) / sum(w) AS m1 FROM c GROUP BY label),
    s AS (SELECT label, sum(w * (x0 - m0) ** 2) / sum(w) AS a, sum(w * (x1 - m1) ** 2) / sum(w) AS b, sum(w * (x0 - m0) * (x1 - m1)) / sum(w) AS o FROM c JOIN m USING (label) GROUP BY label)
    SELECT label::BIGINT AS label, round(sqrt((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + o * o)), 5) AS r0, round(sqrt((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + o * o)), 5) AS r1 FROM s"""
)
def region_weighted_radii(spark, d):
    cells = _by_label(spark, d).withColumn("v", F.col("v").cast("double") + 1)
    out = ft.principal_axes(ft.covariance(cells, 2, weighted=True), 2)
    return _wide(_rounded(out.select("label", F.col("radii")[0].alias("r0"), F.col("radii")[1].alias("r1")), 5))


@query(
    _TL
    + """, s AS (SELECT label, var_pop(x0) AS a, var_pop(x1) AS b, var_pop(x2) AS c, covar_pop(x0, x1) AS d, covar_pop(x0, x2) AS e, covar_pop(x1, x2) AS f FROM c GROUP BY label),
    t AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM s),
    r AS (SELECT *, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3) AS r FROM t),
    g AS (SELECT *, acos(greatest(-1, least(1, r))) / 3 AS g FROM r), v AS (SELECT label, q + 2 * p * cos(g) AS hi, q + 2 * p * cos(g + 2 * pi() / 3) AS lo, 3 * q AS tr FROM g)
    SELECT label::BIGINT AS label, round(sqrt(hi), 5) AS r0, round(sqrt(tr - hi - lo), 5) AS r1, round(sqrt(lo), 5) AS r2 FROM v"""
)
def region_radii_3d(spark, d):
    """Radii of 3-d regions; the SQL solves the characteristic cubic."""
    out = ft.principal_axes(ft.covariance(_boxes(fx.t3(spark, d)), 3), 3)
    return _wide(_rounded(out.select("label", *(F.col("radii")[i].alias(f"r{i}") for i in range(3))), 5))


# -- dirty slices and cache ----------------------------------------------------------------------


@query(f"WITH {_E2}, b AS (SELECT DISTINCT x0 // 50 AS b0, x1 // 16 AS b1 FROM e2) SELECT b0::BIGINT AS b0, b1::BIGINT AS b1 FROM b")
def slice_marked_dirty(spark, d):
    """One slice of the second axis marked in every block, then another cleaned: the first is still dirty."""
    a = TileArray(fx.E2, fx.e2(spark, d)).set_slice_dirty(1, 7).set_slice_dirty(1, 9).set_slice_dirty(1, 9, False)
    return _wide(a.dirty_slices(1, 7).unionByName(a.dirty_slices(1, 9)))


@query(f"WITH {_E2}, b AS (SELECT DISTINCT x0 // 50 AS b0, x1 // 16 AS b1 FROM e2) SELECT b0::BIGINT AS b0, b1::BIGINT AS b1, (CASE WHEN b0 IN (0, 2) THEN 20 ELSE 50 END)::BIGINT AS n0, 16::BIGINT AS n1 FROM b WHERE b0 IN (0, 1, 2)")
def dirty_by_slices(spark, d):
    """Marked through slices: rows 30 to 119 of all columns, as counts of dirty slices by block and axis."""
    a = TileArray(fx.E2, fx.e2(spark, d)).set_dirty(Roi.of_slices((slice(30, 120), slice(0, 64)), 2))
    return _wide(a.dirty.groupBy("b0", "b1").agg(F.count_if(F.col("axis") == 0).alias("n0"), F.count_if(F.col("axis") == 1).alias("n1")))


@query(
    f"""WITH {_S3}, g AS (SELECT a.range AS x0, b.range AS x1, c.range AS x2 FROM range(0, 30) a, range(0, 7) b, range(0, 20) c)
    SELECT g.x0, g.x1, g.x2, CASE WHEN g.x0 >= 5 AND g.x0 < 9 AND g.x1 = 2 AND g.x2 < 4 THEN 7.5 ELSE coalesce(s3.v, 0) END AS v FROM g LEFT JOIN s3 USING (x0, x1, x2)"""
)
def cache_put(spark, d):
    """Cells pushed into a cache are read back and not fetched over."""
    cache = BlockCache(lambda: fx.s3(spark, d), fx.S3)
    cache.refresh(Roi((0, 0, 0), (30, 7, 20)))
    roi = Roi((5, 2, 0), (9, 3, 4))
    cache.put(roi, grid(spark, roi).withColumn("v", F.lit(7.5)))
    return _wide(cache.refresh(Roi((0, 0, 0), (30, 7, 20))))


@query("SELECT 'new' AS state, 0::BIGINT AS blocks, 0::BIGINT AS used_bytes, 0.0::DOUBLE AS dirty_share UNION ALL SELECT 'filled', 12, 57600, 0 UNION ALL SELECT 'invalidated', 12, 57600, 0.25 UNION ALL SELECT 'freed', 6, 28800, 0.5")
def cache_report(spark, d):
    """A cache before its first read, after it, after an invalidation, and after clean blocks were freed."""
    cache, out = BlockCache(lambda: fx.s3(spark, d), fx.S3), []
    state = lambda name: out.append((name, *cache.report().select("blocks", "used_bytes", "dirty_share").first()))
    state("new")
    cache.refresh(Roi((0, 0, 0), (40, 6, 30)))
    state("filled")
    cache.invalidate(Roi((0, 0, 0), (20, 3, 30)))
    state("invalidated")
    cache.free(Roi((20, 0, 0), (40, 6, 30)))
    state("freed")
    return spark.createDataFrame(out, "state string, blocks bigint, used_bytes bigint, dirty_share double")


@query(f"WITH {_S3} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, v FROM s3 WHERE NOT (x0 < 8 AND x1 < 2 AND x2 < 5) UNION ALL SELECT a.range, b.range, c.range, (a.range * 100 + b.range * 10 + c.range)::DOUBLE FROM range(0, 8) a, range(0, 2) b, range(0, 5) c")
def write_numpy(spark, d):
    """A NumPy block written into an array."""
    a = np.fromfunction(lambda i, j, k: i * 100 + j * 10 + k, (8, 2, 5))
    return _wide(TileArray(fx.S3, fx.s3(spark, d)).write(Roi((0, 0, 0), a.shape), numpy_cells(spark, a, fx.S3)).cells)
