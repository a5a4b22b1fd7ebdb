"""The array engine against NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.region import Roi, grid, intersections, tiles
from tessera.operators import features as ft
from tessera.operators.cache import BlockCache
from tessera.operators import mesh
from tessera.operators.mesh import extract_mesh, mesh_faces
from tessera.operators.segment import connected_components
from tessera.operators.store import TileArray, numpy_cells
from tessera.operators.transform import resample, select_channel, threshold
from tessera.plans.spec import ArraySpec
from tessera.sources import hdf5, knossos, snapshot
from tessera.streaming.patches import ingest


def spec(dtype, block, extent, **flags):
    return ArraySpec("a", len(block), dtype, tuple(block), tuple(extent), **flags)


def test_roi_algebra():
    assert Roi((1, 1), (10, 20)).intersect(Roi((5, 6), (30, 40))) == Roi((5, 6), (10, 20))
    assert Roi((0,), (5,)).intersect(Roi((5,), (9,))) is None
    r = Roi((1, 2), (3, 5))
    assert r.shape() == (2, 3) and r.size() == 6 and r + (1, 1) == Roi((2, 3), (4, 6))
    assert r.append_axis(7, 9).remove_axis(2) == r and r.prepend_axis(0, 1).p == (0, 1, 2) and r.insert_axis_before(1, 8, 9).p == (1, 8, 2)
    with pytest.raises(IndexError):
        Roi.of_slices((slice(0, 3),), 2)


def test_tiles_and_empty_region(spark):
    assert tiles(spark, Roi((0, 0), (100, 200)), (50, 25)).count() == 16
    assert tiles(spark, Roi((3, 3), (3, 9)), (5, 5)).count() == 0


def test_interval_join(spark):
    rng = random.Random(3)
    box = lambda: [(k, x, y, x + rng.randint(1, 30), y + rng.randint(1, 30)) for k in range(40) for x, y in [(rng.randint(-40, 60), rng.randint(0, 90))]]
    a, b = box(), box()
    cols = "id int, p0 int, p1 int, q0 int, q1 int"
    got = {(r.a_id, r.b_id) for r in intersections(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), 2, (16, 16)).collect()}
    want = {(x[0], y[0]) for x in a for y in b if Roi(x[1:3], x[3:]).intersect(Roi(y[1:3], y[3:]))}
    assert got == want


def test_random_reads_and_writes(spark):
    rng = np.random.default_rng(1)
    dense = rng.integers(0, 255, (23, 17, 11)).astype(np.uint8)
    s = spec("uint8", (7, 5, 4), dense.shape)
    a = TileArray.from_numpy(spark, s, dense)
    for _ in range(3):
        p = [int(rng.integers(0, n - 1)) for n in dense.shape]
        q = [int(rng.integers(x + 1, n + 1)) for x, n in zip(p, dense.shape)]
        roi = Roi(tuple(p), tuple(q))
        assert np.array_equal(a.to_numpy(roi), dense[tuple(map(slice, p, q))])
        new = rng.integers(0, 3, roi.shape()).astype(np.uint8)
        dense[tuple(map(slice, p, q))] = new
        a = a.write(roi, numpy_cells(spark, new, s, tuple(p)))
    assert np.array_equal(a.to_numpy(Roi((0, 0, 0), dense.shape)), dense)
    assert a.at(100, 100, 100).first().v == 0


def test_masked_write_delete_and_relabel(spark):
    s = spec("uint32", (2, 3), (6, 6))
    a = TileArray.from_numpy(spark, s, np.ones((6, 6), dtype=np.uint32))
    patch = np.array([[0, 42], [100, 7]], dtype=np.uint32)
    b = a.write_nonzero(Roi((1, 1), (3, 3)), numpy_cells(spark, patch, s, (1, 1)), 100)
    assert b.to_numpy(Roi((1, 1), (3, 3))).tolist() == [[1, 42], [0, 7]]
    c = b.delete(Roi((0, 0), (1, 1)))
    assert c.num_blocks() == 5 and c.to_numpy(Roi((0, 0), (2, 3))).sum() == 0
    lut = spark.createDataFrame([(0, 5), (1, 6), (2, 9)], "k int, r int")
    assert b.relabel(lut).to_numpy(Roi((1, 1), (3, 3))).tolist() == [[6, 5], [5, 6]]


def test_directory_minmax_compression_and_empty_blocks(spark):
    s = spec("uint32", (20, 30), (100, 75))
    a = TileArray.from_numpy(spark, s, np.full((100, 75), 42, dtype=np.uint32))
    assert tuple(a.minmax().first()) == (0, 42)  # edge blocks are padded with zeros
    assert a.average_compression_ratio() == 1.0 and a.set_compression(True).average_compression_ratio() < 0.9
    zero = TileArray.empty(spark, s.with_(delete_empty=True)).write(Roi((0, 0), (40, 30)), numpy_cells(spark, np.zeros((40, 30), np.uint32), s))
    assert zero.num_blocks() == 0
    assert np.isnan(zero.average_compression_ratio())


def test_dirty_rules(spark):
    s = spec("uint8", (10, 10), (100, 100))
    a = TileArray.from_numpy(spark, s, np.ones((100, 100), dtype=np.uint8))
    assert a.dirty_blocks().count() == 0
    d = a.set_dirty(Roi((3, 3), (4, 4)))
    assert d.dirty_blocks().count() == 1 and d.is_dirty(Roi((0, 0), (10, 10))) and not d.is_dirty(Roi((5, 5), (6, 6)))
    assert d.set_dirty(Roi((0, 0), (10, 10)), False).dirty_blocks().count() == 0
    assert a.is_dirty(Roi((0, 0), (101, 1))) is False  # outside the extent there is nothing to need


def test_threshold_channel_resample(spark):
    rng = np.random.default_rng(2)
    v = rng.random((6, 8, 2)).astype(np.float32)
    v[0, 0, 1] = np.nan
    s = spec("float32", (4, 4, 1), v.shape)
    cells = numpy_cells(spark, v, s)
    plane = select_channel(cells, 2, 1, 3)
    got = {(r.x0, r.x1): r.v for r in threshold(plane, 0.5, 3, 9).collect()}
    assert got == {(i, j): (9 if v[i, j, 1] > np.float32(0.5) else 3) for i in range(6) for j in range(8)}
    half = {(r.x0, r.x1): r.v for r in resample(plane.where("not isnan(v)"), 0.5, 2).collect()}
    assert half == {(i // 2, j // 2): v[i, j, 1] for i in range(0, 6, 2) for j in range(0, 8, 2) if not np.isnan(v[i, j, 1])}
    with pytest.raises(ValueError):
        resample(plane, 1.5, 2)


def _brute_components(a):
    label, n = np.zeros(a.shape, int), 0
    for start in np.argwhere(a != 0):
        start = tuple(start)
        if label[start]:
            continue
        n += 1
        stack, label[start] = [start], n
        while stack:
            x = stack.pop()
            for k in range(a.ndim):
                for d in (-1, 1):
                    y = tuple(c + d * (i == k) for i, c in enumerate(x))
                    if all(0 <= c < m for c, m in zip(y, a.shape)) and a[y] == a[x] and not label[y]:
                        label[y] = n
                        stack.append(y)
    return label


@pytest.mark.parametrize("kind", ["random", "snake", "checker"])
def test_components(spark, kind):
    if kind == "random":
        a = np.random.default_rng(5).integers(0, 3, (13, 11)).astype(np.uint8)
    elif kind == "snake":
        a = np.zeros((12, 12), np.uint8)
        a[::2] = 1
        a[1::4, -1] = 1
        a[3::4, 0] = 1
    else:
        a = (np.indices((9, 9)).sum(axis=0) % 2).astype(np.uint8)
    s = spec("uint8", (4, 3), a.shape)
    got = np.zeros(a.shape, int)
    for r in connected_components(numpy_cells(spark, a, s), s).collect():
        got[r.x0, r.x1] = r.label
    assert np.array_equal(got, _brute_components(a))


def test_features(spark):
    rng = np.random.default_rng(6)
    v, lab = rng.random((8, 9, 10)), np.zeros((8, 9, 10), np.int64)
    lab[1:4, 2:5, 3:6], lab[5:8, 1:9, 2:4], lab[0, 0, 0] = 1, 2, 3
    s = spec("float64", (4, 4, 4), v.shape)
    labels = numpy_cells(spark, lab, s.with_(dtype="int64")).withColumnRenamed("v", "label")
    rows = {r.label: r for r in ft.region_features(numpy_cells(spark, v, s), labels, 3, dense=True).collect()}
    assert sorted(rows) == [0, 1, 2, 3] and rows[0]["count"] is None
    for k in (1, 2, 3):
        x, at = v[lab == k], np.argwhere(lab == k)
        r = rows[k]
        assert r["count"] == len(x) and np.isclose(r["mean"], x.mean()) and np.isclose(r["variance"], x.var())
        assert np.allclose([r["c0"], r["c1"], r["c2"]], at.mean(axis=0))
        assert np.allclose(r["radii"], np.sqrt(np.maximum(np.linalg.eigvalsh(np.cov(at.T, bias=True))[::-1], 0)) if len(x) > 1 else 0)
        assert r["histogram"] == np.histogram(x, 50, (0, v.max()))[0].tolist() and sum(r["histogram"]) == len(x)
        assert r["q0"] == x.min() and r["q6"] == x.max() and abs(r["q3"] - np.median(x)) < 0.1
        assert tuple(at[x.argmax()]) == (r["mx0"], r["mx1"], r["mx2"])


def test_mesh(spark):
    lab = np.zeros((6, 6, 6), np.int64)
    lab[2:4, 2:4, 2:4] = 1
    s = spec("int64", (3, 3, 3), lab.shape)
    cells = numpy_cells(spark, lab, s).withColumnRenamed("v", "label").where("label = 1")
    verts, lines, faces = extract_mesh(cells, lab.shape, 1)
    n = verts.count(), lines.count(), faces.count()
    assert n == (26, 48, 24) and n[0] - n[1] + n[2] == 2
    whole = grid(spark, Roi((0, 0, 0), (2, 2, 2))).withColumn("label", F.lit(1))
    assert mesh_faces(whole, (2, 2, 2), 1).count() == 0 and mesh_faces(whole, (2, 2, 2), 1, closed=True).count() == 24


def test_cache_fetches_only_what_it_must(spark):
    s = spec("int64", (4, 4), (8, 8))
    state = {"v": 1}
    cache = BlockCache(lambda: grid(spark, Roi((0, 0), (8, 8))).withColumn("v", F.lit(state["v"]).cast("bigint")), s)
    total = lambda roi: cache.refresh(roi).agg(F.sum("v")).first()[0]
    assert total(Roi((0, 0), (4, 4))) == 16
    state["v"] = 5
    assert total(Roi((0, 0), (4, 4))) == 16  # nobody said it changed
    cache.freeze()
    cache.invalidate(Roi((0, 0), (1, 1)))
    assert total(Roi((0, 0), (8, 8))) == 16  # frozen: unseen cells read 0
    cache.unfreeze()
    assert total(Roi((0, 0), (8, 8))) == 5 * 64
    assert cache.clean_blocks().count() == 4 and cache.report().first()["blocks"] == 4


def test_snapshot_round_trip_and_pruning(spark, tmp_path):
    s = spec("float32", (4, 4), (12, 12), compressed=True)
    a = TileArray.from_numpy(spark, s, np.arange(144, dtype=np.float32).reshape(12, 12)).set_dirty(Roi((0, 0), (2, 2)))
    path = f"file://{tmp_path}/array"
    snapshot.save(a, path)
    b = snapshot.load(spark, path)
    assert b.spec == s and b.equals(a) and b.dirty.count() == a.dirty.count()
    snapshot.save(b.write_point((1, 1), 7.0), path)  # a new version beside the one being read
    assert snapshot.load(spark, path).at(1, 1).first().v == 7.0
    source = snapshot.ParquetSource(spark, path)
    source.set_roi(Roi((5, 5), (20, 9)))
    assert source.shape() == (7, 4) and source.load().count() == 28
    plan = snapshot.read_region(spark, path, Roi((5, 5), (7, 7)))._jdf.queryExecution().toString()
    assert "b0" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_stream_into_snapshot(spark, tmp_path):
    s = spec("int64", (4, 4), (8, 8))
    path, feed = f"file://{tmp_path}/array", f"{tmp_path}/feed"
    snapshot.save(TileArray.empty(spark, s), path)
    spark.createDataFrame([(1, 1, 5, 1), (1, 1, 6, 2), (7, 7, 9, 1)], "x0 int, x1 int, v bigint, ts int").write.parquet(feed)
    stream = spark.readStream.schema("x0 int, x1 int, v bigint, ts int").parquet(feed)
    ingest(stream, path, f"{tmp_path}/progress").awaitTermination()
    got = snapshot.load(spark, path)
    assert sorted((r.x0, r.x1, r.v) for r in got.cells.collect()) == [(1, 1, 6), (7, 7, 9)] and got.num_blocks() == 2


def test_knossos_cubes(spark, tmp_path):
    conf = 'experiment name "cube";\nscale x 1.0;\nscale y 1.0;\nscale z 2.0;\nboundary x 200;\nboundary y 128;\nboundary z 128;\nmagnification 1;\n'
    (tmp_path / "knossos.conf").write_text(conf)
    whole = (np.indices((256, 128, 128)).sum(axis=0) % 251).astype(np.uint8)
    for k in (0, 1):
        f = tmp_path / knossos.cube_path("cube", k, 0, 0)
        f.parent.mkdir(parents=True)
        f.write_bytes(whole[128 * k : 128 * k + 128].tobytes(order="F"))
    rows = knossos.read_cubes(spark, str(tmp_path), Roi((120, 3, 5), (136, 6, 9))).collect()
    assert {(r.x0, r.x1, r.x2): r.v for r in rows} == {(x, y, z): whole[x, y, z] for x in range(120, 136) for y in range(3, 6) for z in range(5, 9)}


def test_hdf5_descriptor():
    assert hdf5.split_descriptor("a/b.h5/g/d") == ("a/b.h5", "g/d") and hdf5.split_descriptor("x/y") == ("x", "y")


def _brute_mesh(lab, extent, closed):
    """Faces, edges and corners of label 1, voxel by voxel."""
    own = {tuple(map(int, c)) for c in np.argwhere(lab == 1)}
    faces, lines = set(), set()
    for c in own | {tuple(v - (i == k) for i, v in enumerate(c)) for c in own for k in range(3)}:
        for axis in range(3):
            after = tuple(v + (i == axis) for i, v in enumerate(c))
            if ((c in own) == (after in own)) or not (closed or all(0 <= v < n - 1 for v, n in zip(c, extent))):
                continue
            a, b = [i for i in range(3) if i != axis]
            at = [tuple(after[i] + (k if i == a else l if i == b else 0) for i in range(3)) for k, l in mesh.CORNERS[axis]]
            faces.add((axis, *at))
            lines |= {tuple(sorted((at[i], at[(i + 1) % 4]))) for i in range(4)}
    return faces, lines, sorted({p for f in faces for p in f[1:]})


@pytest.mark.parametrize("layers, closed", [(1, False), (1, True), (3, False), (4, True), (100, True)])
def test_mesh_by_slabs(spark, monkeypatch, layers, closed):
    """Slabs of any width give the brute-force mesh, also if a voxel is listed twice or has no place."""
    extent = (9, 5, 6)
    monkeypatch.setattr(mesh, "SLAB_VOXELS", layers * 30, raising=False)
    lab = np.random.default_rng(layers).integers(0, 3, extent)
    lab[4:6] = 0  # empty layers
    cells = numpy_cells(spark, lab, spec("int64", (3, 3, 3), extent)).withColumnRenamed("v", "label")
    cells = cells.unionByName(cells.where("x1 < 2")).unionByName(cells.limit(3).withColumn("x0", F.lit(None).cast("int")))
    faces, lines, corners = _brute_mesh(lab, extent, closed)
    got = [(r["axis"], *(tuple(r[f"c{i}"]) for i in range(4))) for r in mesh_faces(cells, extent, 1, closed).collect()]
    assert len(got) == len(faces) and set(got) == faces
    got = [(tuple(r["a"]), tuple(r["b"])) for r in mesh.mesh_lines(cells, extent, 1, closed).collect()]
    assert len(got) == len(lines) and set(got) == lines
    verts, edges, quads = extract_mesh(cells, extent, 1, closed)
    assert sorted(map(tuple, verts.collect())) == [(i, *c) for i, c in enumerate(corners)]
    at = {c: i for i, c in enumerate(corners)}
    assert sorted(map(tuple, edges.collect())) == sorted((at[a], at[b]) for a, b in lines)
    assert sorted(map(tuple, quads.collect())) == sorted(tuple(at[c] for c in f[1:]) for f in faces)


def test_mesh_shuffles_voxels_once(spark):
    """Neither faces nor their edges are shuffled; an object without voxels has an empty mesh."""
    whole = grid(spark, Roi((0, 0, 0), (4, 4, 4))).withColumn("label", F.lit(1))
    for df in (mesh_faces(whole, (9, 9, 9), 1), mesh.mesh_lines(whole, (9, 9, 9), 1), *extract_mesh(whole, (9, 9, 9), 1)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [df.count() for df in extract_mesh(whole, (9, 9, 9), 7)] == [0, 0, 0]


def test_differences_compare_apart_from_the_cells(spark):
    """Cells are dealt out anew before they are compared, and no row is copied; rows count as often as they occur."""
    s = spec("float64", (4, 4), (8, 8))
    a = TileArray(s, grid(spark, Roi((0, 0), (8, 8))).withColumn("v", F.lit(1.0)).groupBy("x0", "x1").agg(F.max("v").alias("v")))
    b = a.delete(Roi((0, 0), (1, 1))).write_point((7, 7), float("nan")).set_dirty(Roi((7, 7), (8, 8)))
    for other, n in ((a, (0, 0, 0)), (b, (16 + 2, 1, 2))):
        df = a.differences(other)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "replicaterows" not in plan and "REPARTITION_BY_NUM" in plan
        assert {r["part"]: r["n"] for r in df.collect()} == dict(zip(("cells", "blocks", "dirty"), n))
    twice = TileArray(s, a.cells.unionByName(a.cells.where("x0 = 0")))
    assert {r["part"]: r["n"] for r in twice.differences(a).collect()}["cells"] == 8
    assert b.equals(b) and not twice.equals(a)
