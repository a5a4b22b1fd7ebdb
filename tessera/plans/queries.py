"""The array engine's registered queries and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.region import Roi, grid, intersections, tiles, with_blocks, with_halo
from ..operators import features as ft
from ..operators import mesh as ms
from ..operators.cache import BlockCache
from ..operators.segment import connected_components
from ..operators.store import TileArray
from ..operators.transform import resample, select_channel, threshold, within
from ..streaming.patches import upsert
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_E2 = "e2 AS (SELECT vec_id::INTEGER AS x0, (unnest(range(0, len(embedding))))::INTEGER AS x1, unnest(embedding) AS v FROM embeddings)"
_S3 = "s3 AS (SELECT l_suppkey::INTEGER AS x0, (l_linenumber - 1)::INTEGER AS x1, (l_quantity - 1)::INTEGER AS x2, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL)"
_T3 = "t3 AS (SELECT user_id::INTEGER AS x0, (dayofyear(ts) - 1)::INTEGER AS x1, hour(ts)::INTEGER AS x2, max(value) AS v FROM events GROUP BY ALL)"
_C4 = (
    "c4 AS (SELECT (list_position(['click','error','purchase','signup','view'], event_type) - 1)::INTEGER AS x0, user_id::INTEGER AS x1, "
    "(dayofyear(ts) - 1)::INTEGER AS x2, hour(ts)::INTEGER AS x3, max(value) AS v FROM events GROUP BY ALL)"
)


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if it has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded, so that engines agree to the last digit shown."""
    return df.select(*(F.round(F.col(c).cast("double"), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def _wide(df: DataFrame) -> DataFrame:
    """Integers as bigint."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "bigint") else F.col(c) for c, t in df.dtypes))


# -- reads ---------------------------------------------------------------------------------------


@query(f"WITH {_E2} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, v::DOUBLE AS v FROM e2 WHERE x0 >= 30 AND x0 < 210 AND x1 >= 5 AND x1 < 40")
def roi_read_sparse(spark, d):
    return _wide(TileArray(fx.E2, fx.e2(spark, d))[30:210, 5:40]).withColumn("v", F.col("v").cast("double"))


@query(
    f"""WITH {_T3}, g AS (SELECT a.range AS x0, b.range AS x1, c.range AS x2 FROM range(10, 40) a, range(0, 12) b, range(3, 20) c)
    SELECT g.x0, g.x1, g.x2, coalesce(t3.v, 0) AS v FROM g LEFT JOIN t3 USING (x0, x1, x2)"""
)
def roi_read_dense(spark, d):
    return _wide(TileArray(fx.T3, fx.t3(spark, d)).read(Roi((10, 0, 3), (40, 12, 20)), dense=True))


@query(f"WITH {_E2} SELECT p.x0::BIGINT AS x0, p.x1::BIGINT AS x1, coalesce(v, 0)::DOUBLE AS v FROM (VALUES (17, 33), (123456, 3)) p(x0, x1) LEFT JOIN e2 USING (x0, x1)")
def point_read(spark, d):
    a = TileArray(fx.E2, fx.e2(spark, d))
    return _wide(a.at(17, 33).unionByName(a.at(123456, 3))).withColumn("v", F.col("v").cast("double"))


_DIRECTORY = f"""WITH {_S3}, p AS (SELECT x0 // 20 AS b0, x1 // 3 AS b1, x2 // 10 AS b2, count(*) AS n, count(*) FILTER (v <> 0) AS nnz, min(v) AS lo, max(v) AS hi FROM s3 GROUP BY ALL)"""


@query(
    _DIRECTORY
    + """ SELECT b0::BIGINT AS b0, b1::BIGINT AS b1, b2::BIGINT AS b2, nnz::BIGINT AS nnz, 600::BIGINT AS n_cells,
    CASE WHEN n < 600 THEN least(lo, 0) ELSE lo END AS vmin, CASE WHEN n < 600 THEN greatest(hi, 0) ELSE hi END AS vmax, 4800::BIGINT AS raw_bytes FROM p"""
)
def block_directory(spark, d):
    return _wide(TileArray(fx.S3, fx.s3(spark, d)).directory().drop("dirty"))


@query(f"WITH {_T3} SELECT least(min(v), 0) AS vmin, greatest(max(v), 0) AS vmax FROM t3")
def global_minmax(spark, d):
    return TileArray(fx.T3, fx.t3(spark, d)).minmax()


@query(
    """SELECT a.range AS b0, b.range AS b1, greatest(a.range * 40, 15) AS p0, greatest(b.range * 25, 30) AS p1,
    least((a.range + 1) * 40, 333) AS q0, least((b.range + 1) * 25, 190) AS q1 FROM range(0, 9) a, range(1, 8) b"""
)
def tile_grid(spark, d):
    return _wide(tiles(spark, Roi((15, 30), (333, 190)), (40, 25)))


@query(
    """SELECT a.range AS b0, b.range AS b1, a.range * 10 AS p0, b.range * 20 AS p1,
    least((a.range + 1) * 10 + 1, 50) AS q0, least((b.range + 1) * 20 + 1, 50) AS q1 FROM range(0, 5) a, range(0, 3) b"""
)
def tile_grid_overlap(spark, d):
    return _wide(tiles(spark, Roi((0, 0), (50, 50)), (10, 20), (1, 1)))


@query(
    f"""WITH {_T3}, h AS (SELECT x0 // 32 - i AS b0, x1 // 10 - j AS b1, x2 // 8 - k AS b2 FROM t3, range(0, 2) a(i), range(0, 2) b(j), range(0, 2) c(k)
    WHERE (i = 0 OR (x0 % 32 < 1 AND x0 // 32 >= 1)) AND (j = 0 OR (x1 % 10 < 1 AND x1 // 10 >= 1)) AND (k = 0 OR (x2 % 8 < 1 AND x2 // 8 >= 1)))
    SELECT b0::BIGINT AS b0, b1::BIGINT AS b1, b2::BIGINT AS b2, count(*)::BIGINT AS n FROM h GROUP BY ALL"""
)
def halo_counts(spark, d):
    return _wide(with_halo(fx.t3(spark, d), fx.T3.block_shape, (1, 1, 1)).groupBy("b0", "b1", "b2").agg(F.count("*").alias("n")))


@query(
    """WITH a AS (SELECT x.range * 100 + y.range AS id, x.range * 30 AS p0, y.range * 30 AS p1, x.range * 30 + 45 AS q0, y.range * 30 + 45 AS q1 FROM range(0, 20) x, range(0, 20) y),
    b AS (SELECT x.range * 100 + y.range AS id, x.range * 50 + 7 AS p0, y.range * 50 + 7 AS p1, x.range * 50 + 40 AS q0, y.range * 50 + 40 AS q1 FROM range(0, 12) x, range(0, 12) y)
    SELECT a.id::BIGINT AS a_id, b.id::BIGINT AS b_id, greatest(a.p0, b.p0)::BIGINT AS p0, greatest(a.p1, b.p1)::BIGINT AS p1, least(a.q0, b.q0)::BIGINT AS q0, least(a.q1, b.q1)::BIGINT AS q1
    FROM a, b WHERE greatest(a.p0, b.p0) < least(a.q0, b.q0) AND greatest(a.p1, b.p1) < least(a.q1, b.q1)"""
)
def roi_intersections(spark, d):
    def boxes(n, step, low, high):
        g = grid(spark, Roi((0, 0), (n, n)))
        out = {"id": F.col("x0") * 100 + F.col("x1")} | {f"p{i}": F.col(f"x{i}") * step + low for i in (0, 1)} | {f"q{i}": F.col(f"x{i}") * step + high for i in (0, 1)}
        return g.withColumns(out)

    return _wide(intersections(boxes(20, 30, 0, 45), boxes(12, 50, 7, 40), 2, (60, 60)))


@query(f"WITH {_T3} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, v FROM t3 WHERE v <> 0")
def nonzero_list(spark, d):
    return _wide(TileArray(fx.T3, fx.t3(spark, d)).nonzero())


@query("SELECT x.range AS b0, y.range AS b1, x.range * 50 AS start0, y.range * 16 AS start1, x.range * 50 + 50 AS stop0, y.range * 16 + 16 AS stop1 FROM range(2, 5) x, range(1, 3) y")
def stored_blocks(spark, d):
    return _wide(TileArray(fx.E2, fx.e2(spark, d)).stored_blocks(Roi((120, 20), (250, 40))))


@query("SELECT x.range AS b0, y.range AS b1, z.range AS b2 FROM range(1, 4) x, range(0, 2) y, range(2, 5) z")
def enumerate_blocks(spark, d):
    return _wide(TileArray(fx.S3, fx.s3(spark, d)).enumerate_blocks(Roi((25, 0, 20), (80, 4, 45))))


# -- writes --------------------------------------------------------------------------------------

_PATCH = Roi((40, 10), (90, 30))


@query(
    f"""WITH {_E2} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, v::DOUBLE AS v FROM e2 WHERE NOT (x0 >= 40 AND x0 < 90 AND x1 >= 10 AND x1 < 30)
    UNION ALL SELECT a.range, b.range, ((a.range * 7 + b.range) % 5)::DOUBLE FROM range(40, 90) a, range(10, 30) b"""
)
def write_subarray(spark, d):
    patch = grid(spark, _PATCH).withColumn("v", ((F.col("x0") * 7 + F.col("x1")) % 5).cast("float"))
    return _wide(TileArray(fx.E2, fx.e2(spark, d)).write(_PATCH, patch).cells).withColumn("v", F.col("v").cast("double"))


@query(f"WITH {_E2} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, v::DOUBLE AS v FROM e2 WHERE NOT (x0 = 60 AND x1 = 43) UNION ALL SELECT 60, 43, 42")
def write_point(spark, d):
    return _wide(TileArray(fx.E2, fx.e2(spark, d)).write_point((60, 43), 42.0).cells).withColumn("v", F.col("v").cast("double"))


@query(
    f"""WITH {_S3}, p AS (SELECT a.range::INTEGER AS x0, b.range::INTEGER AS x1, c.range::INTEGER AS x2, ((a.range + b.range + c.range) % 3)::DOUBLE AS w FROM range(10, 30) a, range(1, 5) b, range(5, 25) c)
    SELECT coalesce(s3.x0, p.x0)::BIGINT AS x0, coalesce(s3.x1, p.x1)::BIGINT AS x1, coalesce(s3.x2, p.x2)::BIGINT AS x2,
    CASE WHEN w IS NULL OR w = 0 THEN coalesce(v, 0) WHEN w = 2 THEN 0 ELSE w END AS v FROM s3 FULL JOIN p ON s3.x0 = p.x0 AND s3.x1 = p.x1 AND s3.x2 = p.x2"""
)
def write_nonzero(spark, d):
    roi = Roi((10, 1, 5), (30, 5, 25))
    patch = grid(spark, roi).withColumn("v", ((F.col("x0") + F.col("x1") + F.col("x2")) % 3).cast("double"))
    return _wide(TileArray(fx.S3, fx.s3(spark, d)).write_nonzero(roi, patch, 2).cells)


@query(f"WITH {_S3} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, v FROM s3 WHERE NOT (x0 // 20 IN (1, 2) AND x1 // 3 IN (0, 1) AND x2 // 10 IN (1, 2))")
def delete_subarray(spark, d):
    return _wide(TileArray(fx.S3, fx.s3(spark, d)).delete(Roi((25, 2, 15), (41, 5, 21))).cells)


@query(
    f"""WITH {_T3}, t AS (SELECT x0, x1, x2, CASE WHEN v > 300 THEN 1 ELSE 0 END AS v FROM t3), z AS (SELECT x0 // 32 AS b0, x1 // 10 AS b1, x2 // 8 AS b2 FROM t GROUP BY ALL HAVING sum(v) > 0)
    SELECT b0::BIGINT AS b0, b1::BIGINT AS b1, b2::BIGINT AS b2 FROM z"""
)
def delete_empty_blocks(spark, d):
    a = TileArray.empty(spark, fx.T3.with_(dtype="uint8", delete_empty=True))
    cells = threshold(fx.t3(spark, d), 300.0)
    box = cells.agg(*(f(f"x{i}") for f in (F.min, F.max) for i in range(3))).first()  # all of the data
    roi = Roi.empty(3) if box[0] is None else Roi(tuple(box[:3]), tuple(x + 1 for x in box[3:]))
    return _wide(a.write(roi, cells).blocks)


@query(f"WITH {_T3} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, [0, 7, 7, 3, 9][(x2 % 5) + 1]::BIGINT AS v FROM t3")
def apply_relabeling(spark, d):
    hours = fx.t3(spark, d).withColumn("v", F.col("x2"))
    lut = spark.createDataFrame([(0, 0), (1, 7), (2, 7), (3, 3), (4, 9)], "k int, r int")
    return _wide(TileArray(fx.T3.with_(dtype="int32"), hours).relabel(lut).cells)


# -- cell-wise operators -------------------------------------------------------------------------


@query(f"WITH {_E2} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, (CASE WHEN v > 0.1::FLOAT AND NOT isnan(v) THEN 1 ELSE 0 END)::BIGINT AS v FROM e2")
def threshold_cells(spark, d):
    return _wide(threshold(fx.e2(spark, d), 0.1))


@query(f"WITH {_C4} SELECT x1::BIGINT AS x0, x2::BIGINT AS x1, x3::BIGINT AS x2, v FROM c4 WHERE x0 = 2")
def select_one_channel(spark, d):
    return _wide(select_channel(fx.c4(spark, d), 0, 2, 4))


@query(f"WITH {_S3} SELECT (x0 - 11)::BIGINT AS x0, (x1 - 2)::BIGINT AS x1, (x2 - 7)::BIGINT AS x2, v FROM s3 WHERE x0 >= 11 AND x0 < 70 AND x1 >= 2 AND x1 < 6 AND x2 >= 7 AND x2 < 30")
def source_roi_shift(spark, d):
    return _wide(within(fx.s3(spark, d), Roi((11, 2, 7), (70, 6, 30))))


@query(f"WITH {_E2} SELECT (x0 // 4)::BIGINT AS x0, (x1 // 4)::BIGINT AS x1, v::DOUBLE AS v FROM e2 WHERE x0 % 4 = 0 AND x1 % 4 = 0")
def resample_quarter(spark, d):
    return _wide(resample(fx.e2(spark, d), 0.25, 2)).withColumn("v", F.col("v").cast("double"))


# -- region statistics ---------------------------------------------------------------------------


def _by_label(spark, d):
    """E2's cells with each vector's own label (0: background)."""
    t = spark.read.parquet(f"{d}/embeddings.parquet")
    return t.where("label > 0").select("label", F.col("vec_id").cast("int").alias("x0"), F.posexplode("embedding").alias("x1", "v"))


def _suppliers(df: DataFrame) -> DataFrame:
    """S3's cells labelled by supplier group 1..10."""
    return df.withColumn("label", (F.col("x0") % 10 + 1).cast("int"))


_SL = f"WITH {_S3}, c AS (SELECT *, x0 % 10 + 1 AS label FROM s3), g AS (SELECT max(v) AS hi FROM s3)"
_TL = f"WITH {_T3}, c AS (SELECT *, 1 + (x0 // 50) * 4 + (x1 // 15) * 2 + x2 // 12 AS label FROM t3)"


def _boxes(df: DataFrame) -> DataFrame:
    """T3's cells labelled by box."""
    return df.withColumn("label", (1 + F.floor(F.col("x0") / 50) * 4 + F.floor(F.col("x1") / 15) * 2 + F.floor(F.col("x2") / 12)).cast("int"))


@query(
    f"""WITH {_E2}, c AS (SELECT e.label, v::DOUBLE AS v FROM e2 JOIN embeddings e ON e.vec_id = e2.x0 WHERE e.label > 0), m AS (SELECT *, avg(v) OVER (PARTITION BY label) AS mu FROM c)
    SELECT label::BIGINT AS label, count(*)::BIGINT AS count, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance,
    round(sqrt(count(*)) * sum((v - mu) ** 3) / nullif(sum((v - mu) ** 2), 0) ** 1.5, 6) AS skewness,
    round(count(*) * sum((v - mu) ** 4) / nullif(sum((v - mu) ** 2), 0) ** 2 - 3, 6) AS kurtosis, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum FROM m GROUP BY label"""
)
def region_stats(spark, d):
    return _wide(_rounded(ft.moments(_by_label(spark, d))))


@query(
    _SL
    + """, b AS (SELECT label, CASE WHEN v * 50 / hi = 50 THEN 49 ELSE floor(v * 50 / hi) END::INTEGER AS bin FROM c, g), n AS (SELECT label, bin, count(*) AS n FROM b GROUP BY ALL)
    SELECT label::BIGINT AS label, bin::BIGINT AS bin, n::BIGINT AS n FROM n"""
)
def region_histogram(spark, d):
    cells = fx.s3(spark, d)
    wide = ft.histogram(_suppliers(cells), ft.value_range(cells))
    return _wide(wide.select("label", F.posexplode("histogram").alias("bin", "n")).where("n > 0"))


@query(
    _SL
    + """, b AS (SELECT label, v, hi, CASE WHEN v * 50 / hi = 50 THEN 49 ELSE floor(v * 50 / hi) END AS bin FROM c, g),
    n AS (SELECT label, bin, count(*) AS n, any_value(hi) AS hi FROM b GROUP BY label, bin), e AS (SELECT label, min(v) AS lo, max(v) AS up, count(*) AS total FROM b GROUP BY label),
    k AS (SELECT n.label, n.n, n.hi, lo, up, total, sum(n.n) OVER w - n.n AS before, sum(n.n) OVER w AS upto,
      CASE WHEN row_number() OVER w = 1 THEN lo * 50 / n.hi ELSE bin END AS l, CASE WHEN lead(bin) OVER w IS NULL THEN up * 50 / n.hi ELSE bin + 1 END AS r
      FROM n JOIN e USING (label) WINDOW w AS (PARTITION BY n.label ORDER BY bin))
    SELECT label::BIGINT AS label, round(max(lo), 6) AS q0, """
    + ", ".join(f"round(max(CASE WHEN before < {q} * total AND {q} * total <= upto THEN (l + (r - l) * ({q} * total - before) / n) * hi / 50 END), 6) AS q{i}" for i, q in enumerate((0.1, 0.25, 0.5, 0.75, 0.9), 1))
    + ", round(max(up), 6) AS q6 FROM k GROUP BY label"
)
def region_quantiles(spark, d):
    cells = fx.s3(spark, d)
    return _wide(_rounded(ft.quantiles(_suppliers(cells), ft.value_range(cells))))


@query(
    _TL
    + " SELECT label::BIGINT AS label, "
    + ", ".join([f"round(avg(x{i}), 6) AS c{i}" for i in range(3)] + [f"{f}(x{i})::BIGINT AS {n}{i}" for n, f in (("lo", "min"), ("hi", "max")) for i in range(3)])
    + " FROM c GROUP BY label"
)
def region_geometry(spark, d):
    return _wide(_rounded(ft.geometry(_boxes(fx.t3(spark, d)), 3)))


@query(_TL + " SELECT label::BIGINT AS label, " + ", ".join(f"round(sum(v * x{i}) / nullif(sum(v), 0), 6) AS w{i}" for i in range(3)) + " FROM c GROUP BY label")
def region_weighted_center(spark, d):
    return _wide(_rounded(ft.weighted_center(_boxes(fx.t3(spark, d)), 3)))


@query(
    _SL
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY v, x0, x1, x2) AS i, row_number() OVER (PARTITION BY label ORDER BY v DESC, x0, x1, x2) AS j FROM c)
    SELECT label::BIGINT AS label, """
    + ", ".join([f"max(x{k}) FILTER (i = 1)::BIGINT AS mn{k}" for k in range(3)] + [f"max(x{k}) FILTER (j = 1)::BIGINT AS mx{k}" for k in range(3)])
    + " FROM a GROUP BY label"
)
def region_argminmax(spark, d):
    return _wide(ft.arg_extrema(_suppliers(fx.s3(spark, d)), 3))


@query(_TL + " SELECT label::BIGINT AS label, " + ", ".join(f"round(covar_pop(x{i}, x{j}), 6) AS s{i}{j}" for i in range(3) for j in range(i, 3)) + " FROM c GROUP BY label")
def region_covariance(spark, d):
    return _wide(_rounded(ft.covariance(_boxes(fx.t3(spark, d)), 3)))


@query(
    f"""WITH {_E2}, c AS (SELECT e.label, x0, x1 FROM e2 JOIN embeddings e ON e.vec_id = e2.x0 WHERE e.label > 0),
    s AS (SELECT label, var_pop(x0) AS a, var_pop(x1) AS b, covar_pop(x0, x1) AS o FROM c GROUP BY label)
    SELECT label::BIGINT AS label, round(sqrt((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + o * o)), 5) AS r0, round(sqrt((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + o * o)), 5) AS r1 FROM s"""
)
def region_radii(spark, d):
    out = ft.principal_axes(ft.covariance(_by_label(spark, d), 2), 2)
    return _wide(_rounded(out.select("label", F.col("radii")[0].alias("r0"), F.col("radii")[1].alias("r1")), 5))


@query()
def region_axes(spark, d):
    return ft.principal_axes(ft.covariance(_boxes(fx.t3(spark, d)), 3), 3)


@query()
def region_features_all(spark, d):
    cells = fx.s3(spark, d)
    labels = cells.select("x0", "x1", "x2", (F.col("x0") % 10 + 1).cast("int").alias("label"))
    return ft.region_features(cells, labels, 3)


# -- components ----------------------------------------------------------------------------------


def _cc_sql(fg: str, ndim: int, tail: str) -> str:
    """Components by smallest linear id over a table fg(x0.., id, v), then `tail` over cc(x0.., label)."""
    xs = [f"x{i}" for i in range(ndim)]
    steps = " UNION ALL ".join(
        f"SELECT a.id AS s, b.id AS t FROM fg a JOIN fg b ON b.{x} = a.{x} + 1 AND a.v = b.v" + "".join(f" AND a.{y} = b.{y}" for y in xs if y != x) for x in xs
    )
    return f"""WITH RECURSIVE {fg}, half AS ({steps}), e AS (SELECT s, t FROM half UNION ALL SELECT t, s FROM half),
    reach AS (SELECT id AS n, id AS r FROM fg UNION SELECT e.t, reach.r FROM reach JOIN e ON e.s = reach.n WHERE reach.r < e.t),
    root AS (SELECT n, min(r) AS r FROM reach GROUP BY n), cc AS (SELECT {", ".join("fg." + x for x in xs)}, dense_rank() OVER (ORDER BY r) AS label FROM fg JOIN root ON root.n = fg.id) {tail}"""


_FG2 = f"{_E2}, fg AS (SELECT x0, x1, x0::BIGINT * 64 + x1 AS id, 1 AS v FROM e2 WHERE v > 0.1::FLOAT)"
_FG3 = f"{_T3}, fg AS (SELECT x0, x1, x2, (x0::BIGINT * 366 + x1) * 24 + x2 AS id, 1 AS v FROM t3)"


@query(_cc_sql(_FG2, 2, "SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, label::BIGINT AS label FROM cc"))
def connected_components_2d(spark, d):
    return _wide(connected_components(threshold(fx.e2(spark, d), 0.1), fx.E2.with_(dtype="uint8")))


@query(_cc_sql(_FG3, 3, "SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, label::BIGINT AS label FROM cc"))
def connected_components_3d(spark, d):
    present = fx.t3(spark, d).withColumn("v", F.lit(1).cast("smallint"))
    return _wide(connected_components(present, fx.T3.with_(dtype="uint8")))


@query(_cc_sql(_FG2, 2, "SELECT label::BIGINT AS label, count(*)::BIGINT AS n FROM cc GROUP BY label"))
def cc_sizes(spark, d):
    return _wide(connected_components(threshold(fx.e2(spark, d), 0.1), fx.E2.with_(dtype="uint8")).groupBy("label").agg(F.count("*").alias("n")))


# -- mesh ----------------------------------------------------------------------------------------

_MESH_EXTENT = fx.S3.extent


def _object(spark, d):
    return fx.s3(spark, d).where(F.col("v") > 30000).select("x0", "x1", "x2", F.lit(1).alias("label"))


_FACES = f"""WITH {_S3}, o AS (SELECT x0, x1, x2 FROM s3 WHERE v > 30000),
    s AS (SELECT x0 - (CASE WHEN ax = 0 THEN dd ELSE 0 END) AS x, x1 - (CASE WHEN ax = 1 THEN dd ELSE 0 END) AS y, x2 - (CASE WHEN ax = 2 THEN dd ELSE 0 END) AS z, ax AS axis
      FROM o, range(0, 3) a(ax), range(0, 2) b(dd)),
    f AS (SELECT x, y, z, axis FROM s GROUP BY ALL HAVING count(*) = 1 AND x >= 0 AND y BETWEEN 0 AND 5 AND z BETWEEN 0 AND 48),
    k AS (SELECT x, y, z, axis, i, CASE WHEN i IN (1, 2) THEN 1 ELSE 0 END AS up, CASE WHEN i IN (2, 3) THEN 1 ELSE 0 END AS late FROM f, range(0, 4) c(i)),
    p AS (SELECT f0.x AS fx, f0.y AS fy, f0.z AS fz, axis, i, x + CASE axis WHEN 0 THEN 1 WHEN 1 THEN late ELSE up END AS cx,
      y + CASE axis WHEN 1 THEN 1 WHEN 0 THEN up ELSE late END AS cy, z + CASE axis WHEN 2 THEN 1 WHEN 0 THEN late ELSE up END AS cz FROM k f0)"""


@query(
    _FACES
    + " SELECT axis::BIGINT AS axis, "
    + ", ".join(f"max(c{c}) FILTER (i = {i})::BIGINT AS {c}{i}" for i in range(4) for c in "xyz")
    + " FROM p GROUP BY fx, fy, fz, axis"
)
def mesh_faces(spark, d):
    f = ms.mesh_faces(_object(spark, d), _MESH_EXTENT, 1)
    return _wide(f.select("axis", *(F.col(f"c{i}.{c}").alias(f"{c}{i}") for i in range(4) for c in "xyz")))


@query(
    _FACES
    + """, l AS (SELECT DISTINCT least((a.cx, a.cy, a.cz), (b.cx, b.cy, b.cz)) AS u, greatest((a.cx, a.cy, a.cz), (b.cx, b.cy, b.cz)) AS w
    FROM p a JOIN p b ON a.fx = b.fx AND a.fy = b.fy AND a.fz = b.fz AND a.axis = b.axis AND b.i = (a.i + 1) % 4)
    SELECT u[1]::BIGINT AS a_x, u[2]::BIGINT AS a_y, u[3]::BIGINT AS a_z, w[1]::BIGINT AS b_x, w[2]::BIGINT AS b_y, w[3]::BIGINT AS b_z FROM l"""
)
def mesh_lines(spark, d):
    lines = ms.mesh_lines(_object(spark, d), _MESH_EXTENT, 1)
    return _wide(lines.select(*(F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in "xyz")))


@query(_FACES + ", q AS (SELECT DISTINCT cx, cy, cz FROM p) SELECT (row_number() OVER (ORDER BY cx, cy, cz) - 1)::BIGINT AS vid, cx::BIGINT AS x, cy::BIGINT AS y, cz::BIGINT AS z FROM q")
def mesh_verts(spark, d):
    return _wide(ms.extract_mesh(_object(spark, d), _MESH_EXTENT, 1)[0])


# -- dirty tracking and cache --------------------------------------------------------------------


def _marked(spark, d) -> TileArray:
    """E2 with its blocks marked in one box, then cleaned in a full-height strip of it."""
    a = TileArray(fx.E2, fx.e2(spark, d))
    return a.set_dirty(Roi((60, 10), (240, 40))).set_dirty(Roi((100, 0), (200, 64)), False)


@query("SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT), (1, 1), (1, 2), (4, 0), (4, 1), (4, 2)) t(b0, b1)")
def dirty_blocks(spark, d):
    return _wide(_marked(spark, d).dirty_blocks())


@query("SELECT a.b0, b.range AS b1 FROM (SELECT DISTINCT vec_id // 50 AS b0 FROM embeddings) a, range(0, 4) b WHERE NOT (a.b0 IN (1, 4) AND b.range IN (0, 1, 2))")
def clean_blocks(spark, d):
    return _wide(_marked(spark, d).clean_blocks())


@query("SELECT * FROM (VALUES (1::BIGINT, 0::BIGINT), (1, 1), (335542, 0), (335542, 1)) t(b0, b1)")
def is_dirty(spark, d):
    a = _marked(spark, d)
    return _wide(a.needed_dirty(Roi((90, 12), (110, 20))).unionByName(a.needed_dirty(Roi((16777100, 12), (16777110, 20)))))


@query("SELECT 1::BIGINT AS b0, b.range AS b1, 40::BIGINT AS n0, 16::BIGINT AS n1 FROM range(0, 4) b")
def written_dirty(spark, d):
    """A write cleans the blocks it covers and, of those it doesn't, the slices it spans."""
    roi = Roi((0, 0), (60, 64))
    a = TileArray.empty(spark, fx.E2).write(roi, grid(spark, roi).withColumn("v", F.lit(1.0)))
    return _wide(a.dirty.groupBy("b0", "b1").agg(F.count_if(F.col("axis") == 0).alias("n0"), F.count_if(F.col("axis") == 1).alias("n1")))


@query(
    f"""WITH {_S3}, g AS (SELECT a.range AS x0, b.range AS x1, c.range AS x2 FROM range(10, 50) a, range(0, 7) b, range(5, 30) c)
    SELECT g.x0, g.x1, g.x2, coalesce(s3.v, 0) AS v FROM g LEFT JOIN s3 USING (x0, x1, x2)"""
)
def cache_refresh(spark, d):
    cache = BlockCache(lambda: fx.s3(spark, d), fx.S3)
    cache.refresh(Roi((0, 0, 0), (30, 4, 20)))
    cache.freeze()
    cache.invalidate(Roi((10, 0, 5), (20, 3, 9)))
    cache.unfreeze()
    return _wide(cache.refresh(Roi((10, 0, 5), (50, 7, 30))))


@query(
    f"""WITH {_T3} SELECT x0::BIGINT AS x0, x1::BIGINT AS x1, x2::BIGINT AS x2, v FROM t3 WHERE NOT (x0 = 5 AND x1 = 6 AND x2 = 7)
    UNION ALL SELECT 5, 6, 7, 9.0"""
)
def stream_upsert(spark, d):
    patches = spark.createDataFrame([(5, 6, 7, 3.0, 1), (5, 6, 7, 9.0, 2)], "x0 int, x1 int, x2 int, v double, ts int")
    return _wide(upsert(TileArray(fx.T3, fx.t3(spark, d)), patches).cells)


@query()
def compression_ratio(spark, d):
    a = TileArray(fx.S3, fx.s3(spark, d)).set_compression(True)
    return a.compression().agg(F.sum("stored_bytes").alias("size_bytes"), F.avg(F.col("stored_bytes") / F.col("raw_bytes")).alias("ratio"))


@query(
    _cc_sql(
        f"{_C4}, ch AS (SELECT x1 AS x0, x2 AS x1, x3 AS x2, v FROM c4 WHERE x0 = 2), fg AS (SELECT x0, x1, x2, (x0::BIGINT * 366 + x1) * 24 + x2 AS id, 1 AS v FROM ch WHERE v > 50)",
        3,
        """SELECT label::BIGINT AS label, count(*)::BIGINT AS count, round(avg(ch.v), 6) AS mean, round(min(ch.v), 6) AS minimum, round(max(ch.v), 6) AS maximum,
        round(avg(cc.x0), 6) AS c0, round(avg(cc.x1), 6) AS c1, round(avg(cc.x2), 6) AS c2 FROM cc JOIN ch ON cc.x0 = ch.x0 AND cc.x1 = ch.x1 AND cc.x2 = ch.x2 GROUP BY label""",
    )
)
def pipeline_flagship(spark, d):
    """Channel -> threshold -> components -> statistics of the original data by component."""
    channel = select_channel(fx.c4(spark, d), 0, 2, 4)
    labels = connected_components(threshold(channel, 50.0), fx.T3.with_(dtype="uint8"))
    cells = ft.labelled(channel, labels, 3)
    out = ft.moments(cells).select("label", "count", "mean", "minimum", "maximum").join(ft.geometry(cells, 3).select("label", "c0", "c1", "c2"), "label")
    return _wide(_rounded(out))
