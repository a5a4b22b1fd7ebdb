"""Statistics of labelled regions: moments, histograms, quantiles and geometry. Label 0 is background."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import materialize

BINS = 50
# The seven standard quantiles.
QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def labelled(data: DataFrame, labels: DataFrame, ndim: int) -> DataFrame:
    """x0.., v, label of the cells of regions: an equi-join on coordinates, background filtered first."""
    coords = [f"x{i}" for i in range(ndim)]
    return data.select(*coords, "v").join(labels.where(F.col("label") > 0).select(*coords, "label"), coords)


def _moments() -> list[Column]:
    v = F.col("v").cast("double")
    return [F.count("*").alias("count"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.skewness(v).alias("skewness"),
            F.kurtosis(v).alias("kurtosis"), F.min("v").alias("minimum"), F.max("v").alias("maximum")]


def moments(cells: DataFrame) -> DataFrame:
    """count, mean, variance (population), skewness, kurtosis (excess), minimum, maximum per label."""
    return cells.groupBy("label").agg(*_moments())


def value_range(data: DataFrame) -> DataFrame:
    """One row (lo = 0, hi = largest value of all cells, background included)."""
    return data.agg(F.lit(0.0).alias("lo"), F.max(F.col("v").cast("double")).alias("hi"))


def histogram_rows(cells: DataFrame, span: DataFrame, bins: int = BINS) -> DataFrame:
    """label, bin, n; bin -1 and `bins` hold what lies below and above. The value hi falls into the last bin.

    `span` is one row by construction (a global aggregate), broadcast to stay lazy.
    """
    m = (F.col("v").cast("double") - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    place = F.when(m == bins, bins - 1).when(m < 0, -1).when(m >= bins, bins).otherwise(F.floor(m))
    return cells.join(F.broadcast(span)).withColumn("bin", place.cast("int")).where("bin IS NOT NULL").groupBy("label", "bin").agg(F.count("*").alias("n"))


def histogram(cells: DataFrame, span: DataFrame, bins: int = BINS) -> DataFrame:
    """label, histogram (array of `bins` counts), left_outliers, right_outliers."""
    rows = histogram_rows(cells, span, bins)
    held = F.map_from_entries(F.collect_list(F.struct("bin", "n")))  # bins + 2 entries at most
    get = lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0))
    return rows.groupBy("label").agg(held.alias("m")).select(
        "label", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), get).alias("histogram"),
        get(F.lit(-1)).alias("left_outliers"), get(F.lit(bins)).alias("right_outliers"),
    )


def quantiles(cells: DataFrame, span: DataFrame, bins: int = BINS) -> DataFrame:
    """label, q0..q6: the standard quantiles interpolated in the cumulative histogram; the ends are exact."""
    rows = histogram_rows(cells, span, bins).where((F.col("bin") >= 0) & (F.col("bin") < bins))
    by = Window.partitionBy("label").orderBy("bin")  # bins rows a label at most
    cum = rows.withColumns({"upto": F.sum("n").over(by), "first": F.row_number().over(by) == 1, "last": F.lead("bin").over(by).isNull()}).withColumn("before", F.col("upto") - F.col("n"))
    ends = cells.groupBy("label").agg(F.min(F.col("v").cast("double")).alias("least"), F.max(F.col("v").cast("double")).alias("most"))
    total = rows.groupBy("label").agg(F.sum("n").alias("total"))
    cum = cum.join(ends, "label").join(total, "label").join(F.broadcast(span))
    width = F.col("hi") - F.col("lo")
    left = F.when(F.col("first"), (F.col("least") - F.col("lo")) * bins / width).otherwise(F.col("bin").cast("double"))
    right = F.when(F.col("last"), (F.col("most") - F.col("lo")) * bins / width).otherwise(F.col("bin") + 1.0)
    out = []
    for k, q in enumerate(QUANTILES):
        if q in (0.0, 1.0):
            out.append(F.max("least" if q == 0.0 else "most").alias(f"q{k}"))
            continue
        want = q * F.col("total")
        here = (F.col("before") < want) & (want <= F.col("upto"))
        at = left + (right - left) * (want - F.col("before")) / F.col("n")
        out.append(F.max(F.when(here, F.col("lo") + at * width / bins)).alias(f"q{k}"))
    return cum.groupBy("label").agg(*out)


def geometry(cells: DataFrame, ndim: int) -> DataFrame:
    """Per label: centre c0.., and bounding box lo0.., hi0.. (inclusive)."""
    return cells.groupBy("label").agg(*_geometry(ndim))


def _geometry(ndim: int) -> list[Column]:
    out = [F.avg(f"x{i}").alias(f"c{i}") for i in range(ndim)]
    return out + [f(f"x{i}").alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(ndim)]


def weighted_center(cells: DataFrame, ndim: int) -> DataFrame:
    """Per label: centre weighted by the values."""
    return cells.groupBy("label").agg(*_weighted_center(ndim))


def _weighted_center(ndim: int) -> list[Column]:
    v = F.col("v").cast("double")
    return [(F.sum(v * F.col(f"x{i}")) / F.nullif(F.sum(v), F.lit(0.0))).alias(f"w{i}") for i in range(ndim)]


def arg_extrema(cells: DataFrame, ndim: int) -> DataFrame:
    """Per label: coordinates of the smallest (mn0..) and largest (mx0..) value; ties to the first coordinates."""
    return cells.groupBy("label").agg(*_extrema(ndim)).select("label", *_extrema_columns(ndim))


def _extrema(ndim: int) -> list[Column]:
    at = F.struct(*(F.col(f"x{i}").alias(f"x{i}") for i in range(ndim)))
    return [F.min(F.struct("v", at.alias("at"))).alias("a"), F.min(F.struct((-F.col("v")).alias("v"), at.alias("at"))).alias("b")]


def _extrema_columns(ndim: int) -> list[Column]:
    return [F.col(f"{s}.at.x{i}").alias(f"{n}{i}") for s, n in (("a", "mn"), ("b", "mx")) for i in range(ndim)]


def _covariances(ndim: int) -> list[Column]:
    return [F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}{j}") for i in range(ndim) for j in range(i, ndim)]


def covariance(cells: DataFrame, ndim: int, weighted: bool = False) -> DataFrame:
    """Per label: population covariances s{i}{j} of the coordinates, i <= j; optionally weighted by the values."""
    if not weighted:
        return cells.groupBy("label").agg(*_covariances(ndim))
    return centred(cells, weighted_center(cells, ndim), ndim)


def centred(cells: DataFrame, centers: DataFrame, ndim: int) -> DataFrame:
    """Covariances about given weighted centres (label, w0..): the differences are taken first, so large coordinates lose nothing."""
    v = F.col("v").cast("double")
    x = [F.col(f"x{i}") - F.col(f"w{i}") for i in range(ndim)]
    total = F.nullif(F.sum(v), F.lit(0.0))
    out = [(F.sum(v * x[i] * x[j]) / total).alias(f"s{i}{j}") for i in range(ndim) for j in range(i, ndim)]
    return cells.join(centers, "label").groupBy("label").agg(*out)


def principal_axes(cov: DataFrame, ndim: int) -> DataFrame:
    """label, radii (falling) and axes (unit vectors, largest component positive) from covariances: one row a label, vectorised."""

    def run(frames):
        for pdf in frames:
            m = np.zeros((len(pdf), ndim, ndim))
            for i in range(ndim):
                for j in range(i, ndim):
                    m[:, i, j] = m[:, j, i] = pdf[f"s{i}{j}"].fillna(0)
            value, vector = np.linalg.eigh(m)
            value, vector = np.sqrt(np.maximum(value[:, ::-1], 0)), np.swapaxes(vector[:, :, ::-1], 1, 2)
            big = np.take_along_axis(vector, np.abs(vector).argmax(axis=2)[:, :, None], 2)
            vector = vector * np.where(big < 0, -1, 1)
            vector[value[:, 0] == 0] = np.eye(ndim)
            yield pd.DataFrame({"label": pdf["label"], "radii": value.tolist(), "axes": vector.tolist()})

    return cov.mapInPandas(run, f"label {dict(cov.dtypes)['label']}, radii array<double>, axes array<array<double>>")


def region_features(data: DataFrame, labels: DataFrame, ndim: int, bins: int = BINS, span: tuple[float, float] | None = None, dense: bool = False) -> DataFrame:
    """All statistics of every region in one wide row per label; dense: also labels 0..max without cells.

    The cells of the regions are joined and written once; one aggregation gives all but the histogram and the weighted spread.
    """
    cells = materialize(labelled(data, labels, ndim))
    spark = data.sparkSession
    rng = value_range(data) if span is None else spark.createDataFrame([(float(span[0]), float(span[1]))], "lo double, hi double")
    one = materialize(cells.groupBy("label").agg(*_moments(), *_geometry(ndim), *_weighted_center(ndim), *_extrema(ndim), *_covariances(ndim)))
    spread = [f"s{i}{j}" for i in range(ndim) for j in range(i, ndim)]
    out = one.select(*(c for c in one.columns if c not in ("a", "b", *spread)), *_extrema_columns(ndim))
    out = out.join(histogram(cells, rng, bins), "label").join(quantiles(cells, rng, bins), "label", "left")
    out = out.join(principal_axes(one.select("label", *spread), ndim), "label")
    weighted = centred(cells, one.select("label", *(f"w{i}" for i in range(ndim))), ndim)
    out = out.join(principal_axes(weighted, ndim).select("label", F.col("radii").alias("w_radii"), F.col("axes").alias("w_axes")), "label")
    if dense:
        top = labels.agg(F.max("label")).first()[0] or 0
        out = spark.range(top + 1).select(F.col("id").cast(dict(labels.dtypes)["label"]).alias("label")).join(out, "label", "left")
    return out
