"""The density of points in the plane on a grid, and the points where it is least."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Density:
    """Counts of the points by cell (x, y), and the density at each cell's centre."""

    low: tuple[float, float]
    step: tuple[float, float]
    counts: np.ndarray
    values: np.ndarray

    def cut(self, percentile: float) -> float:
        """The density at a percentile of the points, each taken at its cell's centre: the least that so many of them reach."""
        own = self.values[self.counts > 0]
        order = np.argsort(own)
        share = np.cumsum(self.counts[self.counts > 0][order]) / max(1, self.counts.sum())
        return float(own[order][min(len(order) - 1, int(np.searchsorted(share, percentile / 100)))]) if len(order) else 0.0


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def _cell(value: Column, low: float, step: float, n: int) -> Column:
    return F.when(_finite(value), F.least(F.greatest(F.floor((value - low) / step), F.lit(0)), F.lit(n - 1)).cast("int"))


def density(points: DataFrame, x: str, y: str, cells: int = 100, margin: float = 0.05) -> Density:
    """Gaussian kernels on the points' counts by cell, of the bandwidth that their number and covariance give (n^(-1/6)).

    One aggregation gives the extent and the covariance, another the counts; on the driver are cells x cells numbers, whatever
    the points. Points with a null or a non-finite value are left out; of no points all is 0. Points on a line get a kernel
    that is a cell wide across it.
    """
    used = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter(_finite(F.col("x")) & _finite(F.col("y")))
    n, x0, x1, y0, y1, xx, yy, xy = used.agg(F.count("x"), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")).first()
    if not n:
        return Density((0.0, 0.0), (1.0, 1.0), np.zeros((cells, cells), np.int64), np.zeros((cells, cells)))
    span = [max(b - a, 1e-12) for a, b in ((x0, x1), (y0, y1))]
    low = (x0 - span[0] * margin, y0 - span[1] * margin)
    step = tuple(s * (1 + 2 * margin) / cells for s in span)
    counts = np.zeros((cells, cells), np.int64)
    for r in used.groupBy(_cell(F.col("x"), low[0], step[0], cells).alias("i"), _cell(F.col("y"), low[1], step[1], cells).alias("j")).agg(F.count(F.lit(1)).alias("n")).collect():  # a row a cell
        counts[r["i"], r["j"]] = r["n"]
    cov = np.array([[xx, xy], [xy, yy]]) * n / max(1, n - 1) * n ** (-1 / 3)  # the square of the bandwidth times the covariance
    cov += np.diag([(s / 2) ** 2 for s in step]) * (np.linalg.det(cov) < 1e-12 * max(1e-300, cov[0, 0] * cov[1, 1]))
    at = np.arange(-cells + 1, cells)
    dx, dy = np.meshgrid(at * step[0], at * step[1], indexing="ij")
    inverse = np.linalg.inv(cov)
    kernel = np.exp(-0.5 * (inverse[0, 0] * dx**2 + 2 * inverse[0, 1] * dx * dy + inverse[1, 1] * dy**2)) / (2 * np.pi * np.sqrt(np.linalg.det(cov)) * n)
    size = 4 * cells
    both = np.fft.irfft2(np.fft.rfft2(counts, (size, size)) * np.fft.rfft2(kernel, (size, size)), (size, size))
    values = np.maximum(both[cells - 1 : 2 * cells - 1, cells - 1 : 2 * cells - 1], 0)
    return Density(low, step, counts, values)


def outliers(points: DataFrame, found: Density, x: str, y: str, percentile: float = 10.0) -> DataFrame:
    """``points`` with their cell's density and whether it is below the percentile's; null where they have no place."""
    n = len(found.counts)
    i, j = (_cell(F.col(c).cast("double"), low, step, n) for c, low, step in zip((x, y), found.low, found.step, strict=True))
    cells = points.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(found.values.ravel())], "__cell int, density double")
    return points.withColumn("__cell", i * n + j).join(F.broadcast(cells), "__cell", "left").drop("__cell").withColumn("outlier", F.col("density") < found.cut(percentile))  # n * n rows
