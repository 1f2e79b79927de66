"""Codebooks for opening energies: a gamma distribution fitted from sums, its quantiles as bins, encoding and decoding."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utrflow.operators.arrays import flat


def _digamma(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two derivatives of the logarithm of the gamma function: recurrence up to 8, then the asymptotic series."""
    x = np.array(x, float)
    first, second = np.zeros_like(x), np.zeros_like(x)
    while (low := x < 8).any():
        first, second = np.where(low, first - 1 / x, first), np.where(low, second + 1 / x**2, second)
        x = np.where(low, x + 1, x)
    y = 1 / x**2
    first = first + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    second = second + 1 / x + 0.5 * y + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))
    return first, second


def _log_gamma(a: float) -> float:
    from math import lgamma

    return lgamma(a)


def gamma_cdf(a: float, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function: its power series below a + 1, its continued fraction beyond."""
    x = np.asarray(x, float)
    out = np.zeros_like(x)
    front = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - _log_gamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        t = total = np.full(int(low.sum()), 1 / a)
        for n in range(1, 10_000):
            t = t * x[low] / (a + n)
            total = total + t
            if (t < total * 1e-17).all():
                break
        out[low] = front[low] * total
    high = x >= a + 1
    if high.any():
        y = x[high]
        b = y + 1 - a
        c, d = np.full(len(y), 1e300), 1 / b
        h = d
        for i in range(1, 10_000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-16).all():
                break
        out[high] = 1 - front[high] * h
    return out


def gamma_quantiles(a: float, q: np.ndarray) -> np.ndarray:
    """The values below which the shares ``q`` of a gamma distribution of scale 1 lie, by bisection; infinite for 1."""
    q = np.asarray(q, float)
    low, high = np.full(len(q), -745.0), np.full(len(q), np.log(a + 40 * np.sqrt(a) + 800))
    for _ in range(100):  # of the logarithm, as small shapes put quantiles next to 0
        middle = (low + high) / 2
        under = gamma_cdf(a, np.exp(middle)) < q
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return np.where(q <= 0, 0.0, np.where(q >= 1, np.inf, np.exp((low + high) / 2)))


@dataclass(frozen=True)
class Gamma:
    shape: float
    scale: float
    start: float = 0.0


def fit_gamma(values: DataFrame, column: str, start: float = 0.0) -> Gamma:
    """The likeliest gamma distribution of the values above ``start``, where it begins: one aggregation of three sums.

    The shape solves log(shape) - digamma(shape) = log(mean) - mean(log), by Newton's method. Null values and those up to
    ``start`` are left out; an error without two different values.
    """
    x = F.col(column) - float(start)
    n, mean, log = values.filter(x > 0).agg(F.count(x), F.avg(x), F.avg(F.log(x))).first()
    gap = float(np.log(mean) - log) if n else 0.0
    if not n or gap <= 1e-15:
        raise ValueError("a gamma distribution needs two different values")
    shape = (3 - gap + np.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        first, second = _digamma(np.array([shape]))
        step = float((np.log(shape) - first[0] - gap) / (1 / shape - second[0]))
        shape = shape - step if shape > step else shape / 2
        if abs(step) < 1e-14 * shape:
            break
    return Gamma(float(shape), float(mean / shape), start)


@dataclass(frozen=True)
class Codebook:
    """Bin edges (one more than levels) and the value that stands for each level."""

    edges: np.ndarray
    values: np.ndarray

    @staticmethod
    def of_gamma(gamma: Gamma, levels: int = 256) -> Codebook:
        """Bins that hold equal shares of the distribution, each shown by its median."""
        q = np.arange(levels + 1) / levels
        place = lambda share: gamma.start + gamma.scale * gamma_quantiles(gamma.shape, share)
        return Codebook(place(q), place(q[:-1] + 0.5 / levels))

    @staticmethod
    def linear(most: float, levels: int = 256) -> Codebook:
        """Equal bins from 0 to ``most``; the first begins a step earlier."""
        edges = np.linspace(0, most, levels + 1)
        middle = (edges[1:] + edges[:-1]) / 2
        edges[0] -= most / levels
        return Codebook(edges, middle)

    def encoded(self, column: Column, array: bool = False) -> Column:
        """The level of each value (a column, or an array of them): the bin edge[i] <= x < edge[i + 1]; values outside go to the
        first or the last, null stays null."""
        inner = self.edges[1:-1]

        def levels(x: np.ndarray) -> np.ndarray:
            return np.searchsorted(inner, x, "right")

        @F.pandas_udf("int")
        def one(x: pd.Series) -> pd.Series:
            return pd.Series(levels(x.to_numpy(float)), dtype="Int32").where(x.notna())

        @F.pandas_udf("array<int>")
        def many(x: pd.Series) -> pd.Series:
            values, own, _ = flat(x)
            got = np.split(levels(values).astype(np.int32), np.searchsorted(own, np.arange(1, len(x))))
            return pd.Series([None if a is None else b for a, b in zip(x, got, strict=True)])

        return (many if array else one)(column)

    def decoded(self, level: Column) -> Column:
        """The value that stands for a level; null for others."""
        return F.get(F.array(*[F.lit(float(v)) for v in self.values]), level)

    def density(self, counts: np.ndarray, normed: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(x, y): counts of the levels as a density over their values; its integral is 1 (``normed``) or the number counted.

        An edge at infinity counts as far from its level's value as the edge before it.
        """
        edges = np.where(np.isinf(self.edges), 2 * self.values[-1] - self.edges[-2], self.edges)
        y = counts / np.diff(edges)
        y = y / ((y[1:] + y[:-1]) / 2 * np.diff(self.values)).sum()
        return self.values, y if normed else y * counts.sum()
