"""A binding curve with a background fitted to measured enrichments by damped Gauss-Newton steps.

The prediction is log2((c / (c + 1 / Z) + b) / sum(f0 (c / (c + 1 / Z) + b))) for rows with an affinity Z, a share f0 of the
input, and a measured log2 enrichment. The common sum enters each residual, yet all that a step needs, the error included,
are sums over the rows of products without it: one aggregation a step, whose size is that of the parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utrflow.operators.arrays import added_up

#: Bounds of the concentration c and of the background b.
CONCENTRATION, BACKGROUND = (1e-3, 1e3), (1e-6, 10.0)


@dataclass(frozen=True)
class Curve:
    concentration: float
    background: float
    error: float
    steps: int


def _sums(rows: DataFrame, z: str, share: str, observed: str, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(mean squared error, half its gradient, its Gauss-Newton matrix) by the logarithms of (c, b): one aggregation."""
    c, b = float(np.exp(p[0])), float(np.exp(p[1]))

    def sums(part: pd.DataFrame) -> np.ndarray:
        x, f, y = (part[name].to_numpy(float) for name in (z, share, observed))
        bound = x * c / (x * c + 1)
        h = bound + b
        d = np.stack([bound * (1 - bound), np.full(len(h), b)])  # by log c and log b, of h
        a = d / h / np.log(2)  # of log2 h
        u = np.log2(h) - y
        return np.concatenate([[len(h), f @ h, u.sum(), u @ u], d @ f, a.sum(axis=1), a @ u, (a @ a.T).ravel()])

    n, total, u, uu, w0, w1, a0, a1, ua0, ua1, *products = added_up(rows, sums, 14)
    w = np.log2(total)
    m = np.array([w0, w1]) / total / np.log(2)  # of log2 of the common sum
    at, ua, aa = np.array([a0, a1]), np.array([ua0, ua1]), np.reshape(products, (2, 2))
    error = (uu - 2 * w * u + n * w * w) / n
    slope = (ua - w * at - m * u + n * w * m) / n
    return float(error), slope, (aa - np.outer(at, m) - np.outer(m, at) + n * np.outer(m, m)) / n


def fit_curve(rows: DataFrame, z: str = "z", share: str = "f0", observed: str = "lr", start: tuple[float, float] = (1.0, 1.0), steps: int = 60, tolerance: float = 1e-12) -> Curve:
    """The concentration and background with the least mean squared error, within their bounds.

    A step that raises the error is taken back and damped ten times more; one that lowers it loosens the damping. Rows with
    a null, or Z or share of 0, are left out; without rows the start comes back with error 0.
    """
    used = rows.filter((F.col(z) > 0) & (F.col(share) > 0) & F.col(observed).isNotNull()).select(z, share, observed)
    low, high = np.log([CONCENTRATION[0], BACKGROUND[0]]), np.log([CONCENTRATION[1], BACKGROUND[1]])
    p = np.clip(np.log(start), low, high)
    if used.isEmpty():
        return Curve(*map(float, np.exp(p)), 0.0, 0)
    error, slope, matrix = _sums(used, z, share, observed, p)
    damping, done = 1e-3, 0
    while done < steps and damping < 1e12:
        done += 1
        free = ~((p <= low) & (slope > 0) | (p >= high) & (slope < 0))
        if not free.any() or np.abs(slope[free]).max() < tolerance:
            break
        own = matrix[np.ix_(free, free)]
        move = np.zeros(2)
        move[free] = np.linalg.solve(own + damping * np.diag(np.diag(own) + 1e-12), -slope[free])
        trial = np.clip(p + np.clip(move, -3, 3), low, high)
        got = _sums(used, z, share, observed, trial)
        if got[0] <= error:
            little = error - got[0] < tolerance * error and np.abs(trial - p).max() < 1e-9
            p, (error, slope, matrix), damping = trial, got, max(damping / 10, 1e-12)
            if little:
                break
        else:
            damping *= 10
    return Curve(float(np.exp(p[0])), float(np.exp(p[1])), error, done)


def predicted(rows: DataFrame, curve: Curve, z: str = "z", share: str = "f0") -> DataFrame:
    """``rows`` with lr_predicted; null where Z or the share is null or 0. The common sum is over the rows that have both."""
    x = F.when((F.col(z) > 0) & (F.col(share) > 0), F.col(z) * curve.concentration)
    h = x / (x + 1) + curve.background
    total = rows.agg(F.sum(F.col(share) * h).alias("__w"))
    return rows.crossJoin(F.broadcast(total)).withColumn("lr_predicted", F.log2(h / F.col("__w"))).drop("__w")
