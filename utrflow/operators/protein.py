"""Free protein from all reads' Z, without a histogram between."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utrflow.operators.arrays import added_up


@dataclass(frozen=True)
class Free:
    """The free concentration lies between ``low`` and ``high``, found in ``passes`` passes over the reads."""

    total: float
    low: float
    high: float
    passes: int

    @property
    def value(self) -> float:
        return (self.low + self.high) / 2

    @property
    def error(self) -> float:
        return (self.high - self.low) / 2


def exact_free(reads: DataFrame, totals: list[float], rna: float, z: str = "z", scale: float = 1.0, points: int = 64, width: float = 1e-12, passes: int = 40) -> list[Free]:
    """For each total the free concentration p with p + rna * mean(p Z s / (p Z s + 1)) = total, over reads with Z > 0.

    The left side grows with p, so each pass over the reads tries ``points`` values within the bracket of every total at once
    and keeps the two that enclose the root: a bracket is ``points`` + 1 times narrower after each, and ends at ``width`` of
    its total (seven passes by default) or where doubles end. Without any Z > 0 all protein is free.
    """
    used = reads.filter(F.col(z) > 0).select((F.col(z) * float(scale)).alias("z"))
    brackets = np.array([(0.0, float(t)) for t in totals])
    done = 0
    while done < passes and (np.diff(brackets)[:, 0] > width * np.asarray(totals)).any():
        trial = np.array([np.linspace(lo, hi, points + 2)[1:-1] for lo, hi in brackets])

        def bound(part: pd.DataFrame, p: np.ndarray = trial.ravel()) -> np.ndarray:
            out = np.zeros(len(p) + 1)
            for own in np.array_split(part["z"].to_numpy(float), len(part) // 4096 + 1):
                x = own[:, None] * p
                out[:-1] += (x / (x + 1)).sum(axis=0)
            out[-1] = len(part)
            return out

        sums = added_up(used, bound, trial.size + 1)
        done += 1
        if not sums[-1]:
            return [Free(float(t), float(t), float(t), done) for t in totals]
        over = trial + rna * (sums[:-1] / sums[-1]).reshape(trial.shape) > np.asarray(totals, float)[:, None]
        ends = np.hstack([brackets[:, :1], trial, brackets[:, 1:]])
        first = np.where(over.any(axis=1), over.argmax(axis=1), points)  # the first trial beyond the root
        narrower = np.stack([ends[np.arange(len(ends)), first], ends[np.arange(len(ends)), first + 1]], axis=1)
        if np.array_equal(narrower, brackets):
            break
        brackets = narrower
    return [Free(float(t), float(lo), float(hi), done) for t, (lo, hi) in zip(totals, brackets, strict=True)]
