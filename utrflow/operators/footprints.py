"""Calibration of a motif's footprint: which window of the structure must be open for the protein to bind, and how open.

What is compared are profiles of the single bases' accessibility round the sites. Those of the bound samples are observed;
one is predicted for each window width, shift and scale from the input reads alone, by weighing them with the occupancy that
such a footprint gives. A pass over the input reads predicts the profiles of a whole grid of footprints and affinities.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utrflow.operators.arrays import added_up, flat
from utrflow.operators.fitting import CLIP

#: Bins of the logarithm of a read's Z, from 1e-12 to CLIP, of which free protein is found.
BINS, LOWEST = 2000, 1e-12


@dataclass(frozen=True)
class Footprint:
    """The window of ``k`` bases that begins ``shift`` bases after a site must be open, to the power of ``scale``; ``a0`` is the affinity."""

    k: int
    shift: int
    scale: float
    a0: float


@dataclass
class Reads:
    """Input reads with array columns: ``z`` (affinities by place, without structure), ``open1`` (accessibility of each base) and
    ``windows`` (by width k: the column of the accessibilities of windows of k bases).

    The first base of the first place stands at ``first`` in those arrays, which may begin before it.
    """

    table: DataFrame | None
    z: str
    open1: str
    windows: dict[int, str]
    first: int = 0

    @property
    def names(self) -> Reads:
        """The same without the table: what tasks get."""
        return replace(self, table=None)


def threshold(reads: DataFrame, z: str = "z", share: float = 1e-3) -> float:
    """The least Z of the reads that matter: ``share`` of the greatest; the median, if that would keep more than half of them."""
    top = reads.agg(F.max(z)).first()[0] or 0.0
    cut = share * top
    kept, median = reads.agg(F.avg((F.col(z) > cut).cast("double")), F.percentile_approx(z, 0.5, 10000)).first()
    return float(median) if (kept or 0.0) > 0.5 else float(cut)


def _shifted(values: np.ndarray, own: np.ndarray, at: np.ndarray, sizes: np.ndarray, starts: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The value ``by`` places after each place in its row's array, and whether there is one."""
    place = at + by
    good = (place >= 0) & (place < sizes[own])
    return np.where(good, values[np.where(good, starts[own] + place, 0)], 0.0) if len(values) else np.zeros(len(at)), good


class _Batch:
    """A batch's arrays side by side."""

    def __init__(self, part: pd.DataFrame, columns: list[str]):
        self.arrays = {}
        for c in columns:
            values, own, _ = flat(part[c])
            sizes = np.bincount(own, minlength=len(part))
            self.arrays[c] = (values, sizes, np.cumsum(sizes) - sizes)
        self.rows = len(part)

    def places(self, z: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, sizes, starts = self.arrays[z]
        own = np.repeat(np.arange(self.rows), sizes)
        return values, own, np.arange(len(values)) - starts[own]

    def near(self, column: str, own: np.ndarray, at: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        values, sizes, starts = self.arrays[column]
        return _shifted(values, own, at, sizes, starts, by)


def _around(batch: _Batch, reads: Reads, width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each read the sums of Z (its places that have ``pad`` others on either side), and of Z times each offset's accessibility."""
    z, own, at = batch.places(reads.z)
    sizes = batch.arrays[reads.z][1]
    inner = (at >= pad) & (at < sizes[own] - pad)
    z, own, at = z[inner], own[inner], at[inner]
    total = np.bincount(own, weights=z, minlength=batch.rows)
    around = np.stack([np.bincount(own, weights=z * batch.near(reads.open1, own, at, reads.first + d)[0], minlength=batch.rows) for d in range(-pad, width + pad)])
    return total, around


def observed_profile(reads: Reads, width: int, pad: int) -> np.ndarray:
    """Mean accessibility of the bases from ``pad`` before a site of ``width`` to ``pad`` after it, by the sites' Z. One pass."""
    span, names = width + 2 * pad, reads.names

    def sums(part: pd.DataFrame) -> np.ndarray:
        total, around = _around(_Batch(part, [names.z, names.open1]), names, width, pad)
        return np.append(around.sum(axis=1), total.sum())

    got = added_up(reads.table.select(reads.z, reads.open1), sums, span + 1)
    return got[:-1] / (got[-1] or 1.0)


def _opened(batch: _Batch, reads: Reads, grid: list[tuple[int, int, float]]) -> np.ndarray:
    """Z of each read by (k, shift, scale): the sum over its places of Z times the window's accessibility to the power of scale."""
    z, own, at = batch.places(reads.z)
    out, logs = np.empty((len(grid), batch.rows)), {}
    for g, (k, shift, scale) in enumerate(grid):
        if not k or not scale:
            weighed = z
        else:
            if (k, shift) not in logs:
                value, good = batch.near(reads.windows[k], own, at, reads.first + shift)
                with np.errstate(divide="ignore"):
                    logs[k, shift] = np.where(good, np.log(value), -np.inf)
            weighed = z * np.exp(scale * logs[k, shift])
        out[g] = np.minimum(np.bincount(own, weights=weighed, minlength=batch.rows), CLIP)
    return out


def _columns(reads: Reads, grid: list[tuple[int, int, float]]) -> list[str]:
    return sorted({reads.z, reads.open1, *(reads.windows[k] for k, _, _ in grid if k)})


def free_by_footprint(reads: Reads, points: list[Footprint], totals: list[float], rna: float) -> np.ndarray:
    """Free protein by footprint and sample: one pass that counts reads by the logarithm of the Z that each footprint gives."""
    grid = sorted({(p.k, p.shift, p.scale) for p in points})
    step, names = np.log(CLIP / LOWEST) / BINS, reads.names

    def sums(part: pd.DataFrame) -> np.ndarray:
        z = _opened(_Batch(part, columns), names, grid)
        out = np.zeros((2, len(grid), BINS))
        for g, own in enumerate(z):
            own = own[own > 0]
            at = np.clip(np.log(np.maximum(own, LOWEST) / LOWEST) / step, 0, BINS - 1).astype(np.int64)
            out[0, g] += np.bincount(at, minlength=BINS)
            out[1, g] += np.bincount(at, weights=own, minlength=BINS)
        return out.ravel()

    columns = _columns(reads, grid)
    n, z = added_up(reads.table.select(*columns), sums, 2 * len(grid) * BINS).reshape(2, len(grid), BINS)
    of, out = {g: i for i, g in enumerate(grid)}, np.empty((len(points), len(totals)))
    for i, p in enumerate(points):
        g = of[p.k, p.shift, p.scale]
        some = n[g] > 0
        mean, share = z[g][some] / n[g][some] * p.a0, n[g][some] / max(1.0, n[g].sum())
        low, high = np.zeros(len(totals)), np.array(totals, float)
        for _ in range(100):
            x = (low + high) / 2
            y = x[:, None] * mean
            over = x + rna * (share * y / (y + 1)).sum(axis=1) > totals
            low, high = np.where(over, low, x), np.where(over, x, high)
        out[i] = (low + high) / 2
    return out


def predicted_profiles(reads: Reads, points: list[Footprint], free: np.ndarray, width: int, pad: int) -> np.ndarray:
    """(footprint, sample, offset): the profile round sites of ``width`` that each footprint predicts, in one pass over the reads.

    A read's sites count by its occupancy: the free protein times its Z under the footprint.
    """
    grid = sorted({(p.k, p.shift, p.scale) for p in points})
    of, span = {g: i for i, g in enumerate(grid)}, width + 2 * pad
    columns, names = _columns(reads, grid), reads.names

    def sums(part: pd.DataFrame) -> np.ndarray:
        batch = _Batch(part, columns)
        total, around = _around(batch, names, width, pad)
        z = _opened(batch, names, grid)
        out = np.empty((len(points), free.shape[1], span + 1))
        for i, p in enumerate(points):
            x = free[i][:, None] * p.a0 * z[of[p.k, p.shift, p.scale]]
            psi = x / (x + 1)
            out[i, :, :-1], out[i, :, -1] = psi @ around.T, psi @ total
        return out.ravel()

    got = added_up(reads.table.select(*columns), sums, len(points) * free.shape[1] * (span + 1)).reshape(len(points), free.shape[1], span + 1)
    return got[..., :-1] / np.where(got[..., -1:] > 0, got[..., -1:], 1)


@dataclass
class Fit:
    """A footprint, its squared error against the observed profiles, the profiles that it predicts, and the error without any structure."""

    footprint: Footprint
    error: float
    profiles: np.ndarray
    plain: float


def errors_of(reads: Reads, points: list[Footprint], observed: np.ndarray, totals: list[float], rna: float, width: int, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The squared errors of many footprints and the profiles that they predict, by two passes."""
    got = predicted_profiles(reads, points, free_by_footprint(reads, points, totals, rna), width, pad)
    return ((got - observed) ** 2).sum(axis=(1, 2)), got


def calibrated(reads: Reads, observed: np.ndarray, totals: list[float], rna: float, width: int, pad: int, a0: float = 1.0, ks: list[int] | None = None, shifts: dict[int, list[int]] | None = None, scales: tuple[float, float] = (0.0, 1.0), affinities: tuple[float, float] = (1e-4, 1e3), points: int = 5, rounds: int = 6) -> list[Fit]:
    """The best scale and affinity for each (k, shift), best first; the last is the model without structure, at ``a0``.

    ``observed`` are the bound samples' profiles, by sample and offset. Scale and (logarithmic) affinity are searched for
    within their bounds on a grid of ``points`` x ``points``, which then closes in on each (k, shift)'s best cell: each of
    the ``rounds`` evaluates all windows' grids by the same two passes over the reads.
    """
    ks = sorted(reads.windows) if ks is None else ks
    windows = [(k, s) for k in ks for s in (shifts[k] if shifts else range(-pad, max(width - k + 1 + pad, 2)))]
    plain_error, plain = errors_of(reads, [Footprint(0, 0, 0.0, a0)], observed, totals, rna, width, pad)
    box = {w: (scales, (np.log(affinities[0]), np.log(affinities[1]))) for w in windows}
    best: dict[tuple[int, int], Fit] = {}
    for _ in range(rounds):
        trial = [Footprint(k, s, float(x), float(np.exp(y))) for (k, s), (xs, ys) in box.items() for x in np.linspace(*xs, points) for y in np.linspace(*ys, points)]
        errors, profiles = errors_of(reads, trial, observed, totals, rna, width, pad)
        for p, e, own in zip(trial, errors, profiles, strict=True):
            if (p.k, p.shift) not in best or e < best[p.k, p.shift].error:
                best[p.k, p.shift] = Fit(p, float(e), own, float(plain_error[0]))
        for w, (xs, ys) in box.items():
            p = best[w].footprint
            dx, dy = (xs[1] - xs[0]) / (points - 1), (ys[1] - ys[0]) / (points - 1)
            y = np.log(p.a0)
            box[w] = ((max(scales[0], p.scale - dx), min(scales[1], p.scale + dx)), (max(np.log(affinities[0]), y - dy), min(np.log(affinities[1]), y + dy)))
    none = Fit(Footprint(0, 0, 0.0, a0), float(plain_error[0]), plain[0], float(plain_error[0]))
    return sorted(best.values(), key=lambda f: (f.error, f.footprint.k, f.footprint.shift)) + [none]
