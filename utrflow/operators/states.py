"""What a binding model says about its samples at given parameters: occupancies, weights, backgrounds, errors, estimators.

Reads carry z, the affinity relative to the strongest motif; a0 scales it. A pass over the reads gives the sums q of
occupancies by k-mer for many a0 at once; everything else is arithmetic on vectors of 4^k numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utrflow.operators.arrays import added_up
from utrflow.operators.fitting import CLIP, _by_length, _codes, _kmers_of, best_beta, free_protein, z_histogram
from utrflow.operators.regression import correlation_p


@dataclass(frozen=True)
class Samples:
    """Total protein by sample, RNA, the input's k-mer counts by number, and the observed enrichments (sample, k-mer)."""

    totals: list[float]
    rna: float
    counts: np.ndarray
    observed: np.ndarray
    k: int

    @property
    def shares(self) -> np.ndarray:
        return self.counts / self.counts.sum()

    @property
    def used(self) -> np.ndarray:
        return self.counts > 0

    def outstanding(self, cut: float = 3.5) -> np.ndarray:
        """The k-mers whose observed enrichment lies so many deviations above a sample's mean, in any sample."""
        r = self.observed
        return np.flatnonzero(((r - r.mean(axis=1, keepdims=True)) / r.std(axis=1, keepdims=True) > cut).any(axis=0))


def bound_kmers(reads: DataFrame, scales: np.ndarray, k: int) -> np.ndarray:
    """(scale, k-mer): sums of the occupancies x / (x + 1), x = scale * z, over the k-mers of all reads (seq, z). One pass."""
    scales, size = np.asarray(scales, float).ravel(), 4**k + 1

    def sums(part: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(scales), size))
        for n, rows in part.groupby(part["seq"].str.len()):
            if n >= k:
                index = _kmers_of(_codes(rows["seq"]), k)
                x = np.minimum(rows["z"].to_numpy(float), CLIP)
                for i, c in enumerate(scales):
                    out[i] += np.bincount(index.ravel(), weights=np.repeat(c * x / (c * x + 1), index.shape[1]), minlength=size)
        return out.ravel()

    used = reads.select("seq", "z").filter("seq is not null and z is not null")
    return added_up(used, sums, scales.size * size).reshape(len(scales), size)[:, :-1]


def kmer_counts(reads: DataFrame, k: int) -> np.ndarray:
    """How often each k-mer occurs, by number."""

    def sums(part: pd.DataFrame) -> np.ndarray:
        return _by_length(part, k, lambda x: np.bincount(_kmers_of(x, k).ravel(), minlength=4**k + 1).astype(float), 4**k + 1)

    return added_up(reads.select("seq").filter("seq is not null"), sums, 4**k + 1)[:-1]


@dataclass
class State:
    """By sample: free protein, background, sums q of occupancies by k-mer, enrichments."""

    a0: float
    free: np.ndarray
    betas: np.ndarray
    q: np.ndarray
    samples: Samples

    @property
    def weights(self) -> np.ndarray:
        return self.q + self.samples.counts * self.betas[:, None]

    @property
    def enriched(self) -> np.ndarray:
        """Null (nan) for k-mers that the input doesn't hold: they are left out of errors and correlations."""
        w, used = self.weights, self.samples.used
        return np.where(used, w / np.where(used, self.samples.shares, 1) / w.sum(axis=1, keepdims=True), np.nan)

    @property
    def sample_errors(self) -> np.ndarray:
        return np.nanmean((self.enriched - self.samples.observed) ** 2, axis=1)

    @property
    def error(self) -> float:
        return float(self.sample_errors.mean())

    def correlations(self) -> list[tuple[float, float]]:
        """By sample (r, two-sided p) of the logarithms of predicted and observed enrichments."""
        out = []
        used = self.samples.used
        for r, r0 in zip(np.log2(self.enriched[:, used]), np.log2(self.samples.observed[:, used]), strict=True):
            c = float(np.corrcoef(r, r0)[0, 1])
            out.append((c, correlation_p(c, len(r))))
        return out

    def concentrations(self, reads: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(specific complex, unspecific RNA, complex as total less free protein) in the unit of the RNA, for so many reads of so
        many k-mers each."""
        one = self.samples.rna / (reads * places)
        q = self.q.sum(axis=1)
        return q * one, (self.weights.sum(axis=1) - q) * one, np.asarray(self.samples.totals) - self.free

    def beta_estimators(self) -> np.ndarray:
        """(sample, k-mer): the background with which each k-mer alone would be as enriched as observed."""
        r, n = self.samples.observed, np.where(self.samples.used, self.samples.counts, np.nan)
        return (r * self.samples.shares * self.q.sum(axis=1, keepdims=True) - self.q) / (n * (1 - r))

    def a0_estimators(self) -> np.ndarray:
        """(sample, k-mer): the a0 that it alone would ask for, were occupancies proportional to it."""
        r, n, q = self.samples.observed, np.where(self.samples.used, self.samples.counts, np.nan), self.q / self.a0
        return self.betas[:, None] * n * (1 - r) / (q.sum(axis=1, keepdims=True) * r * self.samples.shares - q)


def best_betas(q: np.ndarray, samples: Samples) -> np.ndarray:
    """The background of each sample with the least error, from 1e-8 to 10."""
    used, total = samples.used, samples.counts.sum()
    return np.array([best_beta(row[used], samples.shares[used], r[used], 1e-8 * total, 10 * total) / total for row, r in zip(q, samples.observed, strict=True)])


def states(reads: DataFrame, a0s: list[float], samples: Samples, betas: np.ndarray | None = None, free: np.ndarray | None = None, histogram: pd.DataFrame | None = None) -> list[State]:
    """A state for each a0, by one pass over the reads (and two for the histogram of z, unless it or the free protein is given).

    Without ``betas`` each sample gets the background that fits best.
    """
    if free is None:
        histogram = z_histogram(reads, "z") if histogram is None else histogram
        free = np.array([[free_protein(histogram.assign(z=histogram["z"] * a), t, samples.rna) for t in samples.totals] for a in a0s])
    q = bound_kmers(reads, free * np.asarray(a0s)[:, None], samples.k).reshape(len(a0s), len(samples.totals), -1)
    return [State(a, p, best_betas(own, samples) if betas is None else np.asarray(betas, float), own, samples) for a, p, own in zip(a0s, free, q, strict=True)]


def fit_a0(reads: DataFrame, samples: Samples, start: float, low: float = 1e-4, high: float = 1e3, points: int = 7, rounds: int = 6) -> tuple[State, list[tuple[float, float]]]:
    """(state, all (a0, error) tried): the affinity alone fitted, the motif held fixed, with the best backgrounds.

    Each round tries ``points`` values evenly in the logarithm by one pass, then closes in on the best one's neighbours. If the
    best lies at a bound, the data don't tell it: the state of ``start`` comes back.
    """
    histogram, tried, best = z_histogram(reads, "z"), [], None
    a, b = np.log(low), np.log(high)
    for _ in range(rounds):
        x = np.linspace(a, b, points)
        found = states(reads, list(np.exp(x)), samples, histogram=histogram)
        tried += [(s.a0, s.error) for s in found]
        i = int(np.argmin([s.error for s in found]))
        if best is None or found[i].error < best.error:
            best = found[i]
        a, b = x[max(0, i - 1)], x[min(points - 1, i + 1)]
    inside = low * (1 + 1e-9) < best.a0 < high * (1 - 1e-9)
    return (best if inside else states(reads, [start], samples, histogram=histogram)[0]), sorted(tried)


def a0_slope(reads: DataFrame, state: State) -> float:
    """The derivative of the error by a0, free protein and backgrounds held, by one pass: each k-mer's occupancies grow by
    psi (1 - psi) / a0."""
    s = state.samples
    scales = state.free * state.a0

    def sums(part: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(scales), 4**s.k + 1))
        for n, rows in part.groupby(part["seq"].str.len()):
            if n >= s.k:
                index = _kmers_of(_codes(rows["seq"]), s.k)
                z = np.minimum(rows["z"].to_numpy(float), CLIP)
                for i, c in enumerate(scales):
                    psi = c * z / (c * z + 1)
                    out[i] += np.bincount(index.ravel(), weights=np.repeat(psi - psi**2, index.shape[1]), minlength=out.shape[1])
        return out.ravel()

    used = reads.select("seq", "z").filter("seq is not null and z is not null")
    d_q = added_up(used, sums, len(scales) * (4**s.k + 1)).reshape(len(scales), -1)[:, :-1] / state.a0
    total, r = state.weights.sum(axis=1, keepdims=True), state.enriched[:, s.used]
    d_r = (d_q[:, s.used] / s.shares[s.used] - r * d_q.sum(axis=1, keepdims=True)) / total
    return float((2 * (r - s.observed[:, s.used]) * d_r).mean(axis=1).mean())


def against_known(known: DataFrame, observed: str = "kd", predicted: str = "predicted") -> DataFrame:
    """(n, r, rho, lowest, median, highest): how predicted dissociation constants go with measured ones: correlations of the
    logarithms and of the ranks, and log10 of predicted over measured. Rows with a null or a value of 0 or less are left out."""
    from utrflow.operators.regression import spearman

    used = known.filter((F.col(observed) > 0) & (F.col(predicted) > 0)).select(F.log10(observed).alias("x"), F.log10(predicted).alias("y"))
    gap = F.col("y") - F.col("x")
    plain = used.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.min(gap).alias("lowest"), F.percentile(gap, F.lit(0.5)).alias("median"), F.max(gap).alias("highest"))
    return plain.crossJoin(F.broadcast(spearman(used, "x", "y")))
