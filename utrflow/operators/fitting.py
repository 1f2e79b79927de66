"""Binding models of reads: free protein, occupancy, predicted enrichment, and the descent that fits them.

Reads are only touched by Spark aggregations: histograms of Z and, for each step of the descent, one pass that gives sums
of the size of the parameters. The driver holds parameters and those sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from utrflow.functions.measures import occupancy
from utrflow.operators import descent
from utrflow.operators.arrays import added_up, portions, small_batches
from utrflow.operators.kmers import counts
from utrflow.plans.storage import release, written

CLIP = 1e6


def z_histogram(reads: DataFrame, z: str, bins: int = 1000) -> pd.DataFrame:
    """(z, n): reads with Z > 0 in at most about ``bins`` bins of equal log width, each at its mean Z."""
    used = reads.filter(F.col(z) > 0).withColumn("__l", F.log(F.least(F.col(z), F.lit(CLIP))))
    ends = used.agg(F.min("__l").alias("lo"), F.max("__l").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    return used.crossJoin(F.broadcast(ends)).groupBy(F.when(step > 0, F.least(F.floor((F.col("__l") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0).alias("bin")).agg(F.avg(F.exp("__l")).alias("z"), F.count(F.lit(1)).alias("n")).select("z", "n").toPandas()


def free_protein(hist: pd.DataFrame, total: float, rna: float, rounds: int = 200) -> float:
    """The free concentration p that with the bound part, rna * mean(p Z / (p Z + 1)), gives the total. By bisection."""
    z, share = hist["z"].to_numpy(float), hist["n"].to_numpy(float) / max(1.0, hist["n"].sum())
    lo, hi = 0.0, total
    for _ in range(rounds):
        p = (lo + hi) / 2
        if p + rna * float((share * p * z / (p * z + 1)).sum()) > total:
            hi = p
        else:
            lo = p
    return (lo + hi) / 2


def predicted_ratios(reads: DataFrame, k: int, psi: Column, beta: float, frequencies: DataFrame) -> DataFrame:
    """(kmer, r): enrichment that occupancies predict: w = q + f0 * beta, r = w / f0 / sum(w); frequencies (kmer, f0) sum to 1."""
    q = counts(reads, k, weight=psi).withColumnRenamed("n", "q")
    w = frequencies.join(q, "kmer", "left").withColumn("w", F.coalesce("q", F.lit(0.0)) + F.col("f0") * beta)
    total = w.agg(F.sum("w").alias("t"))
    return w.crossJoin(F.broadcast(total)).select("kmer", (F.col("w") / F.col("f0") / F.col("t")).alias("r"))


def squared_error(predicted: DataFrame, observed: DataFrame) -> float:
    return predicted.withColumnRenamed("r", "p").join(observed, "kmer").agg(F.avg(F.pow(F.col("p") - F.col("r"), F.lit(2)))).first()[0]


def golden(f: Callable[[float], float], lo: float, hi: float, rounds: int = 60) -> tuple[float, float]:
    """(x, f(x)) of the least value in [lo, hi], for a function with one valley."""
    g = (np.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (a, fa) if fa < fb else (b, fb)


def log_search(f: Callable[[float], float], lo: float, hi: float, points: int = 9) -> tuple[float, float]:
    """The least value over a logarithmic grid, then within the best point's neighbours."""
    x = np.geomspace(lo, hi, points)
    y = [f(v) for v in x]
    i = int(np.argmin(y))
    return golden(lambda v: f(float(np.exp(v))), np.log(x[max(0, i - 1)]), np.log(x[min(points - 1, i + 1)]), 30)


def best_beta(q: np.ndarray, f0: np.ndarray, observed: np.ndarray, lo: float = 1e-8, hi: float = 1.0) -> float:
    """The background that fits best: the error is a function of one number, of sums that are on the driver."""
    def error(beta: float) -> float:
        w = q + f0 * beta
        return float(((w / f0 / w.sum() - observed) ** 2).mean())

    v, _ = log_search(error, lo, hi)
    return float(np.exp(v))


@dataclass
class Model:
    """Motifs with affinities (per nM), and the background of each sample."""

    weights: list[np.ndarray]
    a0: np.ndarray
    betas: np.ndarray

    def vector(self) -> np.ndarray:
        return np.concatenate([*(w.ravel() for w in self.weights), self.a0, self.betas])

    def like(self, v: np.ndarray) -> Model:
        """The model of a parameter vector: weights at least 1e-6 and at most 1 by row, the rows' factors taken into a0."""
        at, weights, a0 = 0, [], []
        n = sum(w.size for w in self.weights)
        for i, w in enumerate(self.weights):
            m = np.maximum(v[at : at + w.size].reshape(w.shape), 1e-6)
            top = m.max(axis=1)
            weights.append(m / top[:, None])
            a0.append(max(v[n + i], 1e-12) * top.prod())
            at += w.size
        a0 = np.maximum(a0, max(a0) * 1e-4)
        return Model(weights, np.array(a0), np.maximum(v[n + len(a0) :], 1e-12))


_LETTERS = np.full(256, 4, np.int64)
for _i, _same in enumerate(("Aa", "Cc", "Gg", "TUtu")):
    _LETTERS[[ord(c) for c in _same]] = _i


def _codes(seqs: pd.Series) -> np.ndarray:
    return _LETTERS.astype(np.uint8)[np.frombuffer("".join(seqs).encode("ascii", "replace"), np.uint8)].reshape(len(seqs), -1)


def _sites(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    m = np.hstack([w, np.zeros((len(w), 1))])
    z = np.ones((len(x), max(0, x.shape[1] - len(w) + 1)))
    for d in range(len(w)):
        z *= m[d][x[:, d : d + z.shape[1]]]
    return z


#: Motifs of up to so many rows have a table of the products of all windows (5^6 numbers, with other letters).
TABLED = 6


class _Portion:
    """The bases of a portion's reads one after another, each read ended by a letter that is no base, so that a window has
    a place for each letter and none across reads counts."""

    def __init__(self, seqs: pd.Series) -> None:
        self.x = _LETTERS[np.frombuffer("\n".join([*seqs, ""]).encode("ascii", "replace"), np.uint8)]
        lengths = np.array([len(q) + 1 for q in seqs], np.int64)
        self.reads, self.start = len(lengths), np.cumsum(lengths) - lengths
        self.own = np.repeat(np.arange(len(lengths)), lengths)
        self.numbers: dict[int, np.ndarray] = {}

    def at(self, d: int) -> np.ndarray:
        """The letters d places on."""
        return np.concatenate([self.x[d:], np.full(min(d, len(self.x)), 4)])

    def sites(self, w: np.ndarray) -> np.ndarray:
        """The product of the motif by place."""
        m = np.hstack([w, np.zeros((len(w), 1))])
        if len(w) > TABLED:
            z = np.ones(len(self.x))
            for d in range(len(w)):
                z *= m[d][self.at(d)]
            return z
        if len(w) not in self.numbers:
            number = np.zeros(len(self.x), np.int64)
            for d in range(len(w)):
                number = number * 5 + self.at(d)
            self.numbers[len(w)] = number
        table = np.ones(1)
        for row in m:
            table = np.outer(table, row).ravel()
        return table[self.numbers[len(w)]]

    def summed(self, values: np.ndarray) -> np.ndarray:
        """The sums by read of a number by place."""
        return np.add.reduceat(values, self.start) if self.reads else np.zeros(0)

    def affinity(self, m: Model) -> np.ndarray:
        return np.minimum(sum((a * self.summed(self.sites(w)) for a, w in zip(m.a0, m.weights, strict=True)), np.zeros(self.reads)), CLIP)

    def kmers(self, k: int) -> np.ndarray:
        """The numbers of k-mers by place; 4^k where a letter isn't a base."""
        return _kmers_of(np.concatenate([self.x, np.full(k - 1, 4)])[None], k)[0]

    def counts(self, k: int) -> np.ndarray | None:
        """(read, k-mer): how often; None where this would be far more numbers than letters."""
        size = 4**k + 1
        if self.reads * size > 4 * len(self.x):
            return None
        return np.bincount(self.own * size + self.kmers(k), minlength=self.reads * size).reshape(self.reads, size).astype(float)

    def by_kmer(self, values: np.ndarray, k: int) -> np.ndarray:
        """(row, k-mer): the sums over the k-mers of all reads of each row's numbers by read."""
        own = self.counts(k)
        if own is not None:
            return values @ own
        index = self.kmers(k)
        return np.array([np.bincount(index, weights=v[self.own], minlength=4**k + 1) for v in values])

    def of_kmers(self, worth: np.ndarray, k: int) -> np.ndarray:
        """(row, read): the sums over a read's k-mers of each row's numbers by k-mer."""
        own = self.counts(k)
        if own is not None:
            return worth @ own.T
        index = self.kmers(k)
        return np.array([self.summed(v[index]) for v in worth])


def read_affinity(reads: DataFrame, model: Model, seq: str = "seq") -> DataFrame:
    """``reads`` with z: the sum over motifs and places of a0 * product (clipped), in Arrow batches."""
    shared = reads.sparkSession.sparkContext.broadcast(model)
    small_batches(reads.sparkSession)

    @F.pandas_udf("double")
    def z(own: pd.Series) -> pd.Series:
        parts = portions(iter([own.fillna("").to_frame("seq")]))
        return pd.Series(np.concatenate([np.zeros(0), *(_Portion(p["seq"]).affinity(shared.value) for p in parts if len(p))]))

    return reads.withColumn("z", z(F.col(seq)))


def _kmers_of(x: np.ndarray, k: int) -> np.ndarray:
    """The numbers of a batch's k-mers by read and place; 4^k where a letter isn't a base."""
    n = x.shape[1] - k + 1
    index, bad = np.zeros((len(x), n), np.int64), np.zeros((len(x), n), bool)
    for d in range(k):
        index = index * 4 + x[:, d : d + n]
        bad |= x[:, d : d + n] > 3
    index[bad] = 4**k
    return index


def _by_length(part: pd.DataFrame, k: int, make: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    total = np.zeros(length)
    for n, rows in part["seq"].groupby(part["seq"].str.len()):
        if n >= k:
            total += make(_codes(rows))
    return total


def _bound_kmers(reads: DataFrame, models: list[Model], free: list[float], k: int) -> np.ndarray:
    """(model, sample, k-mer): sums over the reads of each model's occupancy, by the k-mers that a read holds. One pass."""
    size = 4**k + 1
    shared = reads.sparkSession.sparkContext.broadcast((models, free))

    def weigh(part: pd.DataFrame) -> np.ndarray:
        own, p = shared.value
        x = _Portion(part["seq"])
        z = np.array([x.affinity(m) for m in own])[:, None, :] * np.array(p)[:, None]  # by model, sample and read
        return x.by_kmer((z / (z + 1)).reshape(-1, x.reads), k).ravel()

    n = len(models) * len(free) * size
    return added_up(reads.select("seq").filter("seq is not null"), weigh, n).reshape(len(models), len(free), size)[..., :-1]


def _predicted(q: np.ndarray, model: Model, f0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Enrichments by sample and k-mer, and the sums of the weights by sample."""
    w = q + f0 * model.betas[:, None]
    total = w.sum(axis=1, keepdims=True)
    return w / f0 / total, total


def trial_errors(reads: DataFrame, models: list[Model], free: list[float], k: int, f0: np.ndarray, observed: np.ndarray) -> list[float]:
    """The mean squared errors of many models by one pass over the reads."""
    return [float(((_predicted(q, m, f0)[0] - observed) ** 2).mean()) for q, m in zip(_bound_kmers(reads, models, free, k), models, strict=True)]


def gradient(reads: DataFrame, model: Model, free: list[float], k: int, f0: np.ndarray, observed: np.ndarray, slope: bool = True) -> tuple[float, np.ndarray | None]:
    """(error, its gradient by the parameter vector; None without ``slope``, which spares a pass) over samples (rows of ``observed``, by all 4^k k-mers).

    Two passes over the reads, each a sum of arrays made in Arrow batches: the k-mer sums q, which give the error and
    what a read's occupancy is worth; then the chain rule through occupancy and affinity. Free protein is held fixed.
    """
    samples = len(free)
    sc = reads.sparkSession.sparkContext
    shared = sc.broadcast((model, free))
    r, total = _predicted(_bound_kmers(reads, [model], free, k)[0], model, f0)
    if not slope:
        return float(((r - observed) ** 2).mean()), None
    d_r = 2 * (r - observed) / r.size
    d_w = d_r / f0 / total - (d_r * r).sum(axis=1, keepdims=True) / total
    worth = sc.broadcast(np.hstack([d_w, np.zeros((samples, 1))]))
    n = sum(x.size for x in model.weights)

    def chain(part: pd.DataFrame) -> np.ndarray:
        m, p = shared.value
        x = _Portion(part["seq"])
        z = x.affinity(m)
        d_z = sum(v * c / (z * c + 1) ** 2 for v, c in zip(x.of_kmers(worth.value, k), p, strict=True))
        d_z = np.where(z >= CLIP, 0, d_z)[x.own]
        out, at = np.zeros(n + len(m.a0)), 0
        for i, (a, wt) in enumerate(zip(m.a0, m.weights, strict=True)):
            site = d_z * x.sites(wt)
            for d in range(len(wt)):
                out[at + 4 * d : at + 4 * d + 4] = a * np.bincount(x.at(d), weights=site, minlength=5)[:4] / wt[d]
            out[n + i] = site.sum()
            at += wt.size
        return out

    length = n + len(model.a0)
    slopes = added_up(reads.select("seq").filter("seq is not null"), chain, length)
    return float(((r - observed) ** 2).mean()), np.concatenate([slopes, (d_w * f0).sum(axis=1)])


def converged(errors: list[float], way: np.ndarray | None, slope: float, trend: int, least: float = 1e-7) -> bool:
    """Whether the error or the averaged gradient is next to nothing, or the error's linear decrease over the last ``trend``
    steps is below ``slope`` of the first error."""
    return descent.converged(errors, way, slope, trend, least) is not None


def descend(reads: DataFrame, model: Model, totals: list[float], rna: float, k: int, f0: np.ndarray, observed: np.ndarray, steps: int = 500, keep: float = 0.5, slope: float = 1e-6, trend: int = 13, path: str | None = None) -> tuple[Model, list[float]]:
    """(model, errors by step) of ``descent.descend`` over the reads, with the free protein of each step's model.

    A step takes four passes over the reads: one for free protein, whose Z are written, two for the gradient, and one for all
    trial steps.
    """
    free: list[float] = []

    def evaluate(one: Model) -> tuple[float, np.ndarray]:
        z = written(read_affinity(reads, one).select("z"), "affinities")
        hist = z_histogram(z, "z")
        release(z)
        free[:] = [free_protein(hist, t, rna) for t in totals]
        return gradient(reads, one, free, k, f0, observed)

    found = descent.descend(model, evaluate, lambda trials: trial_errors(reads, trials, free, k, f0, observed), steps, keep, slope, trend, reads.sparkSession, path)
    return found.model, found.errors


def occupancy_at(z: str, free: Column | float) -> Column:
    """The occupancy of a read by its Z, clipped, at a free concentration."""
    return occupancy(F.least(F.col(z), F.lit(CLIP)), free)


def parameter_errors(history: DataFrame, tolerance: float = 0.05, least: int = 10) -> DataFrame:
    """(parameter, lo, mid, hi): quartiles over the steps (step, error, parameter, value) whose error is near the last one's.

    At least ``least`` steps, the best, are taken.
    """
    last = history.agg(F.min_by("error", -F.col("step")).alias("reference"))
    steps = history.select("step", "error").distinct()

    near = steps.withColumn("n", F.row_number().over(Window.orderBy("error", "step"))).crossJoin(F.broadcast(last)).filter((F.col("error") <= F.col("reference") * (1 + tolerance)) | (F.col("n") <= least)).select("step")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return history.join(F.broadcast(near), "step").groupBy("parameter").agg(q.alias("q")).select("parameter", F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"))


def footprint(reads: DataFrame, k: int, pad: int, z: str = "z_sites", acc: str = "acc", weight: Column | None = None) -> DataFrame:
    """(d, p): accessibility at offsets -pad to k + pad - 1 round sites, weighted by their Z: sum(Z acc w) / sum(Z w).

    ``z_sites`` has a value per place, ``acc`` one per base; offsets outside a read are left out.
    """
    w = weight if weight is not None else F.lit(1.0)
    cells = F.flatten(F.transform(F.col(z), lambda v, i: F.transform(F.sequence(F.lit(-pad), F.lit(k + pad - 1)), lambda d: F.struct(d.alias("d"), v.alias("z"), F.when(i + d >= 0, F.get(F.col(acc), i + d)).alias("a")))))
    return reads.select(F.explode(cells).alias("c"), w.alias("w")).filter("c.a is not null").groupBy("c.d").agg((F.sum(F.col("c.z") * F.col("c.a") * F.col("w")) / F.sum(F.col("c.z") * F.col("w"))).alias("p"))


def calibrate(grid: list[tuple[int, int]], error: Callable[[int, int, float, float], float], scales: tuple[float, float] = (0.05, 2.0)) -> tuple[int, int, float, float]:
    """(acc_k, shift, scale, error) of the least error over the grid, the scale searched for at each point."""
    best = min((log_search(lambda a, k=k, s=s: error(k, s, a, 1.0), *scales)[::-1], k, s) for k, s in grid)
    return best[1], best[2], float(np.exp(best[0][1])), best[0][0]
