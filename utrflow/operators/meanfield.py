"""The mean-field binding model: k-mers, not reads, hold the protein.

All that it asks of the reads is one table, how often a k-mer stands near another. Its error and its gradient are sums over
that table (at most 16^k rows, whatever the number of reads); on the driver are vectors of 4^k numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utrflow.functions.sequence import kmer_index
from utrflow.operators.arrays import added_up
from utrflow.operators.fitting import Model
from utrflow.operators.kmers import counts, crosstalk
from utrflow.plans.storage import written

#: Vectors of 4^k numbers go to the driver and to each task: up to so long a k-mer (16,384 numbers).
LONGEST = 7


@dataclass
class Neighbours:
    """(a, b, m): how many k-mers b begin near one a; and the share of each k-mer among all."""

    table: DataFrame
    shares: np.ndarray
    k: int


def neighbours(reads: DataFrame, k: int) -> Neighbours:
    """From reads (read_id, seq): pairs that begin less than k, or k, bases apart, over a's occurrences; written once.

    K-mers with other letters than bases are left out. Each k-mer that occurs is near itself.
    """
    if k > LONGEST:
        raise ValueError(f"k-mers of more than {LONGEST} bases don't fit")
    number = lambda c: kmer_index(F.col(c)).cast("int")
    own = counts(reads, k).select(number("kmer").alias("a"), F.col("n").alias("of_a"))
    pairs = crosstalk(reads, k, k).select(number("a").alias("a"), number("b").alias("b"), "n").filter("a is not null and b is not null")
    table = written(pairs.join(own, "a").select("a", "b", (F.col("n") / F.col("of_a")).alias("m")), "neighbours")
    f0 = np.zeros(4**k)
    for r in own.collect():  # 4^k rows at most
        f0[r["a"]] = r["of_a"]
    return Neighbours(table, f0 / max(1.0, f0.sum()), k)


def affinities(model: Model) -> np.ndarray:
    """a0 * product of weights of all 4^k k-mers, by number."""
    out = np.ones(1)
    for row in model.weights[0]:
        out = np.multiply.outer(out, row).ravel()
    return out * model.a0[0]


@dataclass
class State:
    """What a model says: affinities by k-mer; occupancies, weights and enrichments by sample and k-mer; the mean squared error."""

    model: Model
    affinity: np.ndarray
    occupied: np.ndarray
    weight: np.ndarray
    enriched: np.ndarray
    error: float


def states(near: Neighbours, models: list[Model], free: list[float], observed: np.ndarray) -> list[State]:
    """All models by one pass over the neighbours: w = f0 (sum of m occupied + beta), r = w / sum(w) / f0.

    K-mers that no read holds (f0 = 0) are left out of the error.
    """
    size, n = 4**near.k, len(free)
    f0, p = near.shares, np.asarray(free)[:, None]
    a = [affinities(m) for m in models]
    occupied = np.stack([p * x / (p * x + 1) for x in a])  # model, sample, k-mer
    columns = occupied.reshape(-1, size)

    def weigh(part: pd.DataFrame) -> np.ndarray:
        i, j, m = part["a"].to_numpy(), part["b"].to_numpy(), part["m"].to_numpy()
        return np.concatenate([np.bincount(i, weights=m * c[j], minlength=size) for c in columns])

    sums = added_up(near.table.select("a", "b", "m"), weigh, columns.size).reshape(len(models), n, size)
    out = []
    for model, x, occ, q in zip(models, a, occupied, sums, strict=True):
        w = f0 * (q + model.betas[:, None])
        r = np.where(f0 > 0, w / w.sum(axis=1, keepdims=True) / np.where(f0 > 0, f0, 1), 0)
        out.append(State(model, x, occ, w, r, float(((r - observed)[:, f0 > 0] ** 2).mean())))
    return out


def gradient(near: Neighbours, state: State, observed: np.ndarray) -> np.ndarray:
    """The error's derivatives by the model's vector (weights, a0, betas), by one more pass over the neighbours.

    Occupancies' worth, d error / d occupied, is a sum over the table; the chain goes on through p A / (p A + 1) and the product
    of weights.
    """
    size, n = 4**near.k, len(state.weight)
    f0, r = near.shares, state.enriched
    used = f0 > 0
    total = state.weight.sum(axis=1, keepdims=True)
    d_r = np.where(used, 2 * (r - observed) / (n * used.sum()), 0)
    d_w = np.where(used, (d_r / np.where(used, f0, 1) - (d_r * r).sum(axis=1, keepdims=True)) / total, 0)
    worth = d_w * f0

    def back(part: pd.DataFrame) -> np.ndarray:
        i, j, m = part["a"].to_numpy(), part["b"].to_numpy(), part["m"].to_numpy()
        return np.concatenate([np.bincount(j, weights=m * c[i], minlength=size) for c in worth])

    d_occ = added_up(near.table.select("a", "b", "m"), back, n * size).reshape(n, size)
    d_log = (d_occ * (state.occupied - state.occupied**2)).sum(axis=0)  # by log A of each k-mer
    weights = state.model.weights[0]
    d_weights, cells = np.zeros((near.k, 4)), d_log.reshape([4] * near.k)
    for d in range(near.k):
        d_weights[d] = cells.sum(axis=tuple(x for x in range(near.k) if x != d))
    return np.concatenate([(d_weights / weights).ravel(), [d_log.sum() / state.model.a0[0]], worth.sum(axis=1)])


def evaluator(near: Neighbours, free: list[float], observed: np.ndarray):
    """(error and gradient of a model, errors of many models by one pass): what ``descent.descend`` asks for."""

    def evaluate(model: Model) -> tuple[float, np.ndarray]:
        state = states(near, [model], free, observed)[0]
        return state.error, gradient(near, state, observed)

    return evaluate, lambda models: [s.error for s in states(near, models, free, observed)]


def kmer_gradient(reads: DataFrame, model: Model, free: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(pi, its derivatives): the reads' occupancies summed by the k-mers that they hold, 4^k numbers, and their derivatives by
    the motif's weights and a0, 4^k x (4 w + 1), in one pass over reads (seq). Sites with other letters count 0."""
    from utrflow.operators.fitting import _codes, _sites

    w = model.weights[0]
    n, size = w.size + 1, 4**k
    a0 = float(model.a0[0])

    def summed(part: pd.DataFrame) -> np.ndarray:
        pi, slopes = np.zeros(size), np.zeros((size, n))
        for length, rows in part["seq"].groupby(part["seq"].str.len()):
            if length < max(k, len(w)):
                continue
            x = _codes(rows)
            site = a0 * _sites(x, w)
            z = site.sum(axis=1)
            psi = free * z / (free * z + 1)
            d_z = free / (free * z + 1) ** 2
            own = np.zeros((len(x), n))
            for d in range(len(w)):
                base = x[:, d : d + site.shape[1]]
                for b in range(4):
                    own[:, 4 * d + b] = np.where(base == b, site, 0).sum(axis=1) / w[d, b]
            own[:, -1] = z / a0
            own *= d_z[:, None]
            index, good = np.zeros((len(x), length - k + 1), np.int64), np.ones((len(x), length - k + 1), bool)
            for d in range(k):
                base = x[:, d : d + index.shape[1]]
                index, good = index * 4 + base, good & (base < 4)
            row, _ = np.nonzero(good)
            np.add.at(pi, index[good], psi[row])
            np.add.at(slopes, index[good], own[row])
        return np.concatenate([pi, slopes.ravel()])

    sums = added_up(reads.select("seq").filter("seq is not null"), summed, size * (n + 1))
    return sums[:size], sums[size:].reshape(size, n)
