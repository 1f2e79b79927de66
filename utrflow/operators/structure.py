"""Scores that know how open a site is, scores of two sites together, and how open the places round a k-mer are.

An accessibility is an array column: a value for each window of some width of the whole molecule (left adapter, read, right
adapter), from 0 (closed) to 1 (open). It is an input; no folding is done here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utrflow.functions.sequence import index_kmer, kmers
from utrflow.operators.arrays import flat, portions, small_batches
from utrflow.operators.fitting import CLIP


@dataclass(frozen=True)
class Motif:
    """Weights (rows of four), affinity, and what its sites ask of the structure.

    The site that begins at a base is as open as the window of ``acc`` that begins ``shift`` bases after it, to the power of
    ``scale``. Without a column every site is open.
    """

    weights: tuple[tuple[float, ...], ...]
    a0: float = 1.0
    acc: str | None = None
    shift: int = 0
    scale: float = 1.0

    @property
    def k(self) -> int:
        return len(self.weights)


def _places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all texts as numbers (4 for what isn't a base), the text of each, and its place in it."""
    lengths = np.array([len(t) for t in texts], np.int64)
    own = np.repeat(np.arange(len(texts)), lengths)
    return _LETTERS[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)], own, np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _letters() -> np.ndarray:
    code = np.full(256, 4, np.uint8)
    for i, letters in enumerate(("Aa", "Cc", "Gg", "TUtu")):
        code[[ord(c) for c in letters]] = i
    return code


_LETTERS = _letters()


def with_sites(reads: DataFrame, motifs: list[Motif], nonspecific: float = 0.0, left: str = "", right: str = "", seq: str = "seq", split: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``reads`` (or its columns ``keep``) with z_sites: an affinity for each place, relative to the strongest motif's, summed over the motifs.

    A place's affinity is (product of weights + ``nonspecific``) * openness, the accessibility that the motif asks for to the
    power of its scale: 0 where that is null or outside its array; the product is 0 where a letter isn't a base. Reads stand
    between as many adapter bases as the widest motif has, less one, and each motif is laid along all of that; with ``split``
    a column z_sites_0, z_sites_1, ... for each motif instead, in the order given. A null read has no places.

    Portions of reads are scored together, base by base of the motif: linear in their length, and nothing is shuffled.
    """
    small_batches(reads.sparkSession)
    pad, top = max(m.k for m in motifs) - 1, max(m.a0 for m in motifs)
    adapters = bool(left or right)
    if adapters and pad > min(len(left), len(right)):
        raise ValueError("the adapters are shorter than the padding")
    before, after = (left[len(left) - pad :], right[:pad]) if adapters and pad else ("", "")
    first = len(left) - pad if adapters else 0  # bases of the left adapter that the padded read leaves out
    accs = sorted({m.acc for m in motifs if m.acc})
    kept = reads.columns if keep is None else keep
    names = [f"z_sites_{i}" for i in range(len(motifs))] if split else ["z_sites"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(parts):
            seqs = part.pop("__seq")
            arrays = {c: flat(part.pop(f"__{c}")) for c in accs}
            x, own, at = _places([before + s + after if s is not None else "" for s in seqs])
            size = np.bincount(own, minlength=len(part))
            out = []
            for m in motifs:
                w = np.hstack([np.asarray(m.weights, float), np.zeros((m.k, 1))])
                fits = np.flatnonzero(at + m.k <= size[own])
                z = np.ones(len(fits))
                for d in range(m.k):
                    z *= w[d][x[fits + d]]
                z += nonspecific
                if m.acc:
                    values, of, _ = arrays[m.acc]
                    many = np.bincount(of, minlength=len(part))
                    place = at[fits] + first + m.shift
                    good = (place >= 0) & (place < many[own[fits]])
                    open_ = np.zeros(len(fits))
                    open_[good] = np.nan_to_num(values[(np.cumsum(many) - many)[own[fits[good]]] + place[good]])
                    z *= open_ if m.scale == 1 else np.where(good, open_**m.scale, 0)
                out.append((fits, z * (m.a0 / top)))
            if not split:
                total = np.zeros(len(x))
                for fits, z in out:
                    total[fits] += z
                fits = np.flatnonzero(at + min(m.k for m in motifs) <= size[own])
                out = [(fits, total[fits])]
            for name, (fits, z) in zip(names, out, strict=True):
                part[name] = pd.Series(np.split(z, np.searchsorted(own[fits], np.arange(1, len(part)))) if len(part) else [], index=part.index, dtype=object)
            yield part

    given = reads.select(*kept, F.col(seq).alias("__seq"), *[F.col(c).alias(f"__{c}") for c in accs])
    fields = given.schema.fields[: len(kept)] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]
    return given.mapInPandas(run, T.StructType(fields))


def with_totals(sites: DataFrame, z: str = "z_sites", clip: float = CLIP) -> DataFrame:
    """``sites`` with z (the sum of its places, at most ``clip``), best (the greatest of them) and place (the first such, from 0)."""
    best = F.array_max(z)
    return sites.withColumns({"z": F.least(F.aggregate(z, F.lit(0.0), lambda a, x: a + x), F.lit(clip)), "best": best, "place": F.array_position(F.col(z), best) - 1})


def two_site_totals(sites: DataFrame, first: str, second: str, costs: list[float], keep: list[str], name: str = "z") -> DataFrame:
    """(keep, name): the sum over a read of first[i] + second[i] + the pairs first[i - d] * second[i] * costs[d - 1], for d from
    1 to len(costs).

    ``first`` and ``second`` are arrays of one length, with a value per place; null where either is. The pairs of a portion are
    taken distance by distance over all its reads at once: linear in the reads' length and in the number of costs; no pair
    becomes a row.
    """
    small_batches(sites.sparkSession)
    weights = np.asarray(costs, float)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in portions(parts):
            a, b = part.pop("__a"), part.pop("__b")
            x, own, at = flat(a)
            y, other, _ = flat(b)
            whole = a.notna() & b.notna()
            if not np.array_equal(own[whole.to_numpy()[own]], other[whole.to_numpy()[other]]):
                raise ValueError("both sites' arrays must be of one length")
            x, own, at, y = *(v[whole.to_numpy()[own]] for v in (x, own, at)), y[whole.to_numpy()[other]]
            before = np.zeros(len(x))
            for d, cost in enumerate(weights, 1):
                near = np.flatnonzero(at >= d)
                before[near] += cost * x[near - d]
            part[name] = pd.Series(np.bincount(own, weights=x + y + y * before, minlength=len(part)), index=part.index).where(whole)
            yield part

    kept = sites.select(*keep, F.col(first).alias("__a"), F.col(second).alias("__b"))
    return kept.mapInPandas(run, T.StructType([*kept.schema.fields[:-2], T.StructField(name, T.DoubleType())]))


def spacing_profile(sites: DataFrame, first: str, second: str, k1: int, k2: int, most: int) -> DataFrame:
    """(d, z, n): over all reads, sums of first[i] * second[j] and numbers of such places, by d = j - i + k1 - k2, |d| <= ``most``.

    A task adds up 2 ``most`` + 1 numbers; only those are shuffled.
    """
    small_batches(sites.sparkSession)
    shift, size = k1 - k2, 2 * most + 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z, n = np.zeros(size), np.zeros(size, np.int64)
        for part in portions(parts):
            (x, own, at), (y, other, _) = flat(part[first]), flat(part[second])
            starts = np.searchsorted(other, np.arange(len(part)))
            lengths = np.bincount(other, minlength=len(part))
            for d in range(-most, most + 1):
                j = at + d - shift
                hit = np.flatnonzero((j >= 0) & (j < lengths[own]))
                z[d + most] += float((x[hit] * y[starts[own[hit]] + j[hit]]).sum())
                n[d + most] += len(hit)
        yield pd.DataFrame({"d": np.arange(-most, most + 1), "z": z, "n": n})

    return sites.select(first, second).mapInPandas(run, "d long, z double, n long").groupBy("d").agg(F.sum("z").alias("z"), F.sum("n").alias("n"))


#: Counters that one task keeps: up to so many (64 MB).
COUNTERS = 1 << 23


def kmer_openness(reads: DataFrame, k: int, levels: str, reach: int, shift: int = 0, seq: str = "seq", bins: int = 256) -> DataFrame:
    """(kmer, d, level, n): how often each level stands d places (-reach to k - 1 + reach) from where each k-mer begins.

    ``levels`` is an array of discretised accessibilities (0 to ``bins`` - 1); the one of a read's first base is at ``shift``.
    Places outside the array are left out, and k-mers with other letters than bases. A task counts into one array of
    4^k (k + 2 reach) ``bins`` numbers, whose cells that aren't 0 are what is shuffled.
    """
    small_batches(reads.sparkSession)
    width = k + 2 * reach
    if 4**k * width * bins > COUNTERS:
        raise ValueError("so many k-mers, offsets and levels don't fit into a task's counters")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(4**k * width * bins, np.int64)
        for part in portions(parts):
            part = part.dropna()
            if part.empty:
                continue
            x, own, at = _places(part["seq"].tolist())
            index, good = np.zeros(len(x), np.int64), at + k <= np.bincount(own, minlength=len(part))[own]
            for d in range(k):
                base = np.append(x[d:], np.full(d, 4, np.uint8))
                index, good = index * 4 + base, good & (base < 4)
            level, _, _ = flat(part["levels"])
            sizes = np.array([len(a) for a in part["levels"]], np.int64)
            starts = np.cumsum(sizes) - sizes
            index, own, at = index[good], own[good], at[good] + shift
            for d in range(width):
                place = at + d - reach
                hit = np.flatnonzero((place >= 0) & (place < sizes[own]))
                cells = (index[hit] * width + d) * bins + level[starts[own[hit]] + place[hit]].astype(np.int64)
                np.add.at(total, cells, 1)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "n": total[cells]})

    counted = reads.select(F.col(seq).alias("seq"), F.col(levels).alias("levels")).mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cell = F.col("cell")
    return counted.select(index_kmer(F.expr(f"cell div {bins * width}"), k, "ACGT").alias("kmer"), (F.expr(f"cell div {bins}") % width - reach).alias("d"), (cell % bins).alias("level"), "n")


def mean_openness(counted: DataFrame, values: Column | None = None) -> DataFrame:
    """(kmer, d, n, mean): from ``kmer_openness`` rows, the mean level of each offset, or of ``values`` (an expression on level)."""
    value = F.col("level") if values is None else values
    return counted.groupBy("kmer", "d").agg(F.sum("n").alias("n"), (F.sum(value * F.col("n")) / F.sum("n")).alias("mean"))


def openness_round(reads: DataFrame, at: str, levels: str, upstream: int, downstream: int) -> DataFrame:
    """(d, level, n): levels from ``upstream`` places before to ``downstream`` after one place of each read; reads in which that
    stretch doesn't fit, and null places, are left out."""
    p = F.col(at)
    fits = p.isNotNull() & (p >= upstream) & (p + downstream < F.size(levels))
    around = F.transform(F.slice(F.col(levels), F.greatest(p - upstream + 1, F.lit(1)), F.lit(upstream + downstream + 1)), lambda v, i: F.struct((i - upstream).alias("d"), v.alias("level")))
    return reads.filter(fits).select(F.inline(around)).groupBy("d", "level").agg(F.count(F.lit(1)).alias("n"))


def kmer_accessibilities(reads: DataFrame, kmer: str, acc: str, shift: int = 0, read: str = "read_id", seq: str = "seq") -> DataFrame:
    """(read, pos, acc): the accessibility at each place of one k-mer; null outside the array."""
    at = F.filter(F.transform(kmers(F.col(seq), len(kmer)), lambda w, i: F.when(w == kmer, i)), lambda i: i.isNotNull())
    return reads.select(read, F.inline(F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(F.col(acc), i + shift).alias("acc")))))
