"""Position-specific affinity matrices: tables (rbp, motif, a0, pos, base, weight) or lists of rows of four weights (A C G U)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.functions.sequence import IUPAC, all_kmers

BASES = "ACGU"
#: Rows of a motif table that goes to the driver and to each task: some twenty thousand motifs of 12 positions.
MOST_MOTIF_ROWS = 1 << 20


def site_scores(seq: Column, weights: list[list[float]], nonspecific: float = 0.0) -> Column:
    """The product of weights at each place of the sequence, as an array; 0 where a letter isn't a base."""
    k = len(weights)
    table = [F.create_map(*[x for b, w in zip("ACGTU", [*row, row[3]], strict=True) for x in (F.lit(b), F.lit(float(w)))]) for row in weights]
    upper = F.upper(seq)

    def at(i: Column) -> Column:
        z = F.lit(1.0)
        for d in range(k):
            z = z * F.coalesce(F.element_at(table[d], F.substr(upper, i + d, F.lit(1))), F.lit(0.0))
        return z + nonspecific

    n = F.length(seq) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at)).otherwise(F.array().cast("array<double>"))


def window_score(window: Column, weights: list[list[float]]) -> Column:
    """The product of weights over a window of exactly the motif's width, as plain arithmetic (stays in generated code)."""
    z = F.lit(1.0)
    for d, row in enumerate(weights):
        base = F.substring(window, d + 1, 1)
        z = z * F.when(base == "A", float(row[0])).when(base == "C", float(row[1])).when(base == "G", float(row[2])).when(base.isin("T", "U"), float(row[3])).otherwise(0.0)
    return z


def set_scores(seq: Column, motifs: list[tuple[float, list[list[float]]]]) -> Column:
    """Scores of a set of (a0, weights) at each place, relative to its strongest motif: sum of z * a0 / a0 of the first.

    The motifs are taken strongest first; wider ones end earlier, and count 0 after.
    """
    motifs = sorted(motifs, key=lambda m: -m[0])
    total = site_scores(seq, motifs[0][1])
    for a0, weights in motifs[1:]:
        total = _added(total, site_scores(seq, weights), a0 / motifs[0][0])
    return total


def _added(total: Column, other: Column, ratio: float) -> Column:
    return F.zip_with(total, other, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)) * ratio)


def total_and_best(scores: Column) -> tuple[Column, Column, Column]:
    """Sum, maximum and the first place (from 0) of the maximum of an array of scores."""
    best = F.array_max(scores)
    return F.aggregate(scores, F.lit(0.0), lambda a, z: a + z), best, F.array_position(scores, best) - 1


def score_many(seqs: DataFrame, psams: DataFrame, seq: str = "seq", reduce: str = "sum") -> DataFrame:
    """(seq, rbp, score): distinct sequences scored against many motif sets in Arrow batches of numpy.

    ``psams`` has (rbp, motif, a0, pos, base, weight); it is collected (a few thousand rows: motifs, not data). Motifs of a
    set are relative to its strongest. ``reduce``: sum or max over places.
    """
    sets: dict[str, list] = {}
    if psams.count() > MOST_MOTIF_ROWS:
        raise ValueError(f"more than {MOST_MOTIF_ROWS} rows are no motif table")
    for (rbp, _), rows in psams.toPandas().groupby(["rbp", "motif"]):
        m = np.zeros((int(rows["pos"].max()) + 1, 5))
        for r in rows.itertuples():
            m[int(r.pos), BASES.index(r.base.replace("T", "U"))] = r.weight
        sets.setdefault(rbp, []).append((float(rows["a0"].iloc[0]), m))
    shared = seqs.sparkSession.sparkContext.broadcast({k: sorted(v, key=lambda x: -x[0]) for k, v in sets.items()})
    code = np.full(256, 4, np.uint8)
    for i, letters in enumerate(("Aa", "Cc", "Gg", "TUtu")):
        for c in letters:
            code[ord(c)] = i

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            by_length = part[seq].groupby(part[seq].str.len())
            for length, own in by_length:
                x = code[np.frombuffer("".join(own).encode("ascii", "replace"), np.uint8)].reshape(len(own), int(length))
                for rbp, motifs in shared.value.items():
                    places = np.zeros((len(own), int(length)))
                    for a0, m in motifs:
                        n = int(length) - len(m) + 1
                        if n > 0:
                            z = np.ones((len(own), n))
                            for d in range(len(m)):
                                z *= m[d][x[:, d : d + n]]
                            places[:, :n] += z * (a0 / motifs[0][0])
                    out.append(pd.DataFrame({"seq": own.to_numpy(), "rbp": rbp, "score": places.sum(1) if reduce == "sum" else places.max(1)}))
            yield pd.concat(out) if out else pd.DataFrame({"seq": [], "rbp": [], "score": []})

    return seqs.select(seq).filter(F.col(seq).isNotNull()).distinct().mapInPandas(run, "seq string, rbp string, score double")


def peaks(scores: list[float], least: float, width: int, pad: int = 0) -> list[tuple[int, int]]:
    """Greedy peaks of one sequence: the best place while it reaches ``least``; its padded window is then out of play."""
    z, out = np.array(scores, float), []
    while len(z) and z.max() >= least:
        i = int(z.argmax())
        a, b = max(0, i - pad), min(len(z) + width - 1, i + width + pad)
        out.append((a, b))
        z[a:b] = -np.inf
    return out


def kmer_affinities(spark: SparkSession, weights: list[list[float]], a0: float = 1.0, floor: float = 0.0) -> DataFrame:
    """(kmer, affinity) of all k-mers of the motif's width: the greater of a0 * product and the floor."""
    return all_kmers(spark, len(weights)).select("kmer", F.greatest(window_score(F.col("kmer"), weights) * a0, F.lit(floor)).alias("affinity"))


def from_iupac(code: str) -> list[list[float]]:
    """Weights of a consensus: 1 for the bases that a letter stands for, else 1e-6."""
    return [[1.0 if b in IUPAC[c.upper()] else 1e-6 for b in BASES] for c in code]


def scaled(weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Rows with maximum 1, and the factor that was taken out."""
    top = weights.max(axis=1)
    return weights / top[:, None], float(top.prod())


def discrimination(weights: np.ndarray) -> np.ndarray:
    return (weights.max(axis=1) / weights.sum(axis=1) - 0.25) / 0.75


def consensus(weights: np.ndarray, sure: float = 0.9) -> str:
    """The IUPAC letter nearest to each row, by the cosine; lower case below ``sure``."""
    out = []
    for row in np.asarray(weights, float):
        best = max(((float(row @ v / np.linalg.norm(row) / np.linalg.norm(v)), -len(IUPAC[c]), c) for c in "ACGURYSWKMBDHVN" for v in [np.array([float(b in IUPAC[c]) for b in BASES])]))
        out.append(best[2] if best[0] >= sure else best[2].lower())
    return "".join(out)


def reverse_complemented(weights: np.ndarray) -> np.ndarray:
    return np.asarray(weights)[::-1, ::-1]


def padded_to(weights: np.ndarray, width: int) -> np.ndarray:
    """Rows of ones added next to the more specific end, of equal ones in turn right and left, until there are ``width`` rows."""
    w = np.asarray(weights, float)
    for i in range(width - len(w)):
        d = discrimination(w)
        left = bool(i % 2) if d[0] == d[-1] else d[0] > d[-1]
        w = np.vstack([np.ones((1, 4)), w] if left else [w, np.ones((1, 4))])
    return w


def shrunk(weights: np.ndarray, keep: float = 0.75, rows: int = 0) -> tuple[np.ndarray, float]:
    """(weights, factor): the shortest run of rows with that share of the discrimination (the last of equal length; ``rows``
    long, if given), and what a0 is multiplied by: the means of the weights left out before and after it."""
    w = np.asarray(weights, float)
    d = np.concatenate([[0], np.cumsum(discrimination(w))]) / discrimination(w).sum()
    n = len(w)
    runs = {n: (0, n)} | {j - i: (i, j) for i in range(n) for j in range(i + 1, n + 1) if d[j] - d[i] >= keep}
    i, j = runs[rows or min(runs)]
    return w[i:j], float(np.prod([part.mean() for part in (w[:i], w[j:]) if len(part)]))


def dinucleotides(weights: np.ndarray) -> np.ndarray:
    """A matrix of n - 1 rows of 16 weights of base pairs; each inner row counts half in either pair."""
    w = np.asarray(weights, float)
    part = [np.sqrt(r) if 0 < i < len(w) - 1 else r for i, r in enumerate(w)]
    return np.array([np.outer(part[i], part[i + 1]).ravel() for i in range(len(w) - 1)])


def _outside(rows: np.ndarray, ends: str, product: bool) -> float:
    """What the rows that a sequence doesn't reach count: of each its least weight, or its mean, added up or multiplied."""
    if ends == "none" or not len(rows):
        return 1.0 if product else 0.0
    each = rows.mean(axis=1) if ends == "mean" else rows.min(axis=1)
    return float(each.prod() if product else each.sum())


def placed(weights: np.ndarray, sequence: str, product: bool = True, ends: str = "least", least: int = 1, contained: bool = False, relative: bool = False) -> tuple[int, float]:
    """(offset, score) of a sequence along a motif, without gaps: the best of all offsets with ``least`` rows or more in common,
    the first of equals.

    A score is the product (or the sum) of the bases' weights and of what rows without a base count (``ends``: their least
    weight, their mean, or nothing). Letters that aren't bases are skipped. ``contained`` looks only at offsets up to the
    difference of the lengths; ``relative`` divides by the sum of the rows' greatest weights. An empty motif gives (0, 1).
    """
    w = np.asarray(weights, float)
    n, length = len(w), len(sequence)
    if not n:
        return 0, 1.0
    code = [BASES.find(c) for c in sequence.upper().replace("T", "U")]
    offsets = range(-(n - length), n - length + 1) if contained else range(least - length, n + 1 - least)
    best = None
    for o in offsets:
        first, last = max(0, o), min(n, o + length)
        before, after = _outside(w[:first], ends, product), _outside(w[last:], ends, product)
        own = [w[i, code[i - o]] for i in range(first, last) if code[i - o] >= 0]
        score = before * after * float(np.prod(own)) if product else before + after + float(np.sum(own))
        if best is None or score > best[1]:
            best = (o, score)
    o, score = best
    return o, score / float(w.max(axis=1).sum()) if relative else score


def best_place(kmer: Column, k: int, weights: list[list[float]]) -> Column:
    """(score, offset) of ``placed`` for a column of k-mers of the letters A, C, G, T, U, by products, as one expression."""
    w = np.asarray(weights, float)
    scored = []
    for i, o in enumerate(range(1 - k, len(w))):
        first, last = max(0, o), min(len(w), o + k)
        rest = _outside(w[:first], "least", True) * _outside(w[last:], "least", True)
        own = window_score(F.substring(kmer, first - o + 1, last - first), w[first:last].tolist())
        scored.append(F.struct((own * rest).alias("score"), F.lit(-i).alias("order"), F.lit(o).alias("offset")))
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return F.struct(best["score"].alias("score"), best["offset"].alias("offset"))


def highest_scoring(spark: SparkSession, weights: list[list[float]], k: int = 7, most: int = 10) -> DataFrame:
    """(kmer, score, offset): the ``most`` k-mers that a motif likes best at any offset; of equals the last in alphabetical order."""
    x = all_kmers(spark, k, BASES).withColumn("best", best_place(F.col("kmer"), k, weights))
    return x.orderBy(F.col("best.score").desc(), F.col("kmer").desc()).limit(most).select("kmer", "best.score", "best.offset")


def compared_along(weights: np.ndarray, sequence: str, least: int = 2) -> tuple[int, float, float]:
    """(offset, best, total) of a sequence along a motif: products of weights at all offsets with ``least`` rows or more in
    common; a row without base counts the mean of its least weight and 1."""
    w, best, total = np.asarray(weights, float), (-1.0, 0), 0.0
    for offset in range(least - len(w), len(sequence) - least + 1):
        z = 1.0
        for d in range(len(w)):
            i = offset + d
            z *= w[d][BASES.index(sequence[i].upper().replace("T", "U"))] if 0 <= i < len(sequence) else 0.5 * w[d].min() + 0.5
        total += z
        best = max(best, (z, -offset))
    return -best[1], best[0], total


def from_variants(kmers: list[str], affinities: list[float]) -> tuple[np.ndarray, float]:
    """(weights, a0) from k-mers by descending affinity: the first one's bases weigh 1; of each further one the bases that
    are new at their place weigh its affinity over the first's, added up."""
    best = np.array(from_iupac(kmers[0]), float)
    out = best.copy()
    for kmer, a in zip(kmers[1:], affinities[1:], strict=True):
        if a > affinities[0]:
            raise ValueError("k-mers must come by descending affinity")
        out += ((np.array(from_iupac(kmer), float) == 1) & (out != 1)) * (a / affinities[0])
    if (out > 1).any():
        raise ValueError("the variants at a place weigh more than the best base")
    return out, float(affinities[0])


def kmer_score(kmer: str, weights: np.ndarray, a0: float = 1.0) -> float:
    """The sum of the weights of a k-mer's bases, times a0; the k-mer is as long as the motif."""
    return float((np.asarray(weights, float) * np.array(from_iupac(kmer), float)).sum() * a0)


def kmer_score_column(kmer: Column, weights: list[list[float]], a0: float = 1.0) -> Column:
    """``kmer_score`` of a column; null where the k-mer isn't as long as the motif or holds another letter."""
    total = F.lit(0.0)
    for i, row in enumerate(weights):
        base = F.upper(F.substring(kmer, i + 1, 1))
        own = None
        for names, w in zip(("A", "C", "G", "TU"), row, strict=True):
            hit = base.isin(*names)
            own = F.when(hit, float(w)) if own is None else own.when(hit, float(w))
        total = total + own
    return F.when(F.length(kmer) == len(weights), total * float(a0))


def gc_weight(weights: np.ndarray) -> float:
    """The share of all weights that is C's and G's."""
    w = np.asarray(weights, float)
    return float(w[:, 1:3].sum() / w.sum())


def dissociation(a0: float) -> float:
    """The dissociation constant of the best sequence."""
    return 1.0 / a0


def scaled_weights(weights: np.ndarray, a0: float) -> np.ndarray:
    return np.asarray(weights, float) * a0
