"""Document quality by a regularised quadratic discriminant.

A pass over the texts turns each into a row of counts; sums over all documents give each count's usual share, and with
these a row of counts becomes transformed statistics. Sums and products of the labelled rows, added up by Spark over all of
them, give both classes' means and covariances; each covariance is shrunk towards a multiple of the identity. A score is
the logistic of the difference of the two log densities, worked out with cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.llm.segments import END, hashes, joined, lowered, sized, small_batches
from utrflow.plans.storage import written

#: What a row of counts holds: of the words, then of the bytes within words, each counted as a share of its kind.
OF_WORDS = ("without a letter", "ending a clause", "as the one before", "as the second before", "first occurrences", "as the most frequent", "up to 3 bytes", "12 bytes or more", "beginning in upper case", "line ends")
OF_BYTES = ("symbols", "digits", "beyond ASCII")
#: A row of counts: words, bytes within words, sum of their squared lengths, and the shares' cases.
COUNTS = 3 + len(OF_WORDS) + len(OF_BYTES)
#: A row of statistics: logarithms of words, of the mean and the variance of their lengths, and the shares' log odds.
D = COUNTS
#: So many words (times the mean length: bytes) with the usual share are added to each share: a short text says little. Of 4, 8, 16
#: and 32 the best by folds within the rows whose labels may be learnt from.
ADDED = 32.0
CUT = 0.3


def held_out(doc_id: Column) -> Column:
    """The fifth of ids whose labels are never learnt from; a null id isn't in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _kinds() -> np.ndarray:
    """Bits of each byte: 1 blank, 2 letter or beyond ASCII, 4 digit, 8 mark of a sentence, 16 line end, 32 upper case, 64 beyond ASCII."""
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, *range(9, 14), END]] = 1
    kinds[0x80:END] = 2 | 64
    kinds[97:123] = 2
    kinds[65:91] = 2 | 32
    kinds[48:58] = 4
    kinds[list(b".,;:!?'\"()-")] = 8
    kinds[10] |= 16
    return kinds


_KINDS = _kinds()


def counts(texts: list[bytes]) -> np.ndarray:
    """A row of counts for each text; an empty text has zeros."""
    n = len(texts)
    buf, stops = joined(texts)
    kinds = _KINDS[buf]
    word = kinds & 1 == 0
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(stops, starts)
    edges = np.concatenate([[0], stops + 1])

    def of_bytes(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return np.diff(total[edges])

    def of_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner, weights=mask, minlength=n)

    length = (ends - starts).astype(np.float64)
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(kinds & 2 != 0, out=letters[1:])
    h = hashes(lowered(buf), starts, ends)
    same = [np.zeros(len(h), bool) for _ in range(2)]
    for k in (1, 2):
        same[k - 1][k:] = (h[k:] == h[:-k]) & (owner[k:] == owner[:-k])
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    first = np.flatnonzero(new)
    own, most = owner[order][first], np.zeros(n)
    np.maximum.at(most, own, np.diff(np.append(first, len(h))))
    last, begin = kinds[np.maximum(ends - 1, 0)], kinds[starts]
    return np.stack([
        np.bincount(owner, minlength=n), of_bytes(word), of_words(length**2),
        of_words(letters[ends] == letters[starts]), of_words(last & 8 != 0), of_words(same[0]), of_words(same[1]), np.bincount(own, minlength=n), most, of_words(length <= 3), of_words(length >= 12), of_words(begin & 32 != 0), of_bytes(kinds & 16 != 0),
        of_bytes(kinds == 0), of_bytes(kinds & 4 != 0), of_bytes(kinds & 64 != 0),
    ], axis=1)


def statistics(rows: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Rows of counts as rows of statistics; ``total`` is the sum of all documents' counts."""
    whole = np.maximum(total, 1.0)
    mean_bytes = whole[1] / whole[0]
    words, inside, square = rows[:, 0], rows[:, 1], rows[:, 2]
    mean = (inside + ADDED * mean_bytes) / (words + ADDED)
    spread = np.maximum((square + ADDED * whole[2] / whole[0]) / (words + ADDED) - mean**2, 0)
    n_words, n_bytes = len(OF_WORDS), len(OF_BYTES)
    base = np.concatenate([np.repeat(words[:, None], n_words, 1), np.repeat(inside[:, None], n_bytes, 1)], axis=1)
    usual = np.clip(total[3:] / np.repeat(whole[:2], (n_words, n_bytes)), 1e-4, 1 - 1e-4)
    added = np.repeat([ADDED, ADDED * mean_bytes], (n_words, n_bytes))
    part = np.minimum(rows[:, 3:], base)  # line ends may be more than words
    odds = np.log((part + added * usual) / (base - part + added * (1 - usual)))
    return np.concatenate([np.stack([np.log1p(words), np.log(mean), np.log1p(spread)], axis=1), odds], axis=1)


@dataclass
class Gaussian:
    """A class: its log share, mean, and the Cholesky factor of its shrunk covariance, kept with its log determinant."""

    log_share: float
    mean: np.ndarray
    factor: np.ndarray
    log_det: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = np.linalg.solve(self.factor, (x - self.mean).T)  # the squared length of z is the Mahalanobis distance
        return self.log_share - 0.5 * ((z**2).sum(axis=0) + self.log_det)


def shrunk(cov: np.ndarray, n: int) -> np.ndarray:
    """``cov`` of n rows moved towards (trace / d) I by the oracle approximating share, which n, d and the traces give."""
    d, trace, square = len(cov), np.trace(cov), (cov**2).sum()
    level = trace / d
    below = (n + 1 - 2 / d) * (square - trace**2 / d)
    share = 1.0 if below <= 0 else min(1.0, max(1e-3, ((1 - 2 / d) * square + trace**2) / below))
    return (1 - share) * cov + (share * level + 1e-6) * np.eye(d)


@dataclass
class Discriminant:
    """Both classes over standardised statistics; ``total`` is the sum of all documents' counts."""

    total: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    good: Gaussian
    bad: Gaussian

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of class 1 for rows of counts."""
        y = (statistics(rows, self.total) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.good.log_density(y) - self.bad.log_density(y), -700, 700)))


def discriminant(total: np.ndarray, n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant | None:
    """From both classes' numbers of rows, sums and sums of products (class 0 first); None where a class has fewer than two rows."""
    if min(n) < 2:
        return None
    centre = sums.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(products.sum(axis=0)) / n.sum() - centre**2, 1e-6))
    classes = []
    for k in (0, 1):
        mean = sums[k] / n[k]
        cov = (products[k] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale)
        factor = np.linalg.cholesky(shrunk(cov, int(n[k])))
        classes.append(Gaussian(float(np.log(n[k] / n.sum())), (mean - centre) / scale, factor, float(2 * np.log(np.diag(factor)).sum())))
    return Discriminant(total, centre, scale, classes[1], classes[0])


def measured(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, x): a row of counts for each row of ``docs``, written. Null texts count as empty; ids may be null or repeat."""
    small_batches(docs.sparkSession)
    kind, arrow = docs.schema[id_col].dataType.simpleString(), docs.select(id_col).limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in sized(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, arrow), pa.array([r.tobytes() for r in counts(texts).astype("<f8")], pa.binary())], ["id", "x"])

    return written(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, x binary"), "counts")


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, COUNTS)


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums of (at, total) rows by their place in an array of a fixed shape."""
    out = np.zeros(shape)
    for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect():  # as many rows as the array has places
        out.flat[r["at"]] = r["total"]
    return out


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Discriminant | None:
    """The discriminant of all ``rows`` (of ``measured``) that have a label and aren't held out; no row is sampled.

    Null labels and ids don't count; a repeated label counts as often as it stands. What reaches the driver are sums: those
    of the counts, and of two classes' products of statistics. None where a class has fewer than two rows.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id")))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTS)
        for b in batches:
            total += _rows(b["x"]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTS)), pa.array(total)], ["at", "total"])

    whole = _summed(rows.select("x").mapInArrow(totals, "at long, total double"), (COUNTS,))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, D + 1, D + 1))
        for b in batches:
            x, of = np.pad(statistics(_rows(b["x"]), whole), ((0, 0), (1, 0)), constant_values=1.0), b["label"].to_numpy()
            for k in (0, 1):
                total[k] += x[of == k].T @ x[of == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "total"])

    learnt = rows.join(known, "id").select("x", F.col("label").cast("int").alias("label"))
    total = _summed(learnt.mapInArrow(moments, "at long, total double"), (2, D + 1, D + 1))
    return discriminant(whole, total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:])


def score(rows: DataFrame, model: Discriminant | None, id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``measured``: its id, held_out, score (0 to 1), predicted (1 from 0.3 on). Without a model all scores are 0.5."""
    kind, arrow = rows.schema["id"].dataType.simpleString(), rows.select("id").limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = model.score(_rows(b["x"])) if model else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b["id"].cast(arrow), pa.array(scores)], ["id", "score"])

    scored = rows.select("id", "x").mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return score(rows, fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")))
