"""Enrichment of k-mers in bound reads over input reads."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utrflow.operators.arrays import portions, small_batches
from utrflow.operators.intervals import until
from utrflow.operators.kmers import filled, fractions, reads_with
from utrflow.plans.storage import numbered, small


def ratios(bound: DataFrame, control: DataFrame, value: str, name: str, on: list[str] = ("kmer",)) -> DataFrame:
    """Each of ``bound``'s rows with ``name`` = its value over the control's: R of frequencies, F of read fractions, recall."""
    base = control.select(*on, F.col(value).alias("__base"))
    return bound.join(base, list(on)).withColumn(name, F.col(value) / F.col("__base")).drop("__base")


def information(bound: DataFrame, control: DataFrame, k: int, by: list[str] = (), letters: str = "ACGT") -> DataFrame:
    """(by, kmer, di) of all 4^k k-mers, from counts (kmer, n) of both: the information that a k-mer gives on the sample.

    With s the samples' shares of all counts, q the k-mer's share of all and c its share of one sample: the sum over both
    samples of s log2(c / (q s)). It is minus infinity where one sample lacks the k-mer, null where both do.
    """
    full = filled(bound, bound.select(*by).distinct(), k, letters).withColumnRenamed("n", "nb")
    full = full.join(F.broadcast(control.select("kmer", F.col("n").alias("nc"))), "kmer", "left").withColumn("nc", F.coalesce("nc", F.lit(0)))  # 4^k rows
    b = bound.groupBy(*by).agg(F.sum("n").alias("tb"))
    full = full.join(F.broadcast(b), list(by)) if by else full.crossJoin(F.broadcast(b))
    full = full.crossJoin(F.broadcast(control.agg(F.sum("n").alias("tc"))))
    whole = F.col("tb") + F.col("tc")
    q = (F.col("nb") + F.col("nc")) / whole
    part = lambda n, t: t / whole * F.log2(n / t / (q * (t / whole)))
    di = part(F.col("nb"), F.col("tb")) + part(F.col("nc"), F.col("tc"))
    return full.select(*by, "kmer", F.when((F.col("nb") > 0) & (F.col("nc") > 0), di).when(F.col("nb") + F.col("nc") > 0, F.lit(float("-inf"))).alias("di"))


def resampled(reads: DataFrame, value, n: int, seed: int = 20_011, by: list[str] = ()) -> DataFrame:
    """``value(reads)`` (by, kmer, value) with ``error``: its population deviation over n bootstrap samples of the reads.

    A sample draws each read a Poisson(1) number of times, from a hash of its id: it can be repeated, and needs no shuffle.
    ``value`` gets reads with the column weight.
    """
    uniform = (F.pmod(F.xxhash64("read_id", "__sample", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight, upto, p = F.lit(0), 0.0, np.exp(-1.0)
    for k in range(10):
        upto += p
        p /= k + 1
        weight = weight + F.when(uniform > upto, 1).otherwise(0)
    samples = reads.withColumn("__sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("weight", weight).filter("weight > 0")
    errors = value(samples, ["__sample", *by]).groupBy(*by, "kmer").agg(F.stddev_pop("value").alias("error"))
    return value(reads.withColumn("weight", F.lit(1)), list(by)).join(errors, [*by, "kmer"], "left")


def ranked(df: DataFrame, value: str, by: list[str] = (), tie: str = "kmer") -> DataFrame:
    """With ``rank`` from 1: largest value first, of equals the greatest k-mer."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.desc(tie))))


def median_ranking(values: DataFrame, value: str = "r") -> DataFrame:
    """(kmer, median, rank) over samples."""
    return ranked(values.groupBy("kmer").agg(F.percentile(value, F.lit(0.5)).alias("median")), "median")


def diagnostic(values: DataFrame, sample: str = "conc", value: str = "r") -> DataFrame:
    """(kmer, score): top k-mers of samples by their least R times the share of samples where R > 1, best first."""
    tops = values.groupBy(sample).agg(F.max_by("kmer", F.struct(value, "kmer")).alias("kmer")).select("kmer").distinct()
    return values.join(tops, "kmer", "left_semi").groupBy("kmer").agg((F.min(value) * F.avg((F.col(value) > 1).cast("double"))).alias("score")).orderBy(F.desc("score"), "kmer")


def best_samples(values: DataFrame, keep: list[int], least: float, sample: str = "conc", value: str = "r") -> DataFrame:
    """The samples at the given ranks (from 1) by their top R, those below ``least`` left out."""
    top = values.groupBy(sample).agg(F.max(value).alias("top")).filter(F.col("top") >= least)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("top"), sample))).filter(F.col("rank").isin(keep))


def significant(values: DataFrame, sample: str, value: str, error: str, z_cut: float = 2.0, least: int = 1, most: int | None = None) -> DataFrame:
    """(kmer, z, rank): the k-mers above the cut, at least ``least`` and at most ``most`` of them.

    z is the mean over samples of (max(value - error, 0) - m) / s, where m and s are mean and deviation of a sample's plain
    values over all k-mers.
    """
    stats = values.groupBy(sample).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    low = F.greatest(F.col(value) - F.coalesce(F.col(error), F.lit(0.0)), F.lit(0.0))
    z = ranked(values.join(F.broadcast(stats), sample).groupBy("kmer").agg(F.avg((low - F.col("__m")) / F.col("__s")).alias("z")), "z")
    found = z.filter((F.col("z") >= z_cut) | (F.col("rank") <= least))
    return found if most is None else found.filter(F.col("rank") <= most)


def corrected(values: DataFrame, share: float = 0.05, value: str = "r") -> DataFrame:
    """(kmer, r): mean R over samples, corrected for unspecific reads: m + q (m - 1) / (1 - q), q a percentile of the means."""
    mean = values.groupBy("kmer").agg(F.avg(value).alias("m"))
    q = mean.agg(F.percentile("m", F.lit(share)).alias("q"))
    return mean.crossJoin(F.broadcast(q)).select("kmer", (F.col("m") + F.col("q") * (F.col("m") - 1) / (1 - F.col("q"))).alias("r"))


def seeds(values: DataFrame, error: str = "error", value: str = "r", z_cut: float = 4.0, least: int = 10, share: float = 0.05) -> DataFrame:
    """(kmer, r, error, rank): the k-mers that motifs are built from: by ``corrected`` R, from the largest on.

    The cut is the R of the first k-mer whose z over all k-mers is below ``z_cut``, 1 at least; the list ends where R less
    the mean error over samples falls to the cut and more than ``least`` k-mers are taken.
    """
    errors = values.groupBy("kmer").agg(F.avg(error).alias("error"))
    r = corrected(values, share, value).join(errors, "kmer")
    stats = r.agg(F.avg("r").alias("__m"), F.stddev_pop("r").alias("__s"))
    z = ranked(r.crossJoin(F.broadcast(stats)).withColumn("z", (F.col("r") - F.col("__m")) / F.col("__s")).drop("__m", "__s"), "r")
    # without any k-mer below the cut it is the first one's R
    cut = z.agg(F.greatest(F.lit(1.0), F.coalesce(F.max(F.when(F.col("z") < z_cut, F.col("r"))), F.max("r"))).alias("cut"))
    over = z.crossJoin(F.broadcast(cut))
    stop = over.filter((F.col("r") - F.col("error") <= F.col("cut")) & (F.col("rank") > least + 1)).agg(F.min("rank").alias("stop"))
    return over.crossJoin(F.broadcast(stop)).filter(F.col("stop").isNull() | (F.col("rank") < F.col("stop"))).select("kmer", "r", "error", "rank")


def above_error(values: DataFrame, cut: float, least: int, value: str = "r", error: str = "error") -> DataFrame:
    """k-mers from the largest value on, until value - error falls to the cut."""
    return until(values, [F.desc(value), F.desc("kmer")], F.col(value) - F.col(error) <= cut, least)


def flank_divergence(bound: DataFrame, control: DataFrame, core: int, k: int, pseudo: float = 10.0, letters: str = "ACGT") -> DataFrame:
    """(d, kmer, kl, log_ratio) of all 4^k flank k-mers at each offset, from counts (d, kmer, n).

    p and q are the shares of counts + pseudo at an offset, kl is p log2(p / q); log_ratio, log2(p / q), is 0 where the
    flank overlaps the core.
    """
    offsets = bound.select("d").union(control.select("d")).distinct()
    share = lambda df, name: filled(df.select("d", "kmer", "n"), offsets, k, letters).select("d", "kmer", ((F.col("n") + pseudo) / F.sum(F.col("n") + pseudo).over(Window.partitionBy("d"))).alias(name))
    both = share(bound, "p").join(share(control, "q"), ["d", "kmer"])
    ratio = F.log2(F.col("p") / F.col("q"))
    return both.select("d", "kmer", (F.col("p") * ratio).alias("kl"), F.when(_apart("d", core, k), ratio).otherwise(0.0).alias("log_ratio"))


def _apart(d: str, core: int, k: int):
    return (F.col(d) >= core) | (F.col(d) <= -k)


def divergence_by_offset(divergence: DataFrame, core: int, k: int) -> DataFrame:
    """(d, kl): the sums over k-mers, 0 where the flank overlaps the core."""
    return divergence.groupBy("d").agg(F.sum("kl").alias("kl")).withColumn("kl", F.when(_apart("d", core, k), F.col("kl")).otherwise(0.0))


def top_interactors(divergence: DataFrame, n: int = 10) -> DataFrame:
    """(kmer, kl): the k-mers with the largest kl at any offset, overlapping ones included, in alphabetical order."""
    return divergence.groupBy("kmer").agg(F.max("kl").alias("kl")).orderBy(F.desc("kl"), F.desc("kmer")).limit(n).orderBy("kmer")


def cooccurrence(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(a, b, d, score): log2((observed + 1) / (expected + 1))."""
    return observed.join(expected, ["a", "b", "d"], "full").select("a", "b", "d", F.log2((F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("expected", F.lit(0.0)) + 1)).alias("score"))


def ska(reads: DataFrame, start: DataFrame, background: DataFrame, k: int, by: list[str] = (), passes: int = 10, tolerance: float = 0.5, letters: str = "ACGT") -> DataFrame:
    """(by, kmer, weight): streaming assignment of one unit per read to its k-mers, by weight over background.

    Each weight changes as its read is seen, so the order of reads (by read_id) is part of the result: a sample is one
    ordered fold, and samples run in parallel. Passes end when no weight changes by the tolerance, or after ``passes``.
    A sample comes sorted and in batches; the numbers of its windows go to a file that each pass reads portion by portion,
    so that a task's memory doesn't grow with it. ``start`` and ``background`` have (by, kmer, value).
    """
    size = 4**k
    narrow = next(t for t in (np.uint8, np.uint16, np.int32, np.int64) if size - 1 <= np.iinfo(t).max)
    digits = np.full(256, 4, np.uint8)
    for i, c in enumerate(letters):
        digits[ord(c)] = i

    def windows(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all windows in order, those with other letters left out, and how many each read has."""
        seqs = [x.upper().replace("U", "T") if isinstance(x, str) else "" for x in texts]
        x = digits[np.frombuffer(" ".join([*seqs, " " * k]).encode("ascii", "replace"), np.uint8)]  # a blank is in no window
        n = max(0, len(x) - k + 1)
        codes, good = np.zeros(n, np.int64), np.ones(n, bool)
        for d in range(k):
            codes = codes * 4 + x[d : d + n]
            good &= x[d : d + n] < 4
        ends = np.cumsum([len(q) + 1 for q in seqs])
        counts = np.diff(np.concatenate([[0], np.cumsum(good)])[np.minimum(np.concatenate([[0], ends]), n)])
        return codes[good], counts[counts > 0]

    def fold(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, bg = np.ones(size, np.float32), np.ones(size, np.float32)
        with tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None) as held:
            blocks = 0
            for part in portions(parts):
                tables = part[part["kmer"].notna()]  # these come first
                if len(tables):
                    at, _ = windows(tables["kmer"])
                    w[at], bg[at] = tables["start"].to_numpy(np.float32), tables["background"].to_numpy(np.float32)
                codes, counts = windows(part.loc[part["kmer"].isna(), "seq"])
                if len(counts):
                    np.save(held, codes.astype(narrow))
                    np.save(held, counts)
                    blocks += 1
            for _ in range(passes):
                before, total = w.copy(), np.float32(w.sum())
                z = np.float32(size / total)
                held.seek(0)
                for _ in range(blocks):
                    codes = np.load(held).astype(np.intp)
                    below, a = bg[codes], 0
                    for b in np.cumsum(np.load(held)).tolist():
                        x = codes[a:b]
                        part = w[x]
                        part /= below[a:b]
                        part *= z
                        part /= np.add.reduce(part)
                        np.add.at(w, x, part)
                        total += np.float32(1)
                        z = np.float32(size / total)
                        a = b
                w *= z
                if np.abs(w - before).max() < tolerance:
                    break
        names = ["".join(letters[i >> 2 * (k - 1 - j) & 3] for j in range(k)) for i in range(size)]
        yield pd.DataFrame({**{c: v for c, v in zip(by, key, strict=False)}, "kmer": names, "weight": w.astype(float)})

    keys = list(by) or ["__all"]
    add = (lambda df: df) if by else (lambda df: df.withColumn("__all", F.lit(0)))
    tables = add(start.withColumnRenamed("value", "start").join(background.withColumnRenamed("value", "background"), [*by, "kmer"]))
    fields = [f for f in reads.schema.fields if f.name in by]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "kmer string, weight double"])
    small_batches(reads.sparkSession)
    both = tables.select(*keys, "kmer", "start", "background").unionByName(add(reads).select(*keys, "read_id", "seq"), allowMissingColumns=True)
    # a sample's order is that of its partition: the grouping asks for no sort beyond this one
    apart = both.repartition(*keys).sortWithinPartitions(*keys, F.col("kmer").isNull(), F.col("read_id").asc_nulls_last())
    return apart.groupBy(*keys).applyInPandas(fold, schema)


def ska_batched(windows: DataFrame, start: DataFrame, passes: int = 10) -> DataFrame:
    """(kmer, weight): the same idea at scale: in each pass all reads (read_id, kmer) share by the last pass's weights.

    An approximation of ``ska``: it does not depend on the order of reads. A read's equal k-mers are counted once, so that a
    pass goes over at most 4^k rows a read and brings only these together.
    """
    from utrflow.plans.storage import written

    held = written(windows.groupBy("read_id", "kmer").agg(F.count(F.lit(1)).alias("n")), "held")
    weights = start.withColumnRenamed("value", "weight")
    size = weights.count()
    for _ in range(passes):
        parts = held.join(small(weights, size), "kmer").withColumn("w", F.col("n") * F.col("weight"))
        shares = parts.withColumn("t", F.sum("w").over(Window.partitionBy("read_id")))
        got = shares.groupBy("kmer").agg(F.sum(F.col("w") / F.col("t")).alias("g"))
        mixed = weights.join(got, "kmer", "left").withColumn("s", F.col("weight") + F.coalesce("g", F.lit(0.0)))
        whole = mixed.agg(F.sum("s").alias("whole"))
        weights = written(mixed.crossJoin(F.broadcast(whole)).select("kmer", (F.col("s") / F.col("whole") * size).alias("weight")), "ska")
    return weights


def chunks(reads: DataFrame, n: int) -> DataFrame:
    """With ``part``: contiguous nths of the reads by id, from 1; the first ones have a read more where n doesn't divide their number."""
    rows = numbered(reads, ["read_id"], "__number")
    total = rows.count()
    size, more = divmod(total, n)
    at, wide = F.col("__number"), more * (size + 1)
    part = F.when(at < wide, F.floor(at / (size + 1))).otherwise(more + F.floor((at - wide) / max(1, size)))
    return rows.withColumn("part", (part + 1).cast("int")).drop("__number")


def explained(reads: DataFrame, k: int, parts: int = 10, by: list[str] = ()) -> DataFrame:
    """(by, kmer, share, error): the share of a sample's reads that hold each k-mer, of all 4^k, and its error from ``parts``
    contiguous parts of the reads: the root of their mean squared distance from it over their number."""
    split = chunks(reads, parts)
    whole = fractions(reads_with(split, k, list(by)), split, k, list(by)).select(*by, "kmer", F.col("fraction").alias("share"))
    own = [*by, "part"]
    each = fractions(reads_with(split, k, own), split, k, own).join(whole, [*by, "kmer"])
    error = F.sqrt(F.avg((F.col("fraction") - F.col("share")) ** 2) / F.count(F.lit(1)))
    return whole.join(each.groupBy(*by, "kmer").agg(error.alias("error")), [*by, "kmer"])
