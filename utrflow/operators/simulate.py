"""Random reads and bound reads, every draw a hash of a seed and the row: repeatable on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def uniform(seed: int, *ids: Column) -> Column:
    """A number between 0 and 1 (both excluded) for each row."""
    return (F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def normal(seed: int, *ids: Column) -> Column:
    """Box and Muller's draw."""
    return F.sqrt(-2 * F.log(uniform(seed, *ids, F.lit(1)))) * F.cos(2 * math.pi * uniform(seed, *ids, F.lit(2)))


def choice(u: Column, shares: dict[str, float]) -> Column:
    """The entry in whose part of [0, 1) the number lies."""
    total, upto, out = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        upto += share / total
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(name)


def reads(spark: SparkSession, n: int, length: int, seed: int = 20_011, shares: dict[str, float] | None = None) -> DataFrame:
    """(read_id, seq): independent bases."""
    shares = shares or dict.fromkeys("ACGU", 1.0)
    at = F.sequence(F.lit(1), F.lit(length))
    return spark.range(n).select(F.col("id").alias("read_id"), F.array_join(F.transform(at, lambda i: choice(uniform(seed, F.col("id"), i), shares)), "").alias("seq"))


def markov_reads(spark: SparkSession, n: int, length: int, start: dict[str, float], steps: dict[str, dict[str, float]], seed: int = 20_011) -> DataFrame:
    """(read_id, seq): each base drawn by the one before it."""
    def step(seq: Column, i: Column) -> Column:
        u, last, out = uniform(seed, F.col("id"), i), F.right(seq, F.lit(1)), None
        for base, shares in steps.items():
            out = F.when(last == base, choice(u, shares)) if out is None else out.when(last == base, choice(u, shares))
        return F.concat(seq, out.otherwise("N"))

    first = choice(uniform(seed, F.col("id"), F.lit(0)), start)
    more = F.aggregate(F.sequence(F.lit(1), F.lit(length - 1)), first, step) if length > 1 else first
    return spark.range(n).select(F.col("id").alias("read_id"), more.alias("seq"))


def bound(scored: DataFrame, conc: float, unspecific: float = 0.0, seed: int = 1, z: str = "z") -> DataFrame:
    """The reads that stay bound: each with probability 1 - (1 - Zc / (Zc + 1)) (1 - unspecific)."""
    p = 1 - (1 - F.col(z) * conc / (F.col(z) * conc + 1)) * (1 - unspecific)
    return scored.filter(uniform(seed, F.col("read_id")) < p)


def landscape(kmers: DataFrame, sigma: float = 1.0, least: float = -10.0, seed: int = 1) -> DataFrame:
    """(kmer, energy): negative log-normal energies, centred, scaled so that the least is ``least``."""
    raw = kmers.withColumn("e", -F.exp(normal(seed, F.col("kmer")) * sigma))
    mean = raw.agg(F.avg("e").alias("m"), F.min("e").alias("lo"))
    return raw.crossJoin(F.broadcast(mean)).select("kmer", ((F.col("e") - F.col("m")) / (F.col("lo") - F.col("m")) * least).alias("energy"))


def kd(energy: Column) -> Column:
    return F.exp(energy) * 1e9


def occupancies(energies: DataFrame, protein: float) -> DataFrame:
    return energies.withColumn("occupancy", protein / (protein + kd(F.col("energy"))))


def predicted_r(occupied: DataFrame, overlaps: DataFrame, beta: float, kappa: float = 1.0) -> DataFrame:
    """(kmer, r): kappa * arcsinh(1.5 (M occ + beta)), mean 1; ``overlaps`` (kmer, other, m) is the sparse matrix M."""
    seen = overlaps.join(occupied.select(F.col("kmer").alias("other"), "occupancy"), "other").groupBy("kmer").agg(F.sum(F.col("m") * F.col("occupancy")).alias("s"))
    raw = occupied.select("kmer").join(seen, "kmer", "left").withColumn("r", kappa * F.asinh(1.5 * (F.coalesce("s", F.lit(0.0)) + beta)))
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("r").alias("m")))).select("kmer", (F.col("r") / F.col("m")).alias("r"))


def sample(df: DataFrame, n: int, seed: int, by: list[str] = (), replace: bool = False) -> DataFrame:
    """n rows drawn by hashes of ``by`` (all columns, if empty); with ``replace`` each row a Poisson number of times, n on average."""
    ids = [F.col(c) for c in (by or df.columns)]
    if not replace:
        return df.orderBy(F.xxhash64(F.lit(seed), *ids), *ids).limit(n)
    total = max(1, df.count())
    u, rate, weight = uniform(seed, *ids), n / total, F.lit(0)
    upto, p = 0.0, math.exp(-rate)
    for k in range(20 + int(4 * rate)):
        upto += p
        p *= rate / (k + 1)
        weight = weight + F.when(u > upto, 1).otherwise(0)
    return df.withColumn("__n", weight).withColumn("__i", F.explode(F.expr("sequence(1, greatest(__n, 1))"))).filter("__n > 0").drop("__n", "__i")


def per_key(df: DataFrame, by: list[str], n: int, seed: int, ids: list[str]) -> DataFrame:
    """At most n rows of each key, by hash."""

    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), *ids), *ids))).filter(F.col("__r") <= n).drop("__r")
