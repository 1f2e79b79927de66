"""Comparison of runs: tables (run, rbp, step, error, correlation, kd) and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from utrflow.functions.measures import range_label


def descents(log: DataFrame, by: list[str] = ("run", "rbp")) -> DataFrame:
    """First and last error, last and best correlation, and the range of Kd where the error is within 5 % of the least."""
    least = F.min("error").over(Window.partitionBy(*by))
    near = log.withColumn("__kd", F.when(F.col("error") <= 1.05 * least, F.col("kd")))
    return near.groupBy(*by).agg(F.min_by("error", "step").alias("first_error"), F.max_by("error", "step").alias("last_error"), F.max_by("correlation", "step").alias("last_correlation"), F.max("correlation").alias("best_correlation"), F.min("__kd").alias("kd_low"), F.max("__kd").alias("kd_high"), F.max("step").alias("steps"))


def quality_flags(d: DataFrame, good: float = 0.5, stable: float = 2.0) -> DataFrame:
    return d.withColumns({"kd_stable": F.col("kd_high") / F.col("kd_low") < stable, "good_fit": F.col("best_correlation") >= good, "less_error": F.col("last_error") < F.col("first_error")})


def run_quantiles(d: DataFrame, value: str, by: list[str] = ("run",)) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    names = ["p05", "p25", "p50", "p75", "p95"]
    return d.groupBy(*by).agg(q.alias("q"), F.avg(value).alias("mean")).select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)], "mean")


def most_variable(d: DataFrame, value: str, key: str = "rbp", n: int = 15) -> DataFrame:
    return d.groupBy(key).agg(F.stddev_pop(value).alias("spread"), F.count(F.lit(1)).alias("runs")).orderBy(F.desc("spread"), key).limit(n)


def best_footprint(grid: DataFrame, by: list[str] = ("rbp",)) -> DataFrame:
    """The (acc_k, shift, scale, error) of least error."""
    return grid.groupBy(*by).agg(F.min(F.struct("error", "acc_k", "shift", "scale")).alias("b")).select(*by, "b.acc_k", "b.shift", "b.scale", "b.error")


def pairwise(d: DataFrame, value: str, one: str, other: str, key: str = "rbp") -> DataFrame:
    """(n, up, down, mean_log2): a value of two runs, by key."""
    a = d.filter(F.col("run") == one).select(key, F.col(value).alias("a"))
    b = d.filter(F.col("run") == other).select(key, F.col(value).alias("b"))
    return a.join(b, key).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") > F.col("b")).cast("int")).alias("up"), F.sum((F.col("a") < F.col("b")).cast("int")).alias("down"), F.avg(F.log2(F.col("a") / F.col("b"))).alias("mean_log2"))


def eq_bins(df: DataFrame, column: str, n: int, name: str) -> DataFrame:
    """Bins 0 to n - 1 between quantiles of the column: the number of inner edges below the value."""
    edges = df.agg(F.percentile(column, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("__e"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.size(F.filter("__e", lambda e: e < F.col(column)))).drop("__e")


def binned_information(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """(mi): mutual information in bits of two binned columns, 1 added to each of the n * n cells."""
    spark = df.sparkSession
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias(a), (F.col("id") % n).cast("int").alias(b))
    joint = cells.join(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("c")), [a, b], "left").withColumn("c", F.coalesce("c", F.lit(0)) + 1)
    p = F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(1)))
    pa = F.sum("c").over(Window.partitionBy(a)) / F.sum("c").over(Window.partitionBy(F.lit(1)))
    pb = F.sum("c").over(Window.partitionBy(b)) / F.sum("c").over(Window.partitionBy(F.lit(1)))
    return joint.select((p * F.log2(p / (pa * pb))).alias("x")).agg(F.sum("x").alias("mi"))


def permuted_information(df: DataFrame, a: str, b: str, n: int, permutations: int = 100, seed: int = 1) -> DataFrame:
    """(mi, mean, sd, z): the information against that of shuffled pairs (b dealt anew by hashes of ``row_id``)."""
    observed = binned_information(df, a, b, n)
    rounds = df.select("row_id", a, b).withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    x = rounds.select("__p", a, F.row_number().over(Window.partitionBy("__p").orderBy("row_id")).alias("__i"))
    y = rounds.select("__p", b, F.row_number().over(Window.partitionBy("__p").orderBy(F.xxhash64("row_id", "__p", F.lit(seed)), "row_id")).alias("__i"))
    joint = x.join(y, ["__p", "__i"]).groupBy("__p", a, b).agg(F.count(F.lit(1)).alias("c"))
    spark = df.sparkSession
    frame = spark.range(permutations * n * n).select(F.floor(F.col("id") / (n * n)).cast("int").alias("__p"), F.floor(F.col("id") / n % n).cast("int").alias(a), (F.col("id") % n).cast("int").alias(b))
    full = frame.join(joint, ["__p", a, b], "left").withColumn("c", F.coalesce("c", F.lit(0)) + 1)
    t, ta, tb = (F.sum("c").over(Window.partitionBy("__p", *k)) for k in ([], [a], [b]))
    each = full.select("__p", (F.col("c") / t * F.log2(F.col("c") * t / (ta * tb))).alias("x")).groupBy("__p").agg(F.sum("x").alias("mi"))
    spread = each.agg(F.avg("mi").alias("mean"), F.stddev_pop("mi").alias("sd"))
    return observed.crossJoin(F.broadcast(spread)).withColumn("z", (F.col("mi") - F.col("mean")) / F.col("sd"))


def count_enrichment(counts: DataFrame, control: DataFrame, crosstalk: DataFrame | None = None, least: int = 100, inverted: bool = False) -> DataFrame:
    """(oligo, enrichment): (c + 1) / (c0 + 1) * N0 / N; oligos with few control counts or cross-talk left out.

    ``inverted`` scales by N / N0, as some published tables do.
    """
    if crosstalk is not None:
        counts = counts.join(crosstalk.select("oligo"), "oligo", "left_anti")
    both = counts.withColumnRenamed("n", "c").join(control.select("oligo", F.col("n").alias("c0")), "oligo").filter(F.col("c0") >= least)
    scale = both.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("N")))).crossJoin(F.broadcast(control.agg(F.sum("n").alias("N0"))))
    factor = F.col("N") / F.col("N0") if inverted else F.col("N0") / F.col("N")
    return scale.select("oligo", ((F.col("c") + 1) / (F.col("c0") + 1) * factor).alias("enrichment"))


def crosstalk_oligos(scores: DataFrame, cut: float = 800.0) -> DataFrame:
    """(oligo): those whose alignment scores (query, subject, score) with another add up to more than the cut."""
    return scores.filter("query != subject").groupBy("query", "subject").agg(F.sum("score").alias("s")).filter(F.col("s") > cut).select(F.col("query").alias("oligo")).distinct()


def beacon(wide: DataFrame, key: str, replicates: int = 3) -> DataFrame:
    """(conc, mean, low, high) of (sensor - folded) / (unfolded - folded) over replicates, columns sensor_i, folded_i, unfolded_i."""
    parts = ", ".join(f"{i}, sensor_{i}, folded_{i}, unfolded_{i}" for i in range(1, replicates + 1))
    long = wide.selectExpr(key, f"stack({replicates}, {parts}) as (replicate, sensor, folded, unfolded)")
    x = (F.col("sensor") - F.col("folded")) / (F.col("unfolded") - F.col("folded"))
    return long.groupBy(key).agg(F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"))


def top_r_label(r):
    """The ranges of top R."""
    return range_label(r, [(20.0, "20+"), (5.0, "5-20"), (2.0, "2-5"), (1.0, "1-2")], "<1")
