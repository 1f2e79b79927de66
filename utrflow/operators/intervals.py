"""Joins and merges of intervals [start, end) within a chromosome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each bin that the interval touches; empty intervals touch that of their start."""
    lo, hi = F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width)
    return df.withColumn("__bin", F.explode(F.sequence(lo, hi)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str] = ("chrom",), left_on: tuple[str, str] = ("start", "end"), right_on: tuple[str, str] = ("r_start", "r_end"), width: int = 1 << 9, how: str = "inner", left_id: str | None = None, coarse: int | None = 64) -> DataFrame:
    """All pairs of overlapping intervals with equal keys: an equi-join on (keys, bin), whose every pair is made once.

    Both sides are spread over bins of ``width``; a pair counts in the bin where the later start lies. Right intervals of
    more than ``coarse`` bins are joined on bins ``coarse`` times as wide instead, so that none is spread without bound
    (``coarse=None``: there are none). ``how="left"`` keeps left rows without a hit; it needs ``left_id``, a unique column. Half-open: touching ends don't
    overlap. Rows with null keys or bounds meet nothing.
    """
    keys = list(keys)
    ls, le, rs, re_ = *left_on, *right_on

    def one(a: DataFrame, b: DataFrame, w: int) -> DataFrame:
        pairs = _binned(a, ls, le, w).join(_binned(b, rs, re_, w), [*keys, "__bin"])
        return pairs.filter((F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le)) & (F.col("__bin") == F.floor(F.greatest(ls, rs) / w))).drop("__bin")

    if coarse is None:
        hits = one(left, right, width)
    else:
        long = (F.col(re_) - F.col(rs)) > width * coarse
        hits = one(left, right.filter(~long), width).unionByName(one(left, right.filter(long), width * coarse))
    if how == "inner":
        return hits
    if left_id is None:
        raise ValueError("a left join needs left_id")
    return hits.unionByName(left.join(hits.select(left_id).distinct(), left_id, "left_anti"), allowMissingColumns=True)


def with_fallback(left: DataFrame, first: DataFrame, second: DataFrame, left_id: str, **options) -> DataFrame:
    """Overlaps with ``first``; rows without any meet ``second``. Always by anti-join on the row's id."""
    hits = overlap_join(left, first, **options)
    rest = left.join(hits.select(left_id).distinct(), left_id, "left_anti")
    return hits.unionByName(overlap_join(rest, second, **options), allowMissingColumns=True)


def collapsed(df: DataFrame, by: list[str], value: str, name: str, separator: str = "|", order: list[str] | None = None, distinct: bool = False, empty: str | None = None) -> DataFrame:
    """(by, name): the values of each group joined in the given order (of the values themselves, if None).

    Null values are passed over; a group of only such gives ``empty``.
    """
    cells = F.struct(*[F.col(c) for c in (order or [])], F.col(value).alias("__value"))
    got = F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), cells))), lambda x: x["__value"])
    text = F.array_join(F.array_distinct(got) if distinct else got, separator)
    return df.groupBy(*by).agg(F.when(F.count(value) > 0, text).otherwise(F.lit(empty)).alias(name))


def merge_overlapping(df: DataFrame, by: list[str], start: str = "start", end: str = "end", gap: int = 0, lists: list[str] = (), width: int = 1 << 20) -> DataFrame:
    """One row for each run of intervals that overlap (or lie at most ``gap`` apart; -1: share a base): by, start, end, n.

    ``lists`` are columns of which each run gets the sorted distinct values, comma-joined. Intervals are merged within bins
    of ``width``, so that one key's rows don't meet in one task; only a row for each bin goes through a key's whole order: how
    far the bins before it reach, and how many runs they begin.
    """
    rows = df.withColumn("__bin", F.coalesce(F.floor(F.col(start) / width), F.lit(-(1 << 62))).cast("long"))
    order = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda names: [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*names, "__bin"]]

    def with_bins(left: DataFrame, bins: DataFrame, name: str) -> DataFrame:
        return left.alias("l").join(bins.alias("r"), same(by), "left").select("l.*", f"r.{name}")

    reach = rows.groupBy(*by, "__bin").agg(F.max(end).alias("__m")).withColumn("__reach", F.max("__m").over(order))
    w = Window.partitionBy(*by, "__bin").orderBy(start, end)
    before = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__reach"))
    marked = with_bins(rows, reach, "__reach").withColumn("__new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    runs = marked.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a bin's run 0 belongs to the last run before it
    parts = runs.groupBy(*by, "__bin", "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"), *[F.collect_set(c).alias(c) for c in lists])
    begun = parts.groupBy(*by, "__bin").agg(F.max("__run").alias("__k")).withColumn("__begun", F.coalesce(F.sum("__k").over(order), F.lit(0)))
    whole = with_bins(parts, begun, "__begun").groupBy(*by, (F.col("__begun") + F.col("__run")).alias("__run"))
    extra = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), ",").alias(c) for c in lists]
    return whole.agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n"), *extra).drop("__run")


def lifted(df: DataFrame, chain: DataFrame, row_id: str, chrom: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Positions carried to another assembly: the row with chrom, start, end lifted and ``flipped`` for strand changes.

    ``chain`` has blocks (chrom, r_start, r_end, to_chrom, to_start, to_size, to_strand). Positions in no block, or in
    several, are left out; carry ``row_id`` to find them. The lifted chromosome is used, whichever way it is lifted.
    """
    own = df.withColumnRenamed(chrom, "chrom").withColumnRenamed(start, "start").withColumnRenamed(end, "end")
    hits = overlap_join(own, chain).filter((F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end")))
    offset, size = F.col("start") - F.col("r_start"), F.col("end") - F.col("start")
    flipped = F.col("to_strand") == "-"
    placed = hits.withColumn("__to", F.when(flipped, F.col("to_size") - F.col("to_start") - offset - size).otherwise(F.col("to_start") + offset))
    once = placed.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(row_id))).filter("__n = 1")
    columns = [c for c in own.columns if c not in ("chrom", "start", "end")]
    return once.select(*columns, F.col("to_chrom").alias(chrom), F.col("__to").alias(start), (F.col("__to") + size).alias(end), flipped.alias("flipped"))


def fetch(regions: DataFrame, genome: DataFrame, size: int, start: Column, end: Column, chrom: str = "chrom") -> DataFrame:
    """``regions`` with ``seq``, the bases [start, end) of a genome cut into chunks (chrom, chunk, seq) of ``size`` bases.

    A region shorter than a chunk touches two at most: it is an equi-join on (chrom, chunk) and a group of those. Regions
    that leave the chromosome are cut at its ends; those without sequence are left out.
    """
    marked = regions.withColumns({"__start": start, "__end": end, "__id": F.monotonically_increasing_id()})
    parts = marked.withColumn("chunk", F.explode(F.sequence(F.floor(F.greatest(F.col("__start"), F.lit(0)) / size), F.floor((F.col("__end") - 1) / size)))).join(genome.select(F.col("chrom").alias(chrom), "chunk", F.col("seq").alias("__seq")), [chrom, "chunk"])
    lo = F.greatest(F.col("__start"), F.col("chunk") * size)
    hi = F.least(F.col("__end"), (F.col("chunk") + 1) * size)
    piece = F.substr("__seq", (lo - F.col("chunk") * size + 1).cast("int"), (hi - lo).cast("int"))
    got = parts.select("__id", *regions.columns, F.struct("chunk", piece.alias("s")).alias("__piece"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list("__piece")), lambda p: p["s"]), "")
    return got.groupBy("__id", *regions.columns).agg(seq.alias("seq")).drop("__id")


def star(df: DataFrame, *sides: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left joins to several tables on equal column names."""
    for side, on in sides:
        df = df.join(side, on, "left")
    return df


def best_per_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` should leave no ties."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def until(df: DataFrame, order: list[Column], stop: Column, least: int, by: list[str] = ()) -> DataFrame:
    """Rows in order up to the first where ``stop`` holds after ``least`` rows, without that row."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.row_number().over(w)
    ended = F.sum(F.when(stop & (F.col("__n") > least), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__n", n).withColumn("__ended", ended).filter("__ended = 0").drop("__n", "__ended")
