"""k-mer counts and profiles of reads: tables with columns ``by``..., read_id, seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utrflow.functions.sequence import all_kmers, kmer_index, kmers, pieces
from utrflow.plans.storage import small


def positions(reads: DataFrame, k: int, by: list[str] = (), read: str = "read_id", seq: str = "seq", name: str = "kmer", at: str = "pos") -> DataFrame:
    """(by, read, at, name): every window of k bases with its place from 0. No shuffle. Windows with other letters are left out."""
    return reads.select(*by, read, F.posexplode(kmers(F.col(seq), k)).alias(at, name)).filter(F.col(name).rlike("^[ACGTUacgtu]+$"))


def counts(reads: DataFrame, k: int, by: list[str] = (), weight: Column | None = None, **names) -> DataFrame:
    """(by, kmer, n): occurrences, or the sum of a weight of the reads (a column named ``weight``)."""
    if weight is not None:
        reads = reads.withColumn("__w", weight)
        return positions(reads, k, [*by, "__w"], **names).groupBy(*by, "kmer").agg(F.sum("__w").alias("n"))
    return positions(reads, k, by, **names).groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))


def counts_per_read(reads: DataFrame, k: int, read: str = "read_id") -> DataFrame:
    return positions(reads, k, read=read).groupBy(read, "kmer").agg(F.count(F.lit(1)).alias("n"))


def filled(counted: DataFrame, samples: DataFrame, k: int, letters: str = "ACGT", name: str = "kmer") -> DataFrame:
    """``counted`` (by, kmer, n) with a row of n = 0 for each of the 4^k k-mers that one of the ``samples`` (by) hasn't."""
    every = all_kmers(counted.sparkSession, k, letters).withColumnRenamed("kmer", name)
    frame = samples.crossJoin(small(every, 4**k)) if samples.columns else every
    return frame.join(counted, [*samples.columns, name], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def frequencies(counted: DataFrame, k: int, by: list[str] = (), pseudo: float = 10.0, letters: str = "ACGT") -> DataFrame:
    """(by, kmer, n, freq) of all 4^k k-mers: (n + pseudo) / sum(n + pseudo) * 4^k, those that don't occur included."""
    full = filled(counted.select(*by, "kmer", "n"), counted.select(*by).distinct(), k, letters)
    total = full.groupBy(*by).agg(F.sum(F.col("n") + pseudo).alias("__total"))
    full = full.join(F.broadcast(total), list(by)) if by else full.crossJoin(F.broadcast(total))
    return full.withColumn("freq", (F.col("n") + pseudo) / F.col("__total") * 4**k).drop("__total")


def reads_with(reads: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """(by, kmer, n): the number of reads that hold each k-mer."""
    return reads.select(*by, F.explode(F.array_distinct(kmers(F.col("seq"), k))).alias("kmer")).groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))


def reads_with_any(reads: DataFrame, some: list[str], by: list[str] = ()) -> DataFrame:
    """(by, n): the number of reads that hold any of the k-mers."""
    hit = F.lit(False)
    for x in some:
        hit = hit | F.col("seq").contains(x)
    return reads.filter(hit).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def pure_reads(reads: DataFrame, some: list[str], k: int, by: list[str] = ()) -> DataFrame:
    """(by, kmer, n): reads that hold exactly one of the k-mers, by which."""
    held = reads.select(*by, "read_id", F.explode(kmers(F.col("seq"), k)).alias("kmer")).filter(F.col("kmer").isin(some)).distinct()
    one = held.groupBy(*by, "read_id").agg(F.count(F.lit(1)).alias("__n"), F.min("kmer").alias("kmer")).filter("__n = 1")
    return one.groupBy(*by, "kmer").agg(F.count(F.lit(1)).alias("n"))


def best_hits(reads: DataFrame, ranks: DataFrame, k: int, by: list[str] = (), read: str = "read_id") -> DataFrame:
    """(by, kmer, n): each read counts for the k-mer of the best rank that it holds; ``ranks`` has (kmer, rank)."""
    held = positions(reads, k, by, read).join(F.broadcast(ranks), "kmer")
    # least ranks are numbers, which are aggregated without a sort of all windows; the k-mers come back at the end
    best = held.groupBy(*by, read).agg(F.min("rank").alias("rank")).groupBy(*by, "rank").agg(F.count(F.lit(1)).alias("n"))
    return best.join(F.broadcast(ranks.select("kmer", "rank")), "rank").select(*by, "kmer", "n")


def fractions(hits: DataFrame, reads: DataFrame, k: int, by: list[str] = (), pseudo: float = 10.0, letters: str = "ACGT") -> DataFrame:
    """(by, kmer, n, fraction) of all 4^k k-mers: (n + pseudo) / (reads + pseudo), those that no read holds included."""
    total = reads.groupBy(*by).agg(F.count(F.lit(1)).alias("__reads"))
    full = filled(hits, total.select(*by), k, letters)
    joined = full.join(F.broadcast(total), list(by)) if by else full.crossJoin(F.broadcast(total))
    return joined.withColumn("fraction", (F.col("n") + pseudo) / (F.col("__reads") + pseudo)).drop("__reads")


def pairs(reads: DataFrame, k: int, k2: int | None = None, by: list[str] = (), first: list[str] | None = None, least: int | None = None, most: int | None = None, read: str = "read_id") -> DataFrame:
    """(by, read, a, b, d): ordered pairs of k-mers of one read, b starting d bases after a (least <= d <= most).

    Made within the read's row, piece by piece: no shuffle, and linear in a read's length where ``most`` bounds d. ``first``
    restricts a; negative d means b before a.
    """
    k2 = k2 or k
    least = k if least is None else least
    # pieces of the read with all that their own starts (``own`` of them from ``from`` on) can meet
    if most is None:
        parts = F.array(F.struct(F.col("seq").alias("text"), F.lit(0).alias("from"), F.length("seq").alias("own")))
    else:
        before, after = max(0, -least), max(k - 1, most + k2 - 1, 0)
        size = max(128, before, after)
        parts = F.transform(pieces(F.col("seq"), size, before, after), lambda p, i: F.struct(p.alias("text"), F.when(i > 0, before).otherwise(0).alias("from"), F.least(F.lit(size), F.length("seq") - i * size).alias("own")))
    cut = reads.filter(F.length("seq") >= k).select(*by, read, F.explode(parts).alias("c")).select(*by, read, "c.*").filter("own > 0")
    length = F.length("text")
    low = lambda i: F.greatest(i + least, F.lit(0))
    width = lambda i: (F.least(i + most + k2, length) if most is not None else length) - low(i)
    around = F.transform(F.sequence(F.col("from"), F.col("from") + F.col("own") - 1), lambda i: F.struct(F.substr("text", i + 1, F.lit(k)).alias("a"), F.substr("text", low(i) + 1, F.greatest(width(i), F.lit(0))).alias("near"), (low(i) - i).alias("gap")))
    # the neighbourhood is a column of its own, so that its windows are cut from a short text
    rows = cut.select(*by, read, F.explode(around).alias("p")).filter((F.length("p.a") == k) & (F.length("p.near") >= k2))
    if first is not None:
        rows = rows.filter(F.col("p.a").isin(first))
    made = F.transform(F.sequence(F.lit(0), F.length("p.near") - k2), lambda j: F.struct(F.substr("p.near", j + 1, F.lit(k2)).alias("b"), (F.col("p.gap") + j).alias("d")))
    return rows.select(*by, read, F.col("p.a").alias("a"), F.explode(made).alias("q")).select(*by, read, "a", "q.b", "q.d")


#: Up to this length windows are counted before their pairs are taken apart: so short ones repeat often.
COUNTED_WINDOW = 10


def joint_by_distance(reads: DataFrame, k: int, by: list[str] = (), most: int | None = None) -> DataFrame:
    """(by, a, b, d, n): counts of pairs at each distance between starts, k at least."""
    if most is None or most + k > COUNTED_WINDOW:
        return pairs(reads, k, by=by, most=most).groupBy(*by, "a", "b", "d").agg(F.count(F.lit(1)).alias("n"))
    # a window holds a k-mer and all that it can meet; at the read's end it is filled up
    windows = kmers(F.concat("seq", F.lit("$" * most)), most + k)
    seen = reads.select(*by, F.explode(windows).alias("w")).groupBy(*by, "w").agg(F.count(F.lit(1)).alias("n"))
    made = F.transform(F.sequence(F.lit(k), F.lit(most)), lambda d: F.struct(F.substr("w", d + 1, F.lit(k)).alias("b"), d.alias("d")))
    cells = seen.select(*by, F.substring("w", 1, k).alias("a"), "n", F.explode(made).alias("q")).filter(~F.contains(F.concat("a", "q.b"), F.lit("$")))
    return cells.groupBy(*by, "a", "q.b", "q.d").agg(F.sum("n").alias("n"))


def mutual_information(joint: DataFrame, freqs: DataFrame, k: int, by: list[str] = (), pseudo: float = 10.0, letters: str = "ACGT") -> DataFrame:
    """(by, d, mi): sum of p log2(p / (fa fb)) over all 16^k pairs of k-mers at each distance.

    p is the pair's share of the counts with ``pseudo`` added to each (pairs that don't occur included), fa and fb the k-mers'
    shares among ``frequencies`` (by, kmer, freq) of the whole reads.
    """
    keys = [*by, "d"]
    f = lambda name: freqs.select(*by, F.col("kmer").alias(name), (F.col("freq") / 4**k).alias(f"__{name}"))
    cells = filled(joint, joint.select(*keys).distinct().crossJoin(small(all_kmers(joint.sparkSession, k, letters).withColumnRenamed("kmer", "a"), 4**k)), k, letters, "b")
    cells = cells.withColumn("n", F.col("n") + pseudo)
    total = cells.groupBy(*keys).agg(F.sum("n").alias("t"))
    full = cells.join(F.broadcast(total), keys).join(small(f("a"), 4**k), [*by, "a"]).join(small(f("b"), 4**k), [*by, "b"])
    p = F.col("n") / F.col("t")
    return full.groupBy(*keys).agg(F.sum(p * F.log2(p / (F.col("__a") * F.col("__b")))).alias("mi"))


def profile(reads: DataFrame, k: int, by: list[str] = ()) -> DataFrame:
    """(by, kmer, pos, n)."""
    return positions(reads, k, by).groupBy(*by, "kmer", "pos").agg(F.count(F.lit(1)).alias("n"))


def flank_profile(reads: DataFrame, core: str, k: int, reach: int, by: list[str] = ()) -> DataFrame:
    """(by, d, kmer, n): k-mers at signed offsets round each place of a core k-mer, those that overlap it included."""
    met = pairs(reads, len(core), k, by, [core], -reach, reach)
    return met.groupBy(*by, "d", F.col("b").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def crosstalk(reads: DataFrame, k1: int, k2: int) -> DataFrame:
    """(a, b, n): starts of a k2-mer within k1 bases either side of a k1-mer's."""
    return pairs(reads, k1, k2, least=-k1, most=k1).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def expected_pairs(profiles: DataFrame, reads: int) -> DataFrame:
    """(a, b, d, expected): pairs that independent places would give, from (kmer, pos, n) of so many reads."""
    a = profiles.select(F.col("kmer").alias("a"), F.col("pos").alias("pa"), F.col("n").alias("na"))
    b = profiles.select(F.col("kmer").alias("b"), F.col("pos").alias("pb"), F.col("n").alias("nb"))
    # an equal key (the second place) instead of an inequality
    last = F.broadcast(profiles.agg(F.max("pos").alias("last")))
    ahead = a.crossJoin(last).filter(F.col("pa") + F.length("a") <= F.col("last"))
    return ahead.select("a", "pa", "na", F.explode(F.sequence(F.col("pa") + F.length("a"), F.col("last"))).alias("pb")).join(b, "pb").groupBy("a", "b", (F.col("pb") - F.col("pa")).alias("d")).agg((F.sum(F.col("na") * F.col("nb")) / reads).alias("expected"))


def markov_frequencies(short: DataFrame, long: DataFrame, k: int) -> DataFrame:
    """(kmer, freq): shares of k-mers extrapolated from those of (m-1)- and m-mers (kmer, n): a chain of transitions."""
    total = short.agg(F.sum("n").alias("t"))
    starts = short.crossJoin(F.broadcast(total)).select(F.col("kmer"), (F.col("n") / F.col("t")).alias("freq"))
    steps = long.withColumn("from", F.expr("left(kmer, length(kmer) - 1)")).withColumn("base", F.expr("right(kmer, 1)"))
    sums = steps.groupBy("from").agg(F.sum("n").alias("s"))
    steps = F.broadcast(steps.join(sums, "from").select("from", "base", (F.col("n") / F.col("s")).alias("p")))  # 4^m rows
    m1 = len(short.first()["kmer"])
    out = starts
    for _ in range(k - m1):
        out = out.withColumn("from", F.expr(f"right(kmer, {m1})")).join(steps, "from").select(F.concat("kmer", "base").alias("kmer"), (F.col("freq") * F.col("p")).alias("freq"))
    return out


def hits_per_read(reads: DataFrame, kmer: str, read: str = "read_id") -> DataFrame:
    """(read, hits, last): the number of places of a k-mer and its last one (null without)."""
    at = F.filter(F.transform(kmers(F.col("seq"), len(kmer)), lambda w, i: F.when(w == kmer, i)), lambda i: i.isNotNull())
    return reads.select(read, F.size(at).alias("hits"), F.array_max(at).alias("last"))


def accessibility_weighted(reads: DataFrame, k: int, by: list[str] = (), acc: str = "acc", offset: int = 0) -> DataFrame:
    """(by, kmer, n, weight): occurrences and the sums of accessibility at them; ``acc`` has a value for each place of a read."""
    cells = F.arrays_zip(kmers(F.col("seq"), k).alias("kmer"), F.slice(F.col(acc), offset + 1, F.greatest(F.length("seq") - k + 1, F.lit(0))).alias("w"))
    return reads.select(*by, F.explode(cells).alias("c")).filter("c.kmer is not null").groupBy(*by, F.col("c.kmer").alias("kmer")).agg(F.count(F.lit(1)).alias("n"), F.sum("c.w").alias("weight"))


def binned_accessibility(reads: DataFrame, k: int, bins: int, acc: str = "acc") -> DataFrame:
    """(kmer, bin, n): accessibilities from 0 to 1 at each k-mer's places, in equal bins."""
    cells = F.arrays_zip(kmers(F.col("seq"), k).alias("kmer"), F.slice(F.col(acc), 1, F.greatest(F.length("seq") - k + 1, F.lit(0))).alias("w"))
    which = F.least(F.floor(F.col("c.w") * bins), F.lit(bins - 1)).cast("int")
    return reads.select(F.explode(cells).alias("c")).filter("c.kmer is not null and c.w is not null").groupBy(F.col("c.kmer").alias("kmer"), which.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def accessibility_profile(reads: DataFrame, kmer: str, reach: int, acc: str = "acc") -> DataFrame:
    """(d, n, mean): mean accessibility at offsets round a k-mer's places; offsets outside the read are left out."""
    k = len(kmer)
    at = F.filter(F.transform(kmers(F.col("seq"), k), lambda w, i: F.when(w == kmer, i)), lambda i: i.isNotNull())
    around = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(-reach), F.lit(k + reach - 1)), lambda d: F.struct(d.alias("d"), F.get(F.col(acc), i + d).alias("w")))))
    return reads.select(F.explode(around).alias("c")).filter("c.w is not null").groupBy("c.d").agg(F.count(F.lit(1)).alias("n"), F.avg("c.w").alias("mean"))


def base_profile(reads: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, pos, base, share) and with it each place's entropy in bits (by, pos, entropy) as a second column set."""
    cells = positions(reads, 1, by).groupBy(*by, "pos", F.col("kmer").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy(*by, "pos").agg(F.sum("n").alias("t"))
    shares = cells.join(total, [*by, "pos"]).withColumn("share", F.col("n") / F.col("t")).drop("t")
    entropy = shares.groupBy(*by, "pos").agg(F.sum(-F.col("share") * F.log2("share")).alias("entropy"))
    return shares.join(entropy, [*by, "pos"])


def index_rows(reads: DataFrame, k: int, read: str = "read_id") -> DataFrame:
    """(read, index): the numbers of a read's k-mers in order, null for windows with other letters than bases."""
    return reads.select(read, F.transform(kmers(F.col("seq"), k), kmer_index).alias("index"))


def presence(reads: DataFrame, kmer: str, read: str = "read_id") -> DataFrame:
    """(read, present): for each place of a read whether the k-mer starts there."""
    return reads.select(read, F.transform(kmers(F.col("seq"), len(kmer)), lambda w: w == kmer).alias("present"))


def from_sequences(spark, sequences: list[str]) -> DataFrame:
    """(read_id, seq) of a few sequences of the driver, numbered from 0."""
    return spark.createDataFrame(list(enumerate(sequences)), "read_id long, seq string")


def joined_counts(tables: list[DataFrame], names: list[str]) -> DataFrame:
    """(kmer, one column a table) of the k-mers that all tables (kmer, n) have: chained inner joins on one partitioning."""
    out = None
    for t, name in zip(tables, names, strict=True):
        t = t.select("kmer", F.col("n").alias(name))
        out = t if out is None else out.join(t, "kmer")
    return out


def weighted_ratios(bound: DataFrame, control: DataFrame, bound_reads: DataFrame, control_reads: int, k: int, by: list[str] = (), letters: str = "ACGT") -> DataFrame:
    """(by, kmer, w) of all 4^k k-mers: accessibility-weighted counts (kmer, weight), plus 1, by reads, over the control's.

    ``bound_reads`` has the number of reads (by, reads) of each sample.
    """
    every = small(all_kmers(bound.sparkSession, k, letters), 4**k)
    frame = bound_reads.crossJoin(every).join(bound.select(*by, "kmer", F.col("weight").alias("__b")), [*by, "kmer"], "left")
    frame = frame.join(small(control.select("kmer", F.col("weight").alias("__c")), 4**k), "kmer", "left")
    own = lambda c, n: (F.coalesce(c, F.lit(0.0)) + 1) / n
    return frame.select(*by, "kmer", (own("__b", F.col("reads")) / own("__c", F.lit(control_reads))).alias("w"))
