"""Column expressions on nucleotide strings. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: IUPAC ambiguity codes and the bases that each stands for.
IUPAC = {"A": "A", "C": "C", "G": "G", "U": "U", "T": "U", "R": "AG", "Y": "CU", "S": "CG", "W": "AU", "K": "GU", "M": "AC", "B": "CGU", "D": "AGU", "H": "ACU", "V": "ACG", "N": "ACGU"}


def with_chr(chrom: Column) -> Column:
    """The chromosome with its chr prefix, decided row by row."""
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def reverse_complement(seq: Column) -> Column:
    """Of DNA or RNA; U counts as T. Lower case stays lower."""
    return F.reverse(F.translate(seq, "ACGTUacgtu", "TGCAAtgcaa"))


def on_strand(seq: Column, strand: Column) -> Column:
    """The sequence as the strand reads it."""
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def canonical(seq: Column) -> Column:
    """Whether the sequence holds only A, C, G, T, U of either case, and at least one."""
    return seq.rlike("^[ACGTUacgtu]+$")


def middle(seq: Column, centre: int, k: int) -> Column:
    """The 2k-1 bases round position ``centre`` (from 1): each window of k in it holds that base."""
    return F.substring(seq, centre - k + 1, 2 * k - 1)


def substituted(window: Column, alt: Column, at: int) -> Column:
    """The window with its base at position ``at`` (from 1) replaced."""
    return F.concat(F.substring(window, 1, at - 1), alt, F.substring(window, at + 1, 2**31 - 1))


def pieces(seq: Column, size: int = 128, left: int = 0, right: int = 0) -> Column:
    """The sequence cut into pieces of ``size`` letters, each with up to ``left`` letters before and ``right`` after it.

    A substring is found by walking the text from its start, so that all windows of a long text would cost its length squared;
    in pieces they cost its length. ``size`` must be at least ``left`` and ``right``.
    """
    cut = F.split(seq, rf"(?s)(?<=\G.{{{size}}})")
    if right:
        cut = F.zip_with(cut, F.slice(cut, F.lit(2), F.size(cut)), lambda x, y: F.concat(x, F.left(F.coalesce(y, F.lit("")), F.lit(right))))
    if left:
        before = F.concat(F.array(F.lit("")), F.split(seq, rf"(?s)(?<=\G.{{{size}}})"))
        cut = F.zip_with(F.slice(before, F.lit(1), F.size(before) - 1), cut, lambda x, y: F.concat(F.right(x, F.lit(left)), y))
    return cut


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of the sequence in order; an empty array for shorter ones."""
    windows = lambda p: F.when(F.length(p) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - (k - 1), F.lit(1))), lambda i: F.substr(p, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(seq) >= k, F.flatten(F.transform(pieces(seq, max(128, k), 0, k - 1), windows))).otherwise(F.array().cast("array<string>"))


def padded(seq: Column, left: str, right: str, k: int | None = None) -> Column:
    """The sequence between adapters, of which k - 1 bases are kept on either side (all, if k is None)."""
    a, b = (left, right) if k is None else (left[len(left) - (k - 1) :] if k > 1 else "", right[: k - 1])
    return F.concat(F.lit(a), seq, F.lit(b))


def kmer_index(kmer: Column) -> Column:
    """The k-mer as a base-4 number with A 0, C 1, G 2, T or U 3; null if it holds anything else."""
    return F.when(canonical(kmer), F.conv(F.translate(F.upper(kmer), "ACGTU", "01233"), 4, 10).cast("bigint"))


def index_kmer(index: Column, k: int, letters: str = "ACGU") -> Column:
    return F.translate(F.lpad(F.conv(index.cast("string"), 10, 4), k, "0"), "0123", letters)


def all_kmers(spark: SparkSession, k: int, letters: str = "ACGT") -> DataFrame:
    """(kmer): all 4^k in alphabetical order."""
    return spark.range(4**k).select(index_kmer(F.col("id"), k, letters).alias("kmer"))


def gc_share(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GCgc]+", "")) / F.nullif(F.length(seq), F.lit(0))


def base_entropy(seq: Column) -> Column:
    """Shannon entropy in bits of the four bases' shares among all A, C, G, T, U."""
    upper = F.translate(F.upper(seq), "U", "T")
    counts = [(F.length(upper) - F.length(F.replace(upper, F.lit(b), F.lit("")))).cast("double") for b in "ACGT"]
    total = counts[0] + counts[1] + counts[2] + counts[3]
    parts = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return parts[0] + parts[1] + parts[2] + parts[3]


def hull(kmer: Column, letters: str = "ACGU") -> Column:
    """The k-mer and all that differ from it in one base, distinct."""
    near = F.flatten(F.transform(F.sequence(F.lit(1), F.length(kmer)), lambda i: F.transform(F.array(*map(F.lit, letters)), lambda b: F.concat(F.substr(kmer, F.lit(1), i - 1), b, F.substr(kmer, i + 1, F.lit(2**31 - 1))))))
    return F.array_distinct(F.concat(F.array(kmer), near))


def expanded(kmer: Column, letters: str = "ACGU") -> Column:
    """The k-mer with each base before and each base after it."""
    bases = F.array(*map(F.lit, letters))
    return F.concat(F.transform(bases, lambda b: F.concat(b, kmer)), F.transform(bases, lambda b: F.concat(kmer, b)))


def shifted(index: Column, k: int, share: Column) -> Column:
    """Neighbours of a k-mer shifted by x bases either way, as (index, weight) with weight (k - 2x) / k * share while positive."""
    rows = []
    for x in range(1, (k + 1) // 2):
        weight = share * ((k - 2 * x) / k)
        rows += [F.struct((F.shiftleft(index, 2 * x).bitwiseAND(4**k - 1) + F.lit(r)).alias("index"), weight.alias("weight")) for r in range(4**x)]
        rows += [F.struct((F.shiftright(index, 2 * x) + F.lit(r * 4 ** (k - x))).alias("index"), weight.alias("weight")) for r in range(4**x)]
    return F.array(*rows)


def natural_key(chrom: Column) -> list[Column]:
    """Sort keys that put chr2 before chr10."""
    return [F.regexp_extract(chrom, "[0-9]+", 0).try_cast("int").asc_nulls_last(), chrom]


def na(value: Column) -> Column:
    """The value as text, null as NA: only for files."""
    return F.coalesce(value.cast("string"), F.lit("NA"))
