"""Annotation of single-nucleotide variants in 3' untranslated regions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utrflow.functions.sequence import middle, na, on_strand, substituted, with_chr
from utrflow.operators.intervals import collapsed, fetch, overlap_join, with_fallback
from utrflow.operators.psam import score_many
from utrflow.operators.regression import flagged, predicted
from utrflow.plans.storage import written

#: Fixed values of the query: the window's flank, thresholds of motif calls, of features and of predictions.
FLANK, STRONG, LOST, KEPT = 43, 0.33, 0.33, 0.67
NEAR_PAS, CONSERVED, CUT_EQTL, CUT_GWAS = 50, 0.5, 0.1, 0.0075
COLUMNS = ["var_id", "cadd_var_info", "phastcons_100", "motif_RBPs", "motif_cat", "eclip_tot", "eqtl_info", "pred_eqtl", "gwas_info", "pred_gwas", "APA_info", "PAS_info", "miR_info", "clinvar_info", "Rep_info"]
CELLS = ["K562", "HepG2"]
GENOMES = ("hg19", "hg38")


@dataclass
class Annotations:
    """The tables that variants are annotated with; those left None give null columns."""

    utr: DataFrame
    utr_fallback: DataFrame | None = None
    eclip: DataFrame | None = None  # chrom, r_start, r_end, rbp, cell
    eqtl: DataFrame | None = None  # chrom, r_start, r_end, info
    gwas: DataFrame | None = None
    clinvar: DataFrame | None = None
    mir_sites: DataFrame | None = None  # chrom, r_start, r_end, mergekey
    mir_predictions: DataFrame | None = None
    cadd: DataFrame | None = None  # chrom, start, end, ref, alt, cadd_var_info
    conservation: DataFrame | None = None  # chrom, end, phastcons_100
    rep_sites: DataFrame | None = None  # chrom, end, rep_info
    genome: DataFrame | None = None  # chrom, chunk, seq
    genome_chunk: int = 1 << 16
    motifs: DataFrame | None = None  # rbp, motif, a0, pos, base, weight
    models: dict[str, dict[str, float]] = field(default_factory=dict)  # eqtl, gwas: coefficients


def single_nucleotide(variants: DataFrame, genome: str = "hg38") -> DataFrame:
    """Variants with one base either side, chr prefixes, and var_key; others are left out (count them by comparing)."""
    if genome not in GENOMES:
        raise ValueError(f"genome must be one of {GENOMES}")
    kept = variants.filter((F.length("ref") == 1) & (F.length("alt") == 1)).withColumn("chrom", with_chr(F.col("chrom")))
    return kept.select("chrom", "start", "end", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), F.col("id").alias("info")).withColumn("variant_id", variant_id())


def variant_id() -> Column:
    return F.concat_ws("_", "chrom", "end", "ref", "alt")


def isoform_region(location: Column, isoforms: Column) -> Column:
    """Where a variant lies among a gene's isoforms; null if the place is beyond their number."""
    share = location / isoforms
    return F.when(isoforms == 1, "single").when((isoforms > 1) & (share <= 0.5), "common").when((share > 0.5) & (share < 1), "partially_shared").when(share == 1, "unique")


def nearest_end(end: Column, start: Column, stop: Column) -> Column:
    """The distance to the nearer isoform end; null if either is."""
    return F.when(start.isNotNull() & stop.isNotNull(), F.least(F.abs(end - start), F.abs(end - stop)))


def call(ref: Column, alt: Column) -> Column:
    """lost or preserved, for sites that the reference allele binds strongly; null between and for weak ones."""
    return F.when(ref > STRONG, F.when(alt / ref < LOST, "lost").when(alt / ref > KEPT, "preserved"))


def windows(variants: DataFrame, genome: DataFrame, size: int) -> DataFrame:
    """Variants with the 87 bases round them as their strand reads it; windows with N or cut at a chromosome's end are left
    out. ``ref_match`` tells whether the centre is the reference base."""
    got = fetch(variants, genome, size, F.col("start") - FLANK, F.col("end") + FLANK)
    seq = on_strand(F.upper("seq"), F.col("strand"))
    out = got.withColumn("seq", seq).filter((F.length("seq") == 2 * FLANK + 1) & ~F.col("seq").contains("N"))
    return out.withColumn("ref_match", F.substring("seq", FLANK + 1, 1) == on_strand(F.col("ref"), F.col("strand")))


def motif_calls(variants: DataFrame, genome: DataFrame, size: int, motifs: DataFrame, reduce: str = "sum") -> DataFrame:
    """(variant_id, motif_RBPs, motif_cat): proteins whose sites the alternate allele loses or keeps, in parallel order.

    Windows of 2k - 1 bases (each k-mer holds the variant) are scored once per distinct sequence.
    """
    seen = windows(variants.select("variant_id", "chrom", "start", "end", "ref", "alt", "strand").distinct(), genome, size)
    widths = [r[0] for r in motifs.groupBy("rbp").agg((F.max("pos") + 1).alias("k")).select("k").distinct().collect()]
    calls = None
    for k in sorted(widths):
        own = motifs.join(motifs.groupBy("rbp").agg(F.max("pos").alias("__last")).filter(F.col("__last") == k - 1).select("rbp"), "rbp", "left_semi")
        both = seen.withColumn("seq_ref", middle(F.col("seq"), FLANK + 1, k)).withColumn("seq_alt", substituted(F.col("seq_ref"), on_strand(F.col("alt"), F.col("strand")), k))
        distinct = both.select(F.col("seq_ref").alias("seq")).union(both.select(F.col("seq_alt").alias("seq"))).distinct()
        scores = score_many(distinct, own, reduce=reduce)
        r = scores.select(F.col("seq").alias("seq_ref"), "rbp", F.col("score").alias("ref_score"))
        a = scores.select(F.col("seq").alias("seq_alt"), "rbp", F.col("score").alias("alt_score"))
        part = both.join(r, "seq_ref").join(a, ["seq_alt", "rbp"]).select("variant_id", "rbp", call(F.col("ref_score"), F.col("alt_score")).alias("cat")).filter("cat is not null").distinct()
        calls = part if calls is None else calls.union(part)
    if calls is None:  # no motifs
        return variants.select("variant_id", F.lit(None).cast("string").alias("motif_RBPs"), F.lit(None).cast("string").alias("motif_cat")).limit(0)
    got = F.array_sort(F.collect_list(F.struct("rbp", "cat")))
    return calls.groupBy("variant_id").agg(got.alias("g")).select("variant_id", F.array_join(F.transform("g", lambda x: x["rbp"]), "_").alias("motif_RBPs"), F.array_join(F.transform("g", lambda x: x["cat"]), "__").alias("motif_cat"))


#: What a place is: all that overlaps with it is found and collapsed once, however many variants and isoforms stand there.
PLACE = ["chrom", "start", "end"]


def _overlaps(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """``overlap_join``; where no interval is long, ``left`` isn't spread and shuffled a second time for such ones."""
    long = right.filter((F.col("r_end") - F.col("r_start")) > width * 64)
    return overlap_join(left, right, width=width, coarse=64 if not long.isEmpty() else None)


def _marks(tables: Annotations) -> DataFrame | None:
    """(chrom, r_start, r_end, kind, rank, what, texts): the intervals of all tables, with what is told of them.

    ``texts`` are a miR site's, one for each of its predictions.
    """
    told = []
    if tables.eclip is not None:
        rank = F.when(F.col("cell") == CELLS[0], 0).otherwise(1)
        told.append(("eclip", tables.eclip, rank, F.concat_ws("_", "rbp", "cell"), None))
    told += [(kind, t, F.lit(0), F.col("info"), None) for kind, t in (("eqtl", tables.eqtl), ("gwas", tables.gwas), ("clinvar", tables.clinvar)) if t is not None]
    if tables.mir_sites is not None:
        sites, lone = tables.mir_sites, F.array(F.concat_ws("__", "mergekey", F.lit("nonCons_family")))
        if tables.mir_predictions is not None:
            text = F.coalesce(F.concat_ws("__", "mergekey", "family", "seed_match", "pct", "strand", "context", "family_conserved", "site_conserved"), F.col("mergekey"))
            what = F.when(F.col("family").isNull(), F.concat_ws("__", "mergekey", F.lit("nonCons_family"))).otherwise(text)
            sites = sites.join(tables.mir_predictions.groupBy("mergekey").agg(F.array_sort(F.collect_list(what)).alias("__texts")), "mergekey", "left")
            lone = F.coalesce("__texts", lone)
        told.append(("mir", sites, F.lit(0), F.col("mergekey"), lone))
    out = None
    for kind, table, rank, what, texts in told:
        part = table.select("chrom", "r_start", "r_end", F.lit(kind).alias("kind"), rank.alias("rank"), what.cast("string").alias("what"), (F.lit(None).cast("array<string>") if texts is None else texts).alias("texts"))
        out = part if out is None else out.unionByName(part)
    return out


def _told(variants: DataFrame, marks: DataFrame, width: int) -> DataFrame:
    """(place, eclip_tot, eqtl, gwas_info, miR_info, clinvar_info) of the places that meet any interval; eqtl has all distinct
    values."""
    hits = _overlaps(variants.select(*PLACE).distinct(), marks, width)
    of = lambda kind: F.col("kind") == kind

    def text(kind: str, separator: str) -> Column:
        cells = F.collect_list(F.when(of(kind) & F.col("what").isNotNull(), F.struct("rank", "r_start", "r_end", "what")))
        return F.when(F.size(cells) > 0, F.array_join(F.transform(F.array_sort(cells), lambda x: x["what"]), separator))

    mir = F.flatten(F.transform(F.collect_set(F.when(of("mir"), F.struct("what", "texts"))), lambda x: x["texts"]))
    return hits.groupBy(*PLACE).agg(
        text("eclip", "__").alias("eclip_tot"),
        F.transform(F.collect_set(F.when(of("eqtl"), F.struct("what"))), lambda x: x["what"]).alias("eqtl"),
        text("gwas", "|").alias("gwas_info"),
        F.when(F.size(mir) > 0, F.array_join(F.array_sort(mir), "|")).alias("miR_info"),
        text("clinvar", "|").alias("clinvar_info"),
    )


def annotate(variants: DataFrame, tables: Annotations, collapse_fan_out: bool = False, width: int = 512) -> DataFrame:
    """The 15 columns for each variant and overlapping isoform (see COLUMNS), from ``single_nucleotide`` variants.

    Nulls stay null (``for_file`` writes NA). eQTL and ReP hits make a row each unless ``collapse_fan_out``.
    """
    utr = tables.utr.withColumns({"r_start": F.col("iso_start"), "r_end": F.col("iso_stop")})
    if tables.utr_fallback is not None:
        found = with_fallback(variants, utr, tables.utr_fallback.withColumns({"r_start": F.col("iso_start"), "r_end": F.col("iso_stop")}), "variant_id", width=width)
    else:
        found = _overlaps(variants, utr, width)
    rows = found.drop("r_start", "r_end", "score", "info", "variant_id")  # the id is put together at the end: it isn't shuffled
    with_motifs = tables.genome is not None and tables.motifs is not None
    if with_motifs:  # which look at the rows again
        rows = written(rows.withColumn("variant_id", variant_id()), "annotated")
    none = F.lit(None).cast("string")
    marks = _marks(tables)
    if marks is None:
        out = rows.withColumns({n: none for n in ("eclip_tot", "eqtl_info", "gwas_info", "miR_info", "clinvar_info")})
    else:
        out = rows.join(_told(variants, marks, width), PLACE, "left")
        if collapse_fan_out:
            own = F.array_sort(F.filter("eqtl", lambda x: x.isNotNull()))
            out = out.withColumn("eqtl_info", F.when(F.size(own) > 0, F.array_join(own, "|"))).drop("eqtl")
        else:
            out = out.withColumn("eqtl_info", F.explode_outer("eqtl")).drop("eqtl")
    out = out.withColumn("eclip_tot", F.coalesce("eclip_tot", F.lit("")))
    for table, on, names in ((tables.cadd, ["chrom", "start", "end", "ref", "alt"], ["cadd_var_info"]), (tables.conservation, ["chrom", "end"], ["phastcons_100"]), (tables.rep_sites, ["chrom", "end"], ["rep_info"])):
        if table is None:
            out = out.withColumns({n: F.lit(None).cast("double" if n == "phastcons_100" else "string") for n in names})
        elif names == ["rep_info"] and collapse_fan_out:
            out = out.join(collapsed(table, on, "rep_info", "rep_info", "|", distinct=True), on, "left")
        else:
            out = out.join(table.select(*on, *names), on, "left")
    if with_motifs:
        out = out.join(motif_calls(rows, tables.genome, tables.genome_chunk, tables.motifs), "variant_id", "left")
    else:
        out = out.withColumns({"motif_RBPs": none, "motif_cat": none})
    region = isoform_region(F.col("iso_loc"), F.col("number_isos"))
    out = out.withColumns({"region": region, "pas": nearest_end(F.col("end"), F.col("iso_start"), F.col("iso_stop"))})
    out = features(out)
    for name, model, cut in (("pred_eqtl", "eqtl", CUT_EQTL), ("pred_gwas", "gwas", CUT_GWAS)):
        out = out.withColumn(name, flagged(predicted(tables.models[model]), cut) if model in tables.models else F.lit(None).cast("int"))
    apa = F.concat_ws("_", na(F.col("gene")), na(F.col("strand")), na(F.col("iso_loc")), na(F.col("number_isos")), na(F.col("region")))
    pas = F.when(F.col("pas") <= NEAR_PAS, "PAS_proximal").otherwise("")
    return out.select(variant_id().alias("var_id"), "cadd_var_info", "phastcons_100", "motif_RBPs", "motif_cat", "eclip_tot", "eqtl_info", "pred_eqtl", "gwas_info", "pred_gwas", apa.alias("APA_info"), pas.alias("PAS_info"), "miR_info", "clinvar_info", F.col("rep_info").alias("Rep_info"))


def features(df: DataFrame) -> DataFrame:
    """The 0/1 features of both models; null where what they are made from is null (but not for empty eCLIP or miR texts)."""
    return df.withColumns({
        "in_eclip": (F.col("eclip_tot") != "").cast("int"),
        "near_pas": (F.col("pas") <= NEAR_PAS).cast("int"),
        "in_mir": F.coalesce(F.col("miR_info").rlike("consFam|broadConsFam"), F.lit(False)).cast("int"),
        "conserved": (F.col("phastcons_100") > CONSERVED).cast("int"),
        "shared_region": F.col("region").isin("common", "single").cast("int"),
    })


def one_line_each(annotated: DataFrame) -> DataFrame:
    """One row per variant: the distinct values of each column, joined by bars (the single-variant form)."""
    rest = [c for c in annotated.columns if c != "var_id"]
    # rows are dealt out as they are: sets of a row or two, made before, would take more room
    return annotated.repartition("var_id").groupBy("var_id").agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(c) for c in rest])


def for_file(annotated: DataFrame) -> DataFrame:
    return annotated.select(*[na(F.col(c)).alias(c) for c in COLUMNS])


def alleles(df: DataFrame, column: str = "alts", most: int = 4) -> DataFrame:
    """A row for each allele of a comma list; more than ``most`` raise an error when they are met."""
    size = F.size(F.split(column, ","))
    checked = F.when(size > most, F.raise_error(F.concat(F.lit("too many alleles: "), F.col(column))).cast("string")).otherwise(F.col(column))
    return df.withColumn("allele", F.explode(F.split(checked, ",")))
