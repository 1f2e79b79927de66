"""Sources and sinks: variants, intervals, sequences, motifs, reads, tables. Every source has a fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utrflow.functions.sequence import pieces

S, L, D = T.StringType(), T.LongType(), T.DoubleType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


VCF = _schema(chrom=S, pos=L, id=S, ref=S, alt=S, qual=S, filter=S, info=S)
BED = _schema(chrom=S, start=L, end=L, name=S, score=S, strand=S)
#: UTR isoforms (10 columns), and windows with an annotation text.
UTR = _schema(chrom=S, iso_start=L, iso_stop=L, gene=S, score=S, strand=S, number_isos=L, iso_loc=L, utr_start=L, utr_stop=L)
WINDOWS = _schema(chrom=S, r_start=L, r_end=L, info=S)
MIR_PREDICTIONS = _schema(mergekey=S, family=S, seed_match=S, pct=S, strand=S, context=S, family_conserved=S, site_conserved=S)
CONSERVATION = _schema(base_id=S, phastcons_100=D)
REP_SITES = _schema(base_id=S, rbp_peak=S)
CHAIN = _schema(chrom=S, r_start=L, r_end=L, to_chrom=S, to_start=L, to_size=L, to_strand=S)


def read_table(spark: SparkSession, path: str, schema: T.StructType, header: bool = False, sep: str = "\t") -> DataFrame:
    """A headed or header-less text table, plain or gzipped; a malformed row fails the read. An empty file has no rows."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("comment", "#" if not header else "\x00").option("mode", "FAILFAST").option("enforceSchema", True).csv(path)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants with 0-based ``start`` and ``end`` = pos; lines that start with # are skipped, columns after the eighth dropped."""
    text = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split("value", "\t")
    columns = [F.expr(f"try_cast(cells[{i}] AS {f.dataType.simpleString()})").alias(f.name) for i, f in enumerate(VCF.fields)]
    return text.select(cells.alias("cells")).select(*columns).withColumns({"start": F.col("pos") - 1, "end": F.col("pos")})


def one_variant(spark: SparkSession, chrom: str, pos: int, ref: str, alt: str, info: str = "") -> DataFrame:
    """A single variant in the form of ``read_vcf``."""
    return spark.createDataFrame([(chrom, pos, info, ref, alt, None, None, info)], VCF).withColumns({"start": F.col("pos") - 1, "end": F.col("pos")})


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, BED)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of each record; comment lines that start with ; are dropped. The file is split at > signs."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~x.startswith(";"))
    return records.select(F.regexp_extract(lines[0], r"^\S*", 0).alias("name"), F.regexp_replace(F.array_join(body, ""), r"\s", "").alias("seq"))


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """The aligned blocks of a chain file as CHAIN, for ``intervals.lifted``; comment lines are skipped.

    A chain's head says both sequences' names, sizes, strands and starts; its lines hold a block's size and the gaps after it
    in either sequence. ``to_start`` counts on the strand that ``to_strand`` names.
    """
    chains = spark.read.option("lineSep", "chain ").text(path).withColumn("lines", F.split("value", r"\r?\n"))
    heads = chains.withColumn("head", F.split(F.trim(F.col("lines")[0]), r"\s+")).filter((F.size("head") >= 11) & F.col("head")[0].rlike("^[0-9.]+$")).withColumn("chain", F.monotonically_increasing_id())
    rows = heads.select("chain", "head", F.posexplode("lines").alias("n", "line")).filter(F.col("line").rlike(r"^\s*[0-9]+(\s|$)") & (F.col("n") > 0))
    cell = lambda i: F.coalesce(F.get(F.split(F.trim("line"), r"\s+"), F.lit(i)).try_cast("long"), F.lit(0))
    w = Window.partitionBy("chain").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda gap: F.coalesce(F.sum(cell(0) + cell(gap)).over(w), F.lit(0))
    head = lambda i: F.col("head")[i]
    blocks = rows.select(head(1).alias("chrom"), (head(4).cast("long") + past(1)).alias("r_start"), cell(0).alias("size"), head(6).alias("to_chrom"), (head(9).cast("long") + past(2)).alias("to_start"), head(7).cast("long").alias("to_size"), head(8).alias("to_strand"))
    return blocks.withColumn("r_end", F.col("r_start") + F.col("size")).select(*[f.name for f in CHAIN.fields])


def genome_chunks(records: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(chrom, chunk, seq): a genome in chunks of ``size`` bases, for ``intervals.fetch``."""
    cut = F.posexplode(pieces(F.col("seq"), size)).alias("chunk", "seq")  # one walk along the text
    return records.filter(F.length("seq") > 0).select(F.col("name").alias("chrom"), cut).filter("seq != ''").withColumn("chunk", F.col("chunk").cast("long"))


def read_reads(spark: SparkSession, path: str, skip: int = 0, most: int | None = None) -> DataFrame:
    """(rbp, conc, read_id, seq): reads of one length, one a line; the file's name is <rbp>_<concentration or input>.<ext>.

    ``input`` is 0. Of each file the first ``skip`` lines are left out and at most ``most`` reads after them taken; reads with
    other letters than A, C, G, T, U are dropped, as are those whose length isn't that of the file's longest read.
    """
    text = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("seq"), F.monotonically_increasing_id().alias("line")).withColumn("part", F.shiftright("line", 33))
    if skip or most is not None:
        # a file's lines are numbered from the lines of its parts before: a row for each part, no shuffle of reads
        parts = text.groupBy("file", "part").agg(F.min("line").alias("from"), F.count(F.lit(1)).alias("lines"))
        before = F.sum("lines").over(Window.partitionBy("file").orderBy("from")) - F.col("lines")
        numbered = text.join(F.broadcast(parts.select("file", "part", "from", before.alias("before"))), ["file", "part"])
        number = F.col("before") + F.col("line") - F.col("from")
        text = numbered.filter((number >= skip) & (number < skip + most if most is not None else F.lit(True)))
    name = F.regexp_extract("file", r"([^/]+?)_([^/_]+?)\.[^/.]+$", 1)
    what = F.regexp_extract("file", r"([^/]+?)_([^/_]+?)\.[^/.]+$", 2)
    reads = text.filter(F.col("seq").rlike("^[ACGTUacgtu]+$"))
    width = reads.groupBy("file").agg(F.max(F.length("seq")).alias("w"))
    reads = reads.join(F.broadcast(width), "file").filter(F.length("seq") == F.col("w"))  # a row for each file
    return reads.select(name.alias("rbp"), F.when(what == "input", 0.0).otherwise(what.try_cast("double")).alias("conc"), F.col("line").alias("read_id"), "seq")


def largest_set(reads: DataFrame) -> DataFrame:
    """The reads of the protein with the most concentrations (the first by name, of equals)."""
    best = reads.groupBy("rbp").agg(F.countDistinct("conc").alias("n")).orderBy(F.desc("n"), "rbp").limit(1).select("rbp")
    return reads.join(F.broadcast(best), "rbp")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """(rbp, motif, a0, n, acc_k, acc_shift, acc_scale, pos, base, weight) of motif files.

    A motif starts with a line PSAM and attributes name=value; rows of four weights (A C G U) follow. Weights that aren't
    positive become 1e-6. ``motif`` numbers a file's motifs by descending A0, from 0.
    """
    files = spark.read.text(path, wholetext=True).withColumn("rbp", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/.]*)?$", 1))
    parts = files.select("rbp", F.posexplode(F.split("value", r"(?m)^PSAM\b")).alias("order", "text")).filter("order > 0")
    number = lambda key: F.regexp_extract("text", rf"\b{key}=(\S+)", 1).try_cast("double")
    heads = parts.withColumns({"a0": F.coalesce(number("A0"), F.lit(1.0)), "acc_k": number("acc_k").cast("int"), "acc_shift": F.coalesce(number("acc_shift"), F.lit(0.0)).cast("int"), "acc_scale": F.coalesce(number("acc_scale"), F.lit(1.0))})
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(r"^\s*[-+.0-9][-+.0-9eE]*(\s+[-+.0-9][-+.0-9eE]*){3}"))
    rows = heads.withColumn("lines", lines).withColumn("n", F.size("lines")).withColumn("acc_k", F.coalesce("acc_k", "n")).select("rbp", "order", "a0", "n", "acc_k", "acc_shift", "acc_scale", F.posexplode("lines").alias("pos", "line"))
    cells = rows.withColumn("cells", F.slice(F.split(F.trim("line"), r"\s+"), 1, 4)).select("*", F.posexplode("cells").alias("column", "cell"))
    weight = F.col("cell").try_cast("double")
    motif = F.dense_rank().over(Window.partitionBy("rbp").orderBy(F.desc("a0"), "order")) - 1
    return cells.select("rbp", motif.alias("motif"), "a0", "n", "acc_k", "acc_shift", "acc_scale", "pos", F.element_at(F.array(*map(F.lit, "ACGU")), F.col("column") + 1).alias("base"), F.when(weight > 0, weight).otherwise(1e-6).alias("weight"))


def motif_text(motifs: list[tuple[float, list[list[float]]]], comment: str = "") -> str:
    """A motif file of (a0, weights): what ``read_motifs`` reads."""
    from utrflow.operators.psam import consensus

    out = [f"# {line}" for line in comment.splitlines()]
    for a0, weights in motifs:
        out.append(f"PSAM A0={a0:.5f} n={len(weights)}")
        out += ["\t".join(f"{w:.5f}" for w in row) + f"\t{c}" for row, c in zip(weights, consensus(weights), strict=True)]
    return "\n".join(out) + "\n"


def read_known_kds(spark: SparkSession, path: str) -> DataFrame:
    """(rbp, name, seq, kd, kd_err, affinity, affinity_err): lines ``# alias a b`` rename a to b; other letters are left out."""
    text = spark.read.text(path)
    alias = text.filter(F.col("value").rlike(r"^#\s*alias\s+")).select(F.split(F.trim("value"), r"\s+").alias("c")).select(F.element_at("c", -2).alias("rbp"), F.element_at("c", -1).alias("to"))
    cells = text.filter(~F.col("value").startswith("#")).select(F.split("value", r"[\t,]").alias("c")).filter(F.size("c") >= 5)
    rows = cells.select(F.trim(F.col("c")[0]).alias("rbp"), F.trim(F.col("c")[1]).alias("name"), F.upper(F.trim(F.col("c")[2])).alias("seq"), F.trim(F.col("c")[3]).try_cast("double").alias("kd"), F.trim(F.col("c")[4]).try_cast("double").alias("kd_err"))
    rows = rows.filter(F.col("seq").rlike("^[ACGTU]+$")).filter(F.col("kd") > 0).join(F.broadcast(alias), "rbp", "left").withColumn("rbp", F.coalesce("to", "rbp")).drop("to")
    return rows.withColumn("affinity", 1 / F.col("kd")).withColumn("affinity_err", F.pow("affinity", F.lit(2)) * F.col("kd_err"))


def write_tsv(df: DataFrame, path: str, compress: bool = False, header: bool = True) -> None:
    """Tab-separated text, null as NA. As many files as partitions: a single one is for small results (coalesce them)."""
    df.write.option("sep", "\t").option("header", header).option("quote", "\x00").option("nullValue", "NA").option("emptyValue", "").option("compression", "gzip" if compress else "none").csv(path)


def kmer_matrix(values: DataFrame, sample: str = "conc") -> DataFrame:
    """One row per k-mer with value and error of each sample, from (kmer, sample, value, error)."""
    return values.groupBy("kmer").pivot(sample).agg(F.first("value").alias("value"), F.first("error").alias("error"))


def melted(matrix: DataFrame, samples: list[str]) -> DataFrame:
    """The inverse of ``kmer_matrix``."""
    parts = ", ".join(f"'{s}', `{s}_value`, `{s}_error`" for s in samples)
    return matrix.selectExpr("kmer", f"stack({len(samples)}, {parts}) as (sample, value, error)")


def reads_as_fasta(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"))).write.text(path)

