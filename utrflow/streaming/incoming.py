"""Annotation of variants as they arrive: static tables, a stream of variants, each micro-batch annotated by the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from utrflow.operators.annotate import Annotations, annotate, single_nucleotide
from utrflow.sources.files import VCF


def variant_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """New variant files of a folder, in the form of ``read_vcf``."""
    raw = spark.readStream.schema(VCF).option("sep", "\t").option("comment", "#").option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return raw.withColumns({"start": F.col("pos") - 1, "end": F.col("pos")})


def annotate_stream(variants: DataFrame, tables: Annotations, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs ``sink(annotated, batch number)`` for each micro-batch; a repeated number must overwrite."""
    def each(batch: DataFrame, number: int) -> None:
        sink(annotate(single_nucleotide(batch), tables), number)

    writer = variants.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def enrichment_stream(reads: DataFrame, k: int, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Windowed k-mer counts (window, kmer, n) of a stream of (ts, seq), with a watermark."""
    from utrflow.functions.sequence import kmers

    cells = reads.withWatermark("ts", late).select("ts", F.explode(kmers(F.col("seq"), k)).alias("kmer"))
    return cells.groupBy(F.window("ts", window), "kmer").agg(F.count(F.lit(1)).alias("n"))
