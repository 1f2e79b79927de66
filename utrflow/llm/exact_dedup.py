"""Exact deduplication: two-pass Bloom filtering finds possibly repeated hashes; only those rows shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utrflow.llm.bloom import may_repeat, repeated_filter
from utrflow.plans.storage import join_sized, written

SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null as empty. (Single spaces match nothing: they stay.)"""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _order(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))


def _groups(rows: DataFrame, total: int) -> tuple[DataFrame, Column]:
    """The groups of at least two of ``rows`` (__id, __row, text_sha256), and the Bloom test of text_sha256."""
    hashed = rows.withColumn("__h", F.xxhash64("text_sha256"))
    bits = repeated_filter(hashed, "__h", total)
    test = may_repeat(rows.sparkSession, bits, total, "__h")
    found = hashed.filter(test).groupBy("text_sha256").agg(F.min(_order("__id")).alias("__first"), F.count(F.lit(1)).alias("group_size"))
    found = found.filter("group_size > 1").select("text_sha256", F.col("__first.id").alias("keep_id"), F.col("__first.row").alias("__keep_row"), "group_size")
    return written(found, "repeated"), test


def dedup_index(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``df``: its id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, so they equal empty ones. Of rows that share a text and the smallest id, one stays (which,
    is fixed when the hashes are written). Null ids come after all others; if all are null, keep_id is null and one stays.
    Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    rows = written(df.select(F.col(id_col).alias("__id"), text_sha256(F.col(text)).alias("text_sha256")).withColumn("__row", F.monotonically_increasing_id()), "hashes")
    total = rows.count()
    groups, test = _groups(rows, total)
    tested = rows.withColumn("__h", F.xxhash64("text_sha256")).withColumn("__may", test).drop("__h")
    single = tested.filter(~F.col("__may")).select(F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    joined = join_sized(tested.filter("__may").drop("__may"), groups, "text_sha256", "group_size", total)
    many = joined.select(F.col("__id").alias(id_col), F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("__row") == F.col("__keep_row"), F.lit(True)).alias("kept"), "text_sha256")
    return single.unionByName(many)


def marked(hashed: DataFrame, key: str, id_col: str) -> DataFrame:
    """``hashed`` with keep_id, group_size and kept: of rows with equal ``key`` that with the smallest id is kept.

    Keys are counted first; then ``hashed`` is read again, rows whose key surely occurs once pass straight through, and only
    the others are shuffled, with all their columns. A null key equals nothing. Null ids come last. Where several rows share
    a key and the smallest id, one is kept: rows are ranked within their input partition, then the first of each partition.
    """
    rows = written(hashed.select(F.col(id_col).alias("__id"), F.col(key).alias("text_sha256")).withColumn("__row", F.lit(0).cast("long")), "hashes")
    total = rows.count()
    groups, test = _groups(rows.filter("text_sha256 is not null"), total)
    groups = groups.drop("__keep_row").withColumnRenamed("text_sha256", "__key")
    tested = hashed.withColumn("__key", F.col(key)).withColumn("__id", F.col(id_col)).withColumn("text_sha256", F.col("__key"))
    tested = tested.withColumn("__h", F.when(F.col("__key").isNotNull(), F.xxhash64("__key"))).withColumn("__may", test)
    own = [F.col(f"`{c}`") for c in hashed.columns]
    single = tested.filter(~F.col("__may")).select(*own, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    many = join_sized(tested.filter("__may"), groups, "__key", "group_size", total)
    first = F.col("group_size").isNull() | F.col("__id").eqNullSafe(F.col("keep_id"))
    hits = rows.join(groups.select(F.col("__key").alias("text_sha256"), F.col("keep_id").alias("__keep")), "text_sha256").filter(F.col("__id").eqNullSafe(F.col("__keep"))).groupBy("text_sha256").count()
    if hits.filter("count > 1").isEmpty():
        many = many.withColumn("kept", first)
    else:
        rest = many.filter(~first).withColumn("kept", F.lit(False))
        ranked = many.filter(first).withColumn("__part", F.spark_partition_id())
        ranked = ranked.withColumn("__n", F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__id")))
        again = ranked.filter("__n > 1").withColumn("kept", F.lit(False)).drop("__n", "__part")
        lead = ranked.filter("__n = 1").withColumn("kept", F.row_number().over(Window.partitionBy("__key").orderBy("__part")) == 1)
        many = rest.unionByName(again).unionByName(lead.drop("__n", "__part"))
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return single.unionByName(many.select(*own, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "kept"))


def exact_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with one row of each group of equal texts: that with the smallest id (see ``marked``), all columns as they were."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__doc")
    hashed = df.select(own).withColumn("__number", F.col(f"__doc.`{id_col}`")).withColumn("__text", text_sha256(F.col(f"__doc.`{text}`")))
    return marked(hashed, "__text", "__number").filter("kept").select("__doc.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id = g.keep_id AS kept, h.text_sha256
FROM h JOIN g USING (text_sha256)
"""
