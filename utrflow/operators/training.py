"""Training tables of the two models of variant effect, their selection, and coefficients that are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.operators.annotate import CONSERVED, NEAR_PAS, nearest_end
from utrflow.operators.regression import fit_logistic

#: The terms of both models, the columns that must not be null, and the probabilities that select rows.
TERMS = ["in_eclip", "near_pas", "in_mir", "conserved", "shared_region", "number_isos"]
NEEDED = ["in_eclip", "pas", "in_mir", "phastcons_100", "shared_region", "number_isos"]
SURE, UNSURE, CAUSAL = 0.95, 0.001, 0.5


def utr_lengths(isoforms: DataFrame) -> DataFrame:
    """(gene, number_isos, utr_length, utr_start), distinct."""
    return isoforms.select("gene", "number_isos", (F.col("utr_stop") - F.col("utr_start")).alias("utr_length"), "utr_start").distinct()


def _flags(in_mir: Column) -> dict[str, Column]:
    """Flags and label; null where what they are made from is null."""
    share = F.col("iso_loc") / F.col("number_isos")
    return {
        "in_eclip": (F.col("eclip_tot") != "").cast("int"),
        "near_pas": (F.col("pas") <= NEAR_PAS).cast("int"),
        "in_mir": in_mir,
        "conserved": (F.col("phastcons_100") > CONSERVED).cast("int"),
        "shared_region": ((F.col("number_isos") == 1) | (share <= 0.5)).cast("int"),
        "label": (F.col("pip") >= CAUSAL).cast("int"),
    }


def eqtl_features(variants: DataFrame, isoforms: DataFrame, places: DataFrame, conserved_sites: DataFrame) -> DataFrame:
    """``variants`` (gene, var_info, base_id, ref, alt, start, end, phastcons_100, pip, eclip_tot) with features and label.

    UTR lengths come by gene, the isoforms a variant lies in from ``places`` (variant, iso_loc, iso_start, iso_stop) by
    var_info_ref_alt; both may give several rows, and variants without any stay. ``conserved_sites`` has the var_id of
    variants in conserved miRNA sites.
    """
    key = F.concat_ws("_", "var_info", "ref", "alt")
    rows = variants.join(utr_lengths(isoforms), "gene", "left").withColumn("variant", key)
    rows = rows.join(places.select("variant", F.col("iso_loc").cast("double").alias("iso_loc"), "iso_start", "iso_stop").distinct(), "variant", "left")
    rows = rows.withColumns({"dvp": F.col("iso_loc") / F.col("number_isos"), "pas": nearest_end(F.col("end"), F.col("iso_start"), F.col("iso_stop")), "stop_distance": F.abs(F.col("start") - F.col("utr_start")), "var_id": F.concat_ws("_", "base_id", "ref", "alt")})
    rows = rows.withColumn("between", F.when(F.col("dvp") <= 1, F.col("iso_stop") - F.col("iso_start")))
    mir = conserved_sites.select("var_id").distinct().withColumn("__mir", F.lit(1))
    return rows.join(mir, "var_id", "left").withColumns(_flags(F.coalesce("__mir", F.lit(0)))).drop("__mir")


def gwas_features(rows: DataFrame) -> DataFrame:
    """Rows (utr_info, base_id, ref, alt, start, end, iso_start, iso_stop, site_info, phastcons_100, pip, eclip_tot) with features and label.

    The packed utr_info holds the number of isoforms, the place among them, and the UTR's ends in its fields 4, 5, 7 and 8;
    site_info the family's conservation in its seventh. A place beyond the last isoform has no share (dvp).
    """
    part = lambda name, i: F.get(F.split(name, "_"), F.lit(i - 1))
    number = lambda i: part("utr_info", i).try_cast("double")
    out = rows.withColumns({"number_isos": number(4), "iso_loc": number(5), "utr_start": number(7), "utr_stop": number(8)})
    share = F.col("iso_loc") / F.col("number_isos")
    out = out.withColumns({"dvp": F.when(share <= 1, share), "utr_length": F.col("utr_stop") - F.col("utr_start"), "pas": nearest_end(F.col("end"), F.col("iso_start"), F.col("iso_stop")), "stop_distance": F.abs(F.col("start") - F.col("utr_start")), "var_id": F.concat_ws("_", "base_id", "ref", "alt")})
    out = out.withColumn("between", F.when(F.col("dvp").isNotNull(), F.col("iso_stop") - F.col("iso_start")))
    flags = _flags(F.coalesce(part("site_info", 7).isin("consFam", "broadConsFam").cast("int"), F.lit(0)))
    return out.withColumns(flags | {"shared_region": ((F.col("number_isos") == 1) | (F.col("dvp") <= 0.5)).cast("int")})


def selected(features: DataFrame) -> DataFrame:
    """The rows with a very high or very low probability that miss no needed column."""
    return features.filter((F.col("pip") > SURE) | (F.col("pip") < UNSURE)).dropna(subset=NEEDED)


def trained(rows: DataFrame, path: str | None = None) -> dict[str, float]:
    """Coefficients of the logistic model; written as a table (term, coefficient) at ``path``, if given."""
    found = fit_logistic(rows, "label", TERMS)
    if path is not None:
        rows.sparkSession.createDataFrame(list(found.items()), "term string, coefficient double").coalesce(1).write.mode("overwrite").parquet(path)
    return found


def kept_model(spark: SparkSession, path: str) -> dict[str, float]:
    """The coefficients that ``trained`` wrote (a row for each term)."""
    return {r["term"]: r["coefficient"] for r in spark.read.parquet(path).collect()}
