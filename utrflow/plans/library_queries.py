"""Queries of comparisons, measures, motif tools, file formats and matrices over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.functions import measures as m
from utrflow.functions import sequence as s
from utrflow.operators import annotate, compare, enrichment, fitting, kmers, psam, states, structure
from utrflow.plans.model_queries import SECOND, _motif, _open, _open_sql
from utrflow.plans.queries import _PART_SQL, _R_SQL, MOTIF, READS, _base_sql, _freq_sql, _kmer_sql, _parts, _r, reads, table
from utrflow.plans.storage import new_path, written
from utrflow.sources import files

_RT = (8.314459848, 4184.0)


def q87_measures(spark: SparkSession, d: str) -> DataFrame:
    """Energies, shares, rounding by error and labels of the orders."""
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("kd"), (F.col("o_custkey") % 9).cast("double").alias("energy"), ((F.col("o_orderkey") % 997) / 9970.0).alias("p"))
    x = x.withColumn("domains", F.concat(F.when(F.col("o_orderkey") % 3 == 0, "RRM,RRM").when(F.col("o_orderkey") % 3 == 1, "KH, RRM").otherwise("KH")))
    kcal, digits = m.kd_to_kcal(F.col("kd")), m.error_digits(F.col("p"))
    return x.select(
        "o_orderkey", F.round(kcal, 8).alias("kcal"), F.round(m.kcal_to_kd(kcal), 3).alias("kd"), F.round(m.accessibility(F.col("energy"), 0.5), 9).alias("acc"), F.round(m.share_of_total(F.col("kd"), "o_orderstatus"), 12).alias("share"),
        digits.alias("digits"), F.round(m.rounded(F.col("energy") / 7, digits), 9).alias("rounded"), m.p_stars(F.col("p")).alias("stars"), m.domain_class(F.col("domains")).alias("domain"), compare.top_r_label(F.col("energy") * 3).alias("top"), m.equal_bin(F.col("energy"), 0.0, 8.0, 5).alias("level"),
    )


_RT4, _RT37 = (f"(({c} + 273.15) * {_RT[0]}::DOUBLE / {_RT[1]}::DOUBLE)" for c in ("4", "37"))
Q87 = (
    f"WITH x AS (SELECT o_orderkey, o_orderstatus, o_totalprice::DOUBLE AS kd, (o_custkey % 9)::DOUBLE AS e, o_orderkey % 997 / 9970.0::DOUBLE AS p FROM orders), y AS (SELECT *, ln(kd / 1e9) * {_RT4} AS kcal, CASE WHEN p > 0 THEN greatest(0, 1 - floor(log10(p))) ELSE 6 END::INT AS dg FROM x) "
    f"SELECT o_orderkey, round(kcal, 8) AS kcal, round(exp(kcal / {_RT4}) * 1e9, 3) AS kd, round(exp(-e * 0.5 / {_RT37}), 9) AS acc, round(kd / sum(kd) OVER (PARTITION BY o_orderstatus), 12) AS share, dg AS digits, round(round(e / 7 * pow(10, dg)) / pow(10, dg), 9) AS rounded, "
    "CASE WHEN p <= 0.0001 THEN '****' WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'n.s.' END AS stars, CASE o_orderkey % 3 WHEN 0 THEN 'RRM' WHEN 1 THEN 'mixed' ELSE 'KH' END AS domain, "
    "CASE WHEN e * 3 >= 20 THEN '20+' WHEN e * 3 >= 5 THEN '5-20' WHEN e * 3 >= 2 THEN '2-5' WHEN e * 3 >= 1 THEN '1-2' ELSE '<1' END AS top, least(greatest(floor(e / 1.6), 0), 4)::INT AS level FROM y"
)


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Lines as steps of descents: two runs over groups of orders."""
    x = table(spark, d, "lineitem")
    by = [F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd").alias("run"), (F.col("l_partkey") % 40).alias("rbp"), F.col("l_linenumber").alias("step")]
    number = lambda c: F.col(c).cast("double")
    return x.groupBy(*by).agg(F.avg(number("l_extendedprice")).alias("error"), (F.max(number("l_discount")) * 8).alias("correlation"), F.avg(number("l_quantity")).alias("kd"))


_LOG = "lg AS (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS run, l_partkey % 40 AS rbp, l_linenumber AS step, avg(l_extendedprice::DOUBLE) AS error, max(l_discount::DOUBLE) * 8 AS correlation, avg(l_quantity::DOUBLE) AS kd FROM lineitem GROUP BY ALL), ds AS (SELECT run, rbp, arg_min(error, step) AS first_error, arg_max(error, step) AS last_error, max(correlation) AS best, min(kd) FILTER (error <= 1.05 * least) AS lo, max(kd) FILTER (error <= 1.05 * least) AS hi FROM (SELECT *, min(error) OVER (PARTITION BY run, rbp) AS least FROM lg) GROUP BY ALL)"


def q88_compare_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs compared: flags by descent, the steps of least error, and the two runs' last errors against each other."""
    log = written(_log(spark, d), "log")
    found = written(compare.descents(log), "descents")
    flags = compare.quality_flags(found).select(F.lit("flags").alias("what"), F.concat_ws(" ", "run", "rbp").alias("key"), F.round("kd_low", 6).alias("a"), F.round("kd_high", 6).alias("b"), F.concat_ws(" ", F.col("kd_stable").cast("string"), F.col("good_fit").cast("string"), F.col("less_error").cast("string")).alias("c"))
    grid = log.select("rbp", "error", F.col("step").alias("acc_k"), (F.col("step") % 3).alias("shift"), F.col("correlation").alias("scale"))
    best = compare.best_footprint(grid).select(F.lit("footprint").alias("what"), F.col("rbp").cast("string").alias("key"), F.round("error", 6).alias("a"), F.round("scale", 6).alias("b"), F.concat_ws(" ", "acc_k", "shift").alias("c"))
    pair = compare.pairwise(found, "last_error", "even", "odd").select(F.lit("pair").alias("what"), F.lit("even odd").alias("key"), F.round("mean_log2", 8).alias("a"), F.col("n").cast("double").alias("b"), F.concat_ws(" ", "up", "down").alias("c"))
    spread = compare.most_variable(found, "last_error", n=5).select(F.lit("spread").alias("what"), F.col("rbp").cast("string").alias("key"), F.round("spread", 5).alias("a"), F.col("runs").cast("double").alias("b"), F.lit(None).cast("string").alias("c"))
    return flags.unionByName(best).unionByName(pair).unionByName(spread)


Q88 = (
    f"WITH {_LOG} SELECT 'flags' AS what, run || ' ' || rbp AS key, round(lo, 6) AS a, round(hi, 6) AS b, concat_ws(' ', hi / lo < 2, best >= 0.5, last_error < first_error) AS c FROM ds "
    "UNION ALL SELECT 'footprint', rbp::VARCHAR, round(b.error, 6), round(b.scale, 6), b.acc_k || ' ' || b.shift FROM (SELECT rbp, min({'error': error, 'acc_k': step, 'shift': step % 3, 'scale': correlation}) AS b FROM lg GROUP BY 1) "
    "UNION ALL SELECT 'pair', 'even odd', round(avg(log2(a.last_error / b.last_error)), 8), count(*)::DOUBLE, sum((a.last_error > b.last_error)::INT) || ' ' || sum((a.last_error < b.last_error)::INT) FROM ds a JOIN ds b ON a.rbp = b.rbp AND a.run = 'even' AND b.run = 'odd' "
    "UNION ALL SELECT * FROM (SELECT 'spread', rbp::VARCHAR, round(stddev_pop(last_error), 5), count(*)::DOUBLE, NULL FROM ds GROUP BY rbp ORDER BY stddev_pop(last_error) DESC, rbp LIMIT 5)"
)


def q89_oligos(spark: SparkSession, d: str) -> DataFrame:
    """Enrichment of oligos by counts, those that cross-talk left out, and a titration from three replicates."""
    x = table(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("oligo"), "l_returnflag", (F.col("l_suppkey") % 300).alias("subject"), F.col("l_quantity").cast("double").alias("score"))
    counts = lambda flag: x.filter(F.col("l_returnflag") == flag).groupBy("oligo").agg(F.count(F.lit(1)).alias("n"))
    talk = compare.crosstalk_oligos(x.filter("l_returnflag = 'A'").select(F.col("oligo").alias("query"), "subject", "score"), 45.0)
    out = compare.count_enrichment(counts("R"), counts("N"), talk, least=2).select(F.lit("oligo").alias("what"), F.col("oligo").alias("key"), F.round("enrichment", 9).alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    sensors = table(spark, d, "part").filter("p_size > 0").select((F.col("p_partkey") % 100).alias("conc"), *[c for i in (1, 2, 3) for c in ((F.col("p_retailprice").cast("double") * i).alias(f"sensor_{i}"), F.col("p_size").cast("double").alias(f"folded_{i}"), (F.col("p_size") * 100.5).cast("double").alias(f"unfolded_{i}"))])
    curve = compare.beacon(sensors, "conc").select(F.lit("curve").alias("what"), F.col("conc").alias("key"), F.round("mean", 7).alias("a"), F.round("low", 7).alias("b"), F.round("high", 7).alias("c"))
    return out.unionByName(curve)


Q89 = (
    "WITH x AS (SELECT l_partkey % 300 AS o, l_returnflag AS f, l_suppkey % 300 AS sb, l_quantity::DOUBLE AS q FROM lineitem), tk AS (SELECT DISTINCT o FROM (SELECT o, sb FROM x WHERE f = 'A' AND o <> sb GROUP BY 1, 2 HAVING sum(q) > 45)), c AS (SELECT o, count(*) AS n FROM x WHERE f = 'R' AND o NOT IN (SELECT o FROM tk) GROUP BY 1), c0 AS (SELECT o, count(*) AS n FROM x WHERE f = 'N' GROUP BY 1) "
    "SELECT 'oligo' AS what, c.o AS key, round((c.n + 1) / (c0.n + 1) * ((SELECT sum(n) FROM c0) / (SELECT sum(n) FROM c)), 9) AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c FROM c JOIN c0 ON c.o = c0.o WHERE c0.n >= 2 "
    "UNION ALL SELECT 'curve', conc, round(avg(v), 7), round(min(v), 7), round(max(v), 7) FROM (SELECT p_partkey % 100 AS conc, (p_retailprice::DOUBLE * unnest([1, 2, 3]) - p_size) / (p_size * 100.5 - p_size) AS v FROM part WHERE p_size > 0) GROUP BY conc"
)


def q90_motif_tools(spark: SparkSession, d: str) -> DataFrame:
    """Affinities of all 4-mers and how often they occur; where each 3-mer fits the motif best; how strong both motifs are in bases G and C."""
    rna = F.translate("kmer", "T", "U").alias("kmer")
    spelt = kmers.counts(reads(spark, d), 4).select(rna, "n")
    own = psam.kmer_affinities(spark, MOTIF, 2.0, 1e-3).select(rna, "affinity").join(spelt, "kmer").select(F.lit("affinity").alias("what"), "kmer", F.round("affinity", 9).alias("value"), "n")
    short = kmers.counts(reads(spark, d), 3).withColumn("best", psam.best_place(F.col("kmer"), 3, MOTIF))
    fit = short.select(F.lit("place").alias("what"), "kmer", F.round("best.score", 9).alias("value"), F.col("best.offset").cast("long").alias("n"))
    most = psam.highest_scoring(spark, MOTIF, 4, 12).join(spelt, "kmer", "left").select(F.lit("top").alias("what"), "kmer", F.round("score", 9).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
    strong = spark.createDataFrame([("gc", str(i), round(psam.gc_weight(w), 9), 0) for i, w in enumerate((MOTIF, SECOND))], "what string, kmer string, value double, n long")
    return own.unionByName(fit).unionByName(most).unionByName(strong)


def _place_sql() -> str:
    """The product for each offset of a 3-mer along the motif, with the least weight of rows that it doesn't reach."""
    scored = []
    for o in range(-2, 4):
        parts = [_base_sql(f"kmer[{i - o + 1}]", MOTIF[i]) if 0 <= i - o < 3 else f"{min(MOTIF[i])}::DOUBLE" for i in range(4)]
        scored.append(f"({' * '.join(parts)})")
    return "[" + ", ".join(scored) + "]"


_WORD = " * ".join(_base_sql(f"kmer[{i + 1}]", row) for i, row in enumerate(MOTIF))
_SPELL = "SELECT a.b || b.b || c.b || d.b AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) a(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) c(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) d(b)"


def _along_sql() -> str:
    """The best product of a 4-mer over all offsets."""
    scored = []
    for o in range(-3, 4):
        parts = [_base_sql(f"kmer[{i - o + 1}]", MOTIF[i]) if 0 <= i - o < 4 else f"{min(MOTIF[i])}::DOUBLE" for i in range(4)]
        scored.append(f"({' * '.join(parts)})")
    return "greatest(" + ", ".join(scored) + ")"


Q90 = (
    f"WITH {READS}, c AS (WITH {_kmer_sql(4)} SELECT kmer, count(*) AS n FROM km GROUP BY 1), t AS (WITH {_kmer_sql(3)} SELECT kmer, count(*) AS n FROM km GROUP BY 1), sc AS (SELECT kmer, {_place_sql()} AS x FROM t), al AS ({_SPELL}), tp AS (SELECT al.kmer, {_along_sql()} AS v FROM al) "
    f"SELECT 'affinity' AS what, replace(kmer, 'T', 'U') AS kmer, round(greatest(2 * {_WORD}, 0.001), 9) AS value, n FROM c UNION ALL SELECT 'place', kmer, round(list_max(x), 9), list_position(x, list_max(x)) - 3 FROM sc "
    "UNION ALL SELECT 'top', replace(k, 'T', 'U'), v, coalesce(n, 0) FROM (SELECT kmer AS k, round(v, 9) AS v FROM tp ORDER BY tp.v DESC, replace(kmer, 'T', 'U') DESC LIMIT 12) LEFT JOIN c ON c.kmer = k "
    + "".join(f"UNION ALL SELECT 'gc', '{i}', {round(sum(r[1] + r[2] for r in w) / sum(map(sum, w)), 9)}, 0 " for i, w in enumerate((MOTIF, SECOND)))
)


def q91_set_scores(spark: SparkSession, d: str) -> DataFrame:
    """A set of two motifs scored over the windows of seven bases by their distinct texts: sum, best and its place."""
    w = reads(spark, d).select(F.explode(s.kmers(F.col("seq"), 7)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total, best, place = psam.total_and_best(F.col("z"))
    x = written(w.withColumn("z", psam.set_scores(F.col("w"), [(2.0, MOTIF), (1.0, SECOND)])), "windows")
    return x.select(total.alias("t"), best.alias("b"), place.alias("place"), "n").groupBy(F.col("place").cast("long").alias("place")).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("t") * F.col("n")), 3).alias("total"), F.round(F.sum(F.col("b") * F.col("n")), 3).alias("best"))


def _seven(i: int) -> str:
    one, two = (" * ".join(_base_sql(f"w[{i + j}]", row) for j, row in enumerate(x)) for x in (MOTIF, SECOND))
    return f"{one} + {two} * 0.5::DOUBLE"


Q91 = f"WITH {READS}, w AS (SELECT substr(seq, i, 7) AS w FROM (SELECT *, unnest(generate_series(1, length(seq) - 6)) AS i FROM reads WHERE length(seq) >= 7)), z AS (SELECT [{', '.join(_seven(i) for i in range(1, 5))}] AS z FROM w) SELECT list_position(z, list_max(z)) - 1 AS place, count(*) AS n, round(sum(list_sum(z)), 3) AS total, round(sum(list_max(z)), 3) AS best FROM z GROUP BY 1"


def q92_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The ratios by language as a matrix of k-mers by samples, written as text, read back and melted."""
    x = _parts(spark, d).select("kmer", F.col("lang").alias("conc"), F.round("r", 7).alias("value"), F.round("error", 7).alias("error"))
    matrix = files.kmer_matrix(x)
    path = new_path(spark, "matrix")
    files.write_tsv(matrix, path)
    back = spark.read.schema(matrix.schema).option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
    samples = [c.removesuffix("_value") for c in matrix.columns if c.endswith("_value")]
    return files.melted(back, samples)


Q92 = f"WITH {READS}, {_PART_SQL} SELECT kmer, lang AS sample, round(r, 7) AS value, round(error, 7) AS error FROM rv"


def q93_samples(spark: SparkSession, d: str) -> DataFrame:
    """The samples by their top ratio, and the k-mers whose ratio less its error stays above 1."""
    x = written(_parts(spark, d), "parts")
    best = enrichment.best_samples(x, [1, 2], 1.0, "lang").select(F.lit("sample").alias("what"), F.col("lang").alias("key"), F.round("top", 7).alias("value"))
    one = x.filter("lang = 'de'").select("kmer", "r", "error")
    kept = enrichment.above_error(one, 1.0, 3).select(F.lit("kmer").alias("what"), F.col("kmer").alias("key"), F.round("r", 7).alias("value"))
    return best.unionByName(kept)


Q93 = f"WITH {READS}, {_PART_SQL}, t AS (SELECT lang, max(r) AS top FROM rv GROUP BY 1 HAVING max(r) >= 1), k AS (SELECT kmer, r, error, row_number() OVER (ORDER BY r DESC, kmer DESC) AS n FROM rv WHERE lang = 'de'), e AS (SELECT min(n) AS stop FROM k WHERE r - error <= 1 AND n > 3 + 1) SELECT 'sample' AS what, lang AS key, round(top, 7) AS value FROM (SELECT *, row_number() OVER (ORDER BY top DESC, lang) AS n FROM t) WHERE n <= 2 UNION ALL SELECT 'kmer', kmer, round(r, 7) FROM k CROSS JOIN e WHERE stop IS NULL OR n < stop"


def q94_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """How much oftener two bases stand at a distance than independent places would give, over the reads' first forty bases."""
    x = written(reads(spark, d).select("read_id", F.substring("seq", 1, 40).alias("seq")), "starts")
    expected = kmers.expected_pairs(kmers.profile(x, 1), x.count())
    got = enrichment.cooccurrence(kmers.joint_by_distance(x, 1, most=5), expected.filter("d <= 5"))
    return got.select("a", "b", F.col("d").cast("long").alias("d"), F.round("score", 7).alias("score"))


Q94 = f"WITH {READS}, h AS (SELECT read_id, left(seq, 40) AS seq FROM reads), km AS (SELECT read_id, i - 1 AS pos, substr(seq, i, 1) AS kmer FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM h)), o AS (SELECT x.kmer AS a, y.kmer AS b, y.pos - x.pos AS d, count(*) AS n FROM km x JOIN km y ON x.read_id = y.read_id AND y.pos BETWEEN x.pos + 1 AND x.pos + 5 GROUP BY ALL), p AS (SELECT kmer, pos, count(*) AS n FROM km GROUP BY ALL), e AS (SELECT x.kmer AS a, y.kmer AS b, y.pos - x.pos AS d, sum(x.n * y.n) / (SELECT count(*) FROM h) AS ex FROM p x JOIN p y ON y.pos BETWEEN x.pos + 1 AND x.pos + 5 GROUP BY ALL) SELECT a, b, d, round(log2((coalesce(n, 0) + 1) / (coalesce(ex, 0) + 1)), 7) AS score FROM o FULL JOIN e USING (a, b, d)"


def q95_shifts(spark: SparkSession, d: str) -> DataFrame:
    """What each 4-mer gives to its neighbours by a shift, added up."""
    c = kmers.counts(reads(spark, d), 4).select(s.kmer_index(F.col("kmer")).alias("index"), "n")
    x = c.select(F.inline(s.shifted(F.col("index"), 4, F.col("n") * 0.5)))
    return x.groupBy("index").agg(F.round(F.sum("weight"), 4).alias("weight"))


Q95 = f"WITH {READS}, {_kmer_sql(4)}, c AS (SELECT (strpos('ACGT', kmer[1]) - 1) * 64 + (strpos('ACGT', kmer[2]) - 1) * 16 + (strpos('ACGT', kmer[3]) - 1) * 4 + strpos('ACGT', kmer[4]) - 1 AS i, count(*) AS n FROM km GROUP BY 1), t AS (SELECT i % 64 * 4 + r AS index, n * 0.25::DOUBLE AS w FROM c CROSS JOIN (SELECT unnest(range(4)) AS r) UNION ALL SELECT i // 4 + r * 64, n * 0.25::DOUBLE FROM c CROSS JOIN (SELECT unnest(range(4)) AS r)) SELECT index, round(sum(w), 4) AS weight FROM t GROUP BY 1"


def q96_files(spark: SparkSession, d: str) -> DataFrame:
    """Intervals written as text and read back as BED, reads written and read back as FASTA, and the source with the most languages."""
    x = table(spark, d, "orders").select(F.concat(F.lit("chr"), F.col("o_custkey") % 20).alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 50).alias("end"), F.col("o_orderstatus").alias("name"), F.lit(None).cast("string").alias("score"), F.lit("+").alias("strand"))
    bed, fasta = new_path(spark, "bed"), new_path(spark, "fasta")
    files.write_tsv(x, bed, compress=True, header=False)
    own = files.read_bed(spark, bed).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("total")).select(F.lit("bed").alias("what"), F.col("chrom").alias("key"), "n", "total")
    files.reads_as_fasta(reads(spark, d), fasta)
    back = files.read_fasta(spark, fasta).select(F.lit("fasta").alias("what"), F.col("name").alias("key"), F.length("seq").cast("long").alias("n"), F.length(F.regexp_replace("seq", "[^G]", "")).cast("long").alias("total"))
    runs = table(spark, d, "documents").select(F.col("source").alias("rbp"), F.col("lang").alias("conc"), F.col("doc_id").alias("read_id"))
    large = files.largest_set(runs).groupBy(F.col("rbp").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("read_id").alias("total")).select(F.lit("set").alias("what"), "key", "n", "total")
    return own.unionByName(back).unionByName(large)


Q96 = f"WITH {READS}, b AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(DISTINCT lang) DESC, source LIMIT 1) SELECT 'bed' AS what, 'chr' || o_custkey % 20 AS key, count(*) AS n, sum(o_custkey % 50)::BIGINT AS total FROM orders GROUP BY 2 UNION ALL SELECT 'fasta', read_id::VARCHAR, length(seq), length(regexp_replace(seq, '[^G]', '', 'g')) FROM reads UNION ALL SELECT 'set', source, count(*), sum(doc_id)::BIGINT FROM documents JOIN b USING (source) GROUP BY source"


def q97_ratios_of_model(spark: SparkSession, d: str) -> DataFrame:
    """The enrichments that occupancies predict with a background, their squared error against the other languages' mean ratio."""
    x = written(structure.with_totals(structure.with_sites(reads(spark, d).filter("lang = 'en'"), [_motif(MOTIF)], keep=["read_id", "seq"])).select("read_id", "seq", "z"), "bound")
    n = kmers.counts(x, 3)
    f0 = written(n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("kmer", (F.col("n") / F.col("t")).alias("f0")), "shares")
    predicted = written(fitting.predicted_ratios(x, 3, fitting.occupancy_at("z", 0.05), 5.0, f0), "predicted")
    observed = _r(spark, d).groupBy("kmer").agg(F.avg("r").alias("r"))
    error = fitting.squared_error(predicted, observed)
    return predicted.select("kmer", F.round("r", 8).alias("r"), F.lit(round(error, 7)).alias("error"))


Q97 = (
    f"WITH {READS}, {_kmer_sql(3)}, {_freq_sql(3)}, {_R_SQL}, en AS (SELECT read_id, lang, seq FROM reads WHERE lang = 'en'), z AS (SELECT read_id, least(sum(" + " * ".join(_base_sql(f"substr(seq, i + {k}, 1)", row) for k, row in enumerate(MOTIF)) + "), 1e6) AS z FROM (SELECT *, unnest(generate_series(1, length(seq) - 3)) AS i FROM en WHERE length(seq) >= 4) GROUP BY 1), "
    "p AS (SELECT km.kmer, count(*) AS n, sum(coalesce(z, 0) * 0.05::DOUBLE / (coalesce(z, 0) * 0.05::DOUBLE + 1)) AS q FROM km LEFT JOIN z USING (read_id) WHERE km.lang = 'en' GROUP BY 1), f AS (SELECT *, n / sum(n) OVER () AS f0 FROM p), w AS (SELECT *, q + f0 * 5 AS w FROM f), r AS (SELECT kmer, w / f0 / sum(w) OVER () AS r FROM w), ob AS (SELECT kmer, avg(r) AS o FROM rv GROUP BY 1) "
    "SELECT kmer, round(r, 8) AS r, (SELECT round(avg((r - o) ** 2), 7) FROM r JOIN ob USING (kmer)) AS error FROM r"
)


def q98_footprint(spark: SparkSession, d: str) -> DataFrame:
    """Accessibility at offsets round the motif's sites, by their affinity and the read's occupancy, within the array."""
    x = structure.with_totals(structure.with_sites(reads(spark, d).withColumn("acc", _open(F.col("seq"))), [_motif(MOTIF)], keep=["read_id", "acc"]))
    return fitting.footprint(written(x, "sites"), 4, 2, weight=fitting.occupancy_at("z", 0.1)).select(F.col("d").cast("long").alias("d"), F.round("p", 8).alias("p"))


Q98 = f"WITH {READS}, k AS (SELECT read_id, length(seq) AS l, i - 1 AS i, " + " * ".join(_base_sql(f"substr(seq, i + {k}, 1)", row) for k, row in enumerate(MOTIF)) + f" AS z FROM (SELECT *, unnest(generate_series(1, length(seq) - 3)) AS i FROM reads WHERE length(seq) >= 4)), t AS (SELECT read_id, least(sum(z), 1e6) * 0.1::DOUBLE AS x FROM k GROUP BY 1), o AS (SELECT read_id, i - 1 AS j, {_open_sql('substr(seq, i, 1)', 'i - 1')} AS acc FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM reads)) SELECT o.j - k.i AS d, round(sum(z * acc * x / (x + 1)) / sum(z * x / (x + 1)), 8) AS p FROM k JOIN t USING (read_id) JOIN o ON o.read_id = k.read_id AND o.j BETWEEN k.i - 2 AND k.i + 5 GROUP BY 1"


def q99_ska_batched(spark: SparkSession, d: str) -> DataFrame:
    """Three passes in which all reads share by the last pass's weights."""
    w = written(kmers.positions(reads(spark, d), 2).select("read_id", "kmer"), "windows")
    start = s.all_kmers(spark, 2).withColumn("value", F.lit(1.0))
    return enrichment.ska_batched(w, start, 3).select("kmer", F.round("weight", 7).alias("weight"))


def _ska_sql(passes: int) -> str:
    parts = ["al AS (SELECT a.b || b.b AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) a(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) b(b))", "w0 AS (SELECT kmer, 1::DOUBLE AS w FROM al)", "oc AS (SELECT read_id, kmer, count(*) AS n FROM km GROUP BY 1, 2)"]
    for i in range(passes):
        parts.append(f"p{i} AS (SELECT read_id, kmer, n * w AS x, sum(n * w) OVER (PARTITION BY read_id) AS t FROM oc JOIN w{i} USING (kmer))")
        parts.append(f"w{i + 1} AS (SELECT kmer, s / (sum(s) OVER ()) * 16 AS w FROM (SELECT w{i}.kmer, any_value(w) + coalesce(sum(x / t), 0) AS s FROM w{i} LEFT JOIN p{i} ON p{i}.kmer = w{i}.kmer GROUP BY w{i}.kmer))")
    return ", ".join(parts)


Q99 = f"WITH {READS}, {_kmer_sql(2)}, {_ska_sql(3)} SELECT kmer, round(w, 7) AS weight FROM w3"

def _model_reads(spark: SparkSession, d: str) -> DataFrame:
    """The English reads with z of the first motif."""
    x = structure.with_totals(structure.with_sites(reads(spark, d).filter("lang = 'en'"), [_motif(MOTIF)], keep=["read_id", "seq"]))
    return written(x.select("read_id", "seq", "z"), "model-reads")


_SAMPLES = ([1.0, 5.0], [0.02, 0.4], [3.0, 0.5])  # totals, free protein, backgrounds


def q100_model_state(spark: SparkSession, d: str) -> DataFrame:
    """A model's state at fixed parameters: enrichments, errors, complexes, and each k-mer's estimates of background and affinity."""
    x = _model_reads(spark, d)
    at = np.arange(16)
    samples = states.Samples(_SAMPLES[0], 100.0, states.kmer_counts(x, 2), np.stack([0.61 + at / 20, 1.32 - at / 20]), 2)
    one = states.states(x, [0.8], samples, betas=np.array(_SAMPLES[2]), free=np.array([_SAMPLES[1]]))[0]
    rows = []
    for name, v in (("r", one.enriched), ("beta", one.beta_estimators()), ("a0", one.a0_estimators())):
        rows += [(name, s, i, float(v[s, i])) for s in (0, 1) for i in range(16) if samples.used[i]]
    for name, v in (("error", one.sample_errors), *zip(("specific", "unspecific", "complex"), one.concentrations(10, 10), strict=True), ("correlation", [c[0] for c in one.correlations()])):
        rows += [(name, s, 0, float(v[s])) for s in (0, 1)]
    rows.append(("slope", 0, 0, states.a0_slope(x, one)))
    return spark.createDataFrame(rows, "what string, sample long, at long, value double").withColumn("value", F.round("value", 4))


Q100 = (
    f"WITH {READS}, {_kmer_sql(2)}, en AS (SELECT * FROM reads WHERE lang = 'en'), z AS (SELECT read_id, least(sum(" + " * ".join(_base_sql(f"substr(seq, i + {k}, 1)", row) for k, row in enumerate(MOTIF)) + "), 1e6) AS z FROM (SELECT *, unnest(generate_series(1, length(seq) - 3)) AS i FROM en WHERE length(seq) >= 4) GROUP BY 1), "
    "sm AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.02::DOUBLE, 3.0::DOUBLE), (1, 5.0, 0.4, 0.5)) t(s, total, free, beta)), x AS (SELECT s, total, free, beta, km.kmer, coalesce(z, 0) * free * 0.8::DOUBLE AS x FROM km LEFT JOIN z USING (read_id) CROSS JOIN sm WHERE km.lang = 'en'), "
    "q AS (SELECT s, any_value(total) AS total, any_value(free) AS free, any_value(beta) AS beta, strpos('ACGT', kmer[1]) * 4 + strpos('ACGT', kmer[2]) - 5 AS i, count(*) AS n, sum(x / (x + 1)) AS q, sum(x / (x + 1) - (x / (x + 1)) ** 2) / 0.8 AS dq FROM x GROUP BY s, kmer), "
    "w AS (SELECT *, n / sum(n) OVER p AS f0, q + n * beta AS w, sum(q) OVER p AS tq, sum(q + n * beta) OVER p AS tw, sum(dq) OVER p AS td, CASE s WHEN 0 THEN 0.61 + i / 20 ELSE 1.32 - i / 20 END AS o FROM q WINDOW p AS (PARTITION BY s)), r AS (SELECT *, w / f0 / tw AS r FROM w) "
    "SELECT 'r' AS what, s::BIGINT AS sample, i::BIGINT AS at, round(r, 4) AS value FROM r UNION ALL SELECT 'beta', s, i, round((o * f0 * tq - q) / (n * (1 - o)), 4) FROM r UNION ALL SELECT 'a0', s, i, round(beta * n * (1 - o) / ((tq * o * f0 - q) / 0.8), 4) FROM r "
    "UNION ALL SELECT 'error', s, 0, round(avg((r - o) ** 2), 4) FROM r GROUP BY s UNION ALL SELECT 'specific', s, 0, round(any_value(tq), 4) FROM r GROUP BY s UNION ALL SELECT 'unspecific', s, 0, round(any_value(tw - tq), 4) FROM r GROUP BY s UNION ALL SELECT 'complex', s, 0, round(any_value(total - free), 4) FROM r GROUP BY s "
    "UNION ALL SELECT 'correlation', s, 0, round(corr(log2(r), log2(o)), 4) FROM r GROUP BY s UNION ALL SELECT 'slope', 0, 0, round(avg(2 * (r - o) * (dq - r * f0 * td) / f0 / tw), 4) FROM r"
)


def q101_known(spark: SparkSession, d: str) -> DataFrame:
    """Dissociation constants that the motif predicts for the reads' first bases, against measured ones (the documents' lengths)."""
    x = reads(spark, d).filter("length(seq) >= 8").select("read_id", F.substring("seq", 1, 8).alias("seq"))
    x = structure.with_totals(structure.with_sites(x, [_motif(MOTIF)], nonspecific=1e-4, keep=["read_id"]))
    known = x.join(table(spark, d, "documents").select(F.col("doc_id").alias("read_id"), F.length("text").cast("double").alias("kd")), "read_id")
    got = states.against_known(written(known.select("kd", (1 / F.round("z", 9)).alias("predicted")), "known"))
    return got.select("n", *[F.round(c, 7).alias(c) for c in ("r", "rho", "lowest", "median", "highest")])


Q101 = (
    "WITH k AS (SELECT doc_id, length(text)::DOUBLE AS kd, left(upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')), 8) AS s FROM documents), z AS (SELECT doc_id, any_value(kd) AS kd, sum(" + " * ".join(_base_sql(f"substr(s, i + {k}, 1)", row) for k, row in enumerate(MOTIF)) + " + 1e-4::DOUBLE) AS z FROM (SELECT *, unnest(generate_series(1, 5)) AS i FROM k WHERE length(s) = 8) GROUP BY 1), "
    "x AS (SELECT log10(kd) AS x, log10(1 / round(z, 9)) AS y FROM z), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM x) "
    "SELECT count(*) AS n, round(corr(x, y), 7) AS r, round(corr(a, b), 7) AS rho, round(min(y - x), 7) AS lowest, round(quantile_cont(y - x, 0.5), 7) AS median, round(max(y - x), 7) AS highest FROM r"
)


def q102_explained(spark: SparkSession, d: str) -> DataFrame:
    """The share of each language's reads that hold each 3-mer, with an error from ten parts of the reads."""
    return enrichment.explained(reads(spark, d), 3, 10, ["lang"]).select("lang", "kmer", F.round("share", 8).alias("share"), F.round("error", 8).alias("error"))


Q102 = (
    f"WITH {READS}, pt AS (SELECT lang, read_id, seq, ntile(10) OVER (ORDER BY read_id) AS part FROM reads), h AS (SELECT DISTINCT lang, part, read_id, substr(seq, i, 3) AS kmer FROM (SELECT *, unnest(generate_series(1, length(seq) - 2)) AS i FROM pt WHERE length(seq) >= 3)), al AS (SELECT x.b || y.b || z.b AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) x(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) y(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) z(b)), "
    "w AS (SELECT t.lang, al.kmer, (coalesce(n, 0) + 10) / (t.t + 10) AS share FROM (SELECT lang, count(*) AS t FROM pt GROUP BY 1) t CROSS JOIN al LEFT JOIN (SELECT lang, kmer, count(*) AS n FROM h GROUP BY ALL) c ON c.lang = t.lang AND c.kmer = al.kmer), "
    "e AS (SELECT t.lang, t.part, al.kmer, (coalesce(n, 0) + 10) / (t.t + 10) AS f FROM (SELECT lang, part, count(*) AS t FROM pt GROUP BY ALL) t CROSS JOIN al LEFT JOIN (SELECT lang, part, kmer, count(*) AS n FROM h GROUP BY ALL) c ON c.lang = t.lang AND c.part = t.part AND c.kmer = al.kmer) "
    "SELECT lang, kmer, round(any_value(share), 8) AS share, round(sqrt(avg((f - share) ** 2) / count(*)), 8) AS error FROM e JOIN w USING (lang, kmer) GROUP BY ALL"
)

def q103_variants_file(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as a gzipped VCF (with its head, and some that aren't single nucleotides), read back, and made ready."""
    x = table(spark, d, "lineitem")
    ref, alt = F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("l_linenumber") % 4 + 1).cast("int")), F.when(F.col("l_suppkey") % 5 == 0, "GT").otherwise(F.element_at(F.array(*map(F.lit, "cgta")), (F.col("l_linenumber") % 4 + 1).cast("int")))
    cells = [F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("chr"), F.col("l_suppkey") % 22 + 1)).otherwise((F.col("l_suppkey") % 22 + 1).cast("string")), (F.col("l_orderkey") + 1).cast("string"), F.concat(F.lit("rs"), F.col("l_partkey")), ref, alt, F.lit("."), F.lit("PASS"), F.lit("A=1;B=2"), F.lit("GT")]
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT",)], "value string")
    path = new_path(spark, "variants")
    x.select(F.concat_ws("\t", *cells).alias("value")).unionByName(head).write.option("compression", "gzip").text(path)
    own = annotate.single_nucleotide(files.read_vcf(spark, path))
    return own.groupBy("variant_id", "chrom", "start", "end", "ref", "alt").agg(F.count(F.lit(1)).alias("n"), F.min("info").alias("info"))


Q103 = "WITH v AS (SELECT 'chr' || (l_suppkey % 22 + 1) AS chrom, l_orderkey AS s, 'ACGT'[(l_linenumber % 4 + 1)::INT] AS ref, 'CGTA'[(l_linenumber % 4 + 1)::INT] AS alt, 'rs' || l_partkey AS info FROM lineitem WHERE l_suppkey % 5 <> 0) SELECT chrom || '_' || (s + 1) || '_' || ref || '_' || alt AS variant_id, chrom, s AS start, s + 1 AS \"end\", ref, alt, count(*) AS n, min(info) AS info FROM v GROUP BY ALL"


def q104_genome(spark: SparkSession, d: str) -> DataFrame:
    """The reads as a genome in a FASTA file: variants' windows fetched from its chunks by strand, and whether the reference base stands there."""
    path = new_path(spark, "genome")
    x = reads(spark, d).withColumn("strand", F.when(F.col("read_id") % 2 == 0, "+").otherwise("-"))
    files.reads_as_fasta(x, path)
    genome = written(files.genome_chunks(files.read_fasta(spark, path), 256), "genome")
    places = x.filter("length(seq) >= 100").withColumn("at", F.explode(F.sequence(F.lit(0), F.length("seq") - 1, F.lit(97))))
    variants = places.select(F.col("read_id").cast("string").alias("chrom"), F.col("at").cast("long").alias("start"), (F.col("at") + 1).cast("long").alias("end"), F.lit("A").alias("ref"), "strand")
    return annotate.windows(variants, genome, 256).select(F.col("chrom").cast("long").alias("read_id"), "start", F.md5("seq").alias("digest"), "ref_match")


Q104 = f"WITH {READS}, p AS (SELECT read_id, seq, read_id % 2 = 0 AS fw, unnest(generate_series(0, length(seq) - 1, 97)) AS x FROM reads WHERE length(seq) >= 100), w AS (SELECT *, substr(seq, (x - 42)::BIGINT, 87) AS w FROM p WHERE x >= 43 AND x + 44 <= length(seq)) SELECT read_id, x AS start, md5(CASE WHEN fw THEN w ELSE reverse(translate(w, 'ACGT', 'TGCA')) END) AS digest, seq[(x + 1)::INT] = 'A' AS ref_match FROM w"

QUERIES = {name: f for name, f in globals().items() if name[:1] == "q" and name[1:3].isdigit()}
ORACLE_SQL = {name: globals()[name.split("_")[0].upper()] for name in QUERIES if name.split("_")[0].upper() in globals()}
