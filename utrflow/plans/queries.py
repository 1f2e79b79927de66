"""The registered queries: each operator over the driver's tables, whole, with SQL that gives the same rows.

Reads are the A, C, G, T letters of documents (language as sample); intervals are windows round events of a user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utrflow.functions import measures as m
from utrflow.functions import sequence as s
from utrflow.operators import annotate, compare, enrichment, fitting, intervals, kmers, psam, regression, seeding, simulate, structure, training
from utrflow.plans.storage import numbered, written

#: A motif of four rows (A C G U).
MOTIF = [[0.9, 0.1, 0.05, 1.0], [0.02, 0.1, 1.0, 0.05], [0.2, 1.0, 0.1, 0.3], [1.0, 0.05, 0.3, 0.1]]
MINUTE = 60_000_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(read_id, lang, seq) of all documents with a base."""
    # the filter looks at the text: one on seq would be pushed down and cut the letters out a second time
    return table(spark, d, "documents").filter(F.col("text").rlike("[ACGTacgt]")).select(F.col("doc_id").alias("read_id"), "lang", F.upper(F.regexp_replace("text", "[^ACGTacgt]+", "")).alias("seq"))


READS = "reads AS (SELECT doc_id AS read_id, lang, seq FROM (SELECT doc_id, lang, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents) WHERE seq <> '')"


def events(spark: SparkSession, d: str, kind: str, names: tuple[str, str, str] = ("event_id", "start", "end"), wide: int = 0) -> DataFrame:
    """Events of a type as intervals of a user, one microsecond or ``wide`` microseconds either side."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").filter(F.col("event_type") == kind).select(F.col("user_id"), F.col("event_id").alias(names[0]), (at - wide).alias(names[1]), (at + wide + 1).alias(names[2]))


def _ev(kind: str, name: str, wide: int = 0) -> str:
    return f"{name} AS (SELECT user_id, event_id, epoch_us(ts) - {wide} AS a, epoch_us(ts) + {wide} + 1 AS b FROM events WHERE event_type = '{kind}')"


OVERLAPS = dict(keys=["user_id"], width=20 * MINUTE)
RIGHT = ("hit_id", "r_start", "r_end")


def q01_overlap_collapse(spark: SparkSession, d: str) -> DataFrame:
    left, right = events(spark, d, "error"), events(spark, d, "purchase", RIGHT, 10 * MINUTE)
    hits = intervals.overlap_join(left, right, how="left", left_id="event_id", **OVERLAPS)
    return intervals.collapsed(hits, ["event_id", "user_id"], "hit_id", "hits", "|", empty="")


Q01 = f"WITH {_ev('error', 'l')}, {_ev('purchase', 'r', 10 * MINUTE)} SELECT l.event_id, l.user_id, coalesce(string_agg(r.event_id::VARCHAR, '|' ORDER BY r.event_id), '') AS hits FROM l LEFT JOIN r ON l.user_id = r.user_id AND l.a < r.b AND r.a < l.b GROUP BY ALL"


def q02_fallback_union(spark: SparkSession, d: str) -> DataFrame:
    left = events(spark, d, "error")
    first = events(spark, d, "purchase", RIGHT, MINUTE).withColumn("source", F.lit("purchase"))
    second = events(spark, d, "signup", RIGHT, 60 * MINUTE).withColumn("source", F.lit("signup"))
    return intervals.with_fallback(left, first, second, "event_id", **OVERLAPS).select("event_id", "hit_id", "source")


Q02 = f"WITH {_ev('error', 'l')}, {_ev('purchase', 'p', MINUTE)}, {_ev('signup', 'q', 60 * MINUTE)}, one AS (SELECT l.event_id, p.event_id AS hit_id, 'purchase' AS source FROM l JOIN p ON l.user_id = p.user_id AND l.a < p.b AND p.a < l.b) SELECT * FROM one UNION ALL SELECT l.event_id, q.event_id, 'signup' FROM l JOIN q ON l.user_id = q.user_id AND l.a < q.b AND q.a < l.b WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.event_id = l.event_id)"


def q03_two_source_collapse(spark: SparkSession, d: str) -> DataFrame:
    right = None
    for rank, kind in enumerate(("purchase", "signup")):
        part = events(spark, d, kind, RIGHT, 30 * MINUTE).withColumns({"rank": F.lit(rank), "what": F.concat_ws("_", F.lit(kind), "hit_id")})
        right = part if right is None else right.unionByName(part)
    hits = intervals.overlap_join(events(spark, d, "error"), right, how="left", left_id="event_id", **OVERLAPS)
    return intervals.collapsed(hits, ["event_id"], "what", "hits", "__", ["rank", "hit_id"], empty="")


Q03 = f"WITH {_ev('error', 'l')}, {_ev('purchase', 'p', 30 * MINUTE)}, {_ev('signup', 'q', 30 * MINUTE)}, r AS (SELECT *, 0 AS k, 'purchase_' || event_id AS what FROM p UNION ALL SELECT *, 1, 'signup_' || event_id FROM q) SELECT l.event_id, coalesce(string_agg(r.what, '__' ORDER BY r.k, r.event_id), '') AS hits FROM l LEFT JOIN r ON l.user_id = r.user_id AND l.a < r.b AND r.a < l.b GROUP BY ALL"


def q04_snv_filter(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").filter((F.length("l_returnflag") == 1) & (F.length("l_linestatus") == 1))
    return x.select(F.concat(F.lit("chr"), F.col("l_suppkey")).alias("chrom"), (F.col("l_partkey") - 1).alias("start"), F.col("l_partkey").alias("end"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"))


Q04 = "SELECT 'chr' || l_suppkey AS chrom, l_partkey - 1 AS start, l_partkey AS \"end\", l_returnflag AS ref, l_linestatus AS alt FROM lineitem WHERE length(l_returnflag) = 1 AND length(l_linestatus) = 1"


def q05_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", F.length("seq").cast("long").alias("n"), F.md5(s.reverse_complement(F.col("seq"))).alias("digest"))


Q05 = f"WITH {READS} SELECT read_id, length(seq) AS n, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS digest FROM reads"


def q06_window_sub(spark: SparkSession, d: str) -> DataFrame:
    """A variant at every place that has ten bases either side: its windows, as one digest a read."""
    ref = s.kmers(F.col("seq"), 21)
    alt = F.transform(ref, lambda w: s.substituted(w, F.translate(F.substring(w, 11, 1), "ACGT", "CGTA"), 11))
    line = lambda a: F.md5(F.array_join(a, ","))
    return reads(spark, d).filter(F.length("seq") >= 21).select("read_id", F.size(ref).cast("long").alias("n"), line(ref).alias("refs"), line(alt).alias("alts"))


Q06 = f"WITH {READS}, w AS (SELECT read_id, i, substr(seq, i, 21) AS w FROM (SELECT *, unnest(generate_series(1, length(seq) - 20)) AS i FROM reads WHERE length(seq) >= 21)) SELECT read_id, count(*) AS n, md5(string_agg(w, ',' ORDER BY i)) AS refs, md5(string_agg(substr(w, 1, 10) || translate(substr(w, 11, 1), 'ACGT', 'CGTA') || substr(w, 12), ',' ORDER BY i)) AS alts FROM w GROUP BY 1"


def q07_multiallele(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("alts"))
    return annotate.alleles(listed).select(F.col("l_orderkey").alias("site"), "alts", "allele")


Q07 = "WITH g AS (SELECT l_orderkey AS site, list_sort(list_distinct(list(l_returnflag))) AS x FROM lineitem GROUP BY 1) SELECT site, array_to_string(x, ',') AS alts, unnest(x) AS allele FROM g"


def q08_merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    x = table(spark, d, "events").select("user_id", (at - 10 * MINUTE).alias("start"), (at + 10 * MINUTE).alias("end"), "event_type")
    return intervals.merge_overlapping(x, ["user_id"], lists=["event_type"], width=24 * 60 * MINUTE)


Q08 = f"WITH e AS (SELECT user_id, epoch_us(ts) - {10 * MINUTE} AS a, epoch_us(ts) + {10 * MINUTE} AS b, event_type FROM events), w AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e), r AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM w) SELECT user_id, min(a) AS start, max(b) AS \"end\", count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_type FROM r GROUP BY user_id, run"


def _kmer_sql(k: int, extra: str = "") -> str:
    return f"km AS (SELECT read_id, lang, i - 1 AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT *, unnest(generate_series(1, length(seq) - {k - 1})) AS i FROM reads WHERE length(seq) >= {k}){extra})"


def q09_kmer_count(spark: SparkSession, d: str) -> DataFrame:
    return kmers.counts(reads(spark, d), 3, ["lang"])


Q09 = f"WITH {READS}, {_kmer_sql(3)} SELECT lang, kmer, count(*) AS n FROM km GROUP BY ALL"


def _freq(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    """Frequencies from counts that are written once: they are read for the frame, the counts and the totals."""
    return kmers.frequencies(written(kmers.counts(reads(spark, d), k, ["lang"]), "counts"), k, ["lang"])


def q10_kmer_freq_zero(spark: SparkSession, d: str) -> DataFrame:
    return _freq(spark, d, 4).select("lang", "kmer", "n", F.round("freq", 8).alias("freq"))


def _freq_sql(k: int) -> str:
    parts = " CROSS JOIN ".join(f"(VALUES ('A'), ('C'), ('G'), ('T')) AS b{i}(b{i})" for i in range(k))
    word = " || ".join(f"b{i}" for i in range(k))
    return f"al AS (SELECT {word} AS kmer FROM {parts}), c AS (SELECT lang, kmer, count(*) AS n FROM km GROUP BY ALL), full_ AS (SELECT l.lang, al.kmer, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang FROM c) l CROSS JOIN al LEFT JOIN c ON c.lang = l.lang AND c.kmer = al.kmer), fr AS (SELECT *, (n + 10) / sum(n + 10) OVER (PARTITION BY lang) * {4**k} AS freq FROM full_)"


Q10 = f"WITH {READS}, {_kmer_sql(4)}, {_freq_sql(4)} SELECT lang, kmer, n, round(freq, 8) AS freq FROM fr"


def _r(spark: SparkSession, d: str, k: int = 3) -> DataFrame:
    f = _freq(spark, d, k)
    return enrichment.ratios(f.filter("lang != 'en'"), f.filter("lang = 'en'"), "freq", "r")


_R_SQL = "rv AS (SELECT a.lang, a.kmer, a.freq / b.freq AS r FROM fr a JOIN fr b ON a.kmer = b.kmer AND b.lang = 'en' WHERE a.lang <> 'en')"


def q11_r_value(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark, d).select("lang", "kmer", F.round("r", 8).alias("r"))


Q11 = f"WITH {READS}, {_kmer_sql(3)}, {_freq_sql(3)}, {_R_SQL} SELECT lang, kmer, round(r, 8) AS r FROM rv"


def q12_top_kmers(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.ranked(_r(spark, d), "r", ["lang"]).filter("rank <= 10").select("lang", F.col("rank").cast("long").alias("rank"), "kmer", F.round("r", 8).alias("r"))


Q12 = f"WITH {READS}, {_kmer_sql(3)}, {_freq_sql(3)}, {_R_SQL} SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY r DESC, kmer DESC) AS rank, kmer, round(r, 8) AS r FROM rv) WHERE rank <= 10"


def q13_zscore(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark, d).select("lang", "kmer", F.round(m.z_score(F.col("r"), "lang"), 6).alias("z"))


Q13 = f"WITH {READS}, {_kmer_sql(3)}, {_freq_sql(3)}, {_R_SQL} SELECT lang, kmer, round((r - avg(r) OVER (PARTITION BY lang)) / stddev_pop(r) OVER (PARTITION BY lang), 6) AS z FROM rv"


def _shares(spark: SparkSession, d: str, hits: DataFrame, k: int) -> DataFrame:
    return kmers.fractions(hits, reads(spark, d), k, ["lang"])


def q14_reads_with_kmer(spark: SparkSession, d: str) -> DataFrame:
    f = _shares(spark, d, kmers.reads_with(reads(spark, d), 4, ["lang"]), 4)
    return enrichment.ratios(f.filter("lang != 'en'"), f.filter("lang = 'en'"), "fraction", "f").select("lang", "kmer", "n", F.round("fraction", 8).alias("fraction"), F.round("f", 8).alias("f"))


def _full_sql(k: int, hits: str) -> str:
    """al, t (reads by lang) and x (lang, kmer, n, fraction) of all k-mers, from a table (lang, kmer, n)."""
    parts = " CROSS JOIN ".join(f"(VALUES ('A'), ('C'), ('G'), ('T')) AS b{i}(b{i})" for i in range(k))
    word = " || ".join(f"b{i}" for i in range(k))
    return f"al AS (SELECT {word} AS kmer FROM {parts}), t AS (SELECT lang, count(*) AS t FROM reads GROUP BY 1), x AS (SELECT t.lang, al.kmer, coalesce(h.n, 0) AS n, (coalesce(h.n, 0) + 10) / (t + 10) AS fraction FROM t CROSS JOIN al LEFT JOIN {hits} h ON h.lang = t.lang AND h.kmer = al.kmer)"


Q14 = f"WITH {READS}, {_kmer_sql(4)}, h AS (SELECT lang, kmer, count(DISTINCT read_id) AS n FROM km GROUP BY ALL), {_full_sql(4, 'h')} SELECT a.lang, a.kmer, a.n, round(a.fraction, 8) AS fraction, round(a.fraction / b.fraction, 8) AS f FROM x a JOIN x b ON a.kmer = b.kmer AND b.lang = 'en' WHERE a.lang <> 'en'"

_PAIR_SQL = f"{_kmer_sql(2)}, pr AS (SELECT x.lang, x.kmer AS a, y.kmer AS b, y.pos - x.pos AS d FROM km x JOIN km y ON x.read_id = y.read_id AND y.pos BETWEEN x.pos + 2 AND x.pos + 6), jt AS (SELECT lang, a, b, d, count(*) AS n FROM pr GROUP BY ALL)"


def q15_pair_distance(spark: SparkSession, d: str) -> DataFrame:
    return kmers.joint_by_distance(reads(spark, d), 2, ["lang"], 6).withColumn("d", F.col("d").cast("long"))


Q15 = f"WITH {READS}, {_PAIR_SQL} SELECT * FROM jt"


def q16_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    got = kmers.mutual_information(kmers.joint_by_distance(reads(spark, d), 2, ["lang"], 6), _freq(spark, d, 2), 2, ["lang"])
    return got.select("lang", F.col("d").cast("long").alias("d"), F.round("mi", 7).alias("mi"))


Q16 = f"WITH {READS}, {_PAIR_SQL}, {_freq_sql(2)}, q AS (SELECT g.lang, g.d, x.kmer AS a, y.kmer AS b, coalesce(jt.n, 0) + 10 AS n, x.freq / 16 AS fa, y.freq / 16 AS fb FROM (SELECT DISTINCT lang, d FROM jt) g JOIN fr x ON x.lang = g.lang JOIN fr y ON y.lang = g.lang LEFT JOIN jt ON jt.lang = g.lang AND jt.d = g.d AND jt.a = x.kmer AND jt.b = y.kmer), p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, d) AS p FROM q) SELECT lang, d, round(sum(p * log2(p / (fa * fb))), 7) AS mi FROM p GROUP BY ALL"


def q17_kmer_profile(spark: SparkSession, d: str) -> DataFrame:
    return kmers.profile(reads(spark, d), 1, ["lang"]).withColumn("pos", F.col("pos").cast("long"))


Q17 = f"WITH {READS}, {_kmer_sql(1)} SELECT lang, kmer, pos, count(*) AS n FROM km GROUP BY ALL"


def q18_flank_profile(spark: SparkSession, d: str) -> DataFrame:
    return kmers.flank_profile(reads(spark, d), "TGCA", 2, 6, ["lang"]).withColumn("d", F.col("d").cast("long"))


Q18 = f"WITH {READS}, {_kmer_sql(4)}, k2 AS (SELECT read_id, i - 1 AS pos, substr(seq, i, 2) AS kmer FROM (SELECT *, unnest(generate_series(1, length(seq) - 1)) AS i FROM reads WHERE length(seq) >= 2)) SELECT km.lang, k2.pos - km.pos AS d, k2.kmer, count(*) AS n FROM km JOIN k2 ON km.read_id = k2.read_id AND k2.pos BETWEEN km.pos - 6 AND km.pos + 6 WHERE km.kmer = 'TGCA' GROUP BY ALL"


def _base_sql(text: str, row: list[float]) -> str:
    return f"(CASE {text} WHEN 'A' THEN {row[0]}::DOUBLE WHEN 'C' THEN {row[1]}::DOUBLE WHEN 'G' THEN {row[2]}::DOUBLE WHEN 'T' THEN {row[3]}::DOUBLE ELSE 0 END)"


_SITE = " * ".join(_base_sql(f"substr(seq, i + {k}, 1)", row) for k, row in enumerate(MOTIF))
_SCORE_SQL = f"st AS (SELECT read_id, lang, i, {_SITE} AS z FROM (SELECT *, unnest(generate_series(1, length(seq) - 3)) AS i FROM reads WHERE length(seq) >= 4))"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Per read that holds a site: total and best site score, within the read's row."""
    x = structure.with_totals(structure.with_sites(reads(spark, d), [structure.Motif(tuple(map(tuple, MOTIF)))], keep=["read_id", "lang"]))
    return x.filter("best is not null").select("read_id", "lang", F.col("z").alias("total"), "best")


def q19_psam_score(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("read_id", F.round("total", 9).alias("total"), F.round("best", 8).alias("best"))


Q19 = f"WITH {READS}, {_SCORE_SQL} SELECT read_id, round(sum(z), 9) AS total, round(max(z), 8) AS best FROM st GROUP BY 1"


def q20_disruption(spark: SparkSession, d: str) -> DataFrame:
    """A variant at every place that has three bases either side: what it does to the site's score, by read."""
    ref = F.col("ref")
    # each of the 4^7 windows is scored once
    x = s.all_kmers(spark, 7).withColumnRenamed("kmer", "ref")
    x = x.select("ref", s.substituted(ref, F.translate(F.substring(ref, 4, 1), "ACGT", "CGTA"), 4).alias("alt"))
    total = lambda w: sum((psam.window_score(F.substring(w, i, 4), MOTIF) for i in range(2, 5)), psam.window_score(F.substring(w, 1, 4), MOTIF))
    scored = written(x.select("ref", total("ref").alias("a"), total("alt").alias("b")).withColumn("cat", annotate.call(F.col("a"), F.col("b"))), "windows")
    y = reads(spark, d).select("read_id", F.explode(s.kmers(F.col("seq"), 7)).alias("ref")).join(F.broadcast(scored), "ref")
    cat = lambda name: F.count(F.when(F.col("cat") == name, 1)).alias(name)
    return y.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 9).alias("ref_score"), F.round(F.sum("b"), 9).alias("alt_score"), cat("lost"), cat("preserved"))


def _four(word: str) -> str:
    return " + ".join("(" + " * ".join(_base_sql(f"substr({word}, {i + k}, 1)", row) for k, row in enumerate(MOTIF)) + ")" for i in range(1, 5))


Q20 = f"WITH {READS}, v AS (SELECT read_id, substr(seq, i, 7) AS ref FROM (SELECT *, unnest(generate_series(1, length(seq) - 6)) AS i FROM reads WHERE length(seq) >= 7)), w AS (SELECT read_id, ref, substr(ref, 1, 3) || translate(substr(ref, 4, 1), 'ACGT', 'CGTA') || substr(ref, 5) AS alt FROM v), z AS (SELECT read_id, {_four('ref')} AS a, {_four('alt')} AS b FROM w) SELECT read_id, count(*) AS n, round(sum(a), 9) AS ref_score, round(sum(b), 9) AS alt_score, count(*) FILTER (a > 0.33 AND b / a < 0.33) AS lost, count(*) FILTER (a > 0.33 AND b / a > 0.67) AS preserved FROM z GROUP BY 1"


def q21_occupancy(spark: SparkSession, d: str) -> DataFrame:
    conc = F.explode(F.array(F.lit(0.01), F.lit(0.1), F.lit(1.0))).alias("conc")
    return _scores(spark, d).select("read_id", "total", conc).select("read_id", "conc", F.round(m.occupancy(F.col("total"), F.col("conc")), 6).alias("psi"))


Q21 = f"WITH {READS}, {_SCORE_SQL}, t AS (SELECT read_id, sum(z) AS z FROM st GROUP BY 1) SELECT read_id, conc, round(z * conc / (z * conc + 1), 6) AS psi FROM t CROSS JOIN (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE)) AS c(conc)"


def q22_iso_region(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").withColumn("isos", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    dist = annotate.nearest_end(F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", annotate.isoform_region(F.col("l_linenumber"), F.col("isos")).alias("region"), dist.alias("pas"))


Q22 = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c = 1 THEN 'single' WHEN l_linenumber / c <= 0.5 THEN 'common' WHEN l_linenumber / c > 0.5 AND l_linenumber / c < 1 THEN 'partially_shared' WHEN l_linenumber = c THEN 'unique' END AS region, least(abs(l_partkey - l_suppkey), abs(l_partkey - l_orderkey)) AS pas FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem)"


def q23_star_left_joins(spark: SparkSession, d: str) -> DataFrame:
    rename = lambda name, **c: table(spark, d, name).select(*[F.col(v).alias(k) for k, v in c.items()])
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    x = intervals.star(x, (rename("part", part="p_partkey", brand="p_brand"), ["part"]), (rename("supplier", supplier="s_suppkey", nation="s_nationkey"), ["supplier"]), (rename("orders", order="o_orderkey", status="o_orderstatus"), ["order"]), (rename("nation", nation="n_nationkey", nation_name="n_name"), ["nation"]))
    return x.select("order", "line", "brand", "nation_name", "status")


Q23 = 'SELECT l_orderkey AS "order", l_linenumber AS line, p_brand AS brand, n_name AS nation_name, o_orderstatus AS status FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN nation ON n_nationkey = s_nationkey'


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return x.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") / 10000).alias("size"), (F.col("lang") == "en").cast("int").alias("english"))


def q24_glm(spark: SparkSession, d: str) -> DataFrame:
    b = regression.fit_logistic(_labelled(spark, d), "y", ["size", "english"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in b.items()], "term string, coefficient double")


def _newton_sql(steps: int) -> str:
    """Newton steps of the logistic fit, each a CTE with the sums of its step and one with Cramer's solution of the three equations."""
    parts = ["x AS (SELECT quality::DOUBLE AS y, n_chars / 10000 AS u, CASE WHEN lang = 'en' THEN 1.0::DOUBLE WHEN lang IS NOT NULL THEN 0 END AS v FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL AND lang IS NOT NULL)", "b0 AS (SELECT 0::DOUBLE AS p, 0::DOUBLE AS q, 0::DOUBLE AS r)"]
    det = lambda *m: "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))".format(*m)
    rows = [["a", "b", "c"], ["b", "d", "e"], ["c", "e", "f"]]
    solved = []
    for i in range(3):
        m = [[g if j == i else row[j] for j in range(3)] for row, g in zip(rows, ("g", "h", "k"), strict=True)]
        solved.append(f"{det(*sum(m, []))} / {det(*sum(rows, []))}")
    for n in range(1, steps + 1):
        parts.append(f"m{n} AS (SELECT *, mu * (1 - mu) AS w FROM (SELECT x.*, b{n - 1}.*, 1 / (1 + exp(-(p + q * u + r * v))) AS mu FROM x CROSS JOIN b{n - 1}))")
        parts.append(f"s{n} AS (SELECT any_value(p) AS p, any_value(q) AS q, any_value(r) AS r, sum(w) AS a, sum(w * u) AS b, sum(w * v) AS c, sum(w * u * u) AS d, sum(w * u * v) AS e, sum(w * v * v) AS f, sum(y - mu) AS g, sum((y - mu) * u) AS h, sum((y - mu) * v) AS k FROM m{n})")
        parts.append(f"b{n} AS (SELECT p + {solved[0]} AS p, q + {solved[1]} AS q, r + {solved[2]} AS r FROM s{n})")
    return "WITH " + ", ".join(parts) + f" SELECT unnest(['intercept', 'size', 'english']) AS term, unnest([round(p, 6), round(q, 6), round(r, 6)]) AS coefficient FROM b{steps}"


Q24 = _newton_sql(9)


def q25_predict_fixed(spark: SparkSession, d: str) -> DataFrame:
    p = regression.predicted({"intercept": -0.5, "size": 1.25, "english": 0.75})
    x = _labelled(spark, d).withColumn("p", p)
    return x.select("doc_id", F.round("p", 8).alias("p"), regression.flagged(F.col("p"), 0.5).alias("flag"))


Q25 = "WITH x AS (SELECT doc_id, 1 / (1 + exp(-(-0.5::DOUBLE + 1.25::DOUBLE * (n_chars / 10000) + 0.75::DOUBLE * CASE WHEN lang = 'en' THEN 1 ELSE 0 END))) AS p FROM labels JOIN documents USING (doc_id)) SELECT doc_id, round(p, 8) AS p, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS flag FROM x"


def q26_bins(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_type", m.equal_bin(F.col("value"), 0.0, 200.0, 20).alias("bin"))
    return x.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))


Q26 = "SELECT event_type, least(greatest(floor(value / 10), 0), 19)::INT AS bin, count(*) AS n FROM events GROUP BY ALL"


def q27_percentiles(spark: SparkSession, d: str) -> DataFrame:
    x = compare.run_quantiles(table(spark, d, "part"), "p_retailprice", ["p_brand"])
    return x.select("p_brand", *[F.round(c, 6).alias(c) for c in ("p05", "p25", "p50", "p75", "p95", "mean")])


Q27 = "SELECT p_brand, " + ", ".join(f"round(quantile_cont(p_retailprice, {q}), 6) AS p{n}" for n, q in (("05", 0.05), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("95", 0.95))) + ", round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1"


def q28_best_per_group(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return intervals.best_per_group(x, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")])


Q28 = "SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1"


def q29_entropy(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_id", F.round(s.gc_share(F.col("seq")), 8).alias("gc"), F.round(s.base_entropy(F.col("seq")), 6).alias("entropy"))


Q29 = f"WITH {READS}, c AS (SELECT read_id, length(seq)::DOUBLE AS n, unnest([length(replace(seq, 'A', '')), length(replace(seq, 'C', '')), length(replace(seq, 'G', '')), length(replace(seq, 'T', ''))]) AS x FROM reads), e AS (SELECT read_id, sum(CASE WHEN x < n THEN -((n - x) / n) * log2((n - x) / n) ELSE 0 END) AS h FROM c GROUP BY 1) SELECT read_id, round(length(regexp_replace(seq, '[AT]', '', 'g')) / length(seq), 8) AS gc, round(h, 6) AS entropy FROM reads JOIN e USING (read_id)"


def q30_regression(spark: SparkSession, d: str) -> DataFrame:
    x = regression.linear(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return x.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 7).alias("r"), "n")


Q30 = "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 7) AS r, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1"


def q31_spearman(spark: SparkSession, d: str) -> DataFrame:
    x = regression.spearman(table(spark, d, "part"), "p_size", "p_retailprice", ["p_brand"])
    return x.select("p_brand", F.round("rho", 7).alias("rho"))


Q31 = "WITH r AS (SELECT p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS a, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2 AS b FROM part) SELECT p_brand, round(corr(a, b), 7) AS rho FROM r GROUP BY 1"


def q32_free_protein(spark: SparkSession, d: str) -> DataFrame:
    hist = fitting.z_histogram(_scores(spark, d), "total")
    return spark.createDataFrame([(float(t), round(float(fitting.free_protein(hist, t, 50.0)), 7)) for t in (1.0, 5.0, 25.0)], "total double, free double")


Q32 = f"WITH RECURSIVE {READS}, {_SCORE_SQL}, t AS (SELECT ln(least(sum(z), 1e6::DOUBLE)) AS l FROM st GROUP BY read_id HAVING sum(z) > 0), e AS (SELECT min(l) AS lo, max(l) AS hi FROM t), bn AS (SELECT CASE WHEN hi > lo THEN least(floor((l - lo) / ((hi - lo) / 1000)), 999) ELSE 0 END AS bin, avg(exp(l)) AS z, count(*) AS n FROM t CROSS JOIN e GROUP BY 1), h AS (SELECT list(struct_pack(z := z, s := n / (SELECT sum(n) FROM bn)) ORDER BY bin) AS h FROM bn), f AS (SELECT unnest([1.0::DOUBLE, 5.0, 25.0]) AS total, 0::DOUBLE AS lo, unnest([1.0::DOUBLE, 5.0, 25.0]) AS hi, 0 AS i UNION ALL SELECT total, CASE WHEN used > total THEN lo ELSE p END, CASE WHEN used > total THEN p ELSE hi END, i + 1 FROM (SELECT f.*, (lo + hi) / 2 AS p, (lo + hi) / 2 + 50 * list_sum(list_transform(h, lambda x: x.s * (lo + hi) / 2 * x.z / ((lo + hi) / 2 * x.z + 1))) AS used FROM f CROSS JOIN h WHERE i < 100)) SELECT total, round((lo + hi) / 2, 7) AS free FROM f WHERE i = 100"


def q33_ska(spark: SparkSession, d: str) -> DataFrame:
    one = s.all_kmers(spark, 3).withColumn("value", F.lit(1.0))
    start = reads(spark, d).select("lang").distinct().crossJoin(F.broadcast(one))
    background = _freq(spark, d).filter("lang = 'en'").select("kmer", F.col("freq").alias("value"))
    background = start.select("lang", "kmer").join(F.broadcast(background), "kmer")
    return enrichment.ska(reads(spark, d), start, background, 3, ["lang"]).select("lang", "kmer", F.round("weight", 4).alias("weight"))


def q34_descent(spark: SparkSession, d: str) -> DataFrame:
    """The motif fitted to the enrichment of all languages over English, on the English reads, until the error falls by less
    than a thousandth of the first one a step.
    """
    import numpy as np

    freq = written(_freq(spark, d), "frequencies")
    r = enrichment.ratios(freq.filter("lang != 'en'"), freq.filter("lang = 'en'"), "freq", "r").orderBy("lang", "kmer").select("lang", "r").collect()
    langs = sorted({x["lang"] for x in r})
    observed = np.array([[x["r"] for x in r if x["lang"] == lang] for lang in langs])
    f0 = np.array([x["freq"] for x in freq.filter("lang = 'en'").orderBy("kmer").collect()]) / 64
    model = fitting.Model([np.array(MOTIF)], np.array([0.1]), np.full(len(langs), 0.01))
    _, errors = fitting.descend(written(reads(spark, d).filter("lang = 'en'"), "reads"), model, [5.0] * len(langs), 100.0, 3, f0, observed, slope=1e-3)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(errors)], "step int, error double")


def q35_natural_sort(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").select("s_suppkey", F.regexp_replace("s_name", "^.*#0*", "chr").alias("chrom"))
    return numbered(x, [*s.natural_key(F.col("chrom")), F.col("s_suppkey")]).select("s_suppkey", "chrom", (F.col("number") + 1).alias("place"))


Q35 = "WITH x AS (SELECT s_suppkey, regexp_replace(s_name, '^.*#0*', 'chr') AS chrom FROM supplier) SELECT *, row_number() OVER (ORDER BY try_cast(regexp_extract(chrom, '[0-9]+') AS INT) NULLS LAST, chrom, s_suppkey) AS place FROM x"


def q36_set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    parts = (("all", c.unionByName(o)), ("except", c.join(o, "k", "left_anti")), ("intersect", c.join(o, "k", "left_semi")), ("distinct", o.dropDuplicates()))
    out = None
    for name, x in parts:
        x = x.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total")).select(F.lit(name).alias("what"), "n", "total")
        out = x if out is None else out.unionByName(x)
    return out


Q36 = "WITH c AS (SELECT c_custkey AS k FROM customer), o AS (SELECT o_custkey AS k FROM orders) SELECT 'all' AS what, count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT k FROM c UNION ALL SELECT k FROM o) UNION ALL SELECT 'except', count(*), sum(k)::BIGINT FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT 'intersect', count(*), sum(k)::BIGINT FROM c WHERE k IN (SELECT k FROM o) UNION ALL SELECT 'distinct', count(*), sum(k)::BIGINT FROM (SELECT DISTINCT k FROM o)"


def q37_scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part")
    return x.select("p_partkey", F.concat_ws("_", s.na(F.nullif(F.col("p_brand"), F.lit("Brand#11"))), s.na(F.col("p_size"))).alias("packed"), F.length("p_name").cast("long").alias("n"), F.regexp_count("p_type", F.lit("[AEIOU]")).cast("long").alias("vowels"), F.expr("substr(p_type, 1, length(p_type) - 4)").alias("cut"), F.round(F.log2("p_retailprice"), 8).alias("log"), F.round(F.asinh("p_size"), 8).alias("asinh"), F.md5("p_name").alias("digest"))


Q37 = "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#11'), 'NA') || '_' || p_size AS packed, length(p_name) AS n, length(regexp_replace(p_type, '[^AEIOU]', '', 'g')) AS vowels, substr(p_type, 1, length(p_type) - 4) AS cut, round(log2(p_retailprice), 8) AS log, round(asinh(p_size), 8) AS asinh, md5(p_name) AS digest FROM part"


def q38_ntile(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.chunks(reads(spark, d), 10).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("lo"), F.max("read_id").alias("hi")).withColumn("part", F.col("part").cast("long"))


Q38 = f"WITH {READS} SELECT part, count(*) AS n, min(read_id) AS lo, max(read_id) AS hi FROM (SELECT read_id, ntile(10) OVER (ORDER BY read_id) AS part FROM reads) GROUP BY 1"


def q39_information(spark: SparkSession, d: str) -> DataFrame:
    c = kmers.counts(reads(spark, d), 3, ["lang"])
    return enrichment.information(c.filter("lang != 'en'"), c.filter("lang = 'en'").drop("lang"), 3, ["lang"]).select("lang", "kmer", F.round("di", 8).alias("di"))


Q39 = f"WITH {READS}, {_kmer_sql(3)}, {_freq_sql(3)}, cc AS (SELECT lang, kmer, n::DOUBLE AS n, sum(n) OVER (PARTITION BY lang)::DOUBLE AS t FROM full_), j AS (SELECT a.lang, a.kmer, a.n AS x, b.n AS y, a.t AS tx, b.t AS ty FROM cc a JOIN cc b ON a.kmer = b.kmer AND b.lang = 'en' WHERE a.lang <> 'en') SELECT lang, kmer, CASE WHEN x > 0 AND y > 0 THEN round(tx / (tx + ty) * log2(x / tx / ((x + y) / (tx + ty) * (tx / (tx + ty)))) + ty / (tx + ty) * log2(y / ty / ((x + y) / (tx + ty) * (ty / (tx + ty)))), 8) WHEN x + y > 0 THEN '-inf'::DOUBLE END AS di FROM j"


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.ranked(kmers.counts(reads(spark, d), 4), "n").select("kmer", "rank")


def q40_recall(spark: SparkSession, d: str) -> DataFrame:
    return _shares(spark, d, kmers.best_hits(reads(spark, d), _ranks(spark, d), 4, ["lang"]), 4).withColumn("fraction", F.round("fraction", 8))


_RECALL_SQL = f"{_kmer_sql(4)}, rk AS (SELECT kmer, row_number() OVER (ORDER BY count(*) DESC, kmer DESC) AS rank FROM km GROUP BY 1), bh AS (SELECT lang, read_id, arg_min(km.kmer, rank) AS kmer FROM km JOIN rk USING (kmer) GROUP BY ALL), bn AS (SELECT lang, kmer, count(*) AS n FROM bh GROUP BY ALL), {_full_sql(4, 'bn')}"
Q40 = f"WITH {READS}, {_RECALL_SQL} SELECT lang, kmer, n, round(fraction, 8) AS fraction FROM x"

#: Candidates of which a pure read holds one.
PURE = ["TGCATG", "GCATGC", "AAAAAA", "CACACA"]


def q41_pure_reads(spark: SparkSession, d: str) -> DataFrame:
    return kmers.pure_reads(reads(spark, d), PURE, 6, ["lang"])


_PURE_SQL = f"{_kmer_sql(6)}, h AS (SELECT DISTINCT lang, read_id, kmer FROM km WHERE kmer IN ('TGCATG', 'GCATGC', 'AAAAAA', 'CACACA')), p AS (SELECT lang, read_id, min(kmer) AS kmer FROM h GROUP BY ALL HAVING count(*) = 1), pn AS (SELECT lang, kmer, count(*) AS n FROM p GROUP BY ALL)"
Q41 = f"WITH {READS}, {_PURE_SQL} SELECT * FROM pn"


def q42_until_threshold(spark: SparkSession, d: str) -> DataFrame:
    x = _r(spark, d, 4).withColumn("error", F.lit(0.05))
    parts = intervals.until(x, [F.desc("r"), F.desc("kmer")], F.col("r") - F.col("error") <= 1.1, 5, ["lang"])
    return parts.select("lang", "kmer", F.round("r", 8).alias("r"))


Q42 = f"WITH {READS}, {_kmer_sql(4)}, {_freq_sql(4)}, {_R_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r DESC, kmer DESC) AS k FROM rv), e AS (SELECT *, sum(CASE WHEN r - 0.05::DOUBLE <= 1.1::DOUBLE AND k > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT lang, kmer, round(r, 8) AS r FROM e WHERE s = 0"


def q43_diagnostic(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.diagnostic(_r(spark, d, 4), "lang").select("kmer", F.round("score", 8).alias("score"))


Q43 = f"WITH {READS}, {_kmer_sql(4)}, {_freq_sql(4)}, {_R_SQL}, t AS (SELECT DISTINCT kmer FROM (SELECT kmer, row_number() OVER (PARTITION BY lang ORDER BY r DESC, kmer DESC) AS k FROM rv) WHERE k = 1) SELECT kmer, round(min(r) * avg(CASE WHEN r > 1 THEN 1.0::DOUBLE ELSE 0 END), 8) AS score FROM rv WHERE kmer IN (SELECT kmer FROM t) GROUP BY 1"


def q44_median_ranking(spark: SparkSession, d: str) -> DataFrame:
    return enrichment.median_ranking(_r(spark, d, 3)).select("kmer", F.round("median", 8).alias("median"), F.col("rank").cast("long").alias("rank"))


Q44 = f"WITH {READS}, {_kmer_sql(3)}, {_freq_sql(3)}, {_R_SQL}, g AS (SELECT kmer, quantile_cont(r, 0.5) AS median FROM rv GROUP BY 1) SELECT kmer, round(median, 8) AS median, row_number() OVER (ORDER BY median DESC, kmer DESC) AS rank FROM g"


def q45_affinity_histogram(spark: SparkSession, d: str) -> DataFrame:
    x = _scores(spark, d).filter("total > 0").select(m.equal_bin(F.log10("total"), -4.0, 4.0, 32).alias("bin"), m.occupancy(F.col("total"), 0.1).alias("psi"))
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("psi"), 5).alias("bound"))


Q45 = f"WITH {READS}, {_SCORE_SQL}, t AS (SELECT read_id, sum(z) AS z FROM st GROUP BY 1) SELECT least(greatest(floor((log10(z) + 4) / 0.25), 0), 31)::INT AS bin, count(*) AS n, round(sum(z * 0.1::DOUBLE / (z * 0.1::DOUBLE + 1)), 5) AS bound FROM t WHERE z > 0 GROUP BY 1"


def q46_crosstalk(spark: SparkSession, d: str) -> DataFrame:
    return kmers.crosstalk(reads(spark, d), 3, 2)


Q46 = f"WITH {READS}, {_kmer_sql(3)}, k2 AS (SELECT read_id, i - 1 AS pos, substr(seq, i, 2) AS kmer FROM (SELECT *, unnest(generate_series(1, length(seq) - 1)) AS i FROM reads WHERE length(seq) >= 2)) SELECT km.kmer AS a, k2.kmer AS b, count(*) AS n FROM km JOIN k2 ON km.read_id = k2.read_id AND k2.pos BETWEEN km.pos - 3 AND km.pos + 3 GROUP BY ALL"


def q47_base_profile(spark: SparkSession, d: str) -> DataFrame:
    x = kmers.base_profile(reads(spark, d), ["lang"])
    return x.select("lang", F.col("pos").cast("long").alias("pos"), "base", "n", F.round("share", 8).alias("share"), F.round("entropy", 6).alias("entropy"))


Q47 = f"WITH {READS}, {_kmer_sql(1)}, c AS (SELECT lang, pos, kmer AS base, count(*) AS n FROM km GROUP BY ALL), x AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, pos) AS share FROM c) SELECT lang, pos, base, n, round(share, 8) AS share, round(sum(-share * log2(share)) OVER (PARTITION BY lang, pos), 6) AS entropy FROM x"


def q48_kmer_matrix(spark: SparkSession, d: str) -> DataFrame:
    x = _freq(spark, d).groupBy("kmer").pivot("lang", ["de", "en", "es", "fr"]).agg(F.round(F.first("freq"), 8))
    return x


Q48 = f"WITH {READS}, {_kmer_sql(3)}, {_freq_sql(3)} SELECT kmer, " + ", ".join(f"round(max(freq) FILTER (lang = '{x}'), 8) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM fr GROUP BY 1"


def q49_motif_seeds(spark: SparkSession, d: str) -> DataFrame:
    top = enrichment.ranked(_r(spark, d, 4).groupBy("kmer").agg(F.max("r").alias("r")), "r").filter("rank <= 20").select("kmer", "r").collect()
    found = seeding.describe(seeding.build([(r["kmer"], r["r"]) for r in top]))
    return spark.createDataFrame([(i, c, float(a)) for i, (c, a) in enumerate(found)], "motif int, consensus string, a0 double")


def q50_binned_information(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").select("p_size", "p_retailprice")
    x = compare.eq_bins(compare.eq_bins(x, "p_size", 5, "a"), "p_retailprice", 5, "b")
    return compare.binned_information(x, "a", "b", 5).select(F.round("mi", 8).alias("mi"))


Q50 = "WITH e AS (SELECT quantile_cont(p_size, [0.2, 0.4, 0.6, 0.8]) AS x, quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS y FROM part), b AS (SELECT len(list_filter(x, lambda q: q < p_size)) AS a, len(list_filter(y, lambda q: q < p_retailprice)) AS b FROM part CROSS JOIN e), g AS (SELECT i AS a, j AS b FROM range(5) AS s(i) CROSS JOIN range(5) AS t(j)), c AS (SELECT g.a, g.b, count(b.a) + 1 AS n FROM g LEFT JOIN b ON b.a = g.a AND b.b = g.b GROUP BY ALL), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM c) SELECT round(sum(p * log2(p / (pa * pb))), 8) AS mi FROM p"


def q51_liftover(spark: SparkSession, d: str) -> DataFrame:
    chain = table(spark, d, "nation").select(F.lit("chr1").alias("chrom"), (F.col("n_nationkey") * 1000).cast("long").alias("r_start"), (F.col("n_nationkey") * 1000 + 800).cast("long").alias("r_end"), F.lit("chr2").alias("to_chrom"), (F.col("n_nationkey") * 1100).cast("long").alias("to_start"), F.lit(100_000).cast("long").alias("to_size"), F.when(F.col("n_nationkey") % 3 == 0, "-").otherwise("+").alias("to_strand"))
    x = table(spark, d, "orders").select("o_orderkey", F.lit("chr1").alias("chrom"), (F.col("o_custkey") % 25_000).alias("start"), (F.col("o_custkey") % 25_000 + 1).alias("end"))
    return intervals.lifted(x, chain, "o_orderkey")


Q51 = "WITH n AS (SELECT n_nationkey AS k, n_nationkey * 1000 AS a, n_nationkey * 1000 + 800 AS b, n_nationkey * 1100 AS t, n_nationkey % 3 = 0 AS f FROM nation), x AS (SELECT o_orderkey, o_custkey % 25000 AS s FROM orders) SELECT o_orderkey, 'chr2' AS chrom, CASE WHEN f THEN 100000 - t - (s - a) - 1 ELSE t + s - a END AS start, CASE WHEN f THEN 100000 - t - (s - a) - 1 ELSE t + s - a END + 1 AS \"end\", f AS flipped FROM x JOIN n ON s >= a AND s + 1 <= b"


def q52_annotation(spark: SparkSession, d: str) -> DataFrame:
    """The annotation query over lines as variants and orders as isoforms."""
    variants = table(spark, d, "lineitem").select(F.concat(F.lit("chr"), F.col("l_suppkey") % 20).alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 1).alias("end"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.col("l_linenumber").cast("string").alias("id"))
    utr = table(spark, d, "orders").select(F.concat(F.lit("chr"), F.col("o_custkey") % 20).alias("chrom"), F.col("o_orderkey").alias("iso_start"), (F.col("o_orderkey") + 40).alias("iso_stop"), F.col("o_orderstatus").alias("gene"), F.lit(".").alias("score"), F.lit("+").alias("strand"), F.lit(4).cast("long").alias("number_isos"), (F.col("o_custkey") % 5 + 1).alias("iso_loc"), F.col("o_orderkey").alias("utr_start"), (F.col("o_orderkey") + 40).alias("utr_stop"))
    clinvar = table(spark, d, "customer").select(F.concat(F.lit("chr"), F.col("c_nationkey") % 20).alias("chrom"), (F.col("c_custkey") * 10).alias("r_start"), (F.col("c_custkey") * 10 + 5).alias("r_end"), F.col("c_mktsegment").alias("info"))
    one = annotate.single_nucleotide(variants.dropDuplicates(["chrom", "start"]))
    return annotate.annotate(one, annotate.Annotations(utr, clinvar=clinvar)).select("var_id", "APA_info", "PAS_info", "clinvar_info")


Q52 = "WITH v AS (SELECT DISTINCT l_suppkey % 20 AS c, l_orderkey AS s FROM lineitem), u AS (SELECT o_custkey % 20 AS c, o_orderkey AS a, o_orderkey + 40 AS b, o_orderstatus AS g, o_custkey % 5 + 1 AS l FROM orders), r AS (SELECT v.c, s, a, b, g, l FROM v JOIN u ON v.c = u.c AND s < b AND a < s + 1), k AS (SELECT c_nationkey % 20 AS c, c_custkey * 10 AS a, c_custkey * 10 + 5 AS b, c_mktsegment AS i FROM customer), h AS (SELECT v.c, v.s, string_agg(i, '|' ORDER BY k.a, k.b, i) AS i FROM v JOIN k ON v.c = k.c AND s < k.b AND k.a < s + 1 GROUP BY ALL) SELECT 'chr' || r.c || '_' || (r.s + 1) || '_A_G' AS var_id, g || '_+_' || l || '_4_' || CASE WHEN l / 4 <= 0.5 THEN 'common' WHEN l / 4 < 1 THEN 'partially_shared' WHEN l = 4 THEN 'unique' ELSE 'NA' END AS APA_info, CASE WHEN least(abs(r.s + 1 - a), abs(r.s + 1 - b)) <= 50 THEN 'PAS_proximal' ELSE '' END AS PAS_info, h.i AS clinvar_info FROM r LEFT JOIN h ON h.c = r.c AND h.s = r.s"


#: Coefficients of the two models of q60.
MODELS = {"eqtl": {"intercept": -2.5, "in_eclip": 0.75, "near_pas": 0.25, "in_mir": 0.5, "conserved": -0.5, "shared_region": -0.125}, "gwas": {"intercept": -5.0, "in_eclip": 0.25, "near_pas": 0.125, "in_mir": 1.0, "conserved": 0.5, "shared_region": -0.25}}


def _annotated(spark: SparkSession, d: str, collapse: bool) -> DataFrame:
    """Lines as variants (those that repeat, too), orders as isoforms, and every annotation table but genome and motifs."""
    chrom = lambda c: F.concat(F.lit("chr"), F.col(c) % 20).alias("chrom")
    span = lambda c, by, wide: [(F.col(c) * by).cast("long").alias("r_start"), (F.col(c) * by + wide).cast("long").alias("r_end")]
    t = lambda name, *cols: table(spark, d, name).select(*cols)
    variants = t("lineitem", chrom("l_suppkey"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + 1).alias("end"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.lit("x").alias("id"))
    utr = t("orders", chrom("o_custkey"), F.col("o_orderkey").alias("iso_start"), (F.col("o_orderkey") + 40).alias("iso_stop"), F.col("o_orderstatus").alias("gene"), F.lit(".").alias("score"), F.lit("+").alias("strand"), F.lit(4).cast("long").alias("number_isos"), (F.col("o_custkey") % 5 + 1).alias("iso_loc"), F.col("o_orderkey").alias("utr_start"), (F.col("o_orderkey") + 40).alias("utr_stop"))
    region = F.col("n_regionkey")
    tables = annotate.Annotations(
        utr,
        eclip=t("customer", chrom("c_nationkey"), *span("c_custkey", 10, 5), F.col("c_mktsegment").alias("rbp"), F.when(F.col("c_custkey") % 2 == 0, "K562").otherwise("HepG2").alias("cell")),
        eqtl=t("supplier", chrom("s_nationkey"), *span("s_suppkey", 50, 30), F.col("s_name").alias("info")),
        gwas=t("part", chrom("p_partkey"), *span("p_partkey", 7, 5), F.col("p_brand").alias("info")),
        clinvar=t("customer", chrom("c_custkey"), *span("c_custkey", 20, 15), F.col("c_mktsegment").alias("info")),
        mir_sites=t("supplier", chrom("s_suppkey"), *span("s_suppkey", 40, 20), F.concat(F.lit("mir"), F.col("s_nationkey")).alias("mergekey")),
        mir_predictions=table(spark, d, "nation").filter("n_nationkey < 20").select(F.concat(F.lit("mir"), F.col("n_nationkey")).alias("mergekey"), F.when(region > 0, F.concat(F.lit("fam"), region)).alias("family"), F.lit("8mer").alias("seed_match"), F.lit("0.5").alias("pct"), F.lit("+").alias("strand"), F.lit("-0.1").alias("context"), F.when(region == 1, "consFam").when(region == 2, "broadConsFam").otherwise("poor").alias("family_conserved"), F.lit("1").alias("site_conserved")),
        cadd=t("orders", chrom("o_custkey"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1).alias("end"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), F.col("o_orderstatus").alias("cadd_var_info")),
        conservation=t("orders", chrom("o_custkey"), (F.col("o_orderkey") + 1).alias("end"), ((F.col("o_custkey") % 10) / 10).alias("phastcons_100")),
        rep_sites=t("orders", chrom("o_orderkey"), (F.col("o_orderkey") + 1).alias("end"), F.col("o_orderstatus").alias("rep_info")),
        models=MODELS,
    )
    return annotate.annotate(annotate.single_nucleotide(variants), tables, collapse)


def q60_annotation_tables(spark: SparkSession, d: str) -> DataFrame:
    """The annotation with every table: a row for each variant and isoform, with all columns."""
    return _annotated(spark, d, False)


def _glm_sql(name: str, cut: float) -> str:
    p = " + ".join(f"{b} * {f}" for f, b in MODELS[name].items() if f != "intercept")
    return f"CASE WHEN 1 / (1 + exp(-({MODELS[name]['intercept']}::DOUBLE + {p}))) > {cut} THEN 1 WHEN ({p}) IS NOT NULL THEN 0 END"


def _hits_sql(source: str, chrom: str, start: str, wide: int, cells: str) -> str:
    return f"(SELECT r.rid, k.* FROM r JOIN (SELECT {chrom} % 20 AS kc, {start} AS ka, {start} + {wide} AS kb, {cells} FROM {source}) k ON kc = c AND s < kb AND ka < s + 1)"


_ANNOTATED_SQL = (
    "v AS (SELECT l_suppkey % 20 AS c, l_orderkey AS s FROM lineitem), u AS (SELECT o_custkey % 20 AS uc, o_orderkey AS a, o_orderkey + 40 AS b, o_orderstatus AS g, o_custkey % 5 + 1 AS l FROM orders), "
    "r AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM v JOIN u ON c = uc AND s < b AND a < s + 1), "
    f"ec AS (SELECT rid, string_agg(w, '__' ORDER BY rk, ka, kb, w) AS eclip_tot FROM {_hits_sql('customer', 'c_nationkey', 'c_custkey * 10', 5, 'c_custkey % 2 AS rk, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN $$_K562$$ ELSE $$_HepG2$$ END AS w')} GROUP BY 1), "
    f"eq AS (SELECT DISTINCT rid, w AS eqtl_info FROM {_hits_sql('supplier', 's_nationkey', 's_suppkey * 50', 30, 's_name AS w')}), "
    f"gw AS (SELECT rid, string_agg(w, '|' ORDER BY ka, kb, w) AS gwas_info FROM {_hits_sql('part', 'p_partkey', 'p_partkey * 7', 5, 'p_brand AS w')} GROUP BY 1), "
    f"cl AS (SELECT rid, string_agg(w, '|' ORDER BY ka, kb, w) AS clinvar_info FROM {_hits_sql('customer', 'c_custkey', 'c_custkey * 20', 15, 'c_mktsegment AS w')} GROUP BY 1), "
    "pr AS (SELECT 'mir' || n_nationkey AS mk, CASE WHEN n_regionkey > 0 THEN 'fam' || n_regionkey END AS fam, CASE n_regionkey WHEN 1 THEN 'consFam' WHEN 2 THEN 'broadConsFam' ELSE 'poor' END AS fc FROM nation WHERE n_nationkey < 20), "
    f"mi AS (SELECT rid, string_agg(w, '|' ORDER BY w) AS mir_info FROM (SELECT rid, CASE WHEN fam IS NULL THEN x.w || '__nonCons_family' ELSE x.w || '__' || fam || '__8mer__0.5__+__-0.1__' || fc || '__1' END AS w FROM (SELECT DISTINCT rid, w FROM {_hits_sql('supplier', 's_suppkey', 's_suppkey * 40', 20, '$$mir$$ || s_nationkey AS w')}) x LEFT JOIN pr ON mk = x.w) GROUP BY 1), "
    "ca AS (SELECT o_custkey % 20 AS oc, o_orderkey AS ok, o_orderstatus AS cadd_var_info, o_custkey % 10 / 10 AS phastcons_100 FROM orders), rp AS (SELECT o_orderkey % 20 AS oc, o_orderkey AS ok, o_orderstatus AS rep_info FROM orders), "
    "j AS (SELECT r.*, coalesce(eclip_tot, '') AS eclip_tot, eqtl_info, gwas_info, clinvar_info, mir_info, cadd_var_info, phastcons_100, rep_info, CASE WHEN l / 4 <= 0.5 THEN 'common' WHEN l / 4 < 1 THEN 'partially_shared' WHEN l = 4 THEN 'unique' END AS region, least(abs(s + 1 - a), abs(s + 1 - b)) AS pas FROM r LEFT JOIN ec USING (rid) LEFT JOIN eq USING (rid) LEFT JOIN gw USING (rid) LEFT JOIN cl USING (rid) LEFT JOIN mi USING (rid) LEFT JOIN ca ON ca.oc = c AND ca.ok = s LEFT JOIN rp ON rp.oc = c AND rp.ok = s), "
    "f AS (SELECT *, (eclip_tot <> '')::INT AS in_eclip, (pas <= 50)::INT AS near_pas, coalesce(regexp_matches(mir_info, 'consFam|broadConsFam'), false)::INT AS in_mir, (phastcons_100 > 0.5)::INT AS conserved, (region IN ('common', 'single'))::INT AS shared_region FROM j)"
)
_ANNOTATED_COLUMNS = f"'chr' || c || '_' || (s + 1) || '_A_G' AS var_id, cadd_var_info, phastcons_100, NULL::VARCHAR AS motif_RBPs, NULL::VARCHAR AS motif_cat, eclip_tot, eqtl_info, {_glm_sql('eqtl', 0.1)} AS pred_eqtl, gwas_info, {_glm_sql('gwas', 0.0075)} AS pred_gwas, g || '_+_' || l || '_4_' || coalesce(region, 'NA') AS APA_info, CASE WHEN pas <= 50 THEN 'PAS_proximal' ELSE '' END AS PAS_info, mir_info AS miR_info, clinvar_info, rep_info AS Rep_info"
Q60 = f"WITH {_ANNOTATED_SQL} SELECT {_ANNOTATED_COLUMNS} FROM f"


def q61_one_line_each(spark: SparkSession, d: str) -> DataFrame:
    return annotate.one_line_each(_annotated(spark, d, False)).select("var_id", "APA_info", "eqtl_info", "pred_eqtl", "miR_info", "clinvar_info")


_BARS = ", ".join(f"coalesce(array_to_string(list_sort(list_distinct(list({c}::VARCHAR) FILTER ({c} IS NOT NULL))), '|'), '') AS {c}" for c in ("APA_info", "eqtl_info", "pred_eqtl", "miR_info", "clinvar_info"))
Q61 = f"WITH {_ANNOTATED_SQL}, o AS (SELECT {_ANNOTATED_COLUMNS} FROM f) SELECT var_id, {_BARS} FROM o GROUP BY 1"


def q53_hull(spark: SparkSession, d: str) -> DataFrame:
    """Of each 3-mer how often it or one that differs in a base occurs."""
    x = kmers.counts(reads(spark, d), 3).select(F.explode(s.hull(F.col("kmer"), "ACGT")).alias("kmer"), "n")
    return x.groupBy("kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("near"))


Q53 = f"WITH {READS}, {_kmer_sql(3)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1), b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), k AS (SELECT x.b || y.b || z.b AS kmer FROM b x CROSS JOIN b y CROSS JOIN b z) SELECT k.kmer, sum(n)::BIGINT AS n, count(*) AS near FROM k JOIN c ON hamming(k.kmer, c.kmer) <= 1 GROUP BY 1"


def q54_kmer_index(spark: SparkSession, d: str) -> DataFrame:
    x = kmers.counts(reads(spark, d), 4).withColumn("index", s.kmer_index(F.col("kmer")))
    return x.select("kmer", "index", s.index_kmer(F.col("index"), 4, "acgu").alias("back"), "n")


Q54 = f"WITH {READS}, {_kmer_sql(4)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1) SELECT kmer, (strpos('ACGT', kmer[1]) - 1) * 64 + (strpos('ACGT', kmer[2]) - 1) * 16 + (strpos('ACGT', kmer[3]) - 1) * 4 + strpos('ACGT', kmer[4]) - 1 AS index, lower(replace(kmer, 'T', 'U')) AS back, n FROM c"


def _divergence(spark: SparkSession, d: str) -> DataFrame:
    f = kmers.flank_profile(reads(spark, d), "TGCA", 2, 6, ["lang"])
    return enrichment.flank_divergence(f.filter("lang = 'de'"), f.filter("lang = 'en'"), 4, 2)


def q55_flank_divergence(spark: SparkSession, d: str) -> DataFrame:
    return _divergence(spark, d).select(F.col("d").cast("long").alias("d"), "kmer", F.round("kl", 8).alias("kl"), F.round("log_ratio", 8).alias("log_ratio"))


_FLANK_SQL = "f AS (" + Q18.replace(f"{READS}, ", "") + "), al AS (SELECT x.b || y.b AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) x(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) y(b)), fl AS (SELECT o.d, l.lang, al.kmer, coalesce(f.n, 0) + 10 AS n FROM (SELECT DISTINCT d FROM f WHERE lang IN ('de', 'en')) o CROSS JOIN (VALUES ('de'), ('en')) l(lang) CROSS JOIN al LEFT JOIN f ON f.d = o.d AND f.lang = l.lang AND f.kmer = al.kmer), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, d) AS p FROM fl), kl AS (SELECT a.d, a.kmer, a.p * log2(a.p / b.p) AS kl, CASE WHEN a.d >= 4 OR a.d <= -2 THEN log2(a.p / b.p) ELSE 0 END AS log_ratio FROM sh a JOIN sh b ON a.d = b.d AND a.kmer = b.kmer AND a.lang = 'de' AND b.lang = 'en')"
Q55 = f"WITH {READS}, {_FLANK_SQL} SELECT d, kmer, round(kl, 8) AS kl, round(log_ratio, 8) AS log_ratio FROM kl"


def q56_interactors(spark: SparkSession, d: str) -> DataFrame:
    """The k-mers that differ most round the core, and the divergence by offset."""
    x = _divergence(spark, d)
    tops = enrichment.top_interactors(x, 5).select(F.lit("kmer").alias("what"), "kmer", F.lit(None).cast("long").alias("d"), F.round("kl", 8).alias("kl"))
    places = enrichment.divergence_by_offset(x, 4, 2).select(F.lit("offset").alias("what"), F.lit(None).cast("string").alias("kmer"), F.col("d").cast("long").alias("d"), F.round("kl", 7).alias("kl"))
    return tops.unionByName(places)


Q56 = f"WITH {READS}, {_FLANK_SQL} SELECT * FROM (SELECT 'kmer' AS what, kmer, NULL::BIGINT AS d, round(max(kl), 8) AS kl FROM kl GROUP BY kmer ORDER BY max(kl) DESC, kmer DESC LIMIT 5) UNION ALL SELECT 'offset', NULL, d, CASE WHEN d >= 4 OR d <= -2 THEN round(sum(kl), 7) ELSE 0 END FROM kl GROUP BY d"


def q57_recall_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Ratios over English of recall and of pure reads."""
    recall = _shares(spark, d, kmers.best_hits(reads(spark, d), _ranks(spark, d), 4, ["lang"]), 4)
    pure = _shares(spark, d, kmers.pure_reads(reads(spark, d), PURE, 6, ["lang"]), 6).filter(F.col("kmer").isin(PURE))
    out = None
    for what, x in (("recall", recall), ("pure", pure)):
        x = enrichment.ratios(x.filter("lang != 'en'"), x.filter("lang = 'en'"), "fraction", "ratio").select(F.lit(what).alias("what"), "lang", "kmer", F.round("ratio", 8).alias("ratio"))
        out = x if out is None else out.unionByName(x)
    return out


_RATIO_SQL = "SELECT '{what}' AS what, a.lang, a.kmer, round(a.fraction / b.fraction, 8) AS ratio FROM x a JOIN x b ON a.kmer = b.kmer AND b.lang = 'en' WHERE a.lang <> 'en'"
Q57 = f"WITH {READS}, ra AS (WITH {_RECALL_SQL} {_RATIO_SQL.format(what='recall')}), rb AS (WITH {_PURE_SQL}, {_full_sql(6, 'pn')} {_RATIO_SQL.format(what='pure')} AND a.kmer IN ('TGCATG', 'GCATGC', 'AAAAAA', 'CACACA')) SELECT * FROM ra UNION ALL SELECT * FROM rb"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """R by language with an error: its deviation over ten parts of the reads."""
    r = enrichment.chunks(reads(spark, d), 10)
    f = kmers.frequencies(kmers.counts(r, 3, ["lang", "part"]), 3, ["lang", "part"])
    x = enrichment.ratios(f.filter("lang != 'en'"), f.filter("lang = 'en'").drop("lang"), "freq", "r", ["part", "kmer"])
    return x.groupBy("lang", "kmer").agg(F.avg("r").alias("r"), F.stddev_pop("r").alias("error"))


def q58_significant(spark: SparkSession, d: str) -> DataFrame:
    x = enrichment.significant(_parts(spark, d), "lang", "r", "error", 1.0, 1, 20)
    return x.select("kmer", F.round("z", 6).alias("z"), F.col("rank").cast("long").alias("rank"))


_PART_SQL = f"pt AS (SELECT lang, read_id, seq, ntile(10) OVER (ORDER BY read_id) AS part FROM reads), km AS (SELECT lang, part, substr(seq, i, 3) AS kmer FROM (SELECT *, unnest(generate_series(1, length(seq) - 2)) AS i FROM pt WHERE length(seq) >= 3)), c AS (SELECT lang, part, kmer, count(*) AS n FROM km GROUP BY ALL), al AS (SELECT x.b || y.b || z.b AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) x(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) y(b) CROSS JOIN (VALUES ('A'), ('C'), ('G'), ('T')) z(b)), fl AS (SELECT l.lang, l.part, al.kmer, coalesce(c.n, 0) + 10 AS n FROM (SELECT DISTINCT lang, part FROM c) l CROSS JOIN al LEFT JOIN c ON c.lang = l.lang AND c.part = l.part AND c.kmer = al.kmer), fr AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, part) * 64 AS freq FROM fl), rp AS (SELECT a.lang, a.kmer, a.freq / b.freq AS r FROM fr a JOIN fr b ON a.part = b.part AND a.kmer = b.kmer AND b.lang = 'en' WHERE a.lang <> 'en'), rv AS (SELECT lang, kmer, avg(r) AS r, stddev_pop(r) AS error FROM rp GROUP BY ALL)"
Q58 = f"WITH {READS}, {_PART_SQL}, z AS (SELECT kmer, avg((greatest(r - error, 0) - m) / s) AS z FROM (SELECT *, avg(r) OVER (PARTITION BY lang) AS m, stddev_pop(r) OVER (PARTITION BY lang) AS s FROM rv) GROUP BY 1), k AS (SELECT kmer, z, row_number() OVER (ORDER BY z DESC, kmer DESC) AS rank FROM z) SELECT kmer, round(z, 6) AS z, rank FROM k WHERE (z >= 1 OR rank <= 1) AND rank <= 20"


def q59_seeds(spark: SparkSession, d: str) -> DataFrame:
    x = enrichment.seeds(_parts(spark, d), z_cut=1.0)
    return x.select("kmer", F.round("r", 7).alias("r"), F.round("error", 7).alias("error"), F.col("rank").cast("long").alias("rank"))


Q59 = f"WITH {READS}, {_PART_SQL}, m AS (SELECT kmer, avg(r) AS m, avg(error) AS error FROM rv GROUP BY 1), q AS (SELECT quantile_cont(m, 0.05) AS q FROM m), co AS (SELECT kmer, error, m + q * (m - 1) / (1 - q) AS r FROM m CROSS JOIN q), z AS (SELECT *, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS z, row_number() OVER (ORDER BY r DESC, kmer DESC) AS rank FROM co), t AS (SELECT greatest(1, coalesce(max(r) FILTER (z < 1), max(r))) AS cut FROM z), e AS (SELECT min(rank) AS stop FROM z CROSS JOIN t WHERE r - error <= cut AND rank > 11) SELECT kmer, round(r, 7) AS r, round(error, 7) AS error, rank FROM z CROSS JOIN e WHERE stop IS NULL OR rank < stop"

def _training(spark: SparkSession, d: str) -> DataFrame:
    variants = table(spark, d, "customer").select(F.concat(F.lit("g"), F.col("c_nationkey")).alias("gene"), F.concat(F.lit("v"), F.col("c_custkey")).alias("var_info"), F.concat(F.lit("b"), F.col("c_custkey")).alias("base_id"), F.lit("A").alias("ref"), F.lit("G").alias("alt"), (F.col("c_custkey") * 10).alias("start"), (F.col("c_custkey") * 10 + 1).alias("end"), (F.col("c_custkey") % 10 / 10).alias("phastcons_100"), (F.col("c_custkey") * 37 % 1001 / 1000).alias("pip"), F.when(F.col("c_custkey") % 3 > 0, "x").otherwise("").alias("eclip_tot"))
    isoforms = table(spark, d, "nation").filter("n_nationkey < 22").select(F.concat(F.lit("g"), F.col("n_nationkey")).alias("gene"), (F.col("n_regionkey") + 1).alias("number_isos"), (F.col("n_nationkey") * 100).alias("utr_start"), (F.col("n_nationkey") * 100 + 500).alias("utr_stop"))
    places = table(spark, d, "orders").select(F.concat(F.lit("v"), F.col("o_custkey"), F.lit("_A_G")).alias("variant"), (F.col("o_orderkey") % 5 + 1).alias("iso_loc"), (F.col("o_custkey") * 10 - 70).alias("iso_start"), (F.col("o_custkey") * 10 + F.col("o_orderkey") % 100).alias("iso_stop"))
    sites = variants.filter(F.col("start") % 70 == 0).select(F.concat("base_id", F.lit("_A_G")).alias("var_id"))
    return training.eqtl_features(variants, isoforms, places, sites)


def q62_training_eqtl(spark: SparkSession, d: str) -> DataFrame:
    x = training.selected(_training(spark, d))
    return x.select("var_id", "iso_loc", "dvp", "between", "pas", "stop_distance", "utr_length", *training.TERMS, "label")


_TRAINING_SQL = (
    "tv AS (SELECT 'g' || c_nationkey AS gene, c_custkey AS c, c_custkey % 10 / 10 AS ph, c_custkey * 37 % 1001 / 1000 AS pip, c_custkey % 3 > 0 AS ecl FROM customer), ti AS (SELECT DISTINCT 'g' || n_nationkey AS gene, n_regionkey + 1 AS number_isos, 500::INTEGER AS utr_length, n_nationkey * 100 AS us FROM nation WHERE n_nationkey < 22), "
    "tp AS (SELECT DISTINCT o_custkey AS c, (o_orderkey % 5 + 1)::DOUBLE AS iso_loc, o_custkey * 10 - 70 AS a, o_custkey * 10 + o_orderkey % 100 AS b FROM orders), "
    "tf AS (SELECT 'b' || c || '_A_G' AS var_id, iso_loc, iso_loc / number_isos AS dvp, CASE WHEN iso_loc / number_isos <= 1 THEN b - a END AS \"between\", CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(abs(c * 10 + 1 - a), abs(c * 10 + 1 - b)) END AS pas, abs(c * 10 - us) AS stop_distance, utr_length, ecl::INT AS in_eclip, CASE WHEN c * 10 % 70 = 0 THEN 1 ELSE 0 END AS in_mir, (ph > 0.5)::INT AS conserved, (number_isos = 1 OR iso_loc / number_isos <= 0.5)::INT AS shared_region, number_isos, (pip >= 0.5)::INT AS label, pip FROM tv LEFT JOIN ti USING (gene) LEFT JOIN tp USING (c)), "
    "ts AS (SELECT * EXCLUDE (pip), (pas <= 50)::INT AS near_pas FROM tf WHERE (pip > 0.95 OR pip < 0.001) AND pas IS NOT NULL AND shared_region IS NOT NULL AND number_isos IS NOT NULL)"
)
Q62 = f"WITH {_TRAINING_SQL} SELECT var_id, iso_loc, dvp, \"between\", pas, stop_distance, utr_length, in_eclip, near_pas, in_mir, conserved, shared_region, number_isos, label FROM ts"


def q63_training_gwas(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda *parts: F.concat_ws("_", *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    rows = table(spark, d, "part").select(text("a", "b", "c", (k % 4 + 1).cast("string"), F.when(k % 9 == 0, "none").otherwise((k % 6 + 1).cast("string")), "f", (k * 10).cast("string"), (k * 10 + k % 700).cast("string")).alias("utr_info"), F.concat(F.lit("b"), k).alias("base_id"), F.lit("C").alias("ref"), F.lit("T").alias("alt"), (k * 10 + 3).alias("start"), (k * 10 + 4).alias("end"), (k * 10 - k % 90).alias("iso_start"), (k * 10 + 60).alias("iso_stop"), F.when(k % 5 > 0, text("c", "1", "2", "m", "p", "x", F.when(k % 2 == 0, "consFam").otherwise("poor"), "s")).alias("site_info"), (k % 10 / 10).alias("phastcons_100"), (k * 37 % 1001 / 1000).alias("pip"), F.when(k % 3 > 0, "x").otherwise("").alias("eclip_tot"))
    x = training.gwas_features(rows)
    return x.select("var_id", "iso_loc", "dvp", "between", "pas", "stop_distance", "utr_length", *training.TERMS, "label")


Q63 = "WITH p AS (SELECT p_partkey AS k, (p_partkey % 4 + 1)::DOUBLE AS n, CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 6 + 1)::DOUBLE END AS l FROM part) SELECT 'b' || k || '_C_T' AS var_id, l AS iso_loc, CASE WHEN l / n <= 1 THEN l / n END AS dvp, CASE WHEN l / n <= 1 THEN 60 + k % 90 END AS \"between\", least(abs(4 + k % 90), 56)::BIGINT AS pas, 3::DOUBLE AS stop_distance, (k % 700)::DOUBLE AS utr_length, (k % 3 > 0)::INT AS in_eclip, (least(4 + k % 90, 56) <= 50)::INT AS near_pas, CASE WHEN k % 5 > 0 AND k % 2 = 0 THEN 1 ELSE 0 END AS in_mir, (k % 10 / 10 > 0.5)::INT AS conserved, (n = 1 OR CASE WHEN l / n <= 1 THEN l / n END <= 0.5)::INT AS shared_region, n AS number_isos, (k * 37 % 1001 / 1000 >= 0.5)::INT AS label FROM p"


def q64_index_rows(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d)
    x = kmers.index_rows(r, 4).select("read_id", F.md5(F.array_join("index", ",")).alias("indices"))
    y = kmers.presence(r, "TGCA").select("read_id", F.size("present").cast("long").alias("places"), F.size(F.filter("present", lambda p: p)).cast("long").alias("hits"))
    return x.join(y, "read_id").filter("places > 0")


Q64 = f"WITH {READS}, {_kmer_sql(4)} SELECT read_id, md5(string_agg((strpos('ACGT', kmer[1]) - 1) * 64 + (strpos('ACGT', kmer[2]) - 1) * 16 + (strpos('ACGT', kmer[3]) - 1) * 4 + strpos('ACGT', kmer[4]) - 1, ',' ORDER BY pos)) AS indices, count(*) AS places, count(*) FILTER (kmer = 'TGCA') AS hits FROM km GROUP BY 1"


def q65_joined_counts(spark: SparkSession, d: str) -> DataFrame:
    c = kmers.counts(reads(spark, d), 5, ["lang"])
    return kmers.joined_counts([c.filter(F.col("lang") == x) for x in ("de", "en", "es", "fr")], ["de", "en", "es", "fr"])


Q65 = f"WITH {READS}, {_kmer_sql(5)} SELECT * FROM (SELECT kmer, " + ", ".join(f"count(*) FILTER (lang = '{x}') AS {x}" for x in ("de", "en", "es", "fr")) + " FROM km GROUP BY 1) WHERE de > 0 AND en > 0 AND es > 0 AND fr > 0"


def q66_trailing_slope(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    slope = m.trailing_slope(F.col("o_totalprice"), F.col("place"), ["o_orderkey"], 5, "o_custkey")
    return x.select("o_orderkey", F.round(slope, 4).alias("slope")).filter("slope is not null")


Q66 = "WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders) SELECT o_orderkey, round(regr_slope(o_totalprice, place) OVER w, 4) AS slope FROM x WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 4 PRECEDING) QUALIFY count(*) OVER w = 5"


def q67_kmer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Of all k-mers of the texts: sum score and product affinity of a motif, Boltzmann weight and Kd of the affinity."""
    x = kmers.counts(reads(spark, d), 4).select("kmer").withColumns({"score": psam.kmer_score_column(F.col("kmer"), MOTIF, 0.5), "affinity": psam.window_score(F.col("kmer"), MOTIF) * 0.5})
    energy = -F.log(F.col("affinity") * 1e9)
    return x.select("kmer", F.round("score", 8).alias("score"), F.round("affinity", 10).alias("affinity"), F.round(m.boltzmann(energy, 320.0), 6).alias("weight"), F.round(simulate.kd(energy), 6).alias("kd"))


Q67 = f"WITH {READS}, {_kmer_sql(4)}, k AS (SELECT DISTINCT kmer FROM km), s AS (SELECT kmer, 0.5::DOUBLE * (" + " + ".join(_base_sql(f"kmer[{i + 1}]", row) for i, row in enumerate(MOTIF)) + ") AS score, 0.5::DOUBLE * " + " * ".join(_base_sql(f"kmer[{i + 1}]", row) for i, row in enumerate(MOTIF)) + " AS affinity FROM k) SELECT kmer, round(score, 8) AS score, round(affinity, 10) AS affinity, round(affinity * 320, 6) AS weight, round(1 / affinity, 6) AS kd FROM s"


def _accessible(spark: SparkSession, d: str) -> DataFrame:
    """The reads with an accessibility for each base, by the base."""
    value = lambda b: F.when(b == "A", 0.125).when(b == "C", 0.25).when(b == "G", 0.5).otherwise(0.75)
    return reads(spark, d).withColumn("acc", F.transform(F.split("seq", ""), value))


def q68_weighted_ratios(spark: SparkSession, d: str) -> DataFrame:
    r = written(_accessible(spark, d), "accessible")
    c = kmers.accessibility_weighted(r, 3, ["lang"])
    n = r.groupBy("lang").agg(F.count(F.lit(1)).alias("reads"))
    x = kmers.weighted_ratios(c.filter("lang != 'en'"), c.filter("lang = 'en'"), n.filter("lang != 'en'"), r.filter("lang = 'en'").count(), 3, ["lang"])
    return x.select("lang", "kmer", F.round("w", 8).alias("w"))


_ACC_SQL = "CASE {b} WHEN 'A' THEN 0.125::DOUBLE WHEN 'C' THEN 0.25 WHEN 'G' THEN 0.5 ELSE 0.75 END"
Q68 = f"WITH {READS}, {_kmer_sql(3)}, {_freq_sql(3)}, w AS (SELECT lang, kmer, sum({_ACC_SQL.format(b='kmer[1]')}) AS w FROM km GROUP BY ALL), t AS (SELECT lang, count(*) AS t FROM reads GROUP BY 1), v AS (SELECT t.lang, al.kmer, (coalesce(w, 0) + 1) / t AS v FROM t CROSS JOIN al LEFT JOIN w ON w.lang = t.lang AND w.kmer = al.kmer) SELECT a.lang, a.kmer, round(a.v / b.v, 8) AS w FROM v a JOIN v b ON a.kmer = b.kmer AND b.lang = 'en' WHERE a.lang <> 'en'"


def q69_accessibility(spark: SparkSession, d: str) -> DataFrame:
    """Accessibility at the places of k-mers in bins, and round one k-mer by offset."""
    r = _accessible(spark, d)
    bins = kmers.binned_accessibility(r, 2, 4).select(F.lit("bin").alias("what"), "kmer", F.col("bin").cast("long").alias("at"), "n", F.lit(None).cast("double").alias("mean"))
    near = kmers.accessibility_profile(r, "TGCA", 3).select(F.lit("offset").alias("what"), F.lit("TGCA").alias("kmer"), F.col("d").cast("long").alias("at"), "n", F.round("mean", 8).alias("mean"))
    return bins.unionByName(near)


Q69 = f"WITH {READS}, {_kmer_sql(2)}, k4 AS (SELECT read_id, i - 1 AS pos FROM (SELECT *, unnest(generate_series(1, length(seq) - 3)) AS i FROM reads WHERE length(seq) >= 4) WHERE substr(seq, i, 4) = 'TGCA'), k1 AS (SELECT read_id, i - 1 AS pos, {_ACC_SQL.format(b='substr(seq, i, 1)')} AS acc FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM reads)) SELECT 'bin' AS what, kmer, least(floor({_ACC_SQL.format(b='kmer[1]')} * 4), 3)::BIGINT AS at, count(*) AS n, NULL::DOUBLE AS mean FROM km GROUP BY ALL UNION ALL SELECT 'offset', 'TGCA', (k1.pos - k4.pos)::BIGINT, count(*), round(avg(acc), 8) FROM k4 JOIN k1 ON k1.read_id = k4.read_id AND k1.pos BETWEEN k4.pos - 3 AND k4.pos + 6 GROUP BY 3"


def q70_reads_with_set(spark: SparkSession, d: str) -> DataFrame:
    """Reads with any of some k-mers and their share, hits of one k-mer by read as a histogram, values in digits."""
    r = reads(spark, d)
    some = kmers.reads_with_any(r, ["TGCA", "AAAA"], ["lang"]).select(F.lit("any").alias("what"), "lang", F.lit(None).cast("long").alias("hits"), "n")
    hist = kmers.hits_per_read(r, "TGCA").join(r.select("read_id", "lang"), "read_id").groupBy("lang", F.col("hits").cast("long").alias("hits")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("hits").alias("what"), "lang", "hits", "n")
    return some.unionByName(hist)


Q70 = f"WITH {READS}, {_kmer_sql(4)}, h AS (SELECT r.read_id, r.lang, count(*) FILTER (km.kmer = 'TGCA') AS hits FROM reads r LEFT JOIN km ON km.read_id = r.read_id GROUP BY ALL) SELECT 'any' AS what, lang, NULL::BIGINT AS hits, count(DISTINCT read_id) AS n FROM km WHERE kmer IN ('TGCA', 'AAAA') GROUP BY lang UNION ALL SELECT 'hits', lang, hits, count(*) FROM h GROUP BY ALL"


def q71_counts_by_read(spark: SparkSession, d: str) -> DataFrame:
    """How many reads have a k-mer more than once, and how often."""
    c = kmers.counts_per_read(reads(spark, d), 3).filter("n > 1")
    return c.groupBy("kmer").agg(F.count(F.lit(1)).alias("reads"), F.sum("n").alias("n"), F.max("n").alias("most"))


Q71 = f"WITH {READS}, {_kmer_sql(3)}, c AS (SELECT read_id, kmer, count(*) AS n FROM km GROUP BY ALL HAVING count(*) > 1) SELECT kmer, count(*) AS reads, sum(n)::BIGINT AS n, max(n) AS most FROM c GROUP BY 1"


def q72_pads_and_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Reads between adapters, counted by k-mer; each k-mer's longer neighbours; shares extrapolated by a chain."""
    r = reads(spark, d).withColumn("seq", s.padded(F.col("seq"), "GGGACCT", "TTGCACC", 3))
    c = kmers.counts(r, 3)
    near = c.select(F.col("kmer").alias("from"), "n", F.explode(s.expanded(F.col("kmer"), "ACGT")).alias("kmer"))
    return near.groupBy("kmer").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("n"))


Q72 = f"WITH {READS.replace('SELECT doc_id AS read_id, lang, seq FROM', 'SELECT doc_id AS read_id, lang, $$CT$$ || seq || $$TT$$ AS seq FROM')}, {_kmer_sql(3)}, c AS (SELECT kmer, count(*) AS n FROM km GROUP BY 1), b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), e AS (SELECT b || kmer AS kmer, n FROM c CROSS JOIN b UNION ALL SELECT kmer || b, n FROM c CROSS JOIN b) SELECT kmer, count(*) AS sources, sum(n)::BIGINT AS n FROM e GROUP BY 1"


def q73_markov(spark: SparkSession, d: str) -> DataFrame:
    """Shares of 4-mers extrapolated from those of 2- and 3-mers."""
    r = reads(spark, d)
    x = kmers.markov_frequencies(written(kmers.counts(r, 2), "short"), kmers.counts(r, 3), 4)
    return x.select("kmer", F.round("freq", 10).alias("freq"))


Q73 = f"WITH {READS}, k2 AS (WITH {_kmer_sql(2)} SELECT kmer, count(*) AS n FROM km GROUP BY 1), k3 AS (WITH {_kmer_sql(3)} SELECT kmer, count(*) AS n FROM km GROUP BY 1), st AS (SELECT kmer, n / (SELECT sum(n) FROM k2) AS f FROM k2), tr AS (SELECT substr(kmer, 1, 2) AS k, substr(kmer, 3, 1) AS b, n / sum(n) OVER (PARTITION BY substr(kmer, 1, 2)) AS p FROM k3), s3 AS (SELECT kmer || b AS kmer, f * p AS f FROM st JOIN tr ON tr.k = kmer) SELECT kmer || b AS kmer, round(f * p, 10) AS freq FROM s3 JOIN tr ON tr.k = substr(kmer, 2, 2)"

QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "q" and k[1:3].isdigit()}
ORACLE_SQL = {k: globals()[k[:3].upper()] for k in QUERIES if k[:3].upper() in globals()}
