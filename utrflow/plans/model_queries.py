"""Queries of the binding models: structure, two sites, mean field, footprints, free protein, codebooks, curves, densities.

A base's accessibility stands for what folding would give: by its letter and its place (a period of five).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utrflow.operators import density, descent, discretise, fitting, footprints, kmers, meanfield, nonlinear, protein, structure
from utrflow.plans.queries import MOTIF, READS, _base_sql, _kmer_sql, reads, table
from utrflow.plans.storage import written

#: A second motif, the adapters on either side of a read, and what a distance between two sites costs.
SECOND = [[0.1, 0.2, 1.0, 0.3], [1.0, 0.4, 0.05, 0.2], [0.3, 1.0, 0.2, 0.6], [0.05, 0.1, 0.4, 1.0]]
LEFT, RIGHT = "GATTAC", "CCGGTT"
COSTS = [0.0, 0.0, 0.0, 0.8, 0.6, 0.4, 0.2, 0.1]


def _motif(weights: list[list[float]], **more) -> structure.Motif:
    return structure.Motif(tuple(map(tuple, weights)), **more)


def _open(seq: Column) -> Column:
    """An accessibility for each base of a sequence."""
    by_letter = lambda b: F.when(b == "A", 0.4).when(b == "C", 0.2).when(b == "G", 0.3).otherwise(0.5)
    return F.transform(F.split(seq, ""), lambda b, i: by_letter(b) + (i % 5) / 10)


def _open_sql(base: str, place: str) -> str:
    return f"(CASE {base} WHEN 'A' THEN 0.4::DOUBLE WHEN 'C' THEN 0.2::DOUBLE WHEN 'G' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END + ({place}) % 5 / 10::DOUBLE)"


def _pairs(acc: Column) -> Column:
    """Accessibilities of windows of two bases."""
    return F.zip_with(F.slice(acc, F.lit(1), F.size(acc) - 1), F.slice(acc, F.lit(2), F.size(acc) - 1), lambda x, y: x * y)


def _site_sql(text: str, at: str, weights: list[list[float]]) -> str:
    return " * ".join(_base_sql(f"substr({text}, {at} + {k}, 1)", row) for k, row in enumerate(weights))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    """The reads with the accessibilities of the whole molecule's bases and pairs of bases."""
    x = reads(spark, d).withColumn("one", _open(F.concat(F.lit(LEFT), "seq", F.lit(RIGHT))))
    return x.withColumn("two", _pairs(F.col("one")))


def q74_structure(spark: SparkSession, d: str) -> DataFrame:
    """Two motifs over the padded reads, one of which asks for two open bases before its site, to the power of 0.5."""
    motifs = [_motif(MOTIF, a0=2.0, acc="two", shift=-2, scale=0.5), _motif(SECOND, a0=1.0, acc="one", shift=1)]
    x = structure.with_totals(structure.with_sites(_whole(spark, d), motifs, 0.001, LEFT, RIGHT, keep=["read_id"]))
    return x.select("read_id", F.round("z", 7).alias("z"), F.round("best", 8).alias("best"), F.size("z_sites").cast("long").alias("places"))


# place i (from 0) of the padded read begins at place 3 + i of the whole molecule, whose text is t
_MOLECULE = f"w AS (SELECT read_id, '{LEFT}' || seq || '{RIGHT}' AS t FROM reads), p AS (SELECT *, unnest(generate_series(0, length(t) - 10)) AS i FROM w), o AS (SELECT read_id, j, {_open_sql('substr(t, j + 1, 1)', 'j')} AS one FROM (SELECT *, unnest(generate_series(0, length(t) - 1)) AS j FROM w))"
Q74 = f"WITH {READS}, {_MOLECULE}, s AS (SELECT read_id, i, {_site_sql('t', 'i + 4', MOTIF)} + 0.001::DOUBLE AS a, {_site_sql('t', 'i + 4', SECOND)} + 0.001::DOUBLE AS b FROM p), z AS (SELECT s.read_id, s.i, a * coalesce(sqrt(x.one * y.one), 0) + b * coalesce(v.one, 0) * 0.5::DOUBLE AS z FROM s LEFT JOIN o x ON x.read_id = s.read_id AND x.j = s.i + 1 LEFT JOIN o y ON y.read_id = s.read_id AND y.j = s.i + 2 LEFT JOIN o v ON v.read_id = s.read_id AND v.j = s.i + 4) SELECT read_id, round(least(sum(z), 1e6), 7) AS z, round(max(z), 8) AS best, count(*) AS places FROM z GROUP BY 1"


def _two(spark: SparkSession, d: str) -> DataFrame:
    x = reads(spark, d).withColumn("one", _open(F.col("seq")))
    return structure.with_sites(x, [_motif(MOTIF, acc="one"), _motif(SECOND, acc="one")], split=True, keep=["read_id", "seq"])


_TWO_SQL = f"k AS (SELECT read_id, i - 1 AS i, {_site_sql('seq', 'i', MOTIF)} * {_open_sql('substr(seq, i, 1)', 'i - 1')} AS a, {_site_sql('seq', 'i', SECOND)} * {_open_sql('substr(seq, i, 1)', 'i - 1')} AS b FROM (SELECT *, unnest(generate_series(1, length(seq) - 3)) AS i FROM reads WHERE length(seq) >= 4))"


def q75_two_site(spark: SparkSession, d: str) -> DataFrame:
    """Each read's sum over both motifs' sites and their pairs up to eight places apart."""
    x = structure.two_site_totals(_two(spark, d).filter("length(seq) >= 4"), "z_sites_0", "z_sites_1", COSTS, ["read_id"])
    return x.select("read_id", F.round("z", 7).alias("z"))


_LAGS = " + ".join(f"{cost}::DOUBLE * coalesce(lag(a, {d + 1}) OVER w, 0)" for d, cost in enumerate(COSTS))
Q75 = f"WITH {READS}, {_TWO_SQL}, p AS (SELECT read_id, a + b + b * ({_LAGS}) AS z FROM k WINDOW w AS (PARTITION BY read_id ORDER BY i)) SELECT read_id, round(sum(z), 7) AS z FROM p GROUP BY 1"


def q76_spacing(spark: SparkSession, d: str) -> DataFrame:
    x = structure.spacing_profile(_two(spark, d), "z_sites_0", "z_sites_1", 4, 4, 10)
    return x.select("d", F.round("z", 4).alias("z"), "n")


_AHEAD = {d: f"{'lead' if d >= 0 else 'lag'}(b, {abs(d)}) OVER w" for d in range(-10, 11)}
Q76 = (
    f"WITH {READS}, {_TWO_SQL}, p AS (SELECT a, " + ", ".join(f"{x} AS b{d + 10}" for d, x in _AHEAD.items()) + " FROM k WINDOW w AS (PARTITION BY read_id ORDER BY i)) "
    "SELECT unnest(generate_series(-10, 10)) AS d, round(unnest([" + ", ".join(f"sum(a * b{j})" for j in range(21)) + "]), 4) AS z, unnest([" + ", ".join(f"count(b{j})" for j in range(21)) + "]) AS n FROM p"
)


def q77_kmer_openness(spark: SparkSession, d: str) -> DataFrame:
    """How often each level of openness stands at each place round every k-mer, with the levels' mean."""
    level = F.transform(_open(F.col("seq")), lambda v: F.floor(v * 8).cast("int"))
    counted = written(structure.kmer_openness(reads(spark, d).withColumn("levels", level), 2, "levels", 4, bins=8), "openness")
    mean = structure.mean_openness(counted).select("kmer", "d", F.round("mean", 8).alias("mean"))
    return counted.join(mean, ["kmer", "d"]).select("kmer", F.col("d").cast("long").alias("d"), F.col("level").cast("long").alias("level"), "n", "mean")


Q77 = f"WITH {READS}, {_kmer_sql(2)}, o AS (SELECT read_id, i - 1 AS j, floor({_open_sql('substr(seq, i, 1)', 'i - 1')} * 8)::BIGINT AS level FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM reads)), c AS (SELECT km.kmer, j - km.pos AS d, level, count(*) AS n FROM km JOIN o ON o.read_id = km.read_id AND j BETWEEN km.pos - 4 AND km.pos + 5 GROUP BY ALL) SELECT *, round(sum(level * n) OVER (PARTITION BY kmer, d) / sum(n) OVER (PARTITION BY kmer, d), 8) AS mean FROM c"


def q78_openness_round(spark: SparkSession, d: str) -> DataFrame:
    """The levels round each read's last place of a k-mer, and the accessibilities of all its places added up by read."""
    x = reads(spark, d).withColumn("acc", _open(F.col("seq")))
    x = written(x.withColumn("levels", F.transform("acc", lambda v: F.floor(v * 8).cast("int"))), "levels")
    last = x.join(kmers.hits_per_read(x, "TGCA"), "read_id")
    near = structure.openness_round(last, "last", "levels", 2, 5).select(F.lit("level").alias("what"), F.col("d").cast("long").alias("a"), F.col("level").cast("long").alias("b"), "n", F.lit(None).cast("double").alias("acc"))
    places = structure.kmer_accessibilities(x, "TGCA", "acc").groupBy("read_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("acc"), 8).alias("acc"))
    return near.unionByName(places.select(F.lit("read").alias("what"), F.col("read_id").alias("a"), F.lit(None).cast("long").alias("b"), "n", "acc"))


Q78 = f"WITH {READS}, {_kmer_sql(4)}, o AS (SELECT read_id, length(seq) AS l, i - 1 AS j, {_open_sql('substr(seq, i, 1)', 'i - 1')} AS acc FROM (SELECT *, unnest(generate_series(1, length(seq))) AS i FROM reads)), t AS (SELECT read_id, max(pos) AS last FROM km WHERE kmer = 'TGCA' GROUP BY 1) SELECT 'level' AS what, j - last AS a, floor(acc * 8)::BIGINT AS b, count(*) AS n, NULL::DOUBLE AS acc FROM t JOIN o USING (read_id) WHERE last >= 2 AND last + 5 < l AND j BETWEEN last - 2 AND last + 5 GROUP BY ALL UNION ALL SELECT 'read', km.read_id, NULL, count(*), round(sum(acc), 8) FROM km JOIN o ON o.read_id = km.read_id AND o.j = km.pos WHERE km.kmer = 'TGCA' GROUP BY km.read_id"


def _z(spark: SparkSession, d: str) -> DataFrame:
    """Each read's total over both motifs' open sites."""
    x = reads(spark, d).withColumn("one", _open(F.col("seq")))
    return structure.with_totals(structure.with_sites(x, [_motif(MOTIF, acc="one"), _motif(SECOND, acc="one", a0=0.5)], keep=["read_id", "seq"])).select("read_id", "seq", "z")


_Z_SQL = f"{_TWO_SQL}, zt AS (SELECT reads.read_id, coalesce(z, 0) AS z FROM reads LEFT JOIN (SELECT read_id, sum(a + b * 0.5::DOUBLE) AS z FROM k GROUP BY 1) USING (read_id))"
TOTALS = [1.0, 5.0, 25.0, 125.0]


def q79_free_protein(spark: SparkSession, d: str) -> DataFrame:
    """Free protein for four totals from all reads' Z, and the mean occupancy that it gives."""
    x = written(_z(spark, d).select("read_id", "z"), "z")
    found = protein.exact_free(x, TOTALS, 100.0)
    free = spark.createDataFrame([(f.total, f.value) for f in found], "total double, free double")
    bound = x.crossJoin(F.broadcast(free)).withColumn("psi", fitting.occupancy_at("z", F.col("free")))
    return bound.groupBy("total", "free").agg(F.avg("psi").alias("psi")).select("total", F.round("free", 7).alias("free"), F.round("psi", 8).alias("psi"))


Q79 = f"WITH RECURSIVE {READS}, {_Z_SQL}, b AS (SELECT 0 AS i, t AS total, 0::DOUBLE AS lo, t AS hi FROM (SELECT unnest({TOTALS}::DOUBLE[]) AS t) UNION ALL SELECT i + 1, total, CASE WHEN over THEN lo ELSE mid END, CASE WHEN over THEN mid ELSE hi END FROM (SELECT b.*, (lo + hi) / 2 AS mid, (lo + hi) / 2 + 100 * (SELECT avg((lo + hi) / 2 * z / ((lo + hi) / 2 * z + 1)) FROM zt WHERE z > 0) > total AS over FROM b WHERE i < 60)) SELECT total, round((lo + hi) / 2, 7) AS free, round((SELECT avg((lo + hi) / 2 * z / ((lo + hi) / 2 * z + 1)) FROM zt), 8) AS psi FROM b WHERE i = 60"


def _field(spark: SparkSession, d: str) -> tuple[meanfield.Neighbours, fitting.Model, np.ndarray]:
    near = meanfield.neighbours(written(reads(spark, d), "reads"), 2)
    model = fitting.Model([np.array(MOTIF[1:3])], np.array([0.8]), np.array([0.05, 0.2]))
    at = np.arange(16)
    return near, model, np.stack([0.5 + at / 16, 1.5 - at / 16])


def q80_mean_field(spark: SparkSession, d: str) -> DataFrame:
    """The mean-field model at fixed parameters: its enrichments by sample and k-mer, its error, and the error's gradient."""
    near, model, observed = _field(spark, d)
    state = meanfield.states(near, [model], [1.0, 5.0], observed)[0]
    rows = [(f"r{s}", i, float(state.enriched[s, i])) for s in (0, 1) for i in range(16)] + [("error", 0, state.error)]
    rows += [("slope", i, float(g)) for i, g in enumerate(meanfield.gradient(near, state, observed))]
    return spark.createDataFrame(rows, "what string, at long, value double").withColumn("value", F.round("value", 7))


_FIELD_SQL = (
    f"{_kmer_sql(2)}, n AS (SELECT read_id, pos, strpos('ACGT', kmer[1]) * 4 + strpos('ACGT', kmer[2]) - 5 AS i FROM km), c AS (SELECT i, count(*) AS n FROM n GROUP BY 1), f AS (SELECT i, n / sum(n) OVER () AS f0 FROM c), "
    "m AS (SELECT x.i AS a, y.i AS b, count(*) / any_value(c.n) AS m FROM n x JOIN n y ON y.read_id = x.read_id AND y.pos BETWEEN x.pos - 2 AND x.pos + 2 JOIN c ON c.i = x.i GROUP BY 1, 2), "
    + "wt AS (SELECT unnest(range(4)) AS b, unnest({}::DOUBLE[]) AS x, unnest({}::DOUBLE[]) AS y), ".format(MOTIF[1], MOTIF[2])
    + "af AS (SELECT p.b * 4 + q.b AS i, p.b AS b0, q.b AS b1, p.x AS x, q.y AS y, 0.8::DOUBLE * p.x * q.y AS a FROM wt p CROSS JOIN wt q), "
    "sm AS (SELECT * FROM (VALUES (0, 1.0::DOUBLE, 0.05::DOUBLE), (1, 5.0, 0.2)) AS t(s, p, beta)), oc AS (SELECT s, af.*, p * a / (p * a + 1) AS o FROM sm CROSS JOIN af), "
    "w AS (SELECT sm.s, f.i, f0, f0 * (coalesce(sum(m * o), 0) + any_value(beta)) AS w FROM sm CROSS JOIN f JOIN m ON m.a = f.i JOIN oc ON oc.s = sm.s AND oc.i = m.b GROUP BY 1, 2, 3), "
    "r AS (SELECT *, sum(w) OVER (PARTITION BY s) AS t, w / sum(w) OVER (PARTITION BY s) / f0 AS r, CASE s WHEN 0 THEN 0.5 + i / 16 ELSE 1.5 - i / 16 END AS ob FROM w), "
    "e AS (SELECT *, 2 * (r - ob) / count(*) OVER () AS dr FROM r), g AS (SELECT s, i, ((dr / f0 - sum(dr * r) OVER (PARTITION BY s)) / t) * f0 AS worth FROM e), "
    "h AS (SELECT oc.b0, oc.b1, oc.x, oc.y, oc.a, sum(worth * m) * any_value(o - o * o) AS l FROM g JOIN m ON m.a = g.i JOIN oc ON oc.s = g.s AND oc.i = m.b GROUP BY oc.s, oc.i, 1, 2, 3, 4, 5)"
)
Q80 = f"WITH {READS}, {_FIELD_SQL} SELECT 'r' || s AS what, i::BIGINT AS at, round(r, 7) AS value FROM r UNION ALL SELECT 'error', 0, round(avg((r - ob) * (r - ob)), 7) FROM r UNION ALL SELECT 'slope', b0, round(sum(l / x), 7) FROM h GROUP BY b0 UNION ALL SELECT 'slope', 4 + b1, round(sum(l / y), 7) FROM h GROUP BY b1 UNION ALL SELECT 'slope', 8, round(sum(l) / 0.8, 7) FROM h UNION ALL SELECT 'slope', 9 + s, round(sum(worth), 7) FROM g GROUP BY s"


def q81_mean_field_fit(spark: SparkSession, d: str) -> DataFrame:
    """A motif fitted to the enrichments of the other languages over English by a descent on the mean field, with its history."""
    from utrflow.plans.storage import new_path

    x = written(reads(spark, d), "reads")
    near = meanfield.neighbours(x.filter("lang = 'en'"), 2)
    shares = kmers.frequencies(kmers.counts(x, 2, ["lang"]), 2, ["lang"])
    both = shares.filter("lang != 'en'").join(shares.filter("lang = 'en'").select("kmer", F.col("freq").alias("base")), "kmer").select("lang", "kmer", (F.col("freq") / F.col("base")).alias("r")).orderBy("lang", "kmer").collect()  # 16 rows a language
    observed = np.array([r["r"] for r in both]).reshape(-1, 16)
    n = len(observed)
    start = fitting.Model([np.full((2, 4), 0.5)], np.array([0.3]), np.full(n, 0.1))
    evaluate, errors_of = meanfield.evaluator(near, [5.0] * n, observed)
    path = new_path(spark, "history")
    descent.descend(start, evaluate, errors_of, slope=1e-3, spark=spark, path=path)
    steps = descent.history(spark, path)
    quartiles = fitting.parameter_errors(steps, tolerance=0.05, least=5)
    last = steps.groupBy("parameter").agg(F.max_by("value", "step").alias("value"), F.max_by("error", "step").alias("error"), F.max("step").alias("steps"))
    return last.join(quartiles, "parameter").select("parameter", "steps", *[F.round(c, 6).alias(c) for c in ("error", "value", "lo", "mid", "hi")])


def _molecules(spark: SparkSession, d: str) -> footprints.Reads:
    x = structure.with_sites(_whole(spark, d), [_motif(MOTIF)], 0.0, LEFT, RIGHT).select("read_id", F.col("z_sites").alias("z"), "one", "two")
    return footprints.Reads(written(x, "molecules"), "z", "one", {2: "two"}, first=3)


_POINTS = [footprints.Footprint(0, 0, 0.0, 1.0), footprints.Footprint(2, -1, 0.5, 1.0), footprints.Footprint(2, 1, 1.0, 0.25)]
_FREE = np.array([[0.01, 0.5], [0.02, 0.5], [0.05, 1.0]])


def q82_footprints(spark: SparkSession, d: str) -> DataFrame:
    """The profiles of accessibility round the sites that three footprints predict for two concentrations, and the plain one."""
    x = _molecules(spark, d)
    got, plain = footprints.predicted_profiles(x, _POINTS, _FREE, 4, 3), footprints.observed_profile(x, 4, 3)
    rows = [(g, s, i - 3, float(got[g, s, i])) for g in range(3) for s in (0, 1) for i in range(10)] + [(-1, 0, i - 3, float(v)) for i, v in enumerate(plain)]
    return spark.createDataFrame(rows, "point long, sample long, d long, p double").withColumn("p", F.round("p", 8))


Q82 = (
    f"WITH {READS}, {_MOLECULE}, s AS (SELECT read_id, i, length(t) - 9 AS n, {_site_sql('t', 'i + 4', MOTIF)} AS z FROM p), v AS (SELECT x.read_id, x.j, x.one * y.one AS two FROM o x JOIN o y ON y.read_id = x.read_id AND y.j = x.j + 1), "
    "a AS (SELECT s.read_id, least(sum(z), 1e6) AS z0, least(sum(z * coalesce(sqrt(q.two), 0)), 1e6) AS z1, least(sum(z * coalesce(u.two, 0)), 1e6) AS z2 FROM s LEFT JOIN v q ON q.read_id = s.read_id AND q.j = s.i + 2 LEFT JOIN v u ON u.read_id = s.read_id AND u.j = s.i + 4 GROUP BY 1), "
    "y AS (SELECT read_id, unnest([0, 0, 1, 1, 2, 2]) AS point, unnest([0, 1, 0, 1, 0, 1]) AS sample, unnest([z0 * 0.01::DOUBLE, z0 * 0.5::DOUBLE, z1 * 0.02::DOUBLE, z1 * 0.5::DOUBLE, z2 * 0.0125::DOUBLE, z2 * 0.25::DOUBLE]) AS x FROM a), "
    "ps AS (SELECT read_id, point, sample, x / (x + 1) AS psi FROM y UNION ALL SELECT read_id, -1, 0, 1 FROM a), "
    "inn AS (SELECT * FROM s WHERE i >= 3 AND i < n - 3), ar AS (SELECT inn.read_id, o.j - inn.i - 3 AS d, sum(z * one) AS za FROM inn JOIN o ON o.read_id = inn.read_id AND o.j BETWEEN inn.i AND inn.i + 9 GROUP BY 1, 2), tz AS (SELECT read_id, sum(z) AS z FROM inn GROUP BY 1), "
    "nm AS (SELECT point, sample, sum(z * psi) AS t FROM tz JOIN ps USING (read_id) GROUP BY ALL) SELECT point::BIGINT AS point, sample::BIGINT AS sample, d, round(sum(za * psi) / any_value(t), 8) AS p FROM ar JOIN ps USING (read_id) JOIN nm USING (point, sample) GROUP BY ALL"
)


def q83_calibration(spark: SparkSession, d: str) -> DataFrame:
    """The footprint found anew from the profiles that one of the grid predicts, with the errors of the others."""
    x = _molecules(spark, d)
    truth = footprints.Footprint(2, 1, 0.6, 2.0)
    observed = footprints.predicted_profiles(x, [truth], footprints.free_by_footprint(x, [truth], [1.0, 20.0], 50.0), 4, 3)[0]
    fits = footprints.calibrated(x, observed, [1.0, 20.0], 50.0, 4, 3, shifts={2: [-1, 0, 1, 2]}, rounds=4)
    return spark.createDataFrame([(i, f.footprint.k, f.footprint.shift, round(f.footprint.scale, 3), float(f"{f.footprint.a0:.3g}"), float(f"{f.error:.3g}")) for i, f in enumerate(fits)], "place int, k int, shift int, scale double, a0 double, error double")


def q84_gamma_codebook(spark: SparkSession, d: str) -> DataFrame:
    """A gamma distribution of the orders' prices (in thousands) and how many of them each of sixteen levels holds."""
    x = table(spark, d, "orders").select((F.col("o_totalprice") / 1000).cast("double").alias("e"))
    gamma = discretise.fit_gamma(x, "e")
    book = discretise.Codebook.of_gamma(gamma, 16)
    levels = x.groupBy(book.encoded(F.col("e")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    own = F.lit(None).cast("long")
    fit = spark.createDataFrame([("shape", round(gamma.shape, 6)), ("scale", round(gamma.scale, 5))], "what string, value double")
    return fit.select("what", own.alias("level"), own.alias("n"), "value").unionByName(levels.select(F.lit("level").alias("what"), F.col("level").cast("long").alias("level"), "n", F.round(book.decoded(F.col("level")), 4).alias("value")))


def _digamma_sql(x: str) -> tuple[str, str]:
    """Digamma and its derivative at a positive number, from their asymptotic series ten further on."""
    y = f"({x} + 10)"
    first = f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8) - (" + " + ".join(f"1 / ({x} + {i})" for i in range(10)) + "))"
    second = f"(1 / {y} + 1 / (2 * {y} ** 2) + 1 / (6 * {y} ** 3) - 1 / (30 * {y} ** 5) + 1 / (42 * {y} ** 7) - 1 / (30 * {y} ** 9) + " + " + ".join(f"1 / ({x} + {i}) ** 2" for i in range(10)) + ")"
    return first, second


def _gamma_sql() -> str:
    """The fit by Newton steps; quantiles by bisection of the distribution's power series."""
    first, second = _digamma_sql("a")
    # P(a, x) = x^a e^-x / Gamma(a + 1) * (1 + x / (a + 1) + x^2 / (a + 1)(a + 2) + ...), the terms added up backwards (Horner's rule)
    cdf = "exp(a * ln(x) - x - lgamma(a + 1)) * list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(400, 0, -1), lambda n: x / (a + n))), lambda p, t: 1 + p * t)"
    return (
        "x AS (SELECT (o_totalprice / 1000)::DOUBLE AS e FROM orders WHERE o_totalprice > 0), s AS (SELECT avg(e) AS mean, ln(avg(e)) - avg(ln(e)) AS g FROM x), "
        f"nt AS (SELECT 0 AS i, (3 - g + sqrt((g - 3) ** 2 + 24 * g)) / (12 * g) AS a FROM s UNION ALL SELECT i + 1, a - (ln(a) - {first} - g) / (1 / a - {second}) FROM nt CROSS JOIN s WHERE i < 12), "
        "ab AS (SELECT a, mean / a AS scale FROM nt CROSS JOIN s WHERE i = 12), "
        "bi AS (SELECT 0 AS i, q, 0::DOUBLE AS lo, 200::DOUBLE AS hi FROM (SELECT unnest(generate_series(1, 31)) / 32 AS q) UNION ALL SELECT i + 1, q, CASE WHEN under THEN x ELSE lo END, CASE WHEN under THEN hi ELSE x END FROM (SELECT i, q, lo, hi, x, " + cdf + " < q AS under FROM (SELECT bi.*, (lo + hi) / 2 AS x, a FROM bi CROSS JOIN ab WHERE i < 55))), "
        "qu AS (SELECT round(q * 32)::BIGINT AS h, (lo + hi) / 2 * scale AS v FROM bi CROSS JOIN ab WHERE i = 55)"
    )


Q84 = f"WITH RECURSIVE {_gamma_sql()}, lv AS (SELECT e, (SELECT count(*) FROM qu WHERE h % 2 = 0 AND v <= e) AS level FROM x) SELECT 'shape' AS what, NULL::BIGINT AS level, NULL::BIGINT AS n, round(a, 6) AS value FROM ab UNION ALL SELECT 'scale', NULL, NULL, round(scale, 5) FROM ab UNION ALL SELECT 'level', level, count(*), round(any_value(v), 4) FROM lv JOIN qu ON h = 2 * level + 1 GROUP BY level"


def q85_curve(spark: SparkSession, d: str) -> DataFrame:
    """Concentration and background of a binding curve over all reads, whose enrichments follow one with a scatter by read."""
    x = _z(spark, d).filter("z > 0").withColumn("f0", F.length("seq").cast("double"))
    x = x.crossJoin(F.broadcast(x.agg(F.sum("f0").alias("__t")))).withColumn("f0", F.col("f0") / F.col("__t"))
    y = F.col("z") * 2
    x = written(x.select("read_id", "z", "f0", (F.log2(y / (y + 1) + 0.05) + (F.col("read_id") % 7 - 3) / 10).alias("lr")), "curve")
    found = nonlinear.fit_curve(x)
    fit = nonlinear.predicted(x, found).agg(F.corr("lr", "lr_predicted").alias("r"), F.count(F.lit(1)).alias("n"))
    own = lambda v: float(f"{v:.4g}")
    return fit.select(F.lit(own(found.concentration)).alias("concentration"), F.lit(own(found.background)).alias("background"), F.lit(round(found.error, 6)).alias("error"), F.round("r", 5).alias("r"), "n")


_CURVE = "log2((exp(c) * z / (exp(c) * z + 1) + exp(b)))"
Q85 = (
    f"WITH RECURSIVE {READS}, {_Z_SQL}, x AS (SELECT z, length(seq) / (sum(length(seq)) OVER ()) AS f0, log2(2 * z / (2 * z + 1) + 0.05::DOUBLE) + (read_id % 7 - 3) / 10 AS lr FROM zt JOIN reads USING (read_id) WHERE z > 0), "
    "gr AS (SELECT u, v FROM (SELECT unnest(generate_series(-4, 4)) AS u) CROSS JOIN (SELECT unnest(generate_series(-4, 4)) AS v)), "
    "it AS (SELECT 0 AS i, 0::DOUBLE AS c, -2::DOUBLE AS b, 0.6::DOUBLE AS h, 0::DOUBLE AS e UNION ALL "
    f"SELECT i + 1, arg_min(c, e), arg_min(b, e), any_value(h) * 0.6, min(e) FROM (SELECT i, c, b, any_value(h) AS h, avg(({_CURVE} - lr) ** 2) - 2 * log2(sum(f0 * (exp(c) * z / (exp(c) * z + 1) + exp(b)))) * avg({_CURVE} - lr) + log2(sum(f0 * (exp(c) * z / (exp(c) * z + 1) + exp(b)))) ** 2 AS e FROM (SELECT i, h, it.c + u * h AS c, it.b + v * h AS b FROM it CROSS JOIN gr WHERE i < 32) CROSS JOIN x GROUP BY i, c, b) GROUP BY i) "
    f"SELECT printf('%.3e', exp(c))::DOUBLE AS concentration, printf('%.3e', exp(b))::DOUBLE AS background, round(e, 6) AS error, (SELECT round(corr(lr, {_CURVE}), 5) FROM x) AS r, (SELECT count(*) FROM x) AS n FROM it WHERE i = 32"
)


def q86_density(spark: SparkSession, d: str) -> DataFrame:
    """The density of the documents by two measures of their text on a grid, and how many of a cell's are among the sparsest tenth."""
    x = table(spark, d, "documents").filter("length(text) > 0").select(F.log10(F.length("text").cast("double")).alias("x"), (F.length(F.regexp_replace("text", "[^ ]", "")) / F.length("text")).alias("y"))
    x = written(x, "points")
    found = density.density(x, "x", "y", cells=24)
    rows = [(i, j, int(found.counts[i, j]), float(found.values[i, j])) for i in range(24) for j in range(24) if found.counts[i, j]]
    cells = spark.createDataFrame(rows, "i long, j long, n long, density double").withColumn("density", F.round("density", 6))
    sparse = density.outliers(x, found, "x", "y", 10).filter("outlier").count()
    return cells.withColumn("sparse", F.lit(sparse).cast("long"))


Q86 = (
    "WITH p AS (SELECT log10(length(text)) AS x, length(regexp_replace(text, '[^ ]', '', 'g')) / length(text) AS y FROM documents WHERE length(text) > 0), "
    "s AS (SELECT count(*) AS n, min(x) - 0.05 * (max(x) - min(x)) AS x0, min(y) - 0.05 * (max(y) - min(y)) AS y0, 1.1 * (max(x) - min(x)) / 24 AS dx, 1.1 * (max(y) - min(y)) / 24 AS dy, var_samp(x) * count(*) ** (-1 / 3) AS a, var_samp(y) * count(*) ** (-1 / 3) AS b, covar_samp(x, y) * count(*) ** (-1 / 3) AS c FROM p), "
    "g AS (SELECT least(greatest(floor((x - x0) / dx), 0), 23)::BIGINT AS i, least(greatest(floor((y - y0) / dy), 0), 23)::BIGINT AS j, count(*) AS n FROM p CROSS JOIN s GROUP BY ALL), "
    "k AS (SELECT u.i, u.j, any_value(u.n) AS n, sum(v.n * exp(-0.5 * (b * ((u.i - v.i) * dx) ** 2 - 2 * c * (u.i - v.i) * dx * (u.j - v.j) * dy + a * ((u.j - v.j) * dy) ** 2) / (a * b - c * c))) / any_value(2 * pi() * sqrt(a * b - c * c) * s.n) AS density FROM g u CROSS JOIN g v CROSS JOIN s GROUP BY u.i, u.j), "
    "r AS (SELECT *, sum(n) OVER (ORDER BY density) / sum(n) OVER () AS share FROM k) SELECT i, j, n, round(density, 6) AS density, (SELECT coalesce(sum(n), 0)::BIGINT FROM r WHERE share < 0.1) AS sparse FROM r"
)

QUERIES = {name: f for name, f in globals().items() if name[:1] == "q" and name[1:3].isdigit()}
ORACLE_SQL = {name: globals()[name[:3].upper()] for name in QUERIES if name[:3].upper() in globals()}
