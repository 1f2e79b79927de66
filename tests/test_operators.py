"""Operators against hand data, numpy and naive forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from utrflow.functions import measures as m
from utrflow.functions import sequence as s
from utrflow.operators import annotate, compare, enrichment, fitting, intervals, kmers, psam, regression, seeding, simulate, training
from utrflow.sources import files
from utrflow.streaming import incoming


def test_overlap_join_equals_naive(spark):
    r = random.Random(1)
    a = [(i, f"c{r.randint(1, 2)}", x := r.randint(0, 5000), x + r.randint(1, 50)) for i in range(300)]
    b = [(i, f"c{r.randint(1, 2)}", x := r.randint(0, 5000), x + r.choice([1, 20, 4000])) for i in range(200)]
    left, right = spark.createDataFrame(a, "id long, chrom string, start long, end long"), spark.createDataFrame(b, "rid long, chrom string, r_start long, r_end long")
    want = {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    rows = intervals.overlap_join(left, right, width=16, coarse=4).select("id", "rid").collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    full = intervals.overlap_join(left, right, width=16, how="left", left_id="id")
    assert full.select("id").distinct().count() == 300


def test_touching_ends_do_not_overlap(spark):
    a = spark.createDataFrame([(1, "c", 0, 10)], "id long, chrom string, start long, end long")
    b = spark.createDataFrame([(2, "c", 10, 20), (3, "c", 9, 10)], "rid long, chrom string, r_start long, r_end long")
    assert [r["rid"] for r in intervals.overlap_join(a, b).collect()] == [3]


def test_sequence_functions(spark):
    row = spark.createDataFrame([("ACGTN", "acgu", None)], "a string, b string, n string").select(
        s.reverse_complement(F.col("a")).alias("rc"), s.kmers(F.col("b"), 3).alias("k"), s.kmer_index(F.lit("ACGU")).alias("i"),
        s.index_kmer(F.lit(27), 4).alias("w"), F.size(s.hull(F.lit("ACG"))).alias("h"), s.reverse_complement(F.col("n")).alias("none"),
        F.size(s.expanded(F.lit("A"))).alias("e"), s.gc_share(F.lit("GGCA")).alias("gc"), s.base_entropy(F.lit("ACGT")).alias("bits"),
    ).first()
    assert row["rc"] == "NACGT" and row["k"] == ["acg", "cgu"] and row["i"] == 27 and row["w"] == "ACGU"
    assert row["h"] == 10 and row["none"] is None and row["e"] == 8 and row["gc"] == 0.75 and row["bits"] == 2.0


def test_site_scores_with_unknown_base(spark):
    w = [[0.5, 1.0, 0.1, 0.2], [1.0, 0.3, 0.2, 0.1]]
    got = spark.createDataFrame([("CANGA", 1)], "seq string, id int").select(psam.site_scores(F.col("seq"), w).alias("z")).first()["z"]
    assert got == pytest.approx([1.0, 0.0, 0.0, 0.1])
    table = spark.createDataFrame([("x", 0, 1.0, p, b, w[p][i]) for p in range(2) for i, b in enumerate("ACGU")], "rbp string, motif int, a0 double, pos int, base string, weight double")
    score = psam.score_many(spark.createDataFrame([("CANGA",)], "seq string"), table).first()["score"]
    assert score == pytest.approx(1.1)


def test_motif_files_round_trip(spark, tmp_path):
    motifs = [(0.5, [[1.0, 0.1, 0.2, 0.3], [0.0, 1.0, 0.5, 0.25]]), (2.0, [[0.1, 0.2, 0.3, 1.0]] * 2)]
    (tmp_path / "RBP1.txt").write_text(files.motif_text(motifs, "made here"))
    rows = files.read_motifs(spark, str(tmp_path)).orderBy("motif", "pos", "base").collect()
    assert len(rows) == 16 and rows[0]["a0"] == 2.0 and rows[0]["rbp"] == "RBP1"
    assert {r["weight"] for r in rows if r["motif"] == 1 and r["pos"] == 1} == {1e-6, 1.0, 0.5, 0.25}


def test_vcf_and_fasta(spark, tmp_path):
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\tPOS\n1\t101\trs1\tA\tG\t.\t.\tq\nchr2\t5\trs2\tAC\tG\t.\t.\t\n")
    v = files.read_vcf(spark, str(tmp_path / "v.vcf"))
    one = annotate.single_nucleotide(v).collect()
    assert [(r["chrom"], r["start"], r["variant_id"]) for r in one] == [("chr1", 100, "chr1_101_A_G")]
    with pytest.raises(ValueError):
        annotate.single_nucleotide(v, "mm10")
    (tmp_path / "g.fa").write_text(">c1 first\nACGT\nACGT\n>c2\nTTTT\n")
    g = files.genome_chunks(files.read_fasta(spark, str(tmp_path / "g.fa")), 3)
    regions = spark.createDataFrame([("c1", 2, 7), ("c2", 3, 9)], "chrom string, start long, end long")
    assert {(r["chrom"], r["seq"]) for r in intervals.fetch(regions, g, 3, F.col("start"), F.col("end")).collect()} == {("c1", "GTACG"), ("c2", "T")}


def test_annotation_branches(spark):
    r = random.Random(3)
    seq = "".join(r.choice("ACGT") for _ in range(400))
    seq = seq[:200] + "N" + seq[201:]
    genome = files.genome_chunks(spark.createDataFrame([("chrA", seq)], "name string, seq string"), 64)
    v = spark.createDataFrame([("A", 101, "i", seq[100], "A" if seq[100] != "A" else "C"), ("A", 190, "j", seq[189], "A" if seq[189] != "A" else "C"), ("A", 301, "k", "AC", "G"), ("A", 391, "m", seq[390], "G")], "chrom string, pos long, id string, ref string, alt string").withColumns({"start": F.col("pos") - 1, "end": F.col("pos")})
    v = v.withColumn("chrom", F.lit("chrA"))
    utr = spark.createDataFrame([("chrA", 50, 150, "G1", ".", "+", 3, 1, 50, 150), ("chrA", 50, 200, "G1", ".", "+", 3, 3, 50, 200)], files.UTR)
    fallback = spark.createDataFrame([("chrA", 380, 400, "G2", ".", "-", 1, 1, 380, 400)], files.UTR)
    gwas = spark.createDataFrame([("chrA", 95, 105, "g1"), ("chrA", 99, 101, "g2")], files.WINDOWS)
    eclip = spark.createDataFrame([("chrA", 90, 110, "R1", "HepG2"), ("chrA", 90, 110, "R2", "K562")], "chrom string, r_start long, r_end long, rbp string, cell string")
    sites = spark.createDataFrame([("chrA", 90, 110, "m1"), ("chrA", 90, 110, "m2")], "chrom string, r_start long, r_end long, mergekey string")
    predicted = spark.createDataFrame([("m1", "f", "8mer", "0.5", "+", "ctx", "consFam", "1")], files.MIR_PREDICTIONS)
    motif = spark.createDataFrame([("X", 0, 1.0, p, b, 1.0 if b != "N" else 0.0) for p in range(3) for b in "ACGU"], "rbp string, motif int, a0 double, pos int, base string, weight double")
    model = {"intercept": 0.0, "in_eclip": 1.0, "conserved": 1.0}
    tables = annotate.Annotations(utr, fallback, eclip=eclip, gwas=gwas, mir_sites=sites, mir_predictions=predicted, genome=genome, genome_chunk=64, motifs=motif, models={"gwas": model})
    rows = annotate.annotate(annotate.single_nucleotide(v), tables).orderBy("var_id", "APA_info").collect()
    assert rows[0].asDict().keys() == dict.fromkeys(annotate.COLUMNS).keys()
    first = [x for x in rows if x["var_id"].startswith("chrA_101_")]
    assert [x["APA_info"] for x in first] == ["G1_+_1_3_common", "G1_+_3_3_unique"]
    assert first[0]["eclip_tot"] == "R2_K562__R1_HepG2" and first[0]["gwas_info"] == "g1|g2" and first[0]["pred_gwas"] is None
    assert first[0]["miR_info"] == "m1__f__8mer__0.5__+__ctx__consFam__1|m2__nonCons_family" and first[0]["motif_cat"] == "preserved"
    near_n = [x for x in rows if x["var_id"].startswith("chrA_190_")]
    assert len(near_n) == 1 and near_n[0]["motif_RBPs"] is None and near_n[0]["eclip_tot"] == ""
    assert [x["APA_info"] for x in rows if x["var_id"].startswith("chrA_391_")] == ["G2_-_1_1_single"]
    assert annotate.one_line_each(annotate.annotate(annotate.single_nucleotide(v), tables)).count() == 3
    assert annotate.for_file(annotate.annotate(annotate.single_nucleotide(v), tables)).filter("pred_eqtl = 'NA'").count() == len(rows)


def test_logistic_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(int)
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], "y int, a double, b double")
    got = regression.fit_logistic(df, "y", ["a", "b"])
    X, beta = np.hstack([np.ones((500, 1)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ beta))
        beta += np.linalg.solve((X.T * (p * (1 - p))) @ X, X.T @ (y - p))
    assert list(got.values()) == pytest.approx(beta.tolist(), abs=1e-8)
    assert df.select(regression.predicted(got).alias("p")).filter("p is null").count() == 0
    ridge = regression.ridge(df, "y", ["a", "b"], 0.5)
    c = x - x.mean(0)
    assert [ridge["a"], ridge["b"]] == pytest.approx(np.linalg.solve(c.T @ c + 0.5 * np.eye(2), c.T @ (y - y.mean())).tolist())


def test_tests_of_ranks_and_means(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", float(i) + 5) for i in range(10)], "g string, v double")
    u, p = regression.mann_whitney(df, "v", "g", "a", "b")
    assert u == 12.5 and 0.001 < p < 0.01
    t, p = regression.t_test(df.filter("g = 'a'"), "v", 4.5)
    assert t == 0 and p == pytest.approx(1, abs=1e-3)


def test_ska_is_ordered_fold(spark):
    one = s.all_kmers(spark, 2).withColumn("value", F.lit(1.0))
    reads = spark.createDataFrame([(1, "AAC"), (2, "AAG"), (3, "NN")], "read_id long, seq string")
    got = {r["kmer"]: r["weight"] for r in enrichment.ska(reads, one, one, 2, passes=1).collect()}
    w, total = dict.fromkeys(got, 1.0), 16.0
    for seq in ("AAC", "AAG"):
        k = [seq[:2], seq[1:]]
        part = [w[x] for x in k]
        for x, p in zip(k, part):
            w[x] += p / sum(part)
        total += 1
    assert got["AA"] == pytest.approx(w["AA"] * 16 / total, rel=1e-5) and sum(got.values()) == pytest.approx(16, rel=1e-5)


def test_ska_holds_no_sample_in_a_frame(spark):
    r = random.Random(9)
    rows = [(i, r.choice("xyz"), "".join(r.choice("ACGTUNacg") for _ in range(r.randint(0, 40)))) for i in range(400)] + [(400, "x", None), (401, None, "ACGTT")]
    r.shuffle(rows)
    reads = spark.createDataFrame(rows, "read_id long, lang string, seq string")
    one = s.all_kmers(spark, 2).withColumn("value", F.lit(1.0)).crossJoin(reads.select("lang").distinct().filter("lang is not null"))
    base = one.withColumn("value", F.when(F.col("kmer") == "AC", 2.0).otherwise(0.5))
    got = enrichment.ska(reads, one, base, 2, ["lang"], passes=3, tolerance=0.0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and plan.count("Sort [") == plan.count("Exchange hashpartitioning(lang")  # sorted once, in order
    found = {(x["lang"], x["kmer"]): x["weight"] for x in got.collect()}
    names = [a + b for a in "ACGT" for b in "ACGT"]
    assert len(found) == 4 * 16
    for lang in ("x", "y", "z", None):
        w, bg = np.ones(16, np.float32), np.full(16, 0.5 if lang else 1, np.float32)
        bg[1] = 2 if lang else 1
        for _ in range(3):
            total = np.float32(w.sum())
            z = np.float32(16 / total)
            for _, _, seq in sorted((x for x in rows if x[1] == lang), key=lambda x: x[0]):
                seq = (seq or "").upper().replace("U", "T")
                at = np.array([names.index(seq[i : i + 2]) for i in range(len(seq) - 1) if seq[i : i + 2] in names], int)
                if len(at):
                    part = w[at] / bg[at] * z
                    np.add.at(w, at, part / part.sum())
                    total += np.float32(1)
                    z = np.float32(16 / total)
            w *= z
        assert [found[lang, x] for x in names] == w.tolist()


def test_gradient_equals_differences(spark):
    reads = simulate.reads(spark, 200, 12, 5)
    rng = np.random.default_rng(1)
    w = rng.random((3, 4)) * 0.8 + 0.1
    w /= w.max(axis=1, keepdims=True)
    model = fitting.Model([w], np.array([0.4]), np.array([0.05]))
    f0, observed = np.full(16, 1 / 16), rng.random((1, 16)) + 0.5
    error, g = fitting.gradient(reads, model, [2.0], 2, f0, observed)
    for i in (0, 5, 12, 13):
        v, h = model.vector(), 1e-5
        ends = []
        for sign in (1, -1):
            x = v.copy()
            x[i] += sign * h
            m2 = fitting.Model([x[:12].reshape(3, 4)], x[12:13], x[13:])
            ends.append(fitting.gradient(reads, m2, [2.0], 2, f0, observed)[0])
        assert g[i] == pytest.approx((ends[0] - ends[1]) / 2 / h, rel=2e-3, abs=1e-9)


def test_descent_works_on_reads_of_all_lengths_at_once(monkeypatch):
    import pandas as pd

    r = np.random.default_rng(4)
    seqs = pd.Series(["".join(r.choice(list("ACGTUNac"), size=n)) for n in [0, 1, 2, 3, *r.integers(0, 90, 200)]])
    monkeypatch.setattr(fitting, "_kmers_of", lambda x, k, f=fitting._kmers_of: calls.append(x.shape) or f(x, k))
    letters = {c: "ACGT".index(c.upper().replace("U", "T")) for c in "ACGTUac"}
    for widths, k in (((4,), 3), ((3, 8), 5), ((1, 7), 1)):
        calls: list = []
        model = fitting.Model([r.random((w, 4)) * 0.9 + 0.1 for w in widths], r.random(len(widths)), np.ones(1))
        part = fitting._Portion(seqs)
        codes = [[letters.get(c, 4) for c in q] for q in seqs]
        site = lambda w, x, i: np.prod([0 if x[i + d] > 3 else w[d, x[i + d]] for d in range(len(w))])
        want = [sum(a * sum(site(w, x, i) for i in range(len(x) - len(w) + 1)) for a, w in zip(model.a0, model.weights)) for x in codes]
        z = part.affinity(model)
        assert z == pytest.approx(want, rel=1e-12)
        found, total = part.by_kmer(z[None], k)[0], np.zeros(4**k)
        for x, v in zip(codes, z):
            for i in range(len(x) - k + 1):
                if max(x[i : i + k]) < 4:
                    total[sum(c * 4 ** (k - 1 - d) for d, c in enumerate(x[i : i + k]))] += v
        assert found[:-1] == pytest.approx(total, rel=1e-12) and len(calls) == 1 and calls[0][0] == 1
        worth = np.append(r.random(4**k), 0)
        assert part.of_kmers(worth[None], k)[0] @ z == pytest.approx(found @ worth)


def test_free_protein_solves_its_equation(spark):
    import pandas as pd

    hist = pd.DataFrame({"z": [0.1, 1.0, 10.0], "n": [5, 3, 2]})
    p = fitting.free_protein(hist, 3.0, 4.0)
    assert p + 4.0 * sum(n / 10 * p * z / (p * z + 1) for z, n in zip(hist.z, hist.n)) == pytest.approx(3.0)


def test_seeding_and_motif_tools():
    motifs = seeding.build([("TGCATG", 5.0), ("TGCACG", 3.0), ("GCATGA", 2.0), ("AAAAAA", 2.5), ("AAAAAC", 2.0)], support=2)
    assert len(motifs) == 2 and "GCA" in psam.consensus(motifs[0][1]).upper()
    w = np.array(psam.from_iupac("NACGN"))
    assert psam.consensus(psam.shrunk(w)[0]) == "ACG" and psam.shrunk(w)[1] == 1 and psam.padded_to(np.array(psam.from_iupac("ACG")), 5).shape == (5, 4)
    assert psam.consensus(psam.reverse_complemented(np.array(psam.from_iupac("AAC")))) == "GUU"
    assert psam.peaks([0, 0.5, 1.0, 0.2, 0.9], 0.8, 2) == [(2, 4), (4, 6)] and psam.dinucleotides(w).shape == (4, 16)
    assert psam.compared_along(np.array(psam.from_iupac("ACG")), "UACGU")[0] == 1 and psam.placed(np.array(psam.from_iupac("ACG")), "UACGU") == (-1, 1.0)


def test_sampling_repeats_and_simulation(spark):
    a = [r["seq"] for r in simulate.reads(spark, 50, 10, 3).orderBy("read_id").collect()]
    assert a == [r["seq"] for r in simulate.reads(spark, 50, 10, 3).repartition(5).orderBy("read_id").collect()] and len(a[0]) == 10
    df = spark.range(100)
    assert simulate.sample(df, 10, 1).count() == 10 and simulate.sample(df, 100, 1, replace=True).count() > 60
    assert simulate.markov_reads(spark, 5, 6, {"A": 1}, {"A": {"C": 1}, "C": {"A": 1}}).first()["seq"] == "ACACAC"


def test_accessibility_and_bins(spark):
    reads = spark.createDataFrame([(1, "ACGT", [0.1, 0.2, 0.3, 0.4])], "read_id long, seq string, acc array<double>")
    rows = {r["kmer"]: r["weight"] for r in kmers.accessibility_weighted(reads, 2).collect()}
    assert rows == pytest.approx({"AC": 0.1, "CG": 0.2, "GT": 0.3})
    p = {r["d"]: r["mean"] for r in kmers.accessibility_profile(reads, "CG", 1).collect()}
    assert p == pytest.approx({-1: 0.1, 0: 0.2, 1: 0.3, 2: 0.4})
    got = spark.createDataFrame([(0.25,), (None,)], "v double").select(m.edge_bin(F.col("v"), [0.1, 0.2, 0.3]).alias("b"), m.concentration(F.col("v")).alias("c")).collect()
    assert [r["b"] for r in got] == [2, None] and got[0]["c"] == "250.0 pM"


def test_descent_log(spark):
    log = spark.createDataFrame([("r", "x", 0, 2.0, 0.1, 5.0), ("r", "x", 1, 1.0, 0.5, 4.0), ("r", "x", 2, 1.04, 0.4, 6.0)], "run string, rbp string, step int, error double, correlation double, kd double")
    d = compare.descents(log).first()
    assert (d["first_error"], d["last_error"], d["kd_low"], d["kd_high"], d["best_correlation"]) == (2.0, 1.04, 4.0, 6.0, 0.5)


def test_merging_in_bins_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(a), int(a) + int(n), f"x{i % 3}") for i, (k, a, n) in enumerate(zip([["a", "b", None][j] for j in rng.integers(0, 3, 300)], rng.integers(-500, 3000, 300), rng.choice([1, 5, 40, 900], 300, p=[0.5, 0.3, 0.18, 0.02])))] + [("c", 0, 5000, "y"), ("c", 4990, 4991, "z"), ("c", 5001, 5002, "z")]
    for gap in (0, 7, -1):
        want = []
        for k in ("a", "b", "c", None):
            last = None
            for _, a, b, x in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
                if last is None or a > last[2] + gap:
                    want.append(last := [k, a, b, 0, set()])
                last[2], last[3] = max(last[2], b), last[3] + 1
                last[4].add(x)
        got = intervals.merge_overlapping(spark.createDataFrame(rows, "k string, start long, end long, x string").repartition(5), ["k"], gap=gap, lists=["x"], width=100).collect()
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(((r["k"], r["start"], r["end"], r["n"], r["x"]) for r in got), key=key) == sorted(((k, a, b, n, ",".join(sorted(x))) for k, a, b, n, x in want), key=key)


def test_numbers_of_the_definitions(spark):
    """Information, flanks, seeds and shares against numpy sums over all k-mers."""
    rng = np.random.default_rng(9)
    seqs = ["".join(rng.choice(list("ACGT"), 12, p=[0.4, 0.3, 0.2, 0.1])) for _ in range(40)]
    reads = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string")
    names = [a + b for a in "ACGT" for b in "ACGT"]
    n = np.array([sum(s[i : i + 2] == k for s in seqs for i in range(11)) for k in names])
    f = (n + 10) / (n + 10).sum()
    joint = kmers.joint_by_distance(reads, 2, most=4)
    mi = {r["d"]: r["mi"] for r in kmers.mutual_information(joint, kmers.frequencies(kmers.counts(reads, 2), 2), 2).collect()}
    for d in (2, 3, 4):
        c = np.array([[sum(s[i : i + 2] == a and s[i + d : i + d + 2] == b for s in seqs for i in range(11)) for b in names] for a in names]) + 10.0
        p = c / c.sum()
        assert mi[d] == pytest.approx((p * np.log2(p / np.outer(f, f))).sum())
    long = {(r["a"], r["b"], r["d"]): r["n"] for r in kmers.joint_by_distance(reads, 2, most=9).collect()}
    assert long == {(r["a"], r["b"], r["d"]): r["n"] for r in kmers.pairs(reads, 2, most=9).groupBy("a", "b", "d").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = spark.createDataFrame([(0, "ACAC")], "read_id long, seq string")
    di = {r["kmer"]: r["di"] for r in enrichment.information(kmers.counts(few, 2), kmers.counts(reads, 2), 2).collect()}
    t, x = n.sum() + 3, dict(zip(names, n))
    want = 3 / t * np.log2(2 / 3 / ((x["AC"] + 2) / t * 3 / t)) + n.sum() / t * np.log2(x["AC"] / n.sum() / ((x["AC"] + 2) / t * n.sum() / t))
    assert di["AC"] == pytest.approx(want) and di["CC"] == float("-inf") and len(di) == 16
    share = {r["kmer"]: r["fraction"] for r in kmers.fractions(kmers.reads_with(few, 2), few, 2).collect()}
    assert share["AC"] == 1 and share["GG"] == pytest.approx(10 / 11) and len(share) == 16
    w, a0 = psam.from_variants(["ACG", "ACT", "GCG"], [4.0, 2.0, 1.0])
    assert w[2].tolist() == pytest.approx([1e-6, 1e-6, 1, 0.5], abs=1e-5) and w[0][2] == pytest.approx(0.25, abs=1e-5) and a0 == 4 and psam.dissociation(a0) == 0.25
    p = np.array(psam.from_iupac("ACGN"))
    assert psam.padded_to(p, 6)[0].tolist() == [1.0] * 4 and psam.shrunk(p)[1] == 1.0 and len(psam.shrunk(p)[0]) == 3
    assert fitting.converged([1.0] * 13, None, 1e-6, 13) and not fitting.converged([13.0 - i for i in range(13)], None, 1e-6, 13) and fitting.converged([1e-9], None, 1e-6, 13)


def test_read_files_keep_their_own_lengths(spark, tmp_path):
    (tmp_path / "X_input.reads").write_text("".join(f"{'ACGT' * 5}\n" for _ in range(6)))
    (tmp_path / "X_5.reads").write_text("ACGTACGTAC\nNNNNNNNNNN\nACGTA\nCCCCCCCCCC\n")
    got = files.read_reads(spark, str(tmp_path)).groupBy("conc").count().collect()
    assert {r["conc"]: r["count"] for r in got} == {0.0: 6, 5.0: 2}
    got = files.read_reads(spark, str(tmp_path), skip=1, most=4).groupBy("conc").count().collect()
    assert {r["conc"]: r["count"] for r in got} == {0.0: 4, 5.0: 1}


def test_chain_file_lifts(spark, tmp_path):
    (tmp_path / "a.chain").write_text("##matrix=16\nchain 100 chr1 1000 + 10 70 chr2 500 + 200 255 1\n20 10 5\n30\n\nchain 90.5 chr1 1000 + 100 110 chr3 400 - 50 60 2\n10\n")
    chain = files.read_chain(spark, str(tmp_path / "a.chain"))
    assert sorted(map(tuple, chain.collect())) == [("chr1", 10, 30, "chr2", 200, 500, "+"), ("chr1", 40, 70, "chr2", 225, 500, "+"), ("chr1", 100, 110, "chr3", 50, 400, "-")]
    sites = spark.createDataFrame([(i, "chr1", p, p + 1) for i, p in enumerate((9, 10, 29, 30, 40, 69, 100, 109))], "id long, chrom string, start long, end long")
    got = {r["id"]: (r["chrom"], r["start"], r["flipped"]) for r in intervals.lifted(sites, chain, "id").collect()}
    assert got == {1: ("chr2", 200, False), 2: ("chr2", 219, False), 4: ("chr2", 225, False), 5: ("chr2", 254, False), 6: ("chr3", 349, True), 7: ("chr3", 340, True)}


def test_expected_pairs_equal_the_double_loop(spark):
    p = {("AC", 0): 3, ("CA", 2): 5, ("AC", 3): 2, ("GG", 5): 1}
    got = {(r["a"], r["b"], r["d"]): r["expected"] for r in kmers.expected_pairs(spark.createDataFrame([(k, i, n) for (k, i), n in p.items()], "kmer string, pos int, n long"), 10).collect()}
    want = {}
    for (a, i), x in p.items():
        for (b, j), y in p.items():
            if j >= i + 2:
                want[a, b, j - i] = want.get((a, b, j - i), 0) + x * y / 10
    assert got == pytest.approx(want)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text("#head\nA\t101\ti\tC\tG\t.\t.\tx\nA\t102\tj\tCC\tG\t.\t.\tx\n")
    (tmp_path / "in" / "b.vcf").write_text("A\t101\ti\tC\tG\t.\t.\tx\nA\t500\tk\tC\tG\t.\t.\tx\n")
    utr = spark.createDataFrame([("chrA", 50, 150, "G1", ".", "+", 3, 1, 50, 150)], files.UTR)
    variants = incoming.variant_stream(spark, str(tmp_path / "in"), 1)
    write = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"out/n={n}"))
    incoming.annotate_stream(variants, annotate.Annotations(utr), write, str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["var_id"], r["APA_info"]) for r in got] == [("chrA_101_C_G", "G1_+_1_3_common")] * 2 and {r["n"] for r in got} == {0, 1}
    (tmp_path / "reads").mkdir()
    (tmp_path / "reads" / "a.csv").write_text("2020-01-01 00:01:00,ACGT\n2020-01-01 00:02:00,ACG\n2020-01-01 00:06:00,AC\n")
    reads = spark.readStream.schema("ts timestamp, seq string").csv(str(tmp_path / "reads"))
    query = incoming.enrichment_stream(reads, 2).writeStream.outputMode("complete").format("memory").queryName("kmers_in").trigger(availableNow=True).start()
    query.awaitTermination(120)
    counts = {(r["window"]["start"].minute, r["kmer"]): r["n"] for r in spark.table("kmers_in").collect()}
    assert counts == {(0, "AC"): 2, (0, "CG"): 2, (0, "GT"): 1, (5, "AC"): 1}


def test_kept_model_and_training_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i % 2, i % 3 == 0, i % 5 == 0, i % 7 == 0, i % 2 == 1, i % 4 + 1, int((i * 7) % 10 > 4)) for i in range(200)], "in_eclip int, near_pas boolean, in_mir boolean, conserved boolean, shared_region boolean, number_isos int, label int")
    rows = rows.withColumns({c: F.col(c).cast("int") for c in training.TERMS}).withColumn("shared_region", F.col("number_isos").isin(1, 3).cast("int"))
    got = training.trained(rows, str(tmp_path / "model"))
    assert training.kept_model(spark, str(tmp_path / "model")) == got and set(got) == {"intercept", *training.TERMS}


def test_portions_are_bounded_and_keep_the_rows():
    import pandas as pd

    from utrflow.operators.arrays import portions

    part = pd.DataFrame({"id": range(300), "seq": ["A" * (i % 7 * 100) for i in range(300)], "acc": [np.zeros(i % 5 * 50) if i % 3 else None for i in range(300)]})
    got = list(portions(iter([part, part.iloc[:0], part]), 2000))
    assert [i for p in got for i in p["id"]] == [*range(300), *range(300)]
    assert max(p["seq"].str.len().sum() for p in got) <= 2000 and max(len(p) for p in got) < 300
    assert [len(p) for p in portions(iter([part.tail(3)]), 1)] == [1, 1, 1]


def test_sites_come_in_small_batches(spark):
    """No Arrow batch holds more than a few MB of reads, and the scores don't depend on the portions."""
    from utrflow.operators import structure

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 28))
    reads = spark.createDataFrame([(i, "ACGT" * 2500) for i in range(120)], "read_id long, seq string")
    got = structure.with_sites(reads, [structure.Motif(((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0)))], keep=["read_id"])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    rows = got.collect()
    assert len(rows) == 120 and all(sum(r["z_sites"]) == 2500 for r in rows)
